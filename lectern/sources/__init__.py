"""Readers of tables, file trees and text exports."""
