"""Exact byte-pair encoding of whole Arrow columns by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be merged, so the encoding has a boundary between the two. Cutting a text
there and encoding the fragments one by one gives the same ids, if the cut
also leaves the pre-tokenizer's matches alone. That holds when the cut lies at
the start of a character, the character before it is no white space (only
trailing white space is looked ahead from) and the one after it is no
apostrophe (which would begin a contraction). In natural text nearly every
word end is such a cut.

The cuts of a column are found in one numpy pass over its bytes, the fragments
become an Arrow array over the same buffer, Arrow's dictionary encoding leaves
each distinct fragment once, and only those go through the tokenizer; ids are
then gathered back by array indexing.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The pre-tokenizer pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text encoded at once; bounds a worker's memory, not the result.
SLICE_BYTES = 6_000_000

#: Distinct fragments remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 400_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> FragmentTokenizer:
    """The tokenizer of a rank file, loaded once in each Python worker."""
    return FragmentTokenizer(path)


class FragmentTokenizer:
    """Encoder of a byte-level BPE rank file (one base64 token and rank a line)."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = forced_cuts(ranks)
        self.known: dict[str, list[int]] = {}

    def fragments(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Starts of all fragments in ``data``; ``rows`` are the rows' byte offsets."""
        n = len(data)
        mark = np.zeros(n + 1, dtype=bool)
        if n > 1:
            at = np.flatnonzero(self.cut[data[:-1].astype(np.uint16) * 256 + data[1:]]) + 1
            mark[at[~after_wide_space(data, at)]] = True
        mark[rows] = True
        mark[n] = True
        return np.flatnonzero(mark)

    def _ids_of(self, fragments: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, encode = self.known, self.encoding.encode_ordinary
        out = []
        for f in fragments:
            ids = known.get(f)
            if ids is None:
                ids = known[f] = encode(f)
            out.append(ids)
        return out

    def _slice(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one slice: fragment index of each fragment, where rows begin among them, ids of the distinct ones, their lengths."""
        offsets, data = bytes_of(text)
        starts = self.fragments(data, offsets)
        pieces = pa.Array.from_buffers(
            pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        ids = self._ids_of(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lengths.sum()))
        return pieces.indices.to_numpy(), np.searchsorted(starts, offsets), flat, lengths

    def counts(self, text: pa.Array) -> np.ndarray:
        """Number of ids of each row; 0 for null and empty texts."""
        parts = []
        for piece in slices(text):
            index, begin, _, lengths = self._slice(piece)
            run = np.concatenate([[0], np.cumsum(lengths[index])])
            parts.append(run[begin[1:]] - run[begin[:-1]])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def encode(self, text: pa.Array) -> pa.Array:
        """The ids of each row as a list of int32; an empty list for null and empty texts."""
        parts = []
        for piece in slices(text):
            index, begin, flat, lengths = self._slice(piece)
            first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            each = lengths[index]
            run = np.concatenate([[0], np.cumsum(each)])
            gather = np.repeat(first[index] - run[:-1], each) + np.arange(run[-1])
            parts.append(pa.ListArray.from_arrays(pa.array(run[begin].astype(np.int32)), pa.array(flat[gather], type=pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.int32()))


def forced_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """Of all 65,536 byte pairs, those between which a cut is certain (but for white space of several bytes before it)."""
    cut = np.ones(65536, dtype=bool)
    for token in ranks:
        if len(token) > 1:
            t = np.frombuffer(token, dtype=np.uint8).astype(np.uint16)
            cut[t[:-1] * 256 + t[1:]] = False
    cut = cut.reshape(256, 256)
    cut[list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "), :] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False
    return cut.reshape(-1)


def after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space beyond ASCII."""
    last, mid, lead = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
    general = (mid == 0x80) & (((last >= 0x80) & (last <= 0x8A)) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)) | (mid == 0x81) & (last == 0x9F)
    three = (lead == 0xE2) & general | (lead == 0xE3) & (mid == 0x80) & (last == 0x80) | (lead == 0xE1) & (mid == 0x9A) & (last == 0x80)
    return two | three


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string array; null rows are empty."""
    if text.null_count:
        text = text.fill_null("")
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(text: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    """Slices of about SLICE_BYTES; a longer text is a slice of its own."""
    out = []
    for chunk in text.chunks if isinstance(text, pa.ChunkedArray) else [text]:
        if not len(chunk):
            continue
        offsets, _ = bytes_of(chunk)
        ends = [0]
        while ends[-1] < len(chunk):
            ends.append(max(ends[-1] + 1, int(np.searchsorted(offsets, offsets[ends[-1]] + SLICE_BYTES, side="right")) - 1))
        out += [chunk.slice(a, b - a) for a, b in zip(ends, ends[1:])]
    return out
