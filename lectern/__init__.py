"""lectern: document analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame[, options] -> DataFrame`` meant
for ``df.transform``; nothing runs before the caller's action, except where a
docstring says that a bounded table goes to the driver or that an iteration
cuts its lineage with a checkpoint.
"""
