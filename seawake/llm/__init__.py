"""Training-data operators: WARC archives, quality, deduplication, privacy, mixing, packing.

Nothing outside this subpackage (but for ``corpus_pipeline.py`` and the guard
in ``__spark_entry__.py``) imports it.
"""
