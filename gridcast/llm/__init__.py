"""Training-data operators: deduplication, mixing, sharding, packing, search and labelling of text corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
