"""Training-data operators: each takes a DataFrame of documents and returns a DataFrame.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
