"""Operators of a training-data pipeline over `documents`, `embeddings`, `pages` and `benchmark`.

One module per operator; `queries` registers them, `corpus_pipeline.py` chains five of them.
"""
