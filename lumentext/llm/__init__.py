"""Operators for large-scale training-data pipelines.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded registration in
``__spark_entry__.py``) imports it.
"""
