"""Operators for preparing training text at scale.

Nothing outside this package (and ``corpus_pipeline.py``, which belongs to it) imports it.
Each module holds one operator with a general interface; ``queries.py`` applies them to
the given tables.
"""
