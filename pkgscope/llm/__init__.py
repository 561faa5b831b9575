"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder, ``corpus_pipeline.py`` and their tests imports it.
"""
