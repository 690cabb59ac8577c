"""Operators for preparing large text corpora (training-data pipelines).

One module per operator; ``queries.py`` registers them over the bundled tables
and ``corpus_pipeline.py`` (repository top) chains five of them. Nothing else in
the library imports this subpackage.
"""
