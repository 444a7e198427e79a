"""Corpus operators for training-data pipelines, each a Spark job over whole tables.

Nothing else in the library imports this package; the registry adds its
queries only when it is present. Vocabulary files are parameters and are never
copied here.
"""
