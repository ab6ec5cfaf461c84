"""Training-data operators: dedup, scoring, encoding, packing, extraction and classification of text corpora.

Nothing else in the library imports this subpackage.
"""
