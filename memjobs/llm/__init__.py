"""Training-data operators: filtering, deduplication, extraction and tokenisation of text corpora.

Nothing else in the library imports this subpackage.
"""
