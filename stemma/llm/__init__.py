"""Training-data operators: filtering, deduplication, scanning, extraction and tokenisation of corpora.

Nothing else in the library imports this subpackage.
"""
