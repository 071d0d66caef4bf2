"""Training-data operators: deduplication, tokenising, packing, cleaning and scoring of documents.

Nothing else in the library imports this subpackage.
"""
