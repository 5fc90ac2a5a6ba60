"""Training-data operators: deduplication, extraction, mixing, token accounting and archives.

Nothing else in the library imports this subpackage.
"""
