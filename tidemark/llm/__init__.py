"""Training-data operators: quality, deduplication, language, URLs, tokens, packing.

Nothing outside this subpackage imports it.
"""
