"""Training-data operators: deduplication, tokenisation, packing, filtering, extraction.

Nothing outside this subpackage imports it.
"""
