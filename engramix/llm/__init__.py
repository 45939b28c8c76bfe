"""Training-corpus operators: quality, language, near-duplicates, packing, search, extraction, formatting.

Nothing outside this subpackage imports it.
"""
