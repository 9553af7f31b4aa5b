"""Training-data operators: deduplication, filtering, tokenising, mixing and archiving.

Nothing outside this subpackage imports it.
"""
