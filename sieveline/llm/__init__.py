"""Training-data operators: deduplication, tokenisation, packing, archives, search.

Nothing outside this folder imports it.
"""
