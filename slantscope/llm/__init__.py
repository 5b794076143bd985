"""Training-data operators: tokenisation, filtering, deduplication, search, mixing.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
