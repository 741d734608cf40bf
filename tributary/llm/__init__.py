"""Training-data operators: language ID, token counts, media columns, near-duplicates, filters, packing, PII.

Nothing outside this subpackage imports it; ``entry`` holds the registered queries.
"""
