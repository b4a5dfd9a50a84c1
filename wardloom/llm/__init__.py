"""Training-data operators: deduplication, privacy, language, quality, scoring, tokenizing.

Nothing outside this subpackage imports it. ``entries`` registers its queries.
"""
