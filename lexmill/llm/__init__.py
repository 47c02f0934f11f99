"""Training-data operators: scoring, deduplication, mixing, archives, tokens and media at corpus scale.

Nothing outside this subpackage imports it.
"""
