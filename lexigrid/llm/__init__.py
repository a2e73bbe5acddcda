"""Training-data operators: dedup, filters, extraction, scoring and tokenisation.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
