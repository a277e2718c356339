"""Training-data operators: language, quality, secrets, personal data, duplicates, packing.

Nothing outside this subpackage imports it.
"""
