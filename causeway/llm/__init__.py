"""Training-data operators: deduplication, mixing, fingerprints, tokens, packing, PII, secrets, language and URLs.

Nothing outside this subpackage imports it.
"""
