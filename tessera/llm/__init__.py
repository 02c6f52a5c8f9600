"""Operators for preparing training corpora: near-duplicate join, quality, sharding, dedup,
toxicity, byte-level BPE, licences, personal data, source mixing and exact vector search.

Nothing outside this subpackage imports it; queries and their SQL are in ``queries``.
"""
