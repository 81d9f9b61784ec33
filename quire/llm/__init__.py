"""Operators for preparing training corpora: search, dedup, scoring, mixing, packing.

Nothing outside this subpackage imports it; ``queries.QUERIES`` lists what it registers.
"""
