"""Operators of a training-data pipeline: quality, tokens, dedup, mixing, packing, media and archives.

Nothing outside this subpackage imports it.
"""
