"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, media, mixing, packing, quality, simhash, tokens, urls, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_urls": urls.op4_urls,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_licenses": licenses.op7_licenses,
    "op8_simhash": simhash.op8_simhash,
    "op9_media": media.op9_media,
    "op10_warc": warc.op10_warc,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_warc": warc.ORACLE,
}
