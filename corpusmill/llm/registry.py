"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import exact_dedup, lm, mixing, near_dedup, outliers, pieces, quality, secrets, url_filter, warc

QUERIES = {f.__name__: f for f in (url_filter.op1_url_filter, secrets.op2_secret_scan, lm.op3_lm_scores, pieces.op4_pieces, quality.op5_quality_classifier, exact_dedup.op6_exact_dedup, near_dedup.op7_near_dedup, mixing.op8_mix_sources, outliers.op9_quality_rules, warc.op10_warc)}
SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_quality_rules": outliers.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}
