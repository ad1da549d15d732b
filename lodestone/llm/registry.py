"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, centroids, html_extraction, language_id, line_dedup, media, mixing, near_dup, pii, sentencepiece_spans, timestamps, toxicity, url_filters

MODULES = (url_filters, toxicity, mixing, sentencepiece_spans, near_dup, media, html_extraction, ann, language_id, pii, line_dedup, centroids, timestamps)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
