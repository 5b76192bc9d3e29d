"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_text, licenses, media, mixing, ngram_join, packing, pii, quality, repeats, token_files

MODULES = (mixing, token_files, ngram_join, packing, licenses, pii, repeats, html_text, quality, media)


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
