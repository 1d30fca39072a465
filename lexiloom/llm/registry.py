"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import credentials, exact_dedup, html_extract, mixing, packing, quality, rollup, simhash, toxicity, warc

MODULES = (credentials, exact_dedup, html_extract, mixing, packing, quality, rollup, simhash, toxicity, warc)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
