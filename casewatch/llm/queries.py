"""Queries of this folder and their SQL counterparts."""

from __future__ import annotations

from casewatch.llm import exact, forest, html, license, lines, manifest, mixing, packing, phrases, quality, repeats, toxic, warc

MODULES = [warc, exact, forest, repeats, html, toxic, license, quality, mixing, packing, manifest, lines, phrases]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in getattr(m, "SQL", {}).items()}
