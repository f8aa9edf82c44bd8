"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import edit_fingerprint, jaccard_join, language_id, learned_partitions, mixing, packing, sharding, substring_dedup, toxicity, warc_fixity

_MODULES = (learned_partitions, packing, language_id, substring_dedup, sharding, jaccard_join, warc_fixity, mixing, toxicity, edit_fingerprint)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
