"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import (
    op01_embedding_dedup,
    op02_suffix_dedup,
    op03_decontamination,
    op04_url_filter,
    op05_toxicity,
    op06_ctw,
    op07_sharding,
    op08_simhash_dedup,
    op09_warc,
    op10_mixing,
    op11_token_ids,
    op12_collocations,
    op13_importance,
)

MODULES = (
    op01_embedding_dedup,
    op02_suffix_dedup,
    op03_decontamination,
    op04_url_filter,
    op05_toxicity,
    op06_ctw,
    op07_sharding,
    op08_simhash_dedup,
    op09_warc,
    op10_mixing,
    op11_token_ids,
    op12_collocations,
    op13_importance,
)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
