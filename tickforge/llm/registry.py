"""Every query of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, extract, language, merkle, mixing, periodic, pii, quality, simhash, substrings, warc

MODULES = (extract, pii, mixing, simhash, warc, substrings, chat, language, decontaminate, quality, periodic, merkle, bpe)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
