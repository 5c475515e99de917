"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from matchflow.llm import (
    bpe, compress, decontaminate, licenses, negatives, neighbours, ngram_join, packing, pii, secrets, topk, toxicity,
    warc,
)

_MODULES = (
    ngram_join, warc, bpe, topk, pii, toxicity, decontaminate, secrets, licenses, packing, compress, negatives,
    neighbours,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
