"""Queries and SQL of the training-data operators and of the pipeline."""

from __future__ import annotations

from . import ann, exact_dedup, licenses, mixing, near_dedup, packing, pii, quality, resampling, sharding, spelling, token_output, urls

MODULES = [token_output, packing, licenses, near_dedup, pii, sharding, mixing, urls, ann, quality, exact_dedup, resampling, spelling]


def queries() -> dict:
    import corpus_pipeline

    return {name: q for m in MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    import corpus_pipeline

    found = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
