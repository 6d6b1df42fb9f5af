"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import importlib

MODULES = ["q_urlfilter", "q_mixing", "q_multiindex", "q_repeats", "q_sharding", "q_quality", "q_tokencount", "q_warc", "q_decontam", "q_simhash", "q_pages", "q_fim", "q_filteraudit"]


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in _modules() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
