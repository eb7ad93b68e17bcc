"""Operators of a training-data pipeline, one module each, and their registered queries."""

from __future__ import annotations

from importlib import import_module

#: Modules that register a query; each has QUERIES and may have ORACLE_SQL.
MODULES = (
    "url_rules", "quality", "ngram_bloom", "minhash", "bpe_tree", "simhash", "perspectives", "toxicity", "media", "packing", "merkle",
    "substrings", "periodic",
)


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(import_module(f"{__name__}.{module}"), name, {}))
    return out


def queries() -> dict:
    """Query name -> callable(spark, sf_dir), for every operator of this subpackage."""
    return _collect("QUERIES")


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL, for the operators that SQL can express."""
    return _collect("ORACLE_SQL")
