"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus the
DuckDB SQL that computes the same result (the correctness oracle)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("tessera.plans.q_etl", "tessera.plans.q_profile", "tessera.plans.q_eval",
            "tessera.plans.q_text", "tessera.plans.q_tokens", "tessera.plans.q_runlog",
            "tessera.plans.q_datasets", "tessera.plans.q_vectors", "tessera.plans.q_io",
            "tessera.plans.q_stream")


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as exc:
            if exc.name != m:
                raise


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
