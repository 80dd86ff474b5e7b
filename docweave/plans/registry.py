"""The registry of queries: each operator applied to the logical tables, with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans.bindings import BINDINGS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def names_in(text: str) -> list[str]:
    """The logical tables that a text names, each after those it needs itself."""
    out: list[str] = []
    for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
        if word in BINDINGS:
            out += [x for x in [*names_in(BINDINGS[word]), word] if x not in out]
    return out


def with_bindings(text: str) -> str:
    """The query with its logical tables as common table expressions."""
    needed = names_in(text)
    if not needed:
        return text
    head = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in needed)
    body = text.strip()
    rest = f",\n{body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"\n{body}"
    return f"WITH {head}{rest}"


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the logical tables as the query of that name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = with_bindings(oracle)
        return f

    return add
