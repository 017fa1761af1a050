"""Registry of queries with their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans.fixture_sql import CTES
from parley.plans.fixtures import Fx
from parley.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str) -> list[str]:
    """Fixture views a statement uses, in an order that resolves their own needs."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTES and name not in out:
                add(re.sub(rf"\b{name}\b", "", CTES[name]))
                out.append(name)

    add(sql)
    return out


def oracle(sql: str) -> str:
    """A full statement: the fixture views, then the query (which may bring own CTEs)."""
    sql = sql.strip()
    # a view used many times is computed once; a recursive one takes no such hint
    views = [
        f"{n} AS {'' if re.search(rf'{n}\b', CTES[n]) else 'MATERIALIZED '}({CTES[n].strip()})" for n in _needed(sql)]
    body = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    if body:
        views.append(sql[body.end():])
        return "WITH RECURSIVE " + ",\n".join(views)
    return ("WITH RECURSIVE " + ",\n".join(views) + "\n" + sql) if views else sql


def query(name: str, sql: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under a name, with its DuckDB statement if any."""

    def deco(fn: Callable[[Fx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Fx(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return deco
