"""Registry: one Spark query and, where SQL can express it, the same query as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.eventfeed import EventFeed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(body: str) -> str:
    """Prefix ``body`` with the named subqueries it mentions, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in CTES and name not in order:
                need_of = CTES[name]
                order_before = len(order)
                need(re.sub(rf"\b{name}\b", "", need_of))
                if name not in order[order_before:] and name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    """Select and settle the types: s text, i whole number, d day, fN rounded to N digits."""
    out = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind in ("s", "d"):
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        else:
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _fields(spec):
        name = f'"{name}"'
        if kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "d":
            c = f"CAST(CAST({name} AS DATE) AS VARCHAR)"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        else:
            c = f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0"
        out.append(f"{c} AS {name}")
    return compose(f"SELECT {', '.join(out)} FROM ({body}) AS answer")


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of the feed under ``name``."""

    def register(build: Callable[[EventFeed], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: present(build(EventFeed(spark, sf_dir)), spec)
        if sql is not None:
            ORACLE[name] = present_sql(sql, spec)
        return build

    return register
