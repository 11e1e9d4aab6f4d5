"""Where queries register themselves, each with its SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanframe.sources.testdata import SQL_VIEWS, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Queries that read the events many times: they keep one decoded copy.
STORED = frozenset("A-01 A-03 A-10 A-12 A-39 A-41 A-42 A-45 A-50 I-05 J-11 S-22 S-29".split())


def query(name: str, sql: str | None = None):
    """Register ``plan(model)`` as query ``name``. ``sql`` is a SELECT, or ``x AS
    (...), ... SELECT``, that may use the views of SQL_VIEWS."""

    def add(plan: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Model(spark, sf_dir, stored=name in STORED))
        if sql is not None:
            body = sql.strip()
            SQL[name] = f"WITH {SQL_VIEWS}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
        return plan

    return add
