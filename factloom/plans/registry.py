"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name, with SQL that gives the same rows."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_form(name: str, table: str, key: str, inputs: dict[str, list[str]], outputs: dict[str, list[str]], compute: Callable[..., dict[str, Column]]) -> None:
    """Registers a query that applies column functions to every row of a table.

    A row's inputs are written in one of several forms, chosen by its key n; the SQL states what must come out of each
    form, as an expression of n.
    """
    many = len(next(iter(inputs.values())))
    if any(len(v) != many for v in (*inputs.values(), *outputs.values())):
        raise ValueError(f"{name}: forms differ in number")
    case = lambda forms: f"CASE n % {many} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"

    def run(spark, folder):
        rows = read(spark, folder, table).select(F.col(key).alias("n"))
        given = rows.select("n", *(F.expr(case(v)).alias(c) for c, v in inputs.items()))
        found = compute(*(F.col(c) for c in inputs))
        return given.select(F.col("n").alias(key), *(found[c].alias(c) for c in outputs))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"WITH r AS (SELECT {key} AS n FROM {table}) SELECT n AS {key}, " + ", ".join(f"{case(v)} AS {c}" for c, v in outputs.items()) + " FROM r"
