"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.functions.scalar import rounded, rounded_double

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: HotSpot leaves methods beyond this many bytes of code to its interpreter; Spark's default lets generated ones grow to 65535.
METHOD_BYTES = "8000"
#: Doubles of one row from which on they are rounded together.
WIDE = 16


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)  # wide projections are compiled in parts
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def round_cols(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    wide = [n for n in names if kinds[n] == "double"]
    if len(wide) < WIDE:
        return df.withColumns({n: rounded(F.col(n), digits) for n in names})
    # One expression for all columns: written out for each, the generated code passes the limit of a method.
    other = {n: rounded(F.col(n), digits) for n in names if kinds[n] != "double"}
    df = df.withColumns({**other, "_rounded": F.transform(F.array(*wide), lambda x: rounded_double(x, digits))})
    return df.withColumns({n: F.col("_rounded")[i] for i, n in enumerate(wide)}).drop("_rounded")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return round_cols(df, [n for n, t in df.dtypes if t == "double"], digits)
