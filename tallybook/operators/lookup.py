"""Joins against a table with one row per key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 1_021


def _row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """`left` with the columns of its one matching row in `right` (which is unique on `on`).

    An ordinary equi-join, so that adaptive execution splits keys that hold very many rows. Rows with a
    null key match nothing; they carry a spread number, so they are dealt over all tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    values = [c for c in right.columns if c not in on]
    complete = reduce(and_, [F.col(k).isNotNull() for k in on])
    packed = right.select(*on, *[F.col(f"`{c}`").alias(f"_lk_{i}") for i, c in enumerate(values)],
                          F.lit(0).cast("long").alias("_lk_spread"))
    lonely = 1 + F.pmod(_row_hash(left), F.lit(SPREAD))
    marked = left.filter(complete) if how == "inner" else left
    marked = marked.withColumn("_lk_spread", F.when(complete, F.lit(0)).otherwise(lonely))
    joined = marked.join(packed, [*on, "_lk_spread"], how)
    return joined.select(*[F.col(f"`{c}`") for c in left.columns],
                         *[F.col(f"_lk_{i}").alias(c) for i, c in enumerate(values)])
