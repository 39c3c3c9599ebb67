"""Joins and firsts that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 1024


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of a side with hot keys to a side with one row per key.

    Adaptive execution splits a skewed partition only if both inputs of the join come straight
    from a shuffle made for it. A side that was just aggregated on the keys has none, so the join
    uses a derived key, which gives either side its own. Small sides still broadcast by size.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    key = F.when(known, F.struct(*[F.col(k) for k in keys]))
    return (
        left.withColumn("_key", key)
        .join(right.withColumn("_key", key).drop(*keys), "_key", how)
        .drop("_key")
    )


def flag_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread_by: Sequence[str], out: str = "is_first"
) -> DataFrame:
    """Adds whether a row is the first of its key; rows of a hot key are spread over many tasks.

    Rows are ranked inside (key, salt) first. Only each salt's leader goes on to the final ranking
    of the key, at most ``SALTS`` rows; all others stay apart in their own salt. ``spread_by`` are
    the columns that tell rows of one key apart.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    group = F.when(F.col("_leads"), F.lit(-1)).otherwise(F.col("_salt"))
    final = Window.partitionBy(*keys, "_group").orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_leads", F.row_number().over(local) == 1)
        .withColumn("_group", group)
        .withColumn(out, F.col("_leads") & (F.row_number().over(final) == 1))
        .drop("_salt", "_leads", "_group")
    )
