"""Evaluate an expensive expression once where it is used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound once; captured expressions inside lambdas would
    otherwise be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value is computed exactly once per row.

    A one-element generator keeps the optimiser from copying the expression into every later use
    and into filters pushed below it. The value is projected first: a generator with a lambda
    function inside is interpreted as a whole, a projection is compiled.
    """
    return df.withColumn("_computed", value).withColumn(name, F.explode(F.array("_computed"))).drop("_computed")
