"""Page-range grammars as array expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = r"^\d+\s*(-\s*\d+)?$"
_BEYOND = 1 << 62


def _parts(spec: Column) -> Column:
    return F.transform(F.split(F.lower(F.trim(spec)), ","), lambda p: F.trim(p))


def _number(digits: Column) -> Column:
    """Digits as bigint; longer ones than fit lie beyond every document."""
    return F.coalesce(digits.try_cast("bigint"), F.lit(_BEYOND))


def _bounds(part: Column) -> Column:
    """Ordered first and last page of one well-formed part."""
    first = _number(F.regexp_extract(part, r"^(\d+)", 1))
    second = F.regexp_extract(part, r"-\s*(\d+)$", 1)
    last = F.when(second == "", first).otherwise(_number(second))
    return F.struct(
        F.least(first, last).alias("first"), F.greatest(first, last).alias("last")
    )


def merged(bounds: Column) -> Column:
    """Intervals in order, those that touch or overlap joined: as many as the spec has parts at most."""

    def step(runs: Column, b: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        joins = F.coalesce(b["first"] <= last["last"] + 1, F.lit(False))
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], b["last"]).alias("last"))
        before = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        return F.when(joins, F.concat(before, F.array(grown))).otherwise(F.concat(runs, F.array(b)))

    empty = F.lit([]).cast("array<struct<first: bigint, last: bigint>>")
    return F.aggregate(F.array_sort(bounds), empty, step)


def expand(runs: Column) -> Column:
    """The page numbers of merged intervals as one array, for short ranges."""
    numbers = F.flatten(F.transform(runs, lambda b: F.sequence(b["first"], b["last"])))
    return F.transform(numbers, lambda p: p.cast("int"))


#: Page numbers that are made at a time.
_BLOCK = 4096


def explode_runs(df: DataFrame, runs: Column, out: str = "page_number") -> DataFrame:
    """A row for each page of merged intervals. Long ones go through rows of one block each, so that no array
    holds more than a block, or one number a block."""
    blocks = F.flatten(F.transform(runs, lambda b: F.transform(
        F.sequence(b["first"], b["last"], F.lit(_BLOCK).cast("bigint")),
        lambda at: F.struct(at.alias("first"), F.least(at + (_BLOCK - 1), b["last"]).alias("last")),
    )))
    rows = df.withColumn("_block", F.explode(blocks))
    return rows.withColumn(out, F.explode(F.sequence("_block.first", "_block.last"))).withColumn(out, F.col(out).cast("int")).drop("_block")


def _is_all(spec: Column, *names: str) -> Column:
    return F.lower(F.trim(spec)).isin(*names)


def _whole(total: Column) -> Column:
    every = F.array(F.struct(F.lit(1).cast("bigint").alias("first"), total.cast("bigint").alias("last")))
    return F.when(total >= 1, every)


def strict_runs(spec: Column, total: Column) -> Column:
    """Merged intervals of pages, or null when any part is malformed or out of bounds.

    Blank, ``all`` and ``*`` select every page; reversed bounds are swapped.
    """
    parts = _parts(F.coalesce(spec, F.lit("all")))
    bounds = F.transform(parts, _bounds)

    def inside(b: Column) -> Column:
        return F.coalesce((b["first"] >= 1) & (b["last"] <= total.cast("bigint")), F.lit(False))

    valid = F.forall(parts, lambda p: p.rlike(_PART)) & F.forall(bounds, inside)
    return F.when(_is_all(F.coalesce(spec, F.lit("")), "", "all", "*"), _whole(total)).when(valid, merged(bounds))


def lenient_runs(spec: Column, total: Column) -> Column:
    """Merged intervals of pages with bad parts and outside pages dropped; null when none is left.

    Numbers are plain digits; signed forms count as malformed.
    """
    parts = F.filter(_parts(F.coalesce(spec, F.lit(""))), lambda p: p.rlike(_PART))
    clipped = F.transform(
        F.transform(parts, _bounds),
        lambda b: F.struct(
            F.greatest(b["first"], F.lit(1).cast("bigint")).alias("first"),
            F.least(b["last"], total.cast("bigint")).alias("last"),
        ),
    )
    left = F.filter(clipped, lambda b: b["first"] <= b["last"])
    return F.when(_is_all(spec, "all", "*"), _whole(total)).when(F.size(left) > 0, merged(left))


def strict_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of :func:`strict_runs`."""
    return expand(strict_runs(spec, total))


def lenient_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of :func:`lenient_runs`."""
    return expand(lenient_runs(spec, total))
