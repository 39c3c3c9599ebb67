"""Hard negatives by a vertical scan: vectors lie by columns, and each anchor reads them in its own order.

An anchor reads the dimensions in descending magnitude of its components. After some of them every candidate
has a partial score, and the least and greatest that the dimensions left can still add bound the whole one;
candidates outside every window that is still open leave the bitmap, until the exact scores decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW_SHARE, HIGH_SHARE, WHOLE = 30, 90, 100
#: Most rows of a part of the table and most anchors of a block; small tables still have several parts.
PART_ROWS, ANCHOR_ROWS, LEAST_ROWS = 131_072, 131_072, 2_048
#: Dimensions read between two looks at the bounds, and candidates looked at together.
STEP, CHUNK = 16, 8_192
_LONG = 2**63 - 1

_SIDE = "label long, ids binary, values binary, n int, width int"
_BLOCKS = pa.schema([("label", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("n", pa.int32()), ("width", pa.int32())])
_BEST = "anchor_id long, score long, found_id long"
_BEST_ARROW = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("found_id", pa.int64())])
_HITS = "anchor_id long, positive_score long, score long, found_id long"
_HITS_ARROW = pa.schema([("anchor_id", pa.int64()), ("positive_score", pa.int64()), ("score", pa.int64()), ("found_id", pa.int64())])


class Columns:
    """Vectors dimension by dimension, ordered by label and id, with the least and greatest value of each
    dimension in every chunk of rows.

    Values are whole numbers. Single precision adds them exactly while no sum of products reaches 2**24,
    double precision up to 2**53, and Python's integers beyond; ``kind`` says which.
    """

    def __init__(self, values: np.ndarray, ids: np.ndarray, labels: np.ndarray, kind: type) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.values = _typed(np.ascontiguousarray(values[order].T), kind)
        chunks = range(0, len(ids), CHUNK)
        self.low = [self.values[:, at : at + CHUNK].min(axis=1) for at in chunks]
        self.high = [self.values[:, at : at + CHUNK].max(axis=1) for at in chunks]

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def _typed(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return values.astype(kind)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type that adds all products of a row of ``a`` and one of ``b`` exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Windows:
    """The ``k`` best ``(score, id)`` of each score window, both ends included."""

    def __init__(self, lows: list, highs: list, k: int) -> None:
        self.floors, self.highs, self.k = list(lows), list(highs), k  # the least score that still enters each
        self.best: list[list[tuple[int, int]]] = [[] for _ in lows]

    def open(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which candidates may still enter a window."""
        keep = np.zeros(len(lower), bool)
        for low, high in zip(self.floors, self.highs, strict=True):
            keep |= (upper >= low) & (lower <= high)
        return keep

    def enter(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (low, high) in enumerate(zip(self.floors, self.highs, strict=True)):
            at = np.flatnonzero((scores >= low) & (scores <= high))
            if not len(at):
                continue
            if len(at) > 4 * self.k:  # only rows as high as the k-th can enter
                at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
            rivals = self.best[w] + list(zip((int(x) for x in scores[at]), ids[at].tolist(), strict=True))
            rivals.sort(key=lambda x: (-x[0], x[1]))
            self.best[w] = rivals[: self.k]
            if len(self.best[w]) == self.k:
                self.floors[w] = max(low, self.best[w][-1][0])


def scan(columns: Columns, anchor: np.ndarray, windows: Windows, low: int, high: int, skip_id: int | None = None, skip_label: int | None = None) -> None:
    """Reads the rows from ``low`` up to ``high`` into the windows, but for those of an id or a label."""
    order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
    weights, width = anchor[order], len(order)
    for number in range(low // CHUNK, -(-high // CHUNK)):
        start, stop = max(low, number * CHUNK), min(high, (number + 1) * CHUNK)
        ends = weights * columns.low[number][order], weights * columns.high[number][order]
        # what the dimensions from the i-th on can add at least and at most
        least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (np.minimum(*ends), np.maximum(*ends)))
        alive, partial = None, np.zeros(stop - start, columns.values.dtype)
        keep = np.ones(stop - start, bool)
        if skip_id is not None:
            keep &= columns.ids[start:stop] != skip_id
        if skip_label is not None:
            keep &= columns.labels[start:stop] != skip_label
        keep &= windows.open(partial + least[0], partial + most[0])
        read = 0
        while True:
            if not keep.all():
                at = np.flatnonzero(keep)
                alive, partial = (at + start) if alive is None else alive[at], partial[at]
            if read == width or not len(partial):
                break
            dims = order[read : read + STEP]
            part = columns.values[dims, start:stop] if alive is None else columns.values[dims[:, None], alive[None, :]]
            partial = partial + weights[read : read + STEP] @ part
            read += len(dims)
            keep = windows.open(partial + least[read], partial + most[read])
        if len(partial):
            windows.enter(partial, columns.ids[start:stop] if alive is None else columns.ids[alive])


def _unpacked(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and values; narrower vectors end in zeros, which add nothing to a product."""
    width = max(side.column("width").to_pylist(), default=0)
    ids, labels, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, width))]
    for row in side.to_pylist():
        own = np.frombuffer(row["values"], np.float64).reshape(row["n"], row["width"])
        ids.append(np.frombuffer(row["ids"], np.int64))
        labels.append(np.full(row["n"], row["label"], np.int64))
        values.append(np.pad(own, ((0, 0), (0, width - row["width"]))))
    return np.concatenate(ids), np.concatenate(labels), np.concatenate(values)


def _met(anchors: pa.Table, rows: pa.Table) -> tuple[list[tuple[int, int, np.ndarray]], Columns]:
    """Both sides in one exact type and as wide as the wider: anchors as (id, label, values)."""
    (a_ids, a_labels, a), (ids, labels, b) = _unpacked(anchors), _unpacked(rows)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    kind = exact_kind(a, b)
    return list(zip(a_ids.tolist(), a_labels.tolist(), _typed(a, kind), strict=True)), Columns(b, ids, labels, kind)


def _long(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _columns_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * len(schema))], schema=schema)


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of the anchors' own labels in one part of the table."""
    out: list[tuple[int, int, int]] = []
    if anchors.num_rows and rows.num_rows:
        own, columns = _met(anchors, rows)
        for anchor, label, value in own:
            windows = Windows([-np.inf], [np.inf], POSITIVES)
            scan(columns, value, windows, *columns.of_label(label), skip_id=anchor)
            out.extend((anchor, _long(score), row) for score, row in windows.best[0])
    return _columns_of(out, _BEST_ARROW)


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of other labels inside the windows of the anchors' positives, in one part of the table."""
    out: list[tuple[int, int, int, int]] = []
    blocks = anchors.filter(pc.is_valid(anchors.column("ids")))
    asked = anchors.filter(pc.is_valid(anchors.column("anchor_id")))
    scores = dict(zip(asked.column("anchor_id").to_pylist(), asked.column("scores").to_pylist(), strict=True))
    if scores and blocks.num_rows and rows.num_rows:
        own, columns = _met(blocks, rows)
        for anchor, label, value in own:
            wanted = sorted({s for s in scores.get(anchor, ()) if s >= 0}, reverse=True)  # others have empty windows
            if wanted:
                windows = Windows([-(-LOW_SHARE * s // WHOLE) for s in wanted], [HIGH_SHARE * s // WHOLE for s in wanted], NEGATIVES)
                scan(columns, value, windows, 0, len(columns.ids), skip_label=label)
                out.extend((anchor, s, _long(score), row) for s, best in zip(wanted, windows.best, strict=True) for score, row in best)
    return _columns_of(out, _HITS_ARROW)


def _columnar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``vec_id, label, q`` as one row for each label and width of a batch."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        q = batch.column("q")
        flat = pc.list_flatten(q).to_numpy(zero_copy_only=False)
        widths = pc.list_value_length(q).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(widths) - widths
        rows = []
        for label, width in sorted(set(zip(labels.tolist(), widths.tolist(), strict=True))):
            at = np.flatnonzero((labels == label) & (widths == width))
            own = flat[starts[at][:, None] + np.arange(width)]
            rows.append((label, ids[at].astype(np.int64).tobytes(), own.astype(np.float64).tobytes(), len(at), width))
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCKS.names, r, strict=True)) for r in rows], schema=_BLOCKS)


def _parts(rows: DataFrame, n: int, most: int, name: str) -> tuple[DataFrame, int]:
    """Rows packed by label into about equal parts, numbered in the column ``name``."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // most), min(cores, -(-n // LEAST_ROWS)))
    number = F.pmod(F.xxhash64("vec_id", "q"), F.lit(parts)).cast("int").alias(name)
    keyed = rows.select(number, "vec_id", "label", "q").repartition(parts, name).sortWithinPartitions(name)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pc.unique(batch.column(name)).to_pylist():
                own = batch.filter(pc.equal(batch.column(name), part))
                for block in _columnar([own]):
                    yield pa.RecordBatch.from_arrays([pa.array([part] * block.num_rows, pa.int32()), *block.columns], [name, *block.schema.names])

    return keyed.mapInArrow(packed, f"{name} int, {_SIDE}"), parts


def _usable() -> Column:
    bad = "x -> x IS NULL OR isnan(x) OR abs(x * 256d) = double('Infinity')"
    return F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, {bad})")


def hard_negatives(embeddings: DataFrame, every: int = 100, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, best negatives first.

    Anchors are the rows whose id ``every`` divides; each is compared with the whole table, in pairs of a block
    of anchors and a part of the rows. A row without id, label or vector, or with a null or non-finite component
    (also once multiplied by 256), takes no part. An empty vector has the score 0 with every other, a shorter
    one ends in zeros. An id that several rows share is an anchor once, with the least (label, vector) of them;
    as candidates each row stands for itself, and none is a positive of its own id. A score beyond a long is
    held at its end. Ties go to the smaller id. Windows of negative scores are empty. No rows give no rows.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(_usable())
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # floor() of a double is a long, too small for the largest ones: x - x % 1 goes down from below zero
    whole = F.transform("embedding", lambda x: _floor(x * F.lit(256.0)))
    rows = written(rows.select("vec_id", moved.alias("label"), whole.alias("q")), "quantised")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v"))
    anchors = written(anchors.select("vec_id", "v.label", "v.q"), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    table, parts = _parts(rows, n_rows, PART_ROWS, "part")
    table = written(table, "columns")
    blocks = max(1, -(-n_anchors // ANCHOR_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    packed = written(_packed_anchors(anchors.select(block, "vec_id", "label", "q")), "anchor_blocks")

    whole_table = table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("part", "block")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    found = packed.select("*", each_part).groupBy("part", "block").cogroup(whole_table).applyInArrow(_positives, _BEST)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    positives = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    positives = written(positives.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")

    windows = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    windows = windows.select(F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int").alias("block"), "anchor_id", "scores")
    asked = packed.unionByName(windows, allowMissingColumns=True).select("*", each_part)
    hits = asked.groupBy("part", "block").cogroup(whole_table).applyInArrow(_negatives, _HITS)
    first = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "found_id")
    hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)
    return positives.join(hits, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _floor(x: Column) -> Column:
    rest = x % F.lit(1.0)
    return x - rest - F.when(rest < 0, F.lit(1.0)).otherwise(F.lit(0.0))


def _packed_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors as columnar rows by block."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in pc.unique(batch.column("block")).to_pylist():
                own = batch.filter(pc.equal(batch.column("block"), block))
                for side in _columnar([own]):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * side.num_rows, pa.int32()), *side.columns], ["block", *side.schema.names])

    return anchors.mapInArrow(packed, f"block int, {_SIDE}")
