"""Quality rules: base rules on words, then robust outlier rejection per language and source.

The verdict comes from minimum-covariance-determinant estimates: the mean and covariance of that part of a
group's documents that lies closest together, found by concentration steps. A document far from its group in
Mahalanobis distance is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm.shared import WORD_SPACE, blocks, giving_back, mix, split_words, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistic vector. Shares are taken per word with PRIOR_WORDS words of usual text added, so that short
#: texts do not stand out by chance, and enter by their square root, which evens out the spread of counts.
VECTOR = ("word_length", "symbols", "capitals", "marks", "dup_lines", "repeats")
PRIOR_WORDS = 40.0
#: Characters, capitals and punctuation marks of a word of usual text.
PRIOR_LENGTH, PRIOR_CAPITALS, PRIOR_MARKS = 6.0, 0.12, 0.15
#: No direction of the vector is taken to vary less than this.
FLOOR = (0.03, 0.05, 0.05, 0.05, 0.15, 0.12)
#: Share of a group that an estimate rests on, and the chance at which a usual document would be rejected.
SUPPORT, REJECTED_BY_CHANCE = 0.75, 1e-7
#: The fewest documents that an estimate is made from.
LEAST_GROUP = 60
STEPS = 5
_STATS = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", vector array<double>"


def _marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters that belong to words, symbols, ASCII capitals and ASCII punctuation of each text."""
    kinds = np.zeros((256, 4), np.int64)
    kinds[:, 0] = [b & 0xC0 != 0x80 and b not in WORD_SPACE.encode() for b in range(256)]
    kinds[list(SYMBOLS.encode()), 1] = 1
    kinds[65:91, 2] = 1
    kinds[list(b"!?.,;:\"'()-"), 3] = 1
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = []
    for pair in ((0, 1), (2, 3)):
        packed = kinds[:, pair[0]] | kinds[:, pair[1]] << 32
        total = np.concatenate(([0], np.cumsum(packed[data])))
        each = total[offsets[1:]] - total[offsets[:-1]]
        out += [each & 0xFFFFFFFF, each >> 32]
    return tuple(out)


def _repeated(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row inside a window of WINDOW words that occurs more than once in the row."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return np.zeros(n_rows, np.int64)
    words = mix(codes.astype(np.uint64) + np.uint64(1))
    window = mix(rows[:n].astype(np.uint64))
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    window = mix(window[at])
    order = np.argsort(window)
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + WINDOW] -= 1
    return np.bincount(rows[np.cumsum(edge)[:-1] > 0], minlength=n_rows)


def _dup_lines(text: str) -> tuple[int, int]:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0, len(lines)
    worded = [x for x in lines if x.strip(WORD_SPACE)]
    return len(worded) - len(set(worded)), len(lines)


def _stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = batch.column("text")
        codes, rows, _ = split_words(texts)
        n = np.bincount(rows, minlength=len(texts))
        chars, symbols, capitals, marks = _marks(texts)
        lines = np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
        repeats = _repeated(codes, rows, len(texts))
        usual = n + PRIOR_WORDS
        vector = np.stack(
            [
                np.log((chars + PRIOR_WORDS * PRIOR_LENGTH) / usual),
                np.sqrt(symbols / usual),
                np.sqrt((capitals + PRIOR_WORDS * PRIOR_CAPITALS) / usual),
                np.sqrt((marks + PRIOR_WORDS * PRIOR_MARKS) / usual),
                np.sqrt(lines[:, 0] / (lines[:, 1] + 4.0)),
                np.sqrt(repeats / usual),
            ],
            axis=1,
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["doc_id", "lang", "source"]).columns, *(pa.array(c.astype(np.int64)) for c in (n, chars, symbols, lines[:, 0], repeats)), pa.array(list(vector), pa.list_(pa.float64()))],
            ["doc_id", "lang", "source", *COUNTS, "vector"],
        )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts and ``base_failed`` of every document, with its vector."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.mapInArrow(giving_back(_stats), _STATS).withColumn("base_failed", failed)


def _chi_tail(x: float, half: int) -> float:
    """Chance that a chi-squared variable with ``2 * half`` degrees of freedom exceeds ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _chi_point(tail: float, half: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_tail(middle, half) > tail else (low, middle)
    return low


CUTOFF = _chi_point(REJECTED_BY_CHANCE, len(VECTOR) // 2)
#: The covariance of the closest SUPPORT of normal data is too small by this factor.
CONSISTENCY = SUPPORT / (1 - _chi_tail(_chi_point(1 - SUPPORT, len(VECTOR) // 2), len(VECTOR) // 2 + 1))


def estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Center, inverse covariance and log determinant from a group's sums; the floor is added to the variances."""
    p = len(VECTOR)
    center = sums / n
    upper = np.zeros((p, p))
    upper[np.triu_indices(p)] = products / n
    full = upper + np.triu(upper, 1).T
    covariance = CONSISTENCY * (full - np.outer(center, center)) + np.diag(np.square(FLOOR))
    return center, np.linalg.inv(covariance), float(np.linalg.slogdet(covariance)[1])


def _estimates(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples():
            center, inverse, size = estimate(row.n, np.array(row.sums), np.array(row.products))
            rows.append((row.unit, row.start, center.tolist(), inverse.ravel().tolist(), size))
        yield pd.DataFrame(rows, columns=["unit", "start", "center", "inverse", "size"])


_ESTIMATE = "unit string, start int, center array<double>, inverse array<double>, size double"
_P = len(VECTOR)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _moments(rows: DataFrame) -> DataFrame:
    """Estimates of each unit and start from the vectors in ``rows``; sums are combined before the shuffle."""
    v = [F.col("vector")[i] for i in range(_P)]
    sums = rows.groupBy("unit", "start").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x) for x in v]).alias("sums"),
        F.array(*[F.sum(v[i] * v[j]) for i, j in _PAIRS]).alias("products"),
    )
    return sums.mapInPandas(giving_back(_estimates), _ESTIMATE)


def _distance() -> F.Column:
    """Squared Mahalanobis distance of ``vector`` by ``center`` and ``inverse``."""
    d = [F.col("vector")[i] - F.col("center")[i] for i in range(_P)]
    return sum((d[i] * d[j] * F.col("inverse")[i * _P + j] * (1.0 if i == j else 2.0) for i, j in _PAIRS), F.lit(0.0))


#: Distances are ranked on a grid of this many steps for each doubling, ties included whole.
GRID = 64


def _closest(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The rows in each unit's closest SUPPORT by each start's estimate. The bounds come from counts for each
    step of the grid, so no unit's distances are gathered or sorted."""
    step = F.floor(F.log2(F.lit(1.0) + F.greatest(_distance(), F.lit(0.0))) * GRID).cast("int")
    placed = rows.join(estimates.drop("size"), "unit").select("unit", "start", "vector", step.alias("step"))
    counts = placed.groupBy("unit", "start", "step").agg(F.count("*").alias("n"))
    one = Window.partitionBy("unit", "start")
    counts = counts.withColumn("upto", F.sum("n").over(one.orderBy("step"))).withColumn("all", F.sum("n").over(one))
    bounds = counts.where(F.col("upto") >= SUPPORT * F.col("all")).groupBy("unit", "start").agg(F.min("step").alias("bound"))
    return attach(placed, bounds, ["unit", "start"], "inner").where("step <= bound").select("unit", "start", "vector")


def _units(stats: DataFrame) -> DataFrame:
    """Language and source with ``unit``, the estimate that judges them (null without one), and ``feeds``,
    the estimates that their documents enter: their own, and the language's where it judges small groups."""
    counts = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    one = Window.partitionBy("lang")
    own = F.when(F.col("n") >= LEAST_GROUP, F.to_json(F.struct("lang", "source", F.lit("group").alias("of"))))
    serves = (F.sum("n").over(one) >= LEAST_GROUP) & (F.min("n").over(one) < LEAST_GROUP)
    language = F.when(serves, F.to_json(F.struct("lang", F.lit("language").alias("of"))))
    return counts.select("lang", "source", F.coalesce(own, language).alias("unit"), F.array_compact(F.array(own, language)).alias("feeds"))


def fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The estimate of each unit over ``unit, vector`` rows.

    Two starts, the plain moments of all rows and the coordinate-wise medians with their absolute
    deviations, are concentrated ``steps`` times; the smaller determinant wins. Each step writes its
    few rows, so a lost executor never costs more than a step.
    """
    v = [F.col("vector")[i] for i in range(_P)]
    plain = _moments(rows.withColumn("start", F.lit(0)))
    middle = rows.groupBy("unit").agg(F.array(*[F.percentile_approx(x, 0.5, 2000) for x in v]).alias("center"))
    spread = rows.join(middle, "unit").groupBy("unit").agg(
        F.first("center").alias("center"),
        F.array(*[F.percentile_approx(F.abs(x - F.col("center")[i]), 0.5, 2000) for i, x in enumerate(v)]).alias("mad"),
    )
    zero = F.lit(0.0)
    scale = [1 / (F.pow(F.col("mad")[i] * 1.4826, 2) + FLOOR[i] ** 2) for i in range(_P)]
    medians = spread.select(
        "unit", F.lit(1).alias("start"), "center",
        F.array(*[scale[i] if i == j else zero for i in range(_P) for j in range(_P)]).alias("inverse"), zero.alias("size"),
    )
    estimates = written(plain.unionByName(medians), "estimates")
    for _ in range(steps):
        estimates = written(_moments(_closest(rows, estimates)), "estimates")
    best = F.min_by(F.struct("center", "inverse"), F.struct("size", "start")).alias("best")
    return written(estimates.groupBy("unit").agg(best).select("unit", "best.*"), "estimates")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``distance`` of every document.

    A document is kept if it passes the base rules and its squared distance to its group's robust
    center is at most ``cutoff``. Groups are language and source; a null is a value of its own. Groups of
    fewer than ``LEAST_GROUP`` documents are judged by their whole language's estimate; documents of a
    smaller language have no estimate and pass. A null text has no words and fails. Repeated rows are judged alike. Only the small
    statistics are written; estimates are one row for each group.
    """
    stats = written(statistics(docs), "statistics")
    units = written(_units(stats), "units")
    known = F.coalesce(F.to_json(F.struct("lang", "source")), F.lit(""))  # joins nulls with nulls
    units = units.select(known.alias("_group"), "unit", "feeds")
    keyed = stats.withColumn("_group", known).join(units, "_group", "left").drop("_group")
    best = fit(keyed.where("NOT base_failed").select(F.explode("feeds").alias("unit"), "vector"))
    judged = keyed.join(best, "unit", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance")
