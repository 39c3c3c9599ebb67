"""User functions over pages, micro-batches and documents, and the image measurements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quire.operators.extraction import normalize_extraction, parse_annotation
from quire.operators.windows import micro_batches

MAX_ATTEMPTS = 3
MIN_SHORT_SIDE = 1200
MAX_LONG_SIDE = 3600
ANALYSIS_SIDE = 420


def process_pages(
    pages: DataFrame,
    fn: Callable[[int, int, str], str],
    retryable: Callable[[Exception], bool] = lambda error: False,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """``fn(document_id, page_number, markdown)`` per page: (…, result, error, attempts).

    A failing page yields its error text; others are unaffected. Errors for which ``retryable``
    holds are tried again up to ``max_attempts``. Parallel calls are bounded by the partitions.
    """
    id_type = dict(pages.dtypes)["document_id"]
    page_type = dict(pages.dtypes)["page_number"]

    def attempt(document: object, page: int, text: str) -> tuple[str | None, str | None, int]:
        for number in range(1, max_attempts + 1):
            try:
                return fn(document, page, text), None, number
            except Exception as error:
                if number == max_attempts or not retryable(error):
                    return None, str(error), number
        raise AssertionError("max_attempts must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = [
                attempt(d, p, t)
                for d, p, t in zip(batch["document_id"], batch["page_number"], batch["markdown"], strict=True)
            ]
            out = batch[["document_id", "page_number"]].copy()
            out["result"] = [o[0] for o in outcomes]
            out["error"] = [o[1] for o in outcomes]
            out["attempts"] = [o[2] for o in outcomes]
            yield out

    return pages.select("document_id", "page_number", "markdown").mapInPandas(
        run, f"document_id {id_type}, page_number {page_type}, result string, error string, attempts int"
    )


def process_batches(
    job_pages: DataFrame, fn: Callable[[list[int], list[str]], dict[int, str | Exception]], size: int = 8
) -> DataFrame:
    """``fn(pages, texts)`` per micro-batch of queued pages: (job_id, page_number, batch_number, result, error).

    The function returns a result or an exception per page; pages it leaves out, or all pages
    when it raises, become errors. A group holds at most ``size`` pages.
    """
    types = dict(job_pages.dtypes)
    keys = ["job_id", "batch_number"]

    def call(numbers: list[int], texts: list[str]) -> list[str | Exception]:
        try:
            results = fn(numbers, texts)
        except Exception as error:
            results = dict.fromkeys(numbers, error)
        return [results.get(p, RuntimeError("No batch result returned")) for p in numbers]

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        changed = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        starts = [*np.flatnonzero(changed), len(rows)]
        pages, texts = rows["page_number"].tolist(), rows["markdown"].tolist()
        got = [g for a, b in zip(starts, starts[1:], strict=False) for g in call(pages[a:b], texts[a:b])]
        out = rows[["job_id", "page_number", "batch_number"]].copy()
        out["result"] = [None if isinstance(g, Exception) else g for g in got]
        out["error"] = [str(g) if isinstance(g, Exception) else None for g in got]
        return out

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by batch; the last batch of a chunk may continue in the next one.
        open_rows = None
        for chunk in chunks:
            rows = chunk if open_rows is None else pd.concat([open_rows, chunk], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1)
            open_rows, closed = rows[last], rows[~last]
            if len(closed):
                yield answer(closed)
        if open_rows is not None:
            yield answer(open_rows)

    numbered = micro_batches(job_pages, size)
    ordered = (
        numbered.select("job_id", "page_number", "priority", "batch_number", "markdown")
        .repartition(*keys)
        .sortWithinPartitions(*keys, F.desc("priority"), F.asc("page_number"))
    )
    return ordered.mapInPandas(
        run,
        f"job_id {types['job_id']}, page_number {types['page_number']}, batch_number bigint, "
        "result string, error string",
    )


def annotate_documents(documents: DataFrame, fn: Callable[[str], str], template_id: str) -> DataFrame:
    """Document text to a normalised extraction: (document_id, data, error).

    The function returns JSON text; its failures become the row's error and touch nothing else.
    """
    id_type = dict(documents.dtypes)["document_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for text in batch["content"]:
                try:
                    answers.append(fn(text))
                    errors.append(None)
                except Exception as error:
                    answers.append(None)
                    errors.append(str(error))
            yield pd.DataFrame(
                {"document_id": batch["document_id"], "annotation": answers, "call_error": errors}
            )

    answered = documents.select("document_id", "content").mapInPandas(
        run, f"document_id {id_type}, annotation string, call_error string"
    )
    parsed = parse_annotation(answered).withColumn("error", F.coalesce("call_error", "error"))
    return normalize_extraction(parsed, template_id).select("document_id", "data", "error")


@udtf(returnType="page_number: int", useArrow=True)
class PageRange:
    """Table form of the strict page-range grammar; a rejected spec yields no rows."""

    def eval(self, spec: str, total_pages: int):
        text = (spec or "").strip().lower()
        if text in ("", "all", "*"):
            for page in range(1, total_pages + 1):
                yield (page,)
            return
        chosen = set()
        for part in text.split(","):
            ends = [end.strip() for end in part.split("-")]
            if len(ends) > 2 or not all(end.isdecimal() for end in ends):
                return
            low, high = sorted((int(ends[0]), int(ends[-1])))
            if low < 1 or high > total_pages:
                return
            chosen.update(range(low, high + 1))
        for page in sorted(chosen):
            yield (page,)


def register_page_range(spark: SparkSession, name: str = "page_range") -> None:
    """Makes ``LATERAL page_range(spec, total)`` available to SQL."""
    spark.udtf.register(name, PageRange)


def _shrunk(gray: np.ndarray) -> np.ndarray:
    """Block-average copy whose longer side is at most the analysis side."""
    height, width = gray.shape
    longest = max(height, width)
    if longest <= ANALYSIS_SIDE:
        return gray
    scale = ANALYSIS_SIDE / longest
    rows = np.linspace(0, height, max(1, round(height * scale)) + 1).astype(int)
    cols = np.linspace(0, width, max(1, round(width * scale)) + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), rows[:-1], axis=0), cols[:-1], axis=1)
    areas = np.outer(np.diff(rows), np.diff(cols))
    return np.rint(sums / areas).astype(np.uint8)


def gray_metrics(gray: np.ndarray) -> tuple[float, float, float]:
    """Contrast (p95 - p5), sharpness (edge variance) and noise (mean distance to the 3x3 median)."""
    gray = _shrunk(gray)
    cumulative = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    low, high = (int(np.searchsorted(cumulative, gray.size * f)) for f in (0.05, 0.95))
    padded = np.pad(gray, 1, mode="edge").astype(np.int32)
    height, width = gray.shape
    around = np.stack(
        [padded[y : y + height, x : x + width] for y in range(3) for x in range(3)]
    )
    edges = np.clip(9 * around[4] - around.sum(axis=0), 0, 255)
    if height > 4 and width > 4:
        edges = edges[2:-2, 2:-2]
    noise = np.abs(around[4] - np.median(around, axis=0)).mean()
    return float(high - low), float(edges.var()), float(noise)


def image_metrics(images: DataFrame, key: str = "name") -> DataFrame:
    """(key, width, height, contrast, sharpness, noise) of rows with the ``image`` struct of Spark's image source."""
    key_type = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, height, width, channels, data in batch.itertuples(index=False):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                if channels == 1:
                    gray = pixels[:, :, 0]
                else:  # stored blue, green, red
                    weights = np.array([7471, 38470, 19595])
                    gray = ((pixels[:, :, :3].astype(np.int64) @ weights + 0x8000) >> 16).astype(np.uint8)
                rows.append((name, width, height, *gray_metrics(gray)))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "contrast", "sharpness", "noise"])

    return images.select(key, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(
        run, f"{key} {key_type}, width int, height int, contrast double, sharpness double, noise double"
    )


def _unit(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def scan_quality(metrics: DataFrame) -> DataFrame:
    """Adds the 0..1 ``quality`` score from contrast, sharpness and the short side."""
    short = F.least("width", "height")
    return metrics.withColumn(
        "quality",
        0.35 * _unit(F.col("contrast") / 150.0)
        + 0.45 * _unit(F.col("sharpness") / 900.0)
        + 0.20 * _unit(short / float(MIN_SHORT_SIDE)),
    )


def scan_repair_plan(metrics: DataFrame) -> DataFrame:
    """Adds ``upscale_factor`` and the repair candidates a scan qualifies for."""
    short, long = F.least("width", "height"), F.greatest("width", "height")
    factor = F.least(F.lit(3.0), MIN_SHORT_SIDE / short, MAX_LONG_SIDE / long)
    upscale = (short < MIN_SHORT_SIDE) & (factor >= 1.18)
    return (
        metrics.withColumn("upscale_factor", F.when(upscale, F.round(factor, 6)))
        .withColumn("denoise", F.col("noise") >= 11.0)
        .withColumn("enhance_contrast", F.col("contrast") < 92.0)
        .withColumn("sharpen", F.col("sharpness") < 520.0)
    )
