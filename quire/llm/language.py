"""Language identification by averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import blocks, giving_back

UNDETERMINED = "und"
#: Lengths of the byte n-grams of lower-cased text, and the hash buckets they share.
GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 16
#: About so many rows of each language train the model, chosen by a hash of their text; every fifth of
#: them only calibrates. This bounds what reaches the driver; prediction covers every row.
ROWS_PER_LANGUAGE = 1000
#: Bytes of a training text that are used; training only, predictions take whole texts.
TRAINING_BYTES = 4000


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; the last n - 1 bytes start none."""
    h = np.full(max(0, len(data) - n + 1), n, np.uint32)
    for k in range(n):
        h = (h ^ data[k : k + len(h)]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams inside the texts, and the text of each."""
    lower = pc.utf8_lower(texts).cast(pa.large_binary())
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(lower.to_pylist()), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    found, rows = [], []
    for n in GRAMS:
        m = max(0, len(data) - n + 1)
        inside = row[:m] == row[n - 1 :][:m]
        found.append(_buckets(data, n)[inside])
        rows.append(row[:m][inside])
    return np.concatenate(found), np.concatenate(rows)


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and the n-grams in each, in two bytes each for the driver's memory.
    A text of TRAINING_BYTES has fewer n-grams than two bytes can count."""
    if len(texts) > 100:  # a few at a time
        return [x for at in range(0, len(texts), 100) for x in _counts(texts[at : at + 100])]
    found, rows = _grams(pa.array(texts, pa.string()))
    keys, counts = np.unique(rows.astype(np.int64) * BUCKETS + found, return_counts=True)
    cuts = np.searchsorted(keys // BUCKETS, np.arange(1, len(texts)))
    return list(zip(np.split((keys % BUCKETS).astype(np.uint16), cuts), np.split(counts.astype(np.uint16), cuts), strict=True))


class Model:
    """Scores of each bucket and language: the product of embeddings and output weights, so that the
    average of a text's bucket scores is the linear layer over its averaged embedding."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def logits(self, texts: pa.Array) -> np.ndarray:
        found, rows = _grams(texts)
        counts = np.maximum(1, np.bincount(rows, minlength=len(texts)))
        return np.stack([np.bincount(rows, weights=self.table[found, k], minlength=len(texts)) / counts for k in range(len(self.languages))], axis=1)


def train(texts: list[str], langs: list[str], epochs: int = 10, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one text at a time, with a falling rate.

    Every fifth text is held back: a temperature is fitted on them, whole and cut short, by likelihood, and the rejection
    threshold is set below the calibrated scores of all but one in a thousand of them, at most a half. No
    texts give a model without languages.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    of = {lang: k for k, lang in enumerate(languages)}
    target = np.array([of[x] for x in langs])
    texts = [t.encode()[:TRAINING_BYTES].decode(errors="ignore") for t in texts]
    counts = _counts(texts)
    held = np.arange(len(texts)) % 5 == 4
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    output, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    rows, step = np.flatnonzero(~held), 0
    for _ in range(epochs):
        for i in random.permutation(rows):
            lr = rate * (1 - step / (epochs * len(rows)))
            step += 1
            buckets, n = counts[i]
            share = n / max(1.0, float(n.sum()))
            hidden = share @ embedding[buckets]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= lr * 0.01 * p
            embedding[buckets] -= lr * 20 * share[:, None] * back
    table = embedding @ output
    model = Model(languages, table, bias, 1.0, 0.0)
    if held.any():
        some = [texts[i] for i in np.flatnonzero(held)]
        cuts = [t[: 20 + 30 * (k % 6)] for k, t in enumerate(some)]  # short texts too, where doubt is
        both = some + cuts
        logits = np.concatenate([model.logits(pa.array(both[at : at + 100], pa.string())) for at in range(0, len(both), 100)])
        right = (np.arange(len(logits)), np.tile(target[held], 2))
        grid = np.exp(np.linspace(np.log(0.02), np.log(50), 80))

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(logits)[right] + 1e-12).mean()

        model.temperature = float(min(grid, key=loss))
        model.threshold = float(min(0.5, np.quantile(model.probabilities(logits[: len(some)]).max(axis=1), 0.001)))
    return model


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> list:
    """About ``per_language`` rows of each language, or all if it has fewer: those whose text hash lies under
    the bound that leaves this share of the language's distinct texts. Repeated texts count once. Only
    these rows, cut to the bytes that training uses, reach the driver."""
    rows = docs.where("lang IS NOT NULL AND text RLIKE '[^ ]'").select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not sizes:
        return []
    # the bounds are in the scan's filter, so only the chosen texts are shuffled
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_language / r.n))])
    bound = (shares[F.col("lang")] * 2 - 1) * float(2**63)
    chosen = rows.where(F.col("h").cast("double") < bound).select(F.substring("text", 1, TRAINING_BYTES).alias("text"), "lang", "h")
    return chosen.dropDuplicates(["lang", "h"]).orderBy("h", "lang").collect()


def _predicted(model: Model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 20):
            texts = batch.column("text")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model.languages and len(texts):
                p = model.probabilities(model.logits(texts))
                score = np.where(lettered, p.max(axis=1), 0.0)
                lang = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), lettered, strict=True)]
            rejected = ~lettered | (score < model.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["_key", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row from its whole text.

    The score is the calibrated probability of the best language. A null text, or one without a letter, is
    ``und`` with score 0 and rejected, as is every text under a model without languages. Repeated rows are
    predicted alike. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(giving_back(_predicted(model)), "_key long, lang_pred string, score double, rejected boolean")
    return found.withColumnRenamed("_key", "doc_id")


def held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: rows that never train, by the checksum of their id; a null id is held out."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.withColumn("held_out", F.coalesce(checksum % 4 == 2, F.lit(True)))


def fit(docs: DataFrame) -> Model:
    """The model learned from the rows that are not held out."""
    known = held_out(docs.select("doc_id", "text", "lang")).where("NOT held_out")
    rows = training_rows(known)
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row, by a model fitted on the others' labels."""
    return held_out(predict(docs, model or fit(docs))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def _accepted(model: Model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted = _predicted(model)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), texts], ["_key", "text"])
            rejected = [out.column("rejected") for out in predicted([rows])]
            if rejected:
                yield batch.filter(pc.invert(pa.concat_arrays(rejected)))

    return run


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` with all columns whose language is told with enough certainty."""
    return docs.mapInArrow(giving_back(_accepted(model or fit(docs))), docs.schema)
