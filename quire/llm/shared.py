"""Tables, written intermediate results and word splitting shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that end a word.
WORD_SPACE = " \t\n\v\f\r"


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session. A folder of our
    own is used only where the session names none, which is the case in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="spark-")
        shared_folder.own = base
    return base.rstrip("/")


#: Spark removes the shuffle files of a query at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, which cuts the lineage there: a lost
    executor costs its running tasks only. The shuffle files behind the table go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame, *more: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns that an operator reads, with the id as long and a null text as empty. Other
    columns of any name, also ones that an operator uses itself, are left behind here."""
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def blocks(batches: Iterable[pa.RecordBatch], size: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``size`` bytes, a longer text alone in its slice."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that the texts of each hold about ``size`` bytes, but for the last of a task."""
    held, total = [], 0
    for block in blocks(batches, max(1, size // 8), column):
        held.append(block)
        total += pc.sum(pc.binary_length(block.column(column))).as_py() or 0
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def giving_back(fn: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``fn`` for a task, with the memory that it has freed given back at its end. Spark keeps idle workers for later
    tasks, and what their allocators hold on to counts in the executor's memory beside the workers that run."""

    def run(batches: Iterable) -> Iterator:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes of all texts in order, the row of each, and the distinct words. A word is a run of
    characters other than ``WORD_SPACE``."""
    lists = pc.ascii_split_whitespace(texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    words = encoded.dictionary
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if len(words) and not filled.all():
        keep = filled[codes]
        codes, rows = codes[keep], rows[keep]
    return codes.astype(np.int64), rows.astype(np.int64), words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, as unsigned integers."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of consecutive runs, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return at


class WordTable:
    """Encoded words of the blocks before. ``learn`` gives ids and sizes of new words; when the table
    would exceed ``limit`` words it starts anew."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = 800_000) -> None:
        self.learn, self.limit = learn, limit
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.starts = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def gather(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words[codes]`` one after the other, and the number of ids of each."""
        if len(self.known) + len(words) > self.limit:
            self._forget()
        place = pc.index_in(words, self.known)
        new = place.is_null()
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = words.filter(new).cast(pa.large_string())
        if len(missing):
            place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
            learned = [self.learn(missing.slice(i, 60_000)) for i in range(0, len(missing), 60_000)]
            self.known = pa.concat_arrays([self.known, missing])
            sizes = np.concatenate([sizes for _, sizes in learned])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, *(ids.astype(np.int32) for ids, _ in learned)])
        at = place[codes]
        lengths = (self.starts[1:] - self.starts[:-1])[at]
        return self.ids[spread(self.starts[at], lengths)], lengths
