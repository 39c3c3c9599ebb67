"""Token files compressed by Re-Pair: frequent pairs of ids become nonterminals, shard by shard."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import blocks, doc_texts, shared_folder
from quire.llm.tokens import Encoder, crc, split, vocabulary_path

#: The row of one shard. ``bases`` is the first nonterminal of each round; rule k stands for the symbols
#: ``left[k], right[k]`` and expands to ``expansion[k]`` ids; all four are 32-bit little-endian integers.
SHARD = (
    "part int, shard int, doc_ids array<long>, sizes array<int>, n_tokens long, "
    "bases array<int>, left binary, right binary, expansion binary, symbols binary"
)
_BUCKETS = 14
#: Text bytes of a part, about. Words are encoded once a part, so a part should not be small.
PART_BYTES = 32 << 20


def compress(ids: np.ndarray, sizes: np.ndarray, first_nonterminal: int, least: int = 16) -> dict:
    """Re-Pair over documents of ``sizes`` ids each; no pair reaches over the end of a document.

    Each round counts one candidate pair for each hash bucket exactly and replaces all pairs found
    ``least`` times or more at once; of overlapping occurrences the more frequent pair wins. Rounds hash
    anew, so pairs that shared a bucket get their turn. The last round is the first that replaces less
    than one symbol in 64.
    """
    symbols = ids.astype(np.int32)
    opens = np.zeros(len(ids), bool)
    opens[np.cumsum(sizes)[:-1][np.cumsum(sizes)[:-1] < len(ids)]] = True
    lengths = [np.ones(first_nonterminal, np.int64)]
    left, right, bases, base, idle, salt = [], [], [], first_nonterminal, False, 0x9E3779B97F4A7C15
    while not idle and len(symbols) > 1:
        salt = (salt * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
        pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        bucket = ((pairs.astype(np.uint64) * np.uint64(salt)) >> np.uint64(64 - _BUCKETS)).astype(np.int32)
        chosen = np.empty(1 << _BUCKETS, np.int64)
        chosen[bucket] = pairs
        same = (chosen[bucket] == pairs) & ~opens[1:]
        counts = np.bincount(bucket[same], minlength=1 << _BUCKETS)
        rank = np.where(same, counts.astype(np.int32)[bucket], 0)
        rank[rank < least] = 0
        wins = rank > 0
        wins[1:] &= rank[1:] > rank[:-1]
        tied = np.flatnonzero((rank[1:] == rank[:-1]) & (rank[1:] > 0)) + 1
        if len(tied):  # of a run of one id every second pair
            opened = np.flatnonzero(np.diff(tied, prepend=-2) > 1)
            place = np.arange(len(tied)) - np.repeat(opened, np.diff(np.append(opened, len(tied)))) + 1
            leads = np.repeat(wins[tied[opened] - 1], np.diff(np.append(opened, len(tied))))
            wins[tied[leads & (place % 2 == 0)]] = True
        wins[:-1] &= rank[:-1] >= rank[1:]
        used = np.bincount(bucket[wins], minlength=1 << _BUCKETS)
        wins &= used[bucket] >= least // 2
        at = np.flatnonzero(wins)
        if len(at) < max(1, len(symbols) // 64):
            idle = True
            if not len(at):
                break
        rules, which = np.unique(bucket[at], return_inverse=True)
        pair = chosen[rules]
        bases.append(base)
        left.append(pair >> 32)
        right.append(pair & 0xFFFFFFFF)
        known = np.concatenate(lengths)
        lengths = [known, known[left[-1]] + known[right[-1]]]
        symbols[at] = base + which
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, opens = symbols[keep], opens[keep]
        base += len(rules)
    packed = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype("<u4").tobytes()
    return {"bases": bases, "left": packed(left), "right": packed(right), "expansion": packed([np.concatenate(lengths)[first_nonterminal:]]), "symbols": packed([symbols])}


def _expand(symbols: np.ndarray, bases: list[int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Undoes the rounds from the last to the first."""
    for base in reversed(bases):
        rule = symbols >= base
        ends = np.cumsum(1 + rule)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        out[ends[~rule] - 1] = symbols[~rule]
        k = symbols[rule] - bases[0]
        out[ends[rule] - 2], out[ends[rule] - 1] = left[k], right[k]
        symbols = out
    return symbols


def _arrays(shard: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(shard[k], "<u4").astype(np.int64) for k in ("symbols", "left", "right", "expansion"))


def decode(shard: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a shard. The expansion lengths tell which symbols hold them, so
    only those are expanded."""
    symbols, left, right, expansion = _arrays(shard)
    bases = list(shard["bases"])
    if start == 0 and stop is None:
        return _expand(symbols, bases, left, right)
    size = np.ones(len(symbols), np.int64)
    if bases:
        size[symbols >= bases[0]] = expansion[symbols[symbols >= bases[0]] - bases[0]]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return _expand(symbols[a:b], bases, left, right)[start - skipped : stop - skipped]


def _writer(path: str, shard_tokens: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = Encoder(path)
        first = encoder.tokenizer.get_vocab_size()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal held, number
            docs = [d for x in held for d in x[0]]
            ids, sizes = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            row = {"part": part, "shard": number, "doc_ids": docs, "sizes": sizes.tolist(), "n_tokens": len(ids), **compress(ids, sizes, first)}
            number, held = number + 1, []
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for block in blocks(batches, 3 << 20):
            docs = block.column("doc_id").to_pylist()
            ids, sizes = encoder.encode(block.column("text"))
            ends = np.cumsum(sizes)
            at = row = 0
            while row < len(docs):
                open_tokens = sum(len(x[1]) for x in held)
                stop = min(len(docs), int(np.searchsorted(ends, at + shard_tokens - open_tokens)) + 1)
                held.append((docs[row:stop], ids[at : ends[stop - 1]], sizes[row:stop]))
                at, row = int(ends[stop - 1]), stop
                if open_tokens + len(held[-1][1]) >= shard_tokens:
                    yield shard()
        if held:
            yield shard()

    return run


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("bases", pa.list_(pa.int32())), *((k, pa.binary()) for k in ("left", "right", "expansion", "symbols"))]
)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = 1 << 18) -> None:
    """Writes the ids of all documents, each followed by the end id 0, to the folder ``path``.

    Documents are dealt by ranges of doc_id and sorted inside, so parts and shards are in ascending
    order; rows with the same id are ordered by text, null ids come first. A null or empty text is the
    end id alone. A shard is closed with the document that brings it to ``shard_tokens``; a longer
    document has a shard of its own. No rows give an empty table.
    """
    rows = doc_texts(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_writer(vocabulary or vocabulary_path(), shard_tokens), SHARD)
    shards.write.option("compression", "zstd").mode("overwrite").parquet(path)


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = batch.slice(row, 1).to_pylist()[0]
            sizes = np.array(shard["sizes"], np.int64)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard["part"]] * n, pa.int32()), pa.array([shard["shard"]] * n, pa.int32()), pa.array(shard["doc_ids"], pa.int64()),
                 pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([crc(x) for x in split(decode(shard), sizes)], pa.int64())],
                ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``path``.

    Where a shard starts follows from the token counts of the parts and shards before it: running sums
    inside each part, and over the one row of each part. Only those small rows meet the documents' rows.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("n_tokens")
    starts = starts.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    rows = shards.mapInArrow(_reader, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all documents to token files in a new folder of the shared one and reads them back."""
    import uuid

    path = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)
