"""Packing of tokenised documents into sequences by bounded-space online best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import blocks, doc_texts, giving_back, written
from quire.llm.tokens import Encoder, crc, split, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: full ones behind a first that takes the rest."""
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


class OpenBins:
    """At most ``limit`` open bins. One bit for each amount of free space tells whether an open bin has
    it, so the tightest bin that takes an item is the lowest set bit from the item's size on."""

    def __init__(self, capacity: int, limit: int, new_id: Callable[[], int]) -> None:
        self.capacity, self.limit, self.new_id = capacity, limit, new_id
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, bit: int) -> tuple[int, int]:
        """The newest bin with the least free space of at least ``bit``, and that space."""
        rest = self.bits >> bit
        free = bit + (rest & -rest).bit_length() - 1
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found, free

    def place(self, size: int) -> tuple[int, int]:
        """The bin of an item and its offset there. A full bin closes at once; if too many are open,
        the fullest closes first."""
        if self.bits >> size:
            found, free = self._take(size)
        else:
            if self.count >= self.limit:
                self._take(0)
            found, free = self.new_id(), self.capacity
        if free > size:
            self.by_free[free - size].append(found)
            self.bits |= 1 << (free - size)
            self.count += 1
        return found, self.capacity - free


def _pieces(path: str, capacity: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for block in blocks(batches, 2 << 20):
            ids, counts = encoder.encode(block.column("text"))
            rows = [
                (doc, k, start, size, crc(own[start : start + size]))
                for doc, own in zip(block.column("doc_id").to_pylist(), split(ids, counts), strict=True)
                for k, (start, size) in enumerate(cut(len(own), capacity))
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _packed(capacity: int, open_bins: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0

        def new_id() -> int:
            nonlocal made
            made += 1
            return base + made

        bins = OpenBins(capacity, open_bins, new_id)
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            places = np.empty((len(sizes), 2), np.int64)
            for i in np.argsort(-sizes, kind="stable").tolist():  # the large ones of a batch first
                places[i] = bins.place(int(sizes[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places[:, 0]), pa.array(places[:, 1])], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 512, tokens_per_task: int = 1 << 26) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with a ``length`` of at most ``capacity``.

    Each task packs its rows in one pass with ``open_bins`` open bins; the sequence id holds the task's
    number, so ids never clash. Pieces are only lengths here, so a task takes many: their number follows
    the sum of lengths. Bins that tasks leave open are the only loss against one packer for all. Repeated
    rows are packed as often as they occur; no rows give no rows.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // tokens_per_task))
    return pieces.coalesce(tasks).mapInArrow(giving_back(_packed(capacity, open_bins)), f"{PIECES}, {PLACES}")


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 512, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of all documents.

    A document is its ids and the end id 0; a null or empty text is the end id alone. A document of more
    than ``capacity`` ids is cut into full pieces behind a first piece with the rest. Documents with a
    null or repeated id are packed like all others. Texts are encoded where they are scanned; only the
    small piece rows are written between encoding and packing, and nothing is shuffled.
    """
    pieces = doc_texts(docs).mapInArrow(giving_back(_pieces(vocabulary or vocabulary_path(), capacity)), PIECES)
    return pack(written(pieces, "pieces"), capacity, open_bins)
