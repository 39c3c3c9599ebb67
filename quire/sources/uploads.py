"""Uploaded files: scanning, content checks and content identity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp")


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def content_mime(content: Column) -> Column:
    """MIME type by leading bytes; null for anything but PDF, PNG, JPEG and WEBP."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & F.substr(head, F.lit(17), F.lit(8)).eqNullSafe("57454250"), "image/webp")
    )


def ingest_files(
    spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, max_bytes: int | None = None, content: bool = True
) -> DataFrame:
    """Files below ``path`` as (name, extension, bytes, sha256, mime_type, is_pdf, content).

    Empty files and other extensions are filtered before any content is read, larger files only where
    ``max_bytes`` is given. Without ``content`` no file is ever held whole: a file of any size is read as the runs of bytes
    between its line feeds, by as many tasks as it has splits, and hashed piece by piece in their order. Only its longest
    such run has to fit in memory.
    """
    if content or not _PACKED.isdisjoint(e.lower() for e in extensions):
        return _whole_files(spark, path, extensions, max_bytes, content)
    fits = F.lit(True) if max_bytes is None else F.col("_metadata.file_size") <= max_bytes
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
        .where(extension_of(name).isin(*extensions) & fits & (F.col("_metadata.file_size") > len(_MARK)))
        .select(
            F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
        )
    )
    pieces = lines.mapInArrow(_pieces, "path string, name string, bytes long, start long, number long, piece binary")
    ordered = pieces.repartition("path").sortWithinPartitions("path", "start", "number")
    hashed = ordered.mapInArrow(_hashed, "name string, bytes long, sha256 string, head binary")
    hashed = hashed.select("name", extension_of(F.col("name")).alias("extension"), "bytes", "sha256", *_judged(F.col("head")))
    # of a file that is a mark of UTF-8 and nothing else no line comes
    return hashed.unionByName(_whole_files(spark, path, extensions, max_bytes, content).where(F.col("bytes") <= len(_MARK)))


#: Extensions of files that Spark's readers of lines unpack.
_PACKED = frozenset(("gz", "bz2", "deflate", "lz4", "snappy", "zst", "zstd", "xz"))
#: Bytes of a piece of a file, at most.
PIECE_BYTES = 1 << 20
#: The mark of UTF-8 that readers of lines drop at the beginning of a file.
_MARK = b"\xef\xbb\xbf"


def _judged(content: Column) -> tuple[Column, Column]:
    mime = content_mime(content)
    return mime.alias("mime_type"), F.coalesce(mime == "application/pdf", F.lit(False)).alias("is_pdf")


def _whole_files(spark: SparkSession, path: str, extensions: Sequence[str], max_bytes: int | None, content: bool) -> DataFrame:
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where((F.col("length") > 0) & fits)
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return (
        files.withColumn("name", name)
        .withColumn("extension", extension_of(F.col("name")))
        .where(F.col("extension").isin(*extensions))
        .select(
            "name", "extension", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
            *_judged(F.col("content")), *(["content"] if content else []),
        )
    )


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each split, one after the other, in pieces that are numbered in the order of reading."""
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, start = batch.column("line"), batch.column("start").to_numpy()
        file = batch.column("path").dictionary_encode().indices.to_numpy()
        _valid, offsets, data = lines.buffers()
        ends = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1]
        cuts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])))
        for row, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            of = [batch.column(c)[row].as_py() for c in ("path", "name", "bytes", "start")]
            for at in range(int(ends[row]), int(ends[stop]), PIECE_BYTES):
                piece = data.slice(at, min(PIECE_BYTES, int(ends[stop]) - at)).to_pybytes()
                values = [pa.array([v], t) for v, t in zip([*of, number, piece], _PIECE.types, strict=True)]
                yield pa.RecordBatch.from_arrays(values, schema=_PIECE)
                number += 1


_PIECE = pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("number", pa.int64()), ("piece", pa.binary())])
_HASHED = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("head", pa.binary())])


class _File:
    """A file whose bytes come in order. The reader of lines leaves out a mark of UTF-8 at its beginning, and a line feed was
    added at its end whether it has one or not; how many bytes came tells both."""

    def __init__(self, name: str, size: int) -> None:
        self.name, self.size, self.came, self.head, self.held = name, size, 0, b"", b""
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(_MARK)

    def update(self, piece: memoryview) -> None:
        self.came += len(piece)
        if len(self.head) < 12:
            self.head += bytes(piece[:12])
        for part in (self.held, piece[:-1]):
            self.plain.update(part)
            self.marked.update(part)
        self.held = bytes(piece[-1:])

    def row(self) -> pa.RecordBatch:
        missing = self.size - self.came
        if missing not in (-1, 0, 2, 3):
            raise ValueError(f"{self.came} bytes came of {self.name}, which has {self.size}")
        whole, head = (self.marked, _MARK + self.head) if missing > 0 else (self.plain, self.head)
        if missing in (0, 3):
            whole.update(self.held)
        values = (self.name, self.size, whole.hexdigest(), head[: min(12, self.size)])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _HASHED.types, strict=True)], schema=_HASHED)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file; its pieces come one after the other."""
    file, now = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            path = batch.column("path")[row].as_py()
            if path != now:
                if file is not None:
                    yield file.row()
                now, file = path, _File(batch.column("name")[row].as_py(), batch.column("bytes")[row].as_py())
            file.update(memoryview(batch.column("piece")[row].as_buffer()))
    if file is not None:
        yield file.row()


def validate_uploads(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``mime_type``, ``accepted`` and ``reason`` to (name, content) rows, judging by content."""
    extension = extension_of(F.col("name"))
    mime = content_mime(F.col("content"))
    size = F.octet_length("content")
    reason = (
        F.when(~extension.isin(*EXTENSIONS), "unsupported extension")
        .when(size == 0, "empty file")
        .when(size > max_bytes if max_bytes is not None else F.lit(False), "file too large")
        .when((extension == "pdf") & ~mime.eqNullSafe("application/pdf"), "not a valid PDF")
        .when((extension != "pdf") & ~F.coalesce(mime.startswith("image/"), F.lit(False)), "not a readable image")
    )
    return files.select(
        "*",
        F.when(reason.isNull(), mime).alias("mime_type"),
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
    )
