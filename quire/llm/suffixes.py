"""Removal of byte strings that occur in an earlier document, by suffix arrays built column by column.

Each 50-byte string is dealt by the least hash of the 16-byte strings in it, so equal ones meet. What meets is
sorted by a collection Burrows-Wheeler transform with common prefixes: each round inserts one symbol of every
string. Neighbours in the order with 50 bytes in common are equal strings.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm.shared import blocks, doc_texts, giving_back, mix, spread, written

#: Bytes of a repeated string, and of the strings inside it whose least hash deals it.
LENGTH, INNER = 50, 16
#: Bytes of the strings that one transform is built over, about; its arrays should fit a core's cache.
BUILD_BYTES = 1 << 16
#: Of a hash with this many times as many bytes, each 50-byte string is dealt anew by its own hash.
DEAL_ANEW = 16
#: Bytes of a build kept in memory for each of its files; what is beyond goes to a scratch file of the task.
_IN_MEMORY = 32 << 20


class SequenceFile:
    """A sequence of bytes that each round reads from start to end and replaces by a longer one. It is private
    to its task, which drops it at its end; nothing else ever reads it."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=_IN_MEMORY)  # noqa: SIM115

    def replace(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(values.tobytes())

    def values(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), np.uint8)

    def close(self) -> None:
        self.file.close()


def transform(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a collection of strings and the common prefixes of its suffixes.

    ``data`` holds byte values plus one, so that 0 can end the strings; ends are ordered as the strings
    are. Strings are at most 254 bytes long. Each round inserts the suffixes that are one symbol longer:
    the place of a suffix follows from the rank of its first symbol in the transform so far, and the
    prefix it has in common with its neighbours is one more than that of the suffixes behind the symbol.
    """
    n = len(starts)
    bwt_file, lcp_file = SequenceFile(), SequenceFile()
    ends = starts + lengths
    bwt_file.replace(np.where(lengths > 0, data[np.maximum(ends - 1, 0)], 0).astype(np.uint8))
    lcp_file.replace(np.zeros(n, np.uint8))
    at = np.arange(n)  # the row of each string's longest suffix so far
    for column in range(int(lengths.max(initial=0))):
        bwt, lcp = bwt_file.values(), lcp_file.values()
        going = np.flatnonzero(lengths > column)
        order = np.argsort(bwt, kind="stable")
        done = len(bwt) - np.count_nonzero(bwt)
        place = np.empty(len(bwt), np.int32)
        place[order] = np.arange(n - done, n - done + len(bwt), dtype=np.int32)
        new = place[at[going]].astype(np.int64)
        size = n + len(bwt) - done
        old = np.ones(size, bool)
        old[new] = False
        before = ends[going] - 2 - column
        next_bwt, next_lcp = np.empty(size, np.uint8), np.empty(size, np.uint8)
        next_bwt[old] = bwt
        next_bwt[new] = np.where(before >= starts[going], data[np.maximum(before, 0)], 0)
        next_lcp[old] = lcp
        changed = np.zeros(size + 1, bool)
        changed[new] = changed[new + 1] = True
        rows = np.flatnonzero(changed[:size])
        next_lcp[rows] = 0
        rows = rows[rows > n]
        behind, ahead = order[rows - n + done - 1], order[rows - n + done]
        same = bwt[behind] == bwt[ahead]
        rows, low, high = rows[same], behind[same] + 1, ahead[same] + 1
        if len(rows):  # ranges from the last to the first, so that the gaps between them cost nothing
            by = np.argsort(-low, kind="stable")
            bounds = np.stack([low[by], high[by]], axis=1).ravel()
            next_lcp[rows[by]] = 1 + np.minimum.reduceat(np.append(lcp, 0), bounds)[::2]
        at[going] = new
        bwt_file.replace(next_bwt)
        lcp_file.replace(next_lcp)
    bwt, lcp = bwt_file.values(), lcp_file.values()
    bwt_file.close()
    lcp_file.close()
    return bwt, lcp


def positions(bwt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of the suffix in each row, by walking all strings from their ends at once."""
    n = len(lengths)
    order = np.argsort(bwt, kind="stable")
    done = len(bwt) - np.count_nonzero(bwt)
    place = np.empty(len(bwt), np.int64)
    place[order] = np.arange(n - done, n - done + len(bwt))
    string, offset = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    row = np.arange(n)
    string[:n], offset[:n] = row, lengths
    for column in range(int(lengths.max(initial=0))):
        going = np.flatnonzero(lengths > column)
        row[going] = place[row[going]]
        string[row[going]], offset[row[going]] = going, lengths[going] - 1 - column
    return string, offset


def repeated(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every ``length``-byte string that a string of a smaller document has too."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    starts = np.cumsum(lengths) - lengths
    bwt, lcp = transform(data, starts, lengths)
    string, offset = positions(bwt, lengths)
    first = np.flatnonzero(lcp < length)  # a row with less in common starts a group of equal strings
    least = np.minimum.reduceat(docs[string], first)
    group = np.cumsum(lcp < length) - 1
    later = np.flatnonzero(docs[string] > least[group])
    return string[later], offset[later]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _sides(data: np.ndarray, eight: np.ndarray, inner: np.ndarray, value: np.ndarray, begin: np.ndarray, count: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hashes of the 17 bytes before and behind the place of each run's least inner hash, and a last bit for
    runs that have it twice. A 50-byte string of two runs holds the 17 bytes on one side of it at least, so
    runs of one hash with neither side in common share none. A side that leaves the run gets a value of its own."""
    span = np.arange(2 * (LENGTH - INNER) + 1)
    places = np.minimum(begin[:, None] + span, len(inner) - 1)
    found = (inner[places] == value[:, None]) & (span < (count + LENGTH - INNER)[:, None])
    at = begin + found.argmax(axis=1)
    k = np.uint64(0x9E3779B97F4A7C15)
    side = (LENGTH - INNER) // 2
    end = begin + count + LENGTH - 1
    left, right = at - side >= begin, at + INNER + side <= end
    a, b = np.where(left, at - side, 0), np.where(right, at + INNER, 0)
    top = len(eight) - 1
    before = mix(mix(eight[a] * k + eight[np.minimum(a + 8, top)]) + data[a + 16])
    behind = mix(mix(eight[b] * k + eight[np.minimum(b + 8, top)] + np.uint64(1)) + data[b + 16])
    before, behind = np.where(left, before, mix(own + np.uint64(1))), np.where(right, behind, mix(own + np.uint64(2)))
    packed = (before >> np.uint64(49)) << np.uint64(16) | (behind >> np.uint64(49)) << np.uint64(1) | (found.sum(axis=1) > 1).astype(np.uint64)
    return packed.astype(np.int32)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of 50-byte strings with the same least inner hash: the hash, a hash of the run's bytes, document,
    first position and number of strings. A run is cut where it could not hold one inner string any more."""
    width = LENGTH - INNER + 1
    for batch in blocks(batches, 1 << 20):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        if len(data) < LENGTH:
            continue
        row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        two = data[:-1] | data[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        inner = (mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix(eight[8:])) >> np.uint64(32)).astype(np.uint32)
        least = _sliding_least(inner, width)
        n = len(least)
        inside = row[:n] == row[LENGTH - 1 :]
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
        first = np.flatnonzero(start & inside)
        if not len(first):
            continue
        edge = np.flatnonzero(start | ~inside)
        stop = np.append(edge, n)[np.searchsorted(edge, first, "right")]
        pieces = -(-(stop - first) // width)
        begin = spread(np.zeros(len(first), np.int64), pieces).astype(np.int64) * width + np.repeat(first, pieces)
        count = np.minimum(np.repeat(stop, pieces) - begin, width)
        own = np.zeros(len(begin), np.uint64)
        for at in (begin, begin + count - 1):  # the first and the last 50 bytes cover the run
            for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + eight[at + k])
        own = mix(own + count.astype(np.uint64))
        sides = _sides(data, eight, inner, least[begin], begin, count, own)
        doc = batch.column("doc_id").to_numpy()
        offset = np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[begin].view(np.int32)), pa.array(own.view(np.int64)), pa.array(doc[row[begin]]), pa.array((begin - offset[row[begin]]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(sides)],
            ["least", "own", "doc_id", "position", "n", "sides"],
        )


_RUN = "least int, own long, doc_id long, position int, n int, sides int"


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs whose hash several documents have; ``leads`` tells the first document of equal runs, which is left
    out where no other run of the hash has a side in common with it. Rows come sorted by hash, run, document and position, and only
    the rows of a hash with one document so far wait."""
    held: list[np.ndarray] | None = None
    ongoing: tuple[int, int, int] | None = None  # hash, run and first document of a shared hash so far
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("least", "own", "doc_id", "position", "n", "sides")]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        least, own, doc, position, n, sides = columns
        if not len(least):
            continue
        hashes = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        runs = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
        leader = doc[runs][np.cumsum(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1]))) - 1]
        several = np.minimum.reduceat(doc, hashes) < np.maximum.reduceat(doc, hashes)
        if ongoing is not None and ongoing[0] == least[0]:
            several[0] = True
            if ongoing[1] == own[0]:
                leader[: runs[1] if len(runs) > 1 else len(own)] = ongoing[2]
        shared = np.repeat(several, np.diff(np.append(hashes, len(least))))
        of = np.searchsorted(hashes, runs, "right") - 1
        whole = np.zeros(len(hashes), bool)  # of these hashes all runs are compared
        whole[of[sides[runs] & 1 > 0]] = True
        whole[0] |= ongoing is not None and ongoing[0] == least[0]
        whole[-1] |= several[-1]  # others may follow
        differ = whole[of]
        for side in (sides[runs] >> 16, sides[runs] >> 1 & 0x7FFF):
            order = np.lexsort((side, of))
            same = np.flatnonzero((of[order][1:] == of[order][:-1]) & (side[order][1:] == side[order][:-1]))
            differ[order[same]] = differ[order[same + 1]] = True
        differ = np.repeat(differ, np.diff(np.append(runs, len(least))))
        held = None
        if several[-1]:
            ongoing = (int(least[-1]), int(own[-1]), int(leader[-1]))
        else:  # more documents may follow
            held, ongoing = [c[hashes[-1] :].copy() for c in columns], None
        leads = doc == leader
        keep = np.flatnonzero(shared & (differ | ~leads))
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[keep]), pa.array(doc[keep]), pa.array(position[keep]), pa.array(n[keep]), pa.array(leads[keep])], ["least", "doc_id", "position", "n", "leads"]
        )


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's leading runs; where a hash is dealt anew, of each 50-byte string."""
    import xxhash

    for batch in blocks(batches, 1 << 20):
        out = []
        for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            data = text.encode()
            for run in runs:
                at, n = run["position"], run["n"]
                if run["parts"] == 1:
                    out.append((run["least"], 0, doc, at, data[at : at + n + LENGTH - 1]))
                else:
                    for k in range(at, at + n):
                        own = data[k : k + LENGTH]
                        out.append((run["least"], xxhash.xxh3_64_intdigest(own) % run["parts"], doc, k, own))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["least", "part", "doc_id", "position", "bytes"])


def _covered(strings: list[bytes], docs: list[int], places: list[int]) -> pa.RecordBatch:
    """The byte ranges of the documents that repeated strings cover."""
    doc_of, place_of = np.array(docs, np.int64), np.array(places, np.int64)
    string, offset = repeated(strings, doc_of)
    doc, at = doc_of[string], place_of[string] + offset
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    opens = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LENGTH))[: len(at)]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + LENGTH).astype(np.int32))], ["doc_id", "start", "stop"])


def _built(build_bytes: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Builds a transform over the strings of whole hashes, about ``build_bytes`` at a time. The rows come
        sorted by hash and part."""
        strings: list[bytes] = []
        docs: list[int] = []
        places: list[int] = []
        held, last = 0, None
        for batch in batches:
            for least, part, doc, at, own in zip(*(batch.column(c).to_pylist() for c in ("least", "part", "doc_id", "position", "bytes")), strict=True):
                if held > build_bytes and (least, part) != last:
                    yield _covered(strings, docs, places)
                    strings, docs, places, held = [], [], [], 0
                last = (least, part)
                strings.append(own)
                docs.append(doc)
                places.append(at)
                held += len(own)
        if strings:
            yield _covered(strings, docs, places)

    return run


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges that cover the same bytes."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 2 << 20):
        rows = []
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
            data = text.encode()
            size, gone = len(data), merged((r["start"], r["stop"]) for r in ranges or ())
            at, kept = 0, []
            for start, stop in gone:
                kept.append(data[at:start])
                at = stop
            data = b"".join([*kept, data[at:]])
            rows.append((doc, size, size - len(data), len(gone), hashlib.sha256(data).hexdigest(), data))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_ranges(docs: DataFrame, build_bytes: int = BUILD_BYTES) -> DataFrame:
    """``doc_id, start, stop``: byte ranges of documents covered by 50-byte strings that also start in a document
    with a smaller id. Ranges of a document may overlap."""
    rows = doc_texts(docs).where("doc_id IS NOT NULL")
    runs = rows.mapInArrow(giving_back(_runs), _RUN).repartition("least").sortWithinPartitions("least", "own", "doc_id", "position")
    shared = written(runs.mapInArrow(giving_back(_shared), "least int, doc_id long, position int, n int, leads boolean"), "runs")
    leading = shared.where("leads")
    sizes = leading.groupBy("least").agg(F.sum(F.col("n") + (LENGTH - 1)).alias("bytes")).where(F.col("bytes") > DEAL_ANEW * build_bytes)
    parts = sizes.select("least", F.ceil(F.col("bytes") * 8 / F.lit(float(build_bytes))).cast("int").alias("parts"))
    leading = attach(leading, parts, ["least"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    lists = leading.groupBy("doc_id").agg(F.collect_list(F.struct("least", "position", "n", "parts")).alias("runs"))
    strings = rows.join(lists, "doc_id").mapInArrow(giving_back(_strings), "least int, part int, doc_id long, position int, bytes binary")
    ordered = strings.repartition("least", "part").sortWithinPartitions("least", "part", "doc_id", "position")
    found = written(ordered.mapInArrow(giving_back(_built(build_bytes)), "doc_id long, start int, stop int"), "ranges")
    copies = shared.where("NOT leads").select("doc_id", F.col("position").alias("start"), (F.col("position") + F.col("n") + (LENGTH - 1)).alias("stop"))
    return found.unionByName(copies)


def dedup_bytes(docs: DataFrame, build_bytes: int = BUILD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row: its UTF-8 bytes without those in
    50-byte strings that also start in a document with a smaller id.

    Overlapping strings count, and all are judged on the input. Equal runs of strings are one string of
    their first document in the transform; what it has in later documents is repeated by definition. A
    null text is empty. A row with a null id is left whole and cuts nothing. Rows that share an id are one
    document: equal ones do not cut each other, and ranges found in one are cut from all of them.
    """
    ranges = repeated_ranges(docs, build_bytes).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = doc_texts(docs).join(ranges, "doc_id", "left")
    return joined.mapInArrow(giving_back(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _cut_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row")
        names = [field.name for field in rows.type]
        columns = dict(zip(names, rows.flatten(), strict=True))
        texts = []
        for text, ranges in zip(columns["text"].to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            if text is not None and ranges:
                data, at, kept = text.encode(), 0, []
                for start, stop in merged((r["start"], r["stop"]) for r in ranges):
                    kept.append(data[at:start])
                    at = stop
                text = b"".join([*kept, data[at:]]).decode(errors="ignore")
            texts.append(text)
        columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)


def cut_documents(docs: DataFrame, build_bytes: int = BUILD_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes taken out of ``text``; a character that a cut
    leaves incomplete goes too. A null text stays null."""
    ranges = repeated_ranges(docs, build_bytes).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(ranges, "doc_id", "left").select("row", "ranges").mapInArrow(giving_back(_cut_texts), docs.schema)
