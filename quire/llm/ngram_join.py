"""Set-similarity join of word n-gram sets by prefix trees, and the groups that its links make.

Signatures that any two similar sets must share deal the sets into groups; inside a group the sets lie in a
trie in one token order of the group, and a traversal shares the partial overlaps of common prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm.components import components
from quire.llm.shared import blocks, doc_texts, giving_back, hash_strings, mix, split_words, written

#: Tokens of one trie, about; a larger group of similar sets is dealt in pairs of blocks.
TRIE_TOKENS = 3_000_000


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``n`` words of each text, ASCII letters lowered, and the text of each. A
    text with fewer words has one run of them all; one without words has none."""
    codes, rows, words = split_words(pc.ascii_lower(texts))
    each = hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.bincount(rows, minlength=len(texts))
    m = max(0, len(codes) - n + 1)
    runs = np.zeros(m, np.uint64)
    for k in range(n):
        runs = mix(runs + each[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
    inside = rows[:m] == rows[n - 1 :][:m]
    runs, of = runs[inside], rows[:m][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        ends = np.cumsum(counts)
        extra = np.zeros(len(short), np.uint64)
        for i, row in enumerate(short.tolist()):
            whole = np.uint64(counts[row])
            for k in range(ends[row] - counts[row], ends[row]):
                whole = mix(np.array([whole + each[k]], np.uint64))[0]
            extra[i] = whole
        runs, of = np.concatenate([runs, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
    return runs, of


def sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    runs, of = shingles(texts, n)
    cuts = np.searchsorted(of, np.arange(1, len(texts)))
    return [np.unique(s) for s in np.split(runs, cuts)] if len(texts) else []


def size_classes(percent: int, largest: int) -> np.ndarray:
    """Lower bounds of size classes such that sets similar to at least ``percent`` lie in the same class or in
    neighbours: each bound is the one before divided by the similarity. The sequence is the same for every
    ``largest``, which only says where it may end: past it lie two bounds, so its next class has an upper one."""
    bounds = [1]
    while len(bounds) < 3 or bounds[-2] <= largest:
        bounds.append(-(-bounds[-1] * 100 // percent) + (bounds[-1] * 100 % percent == 0))
    return np.array(bounds, np.int64)


def parts(upper: np.ndarray, percent: int) -> np.ndarray:
    """One more than the tokens in which two similar sets of at most ``upper`` tokens can differ. Split by a
    hash into that many parts, such sets have at least one equal part."""
    return 2 * upper * (100 - percent) // (100 + percent) + 1


def spare_parts(percent: int) -> float:
    """Parts beyond the fewest that are needed, as a share. Where the similarity leaves less than six tokens
    to a part, many would be empty by chance; with spare ones, similar sets share one that is not."""
    return 0.35 if (100 + percent) < 12 * (100 - percent) else 0.0


def signatures(rows: list[np.ndarray], percent: int, common: np.ndarray | None = None) -> list[np.ndarray]:
    """The signatures of each set: one for each part under the split of its size class and of the next.
    Similar sets have one in common; sets that share none are not similar.

    Tokens in the buckets of ``common`` enter no part: sets differ in no more tokens without them. With
    ``E`` spare parts two similar sets have ``E + 1`` equal parts at least, so a set with at most ``E`` empty
    parts is found by the others; only sets with more have signatures for empty parts too.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in rows]
    bounds = size_classes(percent, int(sizes.max()))
    own = np.searchsorted(bounds, sizes, "right") - 1
    tokens, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    if common is not None:
        rare = ~common[bucket_of(tokens)]
        tokens, of = tokens[rare], of[rare]
    out: list[list[np.ndarray]] = [[] for _ in rows]
    scrambled = mix(tokens + np.uint64(0x5851F42D4C957F2D))
    for step in (0, 1):
        which = own + step
        least = np.where(sizes > 0, parts(bounds[which + 1] - 1, percent), 0)
        spare = np.ceil(least * spare_parts(percent)).astype(np.int64)
        split = least + spare
        start = np.cumsum(split) - split
        place = start[of] + ((tokens >> np.uint64(11)) % split[of].astype(np.uint64)).astype(np.int64)
        total, filled = np.zeros(split.sum(), np.uint64), np.zeros(split.sum(), bool)
        np.add.at(total, place, scrambled)
        filled[place] = True
        row = np.repeat(np.arange(len(rows)), split)
        number = np.arange(split.sum()) - np.repeat(start, split)
        key = np.repeat(which, split).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
        total = mix(mix(key) ^ total).view(np.int64)
        many = split - np.bincount(row[filled], minlength=len(rows)) > spare
        if not spare_parts(percent):
            many[:] = True
        keep = filled | many[row]
        for i, found in enumerate(np.split(total[keep], np.cumsum(np.bincount(row[keep], minlength=len(rows)))[:-1])):
            out[i].append(found)
    return [np.concatenate(x) for x in out]


#: Buckets that count the shingles of all texts, by the top bits of their hash.
_COUNT_BITS = 18


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)


def _bucket_counts(n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _COUNT_BITS, np.int64)
        for batch in blocks(batches, 2 << 20):
            counts += np.bincount(bucket_of(shingles(batch.column("text"), n)[0]), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["bucket", "n"])

    return run


def common_buckets(rows: DataFrame, n: int) -> np.ndarray:
    """The buckets that hold shingles of many texts: those far above the mean count of all buckets. At most
    ``2 ** _COUNT_BITS`` numbers reach the driver, whatever the corpus."""
    counts = rows.mapInArrow(giving_back(_bucket_counts(n)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    mean = found["n"].sum() / (1 << _COUNT_BITS)
    common = np.zeros(1 << _COUNT_BITS, bool)
    common[found.loc[found["n"] > mean + 6 * np.sqrt(mean) + 16, "bucket"].to_numpy()] = True
    return common


def _described(n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in blocks(batches, 2 << 20):
            rows = sets(batch.column("text"), n)
            keys = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) if len(r) else None for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(r) for r in rows], pa.int64())], ["doc_id", "set_key", "n_shingles"])

    return run


def _marked(n: int, percent: int, common: np.ndarray | None) -> Callable:
    """The signatures of each text's set with the set's hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in blocks(batches, 1 << 20):
            rows = [r for r in sets(batch.column("text"), n) if len(r)]
            if not rows:
                continue
            marks = signatures(rows, percent, common)
            keys = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(np.repeat(keys, [len(m) for m in marks]))], ["mark", "set_key"])

    return run


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each set of a mark to the first one; the rows come sorted by mark and set. The marks of near copies begin
    with the same few sets, so that their links repeat each other however many marks they share."""
    last_mark = last_first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, keys = batch.column("mark").to_numpy(), batch.column("set_key").to_numpy()
        starts = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        first = keys[starts]
        if last_mark == marks[0]:
            first[0] = last_first
        last_mark, last_first = marks[-1], first[-1]
        first = np.repeat(first, np.diff(np.append(starts, len(marks))))
        other = (keys != first) & np.append(True, keys[1:] != keys[:-1])  # a set once, as copies follow each other
        yield pa.RecordBatch.from_arrays([pa.array(first[other], pa.int64()), pa.array(keys[other], pa.int64())], ["a", "b"])


def _ranked(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of each token in the order of those of most sets first, ties by value, -1 for a token of one set alone,
    which is in no overlap; and how many tokens have a place. Numbers of 32 bits, as a trie has fewer tokens."""
    by = np.argsort(tokens, kind="stable").astype(np.int32)
    values = tokens[by]
    first = np.append(True, values[1:] != values[:-1])
    del values
    counts = np.diff(np.append(np.flatnonzero(first), len(tokens)))
    order = np.argsort(-counts, kind="stable")
    shared = int((counts > 1).sum())
    rank = np.full(len(counts), -1, np.int32)
    rank[order[:shared]] = np.arange(shared, dtype=np.int32)
    out = np.empty(len(tokens), np.int32)
    out[by] = np.repeat(rank, counts)
    return out, shared


class Trie:
    """Token sets in one order, the tokens of most sets first, as sorted lists with the length that
    each has in common with the one before: an interval of the lists with a depth is a node."""

    def __init__(self, sets_: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets_], np.int64)
        ranks, shared = _ranked(np.concatenate(sets_))
        lists = []
        for end, size in zip(np.cumsum(self.sizes).tolist(), self.sizes.tolist(), strict=True):
            own = ranks[end - size : end]
            lists.append(np.sort(own[own >= 0]))
        del ranks
        self.order = sorted(range(len(sets_)), key=lambda i: lists[i].astype(">u4").tobytes())
        self.flat = np.concatenate([lists[i] for i in self.order])
        ends = np.cumsum([len(lists[i]) for i in self.order])
        del lists
        self.lists = np.split(self.flat, ends[:-1])
        self.sizes = self.sizes[self.order]
        self.lengths = np.array([len(x) for x in self.lists], np.int64)
        self.common = np.zeros(len(sets_) + 1, np.int64)
        for i in range(1, len(self.lists)):
            a, b = self.lists[i - 1], self.lists[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        holders = np.repeat(np.arange(len(sets_), dtype=np.int32), self.lengths)
        by = np.argsort(self.flat, kind="stable")
        self.holders = holders[by]
        del by, holders
        self.holder_starts = np.concatenate(([0], np.cumsum(np.bincount(self.flat, minlength=shared)))).astype(np.int64)

    def groups(self, percent: int) -> np.ndarray:
        """For each set in the given order the first set that its links lead to.

        The traversal carries the overlap of every set with the path to the node. A set is dropped below a
        node when even all that remains of the longest list there could not make it similar, or when all
        sets there are in its group already; a node without sets left is not entered.
        """
        n = len(self.lists)
        label = np.arange(n)
        marked = np.zeros(len(self.holder_starts), bool)
        stack = [(0, n, 0, np.zeros(n, np.int32), np.arange(n))]
        while stack:
            low, high, depth, overlap, alive = stack.pop()
            here = label[low:high]
            if (here == here[0]).all():
                alive = alive[label[alive] != here[0]]
            if high - low == 1:
                self._leaf(low, depth, overlap, alive, label, marked, percent)
                continue
            least = int(self.sizes[low:high].min())
            bottom = int(self.common[low + 1 : high].min())
            rest = int(self.lengths[low:high].max())
            need = -(-percent * (self.sizes[alive] + least) // (100 + percent))
            alive = alive[np.minimum(overlap[alive] + (rest - depth), self.sizes[alive]) >= need]
            if not len(alive):
                continue
            if bottom > depth:
                path = self.lists[low][depth:bottom]
                held = np.concatenate([self.holders[self.holder_starts[t] : self.holder_starts[t + 1]] for t in path.tolist()])
                overlap = overlap + np.bincount(held, minlength=n).astype(np.int32)
            cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1 : high] == bottom)).tolist(), high]
            for a, b in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True):
                stack.append((a, b, bottom, overlap, alive))
        first = np.full(n, n)
        order = np.array(self.order)
        np.minimum.at(first, label, order)
        out = np.empty(n, np.int64)
        out[order] = first[label]
        return out

    def _leaf(self, at: int, depth: int, overlap: np.ndarray, alive: np.ndarray, label: np.ndarray, marked: np.ndarray, percent: int) -> None:
        """Finishes the overlap of the sets left with one list, and unites the groups of those similar to it."""
        alive = alive[alive > at]  # each pair once
        need = -(-percent * (self.sizes[alive] + self.sizes[at]) // (100 + percent))
        possible = np.minimum(overlap[alive] + (self.lengths[at] - depth), self.sizes[alive]) >= need
        alive, need = alive[possible], need[possible]
        if not len(alive):
            return
        rest = self.lists[at][depth:]
        total = overlap[alive].astype(np.int64)
        if len(rest):
            marked[rest] = True
            lengths = self.lengths[alive]
            filled = np.flatnonzero(lengths)
            ends = np.cumsum(lengths[filled])
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[alive[filled]] - (ends - lengths[filled]), lengths[filled])
            if len(where):
                total[filled] += np.add.reduceat(marked[self.flat[where]].astype(np.int32), ends - lengths[filled])
            marked[rest] = False
        linked = label[alive[total >= need]]
        if len(linked):
            joined = np.unique(np.append(linked, label[at]))
            label[np.isin(label, joined)] = joined[0]


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text, packed, once for each pair of blocks that its group is dealt in. A packed text is a fraction of
    the hashes of its set, which nothing can pack; the set is made again where the trie is."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in blocks(batches, 2 << 20):
        group, key, count, texts = (batch.column(c).to_pylist() for c in ("group", "set_key", "blocks", "text"))
        out, size = [], 0
        for i, text in enumerate(texts):
            packed, mine = pack(text.encode()), key[i] % count[i]
            pairs = ((0, 0) for _ in "1") if count[i] == 1 else ((min(mine, b), max(mine, b)) for b in range(count[i]) if b != mine)
            for a, b in pairs:
                out.append((group[i], a, b, key[i], packed))
                size += len(packed) + 24
                if size >= DEALT_BYTES:
                    yield _dealt(out)
                    out, size = [], 0
        yield _dealt(out)


#: Bytes of the rows that are dealt at a time: a large group takes many copies of each text.
DEALT_BYTES = 2 << 20


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["group", "a", "b", "set_key", "packed"])


def _joined(n: int, percent: int) -> Callable:
    """Joins each run of rows of one group and pair of blocks; the rows come sorted by them."""

    def links(keys: list[int], texts: list[str]) -> tuple[list[int], list[int]]:
        if len(keys) < 2:
            return [], []
        whole = pa.record_batch([pa.array(texts, pa.large_string())], ["text"])
        texts.clear()
        first = Trie([s for part in blocks([whole], 1 << 20) for s in sets(part.column("text"), n)]).groups(percent)
        moved = np.flatnonzero(first != np.arange(len(first)))
        return [keys[i] for i in moved.tolist()], [keys[i] for i in first[moved].tolist()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now, keys, texts = None, [], []
        for batch in batches:
            a_out, b_out = [], []
            for *place, key, own in zip(*(batch.column(c).to_pylist() for c in ("group", "a", "b", "set_key", "packed")), strict=True):
                if place != now:
                    a, b = links(keys, texts)
                    a_out += a
                    b_out += b
                    now, keys, texts = place, [], []
                keys.append(key)
                texts.append(unpack(own).decode())
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        a, b = links(keys, texts)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def join_groups(docs: DataFrame, n: int = 5, percent: int = 80, trie_tokens: int = TRIE_TOKENS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set of ``n``-word shingles and the
    smallest doc_id that links reach.

    Two rows link if ``100 * intersection >= percent * union``. Rows with equal sets are one set from the
    start. A null or empty text, or one without words, has no shingles and links with nothing; a null id
    counts as the largest. Repeated rows share a group. The search is exact: sets similar enough share a
    signature, sets that share one meet in a trie, groups of more than ``trie_tokens`` tokens in every pair
    of their blocks. Only sets that share a signature with another are gathered, one for each distinct set.
    """
    rows = doc_texts(docs)
    described = written(rows.mapInArrow(giving_back(_described(n)), "doc_id long, set_key long, n_shingles long"), "sets")
    common = common_buckets(rows, n) if spare_parts(percent) else None
    marks = rows.mapInArrow(giving_back(_marked(n, percent, common)), "mark long, set_key long")
    ordered = marks.repartition("mark").sortWithinPartitions("mark", "set_key")
    # one link for all marks that two sets share, as its tasks would each make stars of the same sets
    links = ordered.mapInArrow(giving_back(_stars), "a long, b long").distinct()
    near = components(links, "a", "b").toDF("set_key", "group")
    known = described.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = written(near.join(known.where("doc_id IS NOT NULL"), "set_key"), "members")
    sizes = members.groupBy("group").agg(F.ceil(2 * F.sum("n") / F.lit(float(trie_tokens))).cast("int").alias("halves"))
    sizes = sizes.select("group", F.when(F.col("halves") <= 2, 1).otherwise(F.col("halves")).alias("blocks"))
    dealt = attach(members.select("doc_id", "set_key", "group"), sizes, ["group"], "inner")
    texts = rows.join(dealt, "doc_id").select("text", "group", "set_key", "blocks")
    placed = texts.mapInArrow(giving_back(_deal), "group long, a int, b int, set_key long, packed binary")
    placed = placed.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "set_key")
    linked = components(placed.mapInArrow(giving_back(_joined(n, percent)), "a long, b long"), "a", "b").toDF("set_key", "component")
    named = attach(described.select("doc_id", "set_key", "n_shingles"), linked, ["set_key"])
    named = written(named.select("doc_id", "n_shingles", F.coalesce("component", "set_key").alias("label")), "named")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return attach(named, least, ["label"]).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
