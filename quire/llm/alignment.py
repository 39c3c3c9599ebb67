"""Alignment of the tokens of two tokenizers over the same text, and how well the corpus supports each link.

Tokens of both sides are cut into groups where their bytes end together: the ends of each side are keys of a
dictionary to token indexes, the sorted keys that both share slice the two id lists, and inside a slice all
tokens whose byte ranges overlap are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm import pieces, tokens
from quire.llm.shared import blocks, doc_texts, gathered, spread, written

#: Ids of the second side take this many bits of a pair's code.
_BITS = 20
#: Aligned words that a task remembers, and the bytes of text whose pairs share one dictionary.
REMEMBERED, CHUNK_BYTES = 400_000, 8 << 20


def slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte offsets where tokens of both sides end, and how many tokens of each side lie up to each.

    Tokens without bytes end with the token before them.
    """
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1), strict=True))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    return np.array(common, np.int64), *(np.array([at[end] for end in common], np.int64) for at in (a_at, b_at))


def links(a_ends: np.ndarray, b_ends: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens whose byte ranges overlap, slice by slice; tokens without bytes overlap with nothing.

    A slice of one token on a side links it with all on the other. In the rest, the tokens of the other side that
    a token overlaps follow each other from the first that ends behind its start.
    """
    a_counts, b_counts = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
    plain = (a_counts == 1) | (b_counts == 1)
    in_plain = np.repeat(plain, a_counts)
    slice_of = np.repeat(np.arange(len(a_stops)), a_counts)
    a_used, b_used = a_stops[-1] if len(a_stops) else 0, b_stops[-1] if len(b_stops) else 0
    starts = np.concatenate(([0], a_ends))[:a_used]
    b_starts = np.concatenate(([0], b_ends))[:b_used]
    low = (b_stops - b_counts)[slice_of]
    high = b_stops[slice_of]
    odd = np.flatnonzero(~in_plain)
    low[odd] = np.searchsorted(b_ends[:b_used], starts[odd], "right")
    high[odd] = np.searchsorted(b_starts, a_ends[:a_used][odd], "left")
    sizes = np.where(a_ends[:a_used] > starts, high - low, 0)
    left, right = np.repeat(np.arange(a_used), sizes), spread(low, sizes)
    if not (b_ends[:b_used] > b_starts).all():
        filled = (b_ends[:b_used] > b_starts)[right]
        left, right = left[filled], right[filled]
    return left, right


class Units:
    """Aligned texts or words, one after the other: sizes of each, the codes of its linked pairs, its groups as text."""

    def __init__(self) -> None:
        self.fits, self.counts = np.zeros(0, bool), np.zeros((0, 4), np.int64)  # tokens A and B, groups, links
        self.pairs, self.strings = np.zeros(0, np.int64), []

    def add(self, other: Units) -> None:
        self.fits, self.counts = np.concatenate([self.fits, other.fits]), np.concatenate([self.counts, other.counts])
        self.pairs = np.concatenate([self.pairs, other.pairs])
        self.strings = self.strings + other.strings

    def take(self, which: np.ndarray) -> Units:
        out = Units()
        out.fits, out.counts = self.fits[which], self.counts[which]
        starts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        out.pairs = self.pairs[spread(starts[which], out.counts[:, 3])]
        out.strings = [self.strings[i] for i in which.tolist()]
        return out


class Side:
    """The bytes of each id of a tokenizer."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled = spelled
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.starts[ids], self.sizes[ids])]


class Aligner:
    """Units of texts by a byte-level vocabulary (side A) and a model of pieces (side B)."""

    def __init__(self, vocabulary: str, model: str) -> None:
        import sentencepiece

        self.encoder = tokens.Encoder(vocabulary)
        byte_of = {chr(letter): byte for byte, letter in enumerate(tokens._byte_letters().tolist()) if byte != 0x0A}
        byte_of["Ċ"] = 0x0A
        known = self.encoder.tokenizer.get_vocab()
        spelled = [b""] * len(known)
        for token, i in known.items():
            spelled[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.a = Side(spelled)
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        named = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(pieces.BLANK, " ").encode() for i, p in named])
        # no piece may hold a blank inside, or a line feed beside others, so that words are encoded apart
        plain = [x for (i, _), x in zip(named, self.b.spelled, strict=True) if not self.model.is_byte(i)]
        self.by_words = all(b" " not in x.lstrip(b" ") and b"\n" not in x for x in plain)
        self.leads = np.array([p.startswith(pieces.BLANK) for _, p in named])
        self.known: dict[str, int] = {}
        self.units = Units()

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for a blank and each text."""
        return self.encoder._whole([" " + t for t in texts]), self.model.encode(texts, num_threads=1)

    def _made(self, sizes: np.ndarray, text: np.ndarray, a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> Units:
        """Units of so many bytes each from the ids of both sides. Both end a token where a unit ends, so all units
        are aligned in one go over the offsets of their bytes laid side by side."""
        out = Units()
        fits = np.ones(len(sizes), bool)
        for side, ids, counts in ((self.a, a, a_counts), (self.b, b, b_counts)):
            spelled = side.text(ids)
            of = np.repeat(np.arange(len(sizes)), counts)
            fits &= np.bincount(of, weights=side.sizes[ids], minlength=len(sizes)).astype(np.int64) == sizes
            if len(spelled) == len(text):
                differ = np.flatnonzero(spelled != text)
                fits[np.searchsorted(np.cumsum(sizes), differ, "right")] = False
            else:  # some unit is longer or shorter: compare one by one
                ends, stops = np.cumsum(np.bincount(of, weights=side.sizes[ids], minlength=len(sizes)).astype(np.int64)), np.cumsum(sizes)
                for i in np.flatnonzero(fits).tolist():
                    fits[i] = np.array_equal(spelled[ends[i] - sizes[i] : ends[i]], text[stops[i] - sizes[i] : stops[i]])
        if not fits.all():
            a, b = a[np.repeat(fits, a_counts)], b[np.repeat(fits, b_counts)]
            a_counts, b_counts, sizes = a_counts * fits, b_counts * fits, sizes * fits
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        ends, a_stops, b_stops = slices(a_ends, b_ends)
        left, right = links(a_ends, b_ends, a_stops, b_stops)
        unit_ends = np.cumsum(sizes)
        groups = np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(left, np.cumsum(a_counts), "left"), prepend=0)
        out.fits, out.counts = fits, np.stack([a_counts, b_counts, groups, n_links], axis=1)
        out.pairs = a[left] << _BITS | b[right]
        names, others = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts, i, j = [], 0, 0
        for a_stop, b_stop in zip(a_stops.tolist(), b_stops.tolist(), strict=True):
            if a_stop - i == 1 and b_stop - j == 1:
                parts.append(names[i] + "|" + others[j])
            else:
                parts.append(",".join(names[i:a_stop]) + "|" + ",".join(others[j:b_stop]))
            i, j = a_stop, b_stop
        cut = np.cumsum(groups).tolist()
        out.strings = [parts[s] if e - s == 1 else ";".join(parts[s:e]) for s, e in zip([0, *cut], cut, strict=False)]
        return out

    def whole(self, texts: list[str]) -> Units:
        """A unit for each text."""
        a, b = self.ids(texts)
        raw = [b" " + t.encode() for t in texts]
        flat = [np.array([i for x in side for i in x], np.int64) for side in (a, b)]
        counts = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
        return self._made(np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8), flat[0], counts[0], flat[1], counts[1])

    def words(self, words: list[str]) -> np.ndarray:
        """Places of the units of words in ``units``, made where they are new. A word that starts with a line feed
        follows it, others follow a blank."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.units = {}, Units()
        new = [w for w in words if w not in self.known]
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        made = Units()
        for low in range(0, len(new), 20_000):
            made.add(self._word_units(new[low : low + 20_000]))
        if new:
            self.units.add(made)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _word_units(self, words: list[str]) -> Units:
        array = pa.array(words, pa.large_string())
        feeds = pc.starts_with(array, "\n").to_numpy(zero_copy_only=False)
        a, a_counts = self.encoder._learn(array)
        b = np.array([i for low in range(0, len(words), 500) for i in self.model.encode(" ".join(words[low : low + 500]))], np.int64)
        at = np.flatnonzero(self.leads[b])  # each word starts at one; a line feed follows the bare blank
        b_counts = np.diff(np.append(at, len(b)))
        b, b_counts = np.delete(b, at[feeds]), b_counts - feeds
        raw = b"".join([(w if feed else " " + w).encode() for w, feed in zip(words, feeds.tolist(), strict=True)])
        sizes = pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64) + ~feeds
        return self._made(sizes, np.frombuffer(raw, np.uint8), a, a_counts, b, b_counts)

    def split(self, texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
        """Distinct units, which of them each text is made of one after the other, and the text of each.

        Where white space is regular both sides split at every blank and before every line feed, so the words
        between are units, each made once. Other texts are one unit. An empty text has none, and one with the
        blank of the pieces in it, which they give back as an ordinary one, has a unit that does not fit.
        """
        texts = texts.cast(pa.large_string())
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, tokens._IRREGULAR + "|" + pieces.BLANK).to_numpy(zero_copy_only=False) if self.by_words else ~empty
        regular, whole = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd & ~empty)
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(regular)), "\n", " \n"), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        encoded = pc.list_flatten(lists).dictionary_encode()
        places = self.words(encoded.dictionary.to_pylist())
        units = self.units.take(places)
        if len(whole):
            units.add(self.whole(texts.take(pa.array(whole)).to_pylist()))
        which = np.concatenate([encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(places) + np.arange(len(whole))])
        of = np.concatenate([regular[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)], whole]).astype(np.int64)
        order = np.argsort(of, kind="stable") if len(whole) else slice(None)
        return units, which[order], of[order]


_ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, codes array<long>, docs array<long>"
)
_ALIGNED_ARROW = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk(aligner: Aligner, number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row a document, with the pairs it holds as places in the chunk's dictionary and how often it holds
    each. The first row carries the dictionary: the code of each pair and how many documents here hold it."""
    n = len(texts)
    units, which, of = aligner.split(texts)
    bad = np.zeros(n, bool)
    bad[of[~units.fits[which]]] = True
    stay = ~bad[of]
    which, of, counts = which[stay], of[stay], units.counts
    sums = np.stack([np.bincount(of, weights=counts[which, c], minlength=n).astype(np.int64) for c in range(4)])
    strings = units.strings
    stops = np.searchsorted(of, np.arange(n), "right")
    starts = np.searchsorted(of, np.arange(n), "left")
    digests = []
    for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        joined = ";".join([strings[u] for u in which[start:stop].tolist()])
        digests.append(hashlib.sha256(joined.encode()).hexdigest() if stop > start else "")
    # distinct units of each document, then its distinct pairs
    sizes = counts[:, 3]
    codes, place = np.unique(units.pairs, return_inverse=True)
    n_units = max(1, len(sizes))
    held, times = np.unique(of * n_units + which, return_counts=True)
    doc, unit = held // n_units, held % n_units
    at = spread((np.cumsum(sizes) - sizes)[unit], sizes[unit])
    keys = np.repeat(doc, sizes[unit]) * max(1, len(codes)) + place[at]
    held, back = np.unique(keys, return_inverse=True)
    times = np.bincount(back, weights=np.repeat(times, sizes[unit]), minlength=len(held)).astype(np.int32)
    pair = (held % max(1, len(codes))).astype(np.int32)
    cut = np.searchsorted(held // max(1, len(codes)), np.arange(n + 1))
    docs = np.bincount(pair, minlength=len(codes))
    used = docs > 0  # a word may stand only in texts that do not fit
    kept = np.cumsum(used) - 1
    pair = kept[pair].astype(np.int32)
    rest = [None] * (n - 1)
    return pa.RecordBatch.from_arrays([
        pa.array([number] * n, pa.int64()), ids, *(pa.array(s) for s in sums), pa.array(digests, pa.string()),
        *(pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()) for x in (pair, times)),
        *(pa.array([x[used].tolist(), *rest], pa.list_(pa.int64())) for x in (codes, docs)),
    ], schema=_ALIGNED_ARROW)


def _aligned(vocabulary: str, model: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(vocabulary, model)
        number = TaskContext.get().partitionId() << 32
        for block in gathered(batches, CHUNK_BYTES):
            yield _chunk(aligner, number, block.column("doc_id"), block.column("text"))
            number += 1

    return run


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Best links and sums of counts of the documents of a chunk from what the corpus says about its pairs."""
    at = pairs.column("at").to_numpy()
    count = np.zeros(len(at), np.int64)
    best = np.zeros(len(at), np.int64)
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    n_best, count_sum = [], []
    for pair, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, often = np.frombuffer(pair, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        n_best.append(int(best[own] @ often))
        count_sum.append(int(count[own] @ often))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.Table.from_arrays(
        [*(docs.column(c) for c in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")],
        [*names, "n_best", "count_sum", "groups_sha256"],
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``code, count, best`` of every linked id pair: how many documents hold it, and whether no other pair of
    its A id is held by more. Documents are counted in each chunk already."""
    zipped = F.explode(F.arrays_zip("codes", "docs")).alias("p")
    counts = aligned.where("codes IS NOT NULL").select(zipped).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.docs").alias("count"))
    counts = counts.withColumn("a", F.shiftright("code", _BITS))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return attach(counts, top, ["a"], "inner").select("code", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def alignment_digests(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row from its whole text.

    A null or empty text, and one that a side does not give back byte for byte, has no tokens: zeros and an empty
    hash. Repeated rows are documents of their own, also in the counts of pairs; a null id stays null. No rows
    give no rows. Texts are tokenised once, in chunks; what travels are the distinct pairs of each chunk, which
    are counted over the corpus and joined back, not the links.
    """
    fn = _aligned(vocabulary or tokens.vocabulary_path(), model or pieces.model_path())
    aligned = written(doc_texts(docs).mapInArrow(fn, _ALIGNED), "aligned")
    counts = written(pair_counts(aligned), "pair_counts")
    asked = aligned.where("codes IS NOT NULL").select(F.col("chunk").alias("asker"), F.posexplode("codes").alias("at", "code"))
    told = attach(asked, counts, ["code"], "inner").select("asker", "at", "count", "best")
    return aligned.drop("codes", "docs").groupBy("chunk").cogroup(told.groupBy("asker")).applyInArrow(_summed, _DIGEST)


def _spelled(vocabulary: str, model: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, model)
        schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            rows = []
            for doc, text, *both in zip(block.column("doc_id").to_pylist(), texts, *aligner.ids(texts), strict=True):
                raw = np.frombuffer(b" " + text.encode(), np.uint8)
                a, b = (np.array(x, np.int64) for x in both)
                if not text or not np.array_equal(aligner.a.text(a), raw) or not np.array_equal(aligner.b.text(b), raw):
                    a = b = np.zeros(0, np.int64)
                a_ends, b_ends = np.cumsum(aligner.a.sizes[a]), np.cumsum(aligner.b.sizes[b])
                _, a_stops, b_stops = slices(a_ends, b_ends)
                pairs = links(a_ends, b_ends, a_stops, b_stops)
                groups, linked = ([{x: i, y: j} for i, j in zip(*(c.tolist() for c in both), strict=True)] for x, y, both in (("a_end", "b_end", (a_stops, b_stops)), ("a", "b", pairs)))
                rows.append({"doc_id": doc, "a_ids": a.tolist(), "b_ids": b.tolist(), "groups": groups, "links": linked})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def align_documents(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``doc_id, a_ids, b_ids, groups, links`` of every row: the ids of both sides, the number of tokens of each up
    to the end of each group, and the indexes of linked tokens. Rows without tokens have empty lists."""
    fn = _spelled(vocabulary or tokens.vocabulary_path(), model or pieces.model_path())
    return doc_texts(docs).mapInArrow(fn, "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>, links array<struct<a: int, b: int>>")
