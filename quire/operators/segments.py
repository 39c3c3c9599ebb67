"""A stored full-text index that follows its pages: segments, delete marks, and ranked search by block bounds.

An index is a folder of numbered segments. A segment never changes and holds

* ``forward``: its pages with their tokens,
* ``postings``: for each token and bucket of pages one block of postings, headed by the greatest count and the
  least page length in it, from which a bound on any score in the block follows for every average length,
* ``prefixes``: on how many pages each token prefix is found, less the pages that the segment marks as dead,
* ``marks``: pages of earlier segments that it replaces or deletes.

A manifest names the segments that count. It is kept in two slots written in turn, so that one is always whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quire.functions.skew import attach
from quire.functions.tokens import query_terms
from quire.operators.search import counted_tokens, gain, idf, ranked_words, search_terms
from quire.operators.transitions import last_by_key

_PAGE = ["document_id", "page_number"]
#: Most pages of a bucket; segments of one size tier that are merged; size of the smallest tier and step between tiers.
BUCKET_PAGES, FAN_IN, SMALLEST, STEP = 512, 4, 64, 4
#: Longest prefix in the dictionary. The pages of longer query terms are counted from their postings.
PREFIX_LENGTH = 24
#: Buckets of a query that are read first, to find the score that others must reach.
FIRST_BUCKETS = 8
#: Scores are rounded to so many digits before they are ranked.
DIGITS = 6


@dataclass(frozen=True)
class Segment:
    """Stored pages, pages marked dead since, and what the segment adds to the live pages and their tokens."""

    number: int
    stored: int
    dead: int
    pages: int
    tokens: int

    @property
    def tier(self) -> int:
        return int(math.log(max(1, self.stored / SMALLEST), STEP))


_MANIFEST = "version bigint, batch_id bigint, next_number int, number int, stored bigint, dead bigint, pages bigint, tokens bigint"


class Index:
    """The segments of one version of the index in ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.version, self.batch_id, self.next_number, self.segments = -1, -1, 0, []
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/slot=[01]").collect()
        except AnalysisException:  # nothing is stored yet
            rows = []
        if rows:
            self.version = max(r.version for r in rows)
            rows = [r for r in rows if r.version == self.version]
            self.batch_id, self.next_number = rows[0].batch_id, rows[0].next_number
            self.segments = [Segment(r.number, r.stored, r.dead, r.pages, r.tokens) for r in rows if r.number is not None]

    def commit(self, batch_id: int) -> None:
        self.version, self.batch_id = self.version + 1, batch_id
        head = (self.version, batch_id, self.next_number)
        names = ("number", "stored", "dead", "pages", "tokens")
        rows = [(*head, *(asdict(s)[n] for n in names)) for s in self.segments] or [(*head, None, None, None, None, None)]
        frame = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/slot={self.version % 2}")

    def part(self, kind: str, *segments: Segment) -> DataFrame:
        """Rows of the given segments, or of all that count, with their ``segment``."""
        numbers = [s.number for s in segments or self.segments]
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={n}" for n in numbers])
        return rows.withColumn("segment", F.col("segment").cast("int"))

    def live(self, *segments: Segment) -> DataFrame:
        """Pages that no later segment has marked as dead."""
        marks = self.part("marks").select(F.col("dead_segment").alias("segment"), *_PAGE)
        return self.part("forward", *segments).join(marks, ["segment", *_PAGE], "left_anti")

    def postings(self) -> DataFrame:
        """(token, document_id, page_number, tf, dl) of all live pages."""
        pages = self.live().select(*_PAGE, "dl", F.explode("tokens").alias("_c"))
        return pages.select("_c.token", *_PAGE, "_c.tf", "dl")

    def size(self) -> tuple[int, float]:
        """Number of live pages and their average length."""
        pages = sum(s.pages for s in self.segments)
        return pages, sum(s.tokens for s in self.segments) / pages if pages else 0.0

    def write(self, forward: DataFrame, dead: DataFrame | None, marks: DataFrame | None, prefixes: DataFrame | None = None) -> Segment:
        """A new segment of the pages in ``forward``. ``dead`` are the pages, with their tokens, that it takes out
        of others, which ``marks`` names. ``prefixes`` are given where they are known."""
        number, self.next_number = self.next_number, self.next_number + 1
        place = {kind: f"{self.path}/{kind}/segment={number}" for kind in ("forward", "postings", "prefixes", "marks")}
        columns = [*_PAGE, "dl", "tokens"]
        forward.select(columns).write.mode("overwrite").parquet(place["forward"])
        stored = self.spark.read.parquet(place["forward"])
        sizes = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        types = ", ".join(f"`{c}`: {stored.schema[c].dataType.simpleString()}" for c in _PAGE)
        head = "token string, bucket bigint, max_tf int, min_dl int, n bigint"
        made = stored.mapInArrow(_blocks(BUCKET_PAGES), f"{head}, pages array<struct<{types}>>")
        made.write.mode("overwrite").parquet(f"{self.path}/made/segment={number}")
        ranged = self.spark.read.parquet(f"{self.path}/made/segment={number}").repartitionByRange("token", "bucket")
        ranged.sortWithinPartitions("token", "bucket").write.mode("overwrite").parquet(place["postings"])
        if prefixes is None:
            prefixes = _prefixes(stored, 1)
            if dead is not None:
                prefixes = prefixes.unionByName(_prefixes(dead, -1))
        prefixes.groupBy("prefix").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(place["prefixes"])
        if marks is None:
            marks = stored.select(F.lit(0).alias("dead_segment"), *_PAGE).limit(0)
        marks.select("dead_segment", *_PAGE).write.mode("overwrite").parquet(place["marks"])
        return Segment(number, sizes.n, 0, sizes.n, sizes.dl)


def _blocks(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Posting blocks of stored pages. Up to ``size`` pages that are stored next to each other are a bucket, so
    its blocks are made where the pages are read."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                lists = part.column("tokens")
                counted = pc.list_flatten(lists)
                words, at = ranked_words(pc.struct_field(counted, "token"))
                if len(words):
                    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                    order = np.argsort(at, kind="stable")
                    starts = np.searchsorted(at[order], np.arange(len(words)))
                    rows = rows[order]
                    tf = pc.struct_field(counted, "tf").to_numpy(zero_copy_only=False)[order]
                    dl = part.column("dl").to_numpy(zero_copy_only=False)[rows]
                    ends = np.append(starts, len(rows))
                    pages = pa.StructArray.from_arrays([part.column(c).take(pa.array(rows)) for c in _PAGE], _PAGE)
                    yield pa.RecordBatch.from_arrays(
                        [
                            words, pa.array(np.full(len(words), bucket)), pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
                            pa.array(np.minimum.reduceat(dl, starts).astype(np.int32)), pa.array(np.diff(ends)),
                            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pages),
                        ],
                        ["token", "bucket", "max_tf", "min_dl", "n", "pages"],
                    )
                bucket += 1

    return made


def _prefixes(pages: DataFrame, sign: int) -> DataFrame:
    """(prefix, n): each token prefix of each page once, counted by page with a sign."""
    each = pages.select(F.col("tokens.token").alias("_t")).mapInArrow(_counted_prefixes, "prefix string, n bigint")
    return each.groupBy("prefix").agg((F.sum("n") * sign).alias("n"))


def _counted_prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a page are in order, so a token brings the prefixes that are longer than what it shares with
    the one before. How many pages of a batch bring a word with how much shared is counted first; only the
    distinct words are taken apart into prefixes."""
    for batch in batches:
        lists = batch.column("_t")
        words, at = ranked_words(pc.list_flatten(lists))
        if not len(words):
            continue
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        letters = np.array(pc.utf8_slice_codeunits(words, 0, PREFIX_LENGTH).to_pylist(), f"U{PREFIX_LENGTH}").view(np.uint32).reshape(len(words), -1)
        lengths = (letters != 0).sum(axis=1)

        def shared(one: np.ndarray, other: np.ndarray, letters: np.ndarray = letters) -> np.ndarray:
            """Letters at the start of both words; two equal starts of full length share all."""
            out = np.empty(len(one), np.int64)
            for start in range(0, len(one), 1 << 17):
                part = slice(start, start + (1 << 17))
                same = (letters[one[part]] == letters[other[part]]) & (letters[one[part]] != 0)
                out[part] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            return out

        known = np.zeros(len(at), np.int64)
        next_to = np.flatnonzero(rows[1:] == rows[:-1]) + 1
        known[next_to] = shared(at[next_to], at[next_to - 1])
        width = PREFIX_LENGTH + 1
        brought = np.bincount(at * width + known, minlength=len(words) * width).reshape(-1, width).cumsum(axis=1)
        beside = np.zeros(len(words), np.int64)
        beside[1:] = shared(np.arange(1, len(words)), np.arange(len(words) - 1))
        for length in range(1, PREFIX_LENGTH + 1):
            long = np.flatnonzero(lengths >= length)
            if not len(long):
                break
            firsts = np.flatnonzero(beside[long] < length)
            n = np.add.reduceat(brought[long, length - 1], firsts)
            prefix = pc.utf8_slice_codeunits(words.take(pa.array(long[firsts])), 0, length)
            yield pa.RecordBatch.from_arrays([prefix, pa.array(n)], ["prefix", "n"])


def build_index(pages: DataFrame, path: str) -> Index:
    """Stores an index of (document_id, page_number, markdown) in an empty folder."""
    index = Index(pages.sparkSession, path)
    index.segments.append(index.write(counted_tokens(pages.where(F.col("markdown").isNotNull())), None, None))
    index.commit(-1)
    return index


def update_index(spark: SparkSession, path: str, changes: DataFrame, batch_id: int, order: str | None = None) -> Index:
    """Brings the index in step with changed pages; a null markdown deletes a page.

    Of several changes of one page the last by ``order`` counts. A batch that is already in the index changes
    nothing. Its pages become one new segment, which marks their earlier versions as dead; segments are then
    merged where a size tier is full. All other segments stay as they are.
    """
    index = Index(spark, path)
    if batch_id <= index.batch_id:
        return index
    changes = last_by_key(changes, _PAGE, order)
    dead = marks = None
    if index.segments:
        # the dead pages are read again from the marks, which are written first and cut the plan there
        found = index.live().join(changes.select(*_PAGE), _PAGE, "left_semi")
        place = f"{path}/found/batch={batch_id}"
        found.write.mode("overwrite").parquet(place)
        dead = spark.read.parquet(place)
        marks = dead.select(F.col("segment").alias("dead_segment"), *_PAGE)
    new = index.write(counted_tokens(changes.where(F.col("markdown").isNotNull())), dead, marks)
    if dead is not None:
        gone = {r.segment: r for r in dead.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()}
        index.segments = [replace(s, dead=s.dead + gone[s.number].n) if s.number in gone else s for s in index.segments]
        new = replace(new, pages=new.pages - sum(r.n for r in gone.values()), tokens=new.tokens - sum(r.dl for r in gone.values()))
    index.segments.append(new)
    while group := _full(index.segments):
        _merge(index, group)
    index.commit(batch_id)
    return index


def _full(segments: list[Segment]) -> list[Segment]:
    """Segments to be merged: a tier with enough of them, or one that is mostly dead."""
    for tier in sorted({s.tier for s in segments}):
        own = [s for s in segments if s.tier == tier]
        if len(own) >= FAN_IN:
            return own
    return [s for s in segments if s.dead * 2 > s.stored][:1]


def _merge(index: Index, group: list[Segment]) -> None:
    """Replaces segments by one of their live pages; what they took out of others stays taken out."""
    own = [s.number for s in group]
    others = [s.number for s in index.segments if s.number not in own]
    marks = index.part("marks", *group).where(F.col("dead_segment").isin(others)) if others else None
    prefixes = index.part("prefixes", *group).drop("segment")
    made = index.write(index.live(*group), None, marks, prefixes)
    made = replace(made, pages=sum(s.pages for s in group), tokens=sum(s.tokens for s in group))
    index.segments = [s for s in index.segments if s.number not in own] + [made]


def search_index(
    index: Index, queries: DataFrame, k: int = 30, key: str = "query_id", text: str = "query",
    within: DataFrame | None = None, ties: bool = False, only: list[str] | None = None,
) -> DataFrame:
    """The ``k`` best pages (key, document_id, page_number, score, rank) for each row of a query table.

    A page must hold every prefix term of the query. ``within`` limits the pages to some documents (a column
    document_id); statistics stay those of all pages. With ``ties`` all pages as good as the last one are kept.
    ``only`` are the terms where they are known beforehand; they then reach the scan as filters.

    For each query, the buckets in which its rarest term is found are taken, and of them those whose block heads
    show every other term, with a bound on the scores inside. The best few are read first; their ``k``-th score
    leaves of the others only the buckets whose bound reaches it. Blocks are opened in these buckets only, for
    the rarest term; the pages found are scored from their own row.
    """
    n_pages, average = index.size()
    if not n_pages:
        nothing = ("document_id", "bigint"), ("page_number", "int"), ("score", "double"), ("rank", "int")
        return queries.select(key, *[F.lit(None).cast(kind).alias(name) for name, kind in nothing]).limit(0)
    average = F.lit(float(average))
    wanted = queries.select(key, F.explode(query_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("weight"))
    terms = wanted.select("term").distinct()
    heads = index.part("postings").select("segment", "token", "bucket", "max_tf", "min_dl", "n")
    dictionary = index.part("prefixes").select("prefix", "n")
    if only is not None:
        heads = heads.where(reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in only]))
        dictionary = dictionary.where(F.col("prefix").isin(only))
    lengths = terms.agg(F.collect_set(F.char_length("term")).alias("l"))
    fitting = F.filter(F.col("_lens"), lambda n: n <= F.char_length("token"))
    prefixed = heads.withColumn("_lens", lengths.scalar()).withColumn("_len", F.explode(fitting))
    prefixed = prefixed.withColumn("term", F.substr("token", F.lit(1), F.col("_len"))).drop("_lens", "_len")
    matched = attach(prefixed, terms, ["term"], "inner")

    short = attach(dictionary.withColumnRenamed("prefix", "term"), terms, ["term"], "inner").groupBy("term").agg(F.sum("n").alias("n_term"))
    frequency = short.unionByName(_long_terms(index, matched))
    weighted = wanted.join(frequency, "term", "left").withColumn(
        "w", F.col("weight") * idf(F.lit(n_pages), F.col("n_term"))
    )
    asked = weighted.groupBy(key).agg(
        F.collect_list(F.struct("term", "w")).alias("terms"), F.min_by("term", F.struct("n_term", "term")).alias("lead"),
        F.bool_and(F.coalesce(F.col("n_term"), F.lit(0)) > 0).alias("complete"),
    ).where("complete").drop("complete")

    bounds = matched.groupBy("term", "segment", "bucket").agg(F.sum("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
    led = asked.withColumnRenamed("lead", "term").join(bounds.select("term", "segment", "bucket"), "term").withColumnRenamed("term", "lead")
    each = led.select(key, "lead", "segment", "bucket", F.size("terms").alias("needed"), F.explode("terms").alias("_t"))
    each = each.select(key, "lead", "segment", "bucket", "needed", "_t.term", "_t.w")
    alive = attach(each, bounds, ["term", "segment", "bucket"], "inner").groupBy(key, "lead", "segment", "bucket").agg(
        F.sum(F.col("w") * gain(F.col("tf"), F.col("dl"), average)).alias("bound"), F.count(F.lit(1)).alias("found"), F.max("needed").alias("needed")
    ).where("found = needed")
    best_first = Window.partitionBy(key).orderBy(F.desc("bound"), "segment", "bucket")
    alive = alive.withColumn("_place", F.row_number().over(best_first))

    def scored(buckets: DataFrame) -> DataFrame:
        opened = buckets.select(key, F.col("lead").alias("term"), "segment", "bucket").join(
            matched.select("term", "segment", "bucket", "token"), ["term", "segment", "bucket"]
        )
        blocks = index.part("postings").select("segment", "token", "bucket", "pages")
        pages = opened.join(blocks, ["segment", "token", "bucket"]).select(key, "segment", F.explode("pages").alias("_p"))
        pages = pages.select(key, "segment", "_p.document_id", "_p.page_number").distinct()
        if within is not None:
            pages = pages.join(within.select("document_id").distinct(), "document_id", "left_semi")
        rows = pages.join(_holding(index.live(), only), ["segment", *_PAGE]).join(asked.select(key, "terms"), key)
        return rows.select(key, *_PAGE, _score(average).alias("score")).where(F.col("score").isNotNull())

    first = scored(alive.where(F.col("_place") <= FIRST_BUCKETS))
    order = Window.partitionBy(key).orderBy(F.desc("score"), *_PAGE)
    floor = first.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == k).select(key, F.col("score").alias("floor"))
    rest = alive.where(F.col("_place") > FIRST_BUCKETS).join(floor, key, "left")
    slack = 10.0 ** -DIGITS * 2
    reached = scored(rest.where("floor IS NULL OR bound >= floor - " + repr(slack)))
    by = Window.partitionBy(key).orderBy(F.desc("score")) if ties else order
    ranked = first.unionByName(reached).withColumn("rank", (F.rank() if ties else F.row_number()).over(by))
    return ranked.where(F.col("rank") <= k)


def _holding(pages: DataFrame, terms: list[str] | None) -> DataFrame:
    """Of stored pages those that hold every one of the terms, with the tokens that start with one of them; all pages
    where the terms are not known. Pages are cut so in the scan, before they are shuffled."""
    if terms is None:
        return pages

    def begins(term: str) -> Callable[[Column], Column]:
        return lambda x: x.token.startswith(term)

    tests = [begins(t) for t in terms]
    every = reduce(lambda a, b: a & b, [F.exists("tokens", test) for test in tests])
    return pages.where(every).withColumn("tokens", F.filter("tokens", lambda x: reduce(lambda a, b: a | b, [test(x) for test in tests])))


def _long_terms(index: Index, matched: DataFrame) -> DataFrame:
    """(term, n_term) of terms beyond the dictionary, from the live pages in their blocks."""
    long = matched.where(F.char_length("term") > PREFIX_LENGTH).select("term", "segment", "token", "bucket")
    blocks = index.part("postings").where(F.char_length("token") > PREFIX_LENGTH).select("segment", "token", "bucket", "pages")
    pages = long.join(blocks, ["segment", "token", "bucket"]).select("term", "segment", F.explode("pages").alias("_p"))
    pages = pages.select("term", "segment", "_p.document_id", "_p.page_number").distinct()
    marks = index.part("marks").select(F.col("dead_segment").alias("segment"), *_PAGE)
    return pages.join(marks, ["segment", *_PAGE], "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def _score(average: Column) -> Column:
    """Score of a page row by its tokens and the query's terms; null where a term is missing."""
    parts = F.transform("terms", lambda t: F.struct(
        t.w.alias("w"), F.aggregate(F.filter("tokens", lambda x: x.token.startswith(t.term)), F.lit(0), lambda a, x: a + x.tf).alias("tf")
    ))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(p.tf > 0, p.w * gain(p.tf, F.col("dl"), average)))
    return F.round(total, DIGITS)


def search_stored(index: Index, query: str, k: int = 30, within: DataFrame | None = None) -> DataFrame:
    """The ``k`` best pages of one query text and all as good as the last: (document_id, page_number, score)."""
    terms = list(dict.fromkeys(search_terms(query)))
    queries = index.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query if terms else "").alias("query"))
    found = search_index(index, queries, k, within=within, ties=True, only=terms or [" "])
    return found.select(*_PAGE, "score")
