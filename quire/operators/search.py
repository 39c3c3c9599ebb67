"""Ranked prefix search: postings, corpus statistics, BM25 and excerpts.

BM25 as publicly defined for SQLite FTS5: k1 = 1.2, b = 0.75, idf floored at 1e-6, a term's
frequency is the number of page tokens with that prefix, and the corpus is all pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.binding import computed
from quire.functions.skew import attach
from quire.functions.tokens import (
    fold,
    literal_tokens,
    match_expression,
    query_terms,
    tokens,
)

K1, B = 1.2, 0.75
#: Most postings of a file of a stored index, about.
FILE_POSTINGS = 4_000_000
_PAGE = ["document_id", "page_number"]


def tokenize_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, position, token), positions from 0."""
    return pages.select(*_PAGE, F.posexplode(tokens(F.col("markdown"))).alias("position", "token"))


def counted_tokens(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, dl, tokens), the distinct tokens of a page in order, each with its count ``tf``.

    Tokens are counted without a shuffle: those of an Arrow batch become numbers, which are sorted page by page.
    """
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in _PAGE)
    split = pages.select(*_PAGE, tokens(F.col("markdown")).alias("_t"))
    return split.mapInArrow(_counted, f"{kept}, dl int, tokens array<struct<token: string, tf: int>>")


def ranked_words(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of an array in order, and for each entry the place of its word."""
    encoded = flat.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)), place[encoded.indices.to_numpy(zero_copy_only=False)]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_t")
        words, at = ranked_words(pc.list_flatten(lists))
        size = max(1, len(words))
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        found, tf = np.unique(rows * size + at, return_counts=True)
        counted = pa.StructArray.from_arrays([words.take(pa.array(found % size)), pa.array(tf.astype(np.int32))], ["token", "tf"])
        ends = np.searchsorted(found // size, np.arange(len(lists) + 1)).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), counted, mask=lists.is_null())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PAGE), pc.list_value_length(lists).cast(pa.int32()), held], [*_PAGE, "dl", "tokens"])


def inverted_index(pages: DataFrame) -> DataFrame:
    """(token, document_id, page_number, tf, dl). The postings come out of the scan without any shuffle."""
    counted = counted_tokens(pages)
    return counted.select(*_PAGE, "dl", F.explode("tokens").alias("_c")).select("_c.token", *_PAGE, "_c.tf", "dl")


def write_index(pages: DataFrame, path: str, files: int = 64) -> None:
    """Store postings and page lengths of a corpus.

    Pages are tokenised once, into a table of their counted tokens. Postings are laid out by ranges of (token,
    document), so a prefix filter touches few files and row groups, and a token found on a third of all pages
    fills several files. There are ``files`` of them, and more where they would hold over ``FILE_POSTINGS`` each.
    """
    counted_tokens(pages).write.mode("overwrite").parquet(f"{path}/counted")
    counted = pages.sparkSession.read.parquet(f"{path}/counted")
    postings = counted.agg(F.sum(F.size("tokens"))).first()[0] or 0
    each = counted.select(*_PAGE, "dl", F.explode("tokens").alias("_c")).select("_c.token", *_PAGE, "_c.tf", "dl")
    (
        each.repartitionByRange(max(files, -(-postings // FILE_POSTINGS)), "token", "document_id")
        .sortWithinPartitions("token", "document_id")
        .write.mode("overwrite").parquet(f"{path}/postings")
    )
    counted.select(*_PAGE, "dl").write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and the one-row corpus size of a stored index."""
    size = spark.read.parquet(f"{path}/lengths").agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg("dl").alias("avg_length")
    )
    return spark.read.parquet(f"{path}/postings"), size


def search_terms(query: str) -> list[str]:
    """Folded prefix terms of a literal query by the rule that page text is folded with; repeats are kept."""
    return literal_tokens(query)


def idf(n_pages: Column, frequency: Column) -> Column:
    raw = F.log((n_pages - frequency + 0.5) / (frequency + 0.5))
    return F.greatest(raw, F.lit(1e-6))


def gain(tf: Column, dl: Column, avg_length: Column) -> Column:
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avg_length))


def _rank(per_page: DataFrame, terms: list[str], distinct: list[str], corpus: DataFrame) -> DataFrame:
    """BM25 over rows (document_id, page_number, _dl, _tf0, _tf1, ...), all terms required.

    ``corpus`` is one row with struct ``s`` of n_pages, avg_length and the page counts n0, n1, ...
    """
    count = range(len(distinct))
    found = per_page.where(reduce(lambda a, b: a & b, [F.col(f"_tf{i}") > 0 for i in count])).withColumn(
        "_s", corpus.scalar()
    )
    score = reduce(
        lambda a, b: a + b,
        [
            F.lit(float(terms.count(t)))
            * idf(F.col("_s.n_pages"), F.col(f"_s.n{i}"))
            * gain(F.col(f"_tf{i}"), F.col("_dl"), F.col("_s.avg_length"))
            for i, t in enumerate(distinct)
        ],
    )
    return found.select(*_PAGE, score.alias("score"))


def search_text(pages: DataFrame, query: str) -> DataFrame:
    """One query over page text without an index: two scans, no shuffle but a one-row aggregate."""
    terms = search_terms(query)
    distinct = list(dict.fromkeys(terms))
    if not terms:
        return pages.select(*_PAGE, F.lit(0.0).alias("score")).limit(0)
    split = computed(pages.select(*_PAGE, "markdown"), "_t", tokens(F.col("markdown")))
    per_page = split.select(
        *_PAGE,
        F.size("_t").alias("_dl"),
        *[F.size(F.filter("_t", _begins(t))).alias(f"_tf{i}") for i, t in enumerate(distinct)],
    )
    corpus = per_page.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_pages"),
            F.avg("_dl").alias("avg_length"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(distinct))],
        ).alias("s")
    )
    return _rank(per_page, terms, distinct, corpus)


def _begins(term: str) -> Callable[[Column], Column]:
    return lambda token: token.startswith(term)


def search_pages(postings: DataFrame, size: DataFrame, query: str) -> DataFrame:
    """Pages holding every prefix term of one query, with their BM25 ``score``.

    ``size`` is the one-row corpus size. The terms reach the postings as prefix filters; pages
    are then combined by (document, page), and the per-term page counts come from the same
    aggregate through a scalar subquery.
    """
    terms = search_terms(query)
    if not terms:
        return postings.select(*_PAGE, F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(terms))
    matching = postings.where(
        reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in distinct])
    )
    per_page = matching.groupBy(*_PAGE).agg(
        F.max("dl").alias("_dl"),
        *[
            F.sum(F.when(F.col("token").startswith(t), F.col("tf")).otherwise(0)).alias(f"_tf{i}")
            for i, t in enumerate(distinct)
        ],
    )
    whole = size.select(F.struct("n_pages", "avg_length").alias("w"))
    corpus = (
        per_page.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(distinct))])
        .withColumn("_w", whole.scalar())
        .select(
            F.struct(
                F.col("_w.n_pages").alias("n_pages"),
                F.col("_w.avg_length").alias("avg_length"),
                *[f"n{i}" for i in range(len(distinct))],
            ).alias("s")
        )
    )
    return _rank(per_page, terms, distinct, corpus)


def build_search_query(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds the quoted prefix expression; null where the query yields nothing."""
    return queries.withColumn("match_expression", match_expression(F.col(text)))


def search_many(
    postings: DataFrame, size: DataFrame, queries: DataFrame, k: int = 30,
    key: str = "query_id", text: str = "query",
) -> DataFrame:
    """Top k pages for each row of a query table.

    Prefix matching runs on the distinct vocabulary: each token is exploded into its prefixes and
    equi-joined with the distinct terms, so no side is broadcast by hand and none is looped over.
    A query with repeated terms counts them as often as they occur.
    """
    wanted = (
        queries.select(key, F.explode(query_terms(F.col(text))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    needed = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("n_terms"))
    terms = wanted.select("term").distinct()
    lengths = terms.agg(F.collect_set(F.char_length("term")).alias("l"))
    vocabulary = postings.select("token").distinct().withColumn("_lens", lengths.scalar())
    fitting = F.filter("_lens", lambda n: n <= F.char_length("token"))
    prefixes = vocabulary.select("token", F.explode(fitting).alias("_len")).select(
        "token", F.substr("token", F.lit(1), F.col("_len")).alias("term")
    )
    matched = attach(prefixes, terms, ["term"], "inner")
    term_pages = (
        postings.join(matched, "token")
        .groupBy("term", *_PAGE)
        .agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    )
    # Naming both columns keeps this branch identical to the scoring one, so its shuffle is reused.
    counted = (F.col("tf") > 0) & (F.col("dl") > 0)
    frequency = term_pages.groupBy("term").agg(F.count_if(counted).alias("n_term"))
    corpus = size.select(F.struct("n_pages", "avg_length").alias("s"))
    weighted = (
        wanted.join(frequency, "term")
        .withColumn("_s", corpus.scalar())
        .select(
            key, "term", F.col("_s.avg_length").alias("avg_length"),
            (F.col("weight") * idf(F.col("_s.n_pages"), F.col("n_term"))).alias("term_weight"),
        )
    )
    scored = (
        attach(term_pages, weighted, ["term"], "inner")
        .groupBy(key, *_PAGE)
        .agg(
            F.sum(F.col("term_weight") * gain(F.col("tf"), F.col("dl"), F.col("avg_length"))).alias("score"),
            F.count(F.lit(1)).alias("n_found"),
        )
    )
    complete = attach(scored, needed, [key], "inner").where(F.col("n_found") == F.col("n_terms")).select(
        key, *_PAGE, F.round("score", 6).alias("score")
    )
    order = Window.partitionBy(key).orderBy(F.desc("score"), *_PAGE)
    return complete.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= max(1, k)
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _marks(patterns: list[str]) -> Callable[[Column], Column]:
    """The patterns that a word matches, a bit each."""
    bits = [(p, F.lit(1 << k).cast("bigint")) for k, p in enumerate(patterns)]
    return lambda word: reduce(lambda a, b: a.bitwiseOR(b), [F.when(word.rlike(p), bit).otherwise(F.lit(0).cast("bigint")) for p, bit in bits])


#: Terms that one number of 64 bits can mark.
_MASK_TERMS = 62


def search_excerpt(pages: DataFrame, query: str, width: int = 24, lead: int = 5) -> DataFrame:
    """Adds ``excerpt``: the ``width`` words that hold the most different terms.

    A window starts ``lead`` words before a match, or at the first word; of windows with equally many terms the
    first is taken. Cut ends show an ellipsis. Pages without a match have a null excerpt. Each word carries the
    terms it matches as bits, so a window is judged by its ``width`` words, and work grows with the matches.
    """
    terms = list(dict.fromkeys(search_terms(query)))
    if not terms:
        return pages.withColumn("excerpt", F.lit(None).cast("string"))
    begins = [rf"(^|[^\p{{L}}\p{{N}}]){re.escape(t)}" for t in terms]
    parts = [begins[at : at + _MASK_TERMS] for at in range(0, len(begins), _MASK_TERMS)]
    out = pages.withColumn("_w", _words(F.col("markdown"))).withColumn("_f", _words(fold(F.col("markdown"))))
    for number, part in enumerate(parts):
        out = computed(out, f"_m{number}", F.transform("_f", _marks(part)))

    def covered(start: Column) -> Column:
        seen = [F.aggregate(F.slice(f"_m{k}", start, width), F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(m)) for k in range(len(parts))]
        return reduce(lambda a, b: a + b, [F.bit_count(x) for x in seen])

    def first(i: Column) -> Column:
        return F.greatest(F.lit(1), i + 1 - lead)

    hits = F.filter(
        F.transform("_m0", lambda m, i: F.when(reduce(lambda a, b: a | b, [F.get(f"_m{k}", i) != 0 for k in range(len(parts))]), i)),
        lambda i: i.isNotNull(),
    )
    placed = computed(out, "_at", F.array_min(F.transform(hits, lambda i: F.struct((-covered(first(i))).alias("n"), i.alias("i")))))
    start = first(F.col("_at.i"))
    excerpt = F.concat(
        F.when(start > 1, "… ").otherwise(""),
        F.array_join(F.slice("_w", start, width), " "),
        F.when(start + width - 1 < F.size("_w"), " …").otherwise(""),
    )
    masks = [f"_m{k}" for k in range(len(parts))]
    return placed.withColumn("excerpt", F.when(F.col("_at").isNotNull(), excerpt)).drop("_w", "_f", "_at", *masks)
