"""The queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import alignment, extract, grammar, language, mixing, negatives, neighbors, ngram_join, packing, pieces, quality, spans, suffixes
from quire.llm.shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_best_fit_packing")
def _(spark, root):
    return packing.pack_documents(read(spark, root, "documents"))


@query("op8_token_files")
def _(spark, root):
    return grammar.token_files(read(spark, root, "documents"))


@query("op1_quality_rules")
def _(spark, root):
    return quality.quality_rules(read(spark, root, "documents"))


@query("op7_language_id")
def _(spark, root):
    return language.identify(read(spark, root, "documents"))


@query("op4_html_extraction")
def _(spark, root):
    return extract.extract_pages(read(spark, root, "pages"))


@query("op10_sentencepiece")
def _(spark, root):
    return pieces.piece_digests(read(spark, root, "documents"))


@query("op5_near_vectors")
def _(spark, root):
    return neighbors.near_vectors(read(spark, root, "embeddings"))[0]


@query("op6_sentence_spans")
def _(spark, root):
    return spans.span_digests(read(spark, root, "documents"))


@query("op3_ngram_jaccard_join")
def _(spark, root):
    return ngram_join.join_groups(read(spark, root, "documents"), n=3, percent=90)


@query("op2_suffix_array_dedup")
def _(spark, root):
    return suffixes.dedup_bytes(read(spark, root, "documents")).drop("kept")


@query("op12_bond_negatives", """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
           list_inner_product(a.q, b.q)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score FROM scores
    WHERE anchor_label = other_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.other_label <> p.anchor_label
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
""")
def _(spark, root):
    return negatives.hard_negatives(read(spark, root, "embeddings"))


@query("op11_token_alignment")
def _(spark, root):
    return alignment.alignment_digests(read(spark, root, "documents"))


@query("op13_context_mixing")
def _(spark, root):
    return mixing.score_documents(read(spark, root, "documents"), before=True)
