"""The segmented index against text search, and against a rebuild after random updates."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions.tokens import tokens
from quire.operators import search, segments

SCHEMA = "document_id int, page_number int, markdown string"
WORDS = ["alpha", "alphabet", "alp", "beta", "betamax", "gamma", "Été", "x" * 40, "x" * 39 + "y", "delta", "d1"]


def pages_of(rng, n):
    return [(d, p, " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))) for d in range(n) for p in (1, 2)]


def best(spark, pages, query, k, ties=False):
    hits = [(round(r.score, 6), r.document_id, r.page_number) for r in search.search_text(pages, query).collect()]
    hits.sort(key=lambda h: (-h[0], h[1], h[2]))
    if ties and len(hits) > k:
        return [h for h in hits if h[0] >= hits[k - 1][0]]
    return hits[:k]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_PAGES", 5)
    monkeypatch.setattr(segments, "FIRST_BUCKETS", 1)
    monkeypatch.setattr(segments, "SMALLEST", 2)


QUERIES = ["alpha beta", "be be ete", "zzz", "", "alph", "x" * 30, "x" * 40 + " gam", "gamma alpha beta delta d", "e", "Été alp"]


def test_top_pages_equal_text_search(spark, tmp_path, small):
    pages = spark.createDataFrame(pages_of(random.Random(8), 60), SCHEMA)
    index = segments.build_index(pages, str(tmp_path / "i"))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = segments.search_index(index, asked, 4).collect()
    for number, query in enumerate(QUERIES):
        own = sorted((r.rank, r.score, r.document_id, r.page_number) for r in got if r.query_id == number)
        assert [r[1:] for r in own] == best(spark, pages, query, 4), query
        assert [r[0] for r in own] == list(range(1, len(own) + 1))
    for query in ("gamma", "alpha beta", "", "zzz"):
        tied = segments.search_stored(index, query, 3)
        assert sorted((-r.score, r.document_id, r.page_number) for r in tied.collect()) == [(-s, d, p) for s, d, p in best(spark, pages, query, 3, ties=True)]


def test_search_within_documents(spark, tmp_path, small):
    pages = spark.createDataFrame(pages_of(random.Random(3), 40), SCHEMA)
    index = segments.build_index(pages, str(tmp_path / "i"))
    own = spark.createDataFrame([(d,) for d in (3, 5, 8, 21)], "document_id int")
    got = segments.search_stored(index, "alpha", 2, own).collect()
    hits = [h for h in best(spark, pages, "alpha", 1000) if h[1] in (3, 5, 8, 21)]
    assert sorted((r.score, r.document_id) for r in got) == sorted((s, d) for s, d, _ in hits if s >= hits[1][0])


def test_few_buckets_are_opened(spark, tmp_path, monkeypatch):
    """Pages of the common term are not opened where the rare one is missing or the bound is too low."""
    monkeypatch.setattr(segments, "BUCKET_PAGES", 10)
    monkeypatch.setattr(segments, "FIRST_BUCKETS", 2)
    rows = [(d, 1, "common " + ("rare " * (1 + d % 7) if d % 50 == 0 else "") + "filler " * (d % 9)) for d in range(1000)]
    index = segments.build_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    opened = []
    score = segments._score
    monkeypatch.setattr(segments, "_score", lambda average: opened.append(1) or score(average))
    found = segments.search_stored(index, "common rare", 2)
    assert found.count() >= 2 and len(opened) == 2
    heads = index.part("postings")
    assert heads.where("token = 'common'").count() > 3 * heads.where("token = 'rare'").count()


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_updates_equal_a_rebuild(spark, tmp_path, small):
    rng = random.Random(5)
    path, state = str(tmp_path / "i"), {}
    merged = 0
    for batch in range(20):
        changed = {}
        for _ in range(rng.randint(1, 8)):
            page = (rng.randint(0, 25), rng.randint(1, 2))
            changed[page] = None if rng.random() < 0.25 else " ".join(rng.choices(WORDS, k=rng.randint(0, 8)))
        state.update(changed)
        before, known = files(path), {s.number for s in segments.Index(spark, path).segments}
        changes = spark.createDataFrame([(*p, t) for p, t in changed.items()], SCHEMA)
        index = segments.update_index(spark, path, changes, batch)
        kept = known & {s.number for s in index.segments}
        merged += len(known) - len(kept)
        after = files(path)
        for number in kept:
            assert all(after[f] == t for f, t in before.items() if f"segment={number}/" in f)
        again = segments.update_index(spark, path, changes, batch)  # a replay changes nothing
        assert again.version == index.version
    assert merged > 5 and len(index.segments) < 10
    live = spark.createDataFrame([(*p, t) for p, t in state.items() if t is not None], SCHEMA)
    columns = ["token", "document_id", "page_number", "tf", "dl"]
    assert sorted(map(tuple, index.postings().select(columns).collect())) == sorted(map(tuple, search.inverted_index(live).select(columns).collect()))
    assert index.size()[0] == live.count()
    prefixes = index.part("prefixes").groupBy("prefix").sum("n").where("`sum(n)` <> 0")
    rebuilt = segments.build_index(live, str(tmp_path / "j"))
    assert sorted(map(tuple, prefixes.collect())) == sorted((r.prefix, r.n) for r in rebuilt.part("prefixes").collect())
    for query in ("alpha beta", "x" * 30, "gamma", "e"):
        for one in (index, rebuilt):
            got = sorted((-r.score, r.document_id, r.page_number) for r in segments.search_stored(one, query, 3).collect())
            assert got == [(-s, d, p) for s, d, p in best(spark, live, query, 3, ties=True)], query


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    assert segments.Index(spark, path).segments == []
    index = segments.update_index(spark, path, spark.createDataFrame([], SCHEMA), 0)
    assert index.size() == (0, 0.0) and segments.search_stored(index, "a").count() == 0
    index = segments.update_index(spark, path, spark.createDataFrame([(1, 1, "a b")], SCHEMA), 1)
    assert segments.search_stored(index, "a").count() == 1
    index = segments.update_index(spark, path, spark.createDataFrame([(1, 1, None)], SCHEMA), 2)
    assert index.size() == (0, 0.0) and index.postings().count() == 0


def test_dictionary_and_buckets_by_brute_force(spark, tmp_path, monkeypatch):
    """Each prefix counts its pages, whatever the batches and alphabets; a bucket holds BUCKET_PAGES pages at most."""
    monkeypatch.setattr(segments, "BUCKET_PAGES", 7)
    rng = random.Random(4)
    stems = ["a", "ab", "abc", "Été", "éte", "straße", "x" * 24, "x" * 25, "x" * 24 + "y", "日本", "日本語", "𝒳𝒴", "7", "ab7"]
    rows = [(d, 1, " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ß"]) for _ in range(rng.randrange(0, 12)))) for d in range(80)]
    pages = spark.createDataFrame(rows, SCHEMA)
    index = segments.build_index(pages, str(tmp_path / "i"))
    words = {r.document_id: r.t for r in pages.select("document_id", tokens(F.col("markdown")).alias("t")).collect()}
    want = Counter(p for t in words.values() for p in {w[:n] for w in t for n in range(1, min(len(w), segments.PREFIX_LENGTH) + 1)})
    assert {r.prefix: r.n for r in index.part("prefixes").collect()} == want
    assert {r.document_id: (r.dl, [(c.token, c.tf) for c in r.tokens]) for r in index.live().collect()} == {
        d: (len(t), sorted(Counter(t).items(), key=lambda c: c[0].encode())) for d, t in words.items()
    }
    held = index.part("postings").select("bucket", F.explode("pages").alias("p")).groupBy("bucket").agg(F.count_distinct("p").alias("n"))
    assert max(r.n for r in held.collect()) <= 7
    own = index.part("postings").select("token", "bucket", "max_tf", "min_dl", "n", F.explode("pages.document_id").alias("d")).collect()
    assert sorted((r.token, r.d) for r in own) == sorted((w, d) for d, t in words.items() for w in set(t))
    blocks = {}
    for r in own:
        blocks.setdefault((r.token, r.bucket), (r.max_tf, r.min_dl, r.n, []))[3].append(r.d)
    for (token, _), (tf, dl, n, docs) in blocks.items():
        assert (tf, dl, n) == (max(words[d].count(token) for d in docs), min(len(words[d]) for d in docs), len(docs))


def test_pages_are_cut_to_the_terms_before_the_shuffle(spark, tmp_path):
    """Of a page only the tokens that a known term begins are shuffled, of a page without all terms nothing."""
    rows = [(1, 1, "the nation other"), (2, 1, "the other"), (3, 1, "theme tion tion x"), (4, 1, None)]
    index = segments.build_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    cut = segments._holding(index.live(), ["the", "tion"]).collect()
    assert [(r.document_id, r.dl, [tuple(t) for t in r.tokens]) for r in cut] == [(3, 4, [("theme", 1), ("tion", 2)])]
    assert segments._holding(index.live(), None).count() == 3
    assert [r.document_id for r in segments.search_stored(index, "the tion").collect()] == [3]
