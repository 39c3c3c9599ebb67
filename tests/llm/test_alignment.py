"""Token alignment against sets of bytes, text by text."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import alignment, pieces, tokens
from quire.llm.queries import QUERIES

TEXTS = [
    "Hello wörld, it's 日本語 text.", "", None, "two  blanks", " lead", "trail ", "a\nb\nc d", "tab\there", "▁literal", "<|endoftext|> <s> <0x41>",
    "\x00 nul", "x" * 300, "naïve café 🙂🙂 ok", "same same same", "same same same", "\n", "É. Ñandú ça", "a ", "don't won't",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(tokens.vocabulary_path(), pieces.model_path())


def one(aligner, text):
    """Ids, groups as ends, and links by comparing the byte sets of all tokens."""
    if not text:
        return None
    (a,), (b,) = aligner.ids([text])
    raw = b" " + text.encode()
    spans = []
    for ids, known in ((a, aligner.a.spelled), (b, aligner.b.spelled)):
        if b"".join(known[i] for i in ids) != raw:
            return None
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(known[i])))
            at += len(known[i])
        spans.append(own)
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for end in ends:
        groups.append(tuple([i for i, (s, e) in zip(ids, own, strict=True) if low < e <= end] for ids, own in ((a, spans[0]), (b, spans[1]))))
        low = end
    return a, b, groups, links


def brute(aligner, rows):
    made = [(i, one(aligner, t)) for i, t in rows]
    counts = Counter(p for _, m in made if m for p in {(m[0][i], m[1][j]) for i, j in m[3]})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for doc, m in made:
        if m is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = m
        named = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == top[p[0]] for p in named)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in named), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_links_follow_byte_ranges(aligner):
    for text in filter(None, TEXTS):
        want = one(aligner, text)
        if want is None:
            continue
        a, b, groups, links = want
        ends = [np.cumsum([len(known[i]) for i in ids]) for ids, known in ((a, aligner.a.spelled), (b, aligner.b.spelled))]
        _, *stops = alignment.slices(*ends)
        got = zip(*(x.tolist() for x in alignment.links(*ends, *stops)), strict=True)
        assert sorted(got) == links and len(stops[0]) == len(groups)


def test_tokens_without_bytes():
    a, b = np.array([2, 2, 5]), np.array([1, 2, 5, 5])
    _, *stops = alignment.slices(a, b)
    assert [x.tolist() for x in stops] == [[2, 3], [2, 4]]
    assert list(zip(*(x.tolist() for x in alignment.links(a, b, *stops)), strict=True)) == [(0, 0), (0, 1), (2, 2)]


def test_digests_equal_brute_force(spark, aligner, monkeypatch):
    rows = [(None if i == 4 else i, t) for i, t in enumerate(TEXTS)] + [(3, "two  blanks")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, chunk int, code int").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    assert sorted((tuple(r) for r in alignment.alignment_digests(docs).collect()), key=str) == brute(aligner, rows)


def test_query_equals_brute_force_on_whole_texts(spark, aligner, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows]
    got = sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, root).collect()), key=str)
    made = {i: one_ends(aligner, t) for i, t in rows}
    counts = Counter(p for m in made.values() if m for p in set(m[2]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    want = []
    for i, m in made.items():
        if m is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            want.append((i, *m[0], len(m[2]), sum(counts[p] == top[p[0]] for p in m[2]), sum(counts[p] for p in m[2]), m[1]))
    assert got == sorted(want, key=str)


def one_ends(aligner, text):
    """The whole text at once: sizes, hash of the groups and linked id pairs, by walking over bytes."""
    if not text:
        return None
    (a,), (b,) = aligner.ids([text])
    owner = [[k for k, i in enumerate(ids) for _ in known[i]] for ids, known in ((a, aligner.a.spelled), (b, aligner.b.spelled))]
    if any(b"".join(known[i] for i in ids) != b" " + text.encode() for ids, known in ((a, aligner.a.spelled), (b, aligner.b.spelled))):
        return None
    links = list(dict.fromkeys(zip(*owner, strict=True)))
    groups, x, y = [], [], []
    for k, (i, j) in enumerate(zip(*owner, strict=True)):
        last = k + 1 == len(owner[0])
        a_ends, b_ends = last or owner[0][k + 1] != i, last or owner[1][k + 1] != j
        if a_ends:
            x.append(str(a[i]))
        if b_ends:
            y.append(str(b[j]))
        if a_ends and b_ends:
            groups.append(",".join(x) + "|" + ",".join(y))
            x, y = [], []
    return (len(a), len(b), len(groups)), hashlib.sha256(";".join(groups).encode()).hexdigest(), [(a[i], b[j]) for i, j in links]


def test_whole_alignment(spark, aligner):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in alignment.align_documents(docs).collect():
        want = one(aligner, TEXTS[row.doc_id])
        if want is None:
            assert not row.a_ids and not row.b_ids and not row.groups and not row.links
        else:
            a, b, groups, links = want
            assert (row.a_ids, row.b_ids, len(row.groups)) == (a, b, len(groups))
            assert sorted(map(tuple, row.links)) == links


def test_no_documents(spark):
    assert alignment.alignment_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
