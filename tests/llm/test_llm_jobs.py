"""The operators as Spark jobs: brute force on small tables, and tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import components, extract, grammar, language, neighbors, ngram_join, packing, pieces, quality, spans, suffixes, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "This passage stands in several texts, word for word. It has a second sentence of some length too. And a third."
#: Columns of names that the operators use themselves.
CLASH = "_key int, _id int, rep_id int, label string, n int, set_key int, span int, ranges int, runs int, unit int, start int, part int, vector int, kept int"


@pytest.fixture(scope="module")
def docs(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [
        (1, "Alpha beta gamma delta " * 8 + PASSAGE), (2, None), (3, ""), (4, " \n\t "), (5, PASSAGE + " Own words end it here."),
        (6, "One. " + PASSAGE), (6, "One. " + PASSAGE), (None, PASSAGE), (None, None), (7, long), (8, long), (9, "é" * 70), (10, "x" + "é" * 70),
        (11, "日本語。テスト。" * 20), (12, "!!! ... 123"), (13, "one"), (14, "One"), (15, "a\x00b " * 30),
    ]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None) + (None,) * 14 for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def brute_groups(texts, n, percent):
    """Set sizes and smallest reachable ids of ``{id: text}``."""
    sets = {}
    for i, text in texts.items():
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def brute_cut(texts, length=50):
    """Bytes, removed bytes, removed runs and hash of the rest of ``{id: text}``."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, own in data.items():
        gone = np.zeros(len(own) + 1, bool)
        for k in range(len(own) - length + 1):
            if first[own[k : k + length]] < i:
                gone[k : k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(own), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(own, np.uint8)[~gone[:-1]])).hexdigest())
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (None, 5), (200, 201), (201, 200)] + [(300, k) for k in range(301, 340)]
    got = components.components(spark.createDataFrame(links, "x long, y long"), "x", "y")
    got = {r.node: r.component for r in got.collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 200: 200, 201: 200} | {k: 300 for k in range(300, 340)}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, n, percent):
    assert by_id(ngram_join.join_groups(docs, n, percent), "n_shingles", "component_id") == brute_groups(texts_of(docs), n, percent)


def test_ngram_join_in_blocks_of_a_large_group(spark):
    base = [f"word{i}" for i in range(60)]
    texts = {i: " ".join(w for k, w in enumerate(base) if (k * 7 + i) % 60 > i % 4) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert by_id(ngram_join.join_groups(df, 1, 90, trie_tokens=300), "n_shingles", "component_id") == brute_groups(texts, 1, 90)


def test_ngram_join_links_grow_with_the_sets_of_a_group(spark, monkeypatch):
    """Near copies share nearly all of their marks; each brings a few links, not one for every mark or task."""
    base = [f"word{i}" for i in range(150)]
    texts = {i: " ".join("own" if k == 2 * i else w for k, w in enumerate(base)) for i in range(60)}
    counts, made = [], ngram_join.components

    def counted(links, a, b):
        counts.append(links.count())
        return made(links, a, b)

    monkeypatch.setattr(ngram_join, "components", counted)
    df = spark.createDataFrame([*texts.items(), *((1000 + i, texts[7]) for i in range(60))], "doc_id long, text string")
    found = by_id(ngram_join.join_groups(df, 5, 80), "n_shingles", "component_id")
    assert {i: x for i, x in found.items() if i < 1000} == brute_groups(texts, 5, 80)
    assert found[1059] == (146, 0) and counts[0] <= 4 * len(texts)


def test_ngram_join_of_odd_rows(odd):
    got = ngram_join.join_groups(odd, 3, 90)
    assert got.count() == odd.count()
    want = brute_groups({i: t for i, t in texts_of(odd).items() if i not in (7, 8)}, 3, 90)
    found = by_id(got.where("doc_id IS NOT NULL"), "n_shingles", "component_id")
    assert {i: x for i, x in found.items() if i not in (7, 8)} == want
    assert found[8] == (59_998, 7) and found[14] == (1, 13)


def test_suffix_dedup(docs):
    got = by_id(suffixes.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_cut(texts_of(docs))
    assert by_id(suffixes.dedup_bytes(docs, build_bytes=300), "n_bytes", "n_removed", "n_spans", "kept_sha256") == got


def test_suffix_dedup_of_odd_rows(odd):
    got = suffixes.dedup_bytes(odd)
    assert got.count() == odd.count()
    want = brute_cut({i: t for i, t in texts_of(odd).items() if i not in (7, 8)})
    found = by_id(got.where("doc_id IS NOT NULL"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {i: x for i, x in found.items() if i not in (7, 8)} == want
    assert found[8][:3] == (found[7][0], found[7][0], 1) and found[7][1] == 0
    assert got.where("doc_id IS NULL AND n_removed > 0").count() == 0
    cut = suffixes.cut_documents(odd)
    assert cut.columns == odd.columns and cut.where("doc_id = 8").first().text == ""


def test_sentence_spans(docs, odd):
    seen, gone, found = {}, {}, {i: spans.sentences(t) for i, t in sorted(texts_of(docs).items())}
    for i, own in found.items():
        words = [tuple(s.split()) for s in own]
        for k in range(len(own) - 1):
            if len(words[k]) + len(words[k + 1]) >= spans.SPAN_WORDS and seen.setdefault((words[k], words[k + 1]), (i, k)) != (i, k):
                gone.setdefault(i, set()).update((k, k + 1))
    want = {i: ("".join(s for k, s in enumerate(own) if k not in gone.get(i, ())), len(own), len(gone.get(i, ()))) for i, own in found.items()}
    assert by_id(spans.dedup_spans(docs), "text", "n_sentences", "n_removed") == want
    got = spans.dedup_spans(odd)
    assert got.count() == odd.count()
    kept = by_id(got.where("doc_id IS NOT NULL"), "text", "n_removed")
    assert kept[1][1] == 0 and kept[5] == ("This passage stands in several texts, word for word. Own words end it here.", 2) and kept[2] == ("", 0) and kept[8] == kept[7]  # one sentence alone has no span


def test_sentence_spans_of_short_sentences_and_scripts_without_blanks(spark):
    lines = "milk and bread\nfive red apples\ntea\nsalt\ngreen soap and oil\na box of nails\nrope\n"
    han = "今天天气很好。我们一起去公园散步。孩子们在草地上玩耍。大家都非常高兴。"
    thai = "วันนี้อากาศดีมาก\nเราไปเดินเล่นที่สวน\nเด็กเล่นบนสนามหญ้า\n"
    clauses = "我们从北方的城市出发，" + "".join(f"经过第{k}座山和第{k}条河，" for k in "一二三四五六七八") + "最后到达南方的海边"
    texts = {}
    for k, passage in enumerate((lines, han, thai, clauses)):
        texts |= {2 * k: f"First own line {k}.\n{passage}", 2 * k + 1: f"Other own line {k}!\n{passage}"}
    words = [f"w{k}" for k in range(300)]
    texts[10], texts[11] = (f"Own line {k} of this text.\n{' '.join(words)}" for k in "ab")
    texts |= {8: "tea\nsalt\n", 9: "tea\nsalt\n"}  # under twelve words in all
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    digests = by_id(spans.span_digests(df), "kept_sha256")
    want = {i: t if i % 2 == 0 or i == 9 else f"Other own line {i // 2}!\n" for i, t in texts.items()} | {11: "Own line b of this text.\n"}
    assert digests == {i: (hashlib.sha256(t.encode()).hexdigest(),) for i, t in want.items()}


def test_packing(docs, odd):
    for df in (docs, odd):
        rows = packing.pack_documents(df).toPandas()
        encoder = tokens.Encoder(tokens.vocabulary_path()).tokenizer
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            for piece, (start, size) in enumerate(packing.cut(len(ids), 2048)):
                want[(r.doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()))] += 1
        got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
        assert got == want
        rows = rows.sort_values(["sequence_id", "offset"])
        assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
        assert rows.groupby("sequence_id").length.sum().max() <= 2048
        assert rows.sequence_id.nunique() <= 1.05 * rows.length.sum() / 2048 + 1


def test_token_files(docs, odd):
    for df in (docs, odd):
        got = grammar.token_files(df).orderBy("start").collect()
        encoder = tokens.Encoder(tokens.vocabulary_path()).tokenizer
        start, want = 0, []
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == want


def test_pieces(docs, odd):
    for df in (docs, odd):
        texts = sorted((r.doc_id or -1, r.text or "") for r in df.select("doc_id", "text").collect())
        back = pieces.decode(pieces.encode(df))
        assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == texts
        digests = sorted((r.doc_id or -1, r.text_sha256) for r in pieces.piece_digests(df).collect())
        assert digests == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)


def test_language(docs, odd):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    found = language.identify(odd)
    assert found.count() == odd.count()
    assert {r.lang_pred for r in found.where("doc_id IN (2, 3, 4, 12)").collect()} == {"und"}
    rows = language.accepted(odd)
    assert rows.columns == odd.columns and rows.where("doc_id IN (2, 3, 4, 12)").count() == 0


def brute_mcd(vectors, steps):
    """Center and inverse covariance of the closest part of the rows, from both starts."""
    p, v = len(quality.VECTOR), np.array(vectors)
    flat = lambda rows: quality.estimate(len(rows), rows.sum(axis=0), np.array([(rows[:, i] * rows[:, j]).sum() for i, j in quality._PAIRS]))
    center = np.array([np.sort(v[:, i])[-(-len(v) // 2) - 1] for i in range(p)])
    mad = np.array([np.sort(np.abs(v[:, i] - center[i]))[-(-len(v) // 2) - 1] for i in range(p)])
    best = []
    for start in (flat(v), (center, np.diag(1 / ((1.4826 * mad) ** 2 + np.square(quality.FLOOR))), 0.0)):
        for _ in range(steps):
            d = v - start[0]
            step = np.floor(np.log2(1 + np.maximum(0, np.einsum("ni,ij,nj->n", d, start[1], d))) * quality.GRID)
            bound = np.sort(step)[int(np.ceil(quality.SUPPORT * len(v))) - 1]
            start = flat(v[step <= bound])
        best.append(start)
    return min(best, key=lambda e: e[2])


def test_robust_fit_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = {"a": np.concatenate([r.normal(0, 1, (150, 6)), r.normal(6, 0.2, (30, 6))]), "b": r.normal(2, 0.5, (90, 6))}
    df = spark.createDataFrame([(u, [float(x) for x in v]) for u, own in rows.items() for v in own], "unit string, vector array<double>")
    got = {x.unit: x for x in quality.fit(df).collect()}
    for unit, own in rows.items():
        center, inverse, _ = brute_mcd(own, quality.STEPS)
        assert np.allclose(got[unit].center, center) and np.allclose(got[unit].inverse, inverse.ravel())
    assert np.abs(got["a"].center).max() < 0.4  # the far part has no say


def test_quality_rules(docs, odd):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, text in texts_of(docs).items():
        words = WORDS.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = Counter(windows)
        lines, seen = 0, set()
        for line in text.split("\n"):
            if WORDS.search(line):
                lines += line in seen
                seen.add(line)
        repeats = len({k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(5)})
        want = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), lines, repeats)
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        assert got[i].base_failed == (len(words) < 10 or 100 * repeats > 20 * len(words))
        assert not (got[i].kept and got[i].base_failed)
    found = quality.quality_rules(odd)
    assert found.count() == odd.count() and found.where("doc_id IN (2, 3, 4) AND kept").count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 12))
    x = np.concatenate([base, base[:20] + 0.05 * r.normal(size=(20, 12)), base[:5] * 3.0, base[:3], base[:1], base[:1]])
    rows = [(100 + i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1, None), (2, []), (3, [0.0] * 12), (4, [float("nan")] * 12), (5, [1.0, None] * 6), (6, [float("inf")] * 12), (7, [1.0, 2.0]), (8, [-1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rep_id", F.lit(0)).withColumn("shard", F.lit("x"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= neighbors.THRESHOLD - 1e-12
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[row].min() for row in link])
    out, audit = neighbors.near_vectors(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    want = {100 + i: (int(link[i].sum()) - 1, 100 + int(label[i]), bool(label[i] == i)) for i in range(len(x))}
    assert got == want | {i: (0, i, True) for i in range(1, 9)}
    assert audit.agg(F.min("recall")).first()[0] >= neighbors.AUDIT_RECALL


def test_extract_pages(spark):
    rows = [(1, "u", "<p>Text here, and more.</p>"), (None, None, None), (2, None, ""), (1, "u", "<p>Text here, and more.</p>"), (3, "v", "<p>" + "long text, " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in extract.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", 20, 20), (1, "u", 20, 20), (0, None, 0, 0), (2, None, 0, 0), (3, "v", 549_999, 549_999)], key=str)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    for df in (
        quality.quality_rules(none), suffixes.dedup_bytes(none), ngram_join.join_groups(none), spans.dedup_spans(none), language.identify(none),
        grammar.token_files(none), packing.pack_documents(none), pieces.piece_digests(none), suffixes.cut_documents(none),
        extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
        neighbors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0],
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, root):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    kept, stages = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, kept, root).toPandas()
        assert list(rows.columns) == docs.columns
        kept = spark.createDataFrame(rows, docs.schema)
        stages.append(rows)
    rules, languages, joined, cut = stages
    verdict = by_id(quality.quality_rules(docs), "kept")
    assert set(rules.doc_id) == {i for i, (k,) in verdict.items() if k}
    assert set(languages.doc_id) <= set(rules.doc_id)
    groups = brute_groups(dict(zip(languages.doc_id, languages.text, strict=True)), 5, 80)
    assert set(joined.doc_id) == {i for i, (_, least) in groups.items() if i == least}
    want = brute_cut(dict(zip(joined.doc_id, joined.text, strict=True)))
    for row in cut.itertuples():
        assert len(row.text) == row.n_chars and want[row.doc_id][0] - want[row.doc_id][1] - len(row.text.encode()) in range(0, 3 * want[row.doc_id][2] * 2 + 1)
    pieces_of = corpus_pipeline.STAGES[-1][1](spark, kept, root)
    assert pieces_of.select("doc_id").distinct().count() == len(cut)
