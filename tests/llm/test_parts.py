"""The parts of the operators that run inside tasks, against plain brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import extract, grammar, language, neighbors, ngram_join, packing, pieces, quality, spans, suffixes, tokens

ODD = ["", " ", "\n", "a", "a  b", " a", "a ", "a\n\nb", "a\n b\t c", "don't 'll 12ab", "<|endoftext|>", "é日本　x y", "▁ x", "The the. The, the!?\nthe\nx", "\x00\x1f"]


def odd_texts(n, seed=3):
    pick = random.Random(seed)
    parts = ["a", "Foo", " ", "\n", "é", "the", "  ", "\n\n", "\t", "'s", "12", "thing,", "!?", "日本", "　", "▁", " the", "￿"]
    return ODD + ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(n)]


def test_ids_equal_encoding_each_text_by_itself():
    encoder = tokens.Encoder(tokens.vocabulary_path())
    texts = odd_texts(1500)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for got, want, text in zip(tokens.split(ids, counts), whole, texts, strict=True):
        assert got.tolist() == [*want.ids, tokens.END_ID], text


def test_pieces_of_a_document():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_takes_the_tightest_open_bin():
    pick, made = random.Random(1), iter(range(10**6))
    bins = packing.OpenBins(50, 5, lambda: next(made))
    for _ in range(3000):
        size = pick.randrange(1, 51)
        before = {b: free for free, own in enumerate(bins.by_free) for b in own}
        used, offset = bins.place(size)
        after = {b: free for free, own in enumerate(bins.by_free) for b in own}
        fits = [free for free in before.values() if free >= size]
        if fits:
            assert before.pop(used) == min(fits) == 50 - offset
        else:
            assert offset == 0 and used not in before
            if len(before) == 5:  # the fullest closes first
                closed = (before.keys() - after.keys()).pop()
                assert before[closed] == min(before.values())
                del before[closed]
        assert after == before | ({used: 50 - offset - size} if 50 - offset - size else {})
        assert bins.count == len(after) <= 5


@pytest.mark.parametrize("size", [1, 2, 500, 20_000])
def test_grammar_round_trip_and_random_access(size):
    random_ids = np.random.default_rng(size)
    ids = random_ids.zipf(1.3, size).clip(max=400)
    ids = np.concatenate([ids, ids, [0], np.zeros(size, np.int64)])
    sizes = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
    shard = grammar.compress(ids, sizes, 50257)
    assert (grammar.decode(shard) == ids).all()
    pick = random.Random(size)
    for _ in range(30):
        a = pick.randrange(len(ids))
        b = pick.randrange(a, len(ids) + 1)
        assert (grammar.decode(shard, a, b) == ids[a:b]).all()
    if size >= 20_000:
        assert len(shard["symbols"]) // 4 < len(ids) // 2


def test_transform_and_common_prefixes():
    pick = random.Random(5)
    for _ in range(150):
        strings = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(14))) for _ in range(pick.randrange(1, 9))]
        lengths = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings) or b"a", np.uint8) + np.uint8(1)
        bwt, lcp = suffixes.transform(data, np.cumsum(lengths) - lengths, lengths)
        string, offset = suffixes.positions(bwt, lengths)
        want = sorted(([1000 + c for c in s[k:]] + [i], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        assert [(i, k) for _, i, k in want] == list(zip(string.tolist(), offset.tolist(), strict=True))
        common = [0]
        for (a, _, _), (b, _, _) in zip(want, want[1:], strict=False):
            m = 0
            while m < min(len(a), len(b)) - 1 and a[m] == b[m]:
                m += 1
            common.append(m)
        assert common == lcp.tolist()
        docs = np.array([pick.randrange(4) for _ in strings])
        got = suffixes.repeated(strings, docs, 3)
        least = {}
        for s, d in zip(strings, docs.tolist(), strict=True):
            for k in range(len(s) - 2):
                least[s[k : k + 3]] = min(least.get(s[k : k + 3], 9), d)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((i, k) for i, s in enumerate(strings) for k in range(len(s) - 2) if docs[i] > least[s[k : k + 3]])


def family(pick, n, size, edits):
    base = [pick.getrandbits(63) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(pick.randrange(edits + 1)):
            own[pick.randrange(size)] = pick.getrandbits(63)
        out.append(np.unique(np.array(own[: pick.randrange(size - edits, size + 1)], np.uint64)))
    return out


@pytest.mark.parametrize("percent", [80, 90])
def test_trie_groups_and_signatures(percent):
    pick = random.Random(percent)
    for size, edits in ((8, 2), (30, 4), (120, 12), (40, 0)):
        sets = family(pick, 25, size, edits) + family(pick, 5, size, edits)
        marks = ngram_join.signatures(sets, percent)
        label = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    assert set(marks[i].tolist()) & set(marks[j].tolist())
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        got = ngram_join.Trie(sets).groups(percent).tolist()
        assert [got.index(g) for g in got] == [label.index(x) for x in label]
        assert all(g == min(k for k, x in enumerate(label) if x == label[i]) for i, g in enumerate(got))


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_do_not_depend_on_the_other_sets_of_a_block(percent):
    pick = random.Random(percent)
    bounds = ngram_join.size_classes(percent, 1300).tolist()
    for bound in bounds[:-2]:  # a set of the class below the bound, and one of the class that starts there
        if 100 * (bound - 2) < percent * bound:
            continue
        large = np.unique(np.array([pick.getrandbits(63) for _ in range(bound)], np.uint64))
        small = large[:-2]
        one, two = (ngram_join.signatures([x], percent)[0].tolist() for x in (small, large))
        assert set(one) & set(two), bound
        assert ngram_join.signatures([small, np.arange(5000, dtype=np.uint64)], percent)[0].tolist() == one


def test_shingles_of_short_texts():
    found = ngram_join.sets(pa.array(["", "a", "A", "a b", "a b c", "x a b c", " \t", "A  b\nc"]), 3)
    assert [len(x) for x in found] == [0, 1, 1, 1, 1, 2, 0, 1]
    assert found[1] == found[2] and found[4] == found[7] and found[3] != found[4]
    assert set(found[4].tolist()) < set(found[5].tolist())


def test_viterbi_equals_all_segmentations_and_decodes():
    coder = pieces.Pieces(pieces.model_path())
    table = {w: coder.automaton.get(w) for w in coder.automaton.keys()}

    def plain(text):
        chunk = " " + text if text else ""
        matched, n = chunk.replace("▁", "￿").replace(" ", "▁"), len(chunk)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            options = [(best[end - k] + table[matched[end - k : end]][1], k, [table[matched[end - k : end]][2]]) for k in range(min(end, 16), 0, -1) if matched[end - k : end] in table]
            spelled = [coder.bytes[b] for b in chunk[end - 1].encode()]
            options.append((best[end - 1] + len(spelled) * coder.byte_score, 1, spelled))
            for score, k, ids in options:
                if score > best[end]:
                    best[end], back[end] = score, (k, ids)
        ids = []
        while n:
            k, own = back[n]
            ids, n = own + ids, n - k
        return ids

    texts = odd_texts(1200)
    for texts in (odd_texts(1200), ["", ""], ["a b"]):
        ids, sizes = coder.encode(pa.array(texts, pa.string()))
        for own, text in zip(tokens.split(ids, sizes), texts, strict=True):
            assert own.tolist() == plain(text), text
            assert coder.decode(own).decode() == text


def test_sentences_join_to_the_text():
    for text in [*odd_texts(400), "One. Two! Three?\nFour, " + "w " * 40 + ", five, six.  "]:
        assert "".join(spans.sentences(text)) == text


def test_cut_sentences_join_to_the_text():
    for text in [*odd_texts(400), " ".join(f"w{k}" for k in range(200)), "日本語の文章" * 40, "a, " * 90 + "b " * 50]:
        assert "".join(spans.sentences(text, whole=True)) == text
    assert len(spans.sentences(" ".join(f"w{k}" for k in range(200)), whole=True)) > 5


def test_counts_of_repeated_words_and_lines():
    pick = random.Random(8)
    texts = [" ".join(pick.choice("abc") for _ in range(pick.randrange(40))) for _ in range(200)]
    codes, rows, _ = quality.split_words(pa.array(texts))
    got = quality._repeated(codes, rows, len(texts)).tolist()
    for text, n in zip(texts, got, strict=True):
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        assert n == len({i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)})
    assert quality._dup_lines("a\nb\na\n\n\n \n \na") == (2, 8)
    assert quality._dup_lines("") == (0, 1)


def test_robust_estimate_ignores_a_far_group():
    p = len(quality.VECTOR)
    rows = np.random.default_rng(2).normal(3.0, 0.4, (500, p))
    products = np.array([(rows[:, i] * rows[:, j]).sum() for i, j in quality._PAIRS])
    center, inverse, size = quality.estimate(len(rows), rows.sum(axis=0), products)
    covariance = quality.CONSISTENCY * np.cov(rows.T, bias=True) + np.diag(np.square(quality.FLOOR))
    assert np.allclose(center, rows.mean(axis=0)) and np.allclose(inverse, np.linalg.inv(covariance))
    assert np.isclose(size, np.linalg.slogdet(covariance)[1])
    assert abs(quality._chi_tail(quality._chi_point(0.05, 3), 3) - 0.05) < 1e-9


def test_language_model_learns_and_is_calibrated():
    pick = random.Random(4)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"], "z": ["eins", "zwei", "drei"]}
    rows = [(" ".join(pick.choice(words[k]) for _ in range(30)), k) for k in words for _ in range(80)]
    pick.shuffle(rows)
    model = language.train([t for t, _ in rows], [k for _, k in rows], epochs=20)
    p = model.probabilities(model.logits(pa.array(["alpha beta alpha", "dos tres uno", "zwei drei", ""])))
    assert [model.languages[k] for k in p.argmax(axis=1)][:3] == ["x", "y", "z"]
    assert np.allclose(p.sum(axis=1), 1) and 0 < model.threshold <= 0.5


def test_graph_recall_in_dense_and_sparse_data():
    r = np.random.default_rng(3)
    center = r.normal(size=(1, 24))
    near = center + 0.12 * r.normal(size=(900, 24))
    x = np.concatenate([r.normal(size=(1500, 24)), near])
    x = np.concatenate([x, x[:200] + 0.05 * r.normal(size=(200, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[r.permutation(len(x))]
    shard = neighbors.Shard.built(x)
    beam, recall = shard.audited_beam()
    q, node = shard.links(x, beam)
    found = np.zeros((len(x), len(x)), bool)
    found[q, node] = True
    truth = x @ x.T >= neighbors.THRESHOLD
    assert recall >= neighbors.AUDIT_RECALL and (found & truth).sum() / truth.sum() > 0.97


def test_audit_counts_no_row_as_its_own_link_and_ends_in_brute_force():
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 24))
    x[399] = x[0] + 0.01 * r.normal(size=24)  # the only link among the rows
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    shard = neighbors.Shard.built(x)
    for graph in shard.layers:
        graph[graph == 399] = len(x)  # no way leads there
        graph[399] = len(x)
    beam, recall = shard.audited_beam()
    assert (beam, recall) == (0, 1.0)
    assert shard.audited_beam(foreign=x[:1]) == (beam, recall)
    q, node = shard.links(x[[0, 399]], beam)
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == {(0, 0), (0, 399), (1, 0), (1, 399)}


PAGES = {
    "": "",
    "plain text": "plain text",
    "<p>a &amp; b&nbsp;c<br>d</p>": "a & b c d",
    "<script>if(a<b){}</script x><p>a <b>c": "a c",
    "<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>Text, more.<table><tr><td>a<td>b</table>"
    "</article><aside>side</aside></main><div class='cookie-notice'>We use cookies.</div><footer>x</footer>": "Title\nText, more.\na\nb",
    "<div class=content><p>A long paragraph, with commas, and words that matter to a reader.</p><ul><li><a href=x>Home</a></li>"
    "<li><a href=y>About</a></li></ul><p>Second one, also long enough to count, really it is.</p></div><div id=comments><p>Nice, great, "
    "article, really wonderful post, thanks a lot for it.</p></div>": "A long paragraph, with commas, and words that matter to a reader.\n"
    "Second one, also long enough to count, really it is.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert extract.main_text(page) == PAGES[page]


def test_broken_pages_never_fail():
    pick = random.Random(6)
    parts = ["<p>", "</p>", "<div class=a>", "</div>", "<", ">", "text, ", "<li>", "<!--", "-->", "&#x41;", "<script>", "</script>", "<a href='", "'>", "</table>", "<td>", "<br/>"]
    for _ in range(500):
        page = "".join(pick.choice(parts) for _ in range(30))
        assert "\n\n" not in extract.main_text(page)
    assert extract.main_text("<div>" * 20_000 + "deep text") == "deep text"


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_stars_join_the_sets_of_a_mark_over_batches(size):
    rows = [(1, 5), (1, 5), (1, 6), (1, 6), (1, 9), (2, 6), (3, 5), (3, 5), (4, 5), (4, 9)]
    table = pa.table({"mark": [m for m, _ in rows], "set_key": [k for _, k in rows]})
    made = pa.Table.from_batches(list(ngram_join._stars(table.to_batches(size)))).to_pylist()
    assert {(r["a"], r["b"]) for r in made} == {(5, 6), (5, 9)}


def test_wide_beams_take_wider_steps_not_more():
    """Each step orders the whole beam of all queries, so steps that grow with the beam cost its square."""
    x = np.random.default_rng(5).normal(size=(1500, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    shard, steps = neighbors.Shard.built(x), []

    class Counted:
        def __getitem__(self, nodes):
            steps.append(len(nodes))
            return shard.layers[-1][nodes]

    queries = x[:200] + np.float32(0.02)
    ids, sims, _ = neighbors.beam_search(x, Counted(), queries, np.zeros((200, 1), np.int64), 512)
    assert (ids[:, 0] == (queries @ x.T).argmax(axis=1)).all()
    assert (np.sort(sims, axis=1)[:, ::-1] == sims).all() and len(steps) <= 3 * 32


def test_byte_ranges_merge():
    assert suffixes.merged([(5, 9), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 9)]
    assert re.fullmatch(r"[0-9a-f]*", "") is not None and suffixes.merged([]) == []


def test_training_counts_are_small_and_right():
    """Four bytes for each bucket of a text on the driver, and the shares that they give."""
    texts = ["ab", "", "Die Äpfel und der Baum " * 150, "le chat et la souris " * 40] * 60
    counts = language._counts(texts)
    assert sum(b.nbytes + n.nbytes for b, n in counts) == 4 * sum(len(b) for b, _ in counts)
    for text, (buckets, n) in zip(texts, counts, strict=True):
        found, _ = language._grams(pa.array([text], pa.string()))
        assert dict(zip(buckets.tolist(), n.tolist(), strict=True)) == Counter(found.tolist())
