"""What tasks of the n-gram join hold: a few copies of a group's tokens, and no more copies of texts where groups are larger."""

import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from quire.llm import ngram_join


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def near_copies(n, words, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 50_000, words)
    texts = []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, words, 3)] = rng.integers(0, 50_000, 3)
        texts.append(" ".join(f"w{x}" for x in own))
    return texts


def test_texts_of_a_large_group_are_dealt_in_small_batches():
    texts, count = near_copies(300, 400), 500
    batch = pa.record_batch({"group": [7] * 300, "set_key": list(range(300)), "blocks": [count] * 300, "text": texts})
    seen, largest = {}, 0

    def deal():
        nonlocal largest
        for out in ngram_join._deal([batch]):
            largest = max(largest, out.nbytes)
            for key, a, b in zip(*(out.column(c).to_pylist() for c in ("set_key", "a", "b")), strict=True):
                seen.setdefault(key, []).append((a, b))

    _, used = peak(deal)
    assert largest < 3e6 and used < 60
    assert len(seen) == 300 and all(sorted(v) == sorted((min(k, b), max(k, b)) for b in range(count) if b != k) for k, v in seen.items())


def test_a_trie_holds_a_few_copies_of_its_tokens():
    texts = near_copies(2000, 300)
    pack = zstandard.ZstdCompressor(level=3).compress
    batch = pa.record_batch({"group": [1] * 2000, "a": [0] * 2000, "b": [0] * 2000, "set_key": list(range(2000)), "packed": [pack(t.encode()) for t in texts]})
    links, used = peak(lambda: sum(b.num_rows for b in ngram_join._joined(5, 80)([batch])))
    assert links == 1999
    assert used < 70 * 2000 * 300 / 1e6  # bytes a token


def test_ranks_are_those_of_a_plain_count():
    tokens = np.random.default_rng(2).integers(0, 3000, 4000).astype(np.uint64)
    ranks, shared = ngram_join._ranked(tokens)
    values, counts = np.unique(tokens, return_counts=True)
    want = {v: i for i, v in enumerate(values[np.argsort(-counts, kind="stable")][: (counts > 1).sum()].tolist())}
    assert ranks.tolist() == [want.get(t, -1) for t in tokens.tolist()] and shared == len(want)
