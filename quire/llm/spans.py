"""Substring deduplication by sliding spans of sentences that occur elsewhere before."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm.shared import blocks, doc_texts, mix

#: The fewest sentences and words of a span; shorter ones repeat by chance.
SPAN, SPAN_WORDS = 2, 12
#: Characters that count as a word in scripts without blanks: Thai, Lao, Myanmar, Khmer, kana and Han.
WORD_CHARACTERS = 2
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(rf"(?:{_UNSPACED.pattern}|(?:(?!{_UNSPACED.pattern})\S)+)\s*")
#: Sentences of more words are cut after their commas, so that a passage in one long sentence has spans too.
LONG_SENTENCE = 30
_END = re.compile("[.!?…。！？]+[\"'’”)\\]]*\\s+|\\n+|[。！？]+")
_COMMA = re.compile(r"[,;:，、；]\s+")
#: Places to cut a long sentence: after a word, or a character of a script without blanks, of one in CUT_EVERY hashes.
CUT_EVERY = 8
_CLAUSE = re.compile("[\uff0c\u3001\uff1b]\\s*|[,;:]\\s+")


def n_words(text: str) -> int:
    """The words of a text; where a script has no blanks, some characters count as one."""
    found = len(text.split())
    return found if text.isascii() else max(found, len(_UNSPACED.findall(text)) // WORD_CHARACTERS)


def _cut(piece: str) -> list[str]:
    """A long sentence cut after its commas, and where it is still long after words that their hash picks, so
    that the same words are cut alike wherever they stand."""
    import xxhash

    found, at = [], 0
    for end in [*(m.end() for m in _CLAUSE.finditer(piece)), len(piece)]:
        if n_words(piece[at:end]) > LONG_SENTENCE:
            for m in _WORD.finditer(piece, at, end):
                if xxhash.xxh3_64_intdigest(m[0].rstrip()) % CUT_EVERY == 0:
                    found.append(piece[at : m.end()])
                    at = m.end()
        if at < end:
            found.append(piece[at:end])
        at = end
    return found


def sentences(text: str, whole: bool = False) -> list[str]:
    """Consecutive pieces of a text, each with the white space behind it; joined they give the text. Pieces
    without a word belong to the one before, at the start to the one behind. With ``whole`` long sentences
    without commas are cut too."""
    cuts = [m.end() for m in _END.finditer(text)]
    found: list[str] = []
    start = 0
    for end in [*cuts, len(text)]:
        piece = text[start:end]
        start = end
        if not piece:
            continue
        if whole and len(piece) > LONG_SENTENCE and n_words(piece) > LONG_SENTENCE:
            *early, piece = _cut(piece)
            found += early
        elif len(piece) > 2 * LONG_SENTENCE and len(piece.split()) > LONG_SENTENCE:
            at = 0
            for m in _COMMA.finditer(piece):
                found.append(piece[at : m.end()])
                at = m.end()
            piece = piece[at:]
            if not piece:
                continue
        if found and (not piece.strip() or not found[-1].strip()):
            found[-1] += piece
        else:
            found.append(piece)
    return found


def _runs(number: np.ndarray, words: np.ndarray, counts: np.ndarray, span: int, least: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the shortest run from each sentence on, and of the shortest up to each, that stays
    in its text and has ``span`` sentences and ``least`` words. The second kind reaches the end of a passage
    whose last sentences are short. Without ``whole`` only those of just ``span`` sentences."""
    at = np.arange(len(number))
    upto = np.concatenate(([0], np.cumsum(words)))
    high = np.maximum(np.searchsorted(upto, upto[:-1] + least), at + span)
    low = np.minimum(np.searchsorted(upto, upto[1:] - least, "right") - 1, at + 1 - span)
    ahead, behind = high <= np.repeat(np.cumsum(counts), counts), low >= at - number
    ends = np.unique(np.concatenate([at[ahead] << 32 | high[ahead], low[behind] << 32 | at[behind] + 1]))
    start = ends >> 32
    length = (ends & 0xFFFFFFFF) - start
    return (start, length) if whole else (start[length == span], length[length == span])


def _spans(span: int, least: int, whole: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        one = xxhash.xxh3_64_intdigest
        for batch in blocks(batches):
            ids, numbers, hashes, words, counts = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sentences(text, whole)
                counts.append(len(found))
                for k, sentence in enumerate(found):
                    ids.append(doc)
                    numbers.append(k)
                    words.append(n_words(sentence))
                    hashes.append(one(" ".join(sentence.split())))
            if not ids:
                continue
            doc, number, each = np.array(ids, np.int64), np.array(numbers, np.int64), np.array(hashes, np.uint64)
            start, length = _runs(number, np.array(words, np.int64), np.array(counts, np.int64), span, least, whole)
            key = np.zeros(len(start), np.uint64)
            for k in range(length.max(initial=0)):
                on = length > k
                key[on] = mix(key[on] + each[start[on] + k]) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc[start]), pa.array(number[start].astype(np.int32)), pa.array(length.astype(np.int32))],
                ["span", "doc_id", "number", "length"],
            )

    return run


def _kept(whole: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                found = sentences(text, whole)
                gone = {k for s in starts or () for k in range(s["number"], s["number"] + s["length"])}
                texts.append("".join(s for k, s in enumerate(found) if k not in gone) if gone else text)
                counts.append(len(found))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                ["doc_id", "text", "n_sentences", "n_removed"],
            )

    return run


def dedup_spans(docs: DataFrame, span: int = SPAN, least_words: int = SPAN_WORDS, whole: bool = False) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` of every row, without sentences inside repeated spans.

    Of equal spans the one in the smallest doc_id, and there the earliest, stays; all others lose their
    sentences. A span is a run of ``span`` sentences with ``least_words`` words; with ``whole`` a run of fewer
    words is widened until it has them, and long sentences are cut into several, so that lists, verse and one
    long sentence have spans too. Sentences are equal if their words are, whatever the white space; a text of
    one sentence has no span.
    Rows with a null id pass unchanged; rows that share an id are taken as one document, so equal ones do not cut each other. A
    null text is empty. First occurrences are found by minima that combine before the shuffle, and joined
    back with splittable partitions, so a passage in a third of all documents stays spread.
    """
    rows = doc_texts(docs)
    spans = rows.where("doc_id IS NOT NULL").mapInArrow(_spans(span, least_words, whole), "span long, doc_id long, number int, length int")
    firsts = spans.groupBy("span").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = attach(spans, firsts, ["span"], "inner").where("first.doc_id <> doc_id OR first.number <> number")
    starts = later.groupBy("doc_id").agg(F.collect_set(F.struct("number", "length")).alias("starts"))
    return rows.join(starts, "doc_id", "left").mapInArrow(_kept(whole), "doc_id long, text string, n_sentences long, n_removed long")


def span_digests(docs: DataFrame) -> DataFrame:
    """Per document: sentences, removed sentences, and length and hash of what is left."""
    return dedup_spans(docs, whole=True).select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))
