"""SentencePiece encoding by an Aho-Corasick automaton under a single-pass Viterbi, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm.shared import WordTable, blocks, doc_texts, spread
from quire.llm.tokens import crc, split

MODEL = "piece_bpe_32k.model"
#: The character that stands for a blank in pieces.
BLANK = "▁"
#: Stands for a literal BLANK of a text while it is matched; no piece has it.
_LITERAL = "￿"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encoder and decoder for the pieces of a model file.

    A text gets one blank in front, blanks become ``BLANK``, and the segmentation with the greatest sum of
    piece scores wins; of equal sums the one whose last piece is longer, from the end backwards. A
    character that no piece ends at is spelled in bytes, each a little worse than the worst usual piece.
    Nothing else is normalised, so decoding gives the text back. The empty text has no ids.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[int] = [-1] * 256
        self.spelled: list[bytes] = []
        usual = 0.0
        leading = re.compile(f"{BLANK}*[^{BLANK}]*")
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.spelled.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                if not leading.fullmatch(piece):
                    raise ValueError(f"piece {i} has a blank inside, so words cannot be encoded apart")
                score = model.get_score(i)
                usual = min(usual, score if score > -1e8 else 0.0)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.spelled.append(piece.replace(BLANK, " ").encode())
        if -1 in self.bytes:
            raise ValueError("the model lacks byte pieces")
        self.automaton.make_automaton()
        self.byte_score = usual - 10
        self.words = WordTable(self._learn)
        sizes = np.array([len(b) for b in self.spelled], np.int64)
        self.text_sizes, self.text_starts = sizes, np.cumsum(sizes) - sizes
        self.text_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of a text that already has its blank in front. The automaton reads it once; at each end it
        reports the matches from the longest along its output links, and each relaxes the best score."""
        matched = chunk.replace(BLANK, _LITERAL).replace(" ", BLANK)
        n, low = len(chunk), float("-inf")
        best: list[float] = [low] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0], done = 0.0, 0
        byte_score = self.byte_score

        def spell(upto: int) -> None:
            for end in range(done + 1, upto + 1):
                size = len(chunk[end - 1].encode())
                if best[end - 1] + size * byte_score > best[end]:
                    best[end], back[end] = best[end - 1] + size * byte_score, (1, -1)

        for last, (size, score, i) in self.automaton.iter(matched):
            end = last + 1
            if end > done + 1:
                spell(end - 1)
            done = end - 1
            total = best[end - size] + score
            if total > best[end]:
                best[end], back[end] = total, (size, i)
        spell(n)
        ids: list[int] = []
        end = n
        while end:
            size, i = back[end]
            if i < 0:
                ids.extend(self.bytes[b] for b in reversed(chunk[end - 1].encode()))
            else:
                ids.append(i)
            end -= size
        return ids[::-1]

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.viterbi(w) for w in words.to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, sizes.sum()), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order and the number of each. No piece reaches over the start of a run of
        blanks, so the words from one such start to the next are encoded apart, each distinct one once."""
        texts = texts.cast(pa.large_string())
        runs = pc.match_substring_regex(texts, "  |^ | $").to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts, " ")
        flat = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.list_flatten(words), pa.scalar(" ", pa.large_string()))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if runs.any():
            lists = [re.findall(" +[^ ]*", " " + t) if odd else None for t, odd in zip(texts.to_pylist(), runs, strict=True)]
            cut = np.cumsum(counts)
            flat = pa.concat_arrays([pa.array(own, pa.large_string()) if own is not None else flat.slice(end - n, n) for own, end, n in zip(lists, cut.tolist(), counts.tolist(), strict=True)])
            counts = np.array([len(own) if own is not None else n for own, n in zip(lists, counts.tolist(), strict=True)], np.int64)
        encoded = flat.dictionary_encode()
        ids, lengths = self.words.gather(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        stops = np.cumsum(counts)
        sizes = ends[stops] - ends[stops - counts]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # the blank in front of nothing
            ids = np.delete(ids, spread(ends[stops - counts][empty], sizes[empty]))
            sizes[empty] = 0
        return ids, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as bytes, without the blank in front."""
        return self.text_bytes[spread(self.text_starts[ids], self.text_sizes[ids])].tobytes()[1:]


def _encoded(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for block in blocks(batches, 4 << 20):
            ids, sizes = pieces.encode(block.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row from its whole text; a null or empty text has no ids. Row by row, without
    a shuffle; repeated rows are encoded alike."""
    return doc_texts(docs).mapInArrow(_encoded(model or model_path()), "doc_id long, ids array<int>")


def _decoded(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            texts = []
            for x in batch.column("ids"):
                texts.append(pieces.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).decode() if x.is_valid else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ``doc_id, ids``; null or empty ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model or model_path()), "doc_id long, text string")


def _digest(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        byte_ids = np.zeros(len(pieces.spelled), bool)
        byte_ids[pieces.bytes] = True
        for block in blocks(batches, 4 << 20):
            ids, sizes = pieces.encode(block.column("text"))
            rows = []
            for doc, own in zip(block.column("doc_id").to_pylist(), split(ids, sizes), strict=True):
                text = pieces.decode(own)
                rows.append((doc, len(own), int(byte_ids[own].sum()), crc(own), len(text.decode()), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "n_chars", "text_sha256"])

    return run


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes and decodes every row: number of pieces and of byte pieces, checksum of the ids, and length
    and hash of the text decoded from them."""
    return doc_texts(docs).mapInArrow(_digest(model or model_path()), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_chars long, text_sha256 string")
