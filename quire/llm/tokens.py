"""Byte-level token ids of texts by the tokenizers library, each distinct word encoded once a block."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.shared import WordTable, spread

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: White space other than blank and line feed; two white-space characters in a row, or one at an end.
_IRREGULAR = (
    r"[\t\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$"
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: One of these after a letter, at the end of a word, is a token of its own.
_TAILS = ".,;:!?"
#: Letters of Latin scripts, which the split keeps together.
_LETTERS = r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible in
    Latin-1, else the next one from U+0100 on. A line feed, which parts the words, stays."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if b not in visible]
    letters[hidden] = 0x100 + np.arange(len(hidden))
    letters[0x0A] = 0x0A
    return letters


class Encoder:
    """Ids of whole texts, equal to encoding each text by itself.

    The vocabulary splits a text before every single blank that a visible character follows, and around
    every single line feed, before any merge. So where white space is regular, the words between can be
    encoded apart, and each distinct one once. Texts with other white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lines = Tokenizer(self.tokenizer.model)  # the same merges over lines of one word
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self.feed = self._whole(["\n"])[0][0]
        self.tails = np.array([self._whole([c])[0][0] for c in _TAILS])
        self.words = WordTable(self._learn)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words that the split leaves whole: letters after a blank or none."""
        joined = self.letters[np.frombuffer("\n".join(words.to_pylist()).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.lines.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
        last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(words).to_numpy()))
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words; one that starts with a line feed follows it, others follow a blank."""
        feeds = pc.starts_with(words, "\n")
        body = pc.if_else(feeds, pc.utf8_slice_codeunits(words, 1), words)
        lettered = pc.match_substring_regex(body, f"^[{_LETTERS}]+[{_TAILS}]?$")
        tailed = pc.and_(lettered, pc.match_substring_regex(body, f"[{_TAILS}]$"))
        lead = pc.if_else(feeds, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        base = pc.if_else(tailed, pc.utf8_slice_codeunits(body, 0, -1), body)
        base = pc.binary_join_element_wise(lead, base, pa.scalar("", pa.large_string()))
        plain, other = (base.filter(x).dictionary_encode() for x in (lettered, pc.invert(lettered)))
        ids, sizes = self._plain(plain.dictionary) if len(plain) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest = self._whole(other.dictionary.to_pylist())
        ids = np.concatenate([ids, *(np.array(x, np.int64) for x in rest)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        feed, is_plain = feeds.to_numpy(zero_copy_only=False), lettered.to_numpy(zero_copy_only=False)
        which = np.empty(len(words), np.int64)
        which[is_plain] = plain.indices.to_numpy(zero_copy_only=False)
        which[~is_plain] = other.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(plain.dictionary)
        tail = pc.index_in(pc.utf8_slice_codeunits(body, -1), pa.array(list(_TAILS), pa.large_string()))
        tail = np.where(tailed.to_numpy(zero_copy_only=False), self.tails[pc.fill_null(tail, 0).to_numpy(zero_copy_only=False)], -1)
        starts = np.cumsum(sizes) - sizes
        inner = sizes[which]
        total = inner + feed + (tail >= 0)
        at = np.cumsum(total) - total
        out = np.empty(total.sum(), np.int64)
        out[at[feed]] = self.feed
        out[spread(at + feed, inner)] = ids[spread(starts[which], inner)]
        out[(at + total - 1)[tail >= 0]] = tail[tail >= 0]
        return out, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, each text followed by the end id, and the number of each."""
        irregular = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, _IRREGULAR))
        odd = np.flatnonzero(irregular.to_numpy(zero_copy_only=False)).tolist()
        if not odd:
            return self._by_words(texts)
        strings = texts.to_pylist()
        whole = dict(zip(odd, (np.array(x, dtype=np.int64) for x in self._whole([strings[i] for i in odd])), strict=True))
        even = [i for i in range(len(strings)) if i not in whole]
        ids, counts = self._by_words(pa.array([strings[i] for i in even], pa.large_string()))
        parts = dict(zip(even, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if even else {}
        for i, x in whole.items():
            parts[i] = np.append(x, END_ID).astype(np.int32)
        ordered = [parts[i] for i in range(len(strings))]
        return np.concatenate(ordered) if ordered else np.zeros(0, np.int64), np.array([len(x) for x in ordered], np.int64)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every text gets a line feed in front, whose id is taken out again."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("\n", pa.large_string()))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat = pc.list_flatten(lists)
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        filled = pc.greater(pc.binary_length(flat), 0)
        encoded = flat.filter(filled).dictionary_encode()
        rows = rows[filled.to_numpy(zero_copy_only=False)]
        ids, lengths = self.words.gather(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False))
        ends = np.cumsum(lengths)
        at = (ends - lengths)[np.flatnonzero(np.diff(rows, prepend=-1))]  # where each text's line feed is
        counts = np.diff(np.append(at, len(ids)))
        ids[at[1:]] = END_ID  # it ends the text before
        return np.append(ids[1:], np.int32(END_ID)), counts


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def split(ids: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for n in counts.tolist():
        yield ids[at : at + n]
        at += n
