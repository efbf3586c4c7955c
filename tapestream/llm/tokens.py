"""Token ids of whole texts with a bounded memo of words.

The vocabulary's pre-tokenizer never lets a token cross white space, so a text's ids are
the ids of its blank-separated pieces in order.  Arrow splits and dictionary-encodes a
batch of texts; only words not seen before are encoded, many per call.  The memo is
emptied when it reaches ``MEMO_WORDS`` words, so a worker's memory doesn't grow with the
corpus.

Unseen words go through the same vocabulary as merge ranks: a word's end is the byte 0,
whose merges rank before all others, as the word-end symbols of the vocabulary do.  Words
that hold the bytes 0 or 1 go to the tokenizers library itself; the tests hold both ways
against each other.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 300_000
END, BETWEEN = "\x00", "\x01"
WORD_END = "</w>"


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a lower-casing byte-level BPE with word ends, remembered by word."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path}: not a vocabulary with word ends")
        special = {t["content"] for t in spec["added_tokens"]}
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        symbols = byte_symbols()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                core, end = (token[: -len(WORD_END)], b"\0") if token.endswith(WORD_END) else (token, b"")
                ranks[bytes(symbols[c] for c in core) + end] = i
        self.ranked = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\1\0"]
        self.pieces = regex.compile(pieces)
        self.memo_words = memo_words
        self._clear()

    @cached_property
    def tokenizer(self):
        """The library's own, which few words need."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _tokenize_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each has."""
        text = f" {BETWEEN} ".join(words)
        if END in text or text.count(BETWEEN) != len(words) - 1:
            found = [self._ids(w) for w in words]
            return np.asarray([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        text = unicodedata.normalize("NFC", text).lower()
        ids = np.asarray(self.ranked.encode_ordinary("".join(map(self._ended, text.split(" ")))), np.uint32)
        cuts = np.flatnonzero(ids == self.between)
        if len(cuts) != len(words) - 1:
            raise ValueError("words were not kept apart")
        lengths = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), lengths

    def _ended(self, word: str) -> str:
        """The word's pieces, each with its end; letters with a point or comma are the common case."""
        if word.isalpha():
            return word + END
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return f"{word[:-1]}{END}{word[-1]}{END}"
        return "".join([piece + END for piece in self.pieces.findall(word)])

    def _remember(self, words: list[str]) -> None:
        flat, lengths = self._tokenize_words(words)
        first = len(self.lengths)
        self.places.update(zip(words, range(first, first + len(words))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order (uint32), and how many belong to each text. Null: none."""
        texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = words.offsets[0].as_py()
        coded = words.values.slice(first).dictionary_encode()
        unique = coded.dictionary.to_pylist()
        places = list(map(self.places.get, unique))
        misses = [w for w, p in zip(unique, places) if p is None]
        if misses:
            if len(self.places) + len(misses) > self.memo_words:
                self._clear()
                misses = unique
            self._remember(misses)
            places = list(map(self.places.get, unique))
        if not unique:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = np.asarray(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy() - first]
        return ids, np.diff(bounds)


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for this file, made once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
