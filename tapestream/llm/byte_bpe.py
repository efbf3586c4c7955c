"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary gives each token one of as many
slots as there are tokens; a pre-token whose slot holds its own bytes is that token.  Second
tier: what is no token is merged bytewise, with a heap of adjacent pairs by rank and place
over a linked list of parts, so a run of n bytes takes n log n steps.

Texts are cut into segments that are encoded independently (``segments``); a worker
remembers a bounded number of them.  Decoding puts the tokens' bytes together.

Defined results: null is an empty text, which has no ids; null doc_ids stay; repeated rows
get equal rows; special tokens' strings are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import segments
from .packing import text_batches

# Two alternatives of the usual pattern, for letters and for other marks.
LETTERS, MARKS = r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+"
PLAIN = "^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?)$"
#: Bytes of text that are split and encoded at a time.
SLICE = 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines()) if token}


class MinimalPerfectHash:
    """n keys to range(n): each level places the keys that meet no other in its bits, the rest go a level down."""

    def __init__(self, hashes: np.ndarray, room: float = 2.0) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits, and the slot of each set bit
        left, used = np.asarray(hashes, np.uint64), 0
        if len(np.unique(left)) < len(left):
            raise ValueError("two keys have one hash")
        while len(left):
            size = max(1, int(room * len(left)))
            at = self._place(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((bits, used - 1 + np.cumsum(bits)))
            used += int(bits.sum())
            left = left[~bits[at]]
        self.size = used

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (hashes ^ np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key; of a stranger a slot or -1."""
        hashes = np.asarray(hashes, np.uint64)
        slots, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (bits, slot) in enumerate(self.levels):
            at = self._place(hashes[open_], level, len(bits))
            hit = bits[at]
            slots[open_[hit]] = slot[at[hit]]
            open_ = open_[~hit]
        return slots


def _ranges(codes: Iterable[int]) -> str:
    """A regular expression's set of these code points."""
    runs: list[list[int]] = []
    for c in sorted(codes):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def pre_token_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \p{L} and \p{N} holding what they hold in tiktoken, whose Unicode tables may be of another year."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}"):
        theirs = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(theirs.encode_ordinary(every)).decode())
        own = set(regex.findall(name, every))
        less, more = (_ranges(map(ord, x)) for x in (own - theirs, theirs - own))
        inside = name + (f"--[{less}]" if less else "") + (f"||[{more}]" if more else "")
        pattern = pattern.replace(name, f"[{inside}]" if less or more else name)
    return regex.compile(pattern, regex.V1)


class ByteBpe:
    """Encodes texts by merge ranks and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pieces = ranks, pre_token_pattern(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.tokens = {rank: token for token, rank in ranks.items()}
        kinds = pattern.split("|")
        before = kinds[: kinds.index(LETTERS)] if LETTERS in kinds and MARKS in kinds else [""]
        self.plain = all(k.startswith("'") for k in before)  # a word of letters is a piece, and a mark after it another
        keys = list(ranks)
        hashes = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))
        self.slots = MinimalPerfectHash(hashes)
        at = self.slots(hashes)
        self.slot_token = np.empty(len(keys), object)
        self.slot_token[at] = keys
        self.slot_rank = np.empty(len(keys), np.int64)
        self.slot_rank[at] = list(ranks.values())
        self.memo = segments.Memo()

    def whole(self, pieces: list[bytes]) -> list[int | None]:
        """The id of each piece that is a token."""
        at = self.slots(np.fromiter(map(xxh3_64_intdigest, pieces), np.uint64, len(pieces)))
        found = zip(pieces, self.slot_token[at], self.slot_rank[at].tolist(), (at >= 0).tolist())
        return [rank if hit and piece == token else None for piece, token, rank, hit in found]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by merges of the lowest rank, the leftmost of equal ones first."""
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(piece[i : i + 2]) for i in range(n)]
        rank[n - 1] = None
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(rank) if r is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & place
            if rank[i] != entry >> bits:
                continue  # one of its parts was merged otherwise
            j = after[i]
            k = after[i] = after[j]
            rank[i] = rank[j] = None
            if k < n:
                before[k] = i
                rank[i] = r = get(piece[i : after[k]])
                if r is not None:
                    heappush(heap, r << bits | i)
            p = before[i]
            if p >= 0:
                rank[p] = r = get(piece[p:k])
                if r is not None:
                    heappush(heap, r << bits | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; pre-tokens are remembered."""
        pieces = list(map(self.pieces.findall, texts))
        known = self.memo.fill({p for own in pieces for p in own}, self._look_up)
        return [[i for p in own for i in known[p][0]] for own in pieces]

    def _look_up(self, pieces: list[str]) -> Iterator[tuple[tuple[int, ...], str, bytes]]:
        """Of each piece its ids, the ids in decimal, and the bytes they decode to."""
        raw = [p.encode() for p in pieces]
        for piece, found in zip(raw, self.whole(raw)):
            ids = tuple(self.merge(piece)) if found is None else (found,)
            yield ids, ",".join(map(str, ids)), self.decode(ids)

    def forms(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, the ids in decimal and the bytes they decode to, of each text."""
        plain = pc.extract_regex(distinct, PLAIN) if self.plain else pa.nulls(len(distinct), pa.struct([("word", pa.large_string()), ("mark", pa.large_string())]))
        is_plain = plain.is_valid()
        order = np.argsort(~is_plain.to_numpy(zero_copy_only=False), kind="stable")  # plain ones first
        words, marks = (plain.filter(is_plain).field(c) for c in range(2))
        words, marks = words.dictionary_encode(), marks.dictionary_encode()
        others = [self.pieces.findall(t) for t in distinct.filter(pc.invert(is_plain)).to_pylist()]
        of_words, of_marks = words.dictionary.to_pylist(), marks.dictionary.to_pylist()
        known = self.memo.fill({*of_words, *filter(None, of_marks), *(p for own in others for p in own)}, self._look_up)
        nothing = (), "", b""

        def columns(rows: list[tuple[tuple[int, ...], str, bytes]]) -> tuple[np.ndarray, pa.Array, pa.Array]:
            ids, decimal, raw = zip(*rows) if rows else ((), (), ())
            return np.fromiter(map(len, ids), np.int64, len(ids)), pa.array(decimal, pa.large_string()), pa.array(raw, pa.large_binary())

        (n_word, in_word, raw_word), (n_mark, in_mark, raw_mark) = (columns([known[x] if x else nothing for x in own]) for own in (of_words, of_marks))
        at, mark = words.indices, marks.indices
        n = n_word[at.to_numpy()] + n_mark[mark.to_numpy()]
        comma = pc.if_else(pc.equal(in_mark, ""), pa.scalar("", pa.large_string()), pa.scalar(",", pa.large_string()))
        no = pa.scalar("", pa.large_string())
        decimal = pc.binary_join_element_wise(in_word.take(at), comma.take(mark), in_mark.take(mark), no)
        raw = pc.binary_join_element_wise(raw_word.take(at), raw_mark.take(mark), pa.scalar(b"", pa.large_binary()))
        rest = [tuple(zip(*map(known.__getitem__, own))) if own else ((), ("",), ()) for own in others]
        n = np.concatenate([n, np.array([sum(map(len, r[0])) for r in rest], np.int64)])
        decimal = pa.concat_arrays([decimal, pa.array([",".join(r[1]) for r in rest], pa.large_string())])
        raw = pa.concat_arrays([raw, pa.array([b"".join(r[2]) for r in rest], pa.large_binary())])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return n[back], decimal.take(pa.array(back)), raw.take(pa.array(back))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def text_digests(bpe: ByteBpe, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, digest of the ids and of the bytes they decode to, of each text."""
    if not len(texts):
        return [], [], []
    codes, distinct, bounds = segments.split(texts)
    n, *forms = bpe.forms(distinct)
    digests = []
    for form, between in zip(forms, (",", b"")):
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), form.take(pa.array(codes)))
        joined = pc.binary_join(lists, pa.scalar(between, form.type))
        digests.append([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined])
    return np.add.reduceat(n[codes], bounds[:-1]).tolist(), *digests


_loaded: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for this file, made once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in text_batches(whole):
                codes, distinct, bounds = segments.split(batch.column(1))
                ids = bpe.encode(distinct.to_pylist())
                rows = [[i for c in codes[a:b].tolist() for i in ids[c]] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (binary) of rows (doc_id, ids); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and of the bytes they decode to, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in text_batches(whole, 10_000, SLICE):
                n, ids, decoded = text_digests(bpe, batch.column(1))
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
