"""Secrets in whole texts: fixed patterns, and novelty under a primed zstandard.

The patterns (assignments to a secret's name, access key ids, long hex runs) find the base
spans.  The method looks at other long strings of letters and digits in a statement with a
sensitive word, before or after them: a statement is what lies between line ends, ``;``,
braces, and full stops before a blank, however long it is.  The text around such a string is
compressed without and with it, by a compressor primed with the identifiers most frequent in
such surroundings over the whole corpus.  A string that adds at least ``novelty`` bytes for
each of its own is new to both and is reported as ``novel``.  Strings of fewer than 12
characters are none: they add too few bytes to tell.

Defined results: null is an empty text and has no span, its digest that of an empty list;
null doc_ids stay; equal rows get equal results; no candidates give an empty dictionary;
other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import text_batches

KINDS = ("assign", "access", "hex", "novel")
# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = {"assign": 6, "access": 20}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth|signature|client.?id|session|cookie", re.I | re.A)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}")
STATEMENT_END = re.compile(r"[\n\r;{}]|[.!?](?=\s)")
#: Characters on either side of a candidate that are compressed with it.
AROUND = 256
MASK = "[SECRET]"

Span = tuple[int, int, int, int]  # start, kind, end, start of what is masked


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Long strings with letters and digits, in a statement with a sensitive word beside them and outside base spans."""
    long = [m.span() for m in CANDIDATE.finditer(text) if any(map(str.isdigit, m.group())) and any(map(str.isalpha, m.group()))]
    words = [m.start() for m in SENSITIVE.finditer(text)] if long else []
    if not words:
        return []
    ends = [m.start() for m in STATEMENT_END.finditer(text)]
    starts, reach = [s[0] for s in taken], list(accumulate((s[2] for s in taken), max))
    out = []
    for start, end in long:
        at = bisect_right(ends, start)
        first, last = (ends[at - 1] if at else 0), (ends[at] if at < len(ends) else len(text))
        beside = bisect_left(words, last) - bisect_left(words, first) - (bisect_left(words, end) - bisect_left(words, start))
        overlapped = bisect_left(starts, end)  # spans that begin before its end
        if beside and not (overlapped and reach[overlapped - 1] > start):
            out.append((start, end))
    return out


class Novelty:
    """Marginal compressed bytes of a string within its surroundings, per character."""

    def __init__(self, identifiers: list[str]) -> None:
        known = " ".join(reversed(identifiers)).encode()  # what is frequent lies nearest
        primed = {"dict_data": zstandard.ZstdCompressionDict(known, zstandard.DICT_TYPE_RAWCONTENT)} if len(known) >= 8 else {}
        self.compressor = zstandard.ZstdCompressor(level=9, write_content_size=False, write_dict_id=False, **primed)

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        without = len(self.compressor.compress((before + after).encode()))
        return (len(self.compressor.compress((before + text[start:end] + after).encode())) - without) / (end - start)


def identifier_dictionary(docs: DataFrame, size: int = 4000) -> list[str]:
    """The identifiers most frequent around candidates in the whole corpus, ``size`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                words: list[str] = []
                for text in filter(None, batch.column(1).to_pylist()):
                    for start, end in candidates(text, base_spans(text)):
                        words += IDENTIFIER.findall(text, max(0, start - AROUND), start) + IDENTIFIER.findall(text, end, end + AROUND)
                yield pa.record_batch([pa.array(words, pa.string())], ["word"])

    words = docs.select("doc_id", "text").mapInArrow(run, "word string").groupBy("word").count()
    return [r.word for r in words.orderBy(F.desc("count"), "word").limit(size).collect()]


def all_spans(text: str, score: Novelty, novelty: float) -> list[Span]:
    base = base_spans(text)
    more = [(a, 3, b, a) for a, b in candidates(text, base) if score(text, a, b) >= novelty]
    return sorted(base + more) if more else base


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def find(docs: DataFrame, novelty: float = 0.55, size: int = 4000) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for each row of docs."""
    known = identifier_dictionary(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Novelty(known)
        for whole in batches:
            for batch in text_batches(whole):
                counts, digests, listed = [[] for _ in KINDS], [], []
                for text in batch.column(1).to_pylist():
                    spans = all_spans(text or "", score, novelty)
                    kinds = [s[1] for s in spans]
                    for k, column in enumerate(counts):
                        column.append(kinds.count(k))
                    digests.append(hashlib.sha256(_listed([s for s in spans if s[1] < 3]).encode()).hexdigest())
                    listed.append(_listed(spans))
                columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(listed, pa.string())]
                yield pa.record_batch([batch.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end in sorted((cut, end) for _, _, end, cut in spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, novelty: float = 0.55, size: int = 4000) -> DataFrame:
    """docs with every secret masked, and n_chars, where there is such a column, set anew for changed texts."""
    known = identifier_dictionary(docs, size)
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Novelty(known)
        for whole in batches:
            step = max(1, int(whole.num_rows * 4_000_000 / max(1, whole.nbytes)))
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                old = batch.column(place).to_pylist()
                new = [masked(t, all_spans(t, score, novelty)) if t else t for t in old]
                columns = batch.columns
                columns[place] = pa.array(new, batch.schema.field(place).type)
                if length is not None:
                    sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(length).to_pylist(), old, new)]
                    columns[length] = pa.array(sizes, batch.schema.field(length).type)
                yield pa.record_batch(columns, schema=batch.schema)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
