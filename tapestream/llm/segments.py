"""Texts as runs that byte-level and sentence-piece vocabularies encode independently.

A cut lies before each single space that stands between two other non-blank characters.
The pre-tokenizers here start a new piece there whatever lies around, so a text's ids are
those of its segments in order, and each distinct segment is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words between spaces that are empty, or begin or end with what a pattern may take for a blank.
BLANK_END = r"^$|^[\x09-\x0d\x1c-\x20\x85\p{Z}]|[\x09-\x0d\x1c-\x20\x85\p{Z}]$"
#: Entries, and characters of their keys, after which a memo starts anew, with those asked for since the last time.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 16_000_000


class Memo:
    """Results by string, of two generations at most: what is asked for in neither the last nor this one goes."""

    def __init__(self) -> None:
        self.now: dict[str, Any] = {}
        self.before: dict[str, Any] = {}
        self.chars = 0

    def fill(self, keys: Iterable[str], make: Callable[[list[str]], Iterable[Any]]) -> dict[str, Any]:
        """A dict that holds all keys; ``make`` gives the results of unknown ones in order."""
        if len(self.now) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
            self.before, self.now, self.chars = self.now, {}, 0
        now, misses = self.now, []
        for key in keys:
            if key not in now:
                if (found := self.before.get(key)) is None:
                    misses.append(key)
                else:
                    now[key] = found
                self.chars += len(key)
        now.update(zip(misses, make(misses)))
        return now


def compact(texts: pa.Array) -> pa.Array:
    """The texts as large strings, null as empty, in buffers of their own: some kernels misread a slice's."""
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


def split(texts: pa.Array, lead: str = "") -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which distinct segment stands where, the distinct segments, and each text's bounds.

    All but a text's first segment begin with a space; the first one is put after ``lead``, a
    space or nothing.  Null and the empty text are one empty segment.
    """
    texts = compact(texts)
    words = pc.split_pattern(texts, " ")
    first = words.offsets[0].as_py() if len(texts) else 0
    coded = words.values.slice(first).dictionary_encode()
    known = coded.dictionary
    codes, bounds = coded.indices.to_numpy(zero_copy_only=False), words.offsets.to_numpy() - first
    more: dict[str, int] = {}

    def place(segment: str) -> int:
        return more.setdefault(segment, len(known) + len(more))

    blank = pc.match_substring_regex(known, BLANK_END).to_numpy(zero_copy_only=False)
    beside = np.concatenate([[0], np.cumsum(blank[codes])]) if len(codes) else np.zeros(1, np.int64)
    odd = beside[bounds[1:]] > beside[bounds[:-1]]  # texts where a space may be no cut
    if not lead:
        codes, starts = codes.copy(), bounds[:-1]
        codes[starts] = [place(w) for w in known.take(pa.array(codes[starts])).to_pylist()]
    if odd.any():
        parts = []
        for i, one in enumerate(odd.tolist()):
            if one:
                head, *rest = CUT.split(texts[i].as_py())
                parts.append(np.array([place(lead + head), *(place(" " + s) for s in rest)]))
            else:
                parts.append(codes[bounds[i] : bounds[i + 1]])
        codes, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), known, pa.scalar("", pa.large_string()))
    return codes, pa.concat_arrays([spaced, pa.array(list(more), pa.large_string())]), bounds
