"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, corpus-wide.

A text is encoded by a byte-level vocabulary (side A) and a sentence-piece model (side B),
both over the text with a space before it.  Byte offsets where tokens of both sides end cut
the tokens into groups; each pair of an A and a B token occurrence in one group is a link.
A pair of ids counts as many documents as hold it linked.

Postings cogroup, by A's ids:

1. Each worker encodes slices of documents and writes each document's own figures, and its
   postings (id pair, document, multiplicity) as sorted blocks, one per slice and bucket of A ids.
2. The counts of a bucket come from its blocks' distinct pairs: added up in sorted streams,
   first in shares of about ``SHARE_BLOCKS`` blocks, then over the shares, so that a bucket
   with a third of all postings is many tasks.  All pairs of an A id are in one bucket, so
   its highest count is known there.  A bucket's table has at most (A ids / buckets) * B ids rows.
3. The blocks are dealt by bucket and share and cogrouped with the bucket's counts; each block
   gives what it adds to its documents.
4. A slice's additions are summed by document and joined to the documents' own figures.

Segments of texts (``segments``) are encoded independently, each distinct one once a slice.

Defined results: texts that are null or empty, or whose bytes on either side differ from the
space and the text, have no tokens: zeros and an empty digest; null doc_ids stay; each row is
a document of its own, repeated or not; special tokens' strings are ordinary text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .packing import text_batches
from .store import keep
from .tokens import byte_symbols

#: Buckets of A ids; blocks of a bucket whose postings one task takes.
BUCKETS, SHARE_BLOCKS = 128, 64
#: Bytes of text in a slice; plain segments encoded together; links of a group above which its ids are made distinct first.
SLICE, TOGETHER, LONG_GROUP = 5_000_000, 1000, 10_000
FIGURES = "slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
WRITTEN = f"bucket int, {FIGURES}, keys binary, holders binary, docs binary, times binary"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs, compressed."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(numbers) or numbers.max() < 1 << 8 * s)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{size}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class Sides:
    """Both tokenizers: ids and byte lengths of segments."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        special, symbols = {t["content"] for t in spec["added_tokens"]}, byte_symbols()
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if spec.get("normalizer") or merged != sorted(merged):
            raise ValueError(f"{path_a}: not a byte-level vocabulary whose ids are in order of merges")
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: token for token, i in ranks.items()}
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode())
        if any("▁" in piece.lstrip("▁") for piece in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError(f"{path_b}: pieces go on over a space")
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.get_piece_size()
        self.lengths_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(self.n_a)], np.int64)
        self.lengths_b = np.array(list(map(len, self.bytes_b)), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of side A and B of segments that begin with a space, one after another, how many each segment has, and which segments both sides give back."""
        plain = [t[1:2] > " " and not t[1].isspace() and not t[-1].isspace() and "▁" not in t for t in texts]
        order = sorted(range(len(texts)), key=plain.__getitem__)  # odd ones first
        n_odd = len(texts) - sum(plain)
        ids: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        whole = np.ones(len(texts), bool)

        def alone(i: int) -> None:
            own = self.a.encode_ordinary(texts[i]), self.b.encode(texts[i][1:])
            raw = texts[i].encode()
            whole[i] = b"".join(map(self.bytes_a.__getitem__, own[0])) == raw == b"".join(map(self.bytes_b.__getitem__, own[1]))
            for side in range(2):
                ids[side].append(own[side] if whole[i] else [])
                counts[side].append([len(ids[side][-1])])

        for i in order[:n_odd]:
            alone(i)
        for k in range(n_odd, len(order), TOGETHER):  # tokens don't go on from one plain segment into the next
            some = order[k : k + TOGETHER]
            text = "".join([texts[i] for i in some])
            own = self.a.encode_ordinary(text), self.b.encode(text[1:])
            if b"".join(map(self.bytes_b.__getitem__, own[1])) != text.encode():
                for i in some:
                    alone(i)
                continue
            ends = np.cumsum([len(texts[i].encode()) for i in some])
            for side, lengths in enumerate((self.lengths_a, self.lengths_b)):
                tokens_end = np.cumsum(lengths[own[side]])
                upto = np.searchsorted(tokens_end, ends, side="right")
                if (tokens_end[upto - 1] != ends).any():
                    raise ValueError("a token goes on over a segment's end")
                ids[side].append(own[side])
                counts[side].append(np.diff(upto, prepend=0))
        in_order = np.argsort(order)
        out = []
        for side in range(2):
            flat, n = (np.concatenate([np.asarray(x, np.int64) for x in parts]) if parts else np.zeros(0, np.int64) for parts in (ids[side], counts[side]))
            starts, n = (np.cumsum(n) - n)[in_order], n[in_order]
            out += [flat[_spread(starts, n)], n]
        return out[0], out[1], out[2], out[3], whole


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] to starts[i] + lengths[i] - 1 of each i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Added(NamedTuple):
    """What each of a slice's distinct segments adds to its document."""

    figures: np.ndarray  # tokens of A, of B, groups, links, whether the bytes differ
    text: list[str]  # the groups, each with its end mark
    n_pairs: np.ndarray
    keys: np.ndarray  # of the segments' id pairs, one segment after another
    times: np.ndarray


class Aligner:
    """Groups and links of segments.  A pair's key is in order of bucket (A's id modulo the buckets), then A's id, then B's."""

    def __init__(self, sides: Sides, buckets: int) -> None:
        self.sides, self.buckets = sides, buckets
        self.per_bucket = -(-sides.n_a // buckets) * sides.n_b
        decimal = [list(map(str, range(n))) for n in (sides.n_a, sides.n_b)]
        self.names = [[f"{x}{end}" for x in of] for of, ends in zip(decimal, (",|", ",;")) for end in ends]  # within a group and at its end, A and B

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a % self.buckets * self.per_bucket + a // self.buckets * self.sides.n_b + b

    def added(self, distinct: list[str]) -> Added:
        sides, n = self.sides, len(distinct)
        ids_a, n_a, ids_b, n_b, whole = sides.encode(distinct)
        ends_a, ends_b = np.cumsum(sides.lengths_a[ids_a]), np.cumsum(sides.lengths_b[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)  # segments' ends are among them
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        of_a, of_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        segment = np.zeros(len(both), np.int64)
        segment[group_a] = np.repeat(np.arange(n), n_a)
        links = of_a * of_b
        figures = np.stack([n_a, n_b, np.bincount(segment, minlength=n), np.bincount(segment, weights=links, minlength=n).astype(np.int64), ~whole], axis=1).astype(np.int64)

        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[first_a + of_a - 1] = last_b[first_b + of_b - 1] = True
        places = np.empty(len(ids_a) + len(ids_b), np.int64)  # a group's A tokens, then its B tokens
        places[np.arange(len(ids_a)) + first_b[group_a]] = np.arange(len(ids_a))
        places[np.arange(len(ids_b)) + (first_a + of_a)[group_b]] = len(ids_a) + np.arange(len(ids_b))
        names = self.names
        words = [names[1 if end else 0][i] for i, end in zip(ids_a.tolist(), last_a.tolist())] + [names[3 if end else 2][i] for i, end in zip(ids_b.tolist(), last_b.tolist())]
        words = list(map(words.__getitem__, places.tolist()))
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        text = ["".join(words[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]

        pairs = self._pairs(ids_a, ids_b, first_a, of_a, first_b, of_b, segment)
        return Added(figures, text, np.bincount(pairs[0], minlength=n), pairs[1], pairs[2])

    def _pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, of_a: np.ndarray, first_b: np.ndarray, of_b: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, key and multiplicity of each segment's distinct pairs.  Long groups are first made lists of distinct ids."""
        out = []
        links = of_a * of_b
        short = links <= LONG_GROUP
        g = np.flatnonzero(short)
        a = np.repeat(ids_a[_spread(first_a[g], of_a[g])], np.repeat(of_b[g], of_a[g]))
        b = ids_b[_spread(np.repeat(first_b[g], of_a[g]), np.repeat(of_b[g], of_a[g]))]
        out.append((np.repeat(segment[g], links[g]), self._keys(a, b), np.ones(len(a), np.int64)))
        for i in np.flatnonzero(~short).tolist():
            (a, n), (b, m) = (np.unique(ids[first[i] : first[i] + of[i]], return_counts=True) for ids, first, of in ((ids_a, first_a, of_a), (ids_b, first_b, of_b)))
            out.append((np.full(len(a) * len(b), segment[i]), self._keys(np.repeat(a, len(b)), np.tile(b, len(a))), np.repeat(n, len(b)) * np.tile(m, len(a))))
        own, keys, times = map(np.concatenate, zip(*out))
        space = self.buckets * self.per_bucket
        joint = own * space + keys
        order = np.argsort(joint)
        joint = joint[order]
        first = np.flatnonzero(np.diff(joint, prepend=-1))
        times = np.add.reduceat(times[order], first) if len(first) else times
        return joint[first] // space, joint[first] % space, times

    def find(self, texts: pa.Array) -> tuple[np.ndarray, Added, np.ndarray]:
        """Which distinct segment stands where, what these add, and each text's bounds."""
        codes, distinct, bounds = segments.split(texts, " ")
        return codes, self.added(distinct.to_pylist()), bounds


def _blocks(keys: np.ndarray, docs: np.ndarray, times: np.ndarray, per_bucket: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Bucket, distinct keys (as steps), how many documents hold each, and these documents and multiplicities."""
    n_docs = int(docs.max()) + 1 if len(docs) else 1
    joint = keys * n_docs + docs
    order = np.argsort(joint)
    joint = joint[order]
    first = np.flatnonzero(np.diff(joint, prepend=-1))
    times = np.add.reduceat(times[order], first) if len(first) else times[:0]
    keys, docs = joint[first] // n_docs, joint[first] % n_docs
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    holders = np.diff(np.append(start, len(keys)))
    distinct = keys[start]
    cuts = np.flatnonzero(np.diff(distinct // per_bucket, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(distinct)]):
        x, y = start[a], start[b] if b < len(start) else len(keys)
        yield int(distinct[a] // per_bucket), packed(np.diff(distinct[a:b], prepend=0)), packed(holders[a:b]), packed(docs[x:y]), packed(times[x:y])


_loaded: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str, pattern: str, buckets: int) -> Aligner:
    """The worker's tokenizers for these files, made once."""
    if (at := (path_a, path_b, pattern, buckets)) not in _loaded:
        _loaded[at] = Aligner(Sides(path_a, path_b, pattern), buckets)
    return _loaded[at]


def _written(docs: DataFrame, path_a: str, path_b: str, pattern: str, buckets: int) -> DataFrame:
    """A row per document with its figures (bucket -1), and a row per slice and bucket with the postings."""
    names = [c.split()[0] for c in WRITTEN.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b, pattern, buckets)
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in text_batches(whole, 10_000, SLICE):
                codes, added, bounds = own.find(batch.column(1))
                total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(added.figures[codes], axis=0)])
                figures = total[bounds[1:]] - total[bounds[:-1]]
                full = np.array([bool(t) for t in batch.column(1).to_pylist()], bool) & (figures[:, 4] == 0)
                figures[~full] = 0
                places, rows = codes.tolist(), []
                for i, (doc, a, b, some, counts) in enumerate(zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), full.tolist(), figures[:, :4].tolist())):
                    digest = hashlib.sha256("".join(map(added.text.__getitem__, places[a:b]))[:-1].encode()).hexdigest() if some else ""
                    rows.append((-1, number, i, doc, *counts, digest, None, None, None, None))
                of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                at, of = codes[full[of]], of[full[of]]
                lengths = added.n_pairs[at]
                where = _spread((np.cumsum(added.n_pairs) - added.n_pairs)[at], lengths)
                keys, times = added.keys[where], added.times[where]
                for bucket, *data in _blocks(keys, np.repeat(of, lengths), times, own.per_bucket):
                    rows.append((bucket, number, None, None, None, None, None, None, None, *data))
                number += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WRITTEN)


def _added(blocks: DataFrame, by: list[str]) -> DataFrame:
    """One block of counts (keys, holders) per group: equal keys' holders are added up, in a sorted stream."""
    width = len(by)

    def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        return keys[order][first], np.add.reduceat(np.concatenate([n for _, n in parts])[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, pending = None, [], 0

        def done() -> pa.RecordBatch:
            keys, holders = total(parts)
            return pa.record_batch([*[pa.array([x], pa.int32()) for x in group], pa.array([packed(np.diff(keys, prepend=0))]), pa.array([packed(holders)])], [*by, "keys", "holders"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(width + 2)]
                if row[:width] != group:
                    if parts:
                        yield done()
                    group, parts, pending = row[:width], [], 0
                parts.append((np.cumsum(unpacked(row[-2])), unpacked(row[-1])))
                pending += len(parts[-1][0])
                if len(parts) > 1 and pending > 2 * len(parts[0][0]) + 1_000_000:  # what was added up stays small against what is new
                    parts = [total(parts)]
                    pending = len(parts[0][0])
        if parts:
            yield done()

    dealt = blocks.select(*by, "keys", "holders").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "".join(f"{c} int, " for c in by) + "keys binary, holders binary")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, keys, holders): how many documents hold each pair linked."""
    return _added(_added(blocks, ["bucket", "share"]), ["bucket"])


def _additions(blocks: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """slice, and of its documents (docs) what a bucket adds to n_best and count_sum."""

    names = ["slice", "docs", "n_best", "count_sum"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def contribute(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:  # a hash may leave a share empty
            return pa.table([pa.array([], t) for t in types], names=names)
        keys, holders = np.cumsum(unpacked(known["keys"][0].as_py())), unpacked(known["holders"][0].as_py())
        first = np.flatnonzero(np.diff(keys // n_b, prepend=-1))  # keys of one A id lie together
        most = np.repeat(np.maximum.reduceat(holders, first), np.diff(np.append(first, len(keys))))
        best, rows = holders == most, []
        for row in own.to_pylist():
            distinct, n = np.cumsum(unpacked(row["keys"])), unpacked(row["holders"])
            at = np.repeat(np.searchsorted(keys, distinct), n)
            docs, times = unpacked(row["docs"]), unpacked(row["times"])
            present, local = np.unique(docs, return_inverse=True)
            n_best, count_sum = np.zeros(len(present), np.int64), np.zeros(len(present), np.int64)
            np.add.at(n_best, local, times * best[at])
            np.add.at(count_sum, local, times * holders[at])
            rows.append((row["slice"], packed(present), packed(n_best), packed(count_sum)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    both = blocks.groupBy("bucket", "share").cogroup(counts.groupBy("bucket", "share"))
    return both.applyInArrow(contribute, "slice long, docs binary, n_best binary, count_sum binary")


def _summed(figures: DataFrame, additions: DataFrame) -> DataFrame:
    """The documents of each slice with their sums."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add(key: tuple, own: pa.Table, more: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        sums = {name: np.zeros(own.num_rows, np.int64) for name in ("n_best", "count_sum")}
        for row in more.to_pylist():
            docs = unpacked(row["docs"])
            for name, column in sums.items():
                column[docs] += unpacked(row[name])
        for name, column in sums.items():
            own = own.append_column(name, pa.array(column))
        return own.select(names)

    both = figures.groupBy("slice").cogroup(additions.groupBy("slice"))
    return both.applyInArrow(add, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, buckets: int = BUCKETS, share_blocks: int = SHARE_BLOCKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    written = keep(_written(docs, path_a, path_b, pattern, buckets), "postings", "none")
    blocks = written.where("bucket >= 0")
    sizes = blocks.groupBy("bucket").count()  # a row per bucket
    sizes = F.broadcast(sizes.select("bucket", F.ceil(F.col("count") / share_blocks).cast("int").alias("shares")))
    blocks = blocks.join(sizes, "bucket").withColumn("share", F.pmod(F.xxhash64("slice"), F.col("shares")).cast("int"))
    counts = keep(pair_counts(blocks), "pair-counts", "none")
    counts = counts.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "keys", "holders")
    postings = blocks.select("bucket", "share", "slice", "keys", "holders", "docs", "times")
    additions = _additions(postings, counts, n_b)
    figures = written.where("bucket = -1").select(*[c.split()[0] for c in FIGURES.split(", ")])
    return _summed(figures, additions)

