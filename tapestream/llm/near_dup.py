"""Near-duplicate documents by order min-hash, verified by banded alignment.

A text is the sequence of its five-word k-mers, each labelled with how often it occurred
before.  Each of ``bands`` sketches takes the ``minima`` labelled k-mers that rank lowest
under a hash and keeps them in text order, so sharing one is likelier the closer two texts
are in edit distance.  Exact copies are one node from the start.  Every text is aligned
with the first pivot of its buckets of equal sketches, so that families of copies never
become pairs.  What is left are buckets that hold several classes.  There each text proposes
its likeliest partners of other classes, those are aligned, classes merge, and the number
proposed grows until no text had more: then every pair of different classes of a bucket
was aligned, but for those that lengths or k-mer bitmaps rule out.  They do so exactly (a
bit that only one text has is a k-mer that can't be aligned), and the bitmaps grow with the
texts, so few pairs below the similarity get past them.  Large buckets are cut into slices,
of which two at a time meet in a task.  Texts of few k-mers, whose sketches meet too seldom,
also have the k-mers of an exact prefix filter as buckets.

Alignment: labelled k-mers are unique within a text, so the longest common subsequence is
the longest increasing run of matched positions, looked for within the band that the
similarity leaves for insertions and deletions.  Similarity is the aligned k-mers over
those of either text.

Defined results: words are what lies between ASCII blanks; texts under five words are one
k-mer; null is an empty text, and all texts without words are one class; texts of one
doc_id are one class, but each class of texts keeps a row, so no text is lost; rows without
doc_id get a null class and stay; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .components import connected_components, local_stars
from .packing import text_batches
from .store import keep

WORDS = 5
#: Partners a text proposes at first in each bucket, and the factor by which that grows.
PARTNERS, GROWTH = 2, 64
#: Texts of fewer k-mers than this find all that are similar, by a prefix filter.
SHORT = 10
#: Bits of a text's bitmap for each k-mer, at least.
SPREAD = 8
#: K-mers (each row counts as 100 more) of a bucket's slice.
SLICE = 3_000_000
#: More nodes than this aren't broadcast to pick their texts.
BROADCAST_NODES = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labelled_kmers(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's k-mers in order, each with its occurrence number mixed in."""
    split = (text or "").encode().split()
    w = np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split))
    k = max(1, len(w) - words + 1)
    width = len(w) - k + 1
    h = np.full(k if len(w) else 0, width, np.uint64)
    for j in range(width if len(w) else 0):
        h = h * _STEP + w[j : j + k]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        place = np.arange(len(h))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
        h[order] += (place - first).astype(np.uint64) * _STEP
        h = _mixed(h)
    else:
        h = _mixed(h)
    return h


def order_sketches(kmers: np.ndarray, bands: int, minima: int) -> np.ndarray:
    """A value per band: the lowest-ranked k-mers in text order. Texts without k-mers share theirs."""
    odd = np.random.default_rng(20).integers(1, 2**63, (2, bands, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(kmers) > minima:
        ranks = (kmers ^ odd[0]) * odd[1]
        at = np.sort(np.argpartition(ranks, minima - 1, axis=1)[:, :minima], axis=1)
        chosen = kmers[at]
    else:
        chosen = np.broadcast_to(kmers, (bands, len(kmers)))
    value = odd[0][:, 0]
    for j in range(chosen.shape[1]):
        value = _mixed(value * _STEP + chosen[:, j])
    return value.view(np.int64)


def prefix_keys(kmers: np.ndarray, least: float) -> np.ndarray:
    """Of a short text, the lowest k-mers, one of which any text that is similar has among its own lowest."""
    n = len(kmers)
    if not n or n * least >= SHORT:
        return np.zeros(0, np.int64)
    return _mixed(np.sort(kmers)[: n - int(np.ceil(least * n - 1e-9)) + 1] ^ _STEP).view(np.int64)


def bitmap_size(n: int) -> int:
    """Bits for n k-mers: the next power of two above SPREAD times as many."""
    return max(64, 1 << (SPREAD * n).bit_length())


def bitmap(kmers: np.ndarray, size: int = 1024) -> bytes:
    bits = np.zeros(size, bool)
    bits[(kmers & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_align(bits: np.ndarray, n: np.ndarray, rows: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether texts (0/1 bitmaps of one size, numbers of k-mers) can reach ``least``: never false for a pair that does."""
    both = bits[rows] @ bits[others].T
    return _most(both, n[rows][:, None], bits[rows].sum(1)[:, None], n[others][None, :], bits[others].sum(1)[None, :]) >= least - 1e-6


def _most(both: np.ndarray, a: np.ndarray, a_set: np.ndarray, b: np.ndarray, b_set: np.ndarray) -> np.ndarray:
    """An upper bound on the similarity of texts of a and b k-mers, of whose set bits they share ``both``."""
    most = np.minimum(a - (a_set - both), b - (b_set - both))
    return most / np.maximum(a + b - most, 1)


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned k-mers over all k-mers, or 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    # s = l / (n + m - l) >= least leaves n + m - 2 l insertions and deletions at most
    band = (n + m) * (1 - least) / (1 + least) + 1e-9
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    j = j[inside][np.argsort(i[inside])]
    if len(j) > 1 and (np.diff(j) < 0).any():
        ends: list[int] = []
        for x in j.tolist():
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
            else:
                ends[k] = x
        aligned = len(ends)
    else:
        aligned = len(j)
    return aligned / (n + m - aligned)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _sketch(docs: DataFrame, bands: int, minima: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                kmers = [labelled_kmers(t) for t in batch.column(1).to_pylist()]
                rows = [np.concatenate([order_sketches(k, bands, minima), prefix_keys(k, least)]) for k in kmers]
                flat = pa.array(np.concatenate(rows), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)
                yield pa.record_batch([batch.column(0), batch.column(2), lists], ["doc_id", "digest", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest("text").alias("digest"))
    found = rows.mapInArrow(run, "doc_id long, digest binary, sketch array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _bitmaps(texts: DataFrame) -> DataFrame:
    """node, n (k-mers) and bits of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                kmers = [labelled_kmers(t) for t in batch.column(1).to_pylist()]
                bits = [bitmap(k, bitmap_size(len(k))) for k in kmers]
                yield pa.record_batch([batch.column(0), pa.array(map(len, kmers), pa.int64()), pa.array(bits, pa.binary())], ["node", "n", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, bits binary")


def likeliest(n: np.ndarray, label: np.ndarray, bits: list[bytes], side: np.ndarray, least: float, partners: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (i, j) with label i < label j that may reach ``least``: for each i its ``partners`` likeliest j.

    side: 0 or 1; where both occur, only pairs of the two sides count, i being of side 0, in either order of
    labels.  Texts without k-mers are never alike another class.  Last: whether an i had more.
    """
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    two = bool(side.any() and not side.all())
    order = np.argsort(label, kind="stable")
    order = order[n[order] > 0]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    cut = False
    for size in np.unique(sizes):
        rows = order[(sizes[order] == size) & ((side[order] == 0) | (not two))]
        near: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in rows]
        for other in (size // 2, size, size * 2):
            there = order[(sizes[order] == other) & ((side[order] == 1) | (not two))]
            if not len(rows) or not len(there):
                continue
            x, y = _packed([bits[r] for r in rows], other < size), _packed([bits[r] for r in there], other > size)
            x_set, y_set = (np.bitwise_count(m).sum(1).astype(np.float32) for m in (x, y))
            m, labels, ones = n[there].astype(np.float32), label[there], np.ones(x.shape[1], np.float32)
            for r, (i, own) in enumerate(zip(rows, n[rows].astype(np.float32))):
                some = (m >= least * own) & (least * m <= own) & ((labels != label[i]) if two else (labels > label[i]))
                j = np.flatnonzero(some)
                if len(j):
                    bound = _most(np.bitwise_count(x[r] & y[j]).astype(np.float32) @ ones, own, x_set[r], m[j], y_set[j])
                    close = bound >= least - 1e-6
                    near[r].append((bound[close], there[j[close]]))
        for i, parts in zip(rows, near):
            if parts:
                bound, j = (np.concatenate(x) for x in zip(*parts))
                if len(j) > partners:
                    cut, j = True, j[np.argpartition(-bound, partners - 1)[:partners]]
                found.append((np.full(len(j), i), j))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j, cut


def _packed(bits: list[bytes], half: bool) -> np.ndarray:
    """Bitmaps as rows of words, or, with ``half``, what bitmaps of half the size would be."""
    m = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    return m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :] if half else m


def _partners(mixed: DataFrame, groups: int, least: float, partners: int) -> DataFrame:
    """(node, pivot, a, b) of the likeliest pairs of each mixed bucket, once each, with their labels; ``cut``: there are more.

    A task takes many small buckets, or two slices of a large one, at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("key", "i", "j")]))
        keys = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        node, label, n, side = (table.column(c).to_numpy() for c in ("node", "label", "n", "side"))
        bits = table.column("bits").to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
            own = slice(first, last)
            x, y, cut = likeliest(n[own], label[own], bits[own], side[own], least, partners)
            for column, values in zip(out, (node[own][x], node[own][y], label[own][x], label[own][y], np.full(len(x), cut))):
                column.append(values)
        x, y, a, b, cut = map(np.concatenate, out)
        swap = x < y
        pair = {"node": np.where(swap, y, x), "pivot": np.where(swap, x, y), "a": np.where(swap, b, a), "b": np.where(swap, a, b)}
        return pa.table({**pair, "cut": cut})

    slices = F.col("slices").cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), slices).cast("int")
    several = F.transform(F.sequence(F.lit(0), slices - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).cast("int").alias("side")))
    dealt = mixed.select("key", "node", "label", "n", "bits", F.inline(several)).withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    found = dealt.groupBy("g").applyInArrow(run, "node long, pivot long, a long, b long, cut boolean")
    return found.groupBy("node", "pivot").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("cut").alias("cut"))


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (node, pivot, and the labels a and b of both) with whether their texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kmers = None, None
        for whole in batches:
            for batch in text_batches(whole.select(["pivot", "own", "node", "other", "a", "b"]), 500):
                linked = []
                for pivot, own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                    if last != pivot:
                        last, kmers = pivot, labelled_kmers(other)
                    linked.append(alignment_similarity(labelled_kmers(own), kmers, least) >= least - 1e-12)
                yield pa.record_batch([batch.column(2), batch.column(0), batch.column(4), batch.column(5), pa.array(linked, pa.bool_())], ["node", "pivot", "a", "b", "linked"])

    own = pairs.join(texts.withColumnRenamed("text", "own"), "node")
    both = own.join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("other")), "pivot")
    return both.select("pivot", "own", "node", "other", "a", "b").mapInArrow(run, "node long, pivot long, a long, b long, linked boolean")


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    return keep(_verify(pairs, texts, least).where("linked"), "links")


def _moves(edges: DataFrame) -> DataFrame:
    """(label, _to) of the labels that the edges (src, dst) join with smaller ones."""
    moves = keep(connected_components(local_stars(edges)).where("node <> component").toDF("label", "_to"), "moves")
    return F.broadcast(moves) if moves.count() <= BROADCAST_NODES else moves


def _relabelled(rows: DataFrame, moves: DataFrame) -> DataFrame:
    return rows.join(moves, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def _several(of: DataFrame) -> DataFrame:
    """The rows (key, node, label) of buckets that hold several labels."""
    several = of.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return keep(of.join(several.select("key"), "key"), "mixed")


def _sliced(of: DataFrame, maps: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their texts' n and bits, and into how many slices their bucket is to be cut; and how many groups that makes."""
    rows = of.join(maps, "node")
    size = F.sum(F.col("n") + 100)
    sizes = of.join(maps.select("node", "n"), "node").groupBy("key").agg(size.alias("size"), F.ceil(size / SLICE).alias("slices"))
    sizes = keep(sizes, "sizes")
    total = sizes.agg(F.sum(F.col("size") * F.col("slices")).alias("t")).first()["t"] or 0
    large = sizes.where("slices > 1").select("key", "slices")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_NODES else large, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    return rows, max(1, 8 * int(total) // SLICE)


def _text_classes(docs: DataFrame, least: float, bands: int, minima: int) -> tuple[DataFrame, DataFrame]:
    """Rows with doc_id as (doc_id, digest, node, label), node standing for the text; and those without (doc_id)."""
    rows = keep(_sketch(docs, bands, minima, least), "sketches")
    lost, rows = rows.where("doc_id is null").select("doc_id"), rows.where("doc_id is not null")
    firsts = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "row", "sketch"), F.struct("doc_id", "row")).alias("f"))
    nodes = keep(firsts.select(F.col("f.row").alias("node"), "digest", F.col("f.doc_id").alias("doc_id"), "f.sketch"), "nodes")
    keys = nodes.select("node", F.explode(F.array_distinct("sketch")).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("count")).where("count > 1")
    shared = keep(keys.join(buckets, "key").select("key", "node", "pivot"), "shared")
    wanted = nodes.select("node", F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc"))
    wanted = keep(wanted.join(shared.select("node").distinct(), "node", "left_semi"), "wanted")
    own = (F.col("_doc") == F.col("doc_id").cast("long")) & (F.col("_digest") == _digest("text"))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, own)
    texts = keep(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    first = shared.groupBy("node").agg(F.min("pivot").alias("pivot")).where("node <> pivot")
    pairs = keep(first.select("node", "pivot", F.col("node").alias("a"), F.col("pivot").alias("b")), "pairs")
    moves = _moves(_links(pairs, texts, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labels = _relabelled(nodes.select("node", F.col("node").alias("label")), moves)
    of = _several(_relabelled(shared.select("key", "node", F.col("node").alias("label")), moves))
    maps = keep(_bitmaps(texts.join(of.select("node").distinct(), "node", "left_semi")), "bitmaps")
    partners, more = PARTNERS, True
    while more:
        close = keep(_partners(*_sliced(of, maps), least, partners), "close")
        more = not close.where("cut").isEmpty()
        edges = keep(_links(close, texts, least).select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "merges")
        if not edges.isEmpty():
            moves = _moves(edges)
            labels, of = _relabelled(labels, moves), _relabelled(of, moves)
            of = _several(of) if more else of
        partners *= GROWTH
    placed = rows.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").join(labels, "node")
    return keep(placed.select("doc_id", "digest", "node", "label"), "placed"), lost


def near_duplicate_classes(docs: DataFrame, least: float = 0.8, bands: int = 24, minima: int = 4) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size (rows) and kept for each row of docs.

    kept: the row's doc_id and text are the first of those whose texts are alike.  A pair at
    similarity 0.8 shares no sketch of the 24 with a chance of 5 in a million.
    """
    placed, lost = _text_classes(docs, least, bands, minima)
    texts = placed.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("rows"))
    several = keep(placed.groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high"), "several")
    if several.isEmpty():
        classes = texts.select("label", "first", F.col("first.doc_id").alias("class_id"), F.col("rows").alias("class_size"))
    else:  # a doc_id's texts are one class
        edges = placed.join(several, "doc_id").select(F.col("label").alias("src"), F.col("low").alias("dst"))
        joint = connected_components(edges).withColumnsRenamed({"node": "label", "component": "joint"})
        groups = keep(texts.join(joint, "label", "left").withColumn("joint", F.coalesce("joint", "label")), "groups")
        whole = groups.groupBy("joint").agg(F.min("first.doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
        classes = groups.join(whole, "joint").select("label", "first", "class_id", "class_size")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    out = placed.join(classes, "label").select("doc_id", "class_id", "class_size", kept.alias("kept"))
    none = F.lit(None).cast("long")
    return out.union(lost.select("doc_id", none, none, F.lit(False)))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 24, minima: int = 4) -> DataFrame:
    """The first row of each class of alike texts, of equal rows one; rows without doc_id stay."""
    placed, _ = _text_classes(docs, least, bands, minima)
    texts = placed.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    both = placed.groupBy("label", "doc_id", "digest", "node").count().join(texts, "label")
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    names = {"doc_id": "_doc", "digest": "_digest"}
    odd = keep(both.where(~own | (F.col("count") > 1)).select("doc_id", "digest", own.alias("_once")).withColumnsRenamed(names), "odd")
    small = odd.count() <= BROADCAST_NODES
    same = (F.col("_d.doc_id").cast("long") == F.col("_doc")) & (_digest("_d.text") == F.col("_digest"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")).join(F.broadcast(odd) if small else odd, same, "left").where("_once is null or _once")
    if odd.where("_once").isEmpty():
        return marked.select("_d.*")
    repeated = marked.where("_once").dropDuplicates(["_doc", "_digest"])
    return marked.where("_once is null").select("_d.*").union(repeated.select("_d.*"))
