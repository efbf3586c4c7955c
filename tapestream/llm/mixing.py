"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words; none gets more than ``most`` times its own, and the excess is
shared anew by weight.  That is one level L with targets min(weight * L, most * size), found
by a few aggregates, each with more sources at their most.

Blocks: documents of a source are hashed into blocks of about ``block_words`` words, so the
largest source is many small groups.  A source's draws are its blocks in one keyed order
for each pass over it, until its target is met to the word; the block where it ends is
taken in part.

The report's columns depend on the order of blocks alone; which shard has a draw, and so the
tree, decides where it is written.

Shards: a binary tree parts the vector of the sources' draw counts.  At each node the left
half's counts are a multivariate hypergeometric sample of the node's, seeded by the node, so
each shard's task walks down to its own leaf alone and all leaves together use every draw
once.  Shards are then shuffled locally by a keyed order.  More sources than ``WIDEST`` are
split in two steps: groups of sources among the shards, then each group's sources among its
shares of them; that is the same distribution.

Defined results: a word is what lies between ASCII blanks; null texts have size 0 and
nothing is taken of them; null is a source; rows of equal
doc_id, source and text are one document to the mix, also where other columns differ; an empty table gives no rows; reruns give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import WORD
from .store import keep

#: Sources, or groups of them, whose draw counts one task holds.
WIDEST = 100_000
#: Sums that the library's multivariate hypergeometric sampler takes.
LIBRARY_DRAWS = 10**9
#: A source's draws are put in order in so many parts.
PARTS_BITS = 6
#: Sources up to this number are broadcast to their documents.
BROADCAST_SOURCES = 500_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_key(docs: DataFrame) -> Column:
    """128 bits of doc_id, source and text; null differs from any value."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(" "), c), F.lit("n "))

    return F.md5(F.concat(*[part(F.col(c).cast("string")) for c in ("doc_id", "source", "text")]))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with n_source, their place (from 1) in code point order, null last: ranges, and a count for each."""
    last = F.col("source").isNull()
    ranged = sources.repartitionByRange(last, F.coalesce("source", F.lit(""))).withColumn("_part", F.spark_partition_id())
    ranged = keep(ranged, "ranged")
    parts = ranged.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(F.broadcast(parts), "_part").select(*sources.columns, (F.col("_before") + place).alias("n_source"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target and n_source of each source of sizes (source, size)."""
    rows = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("n_source") - 1) % len(weights)).cast("int")).cast("double")
    rows = keep(rows.withColumns({"_weight": weight, "_cap": most * F.col("source_size")}), "weighed")
    total, level, full = share * float(rows.agg(F.sum("source_size")).first()[0] or 0), -1.0, 0
    while True:
        over = F.col("_weight") * level > F.col("_cap")
        now, caps, weighs = rows.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if level >= 0 and now == full or not weighs:
            break
        level, full = (total - (caps or 0.0)) / weighs, now
    target = F.least(F.col("_weight") * level, F.col("_cap")) if weighs else F.col("_cap")
    return rows.select("source", "source_size", target.alias("target"), "n_source")


def left_part(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without replacement are of each source: a multivariate hypergeometric sample.

    The library draws it for less than 10^9 in all.  Beyond, each draw goes left with the same
    chance, and what is too much or too little is put right by draws from those on one side:
    by symmetry what lies left is any subset of n draws with equal chance.
    """
    total = int(counts.sum())
    if total < LIBRARY_DRAWS:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    left = rng.binomial(counts, n / total)
    surplus = int(left.sum()) - n
    side = left if surplus > 0 else counts - left
    ends = np.cumsum(side)
    chosen = np.zeros(0, np.int64)
    while len(chosen) < abs(surplus):  # distinct draws of that side, in order of choice
        more = np.concatenate([chosen, rng.integers(0, int(ends[-1]), abs(surplus) - len(chosen))])
        chosen = more[np.sort(np.unique(more, return_index=True)[1])]
    moved = np.bincount(np.searchsorted(ends, chosen, side="right"), minlength=len(counts))
    return left - moved if surplus > 0 else left + moved


def leaf_counts(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of each source in one shard, found on the way down the tree."""
    counts, first = quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    whole = int(counts.sum())
    bounds = lambda s: whole * s // shards  # noqa: E731  shards get equal numbers of draws
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = left_part(rng, counts, bounds(middle) - bounds(low))
        if shard < middle:
            counts, high = left, middle
        else:
            first, counts, low = first + left, counts - left, middle
    return first, counts


def shares(quotas: np.ndarray, room: np.ndarray, seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, first draw and number of draws of each source, where shard i has ``room[i]`` of all draws: the whole tree."""
    upto = np.concatenate([[0], np.cumsum(room)])
    todo = [(0, len(room), np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while todo:
        low, high, first, counts = todo.pop()
        if not counts.any():
            continue
        if high - low == 1:
            yield low, first, counts
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([*seed, low, high])
        left = left_part(rng, counts, int(upto[middle] - upto[low]))
        todo += [(middle, high, first + left, counts - left), (low, middle, first, left)]


DEALT = "n_source long, draw long, shard long"


def _listed(numbers: np.ndarray, first: np.ndarray, own: np.ndarray, shard: int) -> pa.RecordBatch:
    draw = np.arange(own.sum()) + np.repeat(first - (np.cumsum(own) - own), own)
    return pa.record_batch([pa.array(np.repeat(numbers, own), pa.int64()), pa.array(draw, pa.int64()), pa.array(np.full(len(draw), shard), pa.int64())], ["n_source", "draw", "shard"])


def _by_shard(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(n_source, draw, shard) for each draw of quotas (n_source, count; WIDEST rows at most), from one small task per shard."""
    rows = quotas.orderBy("n_source").toPandas()
    numbers, counts = rows["n_source"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield _listed(numbers, *leaf_counts(counts, shard, shards, seed), shard)

    return quotas.sparkSession.range(shards).mapInArrow(run, DEALT)


def _dealt(draws: DataFrame, shards: int, seed: int, widest: int = WIDEST) -> DataFrame:
    """(n_source, draw, shard) for each draw."""
    quotas = keep(draws.groupBy("n_source").count(), "quotas")
    if (n := quotas.count()) <= widest:
        return _by_shard(quotas, shards, seed)
    groups = -(-n // widest) * 4  # groups of sources stay below the bound too; their number is this one's n
    quotas = quotas.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), "n_source"), F.lit(groups)))
    rooms = _by_shard(quotas.groupBy(F.col("_g").alias("n_source")).agg(F.sum("count").alias("count")), shards, seed)
    rooms = rooms.groupBy(F.col("n_source").alias("_g"), "shard").count()

    def split(key: tuple, own: pa.Table, room: pa.Table) -> pa.Table:
        own, room = own.sort_by("n_source"), room.sort_by("shard")
        numbers, counts, at = own["n_source"].to_numpy(), own["count"].to_numpy(), room["shard"].to_numpy()
        parts = [_listed(numbers, first, n, int(at[i])) for i, first, n in shares(counts, room["count"].to_numpy(), [seed, key[0].as_py()])]
        return pa.Table.from_batches(parts, pa.schema([(c, pa.int64()) for c in ("n_source", "draw", "shard")]))

    return quotas.groupBy("_g").cogroup(rooms.groupBy("_g")).applyInArrow(split, DEALT)


def takes(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 100_000,
    shard_blocks: int = 64,
    seed: int = 7,
    whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as (row, doc_id, size, source_size, target), and what is drawn as (row, shard, place, taken).

    ``row`` stands for doc_id, source and text.  ``whole`` takes a document at the cut wholly or not.
    """
    sizes = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    sizes = keep(sizes, "sizes")
    sources = keep(targets(sizes, weights, share, most), "sources").withColumnRenamed("source", "_source")
    small = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    placed = sizes.join(small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("source", "_source")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))
    placed = keep(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), blocks)), "placed")

    totals = placed.groupBy("n_source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    passes = totals.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1))))
    order = F.xxhash64(F.lit(seed), "epoch", "n_source", "block")
    passes = keep(passes.withColumns({"order": order, "part": F.shiftright(order, 64 - PARTS_BITS)}), "passes")
    # the largest source's blocks are put in order by many tasks: part by part of their hashes
    sums = passes.groupBy("n_source", "epoch", "part").agg(F.sum("words").alias("part_words"), F.count_if(F.col("words") > 0).alias("part_draws"))
    ahead = Window.partitionBy("n_source").orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("n_source", "epoch", "part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("part_words", "part_draws")])
    within = Window.partitionBy("n_source", "epoch", "part").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, 0)
    # blocks of no words stay out, and draws are numbered without gaps
    draws = passes.where("words > 0").join(sums, ["n_source", "epoch", "part"])
    draws = draws.withColumns({"start": F.col("part_words") + F.sum("words").over(within) - F.col("words"), "draw": F.col("part_draws") + F.count("*").over(within) - 1})
    draws = draws.withColumn("room", F.least(F.round("target").cast("long") - F.col("start"), F.col("words"))).where("room > 0")
    draws = keep(draws.select("n_source", "block", "draw", "epoch", "room", "words"), "draws")
    shards = max(1, -(-draws.count() // shard_blocks))
    draws = draws.join(_dealt(draws, shards, seed), ["n_source", "draw"])

    within = Window.partitionBy("n_source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where("size > 0").withColumn("at", F.sum("size").over(within) - F.col("size"))
    taken = F.least(F.col("size"), F.col("room") - F.col("at"))
    if whole:
        taken = F.when(2 * taken >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    drawn = inside.join(draws, ["n_source", "block"]).withColumn("taken", taken.cast("long")).where("taken > 0")
    place = F.xxhash64(F.lit(seed + 2), "epoch", "row")
    return placed.select("row", "doc_id", "size", "source_size", "target"), drawn.select("row", "shard", place.alias("place"), "taken")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs, and how many shards have it.

    Rows of equal doc_id, source and text share what is taken of them evenly; the first get the rest.
    """
    rows, drawn = takes(docs, **options)
    sums = drawn.groupBy("row").agg(F.sum("taken").alias("all"), F.count_distinct("shard").alias("n_shards"))
    same = Window.partitionBy("row")
    both = rows.join(sums, "row", "left").withColumns({"n": F.count("*").over(same), "k": F.row_number().over(same.orderBy("doc_id"))})
    taken = F.coalesce(F.floor(F.col("all") / F.col("n")) + F.when(F.col("k") <= F.col("all") % F.col("n"), 1).otherwise(0), F.lit(0))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs, whole documents, as often as they are drawn, by shard in shuffled order."""
    _, drawn = takes(docs, whole=True, **options)
    drawn = keep(drawn, "drawn")
    texts = docs.select(row_key(docs).alias("row"), F.struct(*docs.columns).alias("doc")).dropDuplicates(["row"])
    return texts.join(drawn, "row").repartition("shard").sortWithinPartitions("shard", "place").select("doc.*")
