"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words, lower-cased and stripped of marks, and their beginnings of
four to seven letters, so that a stem counts whatever follows; each term is a feature for
each of ``COUNTS`` it reaches.  Terms are hashed.  The machine scores
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j: pairs of terms that are toxic only together
get weight that a linear model can't give them.

It is fitted on a bounded sample of labelled rows (``most_of_each`` of each label, in hash
order): Spark ranks the sample's features by their G statistic, and only each row's best
features leave the executors, never its text; weights are learned by Adam on mini-batches, and the intercept is set so that 0.7 is the
cut that does best on rows left out of the fit.  Every document is scored, in parallel.

Defined results: null is an empty text, which gets the score of no features; repeated rows
get equal scores; of a labelled doc_id with several texts the smallest is learned from; null doc_ids are never learned from and are not held out; without labelled rows of
both kinds every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .packing import text_batches
from .store import keep

COUNTS = (1, 2, 3)
BUCKETS = 1 << 24
CUT = 0.7


def stripped(word: str) -> str:
    """The word from its first letter or digit to its last."""
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]


def terms(word: str) -> list[int]:
    """Hashes of the word and its beginnings."""
    word = stripped(word.lower())
    if not word:
        return []
    parts = {word + "$"} | {word[:n] for n in range(4, 8) if len(word) > n}
    return [xxh3_64_intdigest(p) % BUCKETS for p in parts]


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Which of the batch's distinct words stand where, the words, and the bounds of each text."""
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
    first = split.offsets[0].as_py()
    coded = split.values.slice(first).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), split.offsets.to_numpy() - first


def feature_lists(texts: pa.Array, known: dict[int, int] | None = None) -> list[np.ndarray]:
    """Each text's features; with ``known`` only those, by their places in it."""
    codes, distinct, bounds = _words(texts)
    if known is None:
        of = [terms(w) for w in distinct]
    else:
        stems = {f // len(COUNTS) for f in known}
        of = [[t for t in terms(w) if t in stems] for w in distinct]
    some = np.fromiter(map(bool, of), bool, len(of))
    at = np.flatnonzero(some[codes]) if len(codes) else np.zeros(0, np.int64)
    cut = np.searchsorted(at, bounds)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        counts = Counter(t for c in codes[at[a:b]].tolist() for t in of[c])
        found = [t * len(COUNTS) + k for t, n in counts.items() for k, least in enumerate(COUNTS) if n >= least]
        if known is not None:
            found = [known[f] for f in found if f in known]
        out.append(np.array(sorted(found), np.int32))
    return out


class FactorizationMachine:
    """Binary features, logistic loss."""

    def __init__(self, n: int, factors: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(n + 1), rng.normal(0, 0.05, (n + 1, factors))
        self.v[n] = 0  # the last row pads
        self.rng = rng

    def raw(self, padded: np.ndarray) -> np.ndarray:
        v = self.v[padded]
        return self.bias + self.w[padded].sum(1) + 0.5 * (v.sum(1) ** 2 - (v**2).sum(1)).sum(1)

    def fit(self, padded: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-3) -> None:
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), self.w, self.v)]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(self.rng.permutation(len(y)), max(1, len(y) // batch)):
                x = padded[rows]
                error = (1 / (1 + np.exp(-self.raw(x))) - y[rows]) / len(rows)
                v = self.v[x]
                gv = error[:, None, None] * (v.sum(1, keepdims=True) - v)
                gw, gf = decay * self.w / 10, decay * self.v
                np.add.at(gw, x, np.broadcast_to(error[:, None], x.shape))
                np.add.at(gf, x, gv)
                gw[-1] = gf[-1] = 0
                step += 1
                for (m, s), p, g in zip(moments, (None, self.w, self.v), (np.array([error.sum()]), gw, gf)):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    change = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                    if p is None:
                        self.bias -= float(change[0])
                    else:
                        p -= change
        self.w[-1] = self.v[-1] = 0


def _padded(lists: list[np.ndarray], n: int) -> np.ndarray:
    width = max(1, max(map(len, lists), default=1))
    out = np.full((len(lists), width), n, np.int64)
    for row, own in zip(out, lists):
        row[: len(own)] = own
    return out


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_of_each: int) -> DataFrame:
    """doc_id, toxic, spare (to be left out of the fit) and features of at most ``most_of_each`` rows of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                lists = pa.array(feature_lists(batch.column(1)), pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), lists], ["doc_id", "toxic", "spare", "features"])

    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~_held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_of_each).union(known.where("toxic <> 1").orderBy(order, "doc_id").limit(most_of_each))
    spare = F.crc32(F.concat(F.lit("spare"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic"), spare.alias("spare"))
    return keep(rows.mapInArrow(run, "doc_id long, toxic int, spare boolean, features array<int>"), "sample-features")


def telling_features(rows: DataFrame, features: int) -> dict[int, int]:
    """The features of rows (toxic, features) with the highest G statistics, above 8, and their places."""
    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    stats = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b")).where("a + b >= 5")
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = part(F.col("a"), n1 * share) + part(F.col("b"), n0 * share) + part(n1 - F.col("a"), n1 * (1 - share)) + part(n0 - F.col("b"), n0 * (1 - share))
    best = stats.select("f", g.alias("g")).where("g > 8").orderBy(F.desc("g"), "f").limit(features).collect()
    return {f: i for i, f in enumerate(sorted(r.f for r in best))}


def fit(docs: DataFrame, labels: DataFrame, most_of_each: int = 4000, features: int = 2000, factors: int = 8) -> tuple[dict[int, int], FactorizationMachine] | None:
    rows = sample(docs, labels, most_of_each)
    seen = {r.toxic for r in rows.where("not spare").select("toxic").distinct().collect()}
    if seen != {0, 1}:
        return None
    known = telling_features(rows.where("not spare"), features)
    wanted = F.array(*map(F.lit, known)).cast("array<int>")
    own = rows.select("doc_id", "toxic", "spare", F.array_intersect("features", wanted).alias("own")).toPandas().sort_values("doc_id")  # 2 * most_of_each rows at most
    y, spare = own["toxic"].to_numpy(float), own["spare"].to_numpy(bool)
    x = _padded([np.array(sorted(known[f] for f in fs), np.int64) for fs in own["own"]], len(known))
    machine = FactorizationMachine(len(known), factors)
    machine.fit(x[~spare], y[~spare])
    raw = machine.raw(x[spare]) if spare.any() else machine.raw(x)
    truth = y[spare] if spare.any() else y
    cuts = np.quantile(raw, np.linspace(0, 1, 401))
    hits = (raw[:, None] >= cuts) * 1.0
    f1 = 2 * (hits * truth[:, None]).sum(0) / np.maximum(hits.sum(0) + truth.sum(), 1)
    good = cuts[f1 >= f1.max() - 1e-12]
    machine.bias += float(np.log(CUT / (1 - CUT)) - (good.min() + good.max()) / 2)
    return known, machine


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    fitted = fit(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                if fitted is None:
                    values = np.zeros(batch.num_rows)
                else:
                    known, machine = fitted
                    values = 1 / (1 + np.exp(-machine.raw(_padded(feature_lists(batch.column(1), known), len(known)))))
                yield pa.record_batch([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
