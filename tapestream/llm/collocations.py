"""Phrases of words that stand together more often than their parts let expect.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into
words at spaces and tabs.  Phrases of 2 to ``longest`` words are counted level by level, as
in Apriori: the frequent words are numbered and sent to the workers, texts become runs of
these numbers, and a phrase of k words is emitted only where both phrases of k - 1 words
within it are frequent, as the pair of their numbers.  Workers add up what they see before
anything is shuffled, so the commonest phrase is a few rows a task.

What is sent to the workers is counted first.  Levels of more than ``MOST_SENT`` entries are
not sent; all levels are then counted as strings, by a plain aggregation without the filter.

A phrase is cut in two at each place; with its count a and those of the parts l and r its
score is floor(2 * scale * a / (l + r)), of the cut that scores least (ties: the first).
Phrases within a longer frequent one that has ``absorbed`` per cent of their occurrences go;
it is enough to look one word further, since what lies between is as frequent.

Defined results: null is an empty text, a null lang is ``und``; counts are of occurrences,
overlapping ones too, within pieces; repeated rows count each time; ties of rank go by count,
then by the phrase's bytes; products are taken as decimals; an empty table gives no rows;
other columns are ignored.  Words are told apart by 128 bits of hash while they are numbered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .packing import text_batches
from .segments import compact
from .store import forget, keep

#: Entries of a level that are sent to every worker (16 bytes a word, 8 a phrase); beyond, levels are counted by shuffles.
MOST_SENT = 4_000_000
#: Entries that a worker adds up before it lets them go, and how many it hands on at a time.
HELD, AT_ONCE = 1_000_000, 100_000
#: A lang's phrases are ranked in so many shares, then the best of them.
RANK_SHARES = 32
#: Counts up to this number of rows are broadcast to the cuts that ask for them.
BROADCAST_COUNTS = 500_000
NO_LANG = "und"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVEL = "lang string, phrase string, k int, f long"


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Which distinct word stands where (-1: the end of a piece), the distinct words, and the text of each."""
    lower = pc.ascii_lower(compact(texts))
    apart = pc.replace_substring_regex(pc.replace_substring(lower, "\t", " "), r"[.,;:!?\n\v\f\r]", " \n ")
    split = pc.split_pattern(pc.binary_join_element_wise(apart, pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string())), " ")
    first = split.offsets[0].as_py() if len(texts) else 0
    coded = split.values.slice(first).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    number = np.array([-2 if not w else -1 if w == "\n" else i for i, w in enumerate(distinct)], np.int64)
    codes = number[codes] if len(codes) else np.zeros(0, np.int64)
    return codes[codes > -2], distinct, of[codes > -2]


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """Of each word or end, the place of (lang, word) in a table langs by words; the langs and words, and which are words."""
    codes, words, of = words_of(batch.column(1))
    langs = pc.fill_null(batch.column(0).cast(pa.string()), NO_LANG).dictionary_encode()
    own = langs.indices.to_numpy(zero_copy_only=False)[of]
    return own * np.int64(len(words)) + codes, langs.dictionary.to_pylist(), words, codes >= 0


def _word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, f) of frequent words, and with a null word the number of all words of each lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def emit() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, counts in found.items() for word, n in counts.items()]
            found.clear()
            columns = list(zip(*rows)) if rows else [(), (), ()]
            return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "f"])

        for whole in batches:
            for batch in text_batches(whole):
                keys, langs, words, real = _coded(batch)
                places, counts = np.unique(keys[real], return_counts=True)
                for lang, i, n in zip((places // len(words)).tolist(), (places % len(words)).tolist(), counts.tolist()):
                    own = found.setdefault(langs[lang], Counter())
                    own[words[i]] += n
                    own[None] += n
                if sum(map(len, found.values())) > HELD // 4:  # words are larger than numbers
                    yield emit()
        yield emit()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("word").isNull() | (F.col("f") >= least))


class WordNumbers:
    """Numbers from 1 of frequent words, by 128 bits of hash; others are 0."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        order = np.lexsort([low, high])
        self.high, self.low = high[order], low[order]
        self.several = bool((self.high[1:] == self.high[:-1]).any())

    @staticmethod
    def hashes(pairs: list[tuple[str, str]], seed: int) -> tuple[np.ndarray, np.ndarray]:
        found = [xxh3_128_intdigest(f"{lang}\t{word}", seed) for lang, word in pairs]  # no word has a tab
        return np.array([x >> 64 for x in found], np.uint64), np.array([x & (1 << 64) - 1 for x in found], np.uint64)

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        if not len(self.high):
            return np.zeros(len(high), np.int64)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), at + 1, 0)


def _number(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places from 1 of the keys in known, which is sorted; others and 0 are 0."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), np.int64)
    distinct, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return np.where(known[at] == distinct, at + 1, 0)[back]


def _joined(numbers: np.ndarray) -> np.ndarray:
    """A key for each place that starts two numbers above 0 next to each other; else 0."""
    first, second = numbers[:-1], numbers[1:]
    return np.where((first > 0) & (second > 0), first << 32 | second, 0)


def _numbered_words(frequent: DataFrame) -> tuple[DataFrame, WordNumbers, int]:
    """(number, lang, phrase, f) of frequent words, and what numbers them."""
    seed = 0
    while True:

        def hashed(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                high, low = WordNumbers.hashes(list(zip(*(batch.column(c).to_pylist() for c in range(2)))), seed)
                yield pa.record_batch([pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["high", "low"])

        sent = frequent.select("lang", "word").mapInArrow(hashed, "high long, low long").toArrow()  # MOST_SENT rows at most
        numbers = WordNumbers(*(sent.column(c).to_numpy().view(np.uint64) for c in range(2)))
        if not numbers.several:
            break
        seed += 1

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = numbers(*WordNumbers.hashes(list(zip(*(batch.column(c).to_pylist() for c in range(2)))), seed))
            yield pa.record_batch([pa.array(found), *batch.columns], ["number", "lang", "phrase", "f"])

    return frequent.select("lang", "word", "f").mapInArrow(named, "number long, lang string, phrase string, f long"), numbers, seed


def _encoded(docs: DataFrame, numbers: WordNumbers, seed: int) -> DataFrame:
    """A row per slice of texts: the numbers of its words as int32; 0 parts what can't be one phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                keys, langs, words, real = _coded(batch)
                known = np.zeros(len(langs) * len(words) + 1, np.int64)
                places = np.unique(keys[real])
                pairs = [(langs[p // len(words)], words[p % len(words)]) for p in places.tolist()]
                known[places] = numbers(*WordNumbers.hashes(pairs, seed))
                ids = np.where(real, known[keys], 0)
                ids = ids[(ids > 0) | np.append(True, ids[:-1] > 0)]  # runs of zeros are one
                yield pa.record_batch([pa.array([ids.astype("<i4").tobytes()], pa.binary())], ["ids"])

    return docs.select("lang", "text").mapInArrow(run, "ids binary")


def _phrase_counts(encoded: DataFrame, levels: list[np.ndarray]) -> DataFrame:
    """(key, f) of what stands two frequent phrases of the last level apart by one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            first = np.flatnonzero(np.diff(keys[order], prepend=-1))
            return keys[order][first], np.add.reduceat(np.concatenate([n for _, n in parts])[order], first)

        def emit(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), AT_ONCE):
                yield pa.record_batch([pa.array(keys[at : at + AT_ONCE]), pa.array(counts[at : at + AT_ONCE])], ["key", "f"])

        held = 0
        for batch in batches:
            for data in batch.column(0):
                keys = _joined(np.frombuffer(data.as_buffer(), "<i4").astype(np.int64))
                for known in levels:
                    keys = _joined(_number(keys, known))
                if not (keys := keys[keys > 0]).size:
                    continue
                parts.append(np.unique(keys, return_counts=True))
                held += len(parts[-1][0])
                if held > 2 * HELD:
                    parts = [total()]
                    held = len(parts[0][0])
                    if held > HELD:
                        yield from emit(*parts[0])
                        parts, held = [], 0
        if parts:
            yield from emit(*total())

    return encoded.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _levels(docs: DataFrame, words: DataFrame, least: int, longest: int, most_sent: int) -> list[DataFrame] | None:
    """(lang, phrase, k, f) of each level's frequent phrases, or None where a level is too large to be sent."""
    frequent = words.where("word is not null")
    if frequent.count() > most_sent:
        return None
    named, numbers, seed = _numbered_words(frequent)
    level = keep(named.withColumn("last", F.col("phrase")), "words")
    encoded = keep(_encoded(docs, numbers, seed), "encoded")
    tables, sent = [level], []
    for k in range(2, longest + 1):
        counted = keep(_phrase_counts(encoded, sent).where(F.col("f") >= least), "phrase-keys")
        if counted.count() > most_sent:
            return None
        keys = np.sort(counted.select("key").toArrow().column(0).to_numpy())  # MOST_SENT rows at most
        first = level.select(F.col("number").alias("_first"), "lang", F.col("phrase").alias("_head"))
        second = level.select(F.col("number").alias("_second"), F.col("last"))
        named = _with_numbers(counted, keys).withColumns({"_first": F.shiftright("key", 32), "_second": F.col("key").bitwiseAND(F.lit((1 << 32) - 1))})
        named = named.join(first, "_first").join(second, "_second")
        level = keep(named.select("number", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "f"), "phrases")
        tables.append(level)
        sent.append(keys)
    forget(encoded)
    return [t.select("lang", "phrase", F.lit(k).alias("k"), "f") for k, t in enumerate(tables, 1)]


def _with_numbers(counted: DataFrame, keys: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            yield pa.record_batch([pa.array(_number(own, keys)), *batch.columns], ["number", "key", "f"])

    return counted.select("key", "f").mapInArrow(run, "number long, key long, f long")


def _levels_by_shuffle(docs: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """The same levels as strings, without a filter."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    pieces = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("_p"))
    words = pieces.select("lang", F.regexp_extract_all("_p", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("_w"))

    def level(k: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("_w") - (k - 1))
        phrases = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, k), " "))
        counted = words.where(F.size("_w") >= k).select("lang", F.explode(phrases).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("f"))
        return counted.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f")

    return [level(k) for k in range(1, longest + 1)]


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= least, and (lang, n): all words."""
    words = keep(_word_counts(docs, least), "word-counts")
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    levels = _levels(docs, words, least, longest, most_sent) or _levels_by_shuffle(docs, least, longest)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return keep(found, "frequent-phrases"), totals


def _parts(words: str, k: str) -> dict[str, Column]:
    return {
        "left": F.array_join(F.expr(f"slice({words}, 1, {k})"), " "),
        "right": F.array_join(F.expr(f"slice({words}, {k} + 1, size({words}))"), " "),
    }


def scored(found: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """lang, phrase, k, a, l, r and score of each phrase of several words, by its lowest-scoring cut."""
    few = found.count() <= BROADCAST_COUNTS
    counts = found.select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_n"))
    counts = F.broadcast(counts) if few else counts
    cuts = found.where("k > 1").withColumn("_w", F.split("phrase", " ")).withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns(_parts("_w", "_cut")).drop("_w")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.withColumnsRenamed({"_part": side, "_n": name}), ["lang", side])
    exact = f"int({2 * scale}) * cast(f as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    cuts = cuts.withColumn("score", F.expr(exact).cast("long"))
    best = F.min(F.struct("score", "_cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "k", F.col("f").alias("a")).agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


#: The same in DuckDB over documents, with the default parameters.
SQL = f"""
with pieces as (
  select coalesce(lang, '{NO_LANG}') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0b\\x0c\\r]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^ \\t]+') as w from pieces),
starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 5) as levels(k) where len(w) >= k),
found as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, any_value(k) as k, count(*) as f
  from starts group by 1, 2 having count(*) >= 30),
totals as (select lang, sum(len(w)) as n from words group by 1),
split as (select *, string_split(phrase, ' ') as w from found where k > 1),
cuts as (select *, unnest(range(1, k)) as cut from split),
cut_scores as (
  select c.lang, c.phrase, c.f as a, a.f as l, b.f as r, c.cut, (2000000::hugeint * c.f) // (a.f + b.f) as score
  from cuts c
  join found a on a.lang = c.lang and a.phrase = array_to_string(c.w[:c.cut], ' ')
  join found b on b.lang = c.lang and b.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
scored as (select * from cut_scores qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) as phrase, f
  from split where k > 2),
most as (select lang, phrase, max(f) as f from longer group by 1, 2),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from scored s left join most m on m.lang = s.lang and m.phrase = s.phrase
  where m.f is null or 100::hugeint * m.f < 80::hugeint * s.a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, absorbed: int = 80, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's ``first`` best phrases."""
    found, totals = frequent_phrases(docs, least, longest, most_sent)
    wide = found.where("k > 2").withColumn("_w", F.split("phrase", " "))
    within = wide.select("lang", "f", F.explode(F.array(*[F.array_join(F.expr(f"slice(_w, {i}, k - 1)"), " ") for i in (1, 2)])).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    rows = scored(found).join(within, ["lang", "phrase"], "left")
    gone = F.coalesce(F.col("_longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * absorbed, F.lit(False))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each share first, so that one lang's last task has RANK_SHARES * first rows at most
    rows = rows.where(~gone).withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)))
    for by in (["lang", "_share"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= first)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
