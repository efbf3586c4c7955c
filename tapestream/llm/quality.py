"""Quality rules and cross-document line frequency, with DataFrame functions only.

Lines are trimmed, lower-cased and hashed with their host.  A line is boilerplate if more
than ``max_docs`` distinct documents of the host have it, where copies are one document:
those of one text, and near copies.  Boilerplate lines are removed; a document left with
less than ``min_left`` of its characters is rejected.

Counting goes in steps so that little is shuffled: occurrences of each line hash are summed
first (combined before the shuffle, so a line in a third of all documents is no hot key),
then distinct texts, and only texts with a line above the limit are looked at for copies.

Near copies: the ``LOWEST`` lowest hashes of a text's distinct five-word k-mers are its
sketch.  Texts that share one of the four lowest are compared with the bucket's first text,
and those alike in ``ALIKE`` of the lowest hashes of both are linked; a class is a component.

Defined results: words are what lies between ASCII blanks; null is an empty text and a null
host a host of its own; a text without words fails the base rules; rows of equal doc_id and
text count as one document and share a verdict; ties can't occur; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import keep

BLANK = "\\x20\\x09-\\x0D"
#: The same characters, but for the line end.
BLANKS = " \t\r\x0b\x0c"
WORD = f"[^{BLANK}]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Near copies: hashes of a sketch, and the share of those of two texts that both must have.
LOWEST, ALIKE = 64, 0.7
#: Lines above the limit are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_LINES = 500_000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_metrics(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, digest of the text, chars of lines with a word, and METRICS."""
    measured = docs.select("doc_id", _text().alias("_t")).withColumns(
        {"digest": F.xxhash64("_t"), "_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), "_lines": _lines(F.col("_t"))}
    )
    measured = measured.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
            "chars": F.aggregate("_lines", F.lit(0), lambda n, x: n + F.length(x)),
            "_h": F.when(
                F.size("_w") >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)])),
            ),
        }
    )
    measured = measured.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        }
    ).drop("_w", "_t", "_lines", "_h")

    def repeated(x: Column, k: Column) -> Column:
        return x.h.eqNullSafe(F.get("_s", k - 1).h) | x.h.eqNullSafe(F.get("_s", k + 1).h)

    starts = F.array_sort(F.transform(F.filter("_s", repeated), lambda x: x.i))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))).n
    measured = measured.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).select("doc_id", "digest", "chars", *METRICS)


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.lower(F.trim(line, F.lit(BLANKS))))


def _occurrences(docs: DataFrame, host: str) -> DataFrame:
    """A row per line that has a word: doc_id, digest of the text, place, key, characters."""
    rows = docs.select(F.col("doc_id"), F.xxhash64(_text()).alias("digest"), F.col(host).alias("_host"), _lines(_text()).alias("_lines"))
    rows = rows.withColumn("_keys", F.transform("_lines", lambda x: line_key(F.col("_host"), x)))
    lines = F.transform("_keys", lambda key, i: F.struct(i.alias("place"), key.alias("key"), F.length(F.get("_lines", i)).alias("chars")))
    return rows.select("doc_id", "digest", F.inline(lines))


def copies(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, copy_of) of the given texts that have near copies; copy_of is the class's smallest digest."""
    digests = keep(digests, "line-holder-digests")
    few = digests.count() <= BROADCAST_LINES
    rows = docs.select(F.xxhash64(_text()).alias("digest"), _text().alias("_t")).join(F.broadcast(digests) if few else digests, "digest", "left_semi")
    rows = rows.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    kmers = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]))
    kmers = F.when(F.size("_w") >= WINDOW, kmers).otherwise(F.array(F.xxhash64("_w")))
    lowest = F.slice(F.array_sort(F.array_distinct(kmers)), 1, LOWEST)
    texts = keep(rows.select("digest", lowest.alias("lowest")).groupBy("digest").agg(F.first("lowest").alias("lowest")), "copy-sketches")
    four = [F.get("lowest", F.lit(i)) for i in range(4)]
    pairs = [F.when(four[j].isNotNull(), F.xxhash64(four[i], four[j])) for i in range(4) for j in range(i + 1, 4)]
    keys = texts.select("digest", F.explode(F.array_compact(F.array_distinct(F.array(*four, *pairs)))).alias("key"))
    firsts = keys.groupBy("key").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1")
    near = keys.join(firsts, "key").where("digest <> first").select("digest", "first").distinct()
    near = near.join(texts, "digest").join(texts.select(F.col("digest").alias("first"), F.col("lowest").alias("other")), "first")
    both = F.slice(F.array_sort(F.array_union("lowest", "other")), 1, LOWEST)
    alike = F.size(F.array_intersect(both, F.array_intersect("lowest", "other"))) >= ALIKE * F.size(both)
    links = near.where(alike).select(F.col("digest").alias("src"), F.col("first").alias("dst"))
    return connected_components(links).select(F.col("node").alias("digest"), F.col("component").alias("copy_of"))


def boilerplate(docs: DataFrame, host: str = "source", max_docs: int = 20) -> DataFrame:
    """(doc_id, digest, place, key, chars) of each line that is to be removed."""
    lines = _occurrences(docs, host)
    many = keep(lines.groupBy("key").count().where(F.col("count") > max_docs).select("key"), "many-lines")
    few = many.count() <= BROADCAST_LINES
    seen = keep(lines.join(F.broadcast(many) if few else many, "key").dropDuplicates(["doc_id", "digest", "place"]), "seen-lines")
    holders = seen.select("key", "digest").distinct()
    several = holders.groupBy("key").count().where(F.col("count") > max_docs).select("key")
    holders = keep(holders.join(several, "key"), "line-holders")
    classes = copies(docs, holders.select("digest").distinct())
    counted = holders.join(classes, "digest", "left").select("key", F.coalesce("copy_of", "digest").alias("copy_of")).distinct()
    above = keep(counted.groupBy("key").count().where(F.col("count") > max_docs).select("key"), "lines-above")
    few = above.count() <= BROADCAST_LINES
    return seen.join(F.broadcast(above) if few else above, "key").select("doc_id", "digest", "place", "key", "chars")


def judge(docs: DataFrame, host: str = "source", max_docs: int = 20, min_left: float = 0.2) -> DataFrame:
    """A row per row of docs: doc_id, digest, METRICS, removed_chars, removed_keys (null: none) and kept.

    The metrics are written first: a filter on the verdict must not be pushed into them.
    """
    metrics = keep(base_metrics(docs), "metrics")
    gone = boilerplate(docs, host, max_docs).groupBy("doc_id", "digest")
    gone = gone.agg(F.sum("chars").alias("removed_chars"), F.collect_set("key").alias("removed_keys"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "removed_chars", "removed_keys")
    both = metrics.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    removed = F.coalesce("removed_chars", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (F.col("chars") - removed >= min_left * F.col("chars"))
    return both.select("doc_id", "digest", *METRICS, removed.alias("removed_chars"), "removed_keys", kept.alias("kept"))


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents without their boilerplate lines, with the columns of docs."""
    changes = judge(docs, host, **limits).where("not kept or removed_keys is not null").dropDuplicates(["doc_id", "digest"])
    changes = keep(changes.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "removed_keys", F.col("kept").alias("_kept")), "changes")
    few = changes.count() <= BROADCAST_LINES
    texts = docs.select(F.struct(*docs.columns).alias("_d"))
    same = F.col("_d.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("_d.text", F.lit(""))) == F.col("_digest"))
    both = texts.join(F.broadcast(changes) if few else changes, same, "left").where("_kept is null or _kept")
    lines = F.filter(F.split("_d.text", "\n"), lambda x: ~F.array_contains("removed_keys", line_key(F.col(f"_d.{host}"), x)))
    cut = F.col("removed_keys").isNotNull()
    text = F.when(cut, F.array_join(lines, "\n")).otherwise(F.col("_d.text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("_d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[out.get(c, F.col(f"_d.`{c}`")).alias(c) for c in docs.columns])
