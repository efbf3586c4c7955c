"""Personal data in whole texts: fixed forms, and bootstrapped contextual extraction.

The forms (e-mail, ip, card, phone) give the base spans, found by marking the matches in one
pass per form and measuring what lies between the marks.  They are the seeds; other tokens
with a digit or an at sign are candidates.  What surrounds an instance induces its lexical
patterns: the two words before it and, apart, the two after it, with other instances as one
placeholder.  Patterns and instances are a bipartite graph, scored in rounds: a pattern
scores the share of its distinct instances that are good (seeds, or accepted in a round
before), if these are ``seeds`` or more; a candidate scores the best of its patterns, less
where none of the pattern's good instances has its shape.  Candidates at ``sure`` or more are
accepted, and so may lift new patterns in the next round.  In the end each place of a
candidate under a pattern that makes it sure is reported as ``found``.

Only DataFrame functions.  Matching is linear: a form that begins with a run is tried at the
run's start, or where the last match ended, as later starts within it end alike.

Defined results: null is an empty text; null doc_ids and repeated rows are kept, row by row;
instances and patterns are counted once however many rows have them, so copies of a text
weigh nothing; a text without spans has the digest of an empty list; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

KINDS = ("email", "ip", "card", "phone", "found")
BLANK = "\\x20\\x09-\\x0D"
# The contract's forms, possessive and with their start spelled out.
FORMS = {
    "email": r"((?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"((?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3})",
    "card": r"([0-9](?:[\x20-]?[0-9])++)",
    "phone": r"(\+[0-9][\x20().0-9-]+[0-9])",
}
OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Tokens that could be an identifier: with a digit or an at sign.
CANDIDATE = f"((?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+)"
#: What other instances are in a pattern, and how much less sure a candidate of a shape is that no good one has.
OTHER, ODD_SHAPE = "#", 0.8


def _ends(text: Column) -> Column:
    """The first two words and the last two of a text, and how many it has.

    A word is its letters in lower case, OTHER where it has a digit or an at sign, or itself where it has neither.
    """
    letters = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]+", "")
    plain = lambda w: F.when(w.rlike("[0-9@]"), OTHER).when(w.rlike(r"\p{L}"), letters(w)).otherwise(w)

    def ends(words: Column) -> Column:
        some = lambda at: F.array_join(F.transform(F.array_compact(F.array(*[F.try_element_at(words, F.lit(i)) for i in at])), plain), " ")
        return F.struct(some((1, 2)).alias("first"), F.when(F.size(words) > 1, some((-2, -1))).otherwise(some((1,))).alias("last"), F.size(words).alias("size"))

    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), ends), F.lit(0))  # so that the text is split once


def _parts(text: Column, form: str) -> Column:
    """What lies between matches and the matches, in turn: length, match or null, first and last two words of what lies between."""
    marked = F.regexp_replace(text, F.lit(form), F.lit("\x01$1\x02"))
    return F.transform(
        F.split(marked, "[\x01\x02]"),
        lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, x).alias("match"), F.when(i % 2 == 0, _ends(x)).alias("ends")),
    )


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(f"^{OCTET}(\\.{OCTET}){{3}}$"))
        .when(kind == "card", F.length(digits).between(13, 19) & F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))"))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs, numbered, with the parts of each form that may occur."""
    clear = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit("\x03")), F.lit("\x02"), F.lit("\x03"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), clear.alias("t"))
    rows = rows.withColumns({"digit": F.col("t").rlike("[0-9]"), "at": F.contains("t", F.lit("@")), "plus": F.contains("t", F.lit("+"))})
    when = {"email": F.col("at"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("plus") & F.col("digit")}
    parts = {k: F.when(when[k], _parts(F.col("t"), form)) for k, form in FORMS.items()}
    parts["found"] = F.when(F.col("digit") | F.col("at"), _parts(F.col("t"), CANDIDATE))
    return keep(rows.select("row", "doc_id", *[p.alias(k) for k, p in parts.items()]), "scanned")


def _spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, left, right) of each match; kind is a place in KINDS, left and right are patterns or null."""
    each = None
    for k, name in enumerate(KINDS):
        some = scanned.where(F.size(name) > 1).select("row", F.lit(k).alias("kind"), F.posexplode(name).alias("i", "part"))
        each = some if each is None else each.unionByName(some)
    order = Window.partitionBy("row", "kind").orderBy("i")
    at = F.sum("part.n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead, behind = F.lag("part.ends").over(order), F.lead("part.ends").over(order)
    # one word between this and the next instance: that is in the pattern too; none: no pattern
    left = F.when(ahead["size"] > 1, ahead["last"]).when(ahead["size"] == 1, F.concat(F.when(F.col("i") > 1, OTHER).otherwise("^"), F.lit(" "), ahead["last"]))
    right = F.when(behind["size"] > 1, behind["first"]).when(behind["size"] == 1, F.concat(behind["first"], F.lit(" "), F.when(F.lead("i", 2).over(order).isNotNull(), OTHER).otherwise("$")))
    placed = each.select("row", "kind", (at - F.col("part.n")).alias("start"), at.alias("end"), F.col("part.match").alias("match"), left.alias("left"), right.alias("right"))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return placed.where(F.col("match").isNotNull()).where(_valid(name, F.col("match")))


def _instances(spans: DataFrame) -> DataFrame:
    """Base spans (seed) and the candidates that none of them touches, once per pattern: row, start, end, token, shape, pattern, seed."""
    base = F.col("kind") < KINDS.index("found")
    order, back = Window.partitionBy("row").orderBy("start", "kind"), Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc())
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    free = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    shape = F.regexp_replace(F.regexp_replace("match", "[0-9]+", "9"), "\\p{L}+", "a")
    patterns = F.array_compact(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right")))
    kept = spans.withColumns({"seed": base, "free": free}).where("seed or free")
    return kept.select("row", "start", "end", F.md5("match").alias("token"), F.md5(shape).alias("shape"), F.explode(patterns).alias("pattern"), "seed")


def sure_places(instances: DataFrame, rounds: int = 4, sure: float = 0.7, seeds: int = 5) -> DataFrame:
    """(pattern, token) of candidates at ``sure`` or more under the pattern, after ``rounds`` rounds or when a round accepts nothing."""
    edges = keep(instances.groupBy("pattern", "token", "shape").agg(F.max("seed").alias("seed")), "pattern-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    good = edges.where("seed").select("token").distinct()
    n_good, found = -1, None
    for _ in range(rounds):
        good = keep(good, "good-tokens")
        if (n := good.count()) == n_good:
            break
        n_good = n
        marked = edges.join(good, "token")
        scores = marked.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= seeds).join(totals, "pattern")
        scores = scores.select("pattern", (F.col("k") / (F.col("all") + 1)).alias("score")).where(F.col("score") >= sure)
        shapes = marked.select("pattern", "shape").distinct().withColumn("known", F.lit(1.0))
        judged = edges.where("not seed").join(scores, "pattern").join(shapes, ["pattern", "shape"], "left")
        found = judged.where(F.col("score") * F.coalesce("known", F.lit(ODD_SHAPE)) >= sure).select("pattern", "token")
        good = good.union(found.select("token")).distinct()
    return found


def find(docs: DataFrame, **bootstrap) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for each row of docs."""
    scanned = _scan(docs)
    spans = keep(_spans(scanned), "spans")
    instances = _instances(spans)
    places = instances.where("not seed").join(sure_places(instances, **bootstrap), ["pattern", "token"])
    new = places.select("row", "start", "end").distinct()
    found = F.lit(KINDS.index("found"))
    every = spans.where(F.col("kind") < found).select("row", "kind", "start", "end").union(new.select("row", found.alias("kind"), "start", "end"))
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("s"))
    both = scanned.select("row", "doc_id").join(lists, "row", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<kind int, start bigint, end bigint>>)")))

    def listed(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    digest = F.sha2(listed(F.filter("s", lambda x: x["kind"] < found)), 256).alias("base_sha256")
    return both.select("doc_id", *counts[:-1], digest, listed(F.col("s")).alias("spans"), counts[-1])
