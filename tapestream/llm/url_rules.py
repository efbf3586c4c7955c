"""URL rules, propagated to aliases over redirects and canonical links.

A rule is a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule judges a url (of equal ones allow before block, then the smaller text).
A page's aliases are the pages connected with it through its ``<link rel=canonical>`` and
``<meta http-equiv=refresh>`` targets and given redirects, where ``same_page`` says which urls
are one page: ``exact_key`` holds only what differs in the fragment or the host's case for
one, ``alias_key`` also what differs in scheme, www or m prefix, tracking parameters,
trailing slash or ``.html``.  Components are found in a distributed way.  A page without a
rule of its own is allowed if a rule allows anything in its component, else blocked if a
rule blocks anything there, else allowed: an explicit allow takes precedence.

Only DataFrame functions.  Defined results: a null url, or one without ``://``, has an empty
host and path, fits no rule and is allowed; null html has no links; a tag lasts to the next
``>``, whatever its length, and one that another link or meta tag begins in before that is
none; all tags count; repeated rows get equal verdicts; null
page_ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import keep

#: Rules up to this number become one expression; more are joined as a table.
INLINE_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\b(?:(?!<(?:link|meta)\b)[^>])*+>"
CANONICAL, REFRESH = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""", r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF, TARGET = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """urls (with host and path) and rule (null: none) and decision of the rule that judges.

    rules: (verdict, "host/path").  Up to INLINE_RULES are one expression; more go through
    ``judge_by_table``.
    """
    if len(rules) > INLINE_RULES:
        table = urls.sparkSession.createDataFrame(list(rules), "decision string, rule string")
        return judge_by_table(urls, table)
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in reversed(_order(rules)):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, decision = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(decision)
    return urls.withColumns({"rule": rule, "decision": decision})


def judge_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``judge`` with rules (decision, rule) of any number: equi-joins on host suffix and path start.

    A url asks for each of its host's suffixes and each length that some rule's path has, so
    a host with many rules costs no more than one with few.
    """
    rules = rules.select(
        "decision", "rule", F.regexp_extract("rule", "^[^/]*", 0).alias("_host"), F.regexp_replace("rule", "^[^/]*", "").alias("_path")
    )
    lengths = [r.n for r in rules.select(F.length("_path").alias("n")).distinct().collect()]  # as many as a path has lengths
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pairs.select("host", "path", F.explode(suffixes).alias("_host"), F.array(*map(F.lit, sorted(lengths))).alias("n"))
    asked = asked.select("host", "path", "_host", F.explode(F.filter("n", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.withColumn("_path", F.expr("substring(path, 1, n)"))
    best = F.min_by(F.struct("rule", "decision"), F.struct(-F.length("rule"), F.col("decision") != "allow", "rule"))
    found = asked.join(rules, ["_host", "_path"]).groupBy("host", "path").agg(best.alias("best"))
    return urls.join(found, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "decision": F.col("best.decision")}).drop("best")


def exact_key(url: Column) -> Column:
    """The url without its fragment, its scheme and host in lower case."""
    host, _ = parse(url)
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def alias_key(url: Column) -> Column:
    """What urls of one page have in common."""
    host, path = parse(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)") & (p != ""))
    plain = F.regexp_replace(F.regexp_replace(path, r"(?<=.)/+$", ""), r"\.html?$", "")
    bare = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.when(plain == "/", "").otherwise(plain))
    return F.when(host != "", F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare))


def _target(href: Column, url: Column) -> Column:
    """The absolute url of a link found on a page."""
    scheme, site = F.regexp_extract(url, "^[^:]*:", 0), F.regexp_extract(url, "^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^([^?#]*/)[^/?#]*", 1)
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href != "", F.concat(folder, href))
    )


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and refreshes."""
    head = pages.where("html is not null and url is not null")
    # what follows the last > holds no tag, so that each search for a tag's end succeeds and none is made twice
    whole = F.left("html", F.length("html") - F.length(F.substring_index("html", ">", -1)))
    tags = head.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all(whole, F.lit(TAG), F.lit(0))).alias("tag"))
    href = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    found = tags.select("url", href.alias("href")).where("href <> ''")
    return found.select("url", _target(F.col("href"), F.col("url")).alias("target")).where("target is not null")


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, same_page: Callable[[Column], Column] = alias_key) -> DataFrame:
    """page_id, host, path, rule and verdict of each page, and the component it was judged with.

    redirects: further (url, target) rows, such as those a crawler followed.
    """
    host, path = parse(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), same_page(F.col("url")).alias("key"))
    own = keep(judge(own, rules), "judged")
    found = links(pages)
    if redirects is not None:
        found = found.union(redirects.select("url", "target"))
    host, path = parse(F.col("target"))
    found = found.select(same_page(F.col("url")).alias("src"), same_page(F.col("target")).alias("dst"), host.alias("host"), path.alias("path"))
    found = keep(judge(found, rules), "links")
    heads = keep(connected_components(found), "heads").withColumnRenamed("node", "key")

    votes = own.where("rule is not null").select("key", "decision").union(found.where("rule is not null").select(F.col("dst").alias("key"), "decision"))
    votes = votes.where("key is not null").distinct().join(heads, "key", "left").withColumn("component", F.coalesce("component", "key"))
    votes = votes.groupBy("component").agg(F.min("decision").alias("alias_decision"))  # allow comes before block
    ruled, free = own.where("rule is not null or key is null"), own.where("rule is null and key is not null")
    free = free.join(heads, "key", "left").withColumn("component", F.coalesce("component", "key")).join(votes, "component", "left")
    columns = ["page_id", "host", "path", "rule"]
    out = free.select(*columns, F.coalesce("alias_decision", F.lit("allow")).alias("verdict"), "component")
    return out.union(ruled.select(*columns, F.coalesce("decision", F.lit("allow")).alias("verdict"), F.col("key").alias("component")))
