"""URL filter by association rules: Spark's FP-growth mines combinations of URL tokens that go with a label.

A URL becomes tokens: its scheme, the host with each of its parents, the segments of the path (digits as ``#``), the names of
its query and whether it has a fragment. Labelled URLs are transactions of tokens and a label (``block`` or ``allow``). Of the
mined rules tokens -> label those stay that reach ``SUPPORT``, ``LEAST`` and ``CONFIDENCE``, have at most ``MOST_TOGETHER`` tokens and
are surer than each more general rule, the label's own share included. All URLs meet the rules by an inverted
index: each rule is filed under its rarest token, and a URL that has it is checked for the others. A given list of rules (host
with all subdomains, start of the path) is filed in the same index under its host; the longest of these goes before what
was mined, then the surest mined rule decides (ties: support, tokens, order of the alphabet), then ``allow``.

Mining reads all tokens of a labelled URL that could be part of a rule: those that reach the support. Up to ``MOST_TOKENS`` of
them FP-growth finds the sets; it knows no bound on the tokens of a set, so a URL of many tokens would cost it all their
subsets. Where a URL has more, the sets of up to ``MOST_TOGETHER`` tokens are counted themselves, with the same result. Rules are at
most the number of such sets of one URL divided by the support, whatever the number of URLs; that is what is broadcast.
Matching reads all tokens of all URLs, and moves one row for each of them.

Nulls: a null URL, or one without ``://``, has an empty host and path and no tokens, so it is allowed; a null label is no label.
Ties: among listed rules of equal length the first in the list; a host that is listed twice has the longest fitting path.
Repeated URLs are each judged; repeated labelled rows each count. Very long URLs are read whole (a row for each token). Extra
columns pass through; an input column named like a result is replaced. Empty tables give no rules or no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written

#: Of all labelled URLs, so many (and ``LEAST`` rows at least) have to show a rule, and so many of those with its tokens its label.
SUPPORT, LEAST, CONFIDENCE = 0.01, 10, 0.7
MOST_TOKENS, MOST_TOGETHER = 12, 3
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No URL gives this token: it stands for the label of a transaction.
_LABEL = "label:"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?`` or ``#``, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parents(host: Column) -> Column:
    """The host and each of its parent domains, as an array."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; none without a host."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    filled = lambda c: F.filter(c, lambda x: x != "")
    named = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(f"{name}:"), x))
    segments = F.regexp_replace(F.translate(path_of(url), UPPER, LOWER), "[0-9]+", "#")
    found = F.concat(
        named("scheme", F.array(F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER))), named("site", parents(host_of(url))),
        named("path", filled(F.split(segments, "/"))), named("arg", filled(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def most_rules(support: float, most_tokens: int = MOST_TOKENS, most_together: int = MOST_TOGETHER) -> int:
    """No more rules than this can reach ``support`` if no URL has more than ``most_tokens`` tokens: each holds so many sets of them, and has one label."""
    return int(sum(comb(most_tokens, k) for k in range(1, most_together + 1)) / support)


def transactions(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", support: float = SUPPORT, least: int = LEAST) -> tuple[DataFrame, DataFrame, int, int]:
    """(rid, items) of each labelled URL: its tokens that reach the support, by name, and its label last; (token, freq) of these
    tokens; how many URLs there are, and how many of them reach the support.
    """
    rows = labelled.where(F.col(f"`{label_col}`").isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.concat(F.lit(_LABEL), F.col(f"`{label_col}`")).alias("label"), tokens_of(F.col(f"`{url_col}`")).alias("tokens"))
    rows = written(rows, "labelled")
    n = rows.count()
    reach = max(ceil(support * n), least, 1)
    # Of a token that few URLs have no set has more. At most the tokens of one URL divided by the support.
    alone = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= reach)
    each = rows.select("rid", F.explode("tokens").alias("token")).join(alone, "token")
    common = each.groupBy("rid").agg(F.array_sort(F.collect_list("token")).alias("common"))
    return rows.join(common, "rid", "left").select("rid", F.concat(F.coalesce("common", F.array().cast("array<string>")), F.array("label")).alias("items")), alone, n, reach


def _grown(items: DataFrame, n: int, reach: int, most_together: int) -> DataFrame:
    """(antecedent, consequent, confidence, support) of sets of up to ``most_together`` tokens and a label."""
    tokens, label = F.slice("items", F.lit(1), F.size("items") - 1), F.element_at("items", -1)
    last = F.transform("tokens", lambda t: F.array(t))
    all_sets = [last]
    for _ in range(most_together - 1):
        longer = lambda s: F.transform(F.filter("tokens", lambda t: t > F.element_at(s, -1)), lambda t: F.concat(s, F.array(t)))
        last = F.flatten(F.transform(last, longer))
        all_sets.append(last)
    df = items.select(tokens.alias("tokens"), label.alias("label")).select("label", F.explode(F.concat(*all_sets)).alias("antecedent"))
    both = df.groupBy("antecedent", "label").agg(F.count(F.lit(1)).alias("m"))
    counts = both.groupBy("antecedent").agg(F.sum("m").alias("whole"), F.collect_list(F.when(F.col("m") >= reach, F.struct("label", "m"))).alias("l"))  # a row for each label
    counts = counts.select("antecedent", "whole", F.explode("l").alias("l"))
    return counts.select("antecedent", F.array("l.label").alias("consequent"), (F.col("l.m") / F.col("whole")).alias("confidence"), (F.col("l.m") / F.lit(n)).alias("support"))


def mined(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, most_tokens: int = MOST_TOKENS, most_together: int = MOST_TOGETHER) -> DataFrame:
    """(tokens, verdict, confidence, support, anchor) of the rules that stay, tokens in order of the alphabet; written.

    ``anchor`` is the token that the fewest labelled URLs have. Up to ``most_tokens`` tokens a URL the sets come from FP-growth.
    """
    spark = labelled.sparkSession
    kind = "tokens array<string>, verdict string, confidence double, support double, anchor string"
    items, alone, n, reach = transactions(labelled, url_col=url_col, label_col=label_col, support=support, least=least)
    if reach > n:
        return spark.createDataFrame([], kind)
    items, alone = written(items, "transactions"), written(alone, "alone")
    if items.agg(F.max(F.size("items"))).first()[0] - 1 <= most_tokens:
        rules = FPGrowth(itemsCol="items", minSupport=(reach - 0.5) / n, minConfidence=0.0).fit(items).associationRules
    else:
        rules = _grown(items, n, reach, most_together)
    to_label = F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)) & (F.size("antecedent") <= most_together)
    found = rules.where(to_label).select(F.array_sort("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(len(_LABEL) + 1)).alias("verdict"), "confidence", "support")
    share = items.groupBy(F.substr(F.element_at("items", -1), F.lit(len(_LABEL) + 1)).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    share = share.select("verdict", (F.col("n") / F.lit(n)).alias("share"))  # a row for each label
    found = written(found, "rules")
    # Each set of some tokens of a rule, if it is a rule to the same label, has to be less sure.
    places = [list(c) for n in range(1, most_together) for c in combinations(range(most_together), n)]
    parts = F.filter(F.array(*[F.filter(F.array(*[F.get("tokens", F.lit(i)) for i in p]), F.isnotnull) for p in places]), lambda s: (F.size(s) > 0) & (F.size(s) < F.size("tokens"))) if places else F.array()
    general = found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("before"))
    beaten = found.select("tokens", "verdict", "confidence", F.explode(F.array_distinct(parts)).alias("part")).join(general, ["part", "verdict"]).where(F.col("before") >= F.col("confidence")).select("tokens", "verdict").distinct()
    kept = found.where(F.col("confidence") >= confidence).join(share, "verdict").where(F.col("confidence") > F.col("share")).join(beaten, ["tokens", "verdict"], "left_anti")
    anchors = kept.select("tokens", "verdict", F.explode("tokens").alias("token")).join(alone, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return written(kept.join(anchors, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "support", "anchor"), "kept")


def listed_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(place, rule, verdict) of (verdict, rule) pairs, a rule being a host and the start of a path."""
    return spark.createDataFrame([(i, rule, verdict) for i, (verdict, rule) in enumerate(rules)], "place int, rule string, verdict string")


def _index(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, path, tokens, rank, rule, verdict): each rule under one token that all it fits have; the lowest rank decides.

    Both lists are small for certain (one is given, the other is bounded by the support), so one task may rank them.
    """
    by_length = Window.orderBy(F.desc(F.length("rule")), "place")
    first = listed.select(
        F.concat(F.lit("site:"), F.translate(F.regexp_extract("rule", "(?s)^[^/]*", 0), UPPER, LOWER)).alias("token"), F.regexp_extract("rule", "(?s)^[^/]*(.*)", 1).alias("path"),
        F.array().cast("array<string>").alias("tokens"), (F.row_number().over(by_length) - (1 << 30)).alias("rank"), "rule", "verdict",
    )
    surest = Window.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), F.array_join("tokens", " "), "verdict")
    then = rules.select(F.col("anchor").alias("token"), F.lit("").alias("path"), "tokens", F.row_number().over(surest).alias("rank"), F.lit(None).cast("string").alias("rule"), "verdict")
    return first.unionByName(then)


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, url_col: str = "url", default: str = ALLOW, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``pages`` (all by default) with host, path, rule (of ``listed``, else null), mined (tokens of the rule that decides) and verdict.

    ``rules`` comes from ``mined``, ``listed`` from ``listed_rules``.
    """
    url = F.col(f"`{url_col}`").cast("string")
    index = written(_index(listed, rules), "index")
    df = packed(pages, keep, url=url).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "tokens": tokens_of(F.col("url")), "rid": F.monotonically_increasing_id()})
    filed = F.broadcast(index.select("token", F.col("path").alias("start"), F.col("tokens").alias("all"), "rank"))
    hits = df.select("rid", "row", "host", "path", "tokens", F.explode_outer("tokens").alias("token")).join(filed, "token", "left")
    fits = F.startswith("path", "start") & (F.size(F.array_except("all", "tokens")) == 0)
    # All rows of a URL are in one task, so they are one before they move.
    best = hits.groupBy("rid").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(F.when(fits, F.col("rank"))).alias("rank"))
    out = best.join(F.broadcast(index.select("rank", "rule", "verdict", F.col("tokens").alias("mined"))), "rank", "left")
    return unpacked(out, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), mined=F.when(F.col("rule").isNull(), F.col("mined")), verdict=F.coalesce("verdict", F.lit(default)))

