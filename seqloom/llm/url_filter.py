"""URL filtering: rules by host and path, and trust and distrust propagated over the graph of hosts.

Rules decide where one fits. Elsewhere the host decides: from the hosts that rules allow, trust runs along the links
(personalised PageRank), and from the hosts that rules block, distrust runs against the links (a host that links to bad ones is
suspect). A host is blocked if distrust holds more than THRESHOLD of what reached it, relative to all of each kind.

The graph is built and iterated in DataFrames: links are aggregated to one weighted edge per pair of hosts, a step is one join
on the edge's start and one sum by its end, both directions go through the same step, and every few steps the scores are
written to the shared folder, which cuts the lineage. Nothing that grows with the pages comes to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import discard, materialize

DAMPING, WRITE_EVERY, THRESHOLD = 0.85, 4, 0.5
#: Scores have settled when none changes by more than this share of itself; what is below LEAST counts as nothing.
CLOSE_ENOUGH, LEAST = 1e-6, 1e-300
#: Up to so many rules are tried as expressions on each url; more are joined with the urls' hosts.
AS_EXPRESSIONS = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered. Path: what follows the host
    up to ``?``, ``#`` or the end. Both are empty if the url is null or has no ``://``."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains, for paths
    that start with the rule's path; of two equally long ones the later by name counts."""
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = []
    for verdict, rule in rules:
        of, _, under = rule.partition("/")
        ok = ((host == of) | host.endswith("." + of)) & path.startswith("/" + under if "/" in rule else "")
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else none


def with_best_rule(parts: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """The rows (with host and path) and `_best`, as of `best_rule`. `rules` is a list of (verdict, rule), or a table with these
    columns of any size. The table is joined, on each host and all that it is a subdomain of, with the distinct pairs of host
    and path, which are joined back then; nothing is broadcast but what Spark finds small enough."""
    if isinstance(rules, list) and len(rules) <= AS_EXPRESSIONS:
        return parts.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    table = parts.sparkSession.createDataFrame(rules, "verdict string, rule string") if isinstance(rules, list) else rules
    table = table.select("verdict", "rule").dropna().withColumns({"_at": F.instr("rule", "/")})
    under = F.when(F.col("_at") > 0, F.expr("substring(rule, _at)")).otherwise("")
    table = table.select(F.when(F.col("_at") > 0, F.expr("substring(rule, 1, _at - 1)")).otherwise(F.col("rule")).alias("_suffix"), under.alias("_under"), F.struct(F.length("rule").alias("size"), "rule", "verdict").alias("_fits"))
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = pairs.withColumn("_suffix", F.explode(suffixes)).join(table, "_suffix").where(F.col("path").startswith(F.col("_under")))
    best = own.groupBy(F.col("host").alias("_bh"), F.col("path").alias("_bp")).agg(F.max("_fits").alias("_best"))
    return parts.join(best, (F.col("host") == F.col("_bh")) & (F.col("path") == F.col("_bp")), "left").drop("_bh", "_bp")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many pages of one host link to another one. `pages` has (host, html). Links without a host
    of their own stay on the host and make no edge."""
    links = pages.where((F.col("host") != "") & F.contains("html", F.lit("//")))
    links = links.select("host", F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)).alias("_links"))
    absolute = F.transform("_links", lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    hosts = F.array_distinct(F.transform(absolute, lambda x: host_and_path(x)[0]))
    each = links.select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return each.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = DAMPING) -> DataFrame:
    """Trust along the edges and distrust against them.

    `edges` (src, dst, weight) has each pair of hosts once; `seeds` (host, trust, distrust) has non-negative weights, each
    host once. Returns (host, trust, distrust) of every host that anything reached; each kind has a sum of one (zero if it has no
    seeds). What arrives at a host without a way on goes back to the seeds: since the scores are linear in what the seeds get,
    that is the same as letting it go and bringing the sum to one at the end. Rows with nulls are left out.

    Ends when, between two written steps, no host was reached anew and no score changed by more than CLOSE_ENOUGH of itself, so
    the end does not depend on how small the scores are or how long the ways. That comes by itself: all that can be reached is
    reached after the longest shortest way, and later changes shrink by `damping` a step. Scores are doubles: what falls below
    LEAST (the end of an unbranched way of about 4,000 links) is not waited for. A number of `steps` sets the end instead.
    """
    edges, seeds = edges.dropna(), seeds.dropna(subset=["host"]).fillna(0)
    total = seeds.agg(F.coalesce(F.sum("trust"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("distrust"), F.lit(0.0)).alias("d")).first()
    kinds = [(0, "trust", total["t"]), (1, "distrust", total["d"])]
    start = None
    for kind, name, whole in kinds:
        own = seeds.where(F.col(name) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(name) / F.lit(float(whole) or 1.0)).alias("score"))
        start = own if start is None else start.unionByName(own)
    start = materialize(start, "url-seeds")
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "weight")
    ways = ways.unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "weight"))
    out = ways.groupBy("kind", "from").agg(F.sum("weight").alias("whole"))
    ways = materialize(ways.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("weight") / F.col("whole")).alias("part")), "url-ways")
    scores, kept = start, None
    if not ways.isEmpty():
        for step in count(1) if steps is None else range(1, steps + 1):
            moved = scores.withColumnRenamed("host", "from").join(ways, ["kind", "from"])
            moved = moved.select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
            stay = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
            after = moved.unionByName(stay).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if step % WRITE_EVERY and step != steps:
                scores = after
                continue
            after = materialize(after, "url-scores")
            if kept is not None:
                both = after.alias("a").join(kept.alias("b"), ["kind", "host"], "full_outer")
                new, old = F.col("a.score"), F.col("b.score")
                settled = both.where(new.isNull() | old.isNull() | (F.abs(new - old) > CLOSE_ENOUGH * new + LEAST)).isEmpty()
                discard(kept)
                if settled:
                    scores = after
                    break
            scores = kept = after
    whole = scores.groupBy("kind").agg(F.sum("score").alias("whole"))  # two rows at most
    parts = scores.join(F.broadcast(whole), "kind").withColumn("score", F.col("score") / F.col("whole"))
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    out = materialize(parts.groupBy("host").agg(pick(0).alias("trust"), pick(1).alias("distrust")), "url-hosts")
    for used in (start, ways, *([kept] if kept is not None else [])):
        discard(used)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A verdict for every url.

    Returns one row for each row (repeated rows stay repeated): page_id, host, path, rule (the longest that fits, or null),
    verdict (`allow` or `block`), trust and distrust of the host (0 if nothing reached it). Without a rule a host is blocked
    if distrust / (trust + distrust) exceeds `threshold`, and allowed otherwise; so is the empty host of a null url or one
    without ``://``. `rules` is a list of (verdict, rule) or a table with these columns, of any size. Seeds are hosts weighted by
    how many of their pages a rule allows or blocks. Null html has no links. An empty table gives none. Other columns are
    ignored, whatever their names.
    """
    raw = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("html"))
    host, path = host_and_path(F.col("_url"))
    parts = raw.withColumns({"host": host, "path": path})
    judged = with_best_rule(parts, rules)
    verdict = F.col("_best.verdict")
    seeds = judged.where((F.col("host") != "") & verdict.isNotNull()).groupBy("host")
    seeds = seeds.agg(F.sum((verdict == "allow").cast("double")).alias("trust"), F.sum((verdict == "block").cast("double")).alias("distrust"))
    scores = propagate(host_edges(parts.select("host", "html")), seeds)
    scores = scores.withColumnRenamed("host", "_host")
    both = judged.join(scores, F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages`."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_url_filter": op2_url_filter}
