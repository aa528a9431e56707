"""URL filtering: rules first, then a tree of path templates judged by their labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint
from .common import shared_path

# Verdict, host and path of the rules; a rule fits its host and all subdomains
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FAN = 16  # a node with so many children generalises those under 1/FAN of its pages
SURE = 1.96  # standard errors by which labelled branches must differ to stay apart
ENOUGH = 5  # labelled pages on both sides for that test
PRIOR, STRENGTH = 0.5, 2.0  # share of bad pages assumed, and how many labels that counts for
REJECT = 0.8
_UPPER = "".join(map(chr, range(0x41, 0x5B)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null. Every row looks at all rules, so they should be few."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """All segments of the path, numbers and codes in them generalised."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def shape(s: Column) -> Column:
        s = F.regexp_replace(s, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{h}")
        return F.regexp_replace(s, r"[0-9]+", "{n}")

    return F.transform(parts, shape)


def _differ(bad: Column, n: Column, other_bad: Column, other_n: Column) -> Column:
    """Whether two shares differ by more than SURE standard errors, each with one good and one bad page added."""
    p, q = (bad + 1) / (n + 2), (other_bad + 1) / (other_n + 2)
    error = F.sqrt(p * (1 - p) / (n + 3) + q * (1 - q) / (other_n + 3))
    return F.abs(p - q) > SURE * error


def templates(leaves: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, bad) from leaves (host, shape, segs, n, ruled, labelled, bad).

    From the root down, the children of every node are judged by what stands beneath them. One with ENOUGH labels stays
    apart, however few of the pages it has, unless its labelled siblings have as many and about the same share of bad
    pages. Of those with fewer, a child of a node with many children that has few of its pages is a variable segment.
    Variable segments, children without labels and those alike are merged into ``*``.
    A rule says nothing about what stands beside its path: children with pages of a rule and children without are
    judged as two nodes, and where a node has both, the former merge into ``{ruled}``.
    A node's children are summed, never listed. Levels go on until no node has two leaves beneath it; where a leaf
    stands alone, the rest of its path is its own.
    """
    spark, sums = leaves.sparkSession, [F.sum(c).alias(c) for c in ("n", "ruled", "labelled", "bad")]
    tree, level, paths = leaves.withColumn("prefix", F.lit("")), 0, []
    while not tree.isEmpty():
        tree = tree.withColumn("child", F.get("segs", F.lit(level)))
        kids = checkpoint(tree.groupBy("host", "prefix", "child").agg(*sums, F.count(F.lit(1)).alias("leaves")))
        by_rule = F.col("ruled") > 0
        whole = {"fan": F.lit(1), **{f"all_{c}": F.col(c) for c in ("n", "labelled", "bad")}}
        sides = [F.struct(F.sum(F.when(by_rule, c)).alias("ruled"), F.sum(F.when(~by_rule, c)).alias("free")).alias(k) for k, c in whole.items()]
        nodes = checkpoint(kids.groupBy("host", "prefix").agg(*sides, (F.sum("leaves") == 1).alias("alone")))
        kids = kids.join(nodes, ["host", "prefix"])
        fan, all_n, all_labelled, all_bad = (F.when(by_rule, F.col(f"{k}.ruled")).otherwise(F.col(f"{k}.free")) for k in whole)
        rest, rest_bad = all_labelled - F.col("labelled"), all_bad - F.col("bad")
        variable = (fan >= FAN) & (F.col("n") * FAN < all_n)
        alike = (rest >= ENOUGH) & ~_differ(F.col("bad"), F.col("labelled"), rest_bad, rest)
        merged = F.when(F.col("labelled") >= ENOUGH, alike).otherwise(variable | (F.col("labelled") == 0))
        star = F.when(by_rule & F.col("fan.free").isNotNull(), "{ruled}").otherwise("*")
        token = F.when(merged & (fan > 1), star).otherwise(F.col("child"))
        named = checkpoint(kids.select("host", "prefix", "child", "alone", token.alias("token")))
        own = F.array_join(F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(1))), "/")
        tree = tree.join(named, ["host", "prefix", "child"]).withColumn("prefix", F.concat("prefix", F.lit("/"), F.when(F.col("alone"), own).otherwise(F.col("token"))))
        tree = tree.withColumn("more", ~F.col("alone") & (F.size("segs") > level + 1)).drop("child", "alone", "token")
        paths.append(shared_path(spark, "templates"))
        tree.write.parquet(paths[-1])
        tree, level = spark.read.schema(tree.schema).parquet(paths[-1]).filter("more"), level + 1
    tree = spark.read.schema(tree.schema).parquet(*paths).filter("not more") if paths else tree
    totals = tree.groupBy("host", "prefix").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    tree = tree.select("host", "prefix", "shape").join(checkpoint(totals), ["host", "prefix"])
    return tree.select("host", "shape", F.col("prefix").alias("template"), "labelled", "bad")


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence = RULES, labels: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row.

    A rule's verdict is final. It also labels its pages (block: bad), as does ``labels`` (id, bad) where given; from these
    every path template of a host gets its smoothed share of bad pages, ``purity``. Pages without a rule
    are blocked if their template's purity is REJECT or more; rules alone seldom label such a template, so
    without ``labels`` next to nothing is rejected beyond the rules. Numbers and codes in paths are
    generalised first, so the tree is built over distinct shapes of paths, not over pages.

    Null urls and those without ``://`` have empty host and path and are one template of their own. Null or
    repeated ids: rows of their own. An empty table gives an empty result. Further columns are ignored.
    """
    rows = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    rows = rows.withColumn("shape", F.array_join("segs", "/"))
    own = F.when(F.col("rule").isNotNull(), (F.col("rule.verdict") == "block").cast("int"))
    told = rows.withColumn("bad", own)
    if labels is not None:
        by_id = labels.select(F.col(labels.columns[0]).alias("l_id"), F.col(labels.columns[1]).cast("int").alias("l_bad")).groupBy("l_id").agg(F.max("l_bad").alias("l_bad"))
        told = told.join(by_id, F.col("id") == F.col("l_id"), "left").withColumn("bad", F.coalesce("bad", "l_bad"))
    leaves = told.groupBy("host", "shape").agg(
        F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("rule").alias("ruled"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0).cast("long")).alias("bad")
    )
    found = checkpoint(templates(checkpoint(leaves)))
    purity = (F.col("bad") + PRIOR * STRENGTH) / (F.col("labelled") + STRENGTH)
    out = rows.drop("segs").join(found.withColumn("purity", purity), ["host", "shape"])
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id), "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
