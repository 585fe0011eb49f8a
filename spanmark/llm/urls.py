"""Operator 9: URL filters. Suffix rules first; elsewhere a path-template tree per host.

The tree is built level by level over counts, never over pages. A segment is first spelt with its
digit runs as {n}. At each node of the tree:
* of more than `many` children, those with fewer than `support` pages are a variable segment, the wildcard *;
* the others are branches. In the order of their labelled share of blocked pages, each is tested against
  the branch before it (two-proportion z test on pooled counts) and merged into it unless they differ;
  branches without labels merge with each other only. Shares are taken on a grid of GRID steps of the
  arc sine of their root, so a node has at most GRID + 1 of them, however many children it has;
* a merged branch of one child keeps its segment; of several it is *, or *k if the node has others (its
  k-th in order, *0 without labels).
A node of one path keeps what is left of it, and one of fewer than `support` pages with one verdict ends as
**; all others are parted further, however deep, so a tree takes as many rounds as its supported or mixed
nodes are deep.

A template is rejected if it has labelled pages and their blocked share, smoothed towards
its host's, which is smoothed towards one half, reaches `reject`; without labels nothing is
rejected. Labels are the verdicts of the rules themselves.

Null url, or one without "://": host and path are empty, no rule fits, the verdict is that of the
template of the empty host. Repeated page_ids and null ones are judged row by row; other columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SALTS, SHARE = 16, 1000  # a key with over 1 / SHARE of the rows is hot, so fewer than SHARE keys are
GRID = 64
COUNTS = ("n", "labelled", "blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # a longer rule wraps a shorter one
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _joined(left: DataFrame, right: DataFrame, keys: list[str], salt_of: Column, weight: str) -> DataFrame:
    """left join right, a written table with one row a key and the number of its left rows as `weight`.

    The left rows of hot keys are spread over SALTS; only the right rows of these are copied."""
    code, total = F.xxhash64(*keys), right.agg(F.sum(weight)).first()[0] or 0
    hot = code.isin([r[0] for r in right.where(F.col(weight) * SHARE > total).select(code).collect()])
    salted = right.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    salt = F.when(hot, F.pmod(F.xxhash64(salt_of), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return left.withColumn("salt", salt).join(salted, [*keys, "salt"], "left").drop("salt")


def _sums(*more: Column) -> list[Column]:
    return [*(F.sum(c).alias(c) for c in COUNTS), *more]


def _merged(branches: Column, z: float) -> Column:
    """branches: (share, labelled, blocked, members) of a node by rising share. (share, grp, size) of each, where those
    of a group don't differ one after another from what was merged before, and size counts a group's members."""
    start = F.expr("named_struct('out', cast(array() as array<struct<share: int, grp: int, members: long>>), 'grp', 0, 'labelled', 0L, 'blocked', 0L)")

    def step(acc, x):
        pooled = (acc["blocked"] + x["blocked"]) / (acc["labelled"] + x["labelled"])
        spread = F.sqrt(pooled * (1 - pooled) * (1 / acc["labelled"] + 1 / x["labelled"]))
        apart = (acc["labelled"] == 0) | (F.abs(acc["blocked"] / acc["labelled"] - x["blocked"] / x["labelled"]) > z * spread)
        apart = (x["share"] >= 0) & apart  # without labels: group 0
        grp = acc["grp"] + apart.cast("int")
        out = F.concat(acc["out"], F.array(F.struct(x["share"].alias("share"), grp.alias("grp"), x["members"].alias("members"))))
        held = [F.when(apart, x[c]).otherwise(acc[c] + x[c]).alias(c) for c in ("labelled", "blocked")]
        return F.struct(out.alias("out"), grp.alias("grp"), *held)

    groups = F.aggregate(branches, start, step, lambda acc: acc["out"])

    def sized(g, every):
        size = F.aggregate(F.filter(every, lambda o: o["grp"] == g["grp"]), F.lit(0).cast("long"), lambda n, o: n + o["members"])
        return F.struct(g["share"].alias("share"), g["grp"].alias("grp"), size.alias("size"))

    return F.transform(groups, lambda g: sized(g, groups))


def build_tree(spark: SparkSession, paths: DataFrame, many: int = 8, support: int = 20, z: float = 1.96) -> DataFrame:
    """paths: host, path, segments, n, labelled, blocked, a row for each distinct host and path.

    Returns the same rows with `template`, a path of literals and wildcards."""
    here = ["host", "template"]
    rows = written(spark, paths.select("*", F.lit("").alias("template"), (F.size("segments") == 0).alias("ended")), "url-level")
    ended, level = [], 0
    while True:
        ended.append(rows.where("ended").drop("ended"))
        rows = rows.where(~F.col("ended"))
        if not rows.head(1):
            break
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = written(spark, rows.groupBy(*here, "segment").agg(*_sums(F.count(F.lit(1)).alias("paths"))), "url-children")
        nodes = children.groupBy(*here).agg(*_sums(F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("children")))
        one_verdict = (F.col("labelled") == 0) | ((F.col("labelled") == F.col("n")) & ((F.col("blocked") == 0) | (F.col("blocked") == F.col("n"))))
        closes = F.when(F.col("paths") == 1, "rest").when((F.col("n") < support) & one_verdict, "**")
        nodes = written(spark, nodes.select(*here, "children", closes.alias("closes")), "url-nodes")
        both = _joined(children, nodes.withColumn("brothers", F.col("children")), here, F.col("segment"), "children")
        arc = F.round(F.asin(F.sqrt((F.col("blocked") + 0.5) / (F.col("labelled") + 1))) * (2 / math.pi) * GRID).cast("int")
        both = both.withColumns({"thin": (F.col("brothers") > many) & (F.col("n") < support), "share": F.when(F.col("labelled") > 0, arc).otherwise(F.lit(-1))})
        both = written(spark, both, "url-branches")
        shares = both.where(~F.col("thin") & F.col("closes").isNull()).groupBy(*here, "share").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("members"))
        merged = shares.groupBy(*here).agg(F.sum("members").alias("branches"), F.array_sort(F.collect_list(F.struct("share", "labelled", "blocked", "members"))).alias("found"))
        groups = written(spark, merged.select(*here, "branches", F.col("branches").alias("known"), _merged(F.col("found"), z).alias("groups")), "url-groups")
        mine = F.get(F.filter("groups", lambda g: g["share"] == F.col("share")), F.lit(0))
        several = F.when(mine["size"] == F.col("brothers"), F.lit("*")).otherwise(F.concat(F.lit("*"), mine["grp"].cast("string")))
        token = F.when(F.col("closes").isNotNull(), F.lit(None).cast("string")).when(F.col("thin"), F.lit("*")).when(mine["size"] == 1, F.col("segment")).otherwise(several)
        named = _joined(both, groups, here, F.col("segment"), "known").select(*here, "segment", "closes", token.alias("token"), "paths")
        rows = _joined(rows, written(spark, named, "url-tokens"), [*here, "segment"], F.col("path"), "paths")
        level += 1
        rest = F.when(F.col("closes") == "rest", F.array_join(F.slice("segments", level, F.size("segments")), "/")).otherwise(F.coalesce("token", "closes"))
        over = F.col("closes").isNotNull() | (F.size("segments") <= level)
        rows = written(spark, rows.select(*paths.columns, F.concat("template", F.lit("/"), rest).alias("template"), over.alias("ended")), "url-level")
    return reduce(DataFrame.union, ended)


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, strength: float = 4.0, reject: float = 0.6, many: int = 8, support: int = 20, z: float = 1.96) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template and its smoothed purity."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path")).select("*", *(c.alias(k) for c, k in zip(rule_columns(F.col("host"), F.col("path"), rules), ("rule", "ruled"))))
    seen = seen.select(*(c if c == "page_id" else F.coalesce(c, F.lit("")).alias(c) if c in ("host", "path") else F.col(c) for c in seen.columns))
    paths = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    paths = paths.withColumn("segments", F.filter(F.split(F.regexp_replace("path", "[0-9]+", "{n}"), "/"), lambda s: s != ""))
    tree = written(spark, build_tree(spark, paths, many, support, z).drop("segments"), "url-tree")
    templates = written(spark, tree.groupBy("host", "template").agg(*_sums(F.count(F.lit(1)).alias("paths"))).drop("n"), "url-templates")
    hosts = templates.groupBy("host").agg(((F.sum("blocked") + strength / 2) / (F.sum("labelled") + strength)).alias("host_rate"), F.count(F.lit(1)).alias("templates"))
    rated = _joined(templates, written(spark, hosts, "url-hosts"), ["host"], F.col("template"), "templates")
    purity = (F.col("blocked") + strength * F.col("host_rate")) / (F.col("labelled") + strength)
    rated = written(spark, rated.select("host", "template", purity.alias("purity"), (F.col("labelled") > 0).alias("told"), "paths"), "url-purity")
    judged = _joined(tree.select("host", "path", "template", "n"), rated, ["host", "template"], F.col("path"), "paths")
    out = _joined(seen, written(spark, judged, "url-judged"), ["host", "path"], F.monotonically_increasing_id(), "n")
    verdict = F.coalesce("ruled", F.when(F.col("told") & (F.col("purity") >= reject), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
