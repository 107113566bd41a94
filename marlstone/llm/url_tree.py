"""URL filters: explicit rules, and a tree of path templates per host.

The tree is built level by level. Under each (host, template so far) the next
segment is variable if its form is that of an id, or if the distinct segments seen
there are many for the number of pages; it then becomes a wildcard. A branch with
too few distinct paths for that, at this level or any below, is done with the rest
of its path as it is; segments that all paths of a branch share are passed in one
step. So the levels are as many as branch, however long a path is.

Templates of one host that differ only in literal segments are branches of one
skeleton; those whose labelled rate is statistically like that of the skeleton are
merged into it, and so are branches without labels. The share of bad labels of a
template is smoothed towards that of its host, the host's towards its parent
domain's, and so on up to all labels; a template is rejected where that reaches
the threshold. Where few labels or none are at hand, those around decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: Segments with the form of an id (fixed values): digits, or eight hexadecimal digits and more, with or without an extension.
ID_SEGMENT = r"^([0-9]+|[0-9a-fA-F-]{8,})(\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end. Null or no ://: both empty."""
    pattern = r"://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls. A rule fits its host and all subdomains where the path starts with its path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _levels(counted: DataFrame, min_children: int, max_repeat: float) -> DataFrame:
    """counted (host, shape, n, ...; unique by host and shape) with template."""
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    active = counted.withColumns({"rest": segments, "template": F.lit("")})
    whole = F.concat("template", F.when((F.size("rest") > 0) | (F.col("template") == ""), F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise(F.lit("")))
    out = None
    while True:
        segment = F.get("rest", F.lit(0))
        literal = segment.isNotNull() & (segment != "*")
        children = active.groupBy("host", "template", segment.alias("segment")).agg(F.first(literal).alias("literal"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("shapes"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        named = F.col("literal")
        nodes = children.groupBy("host", "template").agg(
            F.count_if(named).alias("children"), F.sum(F.when(named, F.col("n")).otherwise(F.lit(0))).alias("pages"), F.sum("shapes").alias("shapes"), F.min("low").alias("low"), F.max("high").alias("high"),
        )
        variable = (F.col("children") >= min_children) & (F.col("pages") <= max_repeat * F.col("children"))
        # what the least and the greatest path share, all share
        same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
        shared = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0))
        shared = F.when(F.array_position(same, F.lit(False)) > 0, shared).otherwise(F.size("low"))
        nodes = nodes.filter(F.col("shapes") >= min_children).select("host", "template", variable.alias("variable"), F.greatest(shared, F.lit(1)).cast("int").alias("step"))
        met = cut(active.join(nodes, ["host", "template"], "left"))
        ended = met.filter(F.col("step").isNull() | (F.size("rest") == 0)).select(*counted.columns, whole.alias("template"))
        out = ended if out is None else out.unionByName(ended)
        going = met.filter(F.col("step").isNotNull() & (F.size("rest") > 0))
        taken = F.when(F.col("variable"), F.lit("*")).otherwise(F.array_join(F.slice("rest", F.lit(1), F.col("step")), "/"))
        active = going.select(*counted.columns, F.slice("rest", F.col("step") + 1, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), F.concat("template", F.lit("/"), taken).alias("template"))
        if going.isEmpty():
            return out


def _hosts(counted: DataFrame, weight: float) -> DataFrame:
    """(host, purity): the share of bad labels of each host, smoothed towards each of the domains above it in turn, the first of which is all hosts."""
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad_labels").alias("bad_labels"))
    labels = F.split("host", r"\.")
    # the domains of a.b.c are "", "c", "b.c" and "a.b.c"
    domains = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("domain")))
    spread = hosts.select("host", "labelled", "bad_labels", F.explode(domains).alias("d")).select("host", "labelled", "bad_labels", "d.depth", "d.domain")
    sums = spread.groupBy("depth", "domain").agg(F.sum("labelled").alias("of"), F.sum("bad_labels").alias("bad"))
    met = spread.select("host", "depth", "domain").join(sums, ["depth", "domain"])
    chain = met.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("depth", "of", "bad"))).alias("chain"))
    step = lambda purity, d: (d["bad"] + weight * purity) / (d["of"] + weight)
    return chain.select("host", F.aggregate("chain", F.lit(0.0), step).alias("purity"))


def templates(pages: DataFrame, *, min_children: int = 16, max_repeat: float = 4.0, z: float = 2.0, prior_weight: float = 5.0, bad_share: float = 0.6) -> DataFrame:
    """From rows (host, path, bad boolean or null): one row (host, shape, template, labelled, bad_labels, smoothed, rejected) per host and shape.

    shape is the path with id segments generalised, as shape_of gives it; paths
    have any depth. Hosts and paths may be empty. The counts are aggregated before
    any join, so a host with a third of all pages costs a row per task and shape.
    A host's domains are as many as its labels and are folded in one row.
    """
    counted = cut(
        pages.select(F.coalesce("host", F.lit("")).alias("host"), shape_of(F.col("path")).alias("shape"), "bad")
        .groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad_labels"))
    )
    hosts = _hosts(counted, prior_weight)
    tree = _levels(counted, min_children, max_repeat)
    branches = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad_labels").alias("bad_labels"))
    branches = branches.withColumn("skeleton", F.regexp_replace("template", r"[^/*]+", "*"))
    trunks = branches.groupBy("host", "skeleton").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad_labels").alias("all_bad"))
    branches = branches.join(trunks, ["host", "skeleton"]).join(hosts, "host")
    pooled = (F.col("all_bad") + prior_weight * F.col("purity")) / (F.col("all_labelled") + prior_weight)
    spread = F.sqrt(pooled * (1 - pooled) * F.greatest(F.col("labelled"), F.lit(1)))
    like = F.abs(F.col("bad_labels") - F.col("labelled") * pooled) <= z * spread + 1e-9
    branches = cut(branches.withColumn("merged", F.when(like, F.col("skeleton")).otherwise(F.col("template"))))
    final = branches.groupBy("host", "merged", "purity").agg(F.sum("labelled").alias("labelled"), F.sum("bad_labels").alias("bad_labels"))
    final = final.withColumn("smoothed", (F.col("bad_labels") + prior_weight * F.col("purity")) / (F.col("labelled") + prior_weight))
    final = final.withColumn("rejected", F.col("smoothed") >= bad_share)
    names = branches.select("host", "template", "merged").join(final, ["host", "merged"])
    return tree.select("host", "shape", "template").join(names, ["host", "template"]).select("host", "shape", F.col("merged").alias("template"), "labelled", "bad_labels", "smoothed", "rejected")


def shape_of(path: Column) -> Column:
    """The path with empty segments dropped and id segments as *."""
    segments = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.rlike(ID_SEGMENT), F.lit("*")).otherwise(s)), "/"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], **options) -> DataFrame:
    """One row per row of (page_id, url): page_id, host, path, rule, verdict, template, smoothed.

    A fitting rule decides; its verdict also labels the page for the tree (block:
    bad). Any other page is blocked if its template is rejected, else allowed.
    smoothed is the share of bad labels that decides this. Null urls have an empty host and path and follow the same law; repeated rows
    each get a row; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "says": says, "shape": shape_of(F.col("path"))})
    tree = templates(seen.withColumn("bad", F.col("says") == "block"), **options)
    joined = seen.join(tree.select("host", "shape", "template", "smoothed", "rejected"), ["host", "shape"], "left")
    verdict = F.coalesce("says", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "smoothed")
