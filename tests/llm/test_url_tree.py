"""The template tree against a plain one, and urls of any form."""

import random
import re
from collections import defaultdict

from pyspark.sql import types as T

from marlstone.llm import registry, url_tree

ID = re.compile(url_tree.ID_SEGMENT)
PATHS = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("bad", T.BooleanType())])


def shape(path):
    return "/" + "/".join("*" if ID.match(s) else s for s in (path or "").split("/") if s)


def plain(rows, children=16, repeat=4.0, z=2.0, weight=5.0, share=0.6):
    """{(host, shape): (template, smoothed, rejected)}, level by level and host by host."""
    counts = defaultdict(lambda: [0, 0, 0])
    for host, path, bad in rows:
        c = counts[host or "", shape(path)]
        c[0] += 1
        c[1] += bad is not None
        c[2] += bool(bad)
    purity = {}
    total = defaultdict(lambda: [0, 0])
    for (host, _), (_, n, bad) in counts.items():
        parts = host.split(".")
        for k in range(len(parts) + 1):
            total[k, ".".join(parts[len(parts) - k :])][0] += n
            total[k, ".".join(parts[len(parts) - k :])][1] += bad
    for host in {h for h, _ in counts}:
        parts, p = host.split("."), 0.0
        for k in range(len(parts) + 1):
            n, bad = total[k, ".".join(parts[len(parts) - k :])]
            p = (bad + weight * p) / (n + weight)
        purity[host] = p
    template = {key: "" for key in counts}
    rest = {key: [s for s in key[1].split("/") if s] for key in counts}
    for level in range(max((len(r) for r in rest.values()), default=0)):
        nodes = defaultdict(list)
        for key in counts:
            if len(rest[key]) > level:
                nodes[key[0], template[key]].append(key)
        for keys in nodes.values():
            literal = [k for k in keys if rest[k][level] != "*"]
            kinds = {rest[k][level] for k in literal}
            variable = len(kinds) >= children and sum(counts[k][0] for k in literal) <= repeat * len(kinds)
            for k in keys:
                template[k] += "/" + ("*" if variable else rest[k][level])
    template = {k: t or "/" for k, t in template.items()}
    branch, trunk = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    skeleton = lambda t: re.sub("[^/*]+", "*", t)
    for (host, s), (_, n, bad) in counts.items():
        t = template[host, s]
        for where, name in ((branch, t), (trunk, skeleton(t))):
            where[host, name][0] += n
            where[host, name][1] += bad
    merged, final = {}, defaultdict(lambda: [0, 0])
    for (host, t), (n, bad) in branch.items():
        all_n, all_bad = trunk[host, skeleton(t)]
        pooled = (all_bad + weight * purity[host]) / (all_n + weight)
        like = abs(bad - n * pooled) <= z * (pooled * (1 - pooled) * max(n, 1)) ** 0.5 + 1e-9
        merged[host, t] = skeleton(t) if like else t
        final[host, merged[host, t]][0] += n
        final[host, merged[host, t]][1] += bad
    out = {}
    for host, s in counts:
        name = merged[host, template[host, s]]
        n, bad = final[host, name]
        smoothed = (bad + weight * purity[host]) / (n + weight)
        out[host, s] = (name, smoothed, smoothed >= share)
    return out


def same(spark, rows):
    got = {(r.host, r["shape"]): r for r in url_tree.templates(spark.createDataFrame(rows, PATHS)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for key, (name, smoothed, rejected) in want.items():
        assert got[key].template == name and abs(got[key].smoothed - smoothed) < 1e-12 and got[key].rejected == rejected, (key, got[key], want[key])


def test_tree_matches_a_plain_one(spark):
    rng = random.Random(4)
    rows = []
    for host in ("a.x.com", "b.x.com", "y.net", "", "q"):
        lean = rng.random()
        for _ in range(400):
            path = [rng.choice(["en", "de", "fr"])] + [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(rng.randrange(4))] + rng.choice([[], [str(rng.randrange(999))], [f"{rng.random():.12f}"]])
            rows.append((host, "/" + "/".join(path), rng.choice([None, None, rng.random() < lean])))
    rows += [("a.x.com", "/long/" + "/".join("abcdefghijklmnopqrstuvwxyz" * 20) + f"/{k:x}g", k % 2 == 0) for k in range(40)]
    rows += [("y.net", "/" + "/".join(["same"] * k), True) for k in range(30)] + [(None, None, None), ("..", "//", True), ("y.net", "//en//x/", None)]
    same(spark, rows)


def test_query_matches_the_plain_tree(spark):
    """Pages that no rule decides get both verdicts, the plain tree's."""
    sf = "/root/testdata/sf0.01"
    got = registry.op10_url_filter(spark, sf).collect()
    says = {name: verdict for verdict, h, p in registry.URL_RULES for name in [h + p]}
    want = plain([(r.host, r.path, None if r.rule is None else says[r.rule] == "block") for r in got])
    free = [r for r in got if r.rule is None]
    assert all(r.verdict == ("block" if want[r.host, shape(r.path)][2] else "allow") and abs(r.smoothed - want[r.host, shape(r.path)][1]) < 1e-12 for r in free)
    assert {r.verdict for r in free} == {"allow", "block"}


def test_pages_without_rule_go_by_their_host(spark):
    rules = [("block", "bad.com", "/a/"), ("block", "bad.com", "/b/"), ("block", "mixed.com", "/a/"), ("allow", "mixed.com", "/b/"), ("allow", "good.com", "/a/"), ("allow", "good.com", "/b/")]
    urls = [f"http://{h}.com/{s}/{i}" for h in ("bad", "mixed", "good") for s in "abc" for i in range(12)] + ["http://bad.com/deep/er/1", "http://none.com/c/1", "http://sub.bad.com/c/1"]
    rows = [(k, u, "x", "y", "z", "w", "v") for k, u in enumerate(urls * 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, template string")
    got = url_tree.judge_urls(frame, rules).collect()
    assert len(got) == 2 * len(urls)
    blocked = sorted(urls[r.page_id % len(urls)] for r in got if r.verdict == "block" and r.rule is None)
    assert blocked == sorted([*[f"http://bad.com/c/{i}" for i in range(12)], "http://bad.com/deep/er/1", "http://sub.bad.com/c/1"] * 2)


def test_very_long_and_deep_urls(spark):
    urls = ["http://h.com/" + "/".join(["s"] * 3000) + f"/{k}x" for k in range(40)] + ["http://" + ".".join("ab" * 50) + "/" + "x" * 300_000, "http://h.com/" + "/" * 5000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_tree.judge_urls(frame, registry.URL_RULES).collect()
    assert len(got) == len(urls) and {r.verdict for r in got} == {"allow"}
    assert sum(r.template.count("/") > 3000 for r in got) == 40
