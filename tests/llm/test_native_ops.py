"""Chat formatting, mixing, sharding and URL filters against plain versions of the same laws."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import chat_format, mixing, registry, sharding, url_tree

SF = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, formatted string"
DOCS = "doc_id long, text string, source string, shard string, size long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["<|turn|>", "<|says|>", "<|end|>", "[INST]", "</s>", "<s>", "<<SYS>>", "<", "[", "\\", "<\\|end|>", "<\\\\|end|>", "|end|>", "a", "\n", " é𝒳", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|end|>", None]), rng.choice([None, *["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(9)]]), "clash"))
    rows += [(60, 0, "user", "same", "x"), (60, 0, "user", "same", "x"), (None, None, "assistant", "x" * 200_000, "x")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert len(got) == 62
    for conv, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert r.exact and [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss_texts == [x[2] for x in own if x[1] == "assistant"]
        tpl = chat_format.ChatTemplate()
        assert r.formatted.count(tpl.close) == len(own) and r.formatted.count(tpl.open) == len(own)
        raw = [r.formatted[s["from"] : s["to"]] for s in r.loss_spans]
        back = re.compile("|".join(rf"({a}\\*)\\(?={b})" for a, b in tpl.groups()))
        assert [back.sub(lambda m: m[0][:-1], x) for x in raw] == r.loss_texts
    assert chat_format.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_query_digests(spark):
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: r for r in registry.op2_chat_format(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = {}
    for c, *rest in sorted(rows):
        by.setdefault(c, []).append(rest)
    assert set(by) == set(got)
    for c, turns in by.items():
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def _documents(spark, rng, n=400):
    rows = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "a", "é", "z", None])
        rows.append((i, " \t".join(["w"] * rng.choice([0, 1, 5, 40, 90])), source, "clash", -1))
    rows += [(7, "x y", "a", "c", 1)] * 3 + [(None, None, None, None, None), (900, "q " * 3000, "b", "", 0)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mixing_meets_targets(spark):
    rows, docs = _documents(spark, random.Random(2))
    mix = mixing.mixed(docs)
    got = mixing.mix_report(mix).collect()
    assert sorted(r.size for r in got) == sorted(len((x[1] or "").split()) for x in rows)
    sizes = {}
    for x in rows:
        sizes[x[2]] = sizes.get(x[2], 0) + len((x[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    plan = {r.source: r for r in mix.targets.collect()}
    assert all(abs(plan[s].target - target[s]) < 1e-6 for s in order)
    taken = {}
    for r in mix.rows.withColumn("taken", F.col("size") * F.col("laps")).collect():
        assert 0 <= r.laps <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 3000 for s in order)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.mix_report(mixing.mixed(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.laps for r in mix.rows.collect())
    assert mixing.mix_report(mixing.mixed(spark.createDataFrame([], DOCS))).count() == 0
    assert mixing.mix_report(mixing.mixed(spark.createDataFrame([(1, None, None, "", 0)], DOCS))).first().taken == 0


def test_sharding_is_gapless_and_even(spark):
    rng = random.Random(3)
    rows = [(i, "t" * rng.choice([0, 9, 200, 1500]) + (str(i) if i % 3 else ""), "s", "clash", 0) for i in range(3000)]
    rows += [(5000 + i, "copied text " * 20, "s", "x", 0) for i in range(1500)] + [(None, None, None, None, None), (9, "é", "s", "x", 0), (9, "é", "s", "x", 0)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 24).collect()
    want = sorted((x[0] if x[0] is not None else -1, len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    load = np.zeros(24)
    slots = {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert load.max() / load.min() < 1.02
    again = sharding.assign_shards(spark.createDataFrame(rows, DOCS).repartition(5), 24).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_of_copies(spark, monkeypatch):
    """Rows equal in id and text are spread; other groups stay whole, each an item of its own where they are large."""
    monkeypatch.setattr(sharding, "COPIES", 100)
    rng = random.Random(8)
    rows = [(None, None, "s", "x", 0)] * 4000 + [(7, "same id and text " * 5, "s", "x", 0)] * 2000 + [(i, f"{i % 1000} " * rng.randint(1, 60), "s", "x", 0) for i in range(6000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 24, parcels=512).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 4000
    load = np.bincount([r.shard for r in got], [r.size for r in got], 24)
    assert load.max() / load.min() < 1.02
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in got:
        if r.doc_id not in (None, 7):
            homes.setdefault(r.text_crc32, set()).add(r.shard)
    piece = sum(r.size for r in got) / 24 / 64
    size = {}
    for r in got:
        size[r.text_crc32] = size.get(r.text_crc32, 0) + r.size
    assert all(len(h) == 1 for c, h in homes.items() if size[c] <= piece)


def test_url_rules(spark):
    urls = [None, "", "nohost", "http://A.Example.ORG/es/1?x", "x://org/p", "http://borg/p", "http://example.org/en/12#t", "https://c.com/de/5", "https://c.com/fr/5", "https://c.com", "https://é.ÉxamplE.com/de", "a://b.org/c://d.com/de/1", "http://h.net/x\ny/1"]
    got = {r.page_id: r for r in url_tree.judge_urls(pages(spark, urls), registry.URL_RULES).collect()}
    want = [("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("org", "/p", "org/"), ("borg", "/p", None), ("example.org", "/en/12", "example.org/en/1"), ("c.com", "/de/5", "com/de/"), ("c.com", "/fr/5", "com/fr/"), ("c.com", "", None), ("é.Éxample.com", "/de", None), ("b.org", "/c://d.com/de/1", "org/"), ("h.net", "/x\ny/1", None)]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    assert all((got[i].verdict == "block") == (i in (3, 6, 7)) for i in got)
    assert url_tree.judge_urls(pages(spark, []), registry.URL_RULES).count() == 0


def test_url_tree_learns_templates(spark):
    rows = [("h", f"/ads/{i}", True) for i in range(40)] + [("h", f"/news/{i}.html", False) for i in range(40)] + [("h", f"/blog/{i}", False) for i in range(40)]
    rows += [("h", f"/user/name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{chr(97 + i // 26)}x", None) for i in range(60)] + [("k", "", None), ("k", "/" + "/".join("abcdefghijkl"), None)]
    tree = url_tree.templates(spark.createDataFrame(rows, T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("bad", T.BooleanType())])))
    got = {r["shape"]: r for r in tree.collect()}
    assert got["/ads/*"].rejected and not got["/news/*"].rejected and not got["/blog/*"].rejected
    assert {r.template for r in got.values() if r["shape"].startswith("/user/")} <= {"/user/*", "/*/*"}
    assert got["/ads/*"].template == "/ads/*"


def test_queries_on_documents_and_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    shards = {r.doc_id: r for r in registry.op3_sharding(spark, SF).collect()}
    assert {d.doc_id: (len(d.text.encode()) + 8, zlib.crc32(d.text.encode())) for d in docs} == {k: (r.size, r.text_crc32) for k, r in shards.items()}
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None for r in shards.values())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = {d.doc_id: len(word.findall(d.text)) for d in docs}
    per = {}
    for d in docs:
        per[d.source] = per.get(d.source, 0) + sizes[d.doc_id]
    source = {d.doc_id: d.source for d in docs}
    mixed = registry.op8_mixing(spark, SF).collect()
    assert {r.doc_id: r.size for r in mixed} == sizes and all(r.source_size == per[source[r.doc_id]] and r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size + 1e-6 for r in mixed)
    assert abs(sum({source[r.doc_id]: r.target for r in mixed}.values()) - 1.5 * sum(per.values())) < 1e-3
    urls = {p.page_id: p.url for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.op10_url_filter(spark, SF).collect():
        rest = urls[r.page_id].split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host.lower(), path, max(fits)[1] if fits else None) and (not fits or r.verdict == max(fits)[2])
