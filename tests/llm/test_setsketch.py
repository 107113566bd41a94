"""SetSketch, components and near-duplicates against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import common, setsketch
from marlstone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, component string, key long, lang string"


def plain_set(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set(map(tuple, (w[i : i + n] for i in range(len(w) - n + 1)))) if len(w) >= n else {tuple(w)} if w else set()


def plain_components(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def plain_near(rows, n, percent):
    sets = {}
    links = []
    for i, (doc, text, *_) in enumerate(rows):
        s = plain_set(text, n)
        for d, t in sets.values():
            if doc is not None and d is not None and (doc == d or s and t and 100 * len(s & t) >= percent * len(s | t)):
                links.append((doc, d))
        sets[i] = (doc, s)
    return plain_components({r[0] for r in rows if r[0] is not None}, links)


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5), (None, 7), (3, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == plain_components({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_maybe_has_no_false_negatives(spark):
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("doc_id"))
    rows = spark.range(5000).select(F.col("id").alias("doc_id")).union(spark.sql("select cast(null as long)"))
    got = {r.doc_id: r._maybe for r in common.with_maybe(rows, ids, "doc_id").collect()}
    assert len(got) == 5001 and all(got[k] for k in range(0, 5000, 7)) and sum(got.values()) < 760 and not got[None]


def test_registers_merge_and_estimate():
    sketch = setsketch.Sketch()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    make = lambda v: sketch.registers(v, np.array([0, len(v)]))[0]
    assert (setsketch.merge(make(x[:2000]), make(x[1000:])) == make(x)).all()
    for j, want in ((0.9, True), (0.8, True), (0.5, False), (0.2, False)):
        k = int(2 * 1500 * j / (1 + j))
        a, b = make(x[:1500])[None], make(x[1500 - k : 3000 - k])[None]
        assert sketch.can_reach(a, b, np.array([1500.0]), np.array([1500.0]), 0.8)[0] == want
        assert abs((a == b).mean() - j) < 0.12


def test_shingles_match_plain():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one", "a b", "A B a b", *[" ".join(rng.choices("ab cd Ef gh".split(), k=rng.randint(1, 30))) for _ in range(60)]]
    for n in (1, 2, 5):
        h, first = setsketch.shingles(pa.array(texts), n)
        own = [frozenset(h[a:b].tolist()) for a, b in zip(first, first[1:])]
        assert [len(s) for s in own] == [len(plain_set(t, n)) for t in texts]
        for i, s in enumerate(own):
            for j, t in enumerate(own):
                assert len(s & t) == len(plain_set(texts[i], n) & plain_set(texts[j], n))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(60):
        base = rng.choices(vocabulary, k=rng.choice([2, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06, 0.12]) else w for w in base]
            rows.append((len(rows), " ".join(text), "c", 0, "en"))
    rows += [(1000 + i, t, "c", 0, None) for i, t in enumerate([None, "", "Zz", "zZ", "zz  ", " \t", "solo word"])]
    rows += [rows[3], (7, "another text of the same id", "c", 1, "x"), (None, rows[4][1], "c", 1, "x"), (2000, "w1 w2 w3 " * 4000, "c", 1, "x"), (2001, "w1 w2 w3 " * 4000 + "w9", "c", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for n, percent in ((2, 80), (5, 80)):
        got = setsketch.near_duplicates(docs, n=n, percent=percent).collect()
        assert len(got) == len(rows)
        want = plain_near(rows, n, percent)
        sizes = sorted(((r[0] if r[0] is not None else -1), len(plain_set(r[1], n))) for r in rows)
        assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles) for r in got) == sizes
        for r in got:
            assert r.component_id == want.get(r.doc_id), (n, r)
            assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        kept = setsketch.drop_near_duplicates(docs, n=n, percent=percent)
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == docs.columns and None in ids
        ids.remove(None)
        assert sorted(ids) == sorted(set(want.values()))
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0
    assert setsketch.drop_near_duplicates(docs.limit(0)).count() == 0


def test_tiles_hold_every_pair_once(spark):
    rows = [(g, g * 1000 + k, k % 7, g > 2 and k % 5 < main) for g, n, main in ((1, 1, 0), (2, 5, 0), (3, 60, 0), (4, 60, 3), (5, 50, 5)) for k in range(n)]
    frame = spark.createDataFrame(rows, "g long, node long, w long, main boolean")
    for options in ((8,), (100, "w", 20)):
        tiles = {}
        for r in common.tiled(frame, ["g"], *options).collect():
            tiles.setdefault((r.g, r.i, r.j), ([], []))[r.side].append(r.node)
        pairs = []
        for (_, i, j), (left, right) in tiles.items():
            pairs += [tuple(sorted((a, b))) for x, a in enumerate(left) for b in (left[:x] if i == j else right)]
            assert max(len(left), len(right)) <= 30
            if i < 0:
                assert left and right
        want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
        both = {(a[1], b[1]) for a in rows for b in rows if a[3] and b[3]}
        assert sorted(p for p in pairs if p not in both) == sorted(p for p in want if p not in both) and len(set(pairs)) == len(pairs)


def test_rows_of_a_large_component_grow_in_proportion(spark):
    rows = [(1, k, k >= 10) for k in range(5000)]
    frame = spark.createDataFrame(rows, "g long, node long, main boolean")
    assert common.tiled(frame, ["g"], 100).count() <= 5000 + 10 * 52


def test_small_tiles_give_the_same_components(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(25):
            rows.append((len(rows), " ".join(rng.choice("xyz") + str(rng.randint(0, 999)) if rng.random() < 0.05 else w for w in base), "c", 0, "en"))
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(setsketch, "SIDE_ROWS", 6)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs, n=2).collect()}
    assert got == plain_near(rows, 2, 80) and len(set(got.values())) > 12


def test_linked_rows_match_plain_sets(monkeypatch):
    monkeypatch.setattr(setsketch, "SLAB", 7)
    monkeypatch.setattr(setsketch, "BLOCK_PAIRS", 40)
    rng = random.Random(9)
    for round_ in range(30):
        base = [rng.getrandbits(62) - 2**61 for _ in range(25)]
        sets = [sorted({x if rng.random() < 0.9 else rng.choice(base) + k for x in rng.sample(base, rng.randint(1, 25))}) for k in range(rng.randint(1, 40))]
        cut = rng.randint(0, len(sets))
        left, right = (np.arange(len(sets)),) * 2 if round_ % 2 else (np.arange(cut), np.arange(cut, len(sets)))
        links = [(i, j) for i in left.tolist() for j in right.tolist() if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})]
        want = plain_components(range(len(sets)), links)
        hashes = np.array([x for s in sets for x in s], np.int64)
        assert setsketch.linked_rows(hashes, np.array([len(s) for s in sets]), left, right, 80).tolist() == [want[k] for k in range(len(sets))]


def test_a_full_tile_of_linked_rows_stays_small():
    # the matrix of counts is 17 MB; lists of all linked pairs took 330 MB
    side, size = setsketch.SIDE_ROWS, 100
    rng = np.random.default_rng(3)
    sets = np.tile(np.arange(size), (2 * side, 1))
    sets[:, 0] = rng.integers(1000, 2**40, 2 * side)
    tracemalloc.start()
    root = setsketch.linked_rows(sets.ravel(), np.full(2 * side, size), np.arange(side), np.arange(side, 2 * side), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all()
    assert peak < 120e6, peak
