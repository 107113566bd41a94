"""The pigeonhole join against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import embeddings, registry
from tests.llm.test_setsketch import plain_components

VECTORS = "vec_id long, embedding array<float>, label int, block string, node string"


def plain(rows, least):
    good = {}
    for k, (i, v, label, *_) in enumerate(rows):
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    links, edges = [0] * len(rows), []
    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                edges.append((rows[a][0], rows[b][0]))
    parts = plain_components({r[0] for r in rows}, edges)
    return sorted((-1 if r[0] is None else r[0], links[k], -1 if r[0] is None else parts[r[0]]) for k, r in enumerate(rows))


def check(spark, rows, least, how):
    df = spark.createDataFrame(rows, VECTORS)
    got = embeddings.link_vectors(df, least=least, how=how).collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == plain(rows, least)


def test_all_links_are_found(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.standard_normal(24) * rng.choice([0, 0.05, 0.3, 0.4, 0.6])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1, 7])], int(rng.integers(0, 3)), "x", "y"))
    rows += [(k + 10_000, list(rows[k][1]), rows[k][2], "x", "y") for k in range(30)]
    odd = [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(20_000 + k, v, 1, "x", "y") for k, v in enumerate(odd)] + [(20_100, rows[0][1], None, "x", "y"), (None, rows[0][1], rows[0][2], "x", "y"), (3, rows[50][1], rows[50][2], "x", "y"), rows[9]]
    for how in (embeddings.Pigeonhole(block=8, tile=16), embeddings.Pigeonhole(block=5, axes=3, cell=1.0, tile=1000)):
        check(spark, rows, 0.93, how)
    check(spark, rows[:200], 0.6, embeddings.Pigeonhole(block=6, tile=9))
    assert embeddings.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_query_matches_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = registry.op1_pigeonhole(spark, "/root/testdata/sf0.001").select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == plain(rows, 0.93)


def test_rows_of_one_id_have_links_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.05, 0.0]), (7, [0.0, 1.0, 0.05]), (8, [0.0, 1.0, 0.1]), (2, [0.0, 0.0, 1.0])]
    rows = [(i, v, 1, "x", "y") for i, v in rows]
    check(spark, rows, 0.93, embeddings.Pigeonhole(block=2))
    got = embeddings.link_vectors(spark.createDataFrame(rows, VECTORS), how=embeddings.Pigeonhole(block=2)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(2, 0, 2), (5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]


def test_very_large_finite_components_count(spark):
    rows = [(1, [1.75e308, 1e300]), (2, [1.0, 0.0]), (3, [float("inf"), 0.0]), (4, [5e-324, 0.0])]
    got = embeddings.link_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]


def test_rotation_is_orthogonal_and_deals_wide_axes_first():
    rng = np.random.default_rng(2)
    how = embeddings.Pigeonhole(block=4)
    x = rng.standard_normal((500, 10)) * np.arange(1, 11)
    turn = embeddings.principal(x.T @ x, how)
    assert np.allclose(turn.T @ turn, np.eye(10))
    spread = (x @ turn).var(0)
    firsts = [a for a, _ in how.blocks(10)]
    assert sorted(spread)[-len(firsts) :] == sorted(spread[firsts])
