"""The pipeline against plain versions of its stages, on the smallest tables."""

import corpus_pipeline
from marlstone.llm import pieces
from tests.llm.test_quality import plain
from tests.llm.test_setsketch import plain_near

SF = "/root/testdata/sf0.001"


def test_run_matches_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    current, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        current = stage(spark, current, SF)
        assert current.columns == columns
        current = spark.createDataFrame(current.collect(), current.schema)
        seen.append([r.doc_id for r in current.collect()])
    # 200 documents are too few to certify a cutoff, so the base rules decide
    features = {d: plain(r.text) for d, r in docs.items()}
    good = {d for d, f in features.items() if f["n_words"] >= 50 and 100 * f["n_repeat_words"] <= 50 * f["n_words"]}
    assert sorted(seen[0]) == sorted(good)
    near = plain_near([(d, docs[d].text) for d in sorted(good)], 5, 80)
    assert sorted(seen[1]) == sorted(set(near.values()))
    sizes, taken = {}, {}
    for d in seen[1]:
        sizes[docs[d].source] = sizes.get(docs[d].source, 0) + features[d]["n_words"]
    for d in seen[2]:
        taken[docs[d].source] = taken.get(docs[d].source, 0) + features[d]["n_words"]
    assert all(seen[2].count(d) in (1, 2) for d in seen[2]) and set(seen[2]) <= set(seen[1])
    longest = max(features[d]["n_words"] for d in good)
    assert 1.5 * sum(sizes.values()) - longest <= sum(taken.values()) <= 1.5 * sum(sizes.values())
    model = pieces.PieceModel.load()
    final = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in final) == sorted(seen[2])
    assert all(r.n_tokens == len(r.ids) and model.decode(r.ids) == docs[r.doc_id].text for r in final)


def test_stages_stand_odd_tables(spark):
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_row", "_kept", "_copy", "_keep", "_maybe", "key", "node", "place", "n_words", "ids"]
    null = base.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in base.dtypes])
    odd = spark.createDataFrame([(1, "", "en", None, 0), (1, "", "en", None, 0), (2, " \n ", None, "a", 3), (3, "word " * 60_000, "en", "a", 1)], base.schema)
    docs = base.union(null).union(null).union(odd).select("*", *[F.lit("clash").alias(n) for n in names])
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "tokenize":
            assert out.columns == docs.columns and all(r[n] == "clash" for r in rows for n in names), name
        assert rows, name
