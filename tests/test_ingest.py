"""Delimited files to typed rows, envelopes, and idempotent inserts, on hand-written inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import buckets, coerce
from marlstone.operators import envelope, ingest
from marlstone.sources import tsv
from marlstone.sources.catalog import DATASETS, select_datasets


def write_gz(path, lines, newline="\n"):
    with gzip.open(path, "wb") as f:
        f.write((newline.join(lines) + newline).encode())
    return str(path)


BASICS = "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres"


def test_dirty_basics(spark, tmp_path):
    lines = [
        "﻿" + BASICS,
        't1\tmovie\t "quoted" \tx\t0\t1999\t\\N\t90\tDrama,Comedy',
        "t2\tmovie\tnull genres\t\\N\t2\t40000\t1_000\t 12 \ta,,b",
        "",
        "t3\tshort\tshort row",
        "t4\tmovie\textra\tx\t1\t2000\t\\N\t1\tA\tB",
        "\\N\tmovie\tno key\tx\t1\t2000\t\\N\t1\tA",
        "t5\tmovie\tbig\tx\t1\t2000\t\\N\t3000000000\tA",
        "t6\tmovie\told list\tx\t1\t-5\t\\N\tx\tA\x02B\x02",
        "t7\tmovie\tempty list\t\t\t\t\t\t,,",
    ]
    path = write_gz(tmp_path / "title.basics.tsv.gz", lines)
    rows = tsv.read_dataset(spark, path, "title_basics").cache()
    good = {r.tconst: r for r in tsv.accepted(rows, DATASETS["title_basics"]).collect()}
    assert set(good) == {"t1", "t2", "t3", "t4", "t6", "t7"} and good["t4"].genres == ["A"] and good["t4"].runtime_minutes == 1
    assert good["t1"].primary_title == ' "quoted" ' and good["t1"].end_year is None and good["t1"].genres == ["Drama", "Comedy"] and good["t1"].is_adult is False
    assert (good["t2"].is_adult, good["t2"].start_year, good["t2"].end_year, good["t2"].runtime_minutes, good["t2"].genres) == (None, None, 1000, 12, ["a", "b"])
    assert good["t3"].original_title is None and good["t3"].genres is None
    assert (good["t6"].start_year, good["t6"].runtime_minutes, good["t6"].genres) == (-5, None, ["A", "B"])
    bad = tsv.rejected(rows, "title_basics").collect()
    assert sorted((r.table_name, json.loads(r.payload)["tconst"], r.error, json.loads(r.payload).get("extra")) for r in bad) == [("title_basics", "t5", "out of range: runtime_minutes", None)]
    counts = {r.reason: r.n for r in tsv.quality_counts(rows, "title_basics").collect()}
    assert counts == {
        "title_basics.is_adult: wrong form": 1, "title_basics.start_year: wrong form": 1, "title_basics.runtime_minutes: wrong form": 1, "title_basics.genres: wrong form": 1,
        "title_basics: extra fields": 1, "title_basics: without tconst": 1,
    }
    declared = DATASETS["title_basics"].schema
    assert [f.dataType for f in tsv.accepted(rows, DATASETS["title_basics"]).schema] == [f.dataType for f in declared][:-1]


def test_other_tables(spark, tmp_path):
    path = write_gz(tmp_path / "r.tsv.gz", ["tconst\taverageRating\tnumVotes", "a\t7.25\t10", "b\tnan\t2147483648", "c\t150\t1", "d\t9.9\tx", "e\t.5\t0"], "\r\n")
    rows = tsv.read_dataset(spark, path, "title_ratings")
    good = {r.tconst: r for r in tsv.accepted(rows, DATASETS["title_ratings"]).collect()}
    assert {k: float(v.average_rating) for k, v in good.items()} == {"a": 7.3, "d": 9.9, "e": 0.5} and good["d"].num_votes is None
    assert tsv.rejected(rows, "title_ratings").count() == 2
    path = write_gz(tmp_path / "p.tsv.gz", ["tconst\tordering\tnconst\tcategory\tjob\tcharacters", 't\t1\tn\tactor\t\\N\t["Self"]', "t\t2\tn\tactor\t\\N\t[]", "t\t3\tn\tactor\t\\N\tfalse", "t\t4\tn\tactor\t\\N\tnull", 't\t5\tn\tactor\t\\N\t["x"', "t\t\\N\tn\ta\tb\t[]"])
    got = {r.ordering: r.characters for r in tsv.accepted(tsv.read_dataset(spark, path, "title_principals"), DATASETS["title_principals"]).collect()}
    assert got == {1: '["Self"]', 2: "[]", 3: "false", 4: None, 5: None}
    assert tsv.accepted(tsv.read_dataset(spark, path, "title_principals", skip_lines=3), DATASETS["title_principals"]).count() == 2
    assert tsv.read_dataset(spark, write_gz(tmp_path / "e.tsv.gz", ["tconst\tdirectors\twriters"]), "title_crew").count() == 0


def test_registry():
    assert select_datasets() == [n for n in DATASETS if n != "title_akas"] and "title_akas" in select_datasets(include_optional=True)
    assert select_datasets(["name.basics", "title_crew"]) == ["title_crew", "name_basics"]
    with pytest.raises(ValueError):
        select_datasets(["nope"])


def test_metadata_and_reports(spark):
    df = spark.createDataFrame([(7.9, 10_000), (10.0, 999), (None, 1000), (3.0, None), (None, None), (0.4, 100_000)], "r double, v long")
    got = [json.loads(x[0]) if x[0] else None for x in df.select(buckets.rating_metadata(F.col("r"), F.col("v"))).collect()]
    assert got == [
        {"src": "title.ratings", "rating_bucket": "7-8", "vote_bucket": "10k-100k", "popular": True}, {"src": "title.ratings", "rating_bucket": "10", "vote_bucket": "<1k", "popular": False},
        {"src": "title.ratings", "vote_bucket": "1k-10k", "popular": False}, {"src": "title.ratings", "rating_bucket": "3-4"}, None, {"src": "title.ratings", "rating_bucket": "0-1", "vote_bucket": "100k+", "popular": True},
    ]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (5 * 1024**4,), (1024**5 * 2048,), (1023 * 1024,), (-1536,)], "n long")
    assert [r[0] for r in sizes.select(buckets.human_bytes(F.col("n"))).collect()] == ["0.0 B", "1,023.0 B", "1.0 KiB", "1.5 MiB", "5.0 TiB", "2,048.0 PiB", "1,023.0 KiB", "-1.5 KiB"]
    lines = spark.createDataFrame([(" a\nb ", 2.0, 1.0, "40001"), ("x" * 600, 0.0, 1.0, None)], "t string, b double, a double, s string")
    got = lines.select(buckets.one_line(F.col("t")), buckets.percent_change(F.col("b"), F.col("a")), buckets.is_transient(F.col("s"))).collect()
    assert tuple(got[0]) == ("a b", 50.0, True) and tuple(got[1]) == ("x" * 500, None, False)


def test_envelopes(spark):
    payloads = [
        '{"table":"t","data":{"a":1}}', '{"table":"t","rows":[{"a":1},{"a":2,"b":"é"}],"data":{"a":9}}', '"{\\"table\\":\\"t\\",\\"rows\\":[{\\"a\\":5}]}"',
        '{"nonsense":1}', '{"table":"t","rows":{"a":1}}', "[1,2]", "not json", '{"table":"t","rows":[]}', None,
    ]
    got = envelope.opened(spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")).orderBy("i").collect()
    assert [r.malformed for r in got] == [False, False, False, True, True, True, True, False, True]
    assert [[json.loads(x) for x in r.rows] if not r.malformed else None for r in got] == [[{"a": 1}], [{"a": 1}, {"a": 2, "b": "é"}], [{"a": 5}], None, None, None, None, [], None]
    rows = spark.createDataFrame([(i, None if i % 2 else f"é{i}") for i in range(2500)], "k int, v string")
    messages = envelope.batch_messages(rows, "t", ["k", "v"], ["k"], 1000)
    assert messages.agg(F.max("n_rows"), F.sum("n_rows")).first()[:] == (1000, 2500) or messages.agg(F.max("n_rows")).first()[0] <= 1000
    seen = [x for r in messages.collect() for x in json.loads(r.payload)["rows"]]
    assert sorted(x["k"] for x in seen) == list(range(2500)) and all(("v" in x) == (x["k"] % 2 == 0) for x in seen)
    one = envelope.single_messages(rows.filter("k = 4"), "t", ["k", "v"]).first().payload
    assert one == '{"table":"t","data":{"k":4,"v":"é4"}}'
    stats = envelope.payload_stats(spark.createDataFrame([("a",), ("bbb",), ("é",)], "payload string"), large=2).first()
    assert tuple(stats) == (3, 1, 3, 6, 2.0, 1)
    assert spark.range(1).select(envelope.contains(F.lit('{"popular":true,"n":3}'), {"popular": True, "n": 3}), envelope.contains(F.lit("x"), {"n": 3})).first()[:] == (True, False)


def test_insert_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 2, "c"), (2, 1, "d"), (None, 1, "n"), (None, 1, "n")], "k int, o int, v string")
    target = spark.createDataFrame([(2, 1, "old")], rows.schema)
    new = ingest.insert_new(rows, target, ["k", "o"], ["v"])
    assert sorted(map(str, new.collect())) == sorted(map(str, spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (None, 1, "n"), (None, 1, "n")], rows.schema).collect()))
    after = target.union(new)
    assert ingest.insert_new(rows.filter("k is not null"), after, ["k", "o"], ["v"]).count() == 0
    assert ingest.totals(rows, new, rows.limit(0), "t").first()[:] == ("t", 4, 2, 0)
    assert [r.id for r in ingest.with_ids(spark.range(100, 0, -1).select(F.col("id").alias("n")), ["n"], 7).orderBy("n").collect()] == list(range(8, 108))


def test_poison_row_is_set_apart(spark):
    rows = spark.createDataFrame([(1, 2000), (2, 999_999), (3, 2001)], "k int, year int")
    good, bad = ingest.split_valid(rows, ~F.col("year").between(-32768, 32767))
    letters = ingest.dead_letters(bad, "title_basics", ["k", "year"], "22003", "out of range").collect()
    assert good.count() == 2 and [json.loads(r.payload) for r in letters] == [{"k": 2, "year": 999_999}]


def test_wide_average_rounds_once(spark):
    from marlstone.plans.catalog import wide_average

    ratings = spark.range(200_001).select(F.when(F.col("id") < 50_001 + 149_995 // 150_000, F.lit("7.2")).otherwise(F.lit("7.1")).cast("decimal(3,1)").alias("r"))
    total, n, mean = ratings.agg(F.sum("r"), F.count("r"), F.round(wide_average(F.col("r")), 2)).first()
    exact = (200 * int(total * 10) + 10 * n) // (20 * n)
    assert int(mean * 100) == exact


def test_number_forms(spark):
    forms = ["12", " 12 ", "1_000", "_1", "1__0", "+5", "-7", "1.0", "", "abc", "1e3", "nan", "inf", "1.5", ".5", "5.", "1_0.5"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(forms)], "i int, v string").select("i", "v", coerce.to_int(F.col("v")).alias("n"), coerce.to_rating(F.col("v")).alias("f")).orderBy("i")

    def want(kind, x):
        try:
            y = kind(x)
            return y if y == y and abs(y) != float("inf") else None
        except ValueError:
            return None

    for r in df.collect():
        assert (None if r.n is None else int(r.n)) == want(int, r.v) and r.f == want(float, r.v), r


def test_broken_gzip_is_told(spark, tmp_path):
    path = write_gz(tmp_path / "a.tsv.gz", [f"line {k}" for k in range(5000)])
    assert tsv.is_whole(spark, path)
    data = (tmp_path / "a.tsv.gz").read_bytes()
    (tmp_path / "b.tsv.gz").write_bytes(data[: len(data) // 2])
    assert not tsv.is_whole(spark, str(tmp_path / "b.tsv.gz"))


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("tconst\taverageRating\tnumVotes\n" + "".join(f"t{k}\t5.0\t{k}\n" for k in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        lines = {r.line: r.value for r in tsv.numbered_lines(spark, str(path)).collect()}
        assert len(lines) == 3001 and all(lines[k] == f"t{k}\t5.0\t{k}" for k in range(1, 3001))
        votes = sorted(r.num_votes for r in tsv.read_dataset(spark, str(path), "title_ratings", 1000, 2500).collect())
        assert votes == list(range(1001, 2501))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
