"""Streams against batch: restart without loss or repeats, the queue's fold, windows."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import queue
from marlstone.plans import layout
from marlstone.plans.operator_queries import MOVES
from marlstone.streaming import ingest_stream, queue_stream

FIELDS = ["tconst", "averageRating", "numVotes"]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(["\t".join(FIELDS), *rows]) + "\n")


def test_files_are_loaded_once_over_restarts(spark, tmp_path):
    source, table, dead = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "dead")
    start = lambda: ingest_stream.ingest_files(spark, str(source), FIELDS, "title_ratings", table, dead, str(tmp_path / "cp"), 1).awaitTermination(120)
    put(source, "a.tsv", ["t1\t7.0\t10", "t2\t8.0\t20", "t2\t8.5\t20"])
    put(source, "b.tsv", ["t1\t1.0\t1", "t3\t500\t3", "t4\t\\N\t\\N"])
    start()
    assert sorted(r.tconst for r in spark.read.parquet(table).collect()) == ["t1", "t2", "t4"]
    start()
    assert spark.read.parquet(table).count() == 3
    put(source, "c.tsv", ["t5\t5.0\t5", "t4\t1.0\t1"])
    start()
    got = {r.tconst: r.average_rating for r in spark.read.parquet(table).collect()}
    assert set(got) == {"t1", "t2", "t4", "t5"} and float(got["t2"]) == 8.0
    letters = spark.read.parquet(dead).collect()
    assert [(r.table_name, r.error) for r in letters] == [("title_ratings", "out of range: average_rating")]


def test_fold_stream_ends_where_the_batch_fold_does(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("event_id").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    folded = queue_stream.fold_stream(stream, "user_id", "event_id", "event_type", MOVES)
    seen = {}

    def keep(batch, number):
        seen.update({r.user_id: (r.status, r.attempts) for r in batch.collect()})

    folded.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    want = {r.user_id: (r.status, r.attempts) for r in queue.fold(events, "user_id", "event_id", "event_type", MOVES).collect()}
    assert seen == want and len(want) > 5


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = queue_stream.windowed_counts(events, "1 day")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
    events.write.parquet(str(tmp_path / "e"))
    stream = queue_stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "1 day")
    rows = []
    stream.writeStream.outputMode("append").foreachBatch(lambda b, n: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    whole = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert rows and all(whole[(r.start, r.event_type)] == r.n for r in rows)


@pytest.mark.parametrize("sort", [None, "start_year"])
def test_layout_prunes_folders(spark, tmp_path, sort):
    titles = spark.range(200).select(F.col("id").cast("string").alias("tconst"), F.when(F.col("id") % 4 == 0, "movie").otherwise("short").alias("title_type"), (F.col("id") % 50).alias("start_year"))
    layout.by_kind(titles, str(tmp_path / "t"), sort)
    read = spark.read.parquet(str(tmp_path / "t")).filter("title_type = 'movie'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 50 and "PartitionFilters: [isnotnull(title_type" in plan
    layout.sorted_by(titles, str(tmp_path / "s"), "start_year")
    assert spark.read.parquet(str(tmp_path / "s")).filter("start_year >= 45").count() == 20


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS layouts LOCATION '{tmp_path / 'db'}'")
    left = spark.range(1000).select(F.col("id").alias("tconst"), (F.col("id") * 2).alias("a"))
    try:
        layout.bucketed(left, "layouts.l", "tconst", 4)
        layout.bucketed(left.withColumnRenamed("a", "b"), "layouts.r", "tconst", 4)
        layout.analyse(spark, "layouts.l")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("layouts.l").join(spark.table("layouts.r"), "tconst")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE layouts CASCADE")
