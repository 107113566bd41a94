"""Producer and consumer around the stored queue: files to messages, messages to tables.

A crash between the insert and the ack leaves a lease that runs out; the message
comes again, and the insert skips what the table already holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.coerce import LARGEST_INT
from marlstone.operators import envelope, ingest, queue
from marlstone.sources.catalog import DATASETS, Dataset
from marlstone.sources.tsv import accepted, read_dataset

#: SQLSTATEs of what a row can do wrong (fixed values of the SQL standard and its common extensions).
OUT_OF_RANGE, NULL_VALUE, BAD_VALUE = "22003", "23502", "22P02"


@dataclass(frozen=True)
class Progress:
    """How far a file was read: lines_read counts physical lines after the header, kept or not."""

    table_name: str
    source_file: str
    source_bytes: int
    lines_read: int = 0
    messages: int = 0
    completed: bool = False


PROGRESS = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("source_bytes", T.LongType()),
    T.StructField("lines_read", T.LongType()), T.StructField("messages", T.LongType()), T.StructField("completed", T.BooleanType()),
])


def file_bytes(spark: SparkSession, path: str) -> int:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def last_progress(store: queue.StoredQueue, name: str) -> Progress | None:
    """What produce() stored with the last messages of a table."""
    row = store.stored("progress", "table_name", PROGRESS).filter(F.col("table_name") == name).first()
    return Progress(**row.asDict()) if row else None


def resume_point(spark: SparkSession, name: str, path: str, last: Progress | None) -> Progress:
    """Where to go on. A file whose size is not what it was is an error: its lines cannot be told from those read."""
    size = file_bytes(spark, path)
    if last is None:
        return Progress(name, path, size)
    if last.source_bytes != size:
        raise ValueError(f"{path} has {size} bytes, not {last.source_bytes} as before; start the table anew")
    return last


def produce(
    spark: SparkSession, store: queue.StoredQueue, queue_name: str, name: str, path: str, now: datetime, last: Progress | None = None, size: int = 1000, *,
    step_lines: int | None = None, high: int = 2000, low: int = 500, wait: Callable[[], None] | None = None,
) -> Progress:
    """Enqueues what of a file was not yet read, as messages of at most size rows, and returns the progress.

    Progress is stored in the commit that holds the messages, so a restart neither
    repeats nor skips any; last is what is stored, unless it is given. step_lines
    bounds the lines of a commit; without it a file is one. From high pending
    messages on it stops before the next commit: without wait it returns, to be
    called again; else it calls wait until low or fewer are left.
    """
    at = resume_point(spark, name, path, last or last_progress(store, name))
    dataset = DATASETS[name]
    total = None
    held = False
    while not at.completed:
        while held := queue.paused(queue.queue_stats(store.table(), queue_name).first().pending, held, high, low):
            if wait is None:
                return at
            wait()
        total = spark.read.text(path).count() - 1 if total is None else total
        upto = total if step_lines is None else min(total, at.lines_read + step_lines)
        rows = accepted(read_dataset(spark, path, name, at.lines_read, upto), dataset)
        messages = envelope.batch_messages(rows, name, rows.columns, list(dataset.key), size).select("position", "payload")
        next_id = (store.table().agg(F.max("id")).first()[0] or 0) + 1
        numbered = queue.enqueue_frame.changes(store.table(), queue_name, messages, now, next_id)[1].persist()
        at = Progress(name, path, at.source_bytes, upto, at.messages + numbered.count(), upto >= total)
        progress = spark.createDataFrame([(at.table_name, at.source_file, at.source_bytes, at.lines_read, at.messages, at.completed)], PROGRESS)
        store.add(numbered, {"progress": progress})
        numbered.unpersist()
    return at


def _typed(v: Column, kind: str, type_: T.DataType) -> tuple[Column, Column]:
    """(value, sqlstate or null) of a JSON field read as text."""
    none = F.lit(None).cast("string")
    if kind in ("int", "smallint"):
        n, most = v.try_cast("decimal(38,0)"), LARGEST_INT if kind == "int" else 32767
        fits = n.between(-most - 1, most)
        return F.when(fits, n).cast(type_), F.when(v.isNotNull() & n.isNull(), BAD_VALUE).when(n.isNotNull() & ~fits, OUT_OF_RANGE)
    if kind == "rating":
        n = v.try_cast("double")
        fits = F.abs(n) < 99.95
        return F.when(fits, n).cast(type_), F.when(v.isNotNull() & n.isNull(), BAD_VALUE).when(n.isNotNull() & ~fits, OUT_OF_RANGE)
    if kind == "bool01":
        b = v.try_cast("boolean")
        return b, F.when(v.isNotNull() & b.isNull(), BAD_VALUE)
    return v, none


def typed_rows(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """From row (JSON text): the dataset's columns and metadata, then sqlstate and error of the first fault, null if there is none."""
    fields = [T.StructField(c, T.ArrayType(T.StringType()) if kind == "list" else T.StringType()) for _, c, kind in dataset.fields]
    parsed = F.from_json("row", T.StructType([*fields, T.StructField("metadata", T.StringType())]))
    out, faults = {}, []
    for _, c, kind in dataset.fields:
        value, fault = _typed(F.col(f"_r.{c}"), kind, dataset.schema[c].dataType)
        out[c] = value
        if c in dataset.required:
            fault = F.coalesce(fault, F.when(F.col(f"_r.{c}").isNull(), NULL_VALUE))
        faults.append(F.when(fault.isNotNull(), F.struct(fault.alias("sqlstate"), F.lit(c).alias("error"))))
    out["metadata"] = F.col("_r.metadata")
    first = F.coalesce(*faults)
    return rows.withColumn("_r", parsed).withColumns(out).withColumns({"sqlstate": first["sqlstate"], "error": first["error"]}).drop("_r")


def consume_once(spark: SparkSession, store: queue.StoredQueue, queue_name: str, tables: dict[str, str], dead: str, now: datetime, *, batch: int = 10, visibility: timedelta = timedelta(seconds=30), max_attempts: int = 5) -> list[dict]:
    """Claims up to batch messages, loads them, and acks or nacks each. Returns table_name, inserted, skipped, bad per table; nothing if the queue had nothing.

    tables maps a table's name to its Parquet folder. Malformed messages and those
    for unknown tables are nacked. Bad rows go to dead (Parquet) and the good rows
    of their message are kept; a message without a good row is nacked. A table is
    asked only for the keys between the least and the greatest new one.
    """
    taken = {r.msg_id: r.payload for r in store.apply(queue.dequeue, queue_name, now, batch, visibility)}
    if not taken:
        return []
    messages = envelope.opened(spark.createDataFrame(list(taken.items()), "id long, payload string"))
    known = F.col("table").isin(*tables)
    messages = messages.withColumn("faulty", F.col("malformed") | ~F.coalesce(known, F.lit(False))).persist()
    each = messages.filter("not faulty").select("id", "table", F.posexplode("rows").alias("pos", "row"))
    report, failed = [], {r.id for r in messages.filter("faulty").select("id").collect()}
    for name, folder in tables.items():
        dataset = DATASETS[name]
        rows = typed_rows(each.filter(F.col("table") == name), dataset).persist()
        good, bad = ingest.split_valid(rows, F.col("sqlstate").isNotNull())
        lead = dataset.key[0]
        fine = F.when(F.col("sqlstate").isNull(), F.col(lead))
        per = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("sqlstate").alias("bad"), F.min(fine).alias("least"), F.max(fine).alias("most")).collect()
        if per:
            failed |= {r.id for r in per if r.n == r.bad}
            columns = dataset.schema.fieldNames()
            ends = [r for r in per if r.least is not None]
            held = _held(spark, folder, dataset.schema)
            held = held.filter(F.col(lead).between(min(r.least for r in ends), max(r.most for r in ends))) if ends else held.limit(0)
            seen = Observation()
            new = ingest.insert_new(good.select("id", "pos", *columns), held, list(dataset.key), ["id", "pos"]).select(*columns)
            new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(folder)
            inserted, lost = seen.get["n"], sum(r.bad for r in per)
            if lost:
                letters = bad.select(F.lit(name).alias("table_name"), F.col("row").alias("payload"), "sqlstate", "error", F.lit(now).cast("timestamp").alias("failed_at"))
                letters.write.mode("append").parquet(dead)
            report.append({"table_name": name, "inserted": inserted, "skipped": sum(r.n for r in per) - inserted - lost, "bad": lost})
        rows.unpersist()
    messages.unpersist()
    ids = lambda values: spark.createDataFrame([(v,) for v in values], "id long")
    if done := [i for i in taken if i not in failed]:
        store.apply(queue.ack, ids(done), now)
    if failed:
        store.apply(queue.nack, ids(sorted(failed)), now, "no row could be loaded", max_attempts)
    return report


def _held(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def drain(spark: SparkSession, store: queue.StoredQueue, queue_name: str, tables: dict[str, str], dead: str, now: datetime, **options) -> list[dict]:
    """consume_once until nothing is pending. Leases that have run out, as of a worker that died, are taken back first."""
    out = []
    store.apply(queue.reap_expired, queue_name, now, options.get("max_attempts", 5))
    while got := consume_once(spark, store, queue_name, tables, dead, now, **options) or queue.queue_stats(store.table(), queue_name).first().pending:
        out += got if isinstance(got, list) else []
    return out


def ingest_stats(spark: SparkSession, tables: dict[str, str], now: datetime) -> DataFrame:
    """table_name, row_count, total_bytes, measured_at; put it into earlier ones with ingest.upsert by table_name."""
    rows = [(name, spark.read.parquet(folder).count(), file_bytes(spark, folder), now) for name, folder in tables.items()]
    return spark.createDataFrame(rows, "table_name string, row_count long, total_bytes long, measured_at timestamp")
