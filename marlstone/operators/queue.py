"""A leased, retrying, at-least-once work queue as functions of its table.

The table is a DataFrame; every step takes it and the present time and returns the
next table and a result. Nothing here reads a clock. There are no row locks: one
coordinator applies the steps in turn, and what it hands to different workers is
disjoint because each claim is made on the table that the last one returned. An ack
or nack counts whoever holds the lease by now.

A step says what it changes, as rows alone; a stored queue keeps just these.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "processing", "done", "failed")
SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("attempts", T.IntegerType(), False), T.StructField("queue_name", T.StringType(), False),
    T.StructField("status", T.StringType(), False), T.StructField("payload", T.StringType(), False), T.StructField("last_error", T.StringType()),
    T.StructField("locked_until", T.TimestampType()), T.StructField("created_at", T.TimestampType(), False), T.StructField("updated_at", T.TimestampType(), False),
])
COLUMNS = SCHEMA.fieldNames()
#: What a message whose lease ran out says.
EXPIRED = "lease expired before the message was acknowledged"
ERROR_CHARS = 2000


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _time(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


#: What a step's rows are: new ones, changed ones in place of those of the same id, or ones that go.
NEW, CHANGED, GONE = "new", "changed", "gone"
Changes = tuple[str, DataFrame, Callable[[DataFrame], object]]


def _put(table: DataFrame, kind: str, rows: DataFrame) -> DataFrame:
    if kind == NEW:
        return table.select(*COLUMNS).union(rows.select(*COLUMNS))
    if kind == GONE:
        return table.join(rows.select("id"), "id", "left_anti").select(*COLUMNS)
    now = rows.select("id", F.struct(*[c for c in COLUMNS if c != "id"]).alias("_now"))
    met = table.join(now, "id", "left")
    return met.select(*["id" if c == "id" else F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS])


def step(changes: Callable[..., Changes]) -> Callable:
    """A function that returns (next table, result), from one that returns what kind of rows change, these rows, and the result as a function of them."""

    @functools.wraps(changes)
    def whole(table: DataFrame, *args, **options):
        kind, rows, result = changes(table, *args, **options)
        return _put(table, kind, rows), result(rows)

    whole.changes = changes
    return whole


def _changed(rows: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return rows.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in COLUMNS])


@step
def enqueue_many(table: DataFrame, queue: str, payloads: list[str | None], now: datetime, next_id: int) -> Changes:
    """Appends pending messages; null payloads are skipped; result: their ids. Ids ascend from next_id, which must be above any id ever given."""
    if not queue or not queue.strip():
        raise ValueError("a queue needs a name")
    rows = [(next_id + k, 0, queue, "pending", p, None, None, now, now) for k, p in enumerate(p for p in payloads if p is not None)]
    return NEW, table.sparkSession.createDataFrame(rows, SCHEMA), lambda _: [r[0] for r in rows]


def enqueue(table: DataFrame, queue: str, payload: str, now: datetime, next_id: int) -> tuple[DataFrame, int]:
    if payload is None:
        raise ValueError("a message needs a payload")
    table, ids = enqueue_many(table, queue, [payload], now, next_id)
    return table, ids[0]


@step
def enqueue_frame(table: DataFrame, queue: str, messages: DataFrame, now: datetime, next_id: int) -> Changes:
    """enqueue_many of a DataFrame (payload, position): ids ascend with position; result: the rows."""
    from marlstone.operators.ingest import with_ids

    numbered = with_ids(messages.filter("payload is not null").select("position", "payload"), ["position"], next_id - 1)
    at = _time(now)
    new = numbered.select("id", F.lit(0).alias("attempts"), F.lit(queue).alias("queue_name"), F.lit("pending").alias("status"), "payload", F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("locked_until"), at.alias("created_at"), at.alias("updated_at"))
    return NEW, new, lambda rows: rows


@step
def dequeue(table: DataFrame, queue: str, now: datetime, batch: int = 10, visibility: timedelta | None = timedelta(seconds=30)) -> Changes:
    """Leases the lowest pending ids; result (msg_id, payload) by id. A negative visibility makes a lease that has run out."""
    if batch is None or batch < 1:
        raise ValueError("a batch is 1 at least")
    if visibility is None:
        raise ValueError("a lease needs a length")
    # a top-k: each task offers its own first rows
    taken = table.filter((F.col("queue_name") == queue) & (F.col("status") == "pending")).orderBy("id").limit(batch)
    rows = _changed(taken, {"status": F.lit("processing"), "locked_until": _time(now + visibility), "updated_at": _time(now)})
    return CHANGED, rows, lambda rows: rows.select(F.col("id").alias("msg_id"), "payload").orderBy("msg_id")


def claim(table: DataFrame, queue: str, now: datetime, workers: int, batch: int, visibility: timedelta = timedelta(seconds=30)) -> tuple[DataFrame, DataFrame]:
    """One claim for several workers at once: (worker, msg_id, payload), disjoint, in ranges of ids."""
    table, taken = dequeue(table, queue, now, batch * workers, visibility)
    rank = F.row_number().over(Window.orderBy("msg_id")) - 1
    return table, taken.select(F.floor(rank / batch).cast("int").alias("worker"), "msg_id", "payload")


def _in_processing(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.filter("status = 'processing'").join(ids.select("id"), "id", "left_semi")


@step
def ack(table: DataFrame, ids: DataFrame, now: datetime) -> Changes:
    """Ends messages in processing; result (id, acked boolean) for the ids given."""
    none = F.lit(None)
    rows = _changed(_in_processing(table, ids), {"status": F.lit("done"), "locked_until": none.cast("timestamp"), "last_error": none.cast("string"), "updated_at": _time(now)})
    return CHANGED, rows, lambda rows: ids.select("id").join(rows.select("id", F.lit(True).alias("_hit")), "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("acked"))


def _tried(table: DataFrame, now: datetime, error: Column, max_attempts: int | None) -> DataFrame:
    """Back to pending, or failed once attempts reach the most; with no most, never."""
    status = F.when(F.col("attempts") + 1 >= F.lit(max_attempts).cast("int"), F.lit("failed")).otherwise(F.lit("pending"))
    return _changed(table, {"attempts": F.col("attempts") + 1, "status": status, "last_error": error, "locked_until": F.lit(None).cast("timestamp"), "updated_at": _time(now)})


@step
def nack(table: DataFrame, ids: DataFrame, now: datetime, error: str | None = "", max_attempts: int | None = 5) -> Changes:
    """Returns messages in processing for another try; result (id, status): the new status, null if nothing changed."""
    text = F.left(F.coalesce(F.lit(error).cast("string"), F.lit("")), F.lit(ERROR_CHARS))
    rows = _tried(_in_processing(table, ids), now, text, max_attempts)
    return CHANGED, rows, lambda rows: ids.select("id").join(rows.select("id", "status"), "id", "left")


@step
def reap_expired(table: DataFrame, queue: str, now: datetime, max_attempts: int | None = 5) -> Changes:
    """Takes back messages whose lease ended before now; result (id) of them, however many."""
    over = table.filter((F.col("queue_name") == queue) & (F.col("status") == "processing") & (F.col("locked_until") < _time(now)))
    return CHANGED, _tried(over, now, F.lit(EXPIRED), max_attempts), lambda rows: rows.select("id")


def queue_stats(table: DataFrame, queue: str) -> DataFrame:
    """One row: pending, processing, done, failed, total. Zeros for an empty queue."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return table.filter(F.col("queue_name") == queue).agg(*counts, F.count(F.lit(1)).alias("total"))


def paused(pending: int, before: bool, high: int = 2000, low: int = 500) -> bool:
    """Whether a producer waits: from high pending messages on, until low or fewer are left."""
    return pending > low if before else pending >= high


@step
def purge_done(table: DataFrame, queue: str, now: datetime, older: timedelta = timedelta(0), limit: int = 10_000) -> Changes:
    """Removes up to limit done messages, lowest ids first, last changed before now - older; result (id) of them."""
    old = (F.col("queue_name") == queue) & (F.col("status") == "done") & (F.col("updated_at") < _time(now - older))
    return GONE, table.filter(old).orderBy("id").limit(limit), lambda rows: rows.select("id")


class StoredQueue:
    """A queue kept as numbered commits under a folder, with one writer.

    A commit holds the rows that a step made, changed or removed, and what else the
    caller stores with them; its name appears only once it is whole, so a reader
    sees whole commits. Every so often a commit holds all rows (a snapshot), and
    what came before it is no longer read. So a step writes what it changes, not
    the queue, and a claim reads the snapshot with its filters pushed down.
    """

    WHOLE = "whole"

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 50):
        self.spark, self.folder, self.compact_every = spark, folder, compact_every
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version < 0:
            self._commit({self.WHOLE: empty(spark)})

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(self.folder) if n[:1] == "v" and n[1:].isdigit())

    @property
    def version(self) -> int:
        return max(self._versions(), default=-1)

    def _parts(self) -> dict[str, list[tuple[int, str]]]:
        """(version, folder) of each part that counts, by its kind: those of the newest snapshot and of all commits after it."""
        out: dict[str, list[tuple[int, str]]] = {}
        for version in reversed(self._versions()):
            names = self._names(f"{self.folder}/v{version}")
            for name in names:
                out.setdefault(name, []).append((version, f"{self.folder}/v{version}/{name}"))
            if self.WHOLE in names:
                break
        return out

    def _read(self, parts: list[tuple[int, str]], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[folder for _, folder in parts])

    def table(self) -> DataFrame:
        parts = self._parts()
        rows = self._read(parts[self.WHOLE] + parts.get(NEW, []), SCHEMA)
        if not (CHANGED in parts or GONE in parts):
            return rows
        later = None
        for kind in (CHANGED, GONE):
            if kind in parts:
                own = self._read(parts[kind], T.StructType([*SCHEMA, T.StructField("_version", T.LongType())])).withColumn("_gone", F.lit(kind == GONE))
                later = own if later is None else later.unionByName(own)
        # as many rows as steps changed since the snapshot
        last = later.groupBy("id").agg(F.max(F.struct("_version", "_gone", *[c for c in COLUMNS if c != "id"])).alias("r"))
        kept = rows.join(last.select("id"), "id", "left_anti").select(*COLUMNS)
        return kept.union(last.filter("not r._gone").select(*[F.col("id") if c == "id" else F.col(f"r.{c}").alias(c) for c in COLUMNS]))

    def _commit(self, parts: dict[str, DataFrame]) -> int:
        version = self.version + 1
        staged = f"{self.folder}/.next-{version}"
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{staged}/{name}")
        return self._publish(staged, version)

    def _publish(self, staged: str, version: int) -> int:
        if not self._fs.rename(self._path(staged), self._path(f"{self.folder}/v{version}")):
            raise RuntimeError(f"commit {version} is there already: the queue has another writer")
        return version

    def apply(self, change, *args, store: dict[str, DataFrame] | None = None, **options):
        """Runs a step of this module, or a function from a table to (table, result), and commits it. store: small tables to keep in the same commit, by name; stored() reads them.

        Rows are computed once, written, and the result is read from what was
        written: as a list, or as a DataFrame where a step sets no bound to it. A
        step that changes nothing, and stores nothing, makes no commit.
        """
        if not hasattr(change, "changes"):
            table, result = change(self.table(), *args, **options)
            self._commit({self.WHOLE: table, **self._kept(), **(store or {})})
            return result
        kind, rows, result = change.changes(self.table(), *args, **options)
        version = self.version + 1
        staged = f"{self.folder}/.next-{version}"
        (rows if kind == NEW else rows.withColumn("_version", F.lit(version).cast("long"))).write.mode("overwrite").parquet(f"{staged}/{kind}")
        written = self.spark.read.schema(SCHEMA).parquet(f"{staged}/{kind}")
        if not store and written.isEmpty():
            self._fs.delete(self._path(staged), True)
            out = result(self.spark.createDataFrame([], SCHEMA))
            return out.collect() if isinstance(out, DataFrame) and change is not reap_expired else out
        for name, extra in (store or {}).items():
            extra.write.mode("overwrite").parquet(f"{staged}/{name}")
        self._publish(staged, version)
        out = result(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{version}/{kind}"))
        if isinstance(out, DataFrame) and change not in (reap_expired, enqueue_frame):
            out = out.collect()  # a claim's or a change's ids, as many as were asked for
        if version - max(v for v, _ in self._parts()[self.WHOLE]) >= self.compact_every:
            self.compact()
        return out

    def add(self, rows: DataFrame, store: dict[str, DataFrame]) -> int:
        """Commits new messages, with ids, and what else belongs to them."""
        return self._commit({NEW: rows, **store})

    def stored(self, name: str, key: str, schema: T.StructType) -> DataFrame:
        """The last stored row of each key of a table that apply() stored."""
        parts = self._parts().get(name, [])
        rows = self.spark.createDataFrame([], schema)
        out = None
        for version, folder in parts:
            own = self.spark.read.schema(schema).parquet(folder).withColumn("_version", F.lit(version))
            out = own if out is None else out.unionByName(own)
        if out is None:
            return rows
        last = out.groupBy(key).agg(F.max(F.struct("_version", *[c for c in schema.fieldNames() if c != key])).alias("r"))
        return last.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in schema.fieldNames()])

    def _kept(self) -> dict[str, DataFrame]:
        """What is stored beside the queue, to be carried into a snapshot."""
        out = {}
        for name, parts in self._parts().items():
            if name not in (self.WHOLE, NEW, CHANGED, GONE):
                schema = self.spark.read.parquet(parts[0][1]).schema
                out[name] = self.stored(name, schema.fieldNames()[0], schema)
        return out

    def compact(self) -> None:
        """Commits a snapshot: all rows, and the last of what is stored beside them."""
        self._commit({self.WHOLE: self.table(), **self._kept()})

    def forget(self) -> None:
        """Deletes the commits that the newest snapshot replaces."""
        since = max(v for v, _ in self._parts()[self.WHOLE])
        for version in self._versions():
            if version < since:
                self._fs.delete(self._path(f"{self.folder}/v{version}"), True)


def fold(events: DataFrame, key: str, order: str, kind: str, moves: dict[str, str], max_attempts: int = 5) -> DataFrame:
    """key, status, attempts after all events of each key, in order.

    moves names what each kind does: enqueue, dequeue, ack, nack or reap. A move
    that the status does not allow changes nothing. A key's events are folded by
    one expression over a sorted array, inside one task.
    """
    logs = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.col(kind).alias("kind")))).alias("log"))
    start = F.struct(F.lit("none").alias("status"), F.lit(0).cast("long").alias("attempts"))

    def step(state: Column, event: Column) -> Column:
        move = F.coalesce(*[F.when(event["kind"] == k, F.lit(m)) for k, m in moves.items()], F.lit("none"))
        again = state["attempts"] + 1
        back = (state["status"] == "processing") & move.isin("nack", "reap")
        opens = (move == "enqueue") & state["status"].isin("none", "done", "failed")
        status = (
            F.when(opens, "pending").when((move == "dequeue") & (state["status"] == "pending"), "processing").when((move == "ack") & (state["status"] == "processing"), "done")
            .when(back & (again >= max_attempts), "failed").when(back, "pending").otherwise(state["status"])
        )
        attempts = F.when(opens, F.lit(0).cast("long")).when(back, again).otherwise(state["attempts"])
        return F.struct(status.alias("status"), attempts.alias("attempts"))

    return logs.select(key, F.aggregate("log", start, step).alias("s")).select(key, "s.status", "s.attempts")
