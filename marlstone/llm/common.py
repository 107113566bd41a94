"""Shared pieces: checkpoints, unsigned hash order, word counts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (fixed values): space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local master (tests on one machine) may leave it unset; a temporary one is taken then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage. The files go when the session cleans checkpoints, or with the folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few longs that one task takes without effort.
TASK_ROWS = 200_000


def compact(df: DataFrame) -> DataFrame:
    """cut() of a narrow table, in as many partitions as its counted rows need. Small tables then cost few tasks and files in what follows."""
    df = cut(df)
    return df.coalesce(df.count() // TASK_ROWS + 1)


class Scratch:
    """Intermediate tables of one operator call: kept on executors' disks while they are read again, and freed at the end.

    A lost executor's part is computed anew from its lineage, which is why what
    outlives the call is cut instead.
    """

    def __init__(self):
        self._held: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.DISK_ONLY)
        self._held.append(df)
        return df

    def free(self, df: DataFrame) -> None:
        self._held.remove(df)
        df.unpersist()

    def __exit__(self, *_) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The columns in names, and all of df's as one struct _row, so that no column of df can clash with an operator's own; select("_row.*") unpacks it."""
    return df.select(*names, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


#: Rows up to which a table of a few narrow columns is sent to all tasks.
SMALL_ROWS = 20_000


def if_small(table: DataFrame) -> DataFrame:
    """A materialised table marked for broadcast if a count shows SMALL_ROWS rows at most; otherwise as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def bucket_bits(rows: int, per_bucket: int = 4096, least: int = 6, most: int = 20) -> int:
    """Bits of hash that split rows into buckets of about per_bucket each."""
    return max(least, min(most, (max(rows, 1) // per_bucket).bit_length()))


def top_bits(key: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit hash, numbered from 0 in the order of the hash."""
    return F.shiftright(key, 64 - bits) + F.lit(1 << (bits - 1))


#: Bits of with_maybe's bitmap: 4 MB, however many ids there are.
FILTER_BITS = 25


def with_maybe(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """df with _maybe: false only where the value of column name (a long) is not in column name of ids.

    The ids are folded into a bitmap of fixed size, 4 kB for each of up to 1025
    rows, which is what is broadcast. It spares a shuffle of the rows it rules
    out; those left need a join with ids to be sure.
    """
    slot = lambda: F.pmod(F.xxhash64(F.lit(5), name), F.lit(1 << FILTER_BITS))
    maps = ids.filter(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(slot()).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("_bits"))
    bit = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    joined = df.withColumn("_slot", F.bitmap_bucket_number(slot())).join(F.broadcast(maps), F.col("_slot") == F.col("_part"), "left")
    return joined.withColumn("_maybe", F.coalesce(held & F.col(name).isNotNull(), F.lit(False))).drop("_slot", "_part", "_bits")


def tiled(rows: DataFrame, where: list[str], side_rows: int, weight: str | None = None, side_weight: int = 0) -> DataFrame:
    """rows (with node long, main boolean) repeated into tiles, in which all pairs of rows of one group (equal where) meet exactly once, but for pairs of two main rows.

    A group of more than side_rows rows, or side_weight of the column weight, is
    dealt by a hash of node into chunks of about that: main rows and others apart.
    Tile (i, j), 0 <= i <= j, gets others' chunk i as side 0 and chunk j as side 1;
    tile (i, i) gets its chunk once, as side 0. Tile (-1 - i, j) gets the main
    rows' chunk i as side 0 and the others' chunk j as side 1. So where few rows
    are not main, rows grow with the group. A smaller group is tile (0, 0).
    """
    counts = [F.count_if("main").alias("_n1"), F.count_if(~F.col("main")).alias("_n0")]
    if weight:
        counts += [F.coalesce(F.sum(F.when(F.col("main") == bool(k), F.col(weight))), F.lit(0)).alias(f"_w{k}") for k in (0, 1)]

    def chunks(k: int) -> Column:
        n = F.ceil(F.col(f"_n{k}") / side_rows)
        return (F.greatest(n, F.ceil(F.col(f"_w{k}") / side_weight)) if weight else n).cast("int").alias(f"_c{k}")

    above = F.col("_n0") + F.col("_n1") > side_rows
    if weight:
        above |= F.col("_w0") + F.col("_w1") > side_weight
    # few groups are above a chunk, so few rows need to know of them
    large = rows.groupBy(*where).agg(*counts).filter(above).select(*where, chunks(0), chunks(1))
    spread = rows.join(if_small(cut(large)), where, "left")
    own = F.when(F.col("main"), F.col("_c1")).otherwise(F.col("_c0"))
    spread = spread.withColumn("_k", F.pmod(F.xxhash64(F.lit(4), "node"), own).cast("int"))
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    tile = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    k, zero = F.col("_k"), F.lit(0)
    met = F.concat(F.transform(numbers("_c0"), lambda o: tile(F.least(o, k), F.greatest(o, k), o < k)), F.transform(numbers("_c1"), lambda o: tile(-1 - o, k, F.lit(1))))
    tiles = F.when(own.isNull(), F.array(tile(zero, zero, zero))).when(F.col("main"), F.transform(numbers("_c0"), lambda o: tile(-1 - k, o, zero))).otherwise(met)
    spread = spread.withColumn("_t", F.explode(tiles))
    return spread.select(*rows.columns, F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), F.col("_t.side").alias("side"))


def roots(count: int, i, j):
    """Least reachable number of each of count nodes, given linked pairs (numpy arrays)."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: Rows of an Arrow batch sent to Python, where the session keeps its default of 10,000.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Whole texts come in batches of fewer rows, so that a worker holds less at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def by_group(rows: DataFrame, keys: list[str], function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """function of each group of equal keys (longs or ints), as one stream over sorted partitions.

    For many small groups this costs far less than a call for each through pandas.
    A worker holds a batch and one group.
    """
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if open_:
                whole = pa.Table.from_batches(open_).combine_chunks().to_batches()[0]
                open_.clear()
                if (out := function(whole)) is not None:
                    yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], 1)
            starts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
            bounds = [0, *starts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if last is not None and (values[a] != last).any():
                    yield from done()
                open_.append(batch.slice(a, b - a))
                last = values[a]
        yield from done()

    ordered = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)
