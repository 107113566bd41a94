"""Idempotent ingestion: first arrival wins, last write wins, and bad rows stand apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given, with all columns. Pre-aggregated, so a key with very many rows costs a row per task."""
    rest = [c for c in rows.columns if c not in key]
    lead = [c for c in order if c not in key]
    body = F.struct(*[F.col(c) for c in lead + [c for c in rest if c not in lead]])
    return rows.groupBy(*key).agg(F.min(body).alias("_first")).select(*[F.col(c) if c in key else F.col(f"_first.{c}") for c in rows.columns])


def insert_new(rows: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key that target does not hold. A key with a null never conflicts.

    The target is asked only for the new keys, so where these are few it is not shuffled.
    """
    whole = F.lit(True)
    for k in key:
        whole &= F.col(k).isNotNull()
    fresh = first_by_key(rows.filter(whole), key, order)
    held = target.select(*key).join(fresh.select(*key), key, "left_semi")
    fresh = fresh.join(held, key, "left_anti")
    return fresh.select(*rows.columns).unionByName(rows.filter(~whole))


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target with rows put in by key; rows win, and must be unique by key."""
    return target.join(rows.select(*key), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def split_valid(rows: DataFrame, bad) -> tuple[DataFrame, DataFrame]:
    """(good, bad) by a condition that may be null (then good)."""
    flag = F.coalesce(bad, F.lit(False))
    return rows.filter(~flag), rows.filter(flag)


def dead_letters(bad: DataFrame, table: str, columns: list[str], sqlstate: str, error: str) -> DataFrame:
    """table_name, payload, sqlstate, error."""
    return bad.select(F.lit(table).alias("table_name"), F.to_json(F.struct(*columns)).alias("payload"), F.lit(sqlstate).alias("sqlstate"), F.lit(error).alias("error"))


def totals(offered: DataFrame, inserted: DataFrame, bad: DataFrame, table: str) -> DataFrame:
    """table_name, inserted, skipped, bad."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    joined = n(offered, "offered").join(n(inserted, "inserted")).join(n(bad, "bad"))
    return joined.select(F.lit(table).alias("table_name"), "inserted", (F.col("offered") - F.col("inserted") - F.col("bad")).alias("skipped"), "bad")


def with_ids(rows: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """rows with id: base + 1 and on, gapless, in the order given. Ranges are numbered in parallel from the counts of those before."""
    spread = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_k", within).join(F.broadcast(before), "_part").withColumn("id", F.lit(base) + F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")
