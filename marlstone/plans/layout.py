"""Data layouts that stand where a row store has indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_kind(titles: DataFrame, path: str, sort: str | None = None) -> None:
    """Titles in a folder per title_type, so that a filter on it reads one folder; sorted within files, so that row groups have tight ranges of sort."""
    rows = titles.repartition("title_type") if sort is None else titles.repartitionByRange("title_type", sort).sortWithinPartitions("title_type", sort)
    rows.write.mode("overwrite").partitionBy("title_type").parquet(path)


def sorted_by(rows: DataFrame, path: str, column: str) -> None:
    """Files that each hold a range of column, so that range filters and top-k read few row groups."""
    rows.repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by key: joins and aggregates on key of tables bucketed alike need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def analyse(spark, table: str) -> None:
    """Row counts and column statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
