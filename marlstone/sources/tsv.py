"""Delimited text with a header: read raw, coerce, and tell good rows from bad ones.

The text is split on tabs by an expression, not by a CSV reader: there is no
quoting, short rows are padded with nulls, and rows with extra fields are rows like
others: their first fields go to the table, what follows stays in _extra, and they
are counted. A gzip file is one task; the parsed rows can be dealt out from there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.coerce import COERCERS, LARGEST_INT, clean
from marlstone.sources.catalog import DATASETS, Dataset

EXTRA = "extra fields"
BOM = "﻿"


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a gzip file can be read to its end with its checksum, in one task."""
    try:
        spark.read.text(path).count()
    except Exception as e:
        if not re.search("ZipException|EOFException|gzip|ZLIB|FAILED_READ_FILE|incorrect", str(e)):
            raise
        return False
    return True


def header(spark: SparkSession, path: str) -> list[str]:
    """Field names of the first line, without a byte-order mark."""
    first = spark.read.text(path).first()
    return first.value.removeprefix(BOM).split("\t") if first else []


def split_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """From value: one nullable string column per field and _extra array<string>: what follows the last field, null if nothing does. Blank lines and the header go; so does a data row equal to the header."""
    line = F.regexp_replace("value", f"^{BOM}", "")
    rows = lines.select(line.alias("value")).filter((F.col("value") != "") & (F.col("value") != "\t".join(fields)))
    parts = F.split("value", "\t", -1)
    return rows.select(*[F.get(parts, F.lit(k)).alias(f) for k, f in enumerate(fields)], F.when(F.size(parts) > len(fields), F.slice(parts, len(fields) + 1, F.size(parts))).alias("_extra"))


def _fits(column: Column, kind: str) -> Column:
    """Whether a coerced value fits the declared type; a value that does not is kept from the table, not made null."""
    if kind == "int":
        return column.isNull() | column.between(-LARGEST_INT - 1, LARGEST_INT)
    if kind == "rating":
        return column.isNull() | (F.abs(column) < 99.95)
    return F.lit(True)


def coerce_rows(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """Typed columns of dataset, then _uncoercible array<string> (columns that held a value that would not fit), _dropped (the first missing required column, else null), _misfit (the first column whose value is out of the declared range, else null) and _extra."""
    have = set(raw.columns)
    source = lambda f: clean(F.col(f)) if f in have else F.lit(None).cast("string")
    value = {c: COERCERS[kind](source(f)) for f, c, kind in dataset.fields}
    lost = F.filter(F.array(*[F.when(source(f).isNotNull() & value[c].isNull(), F.lit(c)) for f, c, _ in dataset.fields]), lambda x: x.isNotNull())
    misfit = F.coalesce(*[F.when(~_fits(value[c], kind), F.lit(c)) for _, c, kind in dataset.fields])
    kinds = {c: kind for _, c, kind in dataset.fields}
    missing = F.coalesce(*[F.when(value[c].isNull(), F.lit(c)) for c in dataset.required])
    typed = [F.when(_fits(value[c], kinds[c]), value[c]).cast(dataset.schema[c].dataType).alias(c) for _, c, _ in dataset.fields]
    extra = F.col("_extra") if "_extra" in have else F.lit(None).cast("array<string>")
    return raw.select(*typed, lost.alias("_uncoercible"), missing.alias("_dropped"), misfit.alias("_misfit"), extra.alias("_extra"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a single text file, the header being line 0. A file read in several blocks is numbered from the counts of the blocks before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # a row for each block of the file
    before = blocks.select("_block", "_first", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    return lines.join(before, "_block").select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def read_dataset(spark: SparkSession, path: str, name: str, skip_lines: int = 0, upto: int | None = None) -> DataFrame:
    """coerce_rows of one dataset's files. skip_lines leaves out so many physical lines after the header of a single file, for a restart; upto is the last line to read."""
    dataset = DATASETS[name]
    fields = header(spark, path)
    if skip_lines or upto is not None:
        wanted = F.col("line") > skip_lines
        lines = numbered_lines(spark, path).filter(wanted if upto is None else wanted & (F.col("line") <= upto)).select("value")
    else:
        lines = spark.read.text(path)
    return coerce_rows(split_lines(lines, fields), dataset)


def accepted(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """Rows for the table, with the declared columns; rows with extra fields are among them."""
    columns = [F.col(c) for _, c, _ in dataset.fields]
    return rows.filter("_dropped is null and _misfit is null").select(*columns)


def rejected(rows: DataFrame, name: str) -> DataFrame:
    """Rows for the dead letter: table_name, payload (JSON of the row, with the extra fields if there are any), error."""
    columns = [c for _, c, _ in DATASETS[name].fields]
    bad = rows.filter("_dropped is null and _misfit is not null")
    payload = F.to_json(F.struct(*columns, F.col("_extra").alias("extra")))
    return bad.select(F.lit(name).alias("table_name"), payload.alias("payload"), F.concat(F.lit("out of range: "), F.col("_misfit")).alias("error"))


def quality_counts(rows: DataFrame, name: str) -> DataFrame:
    """reason, n: how often a column's value had the wrong form, how many rows lack a required column, and how many have extra fields (which keeps none from the table), most frequent first."""
    lost = rows.select(F.explode("_uncoercible").alias("c")).select(F.concat(F.lit(f"{name}."), F.col("c"), F.lit(": wrong form")).alias("reason"))
    gone = rows.filter("_dropped is not null").select(F.concat(F.lit(f"{name}: without "), F.col("_dropped")).alias("reason"))
    longer = rows.filter("_extra is not null").select(F.lit(f"{name}: {EXTRA}").alias("reason"))
    return lost.union(gone).union(longer).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")
