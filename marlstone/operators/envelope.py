"""Message envelopes: rows to JSON messages and back.

{"table": t, "data": {row}} holds one row, {"table": t, "rows": [{row}, ...]} many.
Null columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_messages(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One message per row: payload."""
    return rows.select(F.to_json(F.struct(F.lit(table).alias("table"), F.struct(*columns).alias("data"))).alias("payload"))


def batch_messages(rows: DataFrame, table: str, columns: list[str], order: list[str], size: int = 1000) -> DataFrame:
    """position long, n_rows, payload: rows dealt into messages of at most size, in the order given; position ascends with it.

    Rows are sorted by range, so batches are made in parallel: each range numbers
    its own rows and its batches start anew, and no row waits for another range.
    """
    spread = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    dealt = spread.withColumns({"_n": number, "_batch": F.floor(number / size)})
    grouped = dealt.groupBy("_part", "_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list(F.struct("_n", F.struct(*columns).alias("row")))).alias("_rows"))
    payload = F.to_json(F.struct(F.lit(table).alias("table"), F.transform("_rows", lambda r: r.row).alias("rows")))
    position = F.col("_part").cast("long") * F.lit(1 << 32) + F.col("_batch")
    return grouped.select(position.alias("position"), "n_rows", payload.alias("payload"))


def opened(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of messages, with table string, rows array<string> of JSON, and malformed boolean.

    If both keys are there, rows wins. A payload that is not a JSON object, rows
    that are no array, and neither key are malformed. A payload that is a JSON
    string is parsed once more.
    """
    first = F.try_parse_json(F.col(payload))
    inner = F.coalesce(F.try_variant_get(first, "$", "string"), F.col(payload))
    text = F.when(F.schema_of_variant(first) == "STRING", inner).otherwise(F.col(payload))
    body = F.try_parse_json(text)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    rows, data = F.try_variant_get(body, "$.rows", "variant"), F.try_variant_get(body, "$.data", "variant")
    listed = F.when(kind(rows).startswith("ARRAY"), F.from_json(F.get_json_object(text, "$.rows"), "array<string>"))
    one = F.when(rows.isNull() & data.isNotNull(), F.array(F.get_json_object(text, "$.data")))
    out = messages.withColumns({"table": F.try_variant_get(body, "$.table", "string"), "rows": F.when(kind(body).startswith("OBJECT"), F.coalesce(listed, one))})
    return out.withColumn("malformed", F.col("rows").isNull() | F.col("table").isNull())


def payload_stats(messages: DataFrame, payload: str = "payload", large: int = 2048) -> DataFrame:
    """One row: messages, min, max, total and median bytes, and how many exceed large."""
    size = F.octet_length(payload)
    return messages.select(size.alias("b")).agg(
        F.count(F.lit(1)).alias("messages"), F.min("b").alias("min_bytes"), F.max("b").alias("max_bytes"),
        F.sum(F.col("b").cast("bigint")).alias("total_bytes"), F.percentile("b", F.lit(0.5)).alias("median_bytes"), F.count_if(F.col("b") > large).alias("large"),
    )


def contains(document: Column, part: dict) -> Column:
    """Whether JSON text holds all of part's top-level scalars."""
    out = F.lit(True)
    for key, value in part.items():
        kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "string"
        out &= F.coalesce(F.try_variant_get(F.try_parse_json(document), f"$.{key}", kind) == F.lit(value), F.lit(False))
    return out
