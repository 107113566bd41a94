"""Files to tables as a stream: parse, validate, insert once, set bad rows apart.

The checkpoint remembers which files were read, so a restart goes on where the
last commit was. A batch that is run again inserts nothing twice, because the
insert skips keys that the table holds, and dead letters are written under the
number of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.ingest import insert_new
from marlstone.sources.catalog import DATASETS
from marlstone.sources.tsv import accepted, coerce_rows, rejected, split_lines


def ingest_files(spark: SparkSession, source: str, fields: list[str], name: str, table: str, dead: str, checkpoint: str, files_per_batch: int = 8) -> StreamingQuery:
    """Starts the stream of text files under source into the Parquet folder table; it ends when all files present are read.

    fields are the header's names. files_per_batch bounds a batch, which is what
    holds back the reader here.
    """
    dataset = DATASETS[name]

    def load(batch: DataFrame, number: int) -> None:
        rows = coerce_rows(split_lines(batch, fields), dataset)
        good, bad = accepted(rows, dataset), rejected(rows, name)
        try:
            held = spark.read.schema(good.schema).parquet(table)
        except Exception as e:  # the table's folder is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = spark.createDataFrame([], good.schema)
        columns = [c for c in good.columns if c not in dataset.key]
        insert_new(good, held, list(dataset.key), columns).write.mode("append").parquet(table)
        bad.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema("value string").text(source)
    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
