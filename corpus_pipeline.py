"""The corpus pipeline: quality rules, near-duplicate removal, mixing to weights, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the
last return the columns of documents; the last returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, pieces, quality, setsketch
from marlstone.llm.common import read, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 over five-word shingles."""
    return setsketch.drop_near_duplicates(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 over the sources in turn, 150 % of the words in all."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document."""
    encoded = pieces.encode_documents(docs.select("doc_id", "text"), pieces.PieceModel.load(pieces.DEFAULT_MODEL))
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("mix sources", mix_sources), ("tokenize", tokenize)]

#: No stage but the base rules is expressible in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes what the next stage no longer reads. The last folder stays, since the result reads it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            _remove(spark, f"{folder}/{k - 1}")
    return docs
