"""Measurement: plans as text, wall time best of N, and comparisons of two phases."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.ingest import upsert

TIMINGS = "phase string, scenario int, exec_ms double, wall_s double, rows long"
PHASES = ("before", "after")
#: Nodes that a comparison counts, by the name Spark gives them (fixed values).
NODES = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "Exchange", "BroadcastExchange", "HashAggregate", "Sort", "Window", "WindowGroupLimit", "Generate", "TakeOrderedAndProject", "Scan parquet")


def executed_plan(df: DataFrame, run: bool = True) -> str:
    """The physical plan; after an action, what adaptive execution ended with."""
    execution = df._jdf.queryExecution()
    if run:
        execution.executedPlan().executeCollect()
    return execution.executedPlan().toString()


def node_counts(plan: str) -> dict[str, int]:
    """How often each of NODES stands in a plan. A name counts only as a whole, so an Exchange is no BroadcastExchange."""
    final = plan.split("+- == Initial Plan ==")[0]
    return {n: len(re.findall(rf"(?<![A-Za-z]){re.escape(n)}(?![A-Za-z])", final)) for n in NODES}


def best_of(query: Callable[[], DataFrame], runs: int = 2) -> tuple[float, float, int]:
    """(first run in ms, best later run in s, rows). The first run is cold and is reported apart."""
    times, rows = [], 0
    for _ in range(1 + runs):
        start = time.perf_counter()
        rows = len(query().toPandas())
        times.append(time.perf_counter() - start)
    return times[0] * 1000, min(times[1:] or times), rows


def load_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timings of known phases; a line that does not parse or names another phase is skipped."""
    raw = spark.read.csv(path, header=True, schema=TIMINGS, mode="DROPMALFORMED")
    return raw.filter(F.col("phase").isin(*PHASES) & F.col("scenario").isNotNull())


def merge_timings(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new put in by (phase, scenario), in that order."""
    return upsert(old, new, ["phase", "scenario"]).orderBy("phase", "scenario")


def save_csv(df: DataFrame, path: str) -> None:
    """A table of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def compared(timings: DataFrame) -> DataFrame:
    """scenario, before and after times, and the change of each in percent; null where a side is missing or before is not above 0."""
    from marlstone.functions.buckets import percent_change

    side = lambda p: timings.filter(F.col("phase") == p).select("scenario", F.col("exec_ms").alias(f"exec_{p}"), F.col("wall_s").alias(f"wall_{p}"))
    both = side("before").join(side("after"), "scenario", "full")
    return both.select("scenario", "exec_before", "exec_after", percent_change(F.col("exec_before"), F.col("exec_after")).alias("exec_change"), "wall_before", "wall_after", percent_change(F.col("wall_before"), F.col("wall_after")).alias("wall_change")).orderBy("scenario")


def markdown(df: DataFrame) -> str:
    """A small table as Markdown; null is n/a, numbers have one decimal."""
    text = lambda v: "n/a" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(text, r)) + " |" for r in df.collect()])


def plan_numbers(text) -> dict:
    """Columns exec_ms, hit, read from the text of an analysed plan: the execution time, and shared blocks of the first Buffers line."""
    line = F.regexp_extract(text, r"Buffers:([^\n]*)", 1)
    shared = F.regexp_extract(line, r"shared((?: [a-z]+=\d+)*)", 1)
    number = lambda name: F.nullif(F.regexp_extract(shared, rf"\b{name}=(\d+)", 1), F.lit("")).cast("bigint")
    return {"exec_ms": F.nullif(F.regexp_extract(text, r"Execution Time: ([0-9.]+) ms", 1), F.lit("")).cast("double"), "hit": number("hit"), "read": number("read")}


def table_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(rows, bytes of all files) of a Parquet folder, on any file system."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path).count(), at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def run_phase(spark: SparkSession, queries: dict[int, Callable[[], DataFrame]], phase: str, folder: str, runs: int = 2) -> DataFrame:
    """Times of a phase for all queries by number; each query's executed plan goes to folder as text, one file a query and phase."""
    if phase not in PHASES:
        raise ValueError(f"a phase is one of {', '.join(PHASES)}")
    rows = []
    for number, query in sorted(queries.items()):
        plan = executed_plan(query())
        spark.createDataFrame([(plan,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/scenario_{number:02d}.{phase}")
        ms, wall, n = best_of(query, runs)
        rows.append((phase, number, ms, wall, n))
    return spark.createDataFrame(rows, TIMINGS)
