"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by a hash. A document's virtual finish time is its
source's tokens up to and including it, divided by the source's target; a second
lap over the source goes on from there. All finish times are put in one global
order, and the mix is what comes before the total budget is spent. The order is
never made by one task: running sums go over ranges of the hash, then over
ranges of virtual time, and only the one range in which the budget ends is
sorted row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, cut, if_small, packed, top_bits, word_count

#: A source gives each document this often at most.
LAPS = 2
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Mix:
    """rows: the narrow input with source_size, target, finish_1, finish_2, laps; targets: one row per source; cutoff: the last (finish, place, key) taken."""

    rows: DataFrame
    targets: DataFrame


def targets(per_source: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, cap: float = LAPS) -> DataFrame:
    """From (source, source_size): place (by code point, null last), target.

    Targets share budget_share of all sizes by the weights in turn; each stops at
    cap times its source's size and the excess is shared by weight again until
    none is above. In order of cap / weight, those capped come first, so one pass
    finds the level at which the rest share.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    listed = per_source.withColumn("place", F.row_number().over(everywhere).cast("long"))
    turn = ((F.col("place") - 1) % len(weights)).cast("int")
    listed = listed.withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1), "most": cap * F.col("source_size").cast("double")})
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    whole = Window.partitionBy()
    listed = listed.withColumns(
        {
            "budget": budget_share * F.sum("source_size").over(whole),
            "capped_before": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(*_BEFORE)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    listed = listed.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    listed = listed.withColumn("shares", F.col("level") <= F.col("most") / F.col("weight"))
    listed = listed.withColumn("final", F.min(F.when(F.col("shares"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight")))
    return listed.select("source", "source_size", "place", target.alias("target"))


def mixed(documents: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, seed: int = 20) -> Mix:
    """Mix rows (doc_id, source, text); size is the number of words of the text.

    Null text or no words: size 0, taken 0. Null source: a source of its own,
    last. Rows repeated in full are separate documents. A document of any length
    is taken whole or not at all in each lap. Other columns are ignored. Empty
    table: no rows. The shuffle hashes doc_id and text, so reruns agree.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    narrow = cut(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    bits = bucket_bits(narrow.count())
    narrow = narrow.withColumn("bucket", top_bits(F.col("key"), bits))
    sums = cut(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget_share))
    ranges = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0)))
    same = ranges["source"].eqNullSafe(plan["source"])
    ranges = ranges.join(plan, same).select(ranges["source"], "bucket", "before", "source_size", "place", "target")
    ranges = ranges.select("place", "bucket", "before", F.col("source").alias("of"), "source_size", "target")
    rows = narrow.join(ranges.withColumnRenamed("bucket", "range"), narrow["source"].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("range"))).drop("of", "range")
    within = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(*_UP_TO)
    rows = rows.withColumn("done", F.col("before") + F.sum("size").over(within))
    finish = lambda lap: F.when(F.col("target") > 0, (F.lit(lap) * F.col("source_size") + F.col("done")) / F.col("target")).otherwise(F.lit(float("inf")))
    rows = cut(rows.withColumns({f"finish_{lap + 1}": finish(lap) for lap in range(LAPS)}).drop("before", "done"))
    last = _cutoff(rows, bits, plan.agg(F.sum("target")).first()[0] or 0.0)
    taken = sum((_fits(F.col(f"finish_{lap + 1}"), last) for lap in range(LAPS)), F.lit(0))
    return Mix(rows.withColumn("laps", taken), plan)


def _fits(finish: Column, last: tuple | None) -> Column:
    if last is None:
        return F.lit(0)
    upto, place, key = last
    fits = (finish < F.lit(upto)) | (finish == F.lit(upto)) & ((F.col("place") < place) | (F.col("place") == place) & (F.col("key") <= F.lit(key)))
    return fits.cast("int")


def _cutoff(rows: DataFrame, bits: int, budget: float) -> tuple | None:
    """The (finish, place, key) of the last document before the budget is spent; one row to the driver."""
    steps = 1 << bits
    laps = F.explode(F.array(*[F.col(f"finish_{lap + 1}") for lap in range(LAPS)])).alias("finish")
    served = rows.filter("target > 0").select("place", "key", "size", laps)
    served = served.withColumn("time", F.least(F.col("finish") * steps, F.lit(2.0 * steps)).cast("long"))
    spent = served.groupBy("time").agg(F.sum("size").alias("spent"))
    spent = spent.withColumn("before", F.coalesce(F.sum("spent").over(Window.orderBy("time").rowsBetween(*_BEFORE)), F.lit(0)))
    edge = spent.filter((F.col("before") <= budget) & (F.col("spent") > 0)).orderBy(F.desc("time")).select("time", "before").first()
    if edge is None:
        return None
    order = Window.orderBy("finish", "place", "key").rowsBetween(*_UP_TO)
    inside = served.filter(F.col("time") == edge.time).withColumn("total", F.lit(edge.before) + F.sum("size").over(order))
    last = inside.filter(F.col("total") <= budget).agg(F.max(F.struct("finish", "place", "key"))).first()[0]
    if last is not None:
        return last.finish, last.place, last.key
    return (edge.time / steps, -1, 0)


def mix_report(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, finish."""
    return mix.rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("laps")).cast("long").alias("taken"), F.col("finish_1").alias("finish"))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Within a source, what is taken is a prefix of the shuffled order, so a row per
    source carries the decision back to the whole rows: the last key of each lap.
    """
    mix = mixed(documents, **options)
    ends = mix.rows.groupBy("place", "source").agg(*[F.max(F.when(F.col("laps") >= lap, F.col("key"))).alias(f"_end_{lap}") for lap in range(1, LAPS + 1)])
    ends = cut(ends.select(F.col("source").alias("_source"), *[f"_end_{lap}" for lap in range(1, LAPS + 1)]))
    seed = options.get("seed", 20)
    copies = sum((F.coalesce((F.xxhash64(F.lit(seed), "_row.doc_id", "_row.text") <= F.col(f"_end_{lap}")).cast("int"), F.lit(0)) for lap in range(1, LAPS + 1)), F.lit(0))
    joined = packed(documents).join(if_small(ends), F.col("_row.source").eqNullSafe(F.col("_source")), "left")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
