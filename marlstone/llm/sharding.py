"""Sharding by vector bin packing.

Documents of equal text form a group. A group whose bytes are above the mean of
so many parcels is an item of its own, or several if it is too large for a shard:
it is then split by the hash of doc_id. The other groups are hashed into the
parcels, which are the remaining items. Largest first, each item (bytes, tokens,
rows) goes to the shard whose residual capacity has the highest dot product with
it. The number of parcels is a parameter, and no more groups than that are above
their mean, so packing on the driver is bounded; no shard is a single task at any
point.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, cut, if_small, top_bits, word_count

#: Rows equal in id and text, from which on they are spread by their place in the table.
COPIES = 4096


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = (8.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of each item. vectors: items x (bytes, tokens, rows), the first dimension being the one whose balance counts most."""
    totals = np.maximum(vectors.sum(0), 1)
    items = vectors / totals * np.asarray(weights)
    residual = np.tile(np.asarray(weights) / shards, (shards, 1))
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -items[:, 0])):
        best = int(np.argmax(residual @ items[k]))
        out[k] = best
        residual[best] -= items[k]
    return _level(vectors[:, 0], out, shards)


def _level(sizes: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Move items from the largest to the smallest shard while that brings their bytes closer together. Each move lessens the sum of squared loads, so this ends."""
    load = np.bincount(shard, sizes, shards)
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        mine = np.flatnonzero((shard == high) & (sizes > 0) & (sizes < gap))
        if not len(mine):
            break
        k = mine[np.abs(sizes[mine] - gap / 2).argmin()]
        shard[k] = low
        load[high] -= sizes[k]
        load[low] += sizes[k]
    return shard


def assign_shards(documents: DataFrame, shards: int = 24, *, parcels: int = 1 << 14, split_share: float = 1 / 64) -> DataFrame:
    """From rows (doc_id, text): doc_id, size, tokens, text_crc32, shard int, slot long.

    size is the UTF-8 bytes of the text plus 8. Null text: empty, so null and
    empty texts are one group. A group above split_share of a shard's bytes is
    split; any smaller group stays in one shard. Slots are gapless from 0 in each
    shard, by hash range, then doc_id; rows equal in id and text take neighbouring
    slots, but for more than COPIES of them, which are spread like other rows: how
    many of them a shard gets may differ between runs. Null doc_ids are placed like
    any other. Other columns are ignored. Empty table: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = cut(
        documents.select(
            "doc_id",
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            word_count(F.col("text")).alias("tokens"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("mix", F.xxhash64(F.lit(7), "doc_id", "text_crc32"))
    total = narrow.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).first()
    if not total.rows:
        return narrow.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    piece = max(1, int(total.size / shards * split_share))
    groups = narrow.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.filter((F.col("bytes") > total.size / parcels) | (F.col("n") > COPIES)))
    copied = narrow.join(if_small(groups.filter(F.col("n") > COPIES).select("group")), "group").groupBy("mix").agg(F.count(F.lit(1)).alias("n"))
    copied = cut(copied.filter(F.col("n") > COPIES).select("mix", F.lit(True).alias("copied")))
    if not copied.isEmpty():
        narrow = narrow.join(if_small(copied), "mix", "left").withColumn("mix", F.when(F.col("copied"), F.xxhash64("mix", "row")).otherwise(F.col("mix"))).drop("copied")
    # fewer groups than parcels, since each has more than a parcel's share of all bytes
    large = groups.filter(F.col("bytes") > total.size / parcels).select("group", F.ceil(F.col("bytes") / piece).cast("long").alias("pieces"))
    large = large.withColumn("first", parcels + F.coalesce(F.sum("pieces").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spread = narrow.drop("row").join(F.broadcast(large), "group", "left")
    item = F.coalesce(F.col("first") + F.pmod(F.col("mix"), F.col("pieces")), F.pmod(F.xxhash64("group"), F.lit(parcels)))
    rows = cut(spread.withColumn("item", item.cast("int")).drop("group", "pieces", "first"))

    vectors = rows.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("item").toPandas()
    packed = pack(vectors[["size", "tokens", "rows"]].to_numpy(float), shards)
    where = np.zeros(int(vectors["item"].max()) + 1, np.int64)
    where[vectors["item"].to_numpy()] = packed
    # a value of one byte or two for each item: a bound set by the parameters
    lookup = F.split(F.lit(",".join(map(str, where))), ",")
    placed = rows.withColumn("shard", F.element_at(lookup, F.col("item") + 1).cast("int"))

    bits = bucket_bits(total.rows, per_bucket=2048, least=4)
    placed = placed.withColumn("range", top_bits(F.col("mix"), bits))
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(offsets.drop("n"), ["shard", "range"])
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("mix", "doc_id", "text_crc32", "size"))
    return joined.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + rank - 1).cast("long").alias("slot"))
