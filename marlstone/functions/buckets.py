"""Derived attributes and small formatting helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From how many votes a title is popular (fixed value).
POPULAR = 10_000


# Labels and bounds of buckets and units below are fixed values.


def rating_bucket(rating: Column) -> Column:
    """"7-8" for 7 up to 8; "10" from 10 on."""
    low = F.when(rating >= 0, F.floor(rating)).otherwise(F.ceil(rating)).cast("bigint")
    return F.when(low >= 10, F.lit("10")).otherwise(F.concat_ws("-", low.cast("string"), (low + 1).cast("string")))


def vote_bucket(votes: Column) -> Column:
    return F.when(votes >= 100_000, "100k+").when(votes >= 10_000, "10k-100k").when(votes >= 1_000, "1k-10k").when(votes.isNotNull(), "<1k")


def rating_metadata(rating: Column, votes: Column, source: str = "title.ratings") -> Column:
    """JSON text with src, rating_bucket, vote_bucket, popular; parts of a null input are left out, and two null inputs make null."""
    parts = F.struct(F.lit(source).alias("src"), F.when(rating.isNotNull(), rating_bucket(rating)).alias("rating_bucket"), vote_bucket(votes).alias("vote_bucket"), (votes >= POPULAR).alias("popular"))
    return F.when(rating.isNotNull() | votes.isNotNull(), F.to_json(parts))


def human_bytes(n: Column) -> Column:
    """Bytes in binary units up to PiB, with one decimal and marks between thousands."""
    units = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
    out = F.lit(None).cast("string")
    for power in reversed(range(len(units))):
        shown = F.concat(F.format_string("%,.1f", n / F.lit(float(1024**power))), F.lit(f" {units[power]}"))
        out = shown if power == len(units) - 1 else F.when(F.abs(n) < 1024 ** (power + 1), shown).otherwise(out)
    return out


def percent_change(before: Column, after: Column) -> Column:
    """(before - after) / before in percent; null unless before is above 0."""
    return F.when(before > 0, (before - after) / before * 100)


def one_line(text: Column, limit: int = 500) -> Column:
    return F.left(F.regexp_replace(F.trim(text), "\n", " "), F.lit(limit))


def is_transient(sqlstate: Column) -> Column:
    """Class 40: serialization failures and deadlocks. Null is not transient."""
    return F.coalesce(sqlstate.startswith("40"), F.lit(False))
