"""The eight analytic questions over a catalog of titles, people, credits and episodes.

Every function takes DataFrames in the shape of sources.catalog and leaves the
physical strategy to Catalyst. What Catalyst does not do by itself is written
out: joins come before explodes that they shrink, aggregates group by the key
alone and fetch names afterwards, averages are taken in wide decimals and rounded
once, and null order and ties are explicit. The unique key that ends each order
is ours, so that results are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_average(value: Column) -> Column:
    """Average of decimals to 16 places, so that one rounding follows, not two."""
    return F.avg(value.cast("decimal(20,12)"))


def _of_kind(titles: DataFrame, kind: str) -> DataFrame:
    return titles.filter(F.col("title_type") == kind)


def average_by_genre(titles: DataFrame, ratings: DataFrame, kind: str = "movie") -> DataFrame:
    """genre, avg_rating, rated_titles; best average first. A title counts once for each element of genres; unrated titles do not count."""
    rated = _of_kind(titles, kind).select("tconst", "genres").join(ratings.select("tconst", "average_rating"), "tconst")
    by_genre = rated.select(F.explode("genres").alias("genre"), "average_rating").groupBy("genre")
    means = by_genre.agg(wide_average(F.col("average_rating")).alias("mean"), F.count(F.lit(1)).alias("rated_titles"))
    ordered = means.orderBy(F.col("mean").desc_nulls_first(), F.col("genre").asc_nulls_last())
    return ordered.select("genre", F.round("mean", 2).alias("avg_rating"), "rated_titles")


def most_voted(titles: DataFrame, ratings: DataFrame, kind: str = "movie", floor: int = 1000, limit: int = 10) -> DataFrame:
    """tconst, primary_title, start_year, average_rating, num_votes of the titles with most votes, from floor on."""
    voted = ratings.filter(F.col("num_votes") >= floor).select("tconst", "average_rating", "num_votes")
    found = voted.join(_of_kind(titles, kind).select("tconst", "primary_title", "start_year"), "tconst")
    top = found.orderBy(F.col("num_votes").desc(), "tconst").limit(limit)
    return top.select("tconst", "primary_title", "start_year", "average_rating", "num_votes")


def busiest_directors(titles: DataFrame, crew: DataFrame, names: DataFrame, ratings: DataFrame, kind: str = "movie", limit: int = 20) -> DataFrame:
    """nconst, primary_name, num_movies, avg_rating. Unrated titles count, the average skips them; a director listed twice for a title counts twice."""
    films = crew.select("tconst", "directors").join(_of_kind(titles, kind).select("tconst"), "tconst")
    films = films.join(ratings.select("tconst", "average_rating"), "tconst", "left")
    credits = films.select(F.explode("directors").alias("nconst"), "average_rating").groupBy("nconst")
    counted = credits.agg(F.count(F.lit(1)).alias("num_movies"), wide_average(F.col("average_rating")).alias("mean"))
    named = counted.join(names.select("nconst", "primary_name"), "nconst")
    top = named.orderBy(F.col("num_movies").desc(), F.col("mean").desc_nulls_last(), "nconst").limit(limit)
    return top.select("nconst", "primary_name", "num_movies", F.round("mean", 2).alias("avg_rating"))


def yearly_average(titles: DataFrame, ratings: DataFrame, kind: str = "movie", since: int = 2000) -> DataFrame:
    """start_year, avg_rating, rated_movies by year from since on."""
    recent = _of_kind(titles, kind).filter(F.col("start_year") >= since).select("tconst", "start_year")
    years = recent.join(ratings.select("tconst", "average_rating"), "tconst").groupBy("start_year")
    means = years.agg(wide_average(F.col("average_rating")).alias("mean"), F.count(F.lit(1)).alias("rated_movies"))
    return means.orderBy("start_year").select("start_year", F.round("mean", 2).alias("avg_rating"), "rated_movies")


def versatile_people(titles: DataFrame, principals: DataFrame, names: DataFrame, kind: str = "movie", roles: tuple[str, ...] = ("actor", "actress"), more_than: int = 5) -> DataFrame:
    """nconst, primary_name, genre_count of people seen in more than more_than distinct genres."""
    cast = principals.filter(F.col("category").isin(*roles)).select("tconst", "nconst")
    seen = cast.join(_of_kind(titles, kind).select("tconst", "genres"), "tconst")
    pairs = seen.select("nconst", F.explode("genres").alias("genre")).distinct()
    counts = pairs.groupBy("nconst").agg(F.count("genre").alias("genre_count")).filter(F.col("genre_count") > more_than)
    named = counts.join(names.select("nconst", "primary_name"), "nconst")
    return named.orderBy(F.col("genre_count").desc(), F.col("primary_name").asc_nulls_last(), "nconst").select("nconst", "primary_name", "genre_count")


def most_seasons(titles: DataFrame, episodes: DataFrame, limit: int = 20) -> DataFrame:
    """tconst, primary_title, seasons, episodes. Only episodes of a known season count; the parent may be of any kind."""
    known = episodes.filter(F.col("season_number").isNotNull()).groupBy("parent_tconst", "season_number").agg(F.count(F.lit(1)).alias("n"))
    counted = known.groupBy("parent_tconst").agg(F.count(F.lit(1)).alias("seasons"), F.sum("n").alias("episodes"))
    named = counted.join(titles.select("tconst", "primary_title"), counted["parent_tconst"] == titles["tconst"])
    top = named.orderBy(F.col("seasons").desc(), F.col("episodes").desc(), "tconst").limit(limit)
    return top.select("tconst", "primary_title", "seasons", "episodes")


def genre_pairs(titles: DataFrame, kind: str = "movie", limit: int = 20) -> DataFrame:
    """genre_a, genre_b, pair_count with genre_a < genre_b by bytes. All pairs of a title come from one generator, with no join."""
    partners = lambda a: F.transform(F.filter("genres", lambda b: a < b), lambda b: F.struct(a.alias("genre_a"), b.alias("genre_b")))
    pairs = _of_kind(titles, kind).select(F.explode(F.flatten(F.transform("genres", partners))).alias("pair"))
    counted = pairs.groupBy("pair.genre_a", "pair.genre_b").agg(F.count(F.lit(1)).alias("pair_count"))
    return counted.orderBy(F.col("pair_count").desc(), "genre_a", "genre_b").limit(limit)


def longest_by_genre(titles: DataFrame, kind: str = "movie", top: int = 5) -> DataFrame:
    """genre, tconst, primary_title, runtime_minutes of the top longest titles of each genre."""
    timed = _of_kind(titles, kind).filter(F.col("runtime_minutes").isNotNull())
    each = timed.select(F.explode("genres").alias("genre"), "tconst", "primary_title", "runtime_minutes")
    order = Window.partitionBy("genre").orderBy(F.col("runtime_minutes").desc(), "tconst")
    ranked = each.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top).drop("rn")
    return ranked.orderBy("genre", F.col("runtime_minutes").desc(), "tconst")
