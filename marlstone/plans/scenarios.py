"""The catalog scenarios on the driver's tables, each with its SQL.

The adapters give the tables the shape of a catalog: a part is a title whose name
words are its genres, an order is a title rated by its price, and so on. Averages
leave as whole hundredths, because engines differ in the type of an average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import catalog
from marlstone.session import table


def _hundredths(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_rating", (F.col("avg_rating") * 100).cast("bigint"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as titles; genres are the words of the name."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("tconst"), F.col("p_type").alias("title_type"), F.col("p_name").alias("primary_title"), F.split("p_name", " ").alias("genres"), F.col("p_size").alias("runtime_minutes"))


def _orders(spark: SparkSession, d: str, since: int | None = None) -> DataFrame:
    """Orders as titles. since: the least year, asked of the date itself, so that the reader can skip by it."""
    orders = table(spark, d, "orders")
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(f"{since}-01-01").cast(orders.schema["o_orderdate"].dataType))
    return orders.select(F.col("o_orderkey").alias("tconst"), F.col("o_orderstatus").alias("title_type"), F.year("o_orderdate").alias("start_year"), F.col("o_orderpriority").alias("primary_title"), "o_custkey")


def _prices(spark: SparkSession, d: str, least: int | None = None) -> DataFrame:
    """Prices as ratings and votes. least: the least number of votes, asked of the price itself."""
    orders = table(spark, d, "orders")
    if least is not None:
        orders = orders.filter(F.col("o_totalprice") >= float(least))
    return orders.select(F.col("o_orderkey").alias("tconst"), F.col("o_totalprice").cast("decimal(15,2)").alias("average_rating"), F.floor("o_totalprice").cast("bigint").alias("num_votes"))


def s1(spark: SparkSession, d: str) -> DataFrame:
    ratings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tconst"), F.col("l_quantity").cast("decimal(12,2)").alias("average_rating"))
    return _hundredths(catalog.average_by_genre(_parts(spark, d), ratings, "ECONOMY"))


def s2(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.most_voted(_orders(spark, d), _prices(spark, d, 100_000), "F", 100_000, 10)
    return out.withColumns({"start_year": F.col("start_year").cast("bigint"), "average_rating": (F.col("average_rating") * 100).cast("bigint")})


def s3(spark: SparkSession, d: str) -> DataFrame:
    crew = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tconst")).agg(F.collect_set("l_suppkey").alias("directors"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("nconst"), F.col("s_name").alias("primary_name"))
    rich = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("tconst"), "o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("average_rating"))
    return _hundredths(catalog.busiest_directors(_orders(spark, d), crew, names, orders.join(rich, "o_custkey"), "F", 20))


def s4(spark: SparkSession, d: str) -> DataFrame:
    return _hundredths(catalog.yearly_average(_orders(spark, d, 1997), _prices(spark, d), "F", 1997)).withColumn("start_year", F.col("start_year").cast("bigint"))


def s5(spark: SparkSession, d: str) -> DataFrame:
    principals = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tconst"), F.col("l_suppkey").alias("nconst"), F.col("l_returnflag").alias("category"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("nconst"), F.col("s_name").alias("primary_name"))
    return catalog.versatile_people(_parts(spark, d), principals, names, "ECONOMY", ("A", "R"), 15)


def s6(spark: SparkSession, d: str) -> DataFrame:
    episodes = table(spark, d, "orders").select(F.col("o_custkey").alias("parent_tconst"), F.nullif(F.year("o_orderdate"), F.lit(2001)).alias("season_number"))
    titles = table(spark, d, "customer").select(F.col("c_custkey").alias("tconst"), F.col("c_name").alias("primary_title"))
    return catalog.most_seasons(titles, episodes, 20)


def s7(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    titles = part.select(F.lit("movie").alias("title_type"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("genres"))
    return catalog.genre_pairs(titles, "movie", 20)


def s8(spark: SparkSession, d: str) -> DataFrame:
    return catalog.longest_by_genre(_parts(spark, d), "ECONOMY", 5)


QUERIES = {f.__name__: f for f in (s1, s2, s3, s4, s5, s6, s7, s8)}

ORACLES = {
    "s1": """
        SELECT genre, CAST((200 * sum(CAST(l_quantity AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_rating, count(*) AS rated_titles
        FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part WHERE p_type = 'ECONOMY') g
        JOIN lineitem ON l_partkey = p_partkey GROUP BY genre""",
    "s2": """
        SELECT o_orderkey AS tconst, o_orderpriority AS primary_title, CAST(year(o_orderdate) AS BIGINT) AS start_year,
               CAST(round(o_totalprice * 100) AS BIGINT) AS average_rating, CAST(floor(o_totalprice) AS BIGINT) AS num_votes
        FROM orders WHERE o_orderstatus = 'F' AND floor(o_totalprice) >= 100000 ORDER BY num_votes DESC, tconst LIMIT 10""",
    "s3": """
        WITH crew AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
        rated AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0),
        counted AS (
            SELECT l_suppkey AS nconst, count(*) AS num_movies, sum(cents) AS s, count(cents) AS n
            FROM crew JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' LEFT JOIN rated ON k = o_orderkey GROUP BY l_suppkey)
        SELECT nconst, s_name AS primary_name, num_movies, CAST((2 * s + n) // (2 * n) AS BIGINT) AS avg_rating
        FROM counted JOIN supplier ON s_suppkey = nconst
        ORDER BY num_movies DESC, CAST(s AS DOUBLE) / n DESC NULLS LAST, nconst LIMIT 20""",
    "s4": """
        SELECT CAST(year(o_orderdate) AS BIGINT) AS start_year,
               CAST((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_rating, count(*) AS rated_movies
        FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1997 GROUP BY 1""",
    "s5": """
        SELECT s_suppkey AS nconst, s_name AS primary_name, count(DISTINCT genre) AS genre_count
        FROM lineitem JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part WHERE p_type = 'ECONOMY') g ON l_partkey = p_partkey
        JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY s_suppkey, s_name HAVING count(DISTINCT genre) > 15""",
    "s6": """
        SELECT c_custkey AS tconst, c_name AS primary_title, count(DISTINCT season) AS seasons, count(*) AS episodes
        FROM (SELECT o_custkey, nullif(year(o_orderdate), 2001) AS season FROM orders) e JOIN customer ON c_custkey = o_custkey
        WHERE season IS NOT NULL GROUP BY c_custkey, c_name ORDER BY seasons DESC, episodes DESC, tconst LIMIT 20""",
    "s7": """
        WITH t AS (SELECT p_partkey, list_append(string_split(p_name, ' '), lower(p_type)) AS g FROM part),
        a AS (SELECT p_partkey, unnest(g) AS genre_a, g FROM t), b AS (SELECT genre_a, unnest(g) AS genre_b FROM a)
        SELECT genre_a, genre_b, count(*) AS pair_count FROM b WHERE genre_a < genre_b
        GROUP BY 1, 2 ORDER BY pair_count DESC, genre_a, genre_b LIMIT 20""",
    "s8": """
        WITH r AS (
            SELECT genre, p_partkey AS tconst, p_name AS primary_title, p_size AS runtime_minutes,
                   row_number() OVER (PARTITION BY genre ORDER BY p_size DESC, p_partkey) AS rn
            FROM (SELECT *, unnest(string_split(p_name, ' ')) AS genre FROM part WHERE p_type = 'ECONOMY') g WHERE p_size IS NOT NULL)
        SELECT genre, tconst, primary_title, runtime_minutes FROM r WHERE rn <= 5""",
}
