"""One query per operator of the catalog engine on the driver's tables, each with its SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import buckets, coerce
from marlstone.operators import envelope, ingest, queue, worker
from marlstone.plans import catalog, measure
from marlstone.session import table
from marlstone.sources import tsv
from marlstone.sources.catalog import DATASETS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 12, 0, 0)


def query(sql: str):
    def put(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return put


def _big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# filters and projections


@query("SELECT p_partkey, p_name AS title, CAST(p_size AS BIGINT) AS size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size >= 10 AND p_retailprice IS NOT NULL")
def filter_range_in_notnull(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO") & (F.col("p_size") >= 10) & F.col("p_retailprice").isNotNull())
    return part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").cast("bigint").alias("size"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F' AND c_acctbal > 5000")
def filter_in_join_condition(spark: SparkSession, d: str) -> DataFrame:
    """A constant predicate of an inner join stands before it, at the scan."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    return orders.join(rich, orders.o_custkey == rich.c_custkey).select("o_orderkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'")
def filter_distinct_from(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(~F.nullif("o_orderstatus", F.lit("P")).eqNullSafe("F")).select("o_orderkey")


@query(r"SELECT s_suppkey FROM supplier WHERE replace(s_name, '#', '_') LIKE '%\_0000%5' ESCAPE '\'")
def filter_like_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").filter(F.replace("s_name", F.lit("#"), F.lit("_")).like(r"%\_0000%5")).select("s_suppkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND json_extract_string(props, '$.k') = '7'")
def filter_json_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "view") & (F.get_json_object("props", "$.k") == "7")).select("event_id")


@query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
def derived_table(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return big.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def array_constructor(spark: SparkSession, d: str) -> DataFrame:
    """An array from the rows of a key; nation has 25 rows, so no group is large."""
    listed = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("a"))
    return listed.select("region", F.array_join("a", ",").alias("names"))


# joins


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").select("l_orderkey", *_big("l_linenumber")).join(orders, "l_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """Counted before the join, so a customer with very many orders is one row in it."""
    big = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 1000")
def join_keys_differ(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation = table(spark, d, "supplier").filter("s_acctbal < 1000"), table(spark, d, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_name", "n_name")


@query("SELECT p_partkey, unnest(CASE WHEN p_size > 10 THEN string_split(p_name, ' ') END) AS word FROM part")
def join_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose array is null or empty go."""
    return table(spark, d, "part").select("p_partkey", F.explode(F.when(F.col("p_size") > 10, F.split("p_name", " "))).alias("word"))


@query("""WITH t AS (SELECT p_partkey, list_append(string_split(p_name, ' '), lower(p_type)) AS g FROM part),
          a AS (SELECT p_partkey, unnest(g) AS x, g FROM t), b AS (SELECT p_partkey, x, unnest(g) AS y FROM a) SELECT p_partkey, x, y FROM b WHERE x < y""")
def join_array_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    pairs = F.flatten(F.transform(g, lambda x: F.transform(F.filter(g, lambda y: x < y), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return table(spark, d, "part").select("p_partkey", F.explode(pairs).alias("p")).select("p_partkey", "p.x", "p.y")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


# aggregates


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST((200 * sum(CAST(l_quantity AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_hundredths
          FROM lineitem GROUP BY 1, 2""")
def agg_average(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), catalog.wide_average(F.col("l_quantity")).alias("mean"))
    return means.select("l_returnflag", "l_linestatus", "n", (F.round("mean", 2) * 100).cast("bigint").alias("avg_hundredths"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def agg_distinct_having(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and plain counts from one two-step aggregate."""
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n")).filter("n > 5")


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
          count(*) FILTER (WHERE o_orderstatus = 'nothing') AS x, count(*) AS total FROM orders""")
def agg_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(status == "O").alias("o"), F.count_if(status == "F").alias("f"), F.count_if(status == "nothing").alias("x"), F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_large, bool_or(o_totalprice > 499000) AS some_huge, count(*) AS n FROM orders GROUP BY 1")
def agg_bool_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_large"), F.bool_or(F.col("o_totalprice") > 499_000).alias("some_huge"), F.count(F.lit(1)).alias("n"))


@query("SELECT min(strlen(text)) AS least, max(strlen(text)) AS most, CAST(sum(strlen(text)) AS BIGINT) AS total, median(strlen(text)) AS middle FROM conversations")
def agg_min_max_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact median by percentile."""
    sizes = table(spark, d, "conversations").select(F.octet_length("text").cast("bigint").alias("b"))
    return sizes.agg(F.min("b").alias("least"), F.max("b").alias("most"), F.sum("b").alias("total"), F.percentile("b", F.lit(0.5)).alias("middle"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'too small' WHEN p_retailprice > 1500 THEN 'too dear' END AS reason FROM part) r
          WHERE reason IS NOT NULL GROUP BY 1""")
def agg_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("p_size") < 5, "too small").when(F.col("p_retailprice") > 1500, "too dear")
    return table(spark, d, "part").select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


# windows, order, limits, set operations


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders")
def window_row_number(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("bigint").alias("rn"))


@query("""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) r WHERE rn <= 3""")
def window_top_k(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(order)).filter("rn <= 3").select("p_brand", "p_partkey")


@query("""SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_acctbal, c_custkey) AS place FROM customer) r WHERE place <= 40""")
def sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "customer").withColumn("s", F.nullif("c_mktsegment", F.lit("BUILDING"))).orderBy(F.col("s").desc_nulls_last(), "c_acctbal", "c_custkey").limit(40)
    numbered = F.row_number().over(Window.orderBy(F.col("s").desc_nulls_last(), "c_acctbal", "c_custkey")).cast("bigint")
    return top.select("c_custkey", numbered.alias("place"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)
    return rows.select("l_orderkey", *_big("l_linenumber"), "l_extendedprice")


@query("SELECT 'customer' AS kind, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")

    def counted(name: str, prefix: str) -> DataFrame:
        per = table(spark, d, name).groupBy(F.col(f"{prefix}_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return per.join(nation, "k").select(F.lit(name).alias("kind"), "n_name", "n")

    return counted("customer", "c").unionByName(counted("supplier", "s"))


# scalar functions


@query("""SELECT event_id, left(coalesce(nullif(event_type, 'view'), 'nothing seen'), 6) AS short, trim('  ' || event_type || ' ') = '' AS blank,
          CASE WHEN event_id % 7 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def scalar_text(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("nothing seen"))
    status = F.when(F.col("event_id") % 7 + 1 >= 5, "failed").otherwise("pending")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", F.left(kind, F.lit(6)).alias("short"), (F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))) == "").alias("blank"), status.alias("status"), k.alias("k"))


@query("SELECT event_id, ts + INTERVAL 30 SECOND < TIMESTAMP '2024-01-20 12:00:00' AS expired FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 DAY")
def scalar_clock(spark: SparkSession, d: str) -> DataFrame:
    """Time arithmetic on an injected clock."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    recent = table(spark, d, "events").filter(F.col("ts") >= now - F.expr("interval 2 days"))
    return recent.select("event_id", (F.col("ts") + F.expr("interval 30 seconds") < now).alias("expired"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(split_part(p_name, ' ', 1)) FROM part))")
def scalar_array_contains(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    least = part.agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w"))
    return part.join(F.broadcast(least), F.array_contains(F.split("p_name", " "), F.col("w"))).select("p_partkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 3")
def scalar_json_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(envelope.contains(F.col("props"), {"k": 3})).select("event_id")


_RAW = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '\\N' WHEN 2 THEN ' 12 ' WHEN 3 THEN '1_000' WHEN 4 THEN '40000' WHEN 5 THEN '7.25'
    WHEN 6 THEN 'x1' WHEN 7 THEN '-3' ELSE '1' END AS raw FROM orders"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    made = F.element_at(F.array(*[F.lit(x) for x in ("", r"\N", " 12 ", "1_000", "40000", "7.25", "x1", "-3", "1")]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", made.alias("raw")).withColumn("v", coerce.clean(F.col("raw")))


@query(f"""WITH r AS ({_RAW}), c AS (SELECT *, CASE WHEN raw NOT IN ('', '\\N') THEN raw END AS v FROM r),
    n AS (SELECT *, CASE WHEN regexp_matches(v, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$') THEN CAST(replace(trim(v), '_', '') AS BIGINT) END AS i FROM c)
    SELECT o_orderkey, v, i, CASE WHEN i BETWEEN -32768 AND 32767 THEN i END AS s, CASE v WHEN '1' THEN true WHEN '0' THEN false END AS b,
           CASE WHEN v <> 'x1' THEN CAST(replace(trim(v), '_', '') AS DOUBLE) END AS f FROM n""")
def coerce_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _raw(spark, d).select("o_orderkey", "v", coerce.to_int(v).cast("bigint").alias("i"), coerce.to_smallint(v).cast("bigint").alias("s"), coerce.to_bool01(v).alias("b"), coerce.to_rating(v).alias("f"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', ',') WHEN 1 THEN replace(p_name, ' ', chr(2)) || chr(2) WHEN 2 THEN ',,' ELSE p_name || ',,x' END AS v FROM part),
    l AS (SELECT p_partkey, list_filter(string_split(v, CASE WHEN contains(v, chr(2)) THEN chr(2) ELSE ',' END), lambda x: x <> '') AS a FROM r)
    SELECT p_partkey, CASE WHEN len(a) > 0 THEN array_to_string(a, '|') END AS items FROM l""")
def coerce_list(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    v = F.when(k == 0, F.replace(name, F.lit(" "), F.lit(","))).when(k == 1, F.concat(F.replace(name, F.lit(" "), F.lit("\x02")), F.lit("\x02"))).when(k == 2, F.lit(",,")).otherwise(F.concat(name, F.lit(",,x")))
    items = coerce.to_list(v)
    return table(spark, d, "part").select("p_partkey", F.when(items.isNotNull(), F.array_join(items, "|")).alias("items"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN 'false' WHEN 4 THEN props END AS kept FROM events""")
def coerce_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.lit("[]")).when(k == 1, F.lit("false")).when(k == 2, F.lit("null")).when(k == 3, F.lit('["a",')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", coerce.to_json(v).alias("kept"))


@query("""SELECT o_orderkey, CASE WHEN r >= 10 THEN '10' ELSE r || '-' || (r + 1) END AS rating_bucket,
    CASE WHEN o_totalprice >= 100000 THEN '100k+' WHEN o_totalprice >= 10000 THEN '10k-100k' WHEN o_totalprice >= 1000 THEN '1k-10k' ELSE '<1k' END AS vote_bucket
    FROM (SELECT *, o_orderkey % 12 AS r FROM orders) o""")
def meta_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", buckets.rating_bucket((F.col("o_orderkey") % 12).cast("double")).alias("rating_bucket"), buckets.vote_bucket(F.col("o_totalprice")).alias("vote_bucket"))


@query("""SELECT o_orderkey, CASE WHEN b > 0 THEN (b - a) / b * 100 END AS change, coalesce(left(o_orderstatus || '40', 3) = 'O40', false) AS retried,
    replace(trim(' ' || o_orderpriority || chr(10) || 'x '), chr(10), ' ') AS line FROM (SELECT *, o_totalprice - 100000 AS b, o_totalprice / 2 AS a FROM orders) o""")
def scalar_reports(spark: SparkSession, d: str) -> DataFrame:
    b, a = F.col("o_totalprice") - 100000, F.col("o_totalprice") / 2
    state = F.when(F.col("o_orderstatus") == "O", "40P01").otherwise("23505")
    line = buckets.one_line(F.concat(F.lit(" "), "o_orderpriority", F.lit("\nx ")))
    return table(spark, d, "orders").select("o_orderkey", buckets.percent_change(b, a).alias("change"), buckets.is_transient(state).alias("retried"), line.alias("line"))


@query("""SELECT o_orderkey, o_totalprice AS exec_ms, o_orderkey AS hit, CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS read FROM orders""")
def plan_text_numbers(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("Sort\n  Buffers: shared hit="), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, " read=7").otherwise(""), F.lit(", temp read=9 written=9\n    Buffers: shared hit=1 read=2\nExecution Time: "), F.format_string("%.2f", "o_totalprice"), F.lit(" ms"))
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in measure.plan_numbers(shown).items()])


# envelopes, ingestion, queue


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS custkeys, true AS small_batches FROM orders")
def envelope_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders to messages of 500 rows and back."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    messages = envelope.batch_messages(orders, "orders", orders.columns, ["o_orderkey"], 500)
    rows = envelope.opened(messages).select("n_rows", F.explode("rows").alias("row"))
    back = rows.select("n_rows", F.from_json("row", "o_orderkey bigint, o_custkey bigint, o_orderstatus string").alias("r"))
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("r.o_custkey").alias("custkeys"), F.bool_and(F.col("n_rows") <= 500).alias("small_batches"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) r WHERE rn = 1 AND l_orderkey % 10 <> 0""")
def insert_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Line items inserted into a table that already holds every tenth order: the first of each key, once."""
    rows = table(spark, d, "lineitem").select("l_orderkey", *_big("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")
    key = ["l_orderkey", "l_linenumber"]
    held = rows.filter("l_orderkey % 10 = 0").select(*key)
    return ingest.insert_new(rows, held, key, ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("""SELECT 'part' AS table_name, '22003' AS sqlstate, p_partkey AS partkey FROM part WHERE p_size > 40""")
def dead_letter(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size")
    _, bad = ingest.split_valid(part, F.col("p_size") > 40)
    letters = ingest.dead_letters(bad, "part", ["p_partkey", "p_size"], "22003", "out of range: p_size")
    return letters.select("table_name", "sqlstate", F.get_json_object("payload", "$.p_partkey").cast("bigint").alias("partkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("segment"))
    return ingest.upsert(old, new, ["c_custkey"])


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as a queue's table: status by kind, a lease of 30 seconds from the time of the event."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "processing").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("pending")
    lease = F.when(status == "processing", F.col("ts") + F.expr("interval 30 seconds"))
    columns = [F.col("event_id").alias("id"), (F.col("event_id") % 6).cast("int").alias("attempts"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("queue_name"), status.alias("status"), F.col("props").alias("payload")]
    return table(spark, d, "events").select(*columns, F.lit(None).cast("string").alias("last_error"), lease.cast("timestamp").alias("locked_until"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"))


_QUEUE = """q AS (SELECT event_id AS id, event_id % 6 AS attempts, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS queue_name,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, props, ts FROM events)"""


@query(f"""WITH {_QUEUE} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
    count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM q WHERE queue_name = 'even'""")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return queue.queue_stats(_queue(spark, d), "even")


@query(f"WITH {_QUEUE} SELECT id AS msg_id, props AS payload FROM q WHERE queue_name = 'odd' AND status = 'pending' ORDER BY id LIMIT 25")
def queue_dequeue(spark: SparkSession, d: str) -> DataFrame:
    return queue.dequeue(_queue(spark, d), "odd", NOW, 25)[1]


@query(f"""WITH {_QUEUE} SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 10 AS INTEGER) AS worker, id AS msg_id FROM (
    SELECT * FROM q WHERE queue_name = 'odd' AND status = 'pending' ORDER BY id LIMIT 40) c""")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim(_queue(spark, d), "odd", NOW, 4, 10)[1].select("worker", "msg_id")


@query(f"""WITH {_QUEUE} SELECT id, CASE WHEN id % 50 = 0 AND status = 'processing' THEN 'done' ELSE status END AS status FROM q""")
def queue_ack(spark: SparkSession, d: str) -> DataFrame:
    rows = _queue(spark, d)
    return queue.ack(rows, rows.filter("id % 50 = 0").select("id"), NOW)[0].select("id", "status")


@query(f"""WITH {_QUEUE} SELECT id, CASE WHEN hit THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
    CAST(CASE WHEN hit THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN hit THEN 'no' END AS last_error FROM (SELECT *, id % 20 = 0 AND status = 'processing' AS hit FROM q) h""")
def queue_nack(spark: SparkSession, d: str) -> DataFrame:
    rows = _queue(spark, d)
    return queue.nack(rows, rows.filter("id % 20 = 0").select("id"), NOW, "no")[0].select("id", "status", *_big("attempts"), "last_error")


@query(f"WITH {_QUEUE} SELECT id FROM q WHERE queue_name = 'even' AND status = 'processing' AND ts + INTERVAL 30 SECOND < TIMESTAMP '2024-01-20 12:00:00'")
def queue_reap(spark: SparkSession, d: str) -> DataFrame:
    return queue.reap_expired(_queue(spark, d), "even", NOW)[1]


@query(f"""WITH {_QUEUE}, gone AS (SELECT id FROM q WHERE queue_name = 'odd' AND status = 'done' AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 DAY ORDER BY id LIMIT 100)
    SELECT id FROM q WHERE id NOT IN (SELECT id FROM gone)""")
def queue_purge(spark: SparkSession, d: str) -> DataFrame:
    return queue.purge_done(_queue(spark, d), "odd", NOW, timedelta(days=1), 100)[0].select("id")


#: What each kind of event does to a user's message (our convention).
MOVES = {"signup": "enqueue", "view": "dequeue", "purchase": "ack", "error": "nack", "click": "reap"}


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, 'none' AS status, CAST(0 AS BIGINT) AS attempts FROM e
      UNION ALL SELECT f.user_id, e.rn,
        CASE WHEN k = 'signup' AND status IN ('none', 'done', 'failed') THEN 'pending' WHEN k = 'view' AND status = 'pending' THEN 'processing'
             WHEN k = 'purchase' AND status = 'processing' THEN 'done'
             WHEN k IN ('error', 'click') AND status = 'processing' THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END ELSE status END,
        CASE WHEN k = 'signup' AND status IN ('none', 'done', 'failed') THEN 0 WHEN k IN ('error', 'click') AND status = 'processing' THEN attempts + 1 ELSE attempts END
      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, status, attempts FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM e GROUP BY user_id)""")
def queue_fold(spark: SparkSession, d: str) -> DataFrame:
    return queue.fold(table(spark, d, "events"), "user_id", "event_id", "event_type", MOVES)


@query("SELECT count(*) AS messages, min(strlen(props)) AS min_bytes, max(strlen(props)) AS max_bytes, CAST(sum(strlen(props)) AS BIGINT) AS total_bytes, median(strlen(props)) AS median_bytes, count(*) FILTER (WHERE strlen(props) > 8) AS large FROM events")
def payload_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = envelope.payload_stats(table(spark, d, "events"), "props", 8)
    return stats.withColumns({"min_bytes": F.col("min_bytes").cast("bigint"), "max_bytes": F.col("max_bytes").cast("bigint")})


# delimited text


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines of a ratings file: every 7th short, every 11th with two fields more, every 13th without a key, and a header and a blank line."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    rating = F.format_string("%d.%d", key % 10, key % 7)
    votes = F.when(key % 5 == 0, F.lit("many")).when(key % 17 == 0, F.lit("3000000000")).otherwise(F.col("o_custkey").cast("string"))
    fields = [F.when(key % 13 == 0, F.lit(r"\N")).otherwise(key.cast("string")), rating]
    line = F.when(key % 7 == 0, F.concat_ws("\t", *fields)).when(key % 11 == 0, F.concat_ws("\t", *fields, votes, F.lit("x"), F.lit("y"))).otherwise(F.concat_ws("\t", *fields, votes))
    head = spark.createDataFrame([("tconst\taverageRating\tnumVotes",), ("",)], "value string")
    return head.union(o.select(line.alias("value")))


_LINES = """l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS tconst, (o_orderkey % 10) * 10 + o_orderkey % 7 AS tenths,
    CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'many' WHEN o_orderkey % 17 = 0 THEN '3000000000' ELSE CAST(o_custkey AS VARCHAR) END END AS votes,
    o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS extra FROM orders),
    t AS (SELECT *, TRY_CAST(votes AS BIGINT) AS num_votes FROM l)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return tsv.coerce_rows(tsv.split_lines(_lines(spark, d), ["tconst", "averageRating", "numVotes"]), DATASETS["title_ratings"])


@query(f"""WITH {_LINES} SELECT tconst, CAST(tenths AS BIGINT) AS tenths, num_votes FROM t WHERE tconst IS NOT NULL AND (num_votes IS NULL OR num_votes <= 2147483647)""")
def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines to typed rows for the table: short ones padded, long ones by their first fields, wrong forms null."""
    rows = tsv.accepted(_typed(spark, d), DATASETS["title_ratings"])
    return rows.select("tconst", (F.col("average_rating") * 10).cast("bigint").alias("tenths"), F.col("num_votes").cast("bigint").alias("num_votes"))


@query(f"""WITH {_LINES} SELECT tconst, num_votes FROM t WHERE extra AND tconst IS NOT NULL AND (num_votes IS NULL OR num_votes <= 2147483647)""")
def tsv_extra_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rows with more fields than the header are in the table."""
    rows = tsv.accepted(_typed(spark, d).filter("_extra is not null"), DATASETS["title_ratings"])
    return rows.select("tconst", F.col("num_votes").cast("bigint").alias("num_votes"))


@query(f"""WITH {_LINES} SELECT tconst, 'out of range: num_votes' AS error, CASE WHEN extra THEN 'x,y' END AS extra FROM t WHERE tconst IS NOT NULL AND num_votes > 2147483647""")
def tsv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What a table cannot take goes to the dead letter, extra fields and all."""
    payload = F.from_json("payload", "tconst string, extra array<string>")
    rows = tsv.rejected(_typed(spark, d), "title_ratings").select("error", payload.alias("p"))
    return rows.select("p.tconst", "error", F.when(F.col("p.extra").isNotNull(), F.array_join("p.extra", ",")).alias("extra"))


@query(f"""WITH {_LINES} SELECT reason, count(*) AS n FROM (
    SELECT 'title_ratings.num_votes: wrong form' AS reason FROM t WHERE votes = 'many'
    UNION ALL SELECT 'title_ratings: extra fields' FROM t WHERE extra
    UNION ALL SELECT 'title_ratings: without tconst' FROM t WHERE tconst IS NULL) r GROUP BY 1""")
def tsv_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return tsv.quality_counts(_typed(spark, d), "title_ratings")


@query(f"""WITH {_LINES}, m AS (SELECT tconst, num_votes, votes FROM t WHERE tconst IS NOT NULL)
    SELECT tconst, CASE WHEN votes = 'many' THEN '22P02' WHEN num_votes > 2147483647 THEN '22003' END AS sqlstate, CASE WHEN votes = 'many' OR num_votes > 2147483647 THEN 'num_votes' END AS error FROM m""")
def typed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of messages to the types of their table, with the state that a fault has."""
    lines = tsv.split_lines(_lines(spark, d), ["tconst", "averageRating", "numVotes"]).filter(r"tconst <> '\\N'")
    rows = lines.select(F.to_json(F.struct("tconst", F.col("averageRating").alias("average_rating"), F.col("numVotes").alias("num_votes"))).alias("row"))
    return worker.typed_rows(rows, DATASETS["title_ratings"]).select("tconst", "sqlstate", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'b' || (o_orderkey % 9) END AS bucket, o_totalprice >= 10000 AS popular FROM orders""")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Derived attributes as JSON, and out of it again."""
    rating = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 9).cast("double"))
    rows = table(spark, d, "orders").select("o_orderkey", buckets.rating_metadata(rating, F.col("o_totalprice")).alias("m"))
    low = F.split_part(F.get_json_object("m", "$.rating_bucket"), F.lit("-"), F.lit(1))
    return rows.select("o_orderkey", F.concat(F.lit("b"), low).alias("bucket"), F.get_json_object("m", "$.popular").cast("boolean").alias("popular"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || '.0 B' WHEN b < 1048576 THEN (b // 1024) || '.5 KiB' ELSE '1,000.0 PiB' END AS shown
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN (o_orderkey % 900 + 1) * 1024 + 512 ELSE 1125899906842624000 END AS b FROM orders) o""")
def byte_units(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    n = F.when(key % 3 == 0, key % 1000).when(key % 3 == 1, (key % 900 + 1) * 1024 + 512).otherwise(F.lit(1_125_899_906_842_624_000))
    return table(spark, d, "orders").select("o_orderkey", buckets.human_bytes(n).alias("shown"))


@query("""SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS inserted, count(*) FILTER (WHERE o_orderkey % 4 IN (2, 3)) AS skipped, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS bad FROM orders""")
def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    """Offered rows by what became of them."""
    rows = table(spark, d, "orders").select("o_orderkey")
    good, bad = ingest.split_valid(rows, F.col("o_orderkey") % 4 == 0)
    new = ingest.insert_new(good, rows.filter("o_orderkey % 4 > 1"), ["o_orderkey"], ["o_orderkey"])
    return ingest.totals(rows, new, bad, "orders")


# messages into the queue


@query("""SELECT 1000 + row_number() OVER (ORDER BY event_id DESC) AS id, event_id, 'pending' AS status FROM events WHERE event_id % 3 <> 0""")
def queue_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """A frame of messages gets ids in the order given; null payloads are skipped."""
    payload = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    messages = table(spark, d, "events").select((-F.col("event_id")).alias("position"), payload.alias("payload"))
    rows = queue.enqueue_frame(queue.empty(spark), "q", messages, NOW, 1001)[0]
    return rows.select("id", F.col("payload").cast("bigint").alias("event_id"), "status")


@query("SELECT CAST(count(*) AS BIGINT) AS messages, true AS in_order, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM (SELECT o_orderkey, 1 AS n_rows FROM orders) o")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one row each: ids ascend with the rows' keys, whatever the number of partitions and batches."""
    messages = envelope.batch_messages(table(spark, d, "orders").select("o_orderkey"), "orders", ["o_orderkey"], ["o_orderkey"], 1)
    rows = queue.enqueue_frame(queue.empty(spark), "q", messages, NOW, 1)[0].select("id", F.get_json_object("payload", "$.rows[0].o_orderkey").cast("bigint").alias("key"))
    # of n rows with ids 1 to n in the order of the key, all have a key no less than those before
    ranked = rows.select("id", "key", F.row_number().over(Window.partitionBy(F.floor((F.col("id") - 1) / 64)).orderBy("key")).alias("rank"))
    ends = rows.groupBy(F.floor((F.col("id") - 1) / 64).alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    apart = ends.alias("a").join(ends.alias("b"), F.col("a.part") + 1 == F.col("b.part")).agg(F.coalesce(F.bool_and(F.col("a.high") < F.col("b.low")), F.lit(True)).alias("apart"))
    inside = ranked.agg(F.count(F.lit(1)).alias("messages"), F.bool_and((F.col("id") - 1) % 64 + 1 == F.col("rank")).alias("inside"))
    return inside.join(F.broadcast(apart)).select("messages", (F.col("inside") & F.col("apart")).alias("in_order"), F.col("messages").alias("n_rows"))


@query(f"""WITH {_QUEUE}, r AS (SELECT *, queue_name = 'even' AND status = 'processing' AND ts + INTERVAL 30 SECOND < TIMESTAMP '2024-01-20 12:00:00' AS over FROM q),
    a AS (SELECT id, queue_name, CASE WHEN over THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN over THEN attempts + 1 ELSE attempts END AS attempts FROM r),
    c AS (SELECT id FROM a WHERE queue_name = 'even' AND status = 'pending' ORDER BY id LIMIT 50)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'done' ELSE status END AS status, CAST(attempts AS BIGINT) AS attempts FROM a""")
def queue_reap_drain(spark: SparkSession, d: str) -> DataFrame:
    """A worker's round: what a dead one held is taken back, the next fifty are claimed and ended."""
    rows, _ = queue.reap_expired(_queue(spark, d), "even", NOW)
    rows, taken = queue.dequeue(rows, "even", NOW, 50)
    return queue.ack(rows, taken.select(F.col("msg_id").alias("id")), NOW)[0].select("id", "status", *_big("attempts"))
