"""Relational coverage over the star schema: joins of every kind, grouping sets, frames, pivots, quantiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.plans.registry import query


@query("REL_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing_summary(t):
    rows = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("REL_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1")
def left_outer(t):
    o = t.orders.filter("o_orderstatus = 'O'")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("REL_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer(t):
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "c", "s")


@query("REL_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("REL_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("REL_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count().na.fill(0)


@query("REL_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events")
def moving_average(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"), F.ntile(4).over(w).alias("quarter"))


@query("REL_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
def ranks(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("REL_quantiles", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def quantiles(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", 0.5), 6).alias("median"), F.round(F.percentile("l_quantity", 0.9), 6).alias("p90"), F.round(F.stddev_samp("l_quantity"), 6).alias("spread"))


@query("REL_top_customers", "SELECT c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY revenue DESC, c_custkey LIMIT 20")
def top_customers(t):
    j = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("REL_recursive_tree", "WITH RECURSIVE r AS (SELECT 1 AS n, 1 AS depth UNION ALL SELECT n * 2 + d, depth + 1 FROM r, (VALUES (0), (1)) AS v (d) WHERE depth < 6) SELECT depth, count(*) AS nodes, sum(n) AS total FROM r GROUP BY 1")
def recursive_tree(t):
    return t.spark.sql("WITH RECURSIVE r AS (SELECT 1 AS n, 1 AS depth UNION ALL SELECT n * 2 + d, depth + 1 FROM r, (VALUES (0), (1)) AS v (d) WHERE depth < 6) SELECT depth, count(*) AS nodes, sum(n) AS total FROM r GROUP BY 1")


@query("REL_json_props", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1")
def json_props(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


@query("REL_conversation_turns", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_turns(t):
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.max(F.length("text")).cast("bigint").alias("longest"))
