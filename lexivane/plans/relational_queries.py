"""Relational built-ins over the star schema: joins, groupings, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def pricing_summary(t):
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(rev), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def inner_joins(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_counts(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_nationkey, c_nationkey, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*)::BIGINT AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey")
def full_join(t):
    s = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select("s_nationkey", "c_nationkey", "suppliers", "customers")


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2")
def top_orders(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 2")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def turn_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_nations(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_nations(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))
