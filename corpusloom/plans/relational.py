"""Relational coverage beyond the record model: grouping sets, set operations, as-of and outer joins, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import load


def cube_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return line.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's order before each order: an as-of join as a window."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days"))


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.filter("l_quantity > 25").select("l_suppkey").exceptAll(line.filter("l_quantity > 40").select("l_suppkey")).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.filter("l_returnflag = 'R'").select("l_partkey").intersect(line.filter("l_returnflag = 'A'").select("l_partkey"))


def anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    open_orders = orders.filter("o_orderstatus = 'P'")
    return customer.join(open_orders, customer.c_custkey == open_orders.o_custkey, "left_anti").select("c_custkey", "c_name")


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers by nation, either side alone too."""
    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return s.join(c, s.s_nationkey == c.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("median_quantity"), F.countDistinct("l_partkey").alias("n_parts"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"))


def pivot_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {"cube_revenue": cube_revenue, "asof_orders": asof_orders, "except_all": except_all, "intersect_keys": intersect_keys, "anti_customers": anti_customers, "full_outer": full_outer,
           "quantiles": quantiles, "ranks": ranks, "pivot_priority": pivot_priority}

ORACLES = {
    "cube_revenue": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "asof_orders": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "except_all": "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 40) GROUP BY l_suppkey",
    "intersect_keys": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    "anti_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "full_outer": """WITH s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1)
        SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM s FULL JOIN c ON s_nationkey = c_nationkey""",
    "quantiles": "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median_quantity, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
    "ranks": "SELECT p_partkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS percent_rank, dense_rank() OVER w AS dense_rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)",
    "pivot_priority": "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
}
