"""Relational core on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcorpus.operators import relational as REL
from sparkcorpus.queries.base import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, t):
    line = t("lineitem").filter(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark, t):
    """Inner joins; revenue is summed by order before it meets customers."""
    by_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    by_customer = by_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    rows = by_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT c_custkey, round(total, 2) AS total, orders FROM (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total, count(*) AS orders FROM orders GROUP BY o_custkey) ORDER BY total DESC, c_custkey LIMIT 20""")
def top_customers(spark, t):
    """O1: a global top-k."""
    c = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("orders"))
    return REL.top(c, 20, F.desc("total"), F.asc("c_custkey")).withColumn("total", F.round("total", 2))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_quantity(spark, t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_orders(spark, t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer""")
def orders_of_customers(spark, t):
    """Counts with zero kept."""
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("""SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def parts_without_large_orders(spark, t):
    """An anti join."""
    big = t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").select("p_partkey", "p_brand").join(big, "p_partkey", "left_anti")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_type LIKE '%S%' AND p_size IS NOT NULL""")
def parts_by_pattern(spark, t):
    """Patterns and null tests."""
    return t("part").filter(F.col("p_name").ilike("%a%") & F.col("p_type").like("%S%") & F.col("p_size").isNotNull()).select("p_partkey", "p_name")


@query("""SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rn FROM customer) WHERE rn <= 3""")
def best_customers_by_segment(spark, t):
    """Top-k of each group."""
    return REL.top_per_group(t("customer"), ["c_mktsegment"], 3, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_mktsegment", "c_custkey", "rn")


@query("""SELECT o_custkey, o_orderkey, used FROM (SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS used FROM orders) WHERE used <= 500000""")
def orders_within_budget(spark, t):
    """Running sums up to a budget."""
    w = REL.prefix_within(t("orders"), ["o_custkey"], [F.asc("o_orderkey")], F.col("o_totalprice"), 1e18)
    return w.withColumn("used", F.round("used", 2)).filter("used <= 500000").select("o_custkey", "o_orderkey", "used")


@query("""SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders""")
def customers_with_orders(spark, t):
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT n_name, count(*) FILTER (kind = 'c') AS customers, count(*) FILTER (kind = 's') AS suppliers FROM (SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY n_name""")
def parties_by_nation(spark, t):
    """A union and conditional counts."""
    both = t("customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("kind")))
    n = both.groupBy("k").agg(F.count_if(F.col("kind") == "c").alias("customers"), F.count_if(F.col("kind") == "s").alias("suppliers"))
    return n.join(t("nation"), F.col("k") == F.col("n_nationkey")).select("n_name", "customers", "suppliers")
