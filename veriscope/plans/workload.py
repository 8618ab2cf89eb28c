"""Business questions over the star schema.

Money is summed as decimals, so totals do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope.operators.baskets import frequent_pairs
from veriscope.operators.ordering import top_per_key
from veriscope.plans.registry import query
from veriscope.sources.files import read_table

_CENTS = "decimal(18,2)"
_REVENUE_SQL = "l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2))"


def _money(c: str):
    return F.col(c).cast(_CENTS)


def _revenue():
    return _money("l_extendedprice") * (F.lit(1).cast("decimal(18,2)") - _money("l_discount"))


def _total(c, name: str):
    return F.sum(c).cast("double").alias(name)


def _mean(c, name: str, digits: int = 6):
    return F.round(F.sum(c).cast("double") / F.count(c), digits).alias(name)


def _lines(spark, d):
    return read_table(spark, d, "lineitem")


def _lines_orders(spark, d):
    return _lines(spark, d).join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def _places(spark, d):
    """Customers with their nation and region."""
    nation = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read_table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def _sales(spark, d):
    """Lines with order, customer and place."""
    return _lines_orders(spark, d).join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey"))


_PLACES_SQL = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SALES_SQL = f"lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({_PLACES_SQL}) ON o_custkey = c_custkey"


@query("B1_totals_of_a_year", f"""
SELECT count(DISTINCT o_orderkey) AS orders, sum({_REVENUE_SQL})::DOUBLE AS revenue, sum(l_quantity)::DOUBLE AS quantity,
  round(sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*), 6) AS avg_discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'""")
def totals(spark, d):
    year = F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31 23:59:59.999999").cast("timestamp_ntz"))
    return _lines_orders(spark, d).filter(year).agg(
        F.count_distinct("o_orderkey").alias("orders"), _total(_revenue(), "revenue"), F.sum("l_quantity").alias("quantity"),
        _mean(_money("l_discount"), "avg_discount"))


@query("B2_filtered_list", """
SELECT DISTINCT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'""")
def listed(spark, d):
    return _places(spark, d).filter((F.col("r_name") == "ASIA") & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name", "n_name").distinct()


@query("B2_distinct_categories", "SELECT DISTINCT p_type, p_brand FROM part")
def categories(spark, d):
    return read_table(spark, d, "part").select("p_type", "p_brand").distinct()


@query("B3_top_parts_by_sales", f"SELECT l_partkey, sum({_REVENUE_SQL})::DOUBLE AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 5")
def top_parts(spark, d):
    return _lines(spark, d).groupBy("l_partkey").agg(_total(_revenue(), "revenue")).orderBy(F.col("revenue").desc(), "l_partkey").limit(5)


@query("B3_top_customers", f"""
SELECT o_custkey, c_name, revenue FROM (SELECT o_custkey, sum({_REVENUE_SQL})::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
ORDER BY revenue DESC, o_custkey LIMIT 10) JOIN customer ON c_custkey = o_custkey""")
def top_customers(spark, d):
    top = _lines_orders(spark, d).groupBy("o_custkey").agg(_total(_revenue(), "revenue")).orderBy(F.col("revenue").desc(), "o_custkey").limit(10)
    return top.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", "revenue")


@query("B4_sales_by_region_and_segment", f"""
SELECT r_name, c_mktsegment, sum({_REVENUE_SQL})::DOUBLE AS revenue, round(sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*), 6) AS avg_discount, count(*) AS lines FROM {_SALES_SQL} GROUP BY 1, 2""")
def by_region_segment(spark, d):
    return _sales(spark, d).groupBy("r_name", "c_mktsegment").agg(
        _total(_revenue(), "revenue"), _mean(_money("l_discount"), "avg_discount"), F.count("*").alias("lines"))


@query("B5_best_and_worst_region", f"""
WITH s AS (SELECT r_name, sum({_REVENUE_SQL})::DOUBLE AS revenue FROM {_SALES_SQL} GROUP BY 1)
SELECT arg_max(r_name, (revenue, r_name)) AS best, arg_min(r_name, (revenue, r_name)) AS worst, max(revenue) AS best_revenue FROM s""")
def extremes(spark, d):
    s = _sales(spark, d).groupBy("r_name").agg(_total(_revenue(), "revenue"))
    order = F.struct("revenue", "r_name")
    return s.agg(F.max_by("r_name", order).alias("best"), F.min_by("r_name", order).alias("worst"), F.max("revenue").alias("best_revenue"))


@query("B6_monthly_trend", """
SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1""")
def monthly(spark, d):
    return read_table(spark, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(
        F.count("*").alias("orders"), _total(_money("o_totalprice"), "total"))


@query("B6_quarterly_trend_by_region", f"""
SELECT r_name, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
FROM orders JOIN ({_PLACES_SQL}) ON o_custkey = c_custkey GROUP BY ALL""")
def quarterly(spark, d):
    o = read_table(spark, d, "orders").join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("r_name", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(_total(_money("o_totalprice"), "total"))


@query("B7_yearly_growth_by_type", f"""
WITH y AS (SELECT p_type, year(l_shipdate)::INTEGER AS year, sum({_REVENUE_SQL})::DOUBLE AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, year, revenue, round((revenue - lag(revenue) OVER w) * 100.0::DOUBLE / lag(revenue) OVER w, 6) AS growth FROM y WINDOW w AS (PARTITION BY p_type ORDER BY year)""")
def growth(spark, d):
    y = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_type", F.year("l_shipdate").alias("year")).agg(_total(_revenue(), "revenue"))
    before = F.lag("revenue").over(Window.partitionBy("p_type").orderBy("year"))
    return y.withColumn("growth", F.round((F.col("revenue") - before) * 100.0 / before, 6))


@query("B7_declining_parts", """
WITH y AS (SELECT l_partkey, year(l_shipdate) AS year, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_shipdate < DATE '1998-01-01' GROUP BY ALL),
x AS (SELECT l_partkey, q - lag(q) OVER (PARTITION BY l_partkey ORDER BY year) AS change FROM y)
SELECT l_partkey, count(change) AS periods, min(change) AS steepest FROM x GROUP BY 1 HAVING max(change) < 0 AND count(change) >= 2""")
def declining(spark, d):
    early = _lines(spark, d).filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    y = early.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey").orderBy("year")
    x = y.withColumn("change", F.col("q") - F.lag("q").over(w))
    return x.groupBy("l_partkey").agg(
        F.count("change").alias("periods"), F.min("change").alias("steepest"), F.max("change").alias("flattest"),
    ).filter((F.col("flattest") < 0) & (F.col("periods") >= 2)).drop("flattest")


_MARGIN_SQL = """sum((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2))) - l_quantity::DECIMAL(18,2) * p_retailprice::DECIMAL(18,2))"""


@query("B8_margin_by_type", f"""
SELECT p_type, round({_MARGIN_SQL}::DOUBLE / nullif(sum({_REVENUE_SQL})::DOUBLE, 0), 8) AS margin, {_MARGIN_SQL}::DOUBLE AS profit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def margin(spark, d):
    joined = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    profit = F.sum(_revenue() - _money("l_quantity") * _money("p_retailprice")).cast("double")
    revenue = F.sum(_revenue()).cast("double")
    return joined.groupBy("p_type").agg(
        F.round(profit / F.nullif(revenue, F.lit(0.0)), 8).alias("margin"), profit.alias("profit"))


@query("B8_negative_profit_parts", f"""
SELECT l_partkey, count(*) AS lines, {_MARGIN_SQL}::DOUBLE AS loss FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE {_REVENUE_SQL} < l_quantity::DECIMAL(18,2) * p_retailprice::DECIMAL(18,2) GROUP BY 1""")
def negative(spark, d):
    joined = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    profit = _revenue() - _money("l_quantity") * _money("p_retailprice")
    return joined.filter(profit < 0).groupBy("l_partkey").agg(F.count("*").alias("lines"), _total(profit, "loss"))


@query("B8_high_sales_low_margin", f"""
WITH s AS (SELECT s_nationkey, p_type, sum({_REVENUE_SQL})::DOUBLE AS revenue, {_MARGIN_SQL}::DOUBLE AS profit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
t AS (SELECT quantile_cont(revenue, 0.75) AS high, quantile_cont(profit, 0.25) AS low FROM s)
SELECT s_nationkey, p_type, revenue, profit FROM s, t WHERE revenue >= high OR profit <= low""")
def high_low(spark, d):
    joined = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        read_table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    profit = F.sum(_revenue() - _money("l_quantity") * _money("p_retailprice")).cast("double")
    # one row per nation and type: the percentiles read a small aggregate
    s = joined.groupBy("s_nationkey", "p_type").agg(_total(_revenue(), "revenue"), profit.alias("profit"))
    cut = s.agg(F.percentile("revenue", 0.75).alias("high"), F.percentile("profit", 0.25).alias("low"))
    return s.join(F.broadcast(cut)).filter((F.col("revenue") >= F.col("high")) | (F.col("profit") <= F.col("low"))).drop("high", "low")


@query("B9_lifetime_value_by_segment", """
WITH c AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS spent, count(*) AS orders FROM orders GROUP BY 1)
SELECT c_mktsegment, count(*) AS customers, round(sum(spent)::DOUBLE / count(*), 4) AS lifetime_value, round(sum(orders)::DOUBLE / count(*), 6) AS order_frequency,
  round(sum(spent)::DOUBLE / sum(orders)::DOUBLE, 4) AS average_order FROM c JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def lifetime(spark, d):
    c = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("spent"), F.count("*").alias("orders"))
    joined = c.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spent, orders = F.sum("spent").cast("double"), F.sum("orders").cast("double")
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.round(spent / F.count("*"), 4).alias("lifetime_value"),
        F.round(orders / F.count("*"), 6).alias("order_frequency"), F.round(spent / orders, 4).alias("average_order"))


@query("B9_sales_per_customer_by_region", f"""
SELECT r_name, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(DISTINCT o_custkey), 4) AS sales_per_customer FROM orders JOIN ({_PLACES_SQL}) ON o_custkey = c_custkey GROUP BY 1""")
def per_customer(spark, d):
    # per customer first, so no region has to hold its distinct customers
    c = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("spent"))
    joined = c.join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum("spent").cast("double") / F.count("*"), 4).alias("sales_per_customer"))


@query("B10_correlations", "SELECT round(corr(l_discount, l_extendedprice), 8) AS discount_price, round(corr(l_quantity, l_extendedprice), 8) AS quantity_price FROM lineitem")
def correlations(spark, d):
    return _lines(spark, d).agg(
        F.round(F.corr("l_discount", "l_extendedprice"), 8).alias("discount_price"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("quantity_price"))


@query("B11_top_parts_per_type", f"""
WITH s AS (SELECT p_type, p_partkey, sum({_REVENUE_SQL})::DOUBLE AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_partkey)::INTEGER AS rank FROM s QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_partkey) <= 3""")
def top_per_type(spark, d):
    sums = _lines(spark, d).groupBy("l_partkey").agg(_total(_revenue(), "revenue"))
    named = sums.join(read_table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("p_type", "p_partkey", "revenue")
    return top_per_key(named, ["p_type"], [F.col("revenue").desc(), F.col("p_partkey")], 3)


@query("B12_ordered_with_best_seller", """
WITH best AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey LIMIT 20),
i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS part, b.l_partkey AS other, count(*) AS orders FROM i a JOIN best USING (l_partkey) JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL""")
def together(spark, d):
    """Parts ordered together with the best sellers.

    Only orders that contain one of the 20 best sellers are opened, and a line
    meets at most 20 parts, so the work stays linear however long an order is.
    """
    items = _lines(spark, d).select("l_orderkey", "l_partkey").distinct()
    best = items.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(20)
    anchors = items.join(F.broadcast(best.select("l_partkey")), ["l_partkey"]).groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    met = items.join(anchors, ["l_orderkey"]).select(F.explode("parts").alias("part"), F.col("l_partkey").alias("other"))
    return met.filter("part <> other").groupBy("part", "other").agg(F.count("*").alias("orders"))


#: A pair is frequent from this many orders on; the same number stands in the SQL.
MIN_ORDERS = 2


@query("B12_ordered_together", f"""
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
n AS (SELECT p, count(*) AS n FROM i GROUP BY 1)
SELECT a.p AS part, b.p AS other, count(*) AS orders, min(x.n) AS part_orders, min(y.n) AS other_orders
FROM i a JOIN i b ON a.o = b.o AND a.p < b.p JOIN n x ON x.p = a.p JOIN n y ON y.p = b.p
GROUP BY 1, 2 HAVING count(*) >= {MIN_ORDERS}""")
def ordered_together(spark, d):
    """All pairs of parts that at least MIN_ORDERS orders hold."""
    return frequent_pairs(_lines(spark, d), F.col("l_orderkey"), F.col("l_partkey"), min_support=MIN_ORDERS)


@query("B13_discount_share_by_region", f"""
SELECT r_name, round(sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DOUBLE * 100 / sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 8) AS discount_percent FROM {_SALES_SQL} GROUP BY 1""")
def ratio(spark, d):
    share = F.sum(_money("l_extendedprice") * _money("l_discount")).cast("double") * 100 / F.sum(_money("l_extendedprice")).cast("double")
    return _sales(spark, d).groupBy("r_name").agg(F.round(share, 8).alias("discount_percent"))


@query("B14_big_spenders", f"""
SELECT c_custkey, c_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spent FROM orders JOIN ({_PLACES_SQL}) ON o_custkey = c_custkey
WHERE r_name = 'EUROPE' AND o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1997-01-01' AND o_totalprice > 100000 GROUP BY 1, 2 ORDER BY spent DESC, c_custkey""")
def big_spenders(spark, d):
    o = read_table(spark, d, "orders").filter(
        (F.col("o_orderdate") >= F.lit("1996-04-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("o_totalprice") > 100000))
    europe = _places(spark, d).filter(F.col("r_name") == "EUROPE")
    return o.join(europe, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(
        _total(_money("o_totalprice"), "spent")).orderBy(F.col("spent").desc(), "c_custkey")


_STOCK_SQL = """demand AS (SELECT l_partkey, sum(l_quantity)::DOUBLE AS sold FROM lineitem GROUP BY 1),
stock AS (SELECT p_partkey, p_type, p_retailprice, p_size * 10 AS stock, (p_size % 7)::BIGINT AS lead_time, coalesce(sold, 0) AS sold FROM part LEFT JOIN demand ON l_partkey = p_partkey)"""


def _stock(spark, d):
    """Parts with a stock level, a lead time and the quantity sold."""
    demand = _lines(spark, d).groupBy("l_partkey").agg(F.sum("l_quantity").alias("sold"))
    return read_table(spark, d, "part").join(demand, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "p_partkey", "p_type", "p_retailprice", (F.col("p_size") * 10).alias("stock"), (F.col("p_size") % 7).cast("long").alias("lead_time"),
        F.coalesce("sold", F.lit(0.0)).alias("sold"))


@query("B15_reorder_list", f"WITH {_STOCK_SQL} SELECT p_partkey, stock, sold, sold / 365 * lead_time > stock AS reorder, stock < 50 AS low, sold > 800 AND stock < 100 AS hot FROM stock WHERE stock < 200 OR sold / 365 * lead_time > stock")
def reorder(spark, d):
    need = F.col("sold") / 365 * F.col("lead_time") > F.col("stock")
    s = _stock(spark, d).filter((F.col("stock") < 200) | need)
    return s.select("p_partkey", "stock", "sold", need.alias("reorder"), (F.col("stock") < 50).alias("low"),
                    ((F.col("sold") > 800) & (F.col("stock") < 100)).alias("hot"))


@query("B16_stock_turnover", f"""WITH {_STOCK_SQL} SELECT p_type, round(sum(sold) / nullif(sum(stock), 0), 8) AS turnover,
  round(sum(stock * p_retailprice::DECIMAL(18,2))::DOUBLE * 0.2::DOUBLE, 4) AS carrying_cost FROM stock GROUP BY 1""")
def turnover(spark, d):
    return _stock(spark, d).groupBy("p_type").agg(
        F.round(F.try_divide(F.sum("sold"), F.sum("stock")), 8).alias("turnover"),
        F.round(F.sum(F.col("stock") * _money("p_retailprice")).cast("double") * 0.2, 4).alias("carrying_cost"))


@query("B17_supplier_scores", """
WITH s AS (SELECT l_suppkey, avg(l_quantity) AS lead, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*) AS defects FROM lineitem GROUP BY 1),
b AS (SELECT min(lead) AS l0, max(lead) AS l1, min(defects) AS d0, max(defects) AS d1 FROM s),
n AS (SELECT l_suppkey, round(1 - 0.5::DOUBLE * (lead - l0) / (l1 - l0) - 0.5::DOUBLE * (defects - d0) / (d1 - d0), 8) AS score FROM s, b)
SELECT l_suppkey, score FROM n ORDER BY score DESC, l_suppkey""")
def supplier_scores(spark, d):
    s = _lines(spark, d).groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("lead"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("defects"))
    b = s.agg(F.min("lead").alias("l0"), F.max("lead").alias("l1"), F.min("defects").alias("d0"), F.max("defects").alias("d1"))
    score = (1 - 0.5 * (F.col("lead") - F.col("l0")) / (F.col("l1") - F.col("l0"))
             - 0.5 * (F.col("defects") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    return s.join(F.broadcast(b)).select("l_suppkey", F.round(score, 8).alias("score")).orderBy(F.col("score").desc(), "l_suppkey")


@query("B18_cost_breakdown", f"""
SELECT l_partkey, sum(l_quantity::DECIMAL(18,2) * p_retailprice::DECIMAL(18,2))::DOUBLE AS goods, sum(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DOUBLE AS tax,
  sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DOUBLE AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def breakdown(spark, d):
    joined = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("l_partkey").agg(
        _total(_money("l_quantity") * _money("p_retailprice"), "goods"), _total(_money("l_extendedprice") * _money("l_tax"), "tax"),
        _total(_money("l_extendedprice") * _money("l_discount"), "discount"))


@query("B19_seasonality", """
WITH m AS (SELECT p_type, month(l_shipdate)::INTEGER AS month, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, month, round(q / avg(q) OVER (PARTITION BY p_type), 8) AS month_index FROM m""")
def seasonality(spark, d):
    m = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_type", F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    return m.select("p_type", "month", F.round(F.col("q") / F.avg("q").over(Window.partitionBy("p_type")), 8).alias("month_index"))


@query("B19_forecast", """
WITH y AS (SELECT p_type, year(l_shipdate)::DOUBLE AS year, sum(l_quantity)::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, round(regr_intercept(q, year) + regr_slope(q, year) * 2002, 2) AS next_year, round(regr_slope(q, year), 4) AS slope FROM y GROUP BY 1""")
def forecast(spark, d):
    y = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_type", F.year("l_shipdate").cast("double").alias("year")).agg(F.sum("l_quantity").alias("q"))
    slope, start = F.regr_slope("q", "year"), F.regr_intercept("q", "year")
    return y.groupBy("p_type").agg(F.round(start + slope * 2002, 2).alias("next_year"), F.round(slope, 4).alias("slope"))


@query("B20_defect_rates", """
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*), 8) AS rate FROM lineitem GROUP BY 1
HAVING count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*) > 0.3""")
def defects(spark, d):
    bad = F.count_if(F.col("l_returnflag") == "R")
    return _lines(spark, d).groupBy("l_suppkey").agg(bad.alias("returned"), (bad / F.count("*")).alias("rate")).filter(
        F.col("rate") > 0.3).withColumn("rate", F.round("rate", 8))


@query("B21_reorder_quantity", f"WITH {_STOCK_SQL} SELECT p_partkey, round(sqrt(2 * sold * 50.0::DOUBLE / (p_retailprice * 0.2::DOUBLE)), 6) AS quantity FROM stock")
def reorder_quantity(spark, d):
    return _stock(spark, d).select(
        "p_partkey", F.round(F.sqrt(2 * F.col("sold") * 50.0 / (F.col("p_retailprice") * 0.2)), 6).alias("quantity"))


@query("B23_parts_without_sales", """
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= DATE '2001-01-01' AND l_shipdate < DATE '2001-04-01')""")
def unsold(spark, d):
    sold = _lines(spark, d).filter(
        (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("2001-04-01").cast("timestamp_ntz")))
    return read_table(spark, d, "part").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


# --- statement classes ----------------------------------------------------
_LITERAL = {
    "like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'",
    "in_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority",
    "between": "SELECT count(*) AS n, min(l_quantity) AS lowest FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "window": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
    "concat_substring": "SELECT c_custkey, concat(substring(c_mktsegment, 1, 3), '-', c_name) AS label FROM customer",
    "date_arithmetic": "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL '90' DAY AND o_orderdate < DATE '1998-01-01'",
}


def _statement(text: str):
    def run(spark, d):
        names = [t for t in ("lineitem", "orders", "customer", "supplier", "nation", "part") if f" {t}" in text]
        frames = {t: read_table(spark, d, t) for t in names}
        sql = text
        for t in names:
            sql = sql.replace(f" {t}", f" {{{t}}}")
        return spark.sql(sql, **frames)

    return run


for _name, _text in _LITERAL.items():
    _oracle = _text.replace("rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", "(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER")
    query(f"B22_{_name}", _oracle)(_statement(_text))
