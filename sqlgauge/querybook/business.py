"""Business-analysis queries over the star schema, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.operators import patterns as P
from sqlgauge.querybook.registry import day_text, query, rounded, table

MONEY = "decimal(18,2)"


def brand_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales by brand: line items joined to parts only; dates are on the line item."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), *_dates(),
        F.col("l_quantity").cast(MONEY).alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("amount"))


def _dates() -> list[Column]:
    d = F.col("l_shipdate")
    return [d.cast("date").alias("day"), F.trunc(d.cast("date"), "MM").alias("month"),
            F.trunc(d.cast("date"), "quarter").alias("quarter"), F.trunc(d.cast("date"), "week").alias("week")]


def area_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales by brand and by nation and region of the supplier."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    area = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    return (
        table(spark, sf, "lineitem").join(area, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
                F.col("n_name").alias("nation"), F.col("r_name").alias("region"), *_dates(),
                F.col("l_quantity").cast(MONEY).alias("qty"),
                F.col("l_extendedprice").cast(MONEY).alias("amount"))
    )


_SQL_DATES = """l_shipdate::DATE AS day, date_trunc('month', l_shipdate)::DATE AS month,
  date_trunc('quarter', l_shipdate)::DATE AS quarter, date_trunc('week', l_shipdate)::DATE AS week,
  l_quantity::DECIMAL(18,2) AS qty, l_extendedprice::DECIMAL(18,2) AS amount"""
BRAND_SALES = f"""brand_sales AS (SELECT p_brand AS brand, p_type AS ptype, {_SQL_DATES}
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
AREA_SALES = f"""area_sales AS (SELECT p_brand AS brand, p_type AS ptype, n_name AS nation, r_name AS region, {_SQL_DATES}
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BRAND_MONTH = f"""{BRAND_SALES}, bm AS (SELECT brand, month, sum(amount) AS amount, sum(qty) AS qty
  FROM brand_sales GROUP BY ALL)"""
BRAND_QUARTER = f"""{BRAND_SALES}, bq AS (SELECT brand, quarter, sum(amount) AS amount, sum(qty) AS qty
  FROM brand_sales GROUP BY ALL)"""


def _d(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


@query("bi_monthly_totals_above", "B1", f"""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, p_brand AS brand,
  sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'
GROUP BY ALL HAVING sum(l_quantity::DECIMAL(18,2)) > 200""")
def bi_monthly_totals_above(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), "o_orderdate")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    facts = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_partkey", F.col("l_quantity").cast(MONEY).alias("qty"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .filter((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    )
    out = P.totals_above(facts, ["brand"], "month", "qty", 200)
    return out.select(day_text("month").alias("month"), "brand", F.col("qty").cast("double").alias("qty"))


@query("bi_month_growth", "B2", f"""
WITH {BRAND_MONTH}, g AS (SELECT *, lag(amount) OVER (PARTITION BY brand ORDER BY month) AS p FROM bm)
SELECT brand, {_d('month')} AS month, amount::DOUBLE AS amount, p::DOUBLE AS previous,
  round((amount::DOUBLE - p::DOUBLE) / p::DOUBLE, 6) AS growth FROM g
WHERE p > 0 AND (amount::DOUBLE - p::DOUBLE) / p::DOUBLE > 0.05""")
def bi_month_growth(spark: SparkSession, sf: str) -> DataFrame:
    out = P.period_growth(brand_sales(spark, sf), ["brand"], "month", "amount", 0.05)
    return out.select("brand", day_text("month").alias("month"), F.col("amount").cast("double").alias("amount"),
                      F.col("previous").cast("double").alias("previous"), rounded("growth").alias("growth"))


@query("bi_year_growth", "B3", f"""
WITH {BRAND_MONTH}
SELECT a.brand, {_d('a.month')} AS month, a.amount::DOUBLE AS amount,
  CASE WHEN b.amount > 0 THEN round((a.amount::DOUBLE - b.amount::DOUBLE) / b.amount::DOUBLE, 6) END AS growth
FROM bm a LEFT JOIN bm b ON a.brand = b.brand AND a.month = (b.month + INTERVAL 12 MONTH)::DATE""")
def bi_year_growth(spark: SparkSession, sf: str) -> DataFrame:
    out = P.year_on_year(brand_sales(spark, sf), ["brand"], "month", "amount")
    return out.select("brand", day_text("month").alias("month"), F.col("amount").cast("double").alias("amount"),
                      rounded("growth").alias("growth"))


@query("bi_share_gain", "B4", f"""
WITH {BRAND_MONTH}, s AS (SELECT brand, month, amount::DOUBLE / (sum(amount) OVER (PARTITION BY month))::DOUBLE AS share FROM bm)
SELECT a.brand, {_d('a.month')} AS month, round(a.share, 6) AS share, round((a.share - b.share) * 100, 6) AS points
FROM s a JOIN s b ON a.brand = b.brand AND a.month = (b.month + INTERVAL 12 MONTH)::DATE
WHERE (a.share - b.share) * 100 > 3""")
def bi_share_gain(spark: SparkSession, sf: str) -> DataFrame:
    out = P.share_gain(brand_sales(spark, sf), ["brand"], "month", "amount", 3)
    return out.select("brand", day_text("month").alias("month"), rounded("share").alias("share"),
                      rounded("points").alias("points"))


@query("bi_top_growth", "B5", f"""
WITH {BRAND_MONTH}, g AS (SELECT *, lag(amount) OVER (PARTITION BY brand ORDER BY month) AS p FROM bm),
r AS (SELECT brand, month, (amount::DOUBLE - p::DOUBLE) / p::DOUBLE AS growth,
  row_number() OVER (PARTITION BY month ORDER BY (amount::DOUBLE - p::DOUBLE) / p::DOUBLE DESC, brand) AS place
  FROM g WHERE p > 0)
SELECT brand, {_d('month')} AS month, round(growth, 6) AS growth, place::INTEGER AS place FROM r WHERE place <= 5""")
def bi_top_growth(spark: SparkSession, sf: str) -> DataFrame:
    out = P.top_growth(brand_sales(spark, sf), ["brand"], "month", "amount", 5)
    return out.select("brand", day_text("month").alias("month"), rounded("growth").alias("growth"), "place")


@query("bi_top_share", "B5", f"""
WITH {BRAND_MONTH}, s AS (SELECT brand, month, amount::DOUBLE / (sum(amount) OVER (PARTITION BY month))::DOUBLE AS share FROM bm),
r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY share DESC) AS place FROM s)
SELECT brand, {_d('month')} AS month, round(share, 6) AS share, place::INTEGER AS place FROM r WHERE place <= 3""")
def bi_top_share(spark: SparkSession, sf: str) -> DataFrame:
    out = P.top_share(brand_sales(spark, sf), ["brand"], "month", "amount", 3)
    return out.select("brand", day_text("month").alias("month"), rounded("share").alias("share"), "place")


@query("bi_rank_moves", "B6", f"""
WITH {BRAND_MONTH}, r AS (SELECT brand, month, rank() OVER (PARTITION BY month ORDER BY amount DESC) AS place FROM bm),
m AS (SELECT *, lag(place) OVER (PARTITION BY brand ORDER BY month) - place AS move FROM r)
SELECT brand, count(*) FILTER (WHERE move <> 0) AS n_changes, coalesce(max(move), 0)::INTEGER AS largest_rise,
  count(*) FILTER (WHERE abs(move) > 5) AS n_big_moves, bool_and(place <= 3) AS always_top FROM m GROUP BY brand""")
def bi_rank_moves(spark: SparkSession, sf: str) -> DataFrame:
    return P.rank_summary(brand_sales(spark, sf), ["brand"], "month", "amount")


@query("bi_below_overall_growth", "B7", f"""
WITH {AREA_SALES}, h AS (SELECT nation, sum(CASE WHEN month < DATE '1998-07-01' THEN amount END) AS a,
  sum(CASE WHEN month >= DATE '1998-07-01' THEN amount END) AS b
  FROM area_sales WHERE month >= DATE '1998-01-01' AND month < DATE '1999-01-01' GROUP BY nation),
o AS (SELECT (sum(b)::DOUBLE - sum(a)::DOUBLE) / sum(a)::DOUBLE AS g FROM h)
SELECT nation, a::DOUBLE AS first_sum, b::DOUBLE AS second_sum,
  round((b::DOUBLE - a::DOUBLE) / a::DOUBLE, 6) AS growth, round(g, 6) AS overall_growth
FROM h, o WHERE a > 0 AND (b::DOUBLE - a::DOUBLE) / a::DOUBLE < g""")
def bi_below_overall_growth(spark: SparkSession, sf: str) -> DataFrame:
    out = P.below_overall_growth(area_sales(spark, sf), ["nation"], "day", "amount",
                                 ("1998-01-01", "1998-07-01"), ("1998-07-01", "1999-01-01"))
    return out.select("nation", F.col("first_sum").cast("double").alias("first_sum"),
                      F.col("second_sum").cast("double").alias("second_sum"),
                      rounded("growth").alias("growth"), rounded("overall_growth").alias("overall_growth"))


@query("bi_price_bands", "B8", """
SELECT (CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 1 WHEN p_retailprice < 1050 THEN 2 ELSE 3 END)::INTEGER AS band,
  sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount,
  round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE, 6) AS avg_price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def bi_price_bands(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    facts = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_retailprice", F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"))
    out = P.price_bands(facts, "p_retailprice", (950.0, 1000.0, 1050.0), "qty", "amount")
    return out.select("band", F.col("qty").cast("double").alias("qty"),
                      F.col("amount").cast("double").alias("amount"), rounded("avg_price").alias("avg_price"))


_YEAR_98 = "month >= DATE '1998-01-01' AND month < DATE '1999-01-01'"


def _in_1998(facts: DataFrame) -> DataFrame:
    return facts.filter((F.col("day") >= F.lit("1998-01-01").cast("date"))
                        & (F.col("day") < F.lit("1999-01-01").cast("date")))


@query("bi_price_against_january", "B8", f"""
WITH {BRAND_MONTH}, p AS (SELECT brand, month, amount::DOUBLE / qty::DOUBLE AS price FROM bm WHERE {_YEAR_98}),
b AS (SELECT *, first_value(price) OVER (PARTITION BY brand ORDER BY month) AS base FROM p)
SELECT brand, {_d('month')} AS month, round(price, 6) AS avg_price, round((price - base) / base, 6) AS rise
FROM b WHERE (price - base) / base > 0.05""")
def bi_price_against_january(spark: SparkSession, sf: str) -> DataFrame:
    out = P.price_against_first(_in_1998(brand_sales(spark, sf)), ["brand"], "month", "qty", "amount", 0.05)
    return out.select("brand", day_text("month").alias("month"), rounded("avg_price").alias("avg_price"),
                      rounded("rise").alias("rise"))


@query("bi_dearer_yet_larger", "B9", f"""
WITH {BRAND_SALES}, p AS (SELECT ptype, brand, quarter, sum(qty) AS qty, sum(amount)::DOUBLE / sum(qty)::DOUBLE AS price
  FROM brand_sales GROUP BY ALL)
SELECT a.ptype, a.brand, {_d('a.quarter')} AS quarter, a.qty::DOUBLE AS qty, a.price AS price,
  min(b.qty)::DOUBLE AS least_cheaper
FROM p a JOIN p b ON a.ptype = b.ptype AND a.quarter = b.quarter AND b.price < a.price AND b.qty < a.qty
GROUP BY ALL""")
def bi_dearer_yet_larger(spark: SparkSession, sf: str) -> DataFrame:
    out = P.dearer_yet_larger(brand_sales(spark, sf), ["brand"], ["ptype"], "quarter", "qty", "amount")
    return out.select("ptype", "brand", day_text("quarter").alias("quarter"), F.col("qty").cast("double").alias("qty"),
                      "price", F.col("least_cheaper").cast("double").alias("least_cheaper"))


@query("bi_cut_without_gain", "B9", f"""
WITH {BRAND_MONTH}, p AS (SELECT brand, month, qty, amount::DOUBLE / qty::DOUBLE AS price FROM bm),
l AS (SELECT *, lag(price) OVER w AS pp, lag(qty) OVER w AS pq FROM p WINDOW w AS (PARTITION BY brand ORDER BY month))
SELECT brand, {_d('month')} AS month, qty::DOUBLE AS qty, pq::DOUBLE AS qty_before, round(price, 6) AS avg_price,
  round(pp, 6) AS price_before FROM l WHERE price < pp AND qty <= pq""")
def bi_cut_without_gain(spark: SparkSession, sf: str) -> DataFrame:
    out = P.cut_without_gain(brand_sales(spark, sf), ["brand"], "month", "qty", "amount")
    return out.select("brand", day_text("month").alias("month"), F.col("qty").cast("double").alias("qty"),
                      F.col("qty_before").cast("double").alias("qty_before"),
                      rounded("avg_price").alias("avg_price"), rounded("price_before").alias("price_before"))


@query("bi_volatility", "B10", f"""
WITH {AREA_SALES}, q AS (SELECT nation, quarter, sum(qty)::DOUBLE AS v FROM area_sales
  WHERE month >= DATE '1998-01-01' AND month < DATE '1999-01-01' GROUP BY ALL)
SELECT nation, round(max(v) - min(v), 6) AS spread, round(min(v) / max(v), 6) AS low_high,
  round(stddev_samp(v) / avg(v), 6) AS variation FROM q GROUP BY nation HAVING stddev_samp(v) / avg(v) > 0.05""")
def bi_volatility(spark: SparkSession, sf: str) -> DataFrame:
    out = P.volatility(_in_1998(area_sales(spark, sf)), ["nation"], "quarter", "qty", 0.05)
    return out.select("nation", *[rounded(c).alias(c) for c in ("spread", "low_high", "variation")])


@query("bi_first_reaching", "B11", f"""
WITH {BRAND_MONTH}, h AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY month) AS n FROM bm WHERE qty >= 900)
SELECT brand, {_d('month')} AS month, qty::DOUBLE AS qty FROM h WHERE n = 1""")
def bi_first_reaching(spark: SparkSession, sf: str) -> DataFrame:
    out = P.first_reaching(brand_sales(spark, sf), ["brand"], "month", "qty", 900)
    return out.select("brand", day_text("month").alias("month"), F.col("qty").cast("double").alias("qty"))


@query("bi_first_above_earlier_best", "B11", f"""
WITH {BRAND_MONTH}, b AS (SELECT brand, max(amount) AS best FROM bm WHERE month >= DATE '1998-01-01' AND month < DATE '1998-07-01' GROUP BY brand),
h AS (SELECT bm.brand, month, amount, best, row_number() OVER (PARTITION BY bm.brand ORDER BY month) AS n
  FROM bm JOIN b ON bm.brand = b.brand WHERE month >= DATE '1998-07-01' AND month < DATE '1999-01-01' AND amount > best)
SELECT brand, {_d('month')} AS month, amount::DOUBLE AS amount, best::DOUBLE AS earlier_best FROM h WHERE n = 1""")
def bi_first_above_earlier_best(spark: SparkSession, sf: str) -> DataFrame:
    out = P.first_above_earlier_best(brand_sales(spark, sf), ["brand"], "month", "amount",
                                     ("1998-01-01", "1998-07-01"), ("1998-07-01", "1999-01-01"))
    return out.select("brand", day_text("month").alias("month"), F.col("amount").cast("double").alias("amount"),
                      F.col("earlier_best").cast("double").alias("earlier_best"))


@query("bi_growth_runs", "B12", f"""
WITH {BRAND_MONTH}, u AS (SELECT brand, month, coalesce(amount > lag(amount) OVER w, false) AS up, lead(month) OVER w AS nxt
  FROM bm WINDOW w AS (PARTITION BY brand ORDER BY month)),
r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY brand ORDER BY month) AS run FROM u)
SELECT brand, count(*) AS n_periods, {_d('min(month)')} AS run_start, {_d('max(month)')} AS run_end,
  {_d('last(nxt ORDER BY month)')} AS first_fall FROM r WHERE up GROUP BY brand, run HAVING count(*) >= 3""")
def bi_growth_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = P.growth_runs(brand_sales(spark, sf), ["brand"], "month", "amount", 3)
    return out.select("brand", "n_periods", *[day_text(c).alias(c) for c in ("run_start", "run_end", "first_fall")])


@query("bi_weeks_above_mean", "B13", f"""
WITH {BRAND_SALES}, w AS (SELECT brand, week, sum(qty)::DOUBLE AS v FROM brand_sales
  WHERE week >= DATE '1998-01-01' AND week < DATE '1998-07-01' GROUP BY ALL),
m AS (SELECT brand, avg(v) AS m FROM w WHERE week < DATE '1998-04-01' GROUP BY brand)
SELECT w.brand, round(any_value(m), 6) AS earlier_mean, count(*) FILTER (WHERE week >= DATE '1998-04-01' AND v > m) AS n_above
FROM w LEFT JOIN m ON w.brand = m.brand GROUP BY w.brand""")
def bi_weeks_above_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = P.count_above_earlier_mean(brand_sales(spark, sf), ["brand"], "week", "qty",
                                     ("1998-01-01", "1998-04-01"), ("1998-04-01", "1998-07-01"))
    return out.select("brand", rounded("earlier_mean").alias("earlier_mean"), "n_above")


@query("bi_coverage_gain", "B14", f"""
WITH {AREA_SALES}, c AS (SELECT brand, ptype, week, count(DISTINCT nation)::DOUBLE / (SELECT count(*) FROM nation) AS cov
  FROM area_sales GROUP BY ALL),
g AS (SELECT *, lag(cov) OVER (PARTITION BY brand, ptype ORDER BY week) AS p FROM c),
r AS (SELECT *, (cov - p) / p AS growth, row_number() OVER (PARTITION BY brand, ptype ORDER BY (cov - p) / p DESC, week) AS n FROM g WHERE p > 0)
SELECT brand, ptype, {_d('week')} AS week, round(cov, 6) AS coverage, round(growth, 6) AS growth FROM r WHERE n = 1""")
def bi_coverage_gain(spark: SparkSession, sf: str) -> DataFrame:
    out = P.fastest_coverage_gain(area_sales(spark, sf), ["brand", "ptype"], "week", "nation", table(spark, sf, "nation"))
    return out.select("brand", "ptype", day_text("week").alias("week"), rounded("coverage").alias("coverage"),
                      rounded("growth").alias("growth"))


@query("bi_share_high_and_rising", "B15", f"""
WITH {AREA_SALES}, s AS (SELECT nation, ptype,
  sum(CASE WHEN month >= DATE '1998-04-01' AND month < DATE '1998-07-01' THEN qty ELSE 0 END) AS q2,
  sum(CASE WHEN month >= DATE '1998-07-01' AND month < DATE '1998-10-01' THEN qty ELSE 0 END) AS q3
  FROM area_sales WHERE month >= DATE '1998-04-01' AND month < DATE '1998-10-01' GROUP BY ALL),
t AS (SELECT *, q2::DOUBLE / (sum(q2) OVER (PARTITION BY nation))::DOUBLE AS a, q3::DOUBLE / (sum(q3) OVER (PARTITION BY nation))::DOUBLE AS b FROM s)
SELECT nation, ptype, round(a, 6) AS share_before, round(b, 6) AS share_now FROM t WHERE b > 0.2 AND b > a""")
def bi_share_high_and_rising(spark: SparkSession, sf: str) -> DataFrame:
    out = P.share_high_and_rising(area_sales(spark, sf), ["ptype"], ["nation"], "day", "qty",
                                  ("1998-04-01", "1998-07-01"), ("1998-07-01", "1998-10-01"), 0.2)
    return out.select("nation", "ptype", rounded("share_before").alias("share_before"),
                      rounded("share_now").alias("share_now"))


@query("bi_double_growth", "B16", f"""
WITH {BRAND_QUARTER}, p AS (SELECT brand, quarter, qty, amount::DOUBLE / qty::DOUBLE AS price FROM bq),
b AS (SELECT *, coalesce(qty > lag(qty) OVER w AND price > lag(price) OVER w, false) AS up FROM p WINDOW w AS (PARTITION BY brand ORDER BY quarter)),
t AS (SELECT *, up AND lag(up, 1, false) OVER (PARTITION BY brand ORDER BY quarter) AS twice FROM b)
SELECT brand, {_d('quarter')} AS quarter, qty::DOUBLE AS qty, round(price, 6) AS avg_price FROM t WHERE twice""")
def bi_double_growth(spark: SparkSession, sf: str) -> DataFrame:
    out = P.double_growth(brand_sales(spark, sf), ["brand"], "quarter", "qty", "amount")
    return out.select("brand", day_text("quarter").alias("quarter"), F.col("qty").cast("double").alias("qty"),
                      rounded("avg_price").alias("avg_price"))


@query("bi_distinct_share_above_mean", "B17", """
WITH s AS (SELECT n_name AS nation, count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey END) AS n_hit,
  count(DISTINCT o_custkey) AS n_members FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name HAVING count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey END) >= 5),
t AS (SELECT *, n_hit / n_members AS share FROM s), m AS (SELECT avg(share) AS mean FROM t)
SELECT nation, n_hit, n_members, round(share, 6) AS share, round(mean, 6) AS mean_share, round(share - mean, 6) AS diff
FROM t, m WHERE share - mean > 0""")
def bi_distinct_share_above_mean(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = table(spark, sf, "orders").select("o_custkey").join(
        customer, F.col("o_custkey") == F.col("c_custkey"))
    out = P.distinct_share_above_mean(facts, ["nation"], "o_custkey", F.col("c_mktsegment") == "BUILDING", 5)
    return out.select("nation", "n_hit", "n_members", rounded("share").alias("share"),
                      rounded("mean_share").alias("mean_share"), rounded("diff").alias("diff"))


@query("bi_local_mean_above_overall", "B18", f"""
WITH {AREA_SALES}, c AS (SELECT region, brand, nation, sum(qty)::DOUBLE AS v FROM area_sales GROUP BY ALL),
l AS (SELECT region, brand, sum(v) / count(*) AS lm FROM c GROUP BY ALL), o AS (SELECT brand, sum(v) / count(*) AS om FROM c GROUP BY brand)
SELECT region, l.brand, round(lm, 4) AS local_mean, round(om, 4) AS overall_mean, round(lm - om, 4) AS diff
FROM l JOIN o ON l.brand = o.brand WHERE lm - om > 0""")
def bi_local_mean_above_overall(spark: SparkSession, sf: str) -> DataFrame:
    out = P.local_mean_above_overall(area_sales(spark, sf), ["nation"], ["region"], ["brand"], F.col("qty"))
    return out.select("region", "brand", *[rounded(c, 4).alias(c) for c in ("local_mean", "overall_mean", "diff")])


@query("bi_trailing_days", "B19", """
SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events
WHERE ts::DATE BETWEEN DATE '2024-01-16' - 15 AND DATE '2024-01-16' - 1 GROUP BY event_type""")
def bi_trailing_days(spark: SparkSession, sf: str) -> DataFrame:
    recent = P.trailing_days(table(spark, sf, "events"), "ts", "2024-01-16", 15)
    users = recent.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return users.groupBy("event_type").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_users"))


@query("bi_best_and_worst", "B20", f"""
WITH {BRAND_QUARTER}, r AS (SELECT brand, quarter, qty, rank() OVER (PARTITION BY brand ORDER BY qty DESC) AS t,
  rank() OVER (PARTITION BY brand ORDER BY qty) AS b, row_number() OVER (PARTITION BY brand ORDER BY qty DESC, quarter) AS pt,
  row_number() OVER (PARTITION BY brand ORDER BY qty, quarter) AS pb FROM bq)
SELECT brand, 'best' AS kind, {_d('quarter')} AS quarter, qty::DOUBLE AS qty, pt = 1 AS picked FROM r WHERE t = 1
UNION ALL SELECT brand, 'worst', {_d('quarter')}, qty::DOUBLE, pb = 1 FROM r WHERE b = 1""")
def bi_best_and_worst(spark: SparkSession, sf: str) -> DataFrame:
    out = P.best_and_worst(brand_sales(spark, sf), ["brand"], "quarter", "qty")
    return out.select("brand", "kind", day_text("quarter").alias("quarter"),
                      F.col("qty").cast("double").alias("qty"), "picked")
