"""Sizes, keys, texts, gates and checks of single rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import pricing as px
from ..functions import text as tt
from ..functions import timeaxis as tx
from ..operators import selection
from ..sources import tables as tb
from .base import query
from .edge import SWAPS, with_swaps


@query("F05_live_loss_day", f"SELECT o_orderkey, {tb.loss_day_sql('(o_orderdate + to_seconds(o_custkey * 37))')} AS day FROM orders")
def f05(spark, sf):
    o = tb.read(spark, sf, "orders")
    now = F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_custkey * 37)")
    return o.select("o_orderkey", tx.day_number(tx.loss_day(now)).alias("day"))


@query("F10_risk_quantity", "SELECT p_partkey, CASE WHEN raw >= 0.1 THEN floor(raw / 0.1 + 0.5) * 0.1 END AS quantity FROM (SELECT p_partkey, 250.0::DOUBLE / (p_retailprice * p_size / 100) AS raw FROM part)", "quantity")
def f10(spark, sf):
    return tb.read(spark, sf, "part").select("p_partkey", px.risk_quantity(F.lit(250.0), F.col("p_retailprice") * F.col("p_size") / 100, 0.1).alias("quantity"))


ORDERS_SQL = """o0 AS (SELECT p_partkey, p_retailprice AS price, p_partkey % 2 = 0 AS is_long, p_retailprice * (p_size / 10.0::DOUBLE) / 100 AS distance, p_size % 3 AS kind FROM part),
o1 AS (SELECT *, distance / 0.01::DOUBLE * 0.1::DOUBLE AS lot_loss FROM o0),
o2 AS (SELECT *, floor(200.0::DOUBLE / lot_loss / 0.01::DOUBLE + 1e-9::DOUBLE) * 0.01::DOUBLE AS v0 FROM o1),
o3 AS (SELECT *, CASE WHEN v0 >= 0.05 THEN least(v0, 2.0::DOUBLE) ELSE 0.0 END AS v, CASE kind WHEN 0 THEN 1.144::DOUBLE WHEN 2 THEN 0.9::DOUBLE END AS factor FROM o2),
o4 AS (SELECT *, CASE WHEN factor IS NULL THEN v ELSE least(floor(v * (200.0::DOUBLE / (v * lot_loss * factor)) / 0.01::DOUBLE) * 0.01::DOUBLE, 2.0::DOUBLE) END AS a FROM o3 WHERE v > 0),
o5 AS (SELECT *, CASE WHEN factor IS NULL OR a * lot_loss * factor <= 200 THEN a WHEN round(a - 0.01, 8) * lot_loss * factor <= 200 THEN round(a - 0.01, 8) WHEN round(a - 0.02, 8) * lot_loss * factor <= 200 THEN round(a - 0.02, 8) END AS volume FROM o4),
o6 AS (SELECT p_partkey, volume, volume * lot_loss * coalesce(factor, 1) AS risk, round(CASE WHEN is_long THEN price - distance ELSE price + distance END, 5) AS sl FROM o5 WHERE volume >= 0.05 OR factor IS NULL)"""


@query("F12_size_order", "SELECT * FROM o6", "volume risk sl", ORDERS_SQL)
def f12(spark, sf):
    price, pct = F.col("p_retailprice"), F.col("p_size") / 10
    lot_loss = price * pct / 100 / 0.01 * 0.1
    factor = F.when(F.col("p_size") % 3 == 0, F.lit(1.144)).when(F.col("p_size") % 3 == 2, F.lit(0.9))
    order = px.entry_order(price, F.col("p_partkey") % 2 == 0, pct, F.lit(2.5), F.lit(200.0), F.lit(0.01), F.lit(0.1), 0.05, 0.01, 2.0, 5, lambda v: v * lot_loss * factor)
    return tb.read(spark, sf, "part").select("p_partkey", order.alias("o")).where("o IS NOT NULL").select("p_partkey", "o.volume", "o.risk", "o.sl")


@query("F13_position_risk", "SELECT k1, k2, k3, k4, 0.1::DOUBLE * ((CASE WHEN k2 = 3 THEN entry ELSE entry * sl_pct / 100 END) / 0.01::DOUBLE) * 0.5::DOUBLE AS risk FROM trades", "risk", tb.TRADES)
def f13(spark, sf):
    stop = F.when(F.col("k2") != 3, px.stop_price(F.col("entry"), F.col("is_long"), F.col("sl_pct")))
    return tb.trades(spark, sf).select("k1", "k2", "k3", "k4", px.position_risk(F.lit(0.1), F.col("entry"), stop, F.lit(0.01), F.lit(0.5)).alias("risk"))


@query("F17_close_events", "SELECT market, ts_closed, count(*) AS n, sum(r + swap_r) AS value FROM swaps GROUP BY 1, 2", "value", f"{tb.TRADES},\n{SWAPS}")
def f17(spark, sf):
    """Net R at each closing time, trades that close together added up."""
    return with_swaps(spark, sf).groupBy("market", "ts_closed").agg(F.count("*").alias("n"), F.sum(F.col("r") + F.col("swap_r")).alias("value"))


@query("F19_combo_key", "SELECT DISTINCT 'brand=' || p_brand || ',size=' || p_size || ',type=' || p_type AS combo FROM part")
def f19(spark, sf):
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return tb.read(spark, sf, "part").select(tt.combo_key(m).alias("combo")).distinct()


@query("F21_money", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer", "amount")
def f21(spark, sf):
    said = F.concat(F.lit("  "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("  EUR"))
    return tb.read(spark, sf, "customer").select("c_custkey", px.money(said).cast("double").alias("amount"))


@query("F22_entry_side", "SELECT l_returnflag, l_returnflag <> 'R' AS is_long, count(*) AS n FROM lineitem GROUP BY 1, 2")
def f22(spark, sf):
    side = F.when(F.col("l_returnflag") != "R", F.lit(" buy ")).otherwise(F.lit("Sell"))
    return tb.read(spark, sf, "lineitem").groupBy("l_returnflag", px.is_long(side).alias("is_long")).agg(F.count("*").alias("n"))


@query("F23_decimal_text", "SELECT o_orderkey, CASE WHEN contains(s, '.') THEN rtrim(rtrim(s, '0'), '.') ELSE s END AS amount FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS s FROM orders)")
def f23(spark, sf):
    return tb.read(spark, sf, "orders").select("o_orderkey", tt.decimal_text(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


@query("F25_redacted", "SELECT c_custkey, replace(replace('bot ' || c_custkey || ':AA' || c_mktsegment || ' of ' || c_name || ' failed', c_custkey || ':AA' || c_mktsegment, '***'), CAST(c_custkey AS VARCHAR), '***') AS message FROM customer")
def f25(spark, sf):
    token = F.concat(F.col("c_custkey").cast("string"), F.lit(":AA"), F.col("c_mktsegment"))
    said = F.concat(F.lit("bot "), token, F.lit(" of "), F.col("c_name"), F.lit(" failed"))
    return tb.read(spark, sf, "customer").select("c_custkey", tt.redacted(said, token).alias("message"))


@query("F27_daily_threshold", "SELECT market, 0.10::DOUBLE * count(*) / count(DISTINCT day) AS threshold FROM trades GROUP BY 1", "threshold", tb.TRADES)
def f27(spark, sf):
    x = tb.trades(spark, sf).groupBy("market").agg(F.count("*").alias("n"), F.countDistinct("day").alias("d"))
    return x.select("market", px.daily_threshold(F.col("n"), F.col("d")).cast("double").alias("threshold"))


@query("F28_anniversary", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 18 MONTH AS DATE) AS futility, CAST(o_orderdate + INTERVAL 30 MONTH AS DATE) AS efficacy FROM orders")
def f28(spark, sf):
    return tb.read(spark, sf, "orders").select("o_orderkey", tx.anniversary(F.col("o_orderdate"), 18).alias("futility"), tx.anniversary(F.col("o_orderdate"), 30).alias("efficacy"))


@query("F29_loss_share", "SELECT c_custkey, c_acctbal <= 0 AS unlimited, CASE WHEN c_acctbal > 0 THEN greatest(0, c_acctbal - 3000) / c_acctbal END AS share FROM customer", "share")
def f29(spark, sf):
    s = px.loss_share(F.col("c_acctbal"), F.lit(3000.0))
    endless = s == float("inf")
    return tb.read(spark, sf, "customer").select("c_custkey", endless.alias("unlimited"), F.when(~endless, s).alias("share"))


@query("F32_epoch_ns", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def f32(spark, sf):
    return tb.read(spark, sf, "events").select("event_id", tx.epoch_nanoseconds(F.col("ts")).alias("ns"))


@query("V01_closed_positions", "SELECT k1, k2, k3, k4, ts_closed FROM (SELECT * REPLACE (CASE WHEN is_long OR k2 < 5 THEN ts_closed END AS ts_closed) FROM trades) WHERE ts_closed >= TIMESTAMP '1996-01-01'", ctes=tb.TRADES)
def v01(spark, sf):
    t = tb.trades(spark, sf).withColumn("ts_closed", F.when(F.col("is_long") | (F.col("k2") < 5), F.col("ts_closed")))
    return selection.closed_positions(t, dt.datetime(1996, 1, 1)).select("k1", "k2", "k3", "k4", "ts_closed")


@query("V06_decimal_gates", "SELECT l_discount, CAST(l_discount AS DECIMAL(18,6)) <= 0.05 AS spa_ok, count(*) AS n FROM lineitem GROUP BY 1, 2", "l_discount")
def v06(spark, sf):
    return tb.read(spark, sf, "lineitem").groupBy("l_discount", selection.at_most(F.col("l_discount")).alias("spa_ok")).agg(F.count("*").alias("n"))


CHECKED = f"{tb.TRADES},\nch AS (SELECT market, count(*) AS n, sum(r) AS total, min(r) AS worst, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit, count(DISTINCT day) AS days FROM trades GROUP BY 1)"


def checked(spark, sf):
    return tb.trades(spark, sf).groupBy("market").agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.min("r").alias("worst"), F.avg((F.col("r") > 0).cast("double")).alias("hit"), F.countDistinct("day").alias("days"))


@query(
    "V14_verdict",
    "SELECT market, [x FOR x IN [CASE WHEN n < 30 THEN 'trades' END, CASE WHEN NOT (round(total, 6) > 0) THEN 'return' END, CASE WHEN worst < -2.4 THEN 'tail' END, CASE WHEN days < 10 THEN 'days' END, CASE WHEN hit < 0.45 THEN 'hit rate' END] IF x IS NOT NULL] AS failed, n >= 30 AND round(total, 6) > 0 AND worst >= -2.4 AND days >= 10 AND hit >= 0.45 AS passed FROM ch",
    ctes=CHECKED,
)
def v14(spark, sf):
    checks = [("trades", F.col("n") >= 30), ("return", F.round("total", 6) > 0), ("tail", F.col("worst") >= -2.4), ("days", F.col("days") >= 10), ("hit rate", F.col("hit") >= 0.45)]
    return selection.verdict(checked(spark, sf), checks).select("market", "failed", "passed")


@query("V15_gated", "SELECT instrument, variation, train_months, mean_oos > 0 AND pct_profitable >= 45 AND oos_trades >= 10 AND NOT (train_months = 36) AS ok FROM study", ctes=tb.STUDY)
def v15(spark, sf):
    gates = [F.col("mean_oos") > 0, F.col("pct_profitable") >= 45, F.col("oos_trades") >= 10]
    return tb.study(spark, sf).select("instrument", "variation", "train_months", selection.gated(gates, F.col("train_months") == 36).alias("ok"))


@query("V17_must_flatten", "SELECT o_orderkey, equity <= least(100000.0, high - 5000.0) OR equity <= day_start * (1 - 0.025::DOUBLE) AS flatten FROM (SELECT o_orderkey, 95000.0::DOUBLE + o_totalprice / 50 AS equity, 98000.0::DOUBLE + o_custkey AS day_start, 101000.0::DOUBLE + o_custkey AS high FROM orders)")
def v17(spark, sf):
    o = tb.read(spark, sf, "orders")
    return o.select("o_orderkey", selection.must_flatten(95000.0 + F.col("o_totalprice") / 50, 98000.0 + F.col("o_custkey"), 101000.0 + F.col("o_custkey"), 100_000.0).alias("flatten"))


@query(
    "V20_pinned_params",
    "SELECT p_brand, key, count(DISTINCT value) AS values, min(value) AS least, max(value) AS most FROM (SELECT p_brand, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, 'maker', left(p_brand, 7) FROM part UNION ALL SELECT p_brand, 'type', p_type FROM part) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1 AND key <> 'type'",
)
def v20(spark, sf):
    params = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("size", F.col("p_size").cast("string")), ("maker", F.substring("p_brand", 1, 7)), ("type", F.col("p_type")))))
    x = tb.read(spark, sf, "part").select("p_brand", F.explode(params).alias("p")).select("p_brand", "p.key", "p.value")
    return selection.disagreeing(x, ["p_brand"], "key", "value", ("type",))


@query("J02_renamed", "SELECT p_partkey, coalesce(n_name, p_brand) AS market FROM part LEFT JOIN (SELECT 'Brand#' || (n_nationkey + 10) AS old, n_name FROM nation) ON p_brand = old")
def j02(spark, sf):
    names = tb.read(spark, sf, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("old"), F.col("n_name").alias("new"))
    return selection.renamed(tb.read(spark, sf, "part"), F.broadcast(names), "p_brand", "old", "new").select("p_partkey", "market")  # 25 nations


@query("O08_first_windows", "SELECT ordinal, test_start, trades FROM held ORDER BY ordinal LIMIT 5", ctes=tb.WINDOW_TRADES)
def o08(spark, sf):
    """A run may be limited to its first windows: the limit is the feature."""
    return tb.window_trades(spark, sf).orderBy("ordinal").limit(5).select("ordinal", "test_start", "trades")


@query("O12_uncovered", "SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def o12(spark, sf):
    good = tb.read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return selection.uncovered(tb.read(spark, sf, "lineitem"), good, ["l_suppkey"])


@query("A35_trial_budget", "SELECT v AS variations, t AS lengths, g AS combos, v * t * g + 5 AS trials FROM (SELECT count(DISTINCT variation) AS v, count(DISTINCT train_months) AS t, count(DISTINCT instrument) AS g FROM study)", ctes=tb.STUDY)
def a35(spark, sf):
    return selection.trial_budget(tb.study(spark, sf).withColumn("combo", F.col("instrument")))
