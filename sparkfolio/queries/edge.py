"""Trades: loss days, edge and risk statistics, curves, attribution, swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as px
from ..functions import timeaxis as tx
from ..operators import bundles, curves, scans, stats
from ..sources import tables as tb
from .base import query

ORDER = ["ts_closed", "ts_opened", "k1", "k2", "k3", "k4", "r"]
O = ", ".join(ORDER)
START = 100_000.0
RISK = tb.BASE_RISK
DAILY, TRAILING = 0.03, 0.06
#: Days of a market that one task takes.
WIDTH = 180


@query(
    "flagship_market_risk",
    f"""SELECT market, n, total_r, worst_day_r, worst_day, max_dd FROM
 (SELECT market, count(*) AS n, sum(r) AS total_r FROM trades GROUP BY 1)
 JOIN (SELECT market, min(s) AS worst_day_r, arg_min(day, (s, day)) AS worst_day FROM (SELECT market, day, round(sum(r), 6) AS s FROM trades GROUP BY 1, 2) GROUP BY 1) USING (market)
 JOIN (SELECT market, max((peak - eq) / peak) AS max_dd FROM (SELECT market, eq, greatest({START}, max(eq) OVER w) AS peak FROM
  (SELECT market, {O}, {START} + sum(r * {RISK} * {START}) OVER (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS eq FROM trades)
  WINDOW w AS (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING)) GROUP BY 1) USING (market)""",
    "total_r worst_day_r max_dd",
    tb.TRADES,
)
def flagship(spark, sf):
    t = tb.trades(spark, sf)
    total = t.groupBy("market").agg(F.count("*").alias("n"), F.sum("r").alias("total_r"))
    x = t.withColumn("pnl", F.col("r") * RISK * START)
    dd = scans.deepest(x, ["market"], ORDER, scans.cut_by(x, ORDER[0], WIDTH), "pnl", START)
    return total.join(stats.worst_day(t, ["market"]), "market").join(dd, "market").select("market", "n", "total_r", "worst_day_r", "worst_day", "max_dd")


@query("F01_loss_day", f"SELECT event_id, {tb.loss_day_sql('ts')} AS day FROM events")
def f01(spark, sf):
    return tb.read(spark, sf, "events").select("event_id", tx.day_number(tx.loss_day(F.col("ts"))).alias("day"))


@query("F02_bar_loss_day", f"SELECT market, ts, {tb.loss_day_sql('(ts + INTERVAL 4 HOUR)')} AS day FROM bars", ctes=tb.BARS)
def f02(spark, sf):
    return tb.bars(spark, sf).select("market", "ts", tx.day_number(tx.bar_loss_day(F.col("ts"))).alias("day"))


@query("F03_calendar_day", "SELECT event_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS day FROM events")
def f03(spark, sf):
    return tb.read(spark, sf, "events").select("event_id", tx.calendar_day(F.col("ts")).alias("day"))


@query(
    "F04_overlapped_loss_days",
    f"SELECT k1, k2, k3, k4, CAST(unnest(range({tb.loss_day_sql('ts_opened')}::BIGINT, {tb.loss_day_sql('(ts_closed - INTERVAL 1 MICROSECOND)')}::BIGINT + 1)) AS INTEGER) AS day FROM trades WHERE ts_closed > ts_opened",
    ctes=tb.TRADES,
)
def f04(spark, sf):
    t = tb.trades(spark, sf)
    return t.select("k1", "k2", "k3", "k4", F.explode(tx.overlapped_loss_days(F.col("ts_opened"), F.col("ts_closed"))).alias("d")).select("k1", "k2", "k3", "k4", tx.day_number(F.col("d")).alias("day"))


NIGHTS = """CAST((SELECT count(*) FILTER (WHERE isodow(d) <= 5) + 2 * count(*) FILTER (WHERE isodow(d) = 3) FROM (SELECT unnest(generate_series(
 CAST((ts_opened AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS DATE), CAST((ts_closed AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS DATE) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)) AS INTEGER)"""


@query("F07_night_units", f"SELECT k1, k2, k3, k4, {NIGHTS} AS nights FROM trades", ctes=tb.TRADES)
def f07(spark, sf):
    return tb.trades(spark, sf).select("k1", "k2", "k3", "k4", tx.night_units(F.col("ts_opened"), F.col("ts_closed"), F.lit(2)).alias("nights"))


SWAPS = """specs AS (SELECT DISTINCT market, CASE WHEN ascii(right(market, 1)) % 2 = 0 THEN 'POINTS' ELSE 'INTEREST' END AS mode, -1.5::DOUBLE AS swap_long, 0.5::DOUBLE AS swap_short FROM trades),
swapped AS (SELECT t.*, CASE WHEN is_long THEN swap_long ELSE swap_short END AS rate, mode, @NIGHTS AS nights FROM trades t JOIN specs USING (market)),
swaps AS (SELECT *, CASE WHEN mode = 'POINTS' THEN rate * 1.0 ELSE entry * rate / 100 / 360 * 1.0 / 0.01 END * nights / (entry * sl_pct / 100 / 0.01 * 1.0) AS swap_r FROM swapped)""".replace("@NIGHTS", NIGHTS)


def with_swaps(spark, sf):
    t = tb.trades(spark, sf)
    specs = t.select("market").distinct().select("market", F.when(F.ascii(F.substring("market", -1, 1)) % 2 == 0, "POINTS").otherwise("INTEREST").alias("mode"), F.lit(-1.5).alias("swap_long"), F.lit(0.5).alias("swap_short"))
    x = t.join(specs, "market", "left")
    one, tick = F.lit(1.0), F.lit(0.01)
    night = px.swap_per_lot_night(F.col("mode"), F.when(F.col("is_long"), F.col("swap_long")).otherwise(F.col("swap_short")), F.col("entry"), one, tick)
    nights = tx.night_units(F.col("ts_opened"), F.col("ts_closed"), F.lit(2))
    return x.withColumn("swap_r", F.coalesce(px.swap_r(night, nights, px.loss_per_lot(F.col("entry"), F.col("sl_pct"), one, tick)), F.lit(0.0)))


@query("F08_swap_r", "SELECT k1, k2, k3, k4, swap_r, r + swap_r AS net_r FROM swaps", "swap_r net_r", f"{tb.TRADES},\n{SWAPS}")
def f08(spark, sf):
    return with_swaps(spark, sf).select("k1", "k2", "k3", "k4", "swap_r", (F.col("r") + F.col("swap_r")).alias("net_r"))


@query(
    "F09_exit_prices",
    "SELECT k1, k2, k3, k4, entry * (1 - CASE WHEN is_long THEN 1 ELSE -1 END * sl_pct / 100) AS stop, entry * (1 + CASE WHEN is_long THEN 1 ELSE -1 END * 2.5 / 100) AS target FROM trades",
    "stop target",
    tb.TRADES,
    digits=6,
)
def f09(spark, sf):
    e, s = F.col("entry"), F.col("is_long")
    return tb.trades(spark, sf).select("k1", "k2", "k3", "k4", px.stop_price(e, s, F.col("sl_pct")).alias("stop"), px.target_price(e, s, F.lit(2.5)).alias("target"))


@query(
    "F11_lots",
    "SELECT p_partkey, CASE WHEN p_retailprice > 0 AND v >= 0.05 THEN least(v, 2.0) ELSE 0.0 END AS lots FROM (SELECT *, floor(100.0 / (p_retailprice * p_size / 100 / 0.01 * 0.1) / 0.01 + 1e-9) * 0.01 AS v FROM part)",
    "lots",
)
def f11(spark, sf):
    d = F.col("p_retailprice") * F.col("p_size") / 100
    return tb.read(spark, sf, "part").select("p_partkey", px.lots(F.lit(100.0), d, F.lit(0.01), F.lit(0.1), 0.05, 0.01, 2.0).alias("lots"))


@query("F15_flat_pnl", f"SELECT market, sum(r * {RISK} * {START}) AS pnl, sum(r * {RISK}) AS account_return FROM trades GROUP BY 1", "pnl account_return", tb.TRADES)
def f15(spark, sf):
    return tb.trades(spark, sf).groupBy("market").agg(F.sum(F.col("r") * RISK * START).alias("pnl"), F.sum(F.col("r") * RISK).alias("account_return"))


@query("F18_window_label", "SELECT ordinal, strftime(test_start, '%Y-%m') || '..' || strftime(test_end, '%Y-%m') AS label, trades FROM held", ctes=tb.WINDOW_TRADES)
def f18(spark, sf):
    return tb.window_trades(spark, sf).select("ordinal", tx.window_label(F.col("test_start"), F.col("test_end")).alias("label"), "trades")


@query("F20_candidate_id", "SELECT candidate, count(*) AS n FROM candidates GROUP BY 1", ctes=tb.CANDIDATES)
def f20(spark, sf):
    return tb.candidates(spark, sf).groupBy("candidate").agg(F.count("*").alias("n"))


@query("F43_throttle", f"SELECT o_orderkey, 2.0 * greatest(0.15, 1 - least(o_totalprice / 500000, 1.0)) AS size FROM orders", "size")
def f43(spark, sf):
    return tb.read(spark, sf, "orders").select("o_orderkey", px.throttle(2.0, F.least(F.col("o_totalprice") / 500000, F.lit(1.0))).alias("size"))


EDGE = """SELECT market, count(r) AS n, count(*) FILTER (r > 0) / count(r) AS hit_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r < 0), 0) AS avg_loss, avg(r) AS expectancy,
 avg(r) FILTER (r > 0) / -avg(r) FILTER (r < 0) AS payoff, CASE WHEN sum(r) FILTER (r < 0) < 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) ELSE 'infinity'::DOUBLE END AS profit_factor FROM trades GROUP BY 1"""


@query("A01_edge_stats", EDGE, "hit_rate avg_win avg_loss expectancy payoff profit_factor", tb.TRADES)
def a01(spark, sf):
    return stats.edge_stats(tb.trades(spark, sf), ["market"], "r")


DAILY_EQUITY = f"""days AS (SELECT market, day, sum(r) AS s FROM trades GROUP BY 1, 2), curve AS (SELECT market, day, {START} + sum(s * {RISK} * {START}) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM days)"""


def daily_equity(spark, sf):
    d = stats.daily_sum(tb.trades(spark, sf), ["market"], "day", "r").withColumn("pnl", F.col("total") * RISK * START)
    return curves.running_sum(d, ["market"], ["day"], "pnl", "equity", START).select("market", "day", "equity")


@query(
    "A03_risk_stats",
    f"""SELECT market, greatest((max(day) - min(day)) / 365.25, 1e-9) AS years, arg_max(equity, day) / {START} - 1 AS total_return, (arg_max(equity, day) / {START} - 1) / greatest((max(day) - min(day)) / 365.25, 1e-9) AS annual_return,
 max((peak - equity) / peak) AS max_dd, coalesce(avg(step) / nullif(stddev_samp(step), 0) * sqrt(252.0), 0) AS sharpe FROM
 (SELECT *, max(equity) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak, (equity - lag(equity) OVER (PARTITION BY market ORDER BY day)) / {START} AS step FROM curve) GROUP BY 1""",
    "years total_return annual_return max_dd sharpe",
    f"{tb.TRADES},\n{DAILY_EQUITY}",
)
def a03(spark, sf):
    return stats.risk_stats(daily_equity(spark, sf), ["market"], START)


@query("A09_attribution", f"""SELECT market, n, total_r, hit, avg_r, total_r * {RISK} * 100 AS return_pct, total_r * 100 / nullif(sum(total_r) OVER (), 0) AS share_pct FROM
 (SELECT market, count(*) AS n, sum(r) AS total_r, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(r) AS avg_r FROM trades GROUP BY 1)""", "total_r hit avg_r return_pct share_pct", tb.TRADES)  # fmt: skip
def a09(spark, sf):
    return stats.attribution(tb.trades(spark, sf), "market", "r", RISK)


@query(
    "A10_per_year",
    f"""SELECT market, year, last / coalesce(lag(last) OVER (PARTITION BY market ORDER BY year), first) - 1 AS ret FROM
 (SELECT market, CAST(year(DATE '1970-01-01' + day) AS INTEGER) AS year, arg_max(equity, day) AS last, arg_min(equity, day) AS first FROM curve GROUP BY 1, 2)""",
    "ret",
    f"{tb.TRADES},\n{DAILY_EQUITY}",
)
def a10(spark, sf):
    return stats.compound_by_year(daily_equity(spark, sf).withColumn("day", F.date_from_unix_date("day")), ["market"])


@query("A14_A15_worst", "SELECT * FROM (SELECT market, min(s) AS worst_day_r, arg_min(day, (s, day)) AS worst_day FROM (SELECT market, day, round(sum(r), 6) AS s FROM trades GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT market, min(r) AS worst_trade_r FROM trades GROUP BY 1) USING (market)", "worst_day_r worst_trade_r", tb.TRADES)
def a15(spark, sf):
    t = tb.trades(spark, sf)
    return stats.worst_day(t, ["market"]).join(stats.worst_trade(t, ["market"]), "market")


@query(
    "A16_tail_cap",
    f"SELECT market, least({DAILY}, {TRAILING}) / (1.5 * abs(least(worst_day_r, worst_trade_r))) AS tail_cap FROM (SELECT market, min(s) AS worst_day_r FROM (SELECT market, day, round(sum(r), 6) AS s FROM trades GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT market, min(r) AS worst_trade_r FROM trades GROUP BY 1) USING (market)",
    "tail_cap",
    tb.TRADES,
)
def a16(spark, sf):
    return stats.tail_cap(tb.trades(spark, sf), ["market"], 1.5, DAILY, TRAILING).select("market", "tail_cap")


@query("A17_modal_stop", "SELECT market, min(modal) AS modal FROM (SELECT market, round(sl_pct, 6) AS modal, count(*) AS n, max(count(*)) OVER (PARTITION BY market) AS most FROM trades GROUP BY 1, 2) WHERE n = most GROUP BY 1", "modal", tb.TRADES)
def a17(spark, sf):
    return stats.modal(tb.trades(spark, sf).withColumn("s", F.round("sl_pct", 6)), ["market"], "s")


@query("A18_upper_median", "SELECT p_brand AS market, list_sort(list(DISTINCT p_size))[count(DISTINCT p_size) // 2 + 1] AS median FROM part GROUP BY 1")
def a18(spark, sf):
    return stats.upper_median(tb.read(spark, sf, "part").withColumnRenamed("p_brand", "market"), ["market"], "p_size")


CALMAR = f"""SELECT market, n, CASE WHEN n >= 10 THEN total / {START} / greatest(dd, 1e-6) ELSE '-infinity'::DOUBLE END AS score FROM (SELECT market, count(*) AS n, sum(pnl) AS total, max((peak - equity) / peak) AS dd FROM
 (SELECT *, greatest({START}, max(equity) OVER (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING)) AS peak FROM (SELECT *, {START} + sum(pnl) OVER (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS equity
 FROM (SELECT *, r * {RISK} * {START} AS pnl FROM trades))) GROUP BY 1)"""


@query("A25_calmar", CALMAR, "score", tb.TRADES)
def a25(spark, sf):
    return stats.calmar(tb.trades(spark, sf).withColumn("pnl", F.col("r") * RISK * START), ["market"], ORDER, "pnl", START, width=WIDTH)


@query("A26_sharpe", "SELECT market, count(r) AS n, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) AS sharpe FROM trades GROUP BY 1", "sharpe", tb.TRADES)
def a26(spark, sf):
    return stats.sharpe(tb.trades(spark, sf), ["market"], "r")


@query(
    "A27_moments",
    "SELECT market, count(*) AS n, avg(((r - m) / s) ^ 3) AS skew, avg(((r - m) / s) ^ 4) AS kurt FROM trades JOIN (SELECT market, avg(r) AS m, stddev_samp(r) AS s FROM trades GROUP BY 1) USING (market) GROUP BY 1",
    "skew kurt",
    tb.TRADES,
)
def a27(spark, sf):
    return stats.moments(tb.trades(spark, sf), ["market"], "r")


@query("A33_percentiles", "SELECT market, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95 FROM trades GROUP BY 1", "p05 p50 p95", tb.TRADES)
def a33(spark, sf):
    return stats.percentiles(tb.trades(spark, sf), ["market"], "r", [0.05, 0.5, 0.95])


@query("R23_nearest_rank", "SELECT market, quantile_disc(r, 0.05) AS p05, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.95) AS p95 FROM trades GROUP BY 1", "p05 p50 p95", tb.TRADES)
def r23(spark, sf):
    return stats.percentiles(tb.trades(spark, sf), ["market"], "r", [0.05, 0.5, 0.95], nearest=True)


@query(
    "A34_swap_impact",
    """SELECT market, sum(r) AS gross, sum(swap_r) AS swap, count(*) FILTER (is_long) AS longs, count(*) FILTER (NOT is_long) AS shorts, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS pf_gross,
 sum(r + swap_r) FILTER (r + swap_r > 0) / -sum(r + swap_r) FILTER (r + swap_r < 0) AS pf_net FROM swaps GROUP BY 1""",
    "gross swap pf_gross pf_net",
    f"{tb.TRADES},\n{SWAPS}",
)
def a34(spark, sf):
    return stats.swap_impact(with_swaps(spark, sf), ["market"])


@query(
    "O14_expected_shortfall",
    "SELECT market, avg(r) AS shortfall, max(n) AS n FROM (SELECT market, r, row_number() OVER (PARTITION BY market ORDER BY r) AS k, count(*) OVER (PARTITION BY market) AS n FROM trades) WHERE k <= ceil(n * 0.05) GROUP BY 1",
    "shortfall",
    tb.TRADES,
)
def o14(spark, sf):
    return stats.expected_shortfall(tb.trades(spark, sf), ["market"], "r")


@query(
    "T06_equity_curve",
    f"SELECT market, CAST(0 AS INTEGER) AS step, {START} AS equity FROM trades GROUP BY 1 UNION ALL SELECT market, CAST(row_number() OVER (PARTITION BY market ORDER BY {O}) AS INTEGER), {START} + sum(r * {RISK} * {START}) OVER (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING) FROM trades",
    "equity",
    tb.TRADES,
)
def t06(spark, sf):
    return curves.equity_curve(tb.trades(spark, sf).withColumn("pnl", F.col("r") * RISK * START), ["market"], ORDER, "pnl", START, WIDTH)


@query("T07_max_drawdown", f"SELECT market, max((peak - equity) / peak) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM curve) GROUP BY 1", "max_drawdown", f"{tb.TRADES},\n{DAILY_EQUITY}")
def t07(spark, sf):
    return curves.max_drawdown(daily_equity(spark, sf), ["market"], ["day"], width=WIDTH)


FLOOR = f"(SELECT *, least({START}, greatest({START}, max(equity) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING)) - 0.06 * {START}) AS floor FROM curve)"


@query("T08_trailing_floor", f"SELECT market, day, equity, floor FROM {FLOOR}", "equity floor", f"{tb.TRADES},\n{DAILY_EQUITY}")
def t08(spark, sf):
    return curves.trailing_floor(daily_equity(spark, sf), ["market"], ["day"], "equity", START, 0.06)


@query(
    "T09_trailing_check",
    f"SELECT market, bool_or(equity - floor <= 0) AS breached, min(equity - floor) AS min_margin, min(day) FILTER (equity - floor <= 0) AS first_breach FROM {FLOOR} GROUP BY 1",
    "min_margin",
    f"{tb.TRADES},\n{DAILY_EQUITY}",
)
def t09(spark, sf):
    return curves.trailing_check(daily_equity(spark, sf), ["market"], "day", "equity", "equity", START, 0.06)


@query(
    "T10_daily_breach",
    f"SELECT market, day, loss, loss > 0.01 AS breach FROM (SELECT market, day, (b - equity) / b AS loss FROM (SELECT *, lag(equity, 1, {START}) OVER (PARTITION BY market ORDER BY day) AS b FROM curve))",
    "loss",
    f"{tb.TRADES},\n{DAILY_EQUITY}",
)
def t10(spark, sf):
    return curves.daily_breach(daily_equity(spark, sf), ["market"], "day", "equity", START, 0.01).select("market", "day", "loss", "breach")


@query("T18_cumulative_r", f"SELECT market, k1, k2, k3, k4, sum(r) OVER (PARTITION BY market ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS cum_r FROM trades", "cum_r", tb.TRADES)
def t18(spark, sf):
    return curves.running_sum(tb.trades(spark, sf), ["market"], ORDER, "r", "cum_r", width=WIDTH).select("market", "k1", "k2", "k3", "k4", "cum_r")


@query("T21_r_fixed", f"SELECT k1, k2, k3, k4, pnl / (0.01 * {START}) AS r_multiple FROM (SELECT *, r * {RISK} * {START} AS pnl FROM trades)", "r_multiple", tb.TRADES)
def t21(spark, sf):
    t = tb.trades(spark, sf).withColumn("pnl", F.col("r") * RISK * START)
    return curves.assign_r(t, ["market"], ORDER, "pnl", START, 0.01, True).select("k1", "k2", "k3", "k4", "r_multiple")


@query(
    "T22_r_walked",
    f"SELECT k1, k2, k3, k4, pnl / (0.01 * ({START} + coalesce(sum(pnl) OVER (PARTITION BY market ORDER BY {O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS r_multiple FROM (SELECT *, r * {RISK} * {START} AS pnl FROM trades)",
    "r_multiple",
    tb.TRADES,
)
def t22(spark, sf):
    t = tb.trades(spark, sf).withColumn("pnl", F.col("r") * RISK * START)
    return curves.assign_r(t, ["market"], ORDER, "pnl", START, 0.01, False, WIDTH).select("k1", "k2", "k3", "k4", "r_multiple")


@query("T23_drawdown_series", "SELECT market, day, equity / max(equity) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve", "drawdown", f"{tb.TRADES},\n{DAILY_EQUITY}")
def t23(spark, sf):
    return curves.drawdown_series(daily_equity(spark, sf), ["market"], ["day"], width=WIDTH).select("market", "day", "drawdown")


@query("R17_day_bundles")
def r17(spark, sf):
    """Each market's trades resampled 1000 times in runs of five days, whose trades stay together, and one by one."""
    t = tb.trades(spark, sf).withColumn("pnl", F.col("r") * RISK * START)
    s = bundles.packed(t, ["market"], "day", ORDER, "pnl")
    ends = bundles.resampled(s, ["market"], START, 1000).withColumn("draw", F.lit("days")).unionByName(bundles.resampled(s, ["market"], START, 1000, None).withColumn("draw", F.lit("trades")))
    return bundles.summary(ends, ["market", "draw"], START)


NET = """SELECT {key}, count(net) AS n, count(*) FILTER (net > 0) / count(net) AS hit_rate, coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net < 0), 0) AS avg_loss, avg(net) AS expectancy,
 avg(net) FILTER (net > 0) / -avg(net) FILTER (net < 0) AS payoff, CASE WHEN sum(net) FILTER (net < 0) < 0 THEN coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) ELSE 'infinity'::DOUBLE END AS profit_factor FROM (SELECT market, r + swap_r AS net FROM swaps)"""


@query(
    "S16_reference",
    f"{NET.format(key='market, false AS overall')} GROUP BY market UNION ALL {NET.format(key='NULL, true')}",
    "hit_rate avg_win avg_loss expectancy payoff profit_factor",
    f"{tb.TRADES},\n{SWAPS}",
)
def s16(spark, sf):
    """The edge of all trades and of each market's, net of swaps."""
    return stats.reference(with_swaps(spark, sf), "market")
