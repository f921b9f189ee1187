"""Accounts, scenario days, resampled paths and what is monitored."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from ..functions import pricing as px
from ..operators import accounts, curves, intraday, joins, ledger, monitoring, pathrisk, paths, selection, stats
from ..sources import tables as tb
from .base import query
from .books import LED, TRIPS, deals
from .market import B, DAILY, EVENTS, daily, ev

START = 100_000.0

#: Positions of the accounts of events' users, by the user's last digit; prices of every day that one is held.
HELD = f"""{DAILY},\n{EVENTS},
pos AS (SELECT 'a' || right(CAST(user_id AS VARCHAR), 1) AS account, event_id AS id, e.event_type AS market, v.day AS od, CAST(v.day + event_id % 5 AS INTEGER) AS cd, e.value - 50 AS pnl, -(event_id % 3)::DOUBLE AS swap, e.value AS entry, e.value + 1 + event_id % 7 AS exit FROM events e JOIN ev v USING (event_id)),
span AS (SELECT CAST(unnest(range(min(od), max(cd) + 1)) AS INTEGER) AS day FROM pos),
price AS (SELECT market, day, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
 FROM (SELECT DISTINCT market FROM daily) CROSS JOIN span LEFT JOIN daily USING (market, day)),
days AS (SELECT account, CAST(unnest(range(min(od), max(cd) + 1)) AS INTEGER) AS day FROM pos GROUP BY 1),
held AS (SELECT account, p.day, sum(pnl / CASE WHEN abs(exit - entry) < 1e-12 THEN 1.0 ELSE exit - entry END * (close - entry)) AS floating FROM pos o JOIN price p ON o.market = p.market AND p.day >= od AND p.day < cd GROUP BY 1, 2),
booked AS (SELECT account, cd AS day, sum(pnl + swap) AS s, sum(swap) AS swap, count(*) AS trades FROM pos GROUP BY 1, 2),
flat AS (SELECT account, day, balance - coalesce(s, 0) AS opening, balance, balance + coalesce(floating, 0) AS equity, coalesce(b.swap, 0) AS swap, coalesce(b.trades, 0) AS trades FROM
 (SELECT account, day, s, b.swap, b.trades, floating, {START} + sum(coalesce(s, 0)) OVER (PARTITION BY account ORDER BY day ROWS UNBOUNDED PRECEDING) AS balance FROM days LEFT JOIN booked b USING (account, day) LEFT JOIN held USING (account, day)) b),
diag AS (SELECT *, least(opening, balance, equity) AS minimum FROM flat)"""


def positions(spark, sf):
    user = tb.read(spark, sf, "events").select("event_id", F.concat(F.lit("a"), F.substring(F.col("user_id").cast("string"), -1, 1)).alias("account"))
    key, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    return ev(spark, sf).join(user, "event_id").select(
        "account", key.alias("id"), "market", F.col("day").alias("od"), (F.col("day") + key % 5).cast("int").alias("cd"), at.alias("ts_opened"), (at + (key % 5) * 86_400_000_000 + 1).alias("ts_closed"),
        (F.col("value") - 50).alias("pnl"), (-(key % 3)).cast("double").alias("swap"), F.col("value").alias("entry"), (F.col("value") + 1 + key % 7).alias("exit"),
    )


def prices(spark, sf):
    """Every day from the first open to the last close, for the few markets of the daily closes."""
    d = daily(spark, sf)
    grid = positions(spark, sf).groupBy("market").agg(F.min("od").alias("a"), F.max("cd").alias("b")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    grid = joins.grid(d.select("market").distinct(), grid).select("market", F.explode(F.sequence("a", "b")).alias("day"))
    return curves.align(d, grid, ["market"], "close").select("market", "day", "close")


def flat(spark, sf):
    return accounts.flat(positions(spark, sf), prices(spark, sf), START)


def diagnosed(spark, sf):
    return flat(spark, sf).withColumn("minimum", F.least("opening", "balance", "equity"))


def scenarios(spark, sf):
    return accounts.scenario_days(diagnosed(spark, sf), positions(spark, sf), START)


@query("T13_daily_equity", "SELECT account, day, equity FROM flat", "equity", HELD)
def t13(spark, sf):
    return flat(spark, sf).select("account", "day", "equity")


@query("T42_flat_account", "SELECT account, day, opening, balance, equity FROM flat", "opening balance equity", HELD)
def t42(spark, sf):
    """The general simulation at size 1, so that SQL can say the same."""
    x = accounts.simulate(positions(spark, sf), prices(spark, sf), START, 0.06, lambda used: 1.0)
    return x.where("id IS NULL").select("account", "day", "opening", "balance", "equity")


@query("T42_throttled_account")
def t42_throttled(spark, sf):
    """Sizes fall with what is used of the budget, never under 0.15, and follow equity."""
    return accounts.simulate(positions(spark, sf), prices(spark, sf), START, 0.06, lambda used: max(0.15, 1 - used), compound=True)


DIAGNOSED = f"""{HELD},
checked AS (SELECT account, day, opening, minimum, CASE WHEN opening > 0 THEN greatest(0, opening - minimum) / opening END AS daily_loss, least({START}, greatest({START}, max(balance) OVER (PARTITION BY account ORDER BY day ROWS UNBOUNDED PRECEDING)) - 0.06::DOUBLE * {START}) AS floor,
 greatest(0, opening - minimum) > 0.03::DOUBLE * opening AS daily_breach FROM diag)"""


@query("T45_diagnostics", "SELECT account, day, opening, minimum, daily_loss, floor, daily_breach, minimum <= floor AS trailing_breach FROM checked", "opening minimum daily_loss floor", DIAGNOSED)
def t45(spark, sf):
    x = accounts.diagnostics(diagnosed(spark, sf), START, 0.06, 0.03)
    return x.select("account", "day", "opening", "minimum", F.when(F.col("opening") > 0, F.col("daily_loss")).alias("daily_loss"), "floor", "daily_breach", "trailing_breach")


def watched(spark, sf):
    """The accounts' days with the least equity that bars within them allow. Positions of odd ids are long; those of a
    microsecond lie in the bar of their own event."""
    b = tb.bars(spark, sf).select("market", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "low", "high", "close")
    t = positions(spark, sf).withColumn("is_long", F.col("id") % 2 == 1).withColumn("size", F.lit(1.0))
    return intraday.minima(t, b, flat(spark, sf), START)


@query("T44_intraday_minima")
def t44(spark, sf):
    return watched(spark, sf).drop("balance")


@query("T45_intraday_diagnostics")
def t45_intraday(spark, sf):
    """Losses, floors and breaches by the least equity within each day."""
    x = accounts.diagnostics(watched(spark, sf), START, 0.06, 0.03)
    return x.select("account", "day", "opening", "minimum", F.when(F.col("opening") > 0, F.col("daily_loss")).alias("daily_loss"), "floor", "daily_breach", "trailing_breach")


SCENARIOS = f"""{HELD},
scen AS (SELECT account, day, opening, balance - lag(balance, 1, {START}) OVER w AS balance_change, equity - lag(equity, 1, {START}) OVER w AS equity_change, minimum - opening AS to_minimum, trades, swap FROM diag WINDOW w AS (PARTITION BY account ORDER BY day))"""


@query("T19_scenario_days", "SELECT account, day, opening, balance_change - swap AS price_pnl, equity_change, to_minimum, balance_change, trades, swap FROM scen", "opening price_pnl equity_change to_minimum balance_change swap", SCENARIOS)
def t19(spark, sf):
    return scenarios(spark, sf)


@query(
    "V07_scenario_accounts",
    f"SELECT account, count(*) AS days, count(*) FILTER (abs(opening - before) > 1e-6 OR abs(price_pnl + swap - balance_change) > 1e-6) AS broken FROM (SELECT *, balance_change - swap AS price_pnl, lag(opening + balance_change, 1, {START}) OVER (PARTITION BY account ORDER BY day) AS before FROM scen) GROUP BY 1",
    ctes=SCENARIOS,
)
def v07(spark, sf):
    """Days of each account and how many break the accounting; a tolerance for sums of doubles."""
    s = scenarios(spark, sf)
    bad = accounts.discontinuous(s, START, 1e-6).groupBy("account").agg(F.count("*").alias("broken"))
    return s.groupBy("account").agg(F.count("*").alias("days")).join(bad, "account", "left").fillna({"broken": 0})


@query("A13_annual_money", f"SELECT account, (arg_max(equity, day) - {START}) / {START} / greatest((max(day) - min(day)) / 365.25, 1e-9) * 100 AS annual_pct FROM flat GROUP BY 1", "annual_pct", HELD)
def a13(spark, sf):
    return accounts.annualised(flat(spark, sf), START, False)


@query(
    "A12_edge_character",
    f"SELECT account, sharpe, hold FROM (SELECT account, coalesce(avg(step) / nullif(stddev_samp(step), 0) * sqrt(252.0), 0) AS sharpe FROM (SELECT account, (equity - lag(equity) OVER (PARTITION BY account ORDER BY day)) / {START} AS step FROM flat) GROUP BY 1) JOIN (SELECT account, avg(cd - od) AS hold FROM pos GROUP BY 1) USING (account)",
    "sharpe hold",
    HELD,

)
def a12(spark, sf):
    """Yearly Sharpe of an account's daily equity and the mean days held."""
    s = stats.risk_stats(flat(spark, sf), ["account"], START).select("account", "sharpe")
    return s.join(positions(spark, sf).groupBy("account").agg(F.avg(F.col("cd") - F.col("od")).alias("hold")), "account")


def choices(spark, sf):
    return pathrisk.chosen(pathrisk.packed(scenarios(spark, sf), ["account"]))


@query("R02_block_choices")
def r02(spark, sf):
    """Block lengths of every account; an estimate beyond a tenth of its days is refused with a reason."""
    return choices(spark, sf).select("account", F.col("n").alias("days"), "label", "block", "reason")


@query("R19_scenario_paths")
def r19(spark, sf):
    """Of 10,000 paths for every account and block length, by source day: how often it was drawn and in how many paths."""
    return pathrisk.drawn_days(choices(spark, sf), ["account"])


JOINT = f"""{SCENARIOS},
joint_days AS (SELECT account, count(*) AS n FROM scen GROUP BY 1)"""


@query("V10_joint_rows", "SELECT account, 10000 * n AS day_rows, n AS source_days, 0::BIGINT AS foreign_rows FROM joint_days", ctes=JOINT)
def v10(spark, sf):
    """Every account's 10,000 paths of blocks of 5 days as rows: how many there are, of how many different source days,
    and how many are no source day with all its values."""
    days = scenarios(spark, sf)
    p = pathrisk.sampled(days, ["account"], 5)
    bad = pathrisk.foreign(days, p, ["account"]).groupBy("account").agg(F.sum("times").alias("foreign_rows"))
    x = p.groupBy("account").agg(F.count("*").alias("day_rows"), F.countDistinct("day").alias("source_days"))
    return x.join(bad, "account", "left").fillna({"foreign_rows": 0})


@query("R21_profit_chance")
def r21(spark, sf):
    x = pathrisk.replays(choices(spark, sf), ["account"], START)
    return x.groupBy("account", "label").agg(F.avg((F.col("growth") > 1).cast("double")).alias("p_profit"), F.count("*").alias("paths"))


@query("R22_R25_path_risk")
def r25(spark, sf):
    """Every account and block length, on days with the least equity that bars within them allow."""
    return pathrisk.path_risk(accounts.scenario_days(watched(spark, sf), positions(spark, sf), START), ["account"], START)


@query("R18_expectation_band")
def r18(spark, sf):
    return paths.expectation_band(tb.trades(spark, sf), "r", 100)


@query("R27_R28_forward_test")
def r28(spark, sf):
    """Bounds of mean daily R of all trades and the state of a forward test over them."""
    t = tb.trades(spark, sf).groupBy("day").agg(F.sum(F.col("r").cast("decimal(18,6)")).cast("decimal(28,6)").alias("r"), F.count("*").alias("n"))
    values = [Decimal(v) for v in paths.daily_values(t, "day", "r")]
    x = t.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum("n").alias("n")).first()
    day = lambda d: dt.date(1970, 1, 1) + dt.timedelta(d)
    b = paths.mean_bounds(spark, values, 10, paths.EFFICACY[2])
    state = paths.forward_state(spark, values, day(x["a"]), day(x["b"]), x["n"], 10)
    return spark.createDataFrame([(len(values), x["n"], float(b["mean"]), float(b["lower"]), float(b["upper"]), state)], "days long, trades long, mean double, lower double, upper double, state string")


@query("A41_forward_mean", "SELECT market, avg(CAST(r AS DOUBLE)) AS mean, count(*) AS days FROM (SELECT market, day, sum(r) AS r FROM trades GROUP BY 1, 2) GROUP BY 1", "mean", tb.TRADES)
def a41(spark, sf):
    d = tb.trades(spark, sf).groupBy("market", "day").agg(F.sum(F.col("r").cast("decimal(18,6)")).alias("r"))
    return d.groupBy("market").agg(F.avg("r").cast("double").alias("mean"), F.count("*").alias("days"))


@query(
    "A36_open_risk",
    "SELECT p_type, coalesce(sum(CASE WHEN p_size % 7 <> 0 THEN p_retailprice * p_size END), 0.0) AS total, coalesce(list_sort(list(p_brand) FILTER (p_size % 7 = 0)), []) AS unpriceable, count(*) FILTER (p_size % 7 = 0) = 0 AS known FROM part GROUP BY 1",
    "total",
)
def a36(spark, sf):
    """Positions are parts; a size that is a multiple of seven stands for a market without a price."""
    risk = F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") * F.col("p_size"))
    return monitoring.open_risk(tb.read(spark, sf, "part").select("p_type", F.col("p_brand").alias("market"), risk.alias("risk")), ["p_type"])


@query("T17_history_window", "SELECT account, CAST(600000 - coalesce(sum(amount) FILTER (time >= 1704672000), 0) AS DOUBLE) AS entering, count(*) FILTER (time >= 1704672000) AS shown, count(*) FILTER (time < 1704672000) AS hidden FROM (SELECT 'all' AS account, * FROM led) GROUP BY 1", "entering", LED)
def t17(spark, sf):
    x = monitoring.history_window(ledger.ledger(deals(spark, sf)), 1_704_672_000, 600_000.0)
    return x.withColumn("entering", F.col("entering").cast("double"))


LIVE = "live AS (SELECT market, CASE WHEN ticks % 7 = 0 THEN ts + INTERVAL 1 HOUR WHEN ticks % 11 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS ts, close * (1 + (ticks % 5) / 10000.0::DOUBLE) AS close FROM bars)"


@query(
    "J11_A39_parity",
    """SELECT market, overlap, matched, close_diff_max, matched / overlap AS match_rate, coalesce(modal, 0.0) AS modal_offset_hours FROM (SELECT l.market, count(*) AS overlap, count(b.ts) AS matched, coalesce(max(abs(l.close - b.close) / b.close), 0.0) AS close_diff_max FROM live l JOIN (SELECT market, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1) USING (market) LEFT JOIN bars b ON b.market = l.market AND b.ts = l.ts WHERE l.ts BETWEEN a AND z GROUP BY 1)
 LEFT JOIN (SELECT market, arg_min(h, (-n, h)) AS modal FROM (SELECT l.market, round(d / 3.6e9, 6) AS h, count(*) AS n FROM (SELECT l.market, l.ts, min(abs(epoch_us(l.ts) - epoch_us(b.ts))) AS d FROM live l JOIN bars b USING (market) JOIN (SELECT market, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1) USING (market) WHERE l.ts BETWEEN a AND z GROUP BY 1, 2) l WHERE d > 0 GROUP BY 1, 2) GROUP BY 1) USING (market)""",
    "close_diff_max match_rate modal_offset_hours",
    f"{B},\n{LIVE}",
)
def j11(spark, sf):
    """Live bars are the bars with some clocks an hour off and closes a little higher."""
    b = tb.bars(spark, sf)
    hour = F.expr("INTERVAL '1' HOUR")
    ts = F.when(F.col("ticks") % 7 == 0, F.col("ts") + hour).when(F.col("ticks") % 11 == 0, F.col("ts") - hour).otherwise(F.col("ts"))
    live = b.select("market", ts.alias("ts"), (F.col("close") * (1 + (F.col("ticks") % 5) / 10000)).alias("close"))
    return monitoring.parity(live, b.select("market", "ts", "close"), ["market"])


CELLS = f"""{tb.CANDIDATES},
cells AS (SELECT train_months, variation, n_regionkey AS instrument, year(ts_closed) AS label, sum(r) AS value, -min(r) AS drawdown FROM candidates JOIN supplier ON k4 = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""


def cells(spark, sf):
    """Yearly sums of R of each variation on each region's suppliers."""
    s = tb.read(spark, sf, "supplier").join(F.broadcast(tb.read(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    x = tb.candidates(spark, sf).join(s.select(F.col("s_suppkey").alias("k4"), F.col("n_regionkey").alias("instrument")), "k4")
    return x.groupBy("train_months", "variation", "instrument", F.year("ts_closed").alias("label")).agg(F.sum("r").alias("value"), (-F.min("r")).alias("drawdown"))


def streams(spark, sf):
    return monitoring.candidate_streams(cells(spark, sf).withColumnRenamed("variation", "candidate"))


@query("A23_task_metrics", "SELECT train_months, variation, instrument, mean_oos, pct_profitable, mean_dd, windows, mean_oos / greatest(mean_dd, 0.005) AS return_per_dd FROM (SELECT train_months, variation, instrument, avg(value) AS mean_oos, avg(CASE WHEN round(value, 6) > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_profitable, avg(drawdown) AS mean_dd, count(*) AS windows FROM cells GROUP BY 1, 2, 3)", "mean_oos pct_profitable mean_dd return_per_dd", CELLS)
def a23(spark, sf):
    return monitoring.task_metrics(cells(spark, sf).withColumn("oos", F.round("value", 6)), ["train_months", "variation", "instrument"])


@query(
    "A22_candidate_streams",
    """SELECT train_months, variation AS candidate, label, avg(value) AS value FROM kept SEMI JOIN whole USING (train_months, label) GROUP BY 1, 2, 3""",
    "value",
    f"""{CELLS},
kept AS (SELECT c.* FROM cells c JOIN (SELECT train_months, instrument FROM cells GROUP BY 1, 2 HAVING count(DISTINCT variation) = (SELECT count(DISTINCT variation) FROM cells c2 WHERE c2.train_months = cells.train_months)) USING (train_months, instrument)),
whole0 AS (SELECT train_months, label FROM kept k GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT (variation, instrument)) FROM kept k2 WHERE k2.train_months = k.train_months)),
whole AS (SELECT * FROM whole0 WHERE train_months IN (SELECT train_months FROM whole0 GROUP BY 1 HAVING count(*) >= 2))""",
)
def a22(spark, sf):
    return streams(spark, sf)


@query("R16_candidate_pbo")
def r16(spark, sf):
    return monitoring.worst_pbo(streams(spark, sf), [18, 24, 36])


@query("A37_variant_ranking", "SELECT variation, avg(return_per_dd) AS mean, count(*) AS instruments FROM study WHERE train_months = 24 GROUP BY 1", "mean", tb.STUDY)
def a37(spark, sf):
    return monitoring.variant_ranking(tb.study(spark, sf), 24, "return_per_dd")


@query(
    "A38_live_against_backtest",
    "SELECT * FROM (SELECT market, count(*) AS live_n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS live_hit, avg(r) AS live_mean FROM trades WHERE ts_closed >= TIMESTAMP '1997-01-01' GROUP BY 1) LEFT JOIN (SELECT market, count(*) AS test_n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS test_hit, avg(r) AS test_mean FROM trades WHERE ts_closed < TIMESTAMP '1997-01-01' GROUP BY 1) USING (market)",
    "live_hit live_mean test_hit test_mean",
    tb.TRADES,
)
def a38(spark, sf):
    t, since = tb.trades(spark, sf), F.lit(dt.datetime(1997, 1, 1))
    return monitoring.live_against_backtest(t.where(F.col("ts_closed") >= since), t.where(F.col("ts_closed") < since))


@query(
    "A40_result_rows",
    "SELECT candidate, count(*) AS trades, sum(r) AS pnl, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, avg(r) / nullif(stddev_samp(r), 0) AS sharpe FROM candidates GROUP BY 1",
    "pnl profit_factor sharpe",
    tb.CANDIDATES,
)
def a40(spark, sf):
    c = tb.candidates(spark, sf)
    x = c.groupBy("candidate").agg(F.count("*").alias("trades"), F.sum("r").alias("pnl"), px.ratio(F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))).alias("profit_factor"))
    return x.join(stats.sharpe(c, ["candidate"], "r").select("candidate", "sharpe"), "candidate")
