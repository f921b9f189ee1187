"""Bars, indicators, regimes, joins on time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as tx
from ..operators import curves, indicators, joins, runners, signals, stats
from ..sources import tables as tb
from .base import query

B = tb.BARS
DAILY = f"{B},\ndaily AS (SELECT market, {tb.loss_day_sql('(ts + INTERVAL 4 HOUR)')} AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)"


#: Days of a market that one task takes.
WIDTH = 7


def daily(spark, sf):
    return curves.daily_close(tb.bars(spark, sf).withColumn("day", tx.day_number(tx.bar_loss_day(F.col("ts")))), ["market"])


@query("L10_bars", "SELECT market, ts, open, high, low, close, ticks FROM bars", "open high low close", B)
def l10(spark, sf):
    return tb.bars(spark, sf)


@query("S07_span", "SELECT market, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars FROM bars GROUP BY 1", ctes=B)
def s07(spark, sf):
    return tb.bars(spark, sf).groupBy("market").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"))


@query("S09_daily_close", "SELECT market, day, close FROM daily", "close", DAILY)
def s09(spark, sf):
    return daily(spark, sf)


@query("V02_closed_bars", "SELECT market, count(*) AS closed, max(ts) AS last_ts FROM bars WHERE ts + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-15 10:30:00' GROUP BY 1", ctes=B)
def v02(spark, sf):
    x = tb.bars(spark, sf).where(F.col("ts") + F.expr("INTERVAL '4' HOUR") <= F.lit("2024-01-15 10:30:00").cast("timestamp_ntz"))
    return x.groupBy("market").agg(F.count("*").alias("closed"), F.max("ts").alias("last_ts"))


@query("T24_new_last_bar", "SELECT market, max(ts) AS ts, arg_max(close, ts) AS close FROM bars WHERE ts + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-15 10:30:00' GROUP BY 1", "close", B)
def t24(spark, sf):
    return indicators.new_last_bar(tb.bars(spark, sf), ["market"], F.lit("2024-01-15 10:30:00").cast("timestamp_ntz")).select("market", "ts", "close")


@query(
    "V09_bar_checks",
    "SELECT market, count(*) FILTER (NOT (low <= close AND close <= high)) AS bad_range, count(*) FILTER (ts <= before) AS out_of_order, count(*) FILTER (ts - before <> INTERVAL 4 HOUR) AS gaps FROM (SELECT *, lag(ts) OVER (PARTITION BY market ORDER BY ts) AS before FROM bars) GROUP BY 1",
    ctes=B,
)
def v09(spark, sf):
    from pyspark.sql import Window

    x = tb.bars(spark, sf).withColumn("before", F.lag("ts").over(Window.partitionBy("market").orderBy("ts")))
    return x.groupBy("market").agg(
        F.count_if(~((F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high")))).alias("bad_range"), F.count_if(F.col("ts") <= F.col("before")).alias("out_of_order"),
        F.count_if(F.col("ts") - F.col("before") != F.expr("INTERVAL '4' HOUR")).alias("gaps"),
    )


@query(
    "T01_williams_r",
    """SELECT market, ts, CASE WHEN n >= 14 AND hh > ll THEN 100 * (close - hh) / (hh - ll) ELSE 0 END AS wpr FROM (SELECT *, max(high) OVER w AS hh, min(low) OVER w AS ll, row_number() OVER (PARTITION BY market ORDER BY ts) AS n
 FROM bars WINDOW w AS (PARTITION BY market ORDER BY ts ROWS 13 PRECEDING))""",
    "wpr",
    B,
)
def t01(spark, sf):
    return indicators.williams_r(tb.bars(spark, sf), ["market"], 14, WIDTH).select("market", "ts", "wpr")


@query(
    "T02_bollinger",
    """SELECT market, ts, CASE WHEN n = 20 THEN m END AS mid, CASE WHEN n = 20 THEN m - 2 * d END AS lower, CASE WHEN n = 20 THEN m + 2 * d END AS upper FROM (SELECT *, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS d
 FROM bars WINDOW w AS (PARTITION BY market ORDER BY ts ROWS 19 PRECEDING))""",
    "mid lower upper",
    B,
)
def t02(spark, sf):
    return indicators.bollinger(tb.bars(spark, sf), ["market"], 20, 2.0, WIDTH).select("market", "ts", "mid", "lower", "upper")


VOL = """vols AS (SELECT market, day, close, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS vol FROM (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY market ORDER BY day)) AS r FROM daily) WINDOW w AS (PARTITION BY market ORDER BY day ROWS 4 PRECEDING)),
ers AS (SELECT market, day, abs(close - c5) / nullif(CASE WHEN count(step) OVER w = 5 THEN sum(step) OVER w END, 0) AS er FROM (SELECT *, abs(close - lag(close) OVER v) AS step, lag(close, 5) OVER v AS c5 FROM daily WINDOW v AS (PARTITION BY market ORDER BY day)) WINDOW w AS (PARTITION BY market ORDER BY day ROWS 4 PRECEDING)),
quant AS (SELECT market, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.66) AS hi FROM vols GROUP BY 1),
regimes AS (SELECT market, day, CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'mid' WHEN vol IS NOT NULL THEN 'high' END AS regime FROM vols JOIN quant USING (market))"""


@query("T03_realized_vol", "SELECT market, day, vol FROM vols", "vol", f"{DAILY},\n{VOL}")
def t03(spark, sf):
    return indicators.realized_vol(daily(spark, sf), ["market"], 5).select("market", "day", "vol")


@query("T04_efficiency_ratio", "SELECT market, day, er FROM ers", "er", f"{DAILY},\n{VOL}")
def t04(spark, sf):
    return indicators.efficiency_ratio(daily(spark, sf), ["market"], 5).select("market", "day", "er")


def regimes(spark, sf):
    return indicators.terciles(indicators.realized_vol(daily(spark, sf), ["market"], 5), ["market"], "vol", ("low", "mid", "high"), "regime").select("market", "day", "regime")


@query("T05_terciles", "SELECT market, day, regime FROM regimes", ctes=f"{DAILY},\n{VOL}")
def t05(spark, sf):
    return regimes(spark, sf)


EVENTS = f"ev AS (SELECT event_id, event_type AS market, ts, value, {tb.loss_day_sql('ts')} AS day FROM events)"


def ev(spark, sf):
    return tb.read(spark, sf, "events").select("event_id", F.col("event_type").alias("market"), "ts", "value", tx.day_number(tx.loss_day(F.col("ts"))).alias("day"))


@query("J07_regime_at_open", "SELECT event_id, regime FROM ev ASOF LEFT JOIN regimes USING (market, day)", ctes=f"{DAILY},\n{VOL},\n{EVENTS}")
def j07(spark, sf):
    return joins.asof(ev(spark, sf), regimes(spark, sf), ["market"], "day", ["regime"], width=WIDTH).select("event_id", "regime")


@query(
    "A11_regime_edge",
    "SELECT regime, count(*) AS n, avg(value) AS expectancy, sum(value) AS total, count(*) / sum(count(*)) OVER () AS share FROM ev ASOF JOIN regimes USING (market, day) WHERE regime IS NOT NULL GROUP BY 1",
    "expectancy total share",
    f"{DAILY},\n{VOL},\n{EVENTS}",
)
def a11(spark, sf):
    x = joins.asof(ev(spark, sf), regimes(spark, sf), ["market"], "day", ["regime"]).where("regime IS NOT NULL")
    g = x.groupBy("regime").agg(F.count("*").alias("n"), F.avg("value").alias("expectancy"), F.sum("value").alias("total"))
    from pyspark.sql import Window

    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


@query(
    "J06_asof_bar",
    "SELECT e.event_id, b.ts AS bar_ts, b.close AS bar_close FROM ev e ASOF LEFT JOIN bars b ON e.market = b.market AND e.ts >= b.ts",
    "bar_close",
    f"{B},\n{EVENTS}",
)
def j06(spark, sf):
    b = tb.bars(spark, sf).select("market", "ts", F.col("ts").alias("bar_ts"), F.col("close").alias("bar_close"))
    return joins.asof(ev(spark, sf), b, ["market"], "ts", ["bar_ts", "bar_close"], width=WIDTH).select("event_id", "bar_ts", "bar_close")


@query(
    "J08_asof_strict",
    "SELECT e.event_id, b.ts AS bar_ts FROM ev e ASOF LEFT JOIN bars b ON e.market = b.market AND e.ts > b.ts",
    ctes=f"{B},\n{EVENTS}",
)
def j08(spark, sf):
    b = tb.bars(spark, sf).select("market", "ts", F.col("ts").alias("bar_ts"))
    return joins.asof(ev(spark, sf), b, ["market"], "ts", ["bar_ts"], strict=True, width=WIDTH).select("event_id", "bar_ts")


SECS = f"""a AS (SELECT market, k1, k2, k3, k4, CAST(epoch(ts_opened) AS BIGINT) AS s, CAST(epoch(ts_closed) AS BIGINT) AS e FROM trades),
b AS (SELECT p_brand AS market, p_partkey, 820454400 + p_partkey * 86400 AS bs, 820454400 + p_partkey * 86400 + p_size * 86400 AS be FROM part)"""


@query("J09_interval_overlap", "SELECT k1, k2, k3, k4, p_partkey FROM a JOIN b ON a.market = b.market AND s < be AND bs < e", ctes=f"{tb.TRADES},\n{SECS}")
def j09(spark, sf):
    a = tb.trades(spark, sf).select("market", "k1", "k2", "k3", "k4", F.unix_seconds(tx.as_utc(F.col("ts_opened"))).alias("s"), F.unix_seconds(tx.as_utc(F.col("ts_closed"))).alias("e"))
    p = tb.read(spark, sf, "part")
    start = F.lit(820454400).cast("long") + F.col("p_partkey") * 86400
    b = p.select(F.col("p_brand").alias("market"), "p_partkey", start.alias("bs"), (start + F.col("p_size") * 86400).alias("be"))
    return joins.overlap(a, b, ["market"], "s", "e", "bs", "be", 7 * 86400).select("k1", "k2", "k3", "k4", "p_partkey")


@query(
    "J10_window_member",
    f"SELECT k1, k2, k3, k4, label FROM (SELECT * FROM trades ASOF JOIN (SELECT test_start AS ts_closed, ordinal AS label, max(test_end) OVER () AS until FROM windows) USING (ts_closed)) WHERE ts_closed <= until",
    ctes=f"{tb.TRADES},\n{tb.WINDOWS}",
)
def j10(spark, sf):
    w = tb.windows(spark).select("test_start", "test_end", F.col("ordinal").alias("label"))
    return joins.member(tb.trades(spark, sf), w, [], "ts_closed", "test_start", "test_end", "label").select("k1", "k2", "k3", "k4", "label")


@query(
    "J12_nearest",
    """SELECT event_id, CASE WHEN hi IS NOT NULL AND (lo IS NULL OR hi - sec < sec - lo) THEN hi ELSE lo END AS nearest FROM (SELECT e.event_id, e.sec, l.sec AS lo, h.sec AS hi FROM x e
 ASOF LEFT JOIN y l ON e.market = l.market AND e.sec >= l.sec ASOF LEFT JOIN y h ON e.market = h.market AND e.sec <= h.sec)""",
    ctes=f"""{B}, x AS (SELECT event_id, event_type AS market, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), y AS (SELECT market, CAST(epoch(ts) AS BIGINT) AS sec FROM bars)""",
)
def j12(spark, sf):
    x = tb.read(spark, sf, "events").select("event_id", F.col("event_type").alias("market"), F.unix_seconds(tx.as_utc(F.col("ts"))).alias("at"))
    y = tb.bars(spark, sf).select("market", F.unix_seconds(tx.as_utc(F.col("ts"))).alias("at"))
    return joins.nearest(x, y, ["market"], "at", WIDTH * 86_400).select("event_id", "nearest")


@query(
    "T12_aligned_prices",
    """SELECT market, day, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
 FROM (SELECT market, CAST(unnest(range(min(day) - 2, max(day) + 3)) AS INTEGER) AS day FROM daily GROUP BY 1) LEFT JOIN daily USING (market, day)""",
    "close",
    DAILY,
)
def t12(spark, sf):
    d = daily(spark, sf)
    grid = d.groupBy("market").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("market", F.explode(F.sequence(F.col("a") - 2, F.col("b") + 2)).alias("day"))
    return curves.align(d, grid, ["market"], "close").select("market", "day", "close")


@query(
    "T11_base_curves",
    """SELECT day, sum(coalesce(pnl, 0)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS realized, coalesce(unrealized, 0) AS unrealized FROM (SELECT CAST(unnest(range(min(day), max(day) + 1)) AS INTEGER) AS day FROM daily)
 LEFT JOIN (SELECT cd AS day, sum(pnl) AS pnl FROM pos GROUP BY 1) USING (day)
 LEFT JOIN (SELECT d.day, sum(pnl / CASE WHEN abs(exit - entry) < 1e-12 THEN 1.0 ELSE exit - entry END * (close - entry)) AS unrealized FROM pos p JOIN daily d ON p.market = d.market AND d.day >= od AND d.day < cd GROUP BY 1) USING (day)""",
    "realized unrealized",
    f"{DAILY},\n{EVENTS},\npos AS (SELECT market, day AS od, CAST(day + event_id % 5 AS INTEGER) AS cd, value - 50 AS pnl, value AS entry, value + 1 + event_id % 7 AS exit FROM ev)",
)
def t11(spark, sf):
    d = daily(spark, sf)
    p = ev(spark, sf).select("market", F.col("day").alias("od"), (F.col("day") + F.col("event_id") % 5).cast("int").alias("cd"), (F.col("value") - 50).alias("pnl"), F.col("value").alias("entry"), (F.col("value") + 1 + F.col("event_id") % 7).alias("exit"))
    grid = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return curves.base_curves(p, d, grid)


@query(
    "T32_warm_bars",
    "SELECT market, count(*) FILTER (n >= 26) AS warm, count(*) AS bars FROM (SELECT market, row_number() OVER (PARTITION BY market ORDER BY ts) AS n FROM bars) GROUP BY 1",
    ctes=B,
)
def t32(spark, sf):
    return tb.bars(spark, sf).withColumn("warm", indicators.warm(["market"], 26)).groupBy("market").agg(F.count_if("warm").alias("warm"), F.count("*").alias("bars"))


EMA = """WITH RECURSIVE x AS (SELECT market, ts, close, row_number() OVER (PARTITION BY market ORDER BY ts) AS n FROM bars),
e AS (SELECT market, ts, n, close AS ema FROM x WHERE n = 1 UNION ALL SELECT x.market, x.ts, x.n, x.close * (2.0::DOUBLE / 25) + e.ema * (1 - 2.0::DOUBLE / 25) FROM e JOIN x ON x.market = e.market AND x.n = e.n + 1)"""


@query("T30_ema", f"{EMA.replace('WITH RECURSIVE x', f'WITH RECURSIVE {B}, x')} SELECT market, ts, ema FROM e", "ema")
def t30(spark, sf):
    return indicators.smoothed(tb.bars(spark, sf), ["market"], 24, 14, width=WIDTH).select("market", "ts", "ema")


RSI = """d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY market ORDER BY ts), 0) AS step FROM x),
s AS (SELECT market, ts, n, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM d WHERE n = 1 UNION ALL SELECT d.market, d.ts, d.n, s.u * (1 - 1.0::DOUBLE / 14) + greatest(step, 0) / 14, s.v * (1 - 1.0::DOUBLE / 14) + greatest(-step, 0) / 14 FROM s JOIN d ON d.market = s.market AND d.n = s.n + 1)"""


@query("T31_rsi", f"{EMA.replace('WITH RECURSIVE x', f'WITH RECURSIVE {B}, x')},\n{RSI} SELECT market, ts, CASE WHEN u + v > 0 THEN 100 * u / (u + v) ELSE 50 END AS rsi FROM s", "rsi")
def t31(spark, sf):
    return indicators.smoothed(tb.bars(spark, sf), ["market"], 24, 14, width=WIDTH).select("market", "ts", "rsi")


#: All confirmations are on; the walks are steps of any size, so bodies have no least one.
RULES = signals.EntryRules(band_width=1.5, body_pct=0.0)


@query("T36_signals")
def t36(spark, sf):
    return signals.signal_table(tb.walk(spark, sf), ["market"], RULES, width=180)


@query("T39_backtest")
def t39(spark, sf):
    grid = spark.createDataFrame([(f"sl={s},tp={t}", s, t) for s in (1.0, 2.0) for t in (1.0, 2.0, 4.0)], "combo string, sl_pct double, tp_pct double")
    return signals.backtest(tb.walk(spark, sf), grid, ["market"], RULES)


@query("W05_window_optimiser")
def w05(spark, sf):
    """The combination with the best score on each market, the earliest in the grid on ties."""
    t = t39(spark, sf).withColumn("pnl", F.col("r") * 100)
    x = stats.calmar(t, ["market", "combo"], ["ts_closed", "ts_opened"], "pnl", 100_000.0)
    return x.where(F.col("score") > float("-inf")).groupBy("market").agg(F.max("score").alias("best"), F.min_by("combo", F.struct(-F.col("score"), "combo")).alias("combo"))


#: The grid of the walk-forward runs: stops and targets in percent.
GRID = [(f"sl={s},tp={t}", s, t) for s in (1.0, 2.0) for t in (1.0, 2.0, 4.0)]


@query("W09_walk_forward")
def w09(spark, sf):
    """Daily bars make few trades a window; windows with under ten keep the first combination."""
    return runners.walk_forward(tb.walk(spark, sf), tb.windows(spark), GRID, ["market"], tb.BASE_RISK, RULES)


@query("W08_window_matrix")
def w08(spark, sf):
    bars, w = tb.walk(spark, sf), tb.windows(spark)
    tasks = bars.select("market").distinct().join(F.broadcast(w.select("ordinal")))  # a row a window
    picked = runners.choose(runners.training_trades(bars, w, GRID, ["market"], RULES), tasks, GRID, ["market"], tb.BASE_RISK)
    return runners.window_matrix(runners.continuous(bars, picked, w, GRID, ["market"], RULES, matrix=True), w, ["market"], tb.BASE_RISK)
