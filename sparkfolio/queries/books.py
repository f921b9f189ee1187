"""Studies, candidates, deals, windows: selection, matrices, ledgers and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, gram, joins, ledger, selection, stats, walkforward
from ..sources import tables as tb
from .base import query

CONFIG = f"""{tb.STUDY},
conf AS (SELECT variation, train_months, avg(mean_oos) AS mean_ret, avg(return_per_dd) AS mean_rpd, min(return_per_dd) AS worst_rpd, avg(CASE WHEN mean_oos > 0 THEN 1.0 ELSE 0.0 END) AS frac_positive, count(DISTINCT instrument) AS instruments FROM study GROUP BY 1, 2)"""


@query("A04_per_config", "SELECT * FROM conf", "mean_ret mean_rpd worst_rpd frac_positive", CONFIG)
def a04(spark, sf):
    return stats.per_config(tb.study(spark, sf))


@query(
    "A05_ranking",
    "SELECT variation, count(*) AS rows, avg(mean_oos) AS mean_ret, median(mean_oos) AS median_ret, avg(oos_maxdd) AS mean_dd, avg(return_per_dd) AS mean_rpd, avg(pct_profitable) AS pct, CAST(sum(oos_trades) AS BIGINT) AS trades FROM study GROUP BY 1",
    "mean_ret median_ret mean_dd mean_rpd pct",
    tb.STUDY,
)
def a05(spark, sf):
    return tb.study(spark, sf).groupBy("variation").agg(
        F.count("*").alias("rows"), F.avg("mean_oos").alias("mean_ret"), F.percentile("mean_oos", 0.5).alias("median_ret"), F.avg("oos_maxdd").alias("mean_dd"),
        F.avg("return_per_dd").alias("mean_rpd"), F.avg("pct_profitable").alias("pct"), F.sum("oos_trades").alias("trades"),
    )


@query(
    "A06_best_train",
    "SELECT variation, arg_min(train_months, (-round(rpd, 9), train_months)) AS best_train, max(rpd) AS best_rpd FROM (SELECT variation, train_months, avg(return_per_dd) AS rpd FROM study GROUP BY 1, 2) GROUP BY 1",
    "best_rpd",
    tb.STUDY,
)
def a06(spark, sf):
    return stats.best_train(tb.study(spark, sf))


@query("A07_pivot", 'SELECT variation, avg(return_per_dd) FILTER (train_months = 18) AS "18", avg(return_per_dd) FILTER (train_months = 24) AS "24", avg(return_per_dd) FILTER (train_months = 36) AS "36" FROM study GROUP BY 1', '"18" "24" "36"', tb.STUDY)
def a07(spark, sf):
    return stats.pivoted(tb.study(spark, sf), "variation", "train_months", [18, 24, 36], "return_per_dd")


@query(
    "V03_structure_gates",
    """SELECT variation, train_months, mean_ret, mean_rpd, worst_rpd, frac_positive, instruments = (SELECT count(DISTINCT instrument) FROM study) AS complete, frac_positive >= 0.9 AS enough_positive,
 mean_rpd >= 0.85 * (SELECT max(mean_rpd) FROM conf) AS near_best FROM conf""",
    "mean_ret mean_rpd worst_rpd frac_positive",
    CONFIG,
)
def v03(spark, sf):
    return stats.ranking(tb.study(spark, sf))


@query("V04_universe", "SELECT instrument, return_per_dd FROM study WHERE variation = 'Brand#11' AND train_months = 24 AND return_per_dd >= 0.0 AND mean_oos > 0 AND pct_profitable >= 40", "return_per_dd", tb.STUDY)
def v04(spark, sf):
    return selection.universe(tb.study(spark, sf), "Brand#11", 24, 0.0, 40.0).select("instrument", "return_per_dd")


@query(
    "V05_filter_chain",
    """SELECT variation, a AS positive, b AS profitable, c AS deep, CASE WHEN a = 0 THEN 'positive' WHEN b = 0 THEN 'profitable' WHEN c = 0 THEN 'deep' END AS emptied_by FROM (SELECT variation, count(*) FILTER (mean_oos > 0) AS a,
 count(*) FILTER (mean_oos > 0 AND pct_profitable >= 50) AS b, count(*) FILTER (mean_oos > 0 AND pct_profitable >= 50 AND return_per_dd >= 0.3) AS c FROM study GROUP BY 1)""",
    ctes=tb.STUDY,
)
def v05(spark, sf):
    return selection.chain(tb.study(spark, sf), ["variation"], [("positive", F.col("mean_oos") > 0), ("profitable", F.col("pct_profitable") >= 50), ("deep", F.col("return_per_dd") >= 0.3)])


@query(
    "O02_complexity_first",
    "SELECT instrument, variation, train_months FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ascii(right(variation, 1)) % 3, -round(mean_oos, 9), -train_months, variation) AS n FROM study) WHERE n = 1",
    ctes=tb.STUDY,
)
def o02(spark, sf):
    keys = [F.ascii(F.substring("variation", -1, 1)) % 3, -F.round("mean_oos", 9), -F.col("train_months"), F.col("variation")]
    return selection.first_choice(tb.study(spark, sf), ["instrument"], keys).select("instrument", "variation", "train_months")


@query("O03_first_max", "SELECT o_custkey, max(o_totalprice) AS best, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS at FROM orders GROUP BY 1", "best")
def o03(spark, sf):
    return selection.first_max(tb.read(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("O10_common_labels", "SELECT p_brand AS label FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 10) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT p_type) FROM part WHERE p_size > 10)")
def o10(spark, sf):
    return walkforward.common(tb.read(spark, sf, "part").where("p_size > 10").withColumnRenamed("p_brand", "label"), "p_type", "label")


@query("J05_missing", "SELECT n_nationkey, p_brand FROM (SELECT DISTINCT n_nationkey FROM nation) CROSS JOIN (SELECT DISTINCT p_brand FROM part) EXCEPT SELECT s_nationkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 AND l_discount > 0.08")
def j05(spark, sf):
    li, p, s = (tb.read(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    got = li.where("l_quantity > 45 AND l_discount > 0.08").join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("n_nationkey"), "p_brand")
    want = joins.grid(tb.read(spark, sf, "nation").select("n_nationkey").distinct(), p.select("p_brand").distinct())
    return joins.missing(want, got, ["n_nationkey", "p_brand"])


@query("J04_semi", "SELECT variation, train_months, mean_ret FROM conf WHERE variation IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25.5)", "mean_ret", CONFIG)
def j04(spark, sf):
    good = tb.read(spark, sf, "part").groupBy(F.col("p_brand").alias("variation")).agg(F.avg("p_size").alias("p")).where("p > 25.5")
    return stats.per_config(tb.study(spark, sf)).join(good, "variation", "left_semi").select("variation", "train_months", "mean_ret")


@query("V11_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v11(spark, sf):
    return joins.duplicates(tb.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


MATRIX = f"""{tb.CANDIDATES},
grid AS (SELECT candidate, day FROM (SELECT DISTINCT candidate FROM candidates) CROSS JOIN (SELECT CAST(unnest(range(min(day), max(day) + 1)) AS INTEGER) AS day FROM candidates)),
matrix AS (SELECT candidate, day, CAST(coalesce(s, 0) AS DOUBLE) * 0.0018::DOUBLE AS ret FROM grid LEFT JOIN (SELECT candidate, day, sum(CAST(r AS DECIMAL(18,6))) AS s FROM candidates GROUP BY 1, 2) USING (candidate, day))"""


def matrix(spark, sf):
    return walkforward.daily_matrix(tb.candidates(spark, sf), "candidate", "day", "r", tb.BASE_RISK).withColumn("ret", F.col("ret").cast("double"))


@query("A19_candidate_matrix", "SELECT candidate, day, ret FROM matrix", "ret", MATRIX)
def a19(spark, sf):
    return matrix(spark, sf)


@query("A20_window_sums", "SELECT candidate, label, sum(r) AS net_r, count(*) AS trades FROM (SELECT * FROM candidates ASOF JOIN (SELECT test_start AS ts_closed, ordinal AS label, max(test_end) OVER () AS until FROM windows) USING (ts_closed)) WHERE ts_closed <= until GROUP BY 1, 2", "net_r", f"{tb.CANDIDATES},\n{tb.WINDOWS}")
def a20(spark, sf):
    w = tb.windows(spark).select("test_start", "test_end", F.col("ordinal").alias("label"))
    return joins.member(tb.candidates(spark, sf), w, [], "ts_closed", "test_start", "test_end", "label").groupBy("candidate", "label").agg(F.sum("r").alias("net_r"), F.count("*").alias("trades"))


@query("A30_mean_correlation", "SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(rho))) AS rho_bar, count(*) AS pairs FROM (SELECT corr(x.ret, y.ret) AS rho FROM matrix x JOIN matrix y ON x.day = y.day AND x.candidate < y.candidate GROUP BY x.candidate, y.candidate)", "rho_bar", MATRIX)
def a30(spark, sf):
    return selection.pooled_correlation(gram.correlations(gram.pair_moments(matrix(spark, sf), "candidate", "day", "ret")))


@query(
    "J14_pair_scores",
    """SELECT a, b, n, mean_diff, sd_diff, CASE WHEN sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n)) ELSE 0 END AS score FROM (SELECT x.candidate AS a, y.candidate AS b, count(*) AS n, avg(x.ret) - avg(y.ret) AS mean_diff, stddev_samp(x.ret - y.ret) AS sd_diff
 FROM matrix x JOIN matrix y ON x.day = y.day AND x.candidate < y.candidate GROUP BY 1, 2)""",
    "mean_diff sd_diff score",
    MATRIX,
)
def j14(spark, sf):
    """Every two candidates: the mean and deviation of their daily difference, and the mean in standard errors."""
    return gram.differences(gram.pair_moments(matrix(spark, sf), "candidate", "day", "ret")).select("a", "b", "n", "mean_diff", "sd_diff", "score")


@query(
    "V12_reconciliation",
    """SELECT candidate, CAST(total AS DOUBLE) AS total, total = by_day AND total = by_market AS agree FROM (SELECT candidate, sum(CAST(r AS DECIMAL(18,6))) AS total FROM candidates GROUP BY 1)
 JOIN (SELECT candidate, sum(s) AS by_day FROM (SELECT candidate, day, sum(CAST(r AS DECIMAL(18,6))) AS s FROM candidates GROUP BY 1, 2) GROUP BY 1) USING (candidate)
 JOIN (SELECT candidate, sum(s) AS by_market FROM (SELECT candidate, market, sum(CAST(r AS DECIMAL(18,6))) AS s FROM candidates GROUP BY 1, 2) GROUP BY 1) USING (candidate)""",
    "total",
    tb.CANDIDATES,
)
def v12(spark, sf):
    return walkforward.reconciliation(tb.candidates(spark, sf), "candidate", "day", "market", "r").select("candidate", F.col("total").cast("double").alias("total"), "agree")


@query("R15_pbo")
def r15(spark, sf):
    x = tb.candidates(spark, sf).withColumn("slice", F.floor(F.col("day") / 30)).groupBy("candidate", "slice").agg(F.sum(F.col("r").cast("decimal(18,6)")).alias("perf"))
    return walkforward.pbo(x, "candidate", "slice", "perf")


@query("W01_windows", "SELECT ordinal, train_start, train_end, test_start, test_end, trades, net_r FROM held", "net_r", tb.WINDOW_TRADES)
def w01(spark, sf):
    """The windows and what closes in each."""
    return tb.window_trades(spark, sf)


@query("W02_holdout", "SELECT ordinal, CASE WHEN test_end <= TIMESTAMP '2002-01-01' - to_months(18) THEN 'select' ELSE 'holdout' END AS phase, trades, net_r FROM held", "net_r", tb.WINDOW_TRADES)
def w02(spark, sf):
    return walkforward.holdout(tb.window_trades(spark, sf), "2002-01-01", 18).select("ordinal", "phase", "trades", "net_r")


@query("W03_grid", "SELECT a AS sl, b AS tp, count(*) FILTER (r <= -a) AS stopped, count(*) FILTER (r >= b) AS reached FROM unnest([0.3::DOUBLE, 0.5, 0.8]) t(a) CROSS JOIN unnest([1.0::DOUBLE, 2.0]) u(b) CROSS JOIN trades GROUP BY 1, 2", "sl tp", tb.TRADES)
def w03(spark, sf):
    """Each combination with the trades that lose at least its stop and those that win at least its target. Trades are
    counted by value first."""
    grid = joins.grid(spark.createDataFrame([(0.3,), (0.5,), (0.8,)], "sl double"), spark.createDataFrame([(1.0,), (2.0,)], "tp double"))
    values = tb.trades(spark, sf).groupBy("r").agg(F.count("*").alias("n"))
    x = values.crossJoin(F.broadcast(grid))  # six rows
    return x.groupBy("sl", "tp").agg(F.coalesce(F.sum(F.when(F.col("r") <= -F.col("sl"), F.col("n"))), F.lit(0)).alias("stopped"), F.coalesce(F.sum(F.when(F.col("r") >= F.col("tp"), F.col("n"))), F.lit(0)).alias("reached"))


@query(
    "W06_schedule",
    "SELECT test_start AS from_ts, ordinal, true AS entries, trades FROM held UNION ALL SELECT test_end, ordinal, false, trades FROM (SELECT *, lead(test_start) OVER (ORDER BY ordinal) AS nx FROM held) WHERE nx IS NULL OR nx > test_end",
    ctes=tb.WINDOW_TRADES,
)
def w06(spark, sf):
    w = tb.window_trades(spark, sf)
    return walkforward.schedule(tb.windows(spark)).join(w.select("ordinal", "trades"), "ordinal").select("from_ts", "ordinal", "entries", "trades")


@query(
    "A24_efficiency",
    "SELECT variation, avg(o) / nullif(avg(i), 0) AS wfe, avg(o) / nullif(avg(i), 0) * max(train_months) / 6 AS wfe_norm FROM (SELECT variation, train_months, ts_closed, r AS o, abs(r) + 0.5 AS i FROM candidates) GROUP BY 1",
    "wfe wfe_norm",
    tb.CANDIDATES,
)
def a24(spark, sf):
    x = tb.candidates(spark, sf).select("variation", "train_months", F.col("r").alias("oos"), (F.abs("r") + 0.5).alias("ins"))
    return walkforward.efficiency(x, ["variation"])


LED = f"{tb.DEALS},\nled AS (SELECT 'all' AS account, time, ticket, CAST(profit + swap + commission + fee AS DECIMAL(18,4)) AS amount FROM deals WHERE profit + swap + commission + fee <> 0)"


def deals(spark, sf):
    return tb.deals(spark, sf).withColumn("account", F.lit("all"))


@query("L09_ledger", "SELECT time, ticket, CAST(amount AS DOUBLE) AS amount FROM led", "amount", LED)
def l09(spark, sf):
    return ledger.ledger(deals(spark, sf)).select("time", "ticket", F.col("amount").cast("double").alias("amount"))


@query("T14_ledger_equity", "SELECT time, ticket, CAST(100000 + sum(amount) OVER (ORDER BY time, ticket ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM led", "balance", LED)
def t14(spark, sf):
    return ledger.equity(ledger.ledger(deals(spark, sf)), 100_000.0).select("time", "ticket", F.col("balance").cast("double").alias("balance"))


@query(
    "T15_backward_balance",
    "SELECT time, ticket, CAST(600000 - coalesce(sum(amount) OVER w, 0) AS DOUBLE) AS after, CAST(600000 - coalesce(sum(amount) OVER w, 0) - amount AS DOUBLE) AS before FROM led WINDOW w AS (ORDER BY time, ticket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "after before",
    LED,
)
def t15(spark, sf):
    x = ledger.backward(ledger.ledger(deals(spark, sf)), 600_000.0)
    return x.select("time", "ticket", F.col("after").cast("double").alias("after"), F.col("before").cast("double").alias("before"))


TRIPS = f"""{tb.DEALS},
trips AS (SELECT position_id, arg_min(symbol, (time, ticket)) AS symbol, CASE arg_min(type, (time, ticket)) FILTER (entry = 0) WHEN 0 THEN 'BUY' ELSE 'SELL' END AS side, arg_min(time, (time, ticket)) FILTER (entry = 0) AS opened, arg_max(time, (time, ticket)) FILTER (entry = 1) AS closed,
 arg_min(ticket, (time, ticket)) FILTER (entry = 0) AS open_ticket, sum(profit + swap + commission + fee) AS net, count(*) FILTER (entry = 0) AS ins, count(*) FILTER (entry = 1) AS outs FROM deals WHERE symbol <> '' GROUP BY 1 HAVING count(*) FILTER (entry = 0) > 0 AND count(*) FILTER (entry = 1) > 0)"""


@query("L08_round_trips", "SELECT position_id, symbol, side, opened, closed, open_ticket, CAST(net AS DOUBLE) AS net, ins, outs FROM trips", "net", TRIPS)
def l08(spark, sf):
    return ledger.round_trips(deals(spark, sf)).withColumn("net", F.col("net").cast("double"))


@query("V21_excluded", "SELECT position_id, 'open' AS reason FROM deals WHERE symbol <> '' GROUP BY 1 HAVING count(*) FILTER (entry = 1) = 0", ctes=tb.DEALS)
def v21(spark, sf):
    return ledger.excluded(deals(spark, sf))


@query(
    "V21_unreconstructable",
    """SELECT position_id, array_to_string(list_concat(CASE WHEN turned THEN ['reversal'] ELSE [] END, CASE WHEN by_other THEN ['closed by another'] ELSE [] END, list_transform(types, lambda t: 'later entry of type ' || t)), '; ') AS reasons FROM
 (SELECT position_id, bool_or(e = 2) AS turned, bool_or(e = 3) AS by_other, coalesce(list_sort(list(DISTINCT t) FILTER (e = 0 AND n > 1 AND t NOT IN (0, 1))), []) AS types FROM
 (SELECT *, row_number() OVER (PARTITION BY position_id, e ORDER BY time, ticket) AS n FROM (SELECT *, CASE WHEN ticket % 17 = 0 THEN 2 WHEN ticket % 19 = 0 THEN 3 WHEN ticket % 5 = 0 THEN 0 ELSE entry END AS e, CASE WHEN ticket % 25 = 0 THEN 2 + ticket % 3 ELSE type END AS t FROM deals WHERE symbol <> '')) GROUP BY 1)
 WHERE turned OR by_other OR len(types) > 0""",
    ctes=tb.DEALS,
)
def v21_reasons(spark, sf):
    """Some deals made reversals, closed by others, further entries, or entries of other types."""
    t = F.col("ticket")
    entry = F.when(t % 17 == 0, 2).when(t % 19 == 0, 3).when(t % 5 == 0, 0).otherwise(F.col("entry"))
    d = deals(spark, sf).withColumns({"entry": entry, "type": F.when(t % 25 == 0, (2 + t % 3).cast("int")).otherwise(F.col("type"))})
    return ledger.unreconstructable(d).select("position_id", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "A02_live_stats",
    "SELECT symbol, count(*) AS n, count(*) FILTER (net > 0) / count(*) AS hit_rate, CAST(sum(net) FILTER (net > 0) AS DOUBLE) / -CAST(sum(net) FILTER (net < 0) AS DOUBLE) AS profit_factor, CAST(sum(net) AS DOUBLE) / count(*) AS expectancy FROM trips GROUP BY 1",
    "hit_rate profit_factor expectancy",
    TRIPS,
)
def a02(spark, sf):
    return ledger.live_stats(ledger.round_trips(deals(spark, sf)), ["symbol"])


@query(
    "T16_risk_basis",
    "SELECT position_id, CAST(600000 - later - amount AS DOUBLE) * 0.0018::DOUBLE AS risk FROM trips JOIN (SELECT ticket, amount, coalesce(sum(amount) OVER (ORDER BY time, ticket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM led) ON ticket = open_ticket",
    "risk",
    f"{TRIPS},\n{LED.split(tb.DEALS + ',')[1]}",
)
def t16(spark, sf):
    d = deals(spark, sf)
    b = ledger.backward(ledger.ledger(d), 600_000.0).select(F.col("ticket").alias("open_ticket"), "before")
    return ledger.round_trips(d).join(b, "open_ticket").select("position_id", (F.col("before").cast("double") * tb.BASE_RISK).alias("risk"))


@query(
    "V16_pre_trade",
    """SELECT o_orderkey, room, reason = 'ok' AS allowed, reason FROM (SELECT *, CASE WHEN risk + open_risk > 0.02 * equity THEN 'open risk' WHEN 1.5 * (risk + open_risk) > room THEN CASE WHEN room = g THEN 'daily gate' WHEN room = h THEN 'daily limit' ELSE 'trailing floor' END ELSE 'ok' END AS reason FROM
 (SELECT *, least(g, h, f) AS room FROM (SELECT *, equity - day_start * (1 - 0.027::DOUBLE) AS g, equity - day_start * (1 - 0.03::DOUBLE) AS h, equity - least(100000.0::DOUBLE, high - 0.05::DOUBLE * 100000.0) AS f FROM
 (SELECT o_orderkey, o_totalprice / 500 AS risk, 97000.0::DOUBLE + o_totalprice / 100 AS equity, o_custkey * 1.0::DOUBLE AS open_risk, 98000.0::DOUBLE + o_custkey AS day_start, 101000.0::DOUBLE AS high FROM orders))))""",
    "room",
)
def v16(spark, sf):
    o = tb.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 500).alias("risk"), (97000.0 + F.col("o_totalprice") / 100).alias("equity"), (F.col("o_custkey") * 1.0).cast("double").alias("open_risk"), (F.lit(98000.0) + F.col("o_custkey")).alias("day_start"), F.lit(101000.0).alias("high"))
    return selection.pre_trade(o, "risk", "equity", "open_risk", "day_start", "high", 100_000.0).select("o_orderkey", "room", "allowed", "reason")


@query(
    "V13_regression",
    """SELECT variation, CASE WHEN t0 IS NULL OR t1 IS NULL OR a0 IS NULL OR a1 IS NULL THEN 'missing' WHEN abs(t1 - t0) > 0.01 * t0 OR abs(a1 - a0) > 0.02 THEN 'moved' ELSE 'same' END AS flag FROM
 (SELECT variation, CAST(sum(oos_trades) AS BIGINT) AS t0, avg(mean_oos) AS a0 FROM study WHERE train_months = 18 GROUP BY 1) FULL JOIN (SELECT variation, CAST(sum(oos_trades) AS BIGINT) AS t1, avg(mean_oos) AS a1 FROM study WHERE train_months = 24 GROUP BY 1) USING (variation)""",
    ctes=tb.STUDY,
)
def v13(spark, sf):
    s = tb.study(spark, sf)
    run = lambda m: s.where(F.col("train_months") == m).groupBy("variation").agg(F.sum("oos_trades").alias("trades"), F.avg("mean_oos").alias("annual"))
    return selection.regression(run(18), run(24), "variation").select("variation", "flag")


@query(
    "F24_symbol_match",
    "SELECT base, arg_min(p_type, (length(p_type), p_type)) AS match FROM (SELECT DISTINCT left(p_type, 3) AS base FROM part) LEFT JOIN (SELECT DISTINCT p_type FROM part) ON starts_with(p_type, base) GROUP BY 1",
)
def f24(spark, sf):
    p = tb.read(spark, sf, "part").select("p_type").distinct()
    return selection.shortest_match(p.select(F.substring("p_type", 1, 3).alias("base")).distinct(), p, "base", "p_type")


@query("V08_contiguous_days", "SELECT market, count(*) FILTER (day - before <> 1) AS gaps, max(day - before) AS longest FROM (SELECT market, day, lag(day) OVER (PARTITION BY market ORDER BY day) AS before FROM (SELECT DISTINCT market, day FROM trades)) GROUP BY 1", ctes=tb.TRADES)
def v08(spark, sf):
    from pyspark.sql import Window

    d = tb.trades(spark, sf).select("market", "day").distinct().withColumn("step", F.col("day") - F.lag("day").over(Window.partitionBy("market").orderBy("day")))
    return d.groupBy("market").agg(F.count_if(F.col("step") != 1).alias("gaps"), F.max("step").alias("longest"))


@query(
    "T20_window_returns",
    "SELECT ordinal, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM windows LEFT JOIN (SELECT label AS ordinal, sum(r) AS total, count(*) AS n FROM (SELECT * FROM trades ASOF JOIN (SELECT test_start AS ts_closed, ordinal AS label, max(test_end) OVER () AS until FROM windows) USING (ts_closed)) WHERE ts_closed <= until GROUP BY 1) USING (ordinal)",
    "total",
    f"{tb.TRADES},\n{tb.WINDOWS}",
)
def t20(spark, sf):
    w = tb.windows(spark)
    m = joins.member(tb.trades(spark, sf), w, [], "ts_closed", "test_start", "test_end", "ordinal")
    s = m.groupBy("ordinal").agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    return w.select("ordinal").join(s, "ordinal", "left").fillna({"total": 0.0, "n": 0})
