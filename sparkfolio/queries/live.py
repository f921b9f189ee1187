"""Live accounts: the risk state after every update, and what it allows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scans, signals
from ..sources import tables as tb
from ..streaming import parity, risk
from .base import query

START = 100_000.0
#: Days of an account that one task takes.
WIDTH = 7

#: Each event books its value less 50 on the account of its user's last digit; of four events one opens a position, which
#: closes hours later and in one of 28 events has no price, and one asks for an entry. An account starts with its third event.
UPDATES = f"""ue AS (SELECT event_id AS k, ts, 'a' || right(CAST(user_id AS VARCHAR), 1) AS account, value, row_number() OVER (PARTITION BY right(CAST(user_id AS VARCHAR), 1) ORDER BY ts, event_id) AS n,
 {START} + sum(value - 50) OVER (PARTITION BY right(CAST(user_id AS VARCHAR), 1) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance FROM events),
updates AS (SELECT account, ts, 4 * k AS seq, 'balance' AS kind, NULL::BIGINT AS id, NULL::DOUBLE AS risk, balance, balance + value - 50 AS equity FROM ue
 UNION ALL SELECT account, ts, 4 * k - 1, 'start', NULL, NULL, {START}, {START} FROM ue WHERE n = 3
 UNION ALL SELECT account, ts, 4 * k + 1, 'open', k, CASE WHEN k % 28 <> 1 THEN value END, NULL, NULL FROM ue WHERE k % 4 = 1
 UNION ALL SELECT account, ts + to_hours(CAST(1 + k % 7 AS INTEGER)), 4 * k + 2, 'close', k, CASE WHEN k % 28 <> 1 THEN value END, NULL, NULL FROM ue WHERE k % 4 = 1
 UNION ALL SELECT account, ts, 4 * k + 3, 'entry', k - 2, value * 5, NULL, NULL FROM ue WHERE k % 4 = 3),
u AS (SELECT *, {tb.loss_day_sql("ts")} AS day FROM updates),
run AS (SELECT *, last_value(CASE WHEN kind IN ('start', 'balance') THEN balance END IGNORE NULLS) OVER w AS now, last_value(CASE WHEN kind IN ('start', 'balance') THEN equity END IGNORE NULLS) OVER w AS held,
 last_value(CASE WHEN kind = 'start' THEN balance END IGNORE NULLS) OVER w AS began, coalesce(sum(CASE kind WHEN 'open' THEN risk WHEN 'close' THEN -risk END) OVER w, 0) AS total,
 coalesce(sum(CASE WHEN risk IS NULL THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 END END) OVER w, 0) AS bare FROM u WINDOW w AS (PARTITION BY account ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
closes AS (SELECT account, day, CASE WHEN arg_max(began IS NOT NULL, (ts, seq)) THEN arg_max(now, (ts, seq)) END AS banked FROM run GROUP BY 1, 2),
days AS (SELECT account, day, last_value(banked IGNORE NULLS) OVER v AS before, max(banked) OVER v AS top FROM closes WINDOW v AS (PARTITION BY account ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT run.*, coalesce(last_value(CASE WHEN kind = 'start' THEN balance END IGNORE NULLS) OVER (PARTITION BY account, day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), CASE WHEN began IS NOT NULL THEN before END) AS day_start,
 greatest(began, top) AS high, CASE WHEN bare > 0 THEN 'infinity'::DOUBLE ELSE round(total, 9) + 0.0 END AS open_risk FROM run JOIN days USING (account, day)),
pos AS (SELECT o.account, o.id, o.risk, o.ts AS t0, o.seq AS s0, c.ts AS t1, c.seq AS s1 FROM updates o JOIN updates c ON o.kind = 'open' AND c.kind = 'close' AND o.id = c.id),
full_state AS (SELECT s.*, least(began, high - 0.05 * began) AS floor, coalesce(p.risk, 0) AS replaced FROM state s LEFT JOIN pos p ON s.kind = 'entry' AND s.account = p.account AND s.id = p.id AND (t0, s0) < (s.ts, s.seq) AND (t1, s1) > (s.ts, s.seq)),
asked AS (SELECT *, greatest(0, open_risk - replaced) + risk AS taken, least(least(held, day_start) - day_start * (1 - 0.027), least(held, day_start) - day_start * (1 - 0.03), least(held, high) - floor) AS room FROM full_state)"""


def updates(spark, sf):
    w = Window.partitionBy("account").orderBy("ts", "k")
    e = tb.read(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("a"), F.substring(F.col("user_id").cast("string"), -1, 1)).alias("account"), "value")
    so_far, (d, rest) = w.rowsBetween(Window.unboundedPreceding, 0), scans.parts(F.col("value"))
    # decimals, so that a balance meets a floor exactly however many events came before
    e = e.withColumns({"n": F.row_number().over(w), "d": d, "booked": F.lit(START).cast(scans.DECIMAL) + F.sum(d - 50).over(so_far), "rest": F.sum(rest - 50).over(so_far)})
    whole = F.col("booked").cast("double")
    e = e.withColumn("balance", F.when(F.col("rest").isNull(), whole).otherwise(F.coalesce(whole, F.lit(START)) + F.col("rest")))
    e = e.withColumn("equity", F.coalesce(F.when(F.col("rest").isNull(), (F.col("booked") + (F.col("d") - 50)).cast("double")), F.col("balance") + F.col("value") - 50))
    none, price = F.lit(None), F.when(F.col("k") % 28 != 1, F.col("value"))
    row = lambda seq, kind, id_=none, risk_=none, balance=none, equity=none, ts=F.col("ts"): F.struct(ts.alias("ts"), seq.alias("seq"), F.lit(kind).alias("kind"), id_.cast("long").alias("id"), risk_.cast("double").alias("risk"), balance.cast("double").alias("balance"), equity.cast("double").alias("equity"))
    k = F.col("k")
    later = F.col("ts") + F.make_dt_interval(F.lit(0), (1 + k % 7).cast("int"))
    rows = F.array(
        row(4 * k, "balance", balance=F.col("balance"), equity=F.col("equity")), F.when(F.col("n") == 3, row(4 * k - 1, "start", balance=F.lit(START), equity=F.lit(START))),
        F.when(k % 4 == 1, row(4 * k + 1, "open", k, price)), F.when(k % 4 == 1, row(4 * k + 2, "close", k, price, ts=later)), F.when(k % 4 == 3, row(4 * k + 3, "entry", k - 2, F.col("value") * 5)),
    )
    return e.select("account", F.explode(rows).alias("u")).where("u IS NOT NULL").select("account", "u.*")


@query(
    "T47_L06_risk_state",
    f"""SELECT account, seq, kind, day, day_start, high, open_risk, CASE WHEN began IS NULL THEN '{risk.UNKNOWN}' WHEN held <= floor THEN '{risk.TRAILING}' WHEN held <= day_start - 0.025 * day_start THEN '{risk.DAILY}' END AS flatten,
 CASE WHEN kind = 'entry' THEN CASE WHEN began IS NULL THEN '{risk.UNKNOWN}' WHEN taken > 0.02 * held THEN '{risk.CAP}' WHEN 1.5 * taken > room THEN '{risk.TAIL}' END END AS refused FROM asked""",
    "day_start high open_risk",
    UPDATES,
)
def t47(spark, sf):
    """The state after each update of every account, which floor its equity has reached, and why an entry is refused."""
    return risk.risk_table(updates(spark, sf), width=WIDTH).drop("ts")


@query("A39_signal_agreement")
def a39(spark, sf):
    """Live bars are the bars, with closes of some a little higher and an hour off in others; both sides' signals on the
    bars that match. Confirmations off, so that short series have signals."""
    b = tb.bars(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    off = F.when(F.col("ticks") % 11 == 0, F.col("ts") - F.expr("INTERVAL '1' HOUR")).otherwise(F.col("ts"))
    live = b.withColumns({"close": F.col("close") * (1 + (F.col("ticks") % 5) / 100), "ts": off})
    rules = signals.EntryRules(need_band=False, need_range=False, need_strength=False)
    return parity.agreement(parity.signal_table(live, b, rules))
