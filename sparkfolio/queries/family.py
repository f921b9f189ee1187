"""Diagnostics of the whole family on shared windows, and evidence as strict JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as tx
from ..operators import diagnostics, monitoring, selection, stats
from ..sources import evidence, files
from ..sources import windows as ws
from ..sources import tables as tb
from .accounts import CELLS, cells
from .base import query

COMMON = f"""{CELLS},
tasks AS (SELECT train_months, variation, instrument, min(label) AS a, max(label) AS b FROM cells GROUP BY 1, 2, 3),
shared AS (SELECT label FROM cells GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM tasks))"""


def named(spark, sf):
    return cells(spark, sf).withColumn("candidate", F.format_string("%s__train_%dm", "variation", "train_months"))


@query("A21_common_span", "SELECT a AS label, b AS until FROM (SELECT max(a) AS a, min(b) AS b FROM tasks) WHERE a < b", ctes=COMMON)
def a21(spark, sf):
    """The years that all tasks of the family span."""
    x = named(spark, sf).withColumns({"task": F.struct("instrument", "candidate"), "until": F.col("label")})
    return diagnostics.common_bounds(x, "task", "label", "until")


@query(
    "A21_synchronised_matrix",
    "SELECT variation || '__train_' || train_months || 'm' AS candidate, label, avg(value) AS value FROM cells JOIN shared USING (label) GROUP BY 1, 2",
    "value",
    COMMON,
)
def a21_matrix(spark, sf):
    """Every candidate on the years that every market region has for every candidate."""
    return diagnostics.synchronized(named(spark, sf), "instrument", "candidate", "label", "value")


@query("A32_synchronised_diagnostics")
def a32(spark, sf):
    """The family's candidates and its own size; the reason instead where its windows are too few or not whole."""
    path = files.scratch(spark, "cells")
    named(spark, sf).write.parquet(path)  # a row a candidate, region and year; read many times, the trades once
    x = spark.read.parquet(path)
    m = diagnostics.synchronized(x, "instrument", "candidate", "label", "value")
    return diagnostics.family_diagnostics(m, "candidate", "label", "value", x.select("candidate").distinct().count())


@query("R16_variation_pbo")
def r16(spark, sf):
    return monitoring.variation_pbo(cells(spark, sf))


@query("J03_ranked_diagnostics")
def j03(spark, sf):
    """The ranking of the study with each candidate's deflated Sharpe ratios."""
    ranked = stats.ranking(tb.study(spark, sf)).withColumn("candidate", F.format_string("%s__train_%dm", "variation", "train_months"))
    return selection.with_diagnostics(ranked, a32(spark, sf), "candidate").select("candidate", "mean_rpd", "complete", "enough_positive", "near_best", "dsr", "dsr_nominal", "dsr_ok")


#: Fields of a market's evidence.
FIELDS = [
    evidence.Field("schema", "text", fixed="market/1"), evidence.Field("market", "text"), evidence.Field("trades", "long"), evidence.Field("total", "decimal"), evidence.Field("sides", "texts"),
    evidence.Field("outcomes", "object"), evidence.Field("outcomes.wins", "long"), evidence.Field("outcomes.losses", "long"), evidence.Field("outcomes.best", "decimal", required=False),
]


@query(
    "F34_evidence",
    """SELECT market, trades, CAST(total AS DOUBLE) AS total, len(sides) AS sides, wins, losses, CAST(best AS DOUBLE) AS best FROM (SELECT market, count(*) AS trades, sum(CAST(r AS DECIMAL(18,6))) AS total, list(DISTINCT is_long) AS sides,
 count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, max(CASE WHEN r > 0 THEN CAST(r AS DECIMAL(18,6)) END) AS best FROM trades GROUP BY 1)""",
    "total best",
    tb.TRADES,
)
def f34(spark, sf):
    """Each market's figures written as evidence and read back through the checks."""
    r = F.col("r").cast("decimal(18,6)")
    x = tb.trades(spark, sf).groupBy("market").agg(
        F.lit("market/1").alias("schema"), F.count("*").alias("trades"), F.sum(r).alias("total"), F.sort_array(F.collect_set(F.when(F.col("is_long"), "long").otherwise("short"))).alias("sides"),
        F.count_if(r > 0).alias("outcomes_wins"), F.count_if(r < 0).alias("outcomes_losses"), F.max(F.when(r > 0, r)).alias("outcomes_best"),
    )
    y = evidence.typed(evidence.written(x, FIELDS), FIELDS)
    return y.select("market", "trades", F.col("total").cast("double").alias("total"), F.size("sides").cast("long").alias("sides"), F.col("outcomes_wins").alias("wins"), F.col("outcomes_losses").alias("losses"), F.col("outcomes_best").cast("double").alias("best"))


@query(
    "W14_candidate_windows",
    "SELECT candidate, k4 AS market, CAST(year(ts_closed) AS VARCHAR) AS label, count(*) AS events, CAST(sum(CAST(r AS DECIMAL(18,6))) AS DOUBLE) AS net_r, min(epoch_ns(ts_closed)) AS first_ns FROM candidates GROUP BY 1, 2, 3",
    "net_r",
    tb.CANDIDATES,
)
def w14(spark, sf):
    """The yearly windows of each candidate and market, written as lists and read back through the checks."""
    ns, year = tx.epoch_nanoseconds(F.col("ts_closed")), F.year("ts_closed")
    event = F.concat(F.lit("["), ns.cast("string"), F.lit(", "), F.col("r").cast("decimal(18,6)").cast("string"), F.lit("]"))
    x = tb.candidates(spark, sf).select(F.col("k4").alias("market"), "candidate", F.struct(year.alias("year"), event.alias("event")).alias("e"))
    # A text's events meet once, in order of their years; an event without R is none, and comes first in its year.
    x = x.repartition("market", "candidate").groupBy("market", "candidate").agg(F.sort_array(F.collect_list("e")).alias("es"))
    bound = lambda y: tx.epoch_nanoseconds(F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    said = lambda v: F.coalesce(v.cast("string"), F.lit("null"))
    opening = lambda y: F.concat(F.lit('{"window": "'), said(y), F.lit('", "test_start_ns": '), said(bound(y)), F.lit(', "test_end_ns": '), said(bound(y + 1)), F.lit(', "net_r_events": ['))

    def part(e, i):
        before = F.get("es", i - 1)
        starts = (i == 0) | ~before["year"].eqNullSafe(e["year"])
        opens = F.when(i == 0, opening(e["year"])).when(starts, F.concat(F.lit("]}, "), opening(e["year"])))
        return F.concat(F.coalesce(opens, F.lit("")), F.when(starts | before["event"].isNull(), F.lit("")).otherwise(F.lit(", ")), F.coalesce(e["event"], F.lit("")))

    texts = x.select("candidate", "market", F.concat(F.lit("["), F.array_join(F.transform("es", part), ""), F.lit("]}]")).alias("json"))
    y = ws.candidate_windows(texts, ["candidate", "market"])
    total = F.aggregate("events", F.lit(0).cast("decimal(38,6)"), lambda a, e: (a + e["net_r"]).cast("decimal(38,6)"))
    return y.select("candidate", "market", F.col("window").alias("label"), F.size("events").cast("long").alias("events"), total.cast("double").alias("net_r"), F.array_min(F.transform("events", lambda e: e["ts_ns"])).alias("first_ns"))
