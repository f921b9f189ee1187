"""Resampled paths of every account, replayed through the limits of its capital, their metrics and the decision.

An account has one scenario day a calendar day, so its days travel as one row of arrays. Every (account, block length,
chunk of replications) is a row of its own: a task draws the chunk's source days and folds all its paths at once, day by
day. For risk, days of paths are never rows of a table, and no path is shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from . import inference, paths

#: What a day brings, in money of its own source: opening balance, changes of balance and of closing equity, and the fall
#: from the opening to the day's least equity.
PARTS = ("opening", "balance_change", "equity_change", "to_minimum")
#: Day-steps of paths that one task holds at a time.
HELD = 2_000_000


@dataclass(frozen=True)
class Limits:
    """Shares of a day's opening balance and of the start that may be lost, inside and by contract, and the
    largest chances of a breach and of a negative return."""

    internal_daily: float = 0.025
    internal_trailing: float = 0.05
    daily: float = 0.03
    trailing: float = 0.06
    breach_chance: float = 0.01
    negative_chance: float = 0.05


#: What replayed() tells of each path; hits() are the limits, the last two with the high as it was before the day.
HITS = ("internal_daily", "internal_trailing", "daily", "trailing", "earlier_internal_trailing", "earlier_trailing")
VALUES = ("final_return", "max_drawdown", "under_water")


def replayed(days: np.ndarray, rows: np.ndarray, start: float, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Folds paths through the limits. days: a source day a row, the columns PARTS; rows: a path a row, the numbers of
    its source days. A day's changes are shares of its source's opening balance, so they compound from the path's own;
    closing equity adds its share of the path's opening. A daily limit is hit where the fall reaches it, judged in the
    source's money, or where the path opens the day at nothing; a trailing one where the least equity is at or below
    the highest balance less the limit, but no higher than the start. In the rule that decides, the day's own close
    raises the high before its minimum is judged; the earlier_ ones judge first. Drawdown is the minimum against the
    highest closing equity of the days before; a day is under water if it closes below that high."""
    if not (math.isfinite(start) and start > 0):
        raise ValueError("the start is finite and positive")
    if not len(days) or not rows.shape[1]:
        raise ValueError("a path without days")
    if not (days[:, 0] > 0).all():
        raise ValueError("a scenario day that opens at nothing")
    if not (limits.internal_daily < limits.daily and limits.internal_trailing < limits.trailing):
        raise ValueError("the internal limits are the tighter ones")
    opening, fall = days[:, 0], -days[:, 3]
    change, equity, least = (days[:, k] / opening for k in (1, 2, 3))
    reached = {"internal_daily": fall >= limits.internal_daily * opening, "daily": fall >= limits.daily * opening}
    m = len(rows)
    hits = {k: np.zeros(m, bool) for k in HITS}
    grown, close, high = np.ones(m), np.full(m, start), np.full(m, start)
    peak, deepest, wet = np.full(m, start), np.zeros(m), np.zeros(m, np.int64)
    for day in rows.T:
        at = start * grown
        minimum = at * (1 + least[day])
        grown = grown * (1 + change[day])
        close = close + at * equity[day]
        for k, of in reached.items():
            hits[k] |= of[day] | (at <= 0)
        after = np.maximum(high, start * grown)
        for k, top in (("", after), ("earlier_", high)):
            hits[k + "internal_trailing"] |= minimum <= np.minimum(start, top - limits.internal_trailing * start)
            hits[k + "trailing"] |= minimum <= np.minimum(start, top - limits.trailing * start)
        high = after
        deepest = np.maximum(deepest, (peak - minimum) / peak)
        peak = np.maximum(peak, close)
        wet += close < peak
    return {"growth": grown, "final_return": (start * grown - start) / start, "max_drawdown": deepest, "under_water": wet / rows.shape[1], **hits}


def packed(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """keys, n, the days and PARTS as arrays in order of the days; an account's days are counted, and refused beyond
    paths.MOST_DAYS."""
    x = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, *(F.col(c).cast("double").alias(c) for c in PARTS)))).alias("x"))
    full = F.when(F.size("x") > paths.MOST_DAYS, F.raise_error(F.lit(f"a series of over {paths.MOST_DAYS} days")).cast("int")).otherwise(F.size("x"))
    return x.select(*keys, full.cast("long").alias("n"), F.col(f"x.{day}").alias("days"), *(F.col(f"x.{c}").alias(c) for c in PARTS))


def chosen(series: DataFrame, fixed: tuple[int, ...] = paths.BLOCKS) -> DataFrame:
    """packed() with label, block and reason: the estimated mean block length of the account's daily money, rounded up, and
    the fixed ones. An estimate beyond a tenth of the days is refused, never clamped: its block is null and the reason
    says so, as for an account that opens a day at nothing."""

    @F.pandas_udf("double")
    def estimate(values: pd.Series) -> pd.Series:
        return pd.Series([inference.block_length(np.asarray(v, float)) for v in values])

    length = F.ceil(F.when(F.col("estimate") < 2**31, F.col("estimate")))
    poor = F.exists("opening", lambda o: ~(o > 0))
    refused = F.when(F.coalesce(length > F.floor(F.col("n") / 10), F.lit(True)), F.lit("block length beyond a tenth of the days"))
    first = F.struct(F.lit("plugin").alias("label"), F.when(refused.isNull(), length).cast("int").alias("block"), refused.alias("reason"))
    rest = [F.struct(F.lit(f"fixed_{b}").alias("label"), F.lit(b).alias("block"), F.lit(None).cast("string").alias("reason")) for b in fixed]
    x = series.withColumn("estimate", estimate("balance_change")).withColumn("c", F.explode(F.array(first, *rest)))
    reason = F.when(poor, F.lit("an opening balance that is not positive")).otherwise(F.col("c.reason"))
    return x.select(*series.columns, F.col("c.label").alias("label"), F.when(~poor, F.col("c.block")).alias("block"), reason.alias("reason"))


def _chunks(choices: DataFrame, replications: int) -> DataFrame:
    """A row for each chunk of replications of each choice that has a block length; its size depends on the days alone."""
    size = F.greatest(F.lit(1), F.least(F.lit(inference.CHUNK), F.floor(F.lit(HELD) / F.col("n")))).cast("int")
    x = choices.where("block IS NOT NULL").withColumn("size", size)
    x = x.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(replications) / F.col("size")).cast("int") - 1)))
    x = x.withColumn("reps", F.least(F.col("size"), F.lit(replications) - F.col("chunk") * F.col("size")))
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that rows this small are not put together
    return x.repartition(n, F.col("chunk"), F.col("label"), *(c for c in choices.columns if c not in {"n", "days", "label", "block", "reason", *PARTS}))


def _drawn(pdf: pd.DataFrame, seed: int) -> Iterator[tuple]:
    for row in pdf.itertuples(index=False):
        yield row, inference.indices(int(row.n), float(row.block), int(row.reps), seed, int(row.chunk))


def replays(choices: DataFrame, keys: list[str], start: float, replications: int = inference.REPLICATIONS, seed: int = inference.SEED, limits: Limits = Limits()) -> DataFrame:
    """keys, label, block, rep and what replayed() tells, for every path of every choice that wasn't refused."""

    def run(it):
        for pdf in it:
            for row, rows in _drawn(pdf, seed):
                days = np.stack([np.asarray(getattr(row, c), float) for c in PARTS], axis=1)
                out = pd.DataFrame(replayed(days, rows, start, limits))
                for c in [*keys, "label", "block"]:
                    out[c] = getattr(row, c)
                out["rep"] = np.arange(len(rows)) + row.chunk * row.size
                yield out[[*keys, "label", "block", "rep", "growth", *VALUES, *HITS]]

    own = ", ".join(f"{c} {t}" for c, t in choices.select(*keys).dtypes)
    made = f"{own}, label string, block int, rep long, growth double, {', '.join(f'{c} double' for c in VALUES)}, {', '.join(f'{c} boolean' for c in HITS)}"
    return _chunks(choices, replications).mapInPandas(run, made)


def drawn_days(choices: DataFrame, keys: list[str], replications: int = inference.REPLICATIONS, seed: int = inference.SEED) -> DataFrame:
    """keys, label, day, drawn, paths: how often each source day was drawn and in how many paths, counted where it is
    drawn."""

    def run(it):
        for pdf in it:
            for row, rows in _drawn(pdf, seed):
                n = int(row.n)
                seen = np.zeros((len(rows), n), bool)
                np.put_along_axis(seen, rows, True, axis=1)
                out = pd.DataFrame({"day": row.days, "drawn": np.bincount(rows.ravel(), minlength=n), "paths": seen.sum(axis=0)})
                for c in [*keys, "label"]:
                    out[c] = getattr(row, c)
                yield out[[*keys, "label", "day", "drawn", "paths"]]

    own = ", ".join(f"{c} {t}" for c, t in choices.select(*keys).dtypes)
    x = _chunks(choices, replications).mapInPandas(run, f"{own}, label string, day int, drawn long, paths long")
    return x.groupBy(*keys, "label", "day").agg(F.sum("drawn").alias("drawn"), F.sum("paths").alias("paths"))


def sampled(days: DataFrame, keys: list[str], mean_block: int, replications: int = inference.REPLICATIONS, seed: int = inference.SEED) -> DataFrame:
    """rep, step and all columns of days: paths as rows, of every account as many days as it has, drawn whole so that a
    day's values stay together. days has one row an account and day; other columns are free."""

    def run(it):
        for pdf in it:
            for row, rows in _drawn(pdf, seed):
                for at in range(0, len(rows), 50):
                    part = rows[at : at + 50]
                    n = part.shape[1]
                    out = pd.DataFrame({"rep": np.repeat(np.arange(len(part)) + row.chunk * row.size + at, n), "step": np.tile(np.arange(n), len(part)), "source": part.ravel()})
                    for c in keys:
                        out[c] = getattr(row, c)
                    yield out[[*keys, "rep", "step", "source"]]

    choices = packed(days, keys).select(*keys, "n", F.lit("fixed").alias("label"), F.lit(mean_block).alias("block"))
    own = ", ".join(f"{c} {t}" for c, t in choices.select(*keys).dtypes)
    drawn = _chunks(choices, replications).mapInPandas(run, f"{own}, rep long, step long, source long")
    numbered = days.withColumn("source", (F.row_number().over(Window.partitionBy(*keys).orderBy("day")) - 1).cast("long"))
    return drawn.join(numbered, [*keys, "source"]).select("rep", "step", *days.columns)


def foreign(days: DataFrame, sampled_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, what, at, times: path rows that are no source day with all its values, and paths of another length than
    their source; empty if the joint rows were kept. Rows are counted before they are compared, so the comparison is
    of distinct days."""
    rows = sampled_.groupBy(*days.columns).agg(F.count("*").alias("times"))
    source = days.distinct().withColumn("known", F.lit(True))
    odd = rows.join(source, _same(rows, source, days.columns), "left_anti").select(*keys, F.lit("row").alias("what"), F.col("day").cast("long").alias("at"), "times")
    n = days.groupBy(*keys).agg(F.count("*").alias("n"))
    short = sampled_.groupBy(*keys, "rep").agg(F.count("*").alias("times")).join(n, keys, "left").where("n IS NULL OR times <> n")
    return odd.unionByName(short.select(*keys, F.lit("length").alias("what"), F.col("rep").alias("at"), "times"))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & a[c].eqNullSafe(b[c])
    return same


def _rank(p: str) -> Column:
    """Place of the nearest-rank quantile, exact in decimals."""
    return F.ceil(F.lit(Decimal(p)) * F.col("paths")).cast("int")


def metrics(paths_: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of keys: paths, chances and counts of what replays() tells, nearest-rank quantiles of the values,
    and the mean of the worst twentieth of final returns (at least one). A key's values are as many as it has
    replications."""
    any_ = {
        "internal_any": F.col("internal_daily") | F.col("internal_trailing"), "any": F.col("daily") | F.col("trailing"),
        "earlier_internal_any": F.col("internal_daily") | F.col("earlier_internal_trailing"), "earlier_any": F.col("daily") | F.col("earlier_trailing"),
    }
    counted = {k: F.col(k) for k in HITS} | any_ | {"negative": F.col("final_return") < 0, "profit": F.col("growth") > 1}
    x = paths_.groupBy(*keys).agg(
        F.count("*").alias("paths"), *(F.count_if(c).alias(f"{k}_count") for k, c in counted.items()), *(F.sort_array(F.collect_list(v)).alias(v) for v in VALUES)
    )
    at = [F.element_at(v, _rank(p)).alias(f"{v}_p{p[2:]}") for v in VALUES for p in ("0.05", "0.50", "0.95")]
    worst = F.aggregate(F.slice("final_return", F.lit(1), _rank("0.05")), F.lit(0.0), lambda a, v: a + v) / _rank("0.05")
    return x.select(*keys, "paths", *(f"{k}_count" for k in counted), *((F.col(f"{k}_count") / F.col("paths")).alias(f"{k}_chance") for k in counted), *at, worst.alias("shortfall_05"))


def decided(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """measured with exact upper bounds of the chances of an internal breach (also with the earlier highs, which decides
    nothing) and of a negative return, and whether both pass."""

    @F.pandas_udf("double")
    def _upper(events: pd.Series, trials: pd.Series) -> pd.Series:
        return pd.Series([inference.clopper_pearson_upper(int(e), int(t)) for e, t in zip(events, trials)])

    x = measured
    for name, count in (("internal_upper", "internal_any_count"), ("earlier_internal_upper", "earlier_internal_any_count"), ("negative_upper", "negative_count")):
        x = x.withColumn(name, _upper(count, "paths"))
    return x.withColumn("breach_ok", F.col("internal_upper") <= limits.breach_chance).withColumn("negative_ok", F.col("negative_upper") <= limits.negative_chance)


def path_risk(days: DataFrame, keys: list[str], start: float, replications: int = inference.REPLICATIONS, seed: int = inference.SEED, limits: Limits = Limits()) -> DataFrame:
    """For every account and block length: metrics, bounds and passes; the row labelled plugin is the one that decides. A
    refused choice keeps its row, with its reason and nothing else. An account without days has no row."""
    path = files.scratch(days.sparkSession, "choices")
    chosen(packed(days, keys)).write.parquet(path)  # read twice, and by every task's recomputation
    choices = days.sparkSession.read.parquet(path)
    own = decided(metrics(replays(choices, keys, start, replications, seed, limits), [*keys, "label"]), limits)
    return choices.select(*keys, F.col("n").alias("days"), "label", "block", "reason").join(own, [*keys, "label"], "left")
