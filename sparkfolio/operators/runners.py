"""Walk-forward runs: parameters chosen on every training window, then traded over one continuous span."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins, stats, walkforward
from .signals import EntryRules, signals, simulate_positions

#: Fixed value: days of bars before a run's first entry, on which indicators warm up.
PREROLL_DAYS = 45
#: A combination of parameters: its name, stop and target in percent of the fill.
Combo = tuple[str, float, float]
TRADES = "is_long boolean, entry double, exit double, r double, error string"


def _positions(pdf: pd.DataFrame, tries: list[tuple], allowed: np.ndarray, rules: EntryRules, long_only: bool) -> pd.DataFrame:
    """Closed positions of one market's bars, in order, under each (name, stops, targets)."""
    o, h, lo, c = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close"))
    buy, sell = signals(o, h, lo, c, rules)
    ts, frames = pdf["ts"].to_numpy(), []
    for name, sl, tp in tries:
        t = pd.DataFrame(simulate_positions(o, h, lo, c, buy, sell, allowed, sl, tp, long_only), columns=["a", "b", "is_long", "entry", "exit"])
        a, b = t["a"].to_numpy(int), t["b"].to_numpy(int)
        entry, out, is_long = t["entry"].to_numpy(float), t["exit"].to_numpy(float), t["is_long"].to_numpy(bool)
        r = np.where(is_long, 1, -1) * (out - entry) / (entry * np.broadcast_to(sl, len(ts))[a] / 100)
        frames.append(pd.DataFrame({"combo": name, "ts_opened": ts[a], "ts_closed": ts[b], "is_long": is_long, "entry": entry, "exit": out, "r": r, "error": None}))
    return pd.concat(frames, ignore_index=True)


def _failed(e: Exception) -> pd.DataFrame:
    return pd.DataFrame({"combo": [None], "ts_opened": [pd.NaT], "ts_closed": [pd.NaT], "is_long": [None], "entry": [None], "exit": [None], "r": [None], "error": [f"{type(e).__name__}: {e}"]})


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in cols)


def _few(windows: DataFrame) -> DataFrame:
    """Windows, marked for a broadcast; ValueError when there are more than that allows."""
    if windows.limit(joins.MOST_WINDOWS + 1).count() > joins.MOST_WINDOWS:
        raise ValueError(f"more than {joins.MOST_WINDOWS} windows")
    return F.broadcast(windows)


def training_trades(bars: DataFrame, windows: DataFrame, combos: list[Combo], by: list[str], rules: EntryRules = EntryRules(), long_only: bool = False) -> DataFrame:
    """by, ordinal, combo, ts_opened, ts_closed, is_long, entry, exit, r, error: the closed positions of every market
    in every training window under every combination; entries from the window's start on, indicators warmed before.
    A task (market and window) is one group; one that fails is a row with its error. Bars travel once for each
    window that needs them."""
    w = windows.select("ordinal", "train_start", "train_end")
    x = bars.select(*by, "ts", "open", "high", "low", "close")
    x = x.join(_few(w), (F.col("ts") >= F.col("train_start") - F.expr(f"INTERVAL '{PREROLL_DAYS}' DAY")) & (F.col("ts") < F.col("train_end")))
    group, at = [*by, "ordinal"], bars.schema["ts"].dataType.simpleString()

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        try:
            out = _positions(pdf, combos, (pdf["ts"] >= pdf["train_start"]).to_numpy(), rules, long_only)
        except Exception as e:  # a task's fault is its result
            out = _failed(e)
        return out.assign(**{k: pdf[k].iloc[0] for k in group})[[*group, *out.columns]]

    return x.groupBy(*group).applyInPandas(f, f"{_kinds(x, group)}combo string, ts_opened {at}, ts_closed {at}, {TRADES}")


def choose(trades: DataFrame, tasks: DataFrame, combos: list[Combo], by: list[str], risk: float, least: int = 10) -> DataFrame:
    """by, ordinal, combo, is_return, error: each task's combination with the best score on a constant basis, the
    earliest on ties. Without any score the first combination, with return 0; a failed task has none."""
    group = [*by, "ordinal"]
    scores = stats.calmar(trades.where("error IS NULL").withColumn("pnl", F.col("r") * risk), [*group, "combo"], ["ts_closed", "ts_opened"], "pnl", 1.0, least, parts=True)
    place = F.array_position(F.array(*(F.lit(c[0]) for c in combos)), F.col("combo"))
    best = scores.where(F.col("score") > float("-inf")).groupBy(*group).agg(F.min_by(F.struct("combo", "total"), F.struct(-F.col("score"), place)).alias("b"))
    faults = trades.where("error IS NOT NULL").groupBy(*group).agg(F.min("error").alias("error"))
    x = tasks.select(*group).join(best, group, "left").join(faults, group, "left")
    return x.select(*group, F.when(F.col("error").isNull(), F.coalesce("b.combo", F.lit(combos[0][0]))).alias("combo"), F.coalesce("b.total", F.lit(0.0)).alias("is_return"), "error")


def continuous(bars: DataFrame, chosen: DataFrame, windows: DataFrame, combos: list[Combo], by: list[str], rules: EntryRules = EntryRules(), long_only: bool = False, matrix: bool = False) -> DataFrame:
    """by, combo, ts_opened, ts_closed, is_long, entry, exit, r, error of one run over the whole test span, combo null
    for the chosen parameters, of which each window's hold for the positions it opens. Entries only inside test
    windows that have parameters; no position is closed at a seam or at the end. With matrix also each combination held throughout, within
    the same windows. A market is one sequence, so one group; a market that fails is a row with its error."""
    w = windows.select("ordinal", "test_start", "test_end")
    span = w.agg((F.min("test_start") - F.expr(f"INTERVAL '{PREROLL_DAYS}' DAY")).alias("a"), F.max("test_end").alias("b"))
    x = bars.select(*by, "ts", "open", "high", "low", "close").join(F.broadcast(span), F.col("ts").between(F.col("a"), F.col("b"))).drop("a", "b")  # one row
    own_names = {c: f"__{c}" for c in by}  # both sides may stem from the same bars
    seg = chosen.where("combo IS NOT NULL").select(*(F.col(c).alias(n) for c, n in own_names.items()), "ordinal", "combo").join(_few(w), "ordinal")
    at, stops = bars.schema["ts"].dataType.simpleString(), {n: (s, t) for n, s, t in combos}

    def f(pdf: pd.DataFrame, seg: pd.DataFrame) -> pd.DataFrame:
        keys = {c: pdf[c].iloc[0] if len(pdf) else seg[n].iloc[0] for c, n in own_names.items()}
        pdf, seg = pdf.sort_values("ts", kind="stable").reset_index(drop=True), seg.sort_values("test_start").reset_index(drop=True)
        try:
            if not len(pdf) or not len(seg):
                raise ValueError("no bars" if len(seg) else "no parameters")
            k = np.searchsorted(seg["test_start"].to_numpy(), pdf["ts"].to_numpy(), "right") - 1
            allowed = (k >= 0) & (pdf["ts"].to_numpy() < seg["test_end"].to_numpy()[k])
            own = np.array([stops[c] for c in seg["combo"]], float)[np.maximum(k, 0)]
            out = _positions(pdf, [(None, own[:, 0], own[:, 1]), *(combos if matrix else [])], allowed, rules, long_only)
        except Exception as e:  # a market's fault is its result
            out = _failed(e)
        return out.assign(**keys)[[*by, *out.columns]]

    return x.groupBy(*by).cogroup(seg.groupBy(*own_names.values())).applyInPandas(f, f"{_kinds(x, by)}combo string, ts_opened {at}, ts_closed {at}, {TRADES}")


def attributed(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """trades and the ordinal of the window in which each has closed."""
    return joins.member(trades.where("error IS NULL"), windows.select("ordinal", "test_start", "test_end"), [], "ts_closed", "test_start", "test_end", "ordinal")


def walk_forward(bars: DataFrame, windows: DataFrame, combos: list[Combo], by: list[str], risk: float, rules: EntryRules = EntryRules(), long_only: bool = False, least: int = 10) -> DataFrame:
    """by, ordinal, combo, is_return, oos_return, oos_trades, oos_max_dd, error: a row a market and window. Parameters
    come from the window's training bars; the tests are one continuous run; returns are of a constant basis. ValueError
    when test windows overlap. A window whose training failed has its error, no combination and no entries; a market whose
    run failed has the error in each window."""
    if walkforward.overlapping(windows).limit(1).count():
        raise ValueError("test windows overlap")
    tasks = bars.select(*by).distinct().join(_few(windows.select("ordinal")))  # markets x windows is the result
    picked = choose(training_trades(bars, windows, combos, by, rules, long_only), tasks, combos, by, risk, least)
    run = continuous(bars, picked, windows, combos, by, rules, long_only)
    faults = run.where("error IS NOT NULL").select(*by, F.col("error").alias("fault"))
    oos = stats.calmar(attributed(run, windows).withColumn("pnl", F.col("r") * risk), [*by, "ordinal"], ["ts_closed", "ts_opened"], "pnl", 1.0, least, parts=True)
    x = picked.join(oos, [*by, "ordinal"], "left").join(faults, by, "left")
    return x.select(
        *by, "ordinal", "combo", "is_return", F.coalesce("total", F.lit(0.0)).alias("oos_return"), F.coalesce("n", F.lit(0)).alias("oos_trades"), F.coalesce("dd", F.lit(0.0)).alias("oos_max_dd"), F.coalesce("error", "fault").alias("error")
    )


def window_matrix(run: DataFrame, windows: DataFrame, by: list[str], risk: float) -> DataFrame:
    """by, ordinal, combo, ret of a run with matrix: what each combination held throughout returns in each window with
    a close."""
    return attributed(run.where("combo IS NOT NULL"), windows).groupBy(*by, "ordinal", "combo").agg((F.sum("r") * risk).alias("ret"))
