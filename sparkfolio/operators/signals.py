"""Entry signals and position simulation: state machines that run once per group of bars."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .indicators import ema, rsi, smoothed


@dataclass(frozen=True)
class EntryRules:
    """Fixed values of the strategy. Lengths in bars, levels in the units of their indicator."""

    band: int = 20
    band_width: float = 2.0
    range_: int = 14
    strength: int = 14
    mean: int = 10
    strength_scale: float = 100.0
    #: Buys: the low was under the band in the last `under_band` bars, %R under `oversold` in the last `weak`
    #: bars, this one included, and the strength is under `buy_below`.
    need_band: bool = True
    need_range: bool = True
    need_strength: bool = True
    under_band: int = 4
    weak: int = 7
    oversold: float = -80.0
    buy_below: float = 40.0
    #: Sells: a body of at least so many percent; `strong` of the `wait` bars before over `sell_above`.
    body_pct: float = 0.12
    wait: int = 4
    sell_above: float = 70.0
    strong: int = 3

    @property
    def first(self) -> int:
        """Bars before which nothing is judged."""
        return 2 + max(self.under_band + self.band, self.weak + self.range_, self.wait + 2, self.mean + 2, self.strength + 2)

    @property
    def memory(self) -> int:
        """Bars before one on which its signals can depend, beside the mean and the strength: what its conditions look
        back, those of a fall that may still wait, and the bar before for where they begin."""
        return self.first + self.wait + 2


def _before(x: np.ndarray, k: int, fill=False) -> np.ndarray:
    """x of k bars ago."""
    return np.concatenate([np.full(min(k, len(x)), fill, x.dtype), x[: max(0, len(x) - k)]])


def _edges(raw: np.ndarray, judged: np.ndarray) -> np.ndarray:
    """True where a judged condition begins."""
    raw = raw & judged
    return raw & ~_before(raw, 1)


def _last(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over the last n values, whatever came before them; nan until there are n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def signals(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, p: EntryRules = EntryRules()) -> tuple[np.ndarray, np.ndarray]:
    """Buy and sell of every bar of one sequence, from its first bar on: judge() with its own mean and strength."""
    judged = np.arange(len(close)) + 1 >= p.first
    return judge(open_, high, low, close, ema(close, p.mean), rsi(close, p.strength, p.strength_scale), judged, p)


#: Slopes of the mean that rounding alone can make, as a share of it.
LEVEL = 1e-12


def judge(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, mean: np.ndarray, strength: np.ndarray, judged: np.ndarray, p: EntryRules = EntryRules()) -> tuple[np.ndarray, np.ndarray]:
    """Boolean buy and sell of every bar; conditions count where they begin. Buy: a rising bar across the lower
    band, with the confirmations. Sell: %R falls through -20 on a falling bar while the mean falls, or while it
    rises after enough strong bars (or whatever the strength, if that isn't needed). A fall against a rising mean
    without them waits: for some bars, the first falling bar that closes under its high, with a falling mean, once
    its low has been undercut, sells. A later such fall begins the wait anew."""
    n = len(close)
    band = _last(close, p.band, np.mean) - p.band_width * _last(close, p.band, np.std)
    top, bottom = _last(high, p.range_, np.max), _last(low, p.range_, np.min)
    some = top > bottom
    wr = np.where(some, 100 * (close - top) / np.where(some, top - bottom, 1), 0.0)
    slope = np.diff(mean, prepend=mean[:1])
    slope = np.where(np.abs(slope) <= LEVEL * np.abs(mean), 0.0, slope)

    with np.errstate(invalid="ignore"):
        dipped, weak = low < band, wr < p.oversold
        buy = (close > open_) & (low <= band) & (high >= band)
    if p.need_band:
        buy &= np.any([_before(dipped, k) for k in range(1, p.under_band + 1)], axis=0)
    if p.need_range:
        buy &= np.any([_before(weak, k) for k in range(p.weak)], axis=0)
    if p.need_strength:
        buy &= strength < p.buy_below

    wr_before = _before(wr, 1, 0.0)
    body = np.divide(100 * np.abs(close - open_), open_, out=np.zeros(n), where=open_ != 0)
    fall = _edges((close < open_) & (wr < wr_before) & (wr < -20) & (wr_before > -20) & (body >= p.body_pct), judged)
    strong = np.sum([_before(strength > p.sell_above, k) for k in range(1, p.wait + 1)], axis=0) >= p.strong
    at_once = fall & ((slope < 0) | (slope > 0) & (strong | (not p.need_strength)))
    waits = np.flatnonzero(fall & (slope > 0) & ~at_once)
    late = np.zeros(n, bool)
    ready = (close < open_) & (slope < 0)
    for k, at in enumerate(waits):  # few: each looks at the next bars only
        until = min(at + p.wait + 1, n, waits[k + 1] if k + 1 < len(waits) else n)
        span = slice(at + 1, until)
        hit = np.flatnonzero(ready[span] & (close[span] < high[at]) & np.logical_or.accumulate(low[span] < low[at]))
        if len(hit):
            late[at + 1 + hit[0]] = True
    return _edges(buy, judged), at_once | late


def _in_blocks(bars: DataFrame, by: list[str], p: EntryRules, width: int, block: int) -> DataFrame:
    """signal_table() by blocks of a market: its mean and strength are recurrences, taken over whole markets as scans; all
    else has a bounded memory, so a block judges its own bars behind the last ones of the block before."""
    x = smoothed(bars.select(*by, "ts", "open", "high", "low", "close"), by, p.mean, p.strength, p.strength_scale, width)
    x = scans.numbered(x, by, ["ts"], scans.cut_by(x, "ts", width), "__at")
    block, at = max(block, p.memory), F.col("__at") - 1
    own = F.floor(at / block)
    where = F.when(at % block >= block - p.memory, F.array(own, own + 1)).otherwise(F.array(own))
    x = x.withColumn("__block", F.explode(where)).withColumn("__own", F.col("__block") == own)
    kinds = ", ".join(f"{c} {bars.schema[c].dataType.simpleString()}" for c in [*by, "ts"])

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        buy, sell = judge(*(pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "ema", "rsi")), (pdf["__at"] >= p.first).to_numpy(), p)
        return pdf[[*by, "ts"]].assign(buy=buy, sell=sell)[pdf["__own"].to_numpy(bool)]

    return x.groupBy(*by, "__block").applyInPandas(f, f"{kinds}, buy boolean, sell boolean")


def signal_table(bars: DataFrame, by: list[str], p: EntryRules = EntryRules(), width: int | None = None, block: int = 50_000) -> DataFrame:
    """by, ts, buy, sell for every bar; one group is one sequence. width: days of a group that one task takes (see scans),
    block: bars that one task judges; without a width a group is one task."""
    if width is not None:
        return _in_blocks(bars, by, p, width, block)
    kinds = ", ".join(f"{c} {bars.schema[c].dataType.simpleString()}" for c in [*by, "ts"])

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        buy, sell = signals(*(pdf[c].to_numpy(float) for c in ("open", "high", "low", "close")), p)
        return pdf[[*by, "ts"]].assign(buy=buy, sell=sell)

    return bars.select(*by, "ts", "open", "high", "low", "close").groupBy(*by).applyInPandas(f, f"{kinds}, buy boolean, sell boolean")


def simulate_positions(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, buy: np.ndarray, sell: np.ndarray, allowed: np.ndarray, sl_pct: float | np.ndarray, tp_pct: float | np.ndarray, long_only: bool = False) -> list[tuple]:
    """(opened bar, closed bar, is_long, entry, exit). A signal fills at the next bar's open; stop and target hang on
    the fill. A bar that opens beyond the stop fills there; a bar that reaches both counts as the stop. An opposite
    signal closes and, unless long_only, reverses; entries need `allowed`; an open position at the end stays open. Stops
    and targets may differ by bar: those of the bar that fills hold for the position's life."""
    out, pos = [], None
    sls, tps = np.broadcast_to(sl_pct, len(close)), np.broadcast_to(tp_pct, len(close))
    for i in range(1, len(close)):
        want = 1 if buy[i - 1] else -1 if sell[i - 1] else 0
        if want and pos and pos[1] != want:
            out.append((pos[0], i, pos[1] > 0, pos[2], open_[i]))
            pos = None
        if want and pos is None and allowed[i] and (want > 0 or not long_only):
            e = open_[i]
            pos = (i, want, e, e * (1 - want * sls[i] / 100), e * (1 + want * tps[i] / 100))
        if pos:
            _, side, e, stop, target = pos
            hit_stop = low[i] <= stop if side > 0 else high[i] >= stop
            hit_target = high[i] >= target if side > 0 else low[i] <= target
            if hit_stop or hit_target:
                gap = min(open_[i], stop) if side > 0 else max(open_[i], stop)
                out.append((pos[0], i, side > 0, e, gap if hit_stop else target))
                pos = None
    return out


def backtest(bars: DataFrame, params: DataFrame, by: list[str], p: EntryRules = EntryRules(), long_only: bool = False) -> DataFrame:
    """params: combo, sl_pct, tp_pct, a small table. by, combo, ts_opened, ts_closed, is_long, entry, exit, r: closed
    positions of every group under every combination; each group's bars travel once, whatever the combinations."""
    combos = [tuple(r) for r in params.select("combo", "sl_pct", "tp_pct").collect()]  # a parameter grid
    kinds = ", ".join(f"{c} {bars.schema[c].dataType.simpleString()}" for c in by)
    ts = bars.schema["ts"].dataType.simpleString()

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        o, h, lo, c = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close"))
        buy, sell = signals(o, h, lo, c, p)
        frames = []
        for combo, sl, tp in combos:
            t = pd.DataFrame(simulate_positions(o, h, lo, c, buy, sell, np.ones(len(c), bool), sl, tp, long_only), columns=["a", "b", "is_long", "entry", "exit"])
            side = np.where(t["is_long"].astype(bool), 1, -1)
            r = side * (t["exit"] - t["entry"]) / (t["entry"] * sl / 100)
            frames.append(pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "combo": combo, "ts_opened": pdf["ts"].to_numpy()[t["a"].astype(int)], "ts_closed": pdf["ts"].to_numpy()[t["b"].astype(int)], "is_long": t["is_long"].astype(bool), "entry": t["entry"].astype(float), "exit": t["exit"].astype(float), "r": r.astype(float)}, index=range(len(t))))
        return pd.concat(frames)[[*by, "combo", "ts_opened", "ts_closed", "is_long", "entry", "exit", "r"]]

    return bars.select(*by, "ts", "open", "high", "low", "close").groupBy(*by).applyInPandas(f, f"{kinds}, combo string, ts_opened {ts}, ts_closed {ts}, is_long boolean, entry double, exit double, r double")
