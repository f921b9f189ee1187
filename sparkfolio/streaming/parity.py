"""Live bars against reference bars as two streams: joined on their time, replayed through the signals side by side."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import signals

PRICES = ("open", "high", "low", "close")
PAIR = "market string, ts timestamp, " + ", ".join(f"{side}_{c} double" for side in ("live", "ref") for c in PRICES)
JUDGED = "market string, ts timestamp, warm boolean, live_buy boolean, live_sell boolean, ref_buy boolean, ref_sell boolean, agree boolean"


def paired(live: DataFrame, reference: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars of both sides at one market and time; both sides: market, ts (timestamp) and prices. As streams each side
    waits for the other until the watermark, the latest ts less `late`, has passed it."""
    side = lambda df, name, ts: df.select("market" if name == "live" else F.col("market").alias("ref_market"), F.col("ts").alias(ts), *(F.col(c).cast("double").alias(f"{name}_{c}") for c in PRICES)).withWatermark(ts, late)
    x = side(live, "live", "ts").join(side(reference, "ref", "ref_ts"), F.expr("market = ref_market AND ts = ref_ts"))
    return x.select(*(c.split()[0] for c in PAIR.split(", ")))


def judged(pdf: pd.DataFrame, rules: signals.EntryRules, before: int = 0) -> pd.DataFrame:
    """Both sides' signals of one market's pairs, in order; before: pairs that came before the first one."""
    pdf = pdf.sort_values("ts", kind="stable")
    out = pdf[["market", "ts"]].copy()
    out["warm"] = [before + k + 1 >= rules.first for k in range(len(pdf))]
    for side in ("live", "ref"):
        out[f"{side}_buy"], out[f"{side}_sell"] = signals.signals(*(pdf[f"{side}_{c}"].to_numpy(float) for c in PRICES), rules)
    out["agree"] = (out["live_buy"] == out["ref_buy"]) & (out["live_sell"] == out["ref_sell"])
    return out


class Replay(StatefulProcessor):
    """A market's last `history` pairs as a list and the number of those before them; a new pair is judged once."""

    def __init__(self, rules: signals.EntryRules, history: int) -> None:
        self.rules, self.history = rules, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", PAIR)
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAIR.split(", ")]
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")[names]
        old = pd.DataFrame(list(self.pairs.get()), columns=names) if self.pairs.exists() else new.iloc[:0]
        before = self.dropped.get()[0] if self.dropped.exists() else 0
        every = pd.concat([old, new]) if len(old) else new
        out = judged(every, self.rules, before)
        out = out[out["ts"].isin(set(new["ts"]))]
        every = every.sort_values("ts", kind="stable")
        kept = every.iloc[-self.history :]
        self.pairs.put([(r[0], r[1].to_pydatetime(), *map(float, r[2:])) for r in kept.itertuples(index=False, name=None)])
        self.dropped.update((int(before + len(every) - len(kept)),))
        yield out[[c.split()[0] for c in JUDGED.split(", ")]]

    def close(self) -> None:
        pass


def signal_stream(live: DataFrame, reference: DataFrame, rules: signals.EntryRules = signals.EntryRules(), late: str = "1 day", history: int = 500) -> DataFrame:
    """One row a pair of bars: both sides' signals, and whether they agree. Signals follow the last `history` pairs, as
    cycles do. Call risk.durable_state() before the query starts."""
    return paired(live, reference, late).groupBy("market").transformWithStateInPandas(Replay(rules, history), JUDGED, "Append", "None")


def signal_table(live: DataFrame, reference: DataFrame, rules: signals.EntryRules = signals.EntryRules()) -> DataFrame:
    """The same over all pairs at once, each market from its first pair on."""
    return paired(live, reference).groupBy("market").applyInPandas(lambda pdf: judged(pdf, rules), JUDGED)


def agreement(table: DataFrame) -> DataFrame:
    """market, agree, disagree: bars that both sides judged, warmed up."""
    return table.groupBy("market").agg(F.count_if(F.col("warm") & F.col("agree")).alias("agree"), F.count_if(F.col("warm") & ~F.col("agree")).alias("disagree"))
