"""The risk state of live accounts: day start, highest balance, open risk by position, and what they allow. Once as a stream
whose state survives a restart, once as windows over all updates at once; both give the same rows.

An update is account, ts, seq (breaks ties of ts), kind, id, risk, balance, equity. Kinds: start sets the start and the
opening balance of its day; balance tells balance and equity; open and close a position (id, risk: null where nothing can
price it); entry asks whether a position of this risk may be opened, in place of the open position id if there is one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import timeaxis as tx
from ..operators import scans

UPDATE = "account string, ts timestamp, seq long, kind string, id long, risk double, balance double, equity double"
ROW = "account string, ts timestamp, seq long, kind string, day int, day_start double, high double, open_risk double, flatten string, refused string"
#: A loss day begins so long before its date does, as in timeaxis.LOSS_DAY_SHIFT.
SHIFT = pd.Timedelta(hours=7, minutes=45)
#: Fixed wording of decisions.
UNKNOWN, TRAILING, DAILY, CAP, TAIL = "unknown day start", "trailing stop", "daily stop", "open-risk cap", "stressed tail"


@dataclass(frozen=True)
class Budget:
    """Shares of the start, of the day's start and of equity, and the stress of all open stops at once."""

    trailing: float = 0.05
    daily: float = 0.025
    gate_daily: float = 0.027
    contract_daily: float = 0.03
    open_risk: float = 0.02
    stress: float = 1.5


def judged(x: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """x with trailing_floor, daily_floor, flatten and refused. x: start, day_start, high, open_risk (infinite where a
    position has no price), balance, equity, kind, risk, replaced (the risk of the position that an entry takes the
    place of). flatten names the floor that equity is at or under; refused what forbids an entry: the start isn't known, open risk
    would exceed its cap, or the stressed sum of all stops the tightest loss budget. Floating profit enlarges no budget."""
    start, day, high, equity = F.col("start"), F.col("day_start"), F.col("high"), F.col("equity")
    floor = F.least(start, high - budget.trailing * start)
    halt = day - budget.daily * day
    taken = F.greatest(F.lit(0.0), F.col("open_risk") - F.coalesce("replaced", F.lit(0.0))) + F.coalesce("risk", F.lit(float("inf")))
    ref = F.least(equity, day)
    room = F.least(ref - (day - budget.gate_daily * day), ref - (day - budget.contract_daily * day), F.least(equity, high) - floor)
    refused = F.when(start.isNull(), UNKNOWN).when(taken > budget.open_risk * equity, CAP).when(budget.stress * taken > room, TAIL)
    flatten = F.when(start.isNull(), UNKNOWN).when(equity <= floor, TRAILING).when(equity <= halt, DAILY)
    return x.withColumns({"trailing_floor": floor, "daily_floor": halt, "flatten": flatten, "refused": F.when(F.col("kind") == "entry", refused)})


def _decide(kind: str, s: dict, risk: float | None, replaced: float, b: Budget) -> tuple[str | None, str | None]:
    """judged() for one row of the stream."""
    if s["start"] is None:
        return UNKNOWN, UNKNOWN if kind == "entry" else None
    start, day, high, equity = s["start"], s["day_start"], s["high"], s["equity"]
    floor = min(start, high - b.trailing * start)
    flatten = TRAILING if equity <= floor else DAILY if equity <= day - b.daily * day else None
    if kind != "entry":
        return flatten, None
    left = s["open_risk"] - replaced
    taken = (left if left > 0 else 0.0) + (float("inf") if risk is None else risk)
    ref = min(equity, day)
    room = min(ref - (day - b.gate_daily * day), ref - (day - b.contract_daily * day), min(equity, high) - floor)
    return flatten, CAP if taken > b.open_risk * equity else TAIL if b.stress * taken > room else None


class Controller(StatefulProcessor):
    """An account's references in one state variable, its open positions in a map, and a timer at the next day roll."""

    def __init__(self, budget: Budget = Budget()) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.refs = handle.getValueState("references", "day int, start double, day_start double, high double, balance double, equity double")
        self.positions = handle.getMapState("positions", "id long", "risk double")

    def _state(self) -> dict:
        got = self.refs.get() if self.refs.exists() else (None,) * 6
        return dict(zip(("day", "start", "day_start", "high", "balance", "equity"), got))

    def _save(self, s: dict) -> None:
        self.refs.update(tuple(s[k] for k in ("day", "start", "day_start", "high", "balance", "equity")))

    @staticmethod
    def _roll(s: dict, day: int) -> bool:
        """A later day than the last one: the balance is banked, and the day starts with it."""
        if s["day"] is not None and day <= s["day"]:
            return False
        if s["day"] is not None and s["balance"] is not None and s["start"] is not None:
            s["high"], s["day_start"] = max(s["high"], s["balance"]), s["balance"]
        s["day"] = day
        return True

    def _open_risk(self) -> float:
        risks = [risk for _, (risk,) in self.positions.iterator()]
        return float("inf") if None in risks else round(sum(risks), 9)

    def _wake(self, day: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(next_roll(day))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        s, out = self._state(), []
        value = lambda x: None if pd.isna(x) else float(x)
        rolled, open_risk = False, self._open_risk()
        for r in frame.itertuples(index=False):
            rolled |= self._roll(s, int(r.day))
            risk, replaced = value(r.risk), 0.0
            if r.kind == "start":
                s |= {"start": value(r.balance), "day_start": value(r.balance), "balance": value(r.balance), "equity": value(r.equity)}
                s["high"] = s["start"] if s["high"] is None else max(s["high"], s["start"])
            elif r.kind == "balance":
                s |= {"balance": value(r.balance), "equity": value(r.equity)}
            elif r.kind == "open":
                self.positions.updateValue((int(r.id),), (risk,))
                open_risk = self._open_risk()
            elif r.kind == "close" and self.positions.containsKey((int(r.id),)):
                self.positions.removeKey((int(r.id),))
                open_risk = self._open_risk()
            elif r.kind == "entry" and not pd.isna(r.id) and self.positions.containsKey((int(r.id),)):
                replaced = self.positions.getValue((int(r.id),))[0] or 0.0
            flatten, refused = _decide(r.kind, s | {"open_risk": open_risk}, risk, replaced, self.budget)
            out.append((key[0], r.ts, r.seq, r.kind, s["day"], s["day_start"], s["high"], open_risk, flatten, refused))
        self._save(s)
        if rolled:
            self._wake(s["day"])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The day rolls though the account is still: its balance is banked on time."""
        s = self._state()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        if s["day"] is None or not self._roll(s, s["day"] + 1):
            return
        self._save(s)
        self._wake(s["day"])
        risk = self._open_risk()
        flatten, _ = _decide("roll", s | {"open_risk": risk}, None, 0.0, self.budget)
        yield pd.DataFrame([(key[0], at, None, "roll", s["day"], s["day_start"], s["high"], risk, flatten, None)], columns=[c.split()[0] for c in ROW.split(", ")])

    def close(self) -> None:
        pass


def next_roll(day: int) -> int:
    """Milliseconds of the instant at which the loss day after `day` begins."""
    local = pd.Timestamp("1970-01-01") + pd.Timedelta(days=day + 1) - SHIFT
    return int(local.tz_localize(tx.LOSS_DAY_ZONE).timestamp() * 1000)


def durable_state(spark: SparkSession) -> None:
    """State of several variables and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def risk_stream(updates: DataFrame, late: str = "10 minutes", budget: Budget = Budget()) -> DataFrame:
    """One row an update of the stream, and a row of kind roll for each day roll that an idle account's timer made. Rows of
    one batch are taken in order of ts and seq; one that comes later than its day's roll changes positions and balance
    but rolls nothing back. Call durable_state() before the query starts. An account's state is its open positions and
    six numbers."""
    x = updates.where("account IS NOT NULL AND ts IS NOT NULL").withColumn("day", tx.day_number(tx.loss_day(F.col("ts")))).withWatermark("ts", late)
    return x.groupBy("account").transformWithStateInPandas(Controller(budget), ROW, "Append", "EventTime")


def risk_table(updates: DataFrame, budget: Budget = Budget(), width: int | None = None) -> DataFrame:
    """The same rows (but for rolls of idle accounts) over all updates at once. close rows carry their position's risk, and
    position ids are opened once. width: days of an account that one task takes (see scans)."""
    order, whole = ["ts", "seq"], F.col("kind").isin("start", "balance")
    x = updates.where("account IS NOT NULL AND ts IS NOT NULL").withColumn("day", tx.day_number(tx.loss_day(F.col("ts"))))
    began, signed = F.when(F.col("kind") == "start", F.col("balance")), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)
    what = {
        "now": ("last", F.when(whole, F.col("balance"))), "held": ("last", F.when(whole, F.col("equity"))), "start": ("last", began), "first": ("max", began),
        "sum_risk": ("exact", signed * F.coalesce("risk", F.lit(0.0))), "bare": ("sum", F.when(F.col("risk").isNull(), signed)),
    }
    x = scans.running(x, ["account"], order, scans.cut_by(x, "ts", width), what)
    place = F.struct(*order)
    days = x.groupBy("account", "day").agg(F.when(F.max_by("start", place).isNotNull(), F.max_by("now", place)).alias("banked"))
    v = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("account", "day", F.last("banked", True).over(v).alias("before"), F.max("banked").over(v).alias("top"))
    today = Window.partitionBy("account", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(days, ["account", "day"])
    x = x.withColumns({
        "day_start": F.coalesce(F.last(began, True).over(today), F.when(F.col("start").isNotNull(), F.col("before"))), "high": F.greatest("first", "top"), "equity": F.col("held"),
        "open_risk": F.when(F.coalesce("bare", F.lit(0)) > 0, F.lit(float("inf"))).otherwise(F.round(F.coalesce("sum_risk", F.lit(0.0)), 9) + F.lit(0.0)),
    })
    closed = updates.where("kind = 'close'").select("account", F.col("id").alias("held_id"), place.alias("until"))
    opened = updates.where("kind = 'open'").select("account", F.col("id").alias("held_id"), F.col("risk").alias("replaced"), place.alias("since")).join(closed, ["account", "held_id"], "left")
    opened = opened.withColumnRenamed("account", "holder")
    alive = (F.col("since") < place) & (F.col("until").isNull() | (F.col("until") > place))
    x = x.join(opened, (F.col("kind") == "entry") & (F.col("account") == F.col("holder")) & (F.col("id") == F.col("held_id")) & alive, "left")
    return judged(x, budget).select(*(c.split()[0] for c in ROW.split(", ")))
