"""Time axes: server clocks, loss days, swap nights and bar buckets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The loss day starts at 16:15 Chicago time; broker clocks run on Athens time; bars take 4 hours.
LOSS_DAY_ZONE, LOSS_DAY_SHIFT = "America/Chicago", "INTERVAL '7:45' HOUR TO MINUTE"
SERVER_ZONE, BAR_HOURS = "Europe/Athens", 4


def as_utc(ts: Column) -> Column:
    """Wall-clock timestamps without zone are read as UTC."""
    return ts.cast("timestamp")


def loss_day(ts: Column) -> Column:
    """Date of the loss day that holds an instant: the Chicago date, the next one from 16:15 on. Null stays null."""
    return F.to_date(F.from_utc_timestamp(as_utc(ts), LOSS_DAY_ZONE) + F.expr(LOSS_DAY_SHIFT))


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def bar_loss_day(ts_open: Column, hours: int = BAR_HOURS) -> Column:
    """A bar belongs to the loss day of its close."""
    return loss_day(ts_open + F.expr(f"INTERVAL '{hours}' HOUR"))


def calendar_day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def overlapped_loss_days(start: Column, end: Column) -> Column:
    """Array of the loss days that [start, end) touches; empty unless end is later."""
    last = loss_day(end - F.expr("INTERVAL '0.000001' SECOND"))
    return F.when(end > start, F.sequence(loss_day(start), last)).otherwise(F.array().cast("array<date>"))


def server_to_utc(ts: Column, zone: str | None = SERVER_ZONE, offset_hours: int = 0) -> Column:
    """Server wall clock to UTC: by a zone, by a fixed offset, or unchanged. Of two instants with one wall clock the
    earlier counts; a wall clock that daylight saving skips becomes the instant of the change."""
    if offset_hours:
        return ts - F.expr(f"INTERVAL '{offset_hours}' HOUR")
    if zone is None:
        return ts
    u = F.to_utc_timestamp(as_utc(ts), zone)
    # a skipped wall clock lies as far behind the change as its reading differs; the change is on a whole hour
    skipped = F.from_utc_timestamp(u, zone) != as_utc(ts)
    return F.when(skipped, F.date_trunc("HOUR", u)).otherwise(u)


def night_units(opened: Column, closed: Column, rollover: Column) -> Column:
    """Swap nights between two Athens dates: one for each weekday night held, three on the rollover weekday (0 is
    Monday), none at weekends. Counted in closed form, by whole weeks and the days left."""
    a, b = (F.to_date(F.from_utc_timestamp(as_utc(x), SERVER_ZONE)) for x in (opened, closed))
    nights = F.greatest(F.datediff(b, a), F.lit(0))
    first = F.weekday(a)
    weeks, rest = F.floor(nights / 7).cast("int"), F.pmod(nights, F.lit(7)).cast("int")

    def one(k: int) -> Column:
        day = F.pmod(first + k, F.lit(7))
        return F.when(F.lit(k) >= rest, 0).when(day >= 5, 0).when(day == rollover, 3).otherwise(1)

    left = sum((one(k) for k in range(6)), F.lit(0))
    return (weeks * 7 + left).cast("int")


def bar_start(ts: Column, hours: int = BAR_HOURS) -> Column:
    return F.window(ts, f"{hours} hours")["start"]


def window_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "yyyy-MM"), F.lit(".."), F.date_format(end, "yyyy-MM"))


def epoch_nanoseconds(ts: Column) -> Column:
    """Nanoseconds since 1970, whatever the unit of the timestamp's own storage."""
    return F.unix_micros(as_utc(ts)) * 1000


def anniversary(start: Column, months: int) -> Column:
    """The date so many months on; a day that its month lacks becomes the month's last."""
    return F.add_months(F.to_date(start), months)
