"""Calendar columns: Sunday weeks, cyclic encodings, flags and event windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published holiday windows, as (start, end), both inclusive.
RAMADAN = [("2023-03-23", "2023-04-20"), ("2024-03-11", "2024-04-09")]
EID_FITR = [("2023-04-21", "2023-04-23"), ("2024-04-10", "2024-04-12")]
HAJJ = [("2023-06-19", "2023-06-30"), ("2024-06-07", "2024-06-19")]
EID_ADHA = [("2023-06-28", "2023-07-01"), ("2024-06-16", "2024-06-19")]
HOLIDAYS = {"ramadan": RAMADAN, "eid_fitr": EID_FITR, "hajj": HAJJ, "eid_adha": EID_ADHA}

Windows = Sequence[tuple[str, str]]


def week_start_sunday(day: Column) -> Column:
    """The Sunday on or before the day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def weekday(day: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(day)


def cycle(position: Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    angle = F.lit(2.0 * harmonic) * F.pi() * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic(df: DataFrame, day: str, harmonics: Sequence[int] = (1,)) -> DataFrame:
    """Sine and cosine of weekday, month, day of year and ISO week."""
    d = F.col(day)
    positions = {
        "dow": (F.weekday(d).cast("double"), 7.0),
        "month": ((F.month(d) - 1).cast("double"), 12.0),
        "year": (F.dayofyear(d).cast("double"), 365.25),
        "week": (F.weekofyear(d).cast("double"), 52.18),
    }
    out = {}
    for name, (position, period) in positions.items():
        for k in harmonics if name in ("year", "week") else (1,):
            suffix = "" if k == 1 else str(k)
            s, c = cycle(position, period, k)
            out[f"{name}_sin{suffix}"], out[f"{name}_cos{suffix}"] = s, c
    return df.withColumns(out)


def in_windows(day: Column, windows: Windows) -> Column:
    """True when the day lies in any of the windows."""
    hit = F.lit(False)
    for start, end in windows:
        hit = hit | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return hit


def week_overlaps(week_start: Column, windows: Windows) -> Column:
    """True when the week [w, w+6] touches any of the windows."""
    hit = F.lit(False)
    for start, end in windows:
        hit = hit | (
            (week_start <= F.lit(end).cast("date"))
            & (F.date_add(week_start, 6) >= F.lit(start).cast("date"))
        )
    return hit


def is_weekend(day: Column) -> Column:
    """Friday and Saturday."""
    return F.weekday(day).isin(4, 5)


def calendar_flags(df: DataFrame, day: str) -> DataFrame:
    """0/1 flags for weekend, salary days, national days and period edges."""
    d = F.col(day)
    dom, month = F.dayofmonth(d), F.month(d)
    flags = {
        "weekend": is_weekend(d),
        "salary_25_28": dom.between(25, 28),
        "salary_24_31": dom.between(24, 31),
        "salary_25_03": (dom >= 25) | (dom <= 3),
        "founding_day": (month == 2) & (dom == 22),
        "founding_window": (month == 2) & dom.between(15, 29),
        "national_day": (month == 9) & (dom == 23),
        "national_window": (month == 9) & dom.between(16, 30),
        "month_start": dom <= 3,
        "month_end": dom >= F.dayofmonth(F.last_day(d)) - 2,
        "summer": month.isin(6, 7, 8),
        "year_end": (month == 12) & (dom >= 20),
    }
    return df.withColumns({name: flag.cast("int") for name, flag in flags.items()})


def next_days_count(day: Column, flag, days: int = 7) -> Column:
    """How many of the next `days` days satisfy `flag(day)`."""
    ahead = F.sequence(F.date_add(day, 1), F.date_add(day, days))
    return F.size(F.filter(ahead, flag))


def next7_counts(df: DataFrame, day: str, windows: Mapping[str, Windows]) -> DataFrame:
    """Known-in-advance flags counted over the coming week."""

    def inside(w: Windows):
        return lambda d: in_windows(d, w)

    out = {f"{name}_next7": next_days_count(F.col(day), inside(w)) for name, w in windows.items()}
    out["weekend_next7"] = next_days_count(F.col(day), is_weekend)
    return df.withColumns(out)


def event_windows(
    df: DataFrame, day: str, events: Sequence[str], before: int = 7, after: int = 3, horizon: int = 60
) -> DataFrame:
    """Pre / on / post flags around anchor dates and days to the next anchor.

    The distance is clipped to `horizon` and scaled to 0..1; with no later
    anchor it is 1.
    """
    d = F.col(day)
    anchors = F.array(*[F.lit(e).cast("date") for e in sorted(events)])
    ahead = F.array_min(
        F.transform(F.filter(anchors, lambda e: e >= d), lambda e: F.datediff(e, d))
    )
    return df.withColumns(
        {
            "event_pre": F.exists(
                anchors, lambda e: F.datediff(e, d).between(1, before)
            ).cast("int"),
            "event_day": F.exists(anchors, lambda e: e == d).cast("int"),
            "event_post": F.exists(
                anchors, lambda e: F.datediff(d, e).between(1, after)
            ).cast("int"),
            "days_to_event": F.least(F.coalesce(ahead, F.lit(horizon)), F.lit(horizon)) / F.lit(float(horizon)),
        }
    )


def anchor_spans(df: DataFrame, day: str, anchors: Sequence[str], spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """A 0/1 flag per span: the day stands lo to hi days after an anchor, both
    included; negative numbers lie before it."""
    dates = F.array(*[F.lit(a).cast("date") for a in sorted(anchors)])

    def inside(lo: int, hi: int) -> Column:
        return F.exists(dates, lambda a: F.datediff(F.col(day), a).between(lo, hi)).cast("int")

    return df.withColumns({name: inside(lo, hi) for name, (lo, hi) in spans.items()})


def window_phase(df: DataFrame, day: str, windows: Windows, prefix: str, length: int = 30) -> DataFrame:
    """Whether a window runs, the day's share of `length`, its place on that
    circle (0, 0 outside) and which run of ten days it falls in."""
    d, number = F.col(day), F.lit(0)
    for start, end in windows:
        first = F.lit(start).cast("date")
        number = F.when(d.between(first, F.lit(end).cast("date")), F.datediff(d, first) + 1).otherwise(number)
    running = number > 0
    angle = 2 * F.pi() * number / float(length)
    return df.withColumns(
        {
            f"{prefix}_runs": running.cast("int"),
            f"{prefix}_share": number / float(length),
            f"{prefix}_first10": number.between(1, 10).cast("int"),
            f"{prefix}_middle10": number.between(11, 20).cast("int"),
            f"{prefix}_last10": number.between(21, 30).cast("int"),
            f"{prefix}_sin": F.when(running, F.sin(angle)).otherwise(0.0),
            f"{prefix}_cos": F.when(running, F.cos(angle)).otherwise(0.0),
        }
    )


def window_progress(df: DataFrame, day: str, windows: Windows, prefix: str) -> DataFrame:
    """Day number inside the running window and which third of it."""
    d = F.col(day)
    number, third = F.lit(0), F.lit(0)
    for start, end in windows:
        s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
        inside = d.between(s, e)
        position = F.datediff(d, s)
        length = F.datediff(e, s) + 1
        number = F.when(inside, position + 1).otherwise(number)
        third = F.when(inside, (F.floor(position * 3 / length) + 1).cast("int")).otherwise(third)
    return df.withColumns({f"{prefix}_day": number, f"{prefix}_third": third})
