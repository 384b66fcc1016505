"""Numbers and times as the text of a report; halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int = 0) -> Column:
    """Null stays null; Spark would format it as text. What counts as a half is seen on the scaled double, as SQL engines do it."""
    scale = F.lit(10.0**places)
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.rint(value * scale) / scale))


def duration(sec: Column) -> Column:
    return F.format_string("%dh %dm", F.floor(sec / 3600), F.floor(sec % 3600 / 60))


def _clock(sec: Column, start: Column, pattern: str) -> Column:
    none = F.lit(0)
    return F.date_format(start + F.make_dt_interval(none, none, none, sec.cast("decimal(18,6)")), pattern)


def moment(sec: Column, start: Column) -> Column:
    """Time of the clock, or the seconds passed if the start is unknown."""
    return F.when(start.isNull(), F.concat(F.lit("t="), fixed(sec), F.lit("s"))).otherwise(_clock(sec, start, "HH:mm:ss"))


def hour(sec: Column, start: Column) -> Column:
    passed = F.format_string("%d:%02d", F.floor(sec / 3600), F.floor(sec % 3600 / 60))
    return F.when(start.isNull(), passed).otherwise(_clock(sec, start, "HH:mm"))


def share(n: Column, total: Column) -> Column:
    """``n (p%)``; of nothing, ``0 (0%)``."""
    return F.when(total > 0, F.concat(n.cast("string"), F.lit(" ("), fixed(100.0 * n / total), F.lit("%)"))).otherwise("0 (0%)")
