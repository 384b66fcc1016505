"""Published bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def pvc_per_24h(count: Column, analyzed_sec: Column, min_hours: float = C.MIN_HOURS) -> Column:
    """Premature beats scaled to a day; null with less analysed time than ``min_hours``."""
    return F.when(analyzed_sec >= min_hours * 3600, count * 86400.0 / analyzed_sec)


def pvc_24h_status(scaled: Column) -> Column:
    return F.when(scaled < 50, "ok").when(scaled <= 300, "caution").when(scaled.isNotNull(), "alert")


def count_status(n: Column) -> Column:
    return F.when(n == 0, "ok").otherwise("alert")


def run_rate_status(bpm: Column) -> Column:
    return F.when(bpm.isNull(), "ok").when(bpm >= 180, "alert").otherwise("caution")


def pause_status(sec: Column) -> Column:
    return F.when(sec.isNull() | (sec < C.PAUSE_SEC), "ok").when(sec <= C.LONG_PAUSE_SEC, "caution").otherwise("alert")


def analyzed_status(sec: Column, min_hours: float = C.MIN_HOURS) -> Column:
    return F.when(sec >= min_hours * 3600, "ok").otherwise("caution")
