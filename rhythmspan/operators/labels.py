"""Labels of beats against their recent normal rhythm."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..ordered import Rows, walked

LABELLED = "recording_id string, beat_idx long, time_sec double, rr_sec double, qrs_sec double, label string, rr_base double, qrs_base double"


def _middle(values: list[float]) -> float:
    """Median of a few numbers."""
    ordered, half = sorted(values), len(values) // 2
    return ordered[half] if len(values) % 2 else (ordered[half - 1] + ordered[half]) / 2


class _Baseline:
    """Labels beats in order; each beat found normal moves the rhythm that the next ones are held against.

    What is kept between beats is the last normal intervals and widths, and their medians.
    """

    def __init__(self, size: int = C.BASELINE_BEATS):
        self.normal, self.usual = deque(maxlen=size), None

    def _judge(self, rr: float, qrs: float) -> str:
        if math.isnan(rr) or math.isnan(qrs):
            return "U"
        if self.usual is None:
            return "N"
        usual_rr, usual_qrs = self.usual
        if qrs <= C.WIDE_RATIO * usual_qrs or qrs - usual_qrs < C.WIDE_MARGIN_SEC:
            return "N"
        return "V" if rr < C.PREMATURE_RATIO * usual_rr else "E" if rr >= C.LATE_RATIO * usual_rr else "N"

    def take(self, rows: Rows) -> Rows:
        bases, labels = [], []
        for pair in zip(rows["rr_sec"].tolist(), rows["qrs_sec"].tolist(), strict=True):
            bases.append(self.usual or (math.nan, math.nan))
            labels.append(self._judge(*pair))
            if labels[-1] == "N":
                self.normal.append(pair)
                self.usual = tuple(_middle(list(v)) for v in zip(*self.normal, strict=True))
        usual_rr, usual_qrs = np.array(bases).T
        return rows | {"label": np.array(labels, object), "rr_base": usual_rr, "qrs_base": usual_qrs}

    def rest(self) -> None:
        return None


def label_beats(beats: DataFrame) -> DataFrame:
    """``LABELLED``: recordings side by side, each in time order and a batch of beats at a time.

    U without both measures; N without a baseline; V if wide and early; E if wide and late; else N.
    ``rr_base, qrs_base`` are medians of the last normal beats. No frame of rows can express it, since
    labels decide what is in the frame.
    """
    rows = beats.select("recording_id", "beat_idx", "time_sec", F.col("rr_sec").cast("double"), F.col("qrs_sec").cast("double"))
    return walked(rows, ("recording_id",), ("time_sec", "beat_idx"), _Baseline, LABELLED)


def typical(beats: DataFrame, normal: int = 8, reach: int = 40) -> DataFrame:
    """Add ``typical_rr, typical_qrs``: medians of the last N beats with both measures among the preceding ones."""
    before = Window.partitionBy("recording_id").orderBy("time_sec", "beat_idx").rowsBetween(-reach, -1)
    fit = F.when((F.col("label") == "N") & F.col("rr_sec").isNotNull() & F.col("qrs_sec").isNotNull(), F.struct("rr_sec", "qrs_sec"))
    rows = beats.withColumn("__near", F.collect_list(fit).over(before))
    rows = rows.withColumn("__near", F.slice("__near", F.greatest(F.size("__near") - normal + 1, F.lit(1)), normal))
    middle = lambda c: (c[F.floor((F.size(c) - 1) / 2).cast("int")] + c[F.floor(F.size(c) / 2).cast("int")]) / 2
    of = lambda name: F.when(F.size("__near") > 0, middle(F.sort_array(F.transform("__near", lambda x: x[name]))))
    return rows.withColumns({"typical_rr": of("rr_sec"), "typical_qrs": of("qrs_sec")}).drop("__near")
