"""Streams of state events: windowed counts with watermarks, sessions, and transitions kept across batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_coverage(events: DataFrame, time: str, subject: str, state: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts of each state in tumbling (or sliding) windows; events later than the watermark are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(subject).alias("subject"), F.col(state).alias("state")).agg(F.count("*").alias("samples")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "subject", "state", "samples")


def sessions(events: DataFrame, time: str, subject: str, gap: str, late: str) -> DataFrame:
    """Sessions of a subject: stretches without a gap so long."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(subject).alias("subject")).agg(F.count("*").alias("samples")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "subject", "samples")


def transitions(events: DataFrame, time: str, subject: str, state: str) -> DataFrame:
    """(subject, s0, s1, n) for each batch: a subject's last state is kept, so a transition between two batches counts too. Rows of a batch are taken in time order."""
    kinds = dict(events.dtypes)

    def run(key: tuple[Any], batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        chain = ([kept.get[0]] if kept.exists else []) + rows[state].tolist()
        kept.update((chain[-1],))
        pairs = pd.DataFrame({"s0": chain[:-1], "s1": chain[1:]})
        if len(pairs):
            counted = pairs.groupby(["s0", "s1"]).size().reset_index(name="n")
            counted.insert(0, "subject", key[0])
            yield counted

    columns = events.select(F.col(subject).alias("subject"), time, state)
    return columns.groupBy("subject").applyInPandasWithState(run, f"subject {kinds[subject]}, s0 {kinds[state]}, s1 {kinds[state]}, n long", f"last {kinds[state]}", "append", GroupStateTimeout.NoTimeout)
