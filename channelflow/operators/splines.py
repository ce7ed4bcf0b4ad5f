"""Repair of bad channels by spherical splines (Perrin et al., 1989).

The montage gives a small linear system for each set of bad channels; what comes of it is a row of weights a bad channel, applied to samples as an expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelflow.functions import vectors as V

ORDER, TERMS, SMOOTHING = 4, 50, 1e-5


def on_sphere(angle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Unit vectors of a montage's places: degrees from the front to the right, and distance from the top, half of one at the equator."""
    a, down = np.radians(angle), np.pi * np.asarray(radius, dtype=float)
    return np.stack((np.sin(down) * np.sin(a), np.sin(down) * np.cos(a), np.cos(down)), axis=-1)


def kernel(cosine: np.ndarray, order: int = ORDER, terms: int = TERMS) -> np.ndarray:
    """Sum over n of (2 n + 1) / (n (n + 1)) ** order P_n / (4 pi), P_n by the recurrence of Legendre's polynomials."""
    before, now, total = np.ones_like(cosine), cosine, np.zeros_like(cosine)
    for n in range(1, terms + 1):
        total = total + (2 * n + 1) / (n * (n + 1.0)) ** order * now
        before, now = now, ((2 * n + 1) * cosine * now - n * before) / (n + 1)
    return total / (4 * np.pi)


def interpolation(places: np.ndarray, bad: np.ndarray, order: int = ORDER, terms: int = TERMS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Weights (bad x all channels, 0 for bad ones) by which the good channels' spline gives the bad ones' values."""
    good = ~bad
    n = int(good.sum())
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = kernel(np.clip(places[good] @ places[good].T, -1, 1), order, terms) + smoothing * np.eye(n)
    system[n, n] = 0
    to = np.c_[kernel(np.clip(places[bad] @ places[good].T, -1, 1), order, terms), np.ones(int(bad.sum()))]
    out = np.zeros((int(bad.sum()), len(places)))
    out[:, good] = (to @ np.linalg.pinv(system))[:, :n]
    return out


def spline_weights(bads: DataFrame, places: DataFrame, order: int = ORDER, terms: int = TERMS, smoothing: float = SMOOTHING) -> DataFrame:
    """subject and rows array<array<double>>: by channel, the weights of all channels for a bad one, null for a good one. bads(subject, ch), places(ch, angle, radius); channels are numbered from 0.

    Without a good channel a bad one's weights are an empty array. Bad channels that the montage doesn't have are left out.
    """
    kind = dict(bads.dtypes)["subject"]
    montage = places.agg(F.array_sort(F.collect_list(F.struct("ch", F.col("angle").cast("double").alias("angle"), F.col("radius").cast("double").alias("radius")))).alias("places"))
    sets = bads.select("subject", "ch").distinct().groupBy("subject").agg(F.array_sort(F.collect_list(F.col("ch").cast("int"))).alias("bad")).join(F.broadcast(montage), how="cross")  # one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, list] = {}
        for batch in batches:
            found = []
            for bad, where in zip(batch["bad"], batch["places"], strict=True):
                key = tuple(bad)
                if key not in known:
                    numbers = [p["ch"] for p in where]
                    rows: list = [None] * (max(numbers) + 1)
                    mask = np.isin(numbers, bad)
                    at = on_sphere(np.array([p["angle"] for p in where]), np.array([p["radius"] for p in where]))
                    weights = interpolation(at, mask, order, terms, smoothing) if not mask.all() else np.zeros((len(numbers), 0))
                    for ch, w in zip(np.array(numbers)[mask], weights, strict=True):
                        row = np.zeros(len(rows) if len(w) else 0)
                        row[np.array(numbers)[: len(w)]] = w
                        rows[ch] = row.tolist()
                    known[key] = rows
                found.append(known[key])
            yield pd.DataFrame({"subject": batch["subject"], "rows": found})

    return sets.mapInPandas(run, f"subject {kind}, rows array<array<double>>")


def weighed(row: Column, v: Column) -> Column:
    """The sum of v by the weights; what has none may be null. Null without weights."""
    return F.when(F.size(row) > 0, V.total(F.zip_with(row, v, lambda w, x: F.when(w == 0, 0.0).otherwise(w * x))))


def spline_repaired(samples: DataFrame, bads: DataFrame, places: DataFrame, **options: float) -> DataFrame:
    """samples(subject, t, v) with the channels of bads(subject, ch) replaced by what the spherical spline through the subject's others gives. Subjects without bad channels stay as they are."""
    joined = samples.join(spline_weights(bads, places, **options), "subject", "left")
    one = lambda x, i: F.when(F.get("rows", i).isNull(), x).otherwise(weighed(F.get("rows", i), F.col("v")))
    return joined.select("subject", "t", F.when(F.col("rows").isNull(), F.col("v")).otherwise(F.transform("v", one)).alias("v"))
