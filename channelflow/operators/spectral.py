"""Spectra of recordings: Welch periodograms, band powers, filters, in blocks of time. Resampling alone takes a channel's whole series as one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import in_bands


def welch(samples: DataFrame, sfreq: float = 500, segment: int = 1000, overlap: int = 750, together: int = 64) -> DataFrame:
    """samples(subject, t, ch, x) as (subject, ch, f, p): mean periodogram of overlapping segments, Hamming window, mean taken off, one-sided density. Shorter series give one segment of their own.

    t counts from 0 without gaps. A task has `together` segments of a channel and gives their sums by frequency, so a long channel is many tasks.
    """
    kind = dict(samples.dtypes)["subject"]
    lengths = samples.groupBy("subject", "ch").agg(F.count("*").alias("whole"))
    rows = samples.select("subject", "t", "ch", "x").join(lengths, ["subject", "ch"])
    n = F.least("whole", F.lit(segment)).cast("int")
    step = F.when(n > 1, F.greatest(n - F.least(F.lit(overlap), n - 1), F.lit(1))).otherwise(1)
    rows = rows.withColumn("n", n).withColumn("step", step)
    last = F.least(F.floor(F.col("t") / F.col("step")), F.floor((F.col("whole") - F.col("n")) / F.col("step")))
    first = F.greatest(F.ceil((F.col("t") - F.col("n") + 1) / F.col("step")), F.lit(0))
    dealt = rows.where(first <= last).withColumn("group", F.explode(F.sequence(F.floor(first / together), F.floor(last / together))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        whole, n, step, group = (int(part[c].iloc[0]) for c in ("whole", "n", "step", "group"))
        begin = group * together * step
        x = part["x"].to_numpy(dtype=float)
        count = min(together, (whole - n) // step + 1 - group * together)
        x = x[int(begin - part["t"].iloc[0]) :]
        w = np.hamming(n + 1)[:-1]
        parts = np.stack([x[i * step : i * step + n] for i in range(count)])
        p = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2).sum(axis=0) / (sfreq * (w**2).sum())
        p[1 : None if n % 2 else -1] *= 2
        return pd.DataFrame({"subject": part["subject"].iloc[0], "ch": part["ch"].iloc[0], "f": np.fft.rfftfreq(n, 1 / sfreq), "p": p, "m": count})

    sums = dealt.groupBy("subject", "ch", "group").applyInPandas(run, f"subject {kind}, ch int, f double, p double, m long")
    return sums.groupBy("subject", "ch", "f").agg((F.sum("p") / F.sum("m")).alias("p"))


def simpson_band_power(spectrum: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spectrum(keys, f, p) and bands(band, low, high): Simpson's rule over the band's frequencies, equally spaced; with an even number of points the last interval is a trapezoid."""
    inside = in_bands(spectrum, bands)
    w = Window.partitionBy(*keys, "band")
    rows = inside.withColumn("i", F.row_number().over(w.orderBy("f")) - 1).withColumn("n", F.count("*").over(w)).withColumn("dx", F.lead("f").over(w.orderBy("f")) - F.col("f"))
    last = F.when(F.col("n") % 2 == 1, F.col("n") - 1).otherwise(F.col("n") - 2)
    weight = F.when(F.col("i") > last, 0.0).when((F.col("i") == 0) | (F.col("i") == last), F.when(last > 0, 1.0).otherwise(0.0)).when(F.col("i") % 2 == 1, 4.0).otherwise(2.0) / 3
    tail = F.when((F.col("n") % 2 == 0) & (F.col("i") >= F.col("n") - 2), 0.5).otherwise(0.0)
    return rows.groupBy(*keys, "band").agg(F.coalesce(F.sum(F.col("p") * (weight + tail)) * F.min("dx"), F.lit(0.0)).alias("power"))


def relative_log_power(powers: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """log10 of each band's share of the band named total."""
    whole = powers.where(F.col("band") == total).select(*keys, F.col("power").alias("whole"))
    return powers.where(F.col("band") != total).join(whole, list(keys)).select(*keys, "band", F.log10(F.try_divide("power", "whole")).alias("log_power"))


def fir(sfreq: float, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """Coefficients of a linear-phase filter that keeps low to high (or, with stop, takes that out): a windowed sinc, Hamming, of 3.3 over the narrower transition.

    A transition is a quarter of its edge, 2 Hz at least where there is room, and never more than what is left to 0 or to half the rate.
    """
    low_room = min(max(0.25 * low, 2.0), low) if low else np.inf
    high_room = min(max(0.25 * high, 2.0), sfreq / 2 - high) if high else np.inf
    if stop:
        low_room = high_room = min(1.0, (high - low) / 2)
    n = int(np.ceil(3.3 * sfreq / min(low_room, high_room))) | 1
    t = np.arange(n) - n // 2

    def below(edge: float) -> np.ndarray:
        h = 2 * edge / sfreq * np.sinc(2 * edge / sfreq * t) * np.hamming(n)
        return h / h.sum()

    one = (t == 0).astype(float)
    if stop:
        return below(low + low_room / 2) + one - below(high - high_room / 2)
    out = below(high + high_room / 2) if high else one
    return out - below(low - low_room / 2) if low else out


def filtered(samples: DataFrame, coefficients: np.ndarray, block: int = 1 << 15) -> DataFrame:
    """samples(subject, t, ch, x) through a linear-phase filter without delay; beyond its ends a series is mirrored around its end value.

    t counts from 0 without gaps. Blocks of time bring along half a filter's length on either side, so a long channel is many tasks; the result doesn't depend on the block.
    """
    kinds, half = dict(samples.dtypes), len(coefficients) // 2
    block = max(block, half + 1)
    lengths = samples.groupBy("subject", "ch").agg(F.count("*").alias("whole"))
    rows = samples.select("subject", "t", "ch", "x").join(lengths, ["subject", "ch"])
    first = F.greatest(F.floor((F.col("t") - half) / block), F.lit(0))
    last = F.least(F.floor((F.col("t") + half) / block), F.floor((F.col("whole") - 1) / block))
    dealt = rows.withColumn("block", F.explode(F.sequence(first, last)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        x, low, whole = part["x"].to_numpy(dtype=float), int(part["t"].iloc[0]), int(part["whole"].iloc[0])
        begin = int(part["block"].iloc[0]) * block
        end = min(begin + block, whole)
        n = min(half, whole - 1)
        at = np.arange(begin - half, end + half)
        before, after = np.minimum(-at, n), np.minimum(at - (whole - 1), n)
        place = np.where(at < 0, before, np.where(at >= whole, whole - 1 - after, at)) - low
        wide = x[place]
        wide = np.where(at < 0, 2 * x[0] - wide, np.where(at >= whole, 2 * x[-1] - wide, wide))
        own = part["t"].between(begin, end - 1)
        return part.loc[own, ["subject", "t", "ch"]].assign(x=np.convolve(wide, coefficients, mode="valid"))

    return dealt.groupBy("subject", "ch", "block").applyInPandas(run, f"subject {kinds['subject']}, t {kinds['t']}, ch {kinds['ch']}, x double")


def band_pass(samples: DataFrame, low: float | None = 1.0, high: float | None = 30.0, sfreq: float = 500) -> DataFrame:
    """Frequencies outside [low, high] taken away by a finite impulse response."""
    return filtered(samples, fir(sfreq, low, high))


def notch(samples: DataFrame, line: float = 60.0, sfreq: float = 500, width: float = 4.0) -> DataFrame:
    """The power line's frequency, and what is within half the width of it, taken away."""
    return filtered(samples, fir(sfreq, line - width / 2, line + width / 2, stop=True))


def resample(samples: DataFrame, sfreq: float, target: float) -> DataFrame:
    """samples(subject, t, ch, x) at another rate, by cutting or padding the Fourier spectrum; t is numbered anew. The middle bin of an even length stands for two frequencies: cut, it takes both, padded, it is halved."""
    kinds = dict(samples.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("t")["x"].to_numpy(dtype=float)
        n = max(1, round(len(x) * target / sfreq))
        spectrum = np.zeros(n // 2 + 1, dtype=complex)
        own = np.fft.rfft(x)
        k = min(len(own), len(spectrum))
        spectrum[:k] = own[:k]
        least = min(n, len(x))
        if least % 2 == 0 and n != len(x):
            spectrum[least // 2] *= 2 if n < len(x) else 0.5
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "t": np.arange(n), "ch": rows["ch"].iloc[0], "x": np.fft.irfft(spectrum, n) * n / len(x)})

    return samples.groupBy("subject", "ch").applyInPandas(run, f"subject {kinds['subject']}, t long, ch {kinds['ch']}, x double")


def windows(sequence: DataFrame, length: int, stride: int, lag: int = 0) -> DataFrame:
    """Overlapping stretches of a sequence(subject, t, state) as (subject, begin, states, target): whole ones only; target is the same stretch `lag` samples later."""
    w = Window.partitionBy("subject").orderBy("t")
    rows = sequence.withColumn("n", F.count("*").over(Window.partitionBy("subject")))
    states = F.collect_list("state").over(w.rowsBetween(0, length - 1))
    target = F.collect_list("state").over(w.rowsBetween(lag, lag + length - 1))
    out = rows.select("subject", F.col("t").alias("begin"), "n", states.alias("states"), target.alias("target"))
    return out.where((F.col("begin") % stride == 0) & (F.col("begin") + length + lag <= F.col("n"))).drop("n")
