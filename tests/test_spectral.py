"""Spectra against NumPy, and sequence windows."""

import numpy as np
import pytest

from channelflow.operators import spectral as P


@pytest.fixture(scope="module")
def wave(spark):
    t = np.arange(1000)
    x = np.sin(2 * np.pi * 10 * t / 250) + 0.1 * np.sin(2 * np.pi * 60 * t / 250)
    return x, spark.createDataFrame([("a", int(i), 0, float(v)) for i, v in enumerate(x)], "subject string, t long, ch int, x double")


def test_welch_peak_and_power(spark, wave):
    x, df = wave
    spectrum = P.welch(df, 250, 250, 125)
    rows = spectrum.orderBy("f").collect()
    assert max(rows, key=lambda r: r["p"])["f"] == 10
    assert sum(r["p"] for r in rows) * 1.0 == pytest.approx(x.var(), rel=0.05)
    bands = spark.createDataFrame([("alpha", 8.0, 13.0), ("all", 1.0, 100.0)], "band string, low double, high double")
    powers = {r["band"]: r["power"] for r in P.simpson_band_power(spectrum, bands, ["subject", "ch"]).collect()}
    assert powers["alpha"] / powers["all"] > 0.3  # the rule weighs a single line by its place
    assert P.relative_log_power(P.simpson_band_power(spectrum, bands, ["subject", "ch"]), ["subject", "ch"], "all").first()["log_power"] == pytest.approx(np.log10(powers["alpha"] / powers["all"]))


def test_simpson_is_exact_on_a_parabola(spark):
    spectrum = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(9)], "k string, f double, p double")
    bands = spark.createDataFrame([("b", 0.0, 8.0)], "band string, low double, high double")
    assert P.simpson_band_power(spectrum, bands, ["k"]).first()["power"] == pytest.approx(8**3 / 3)


def test_filters(spark, wave):
    x, df = wave
    t = np.arange(1000)
    low, high = np.sin(2 * np.pi * 10 * t / 250), 0.1 * np.sin(2 * np.pi * 60 * t / 250)
    inside = slice(200, 800)
    values = lambda frame: np.array([r["x"] for r in frame.orderBy("t").collect()])
    assert np.abs(values(P.band_pass(df, 1, 30, 250)) - low)[inside].max() < 0.03
    assert np.abs(values(P.band_pass(df, 40, None, 250)) - high)[inside].max() < 0.03
    assert np.abs(values(P.notch(df, 60, 250)) - low)[inside].max() < 0.03
    short = df.where("t < 5")
    assert values(P.band_pass(short, 1, 30, 250)).shape == (5,)


def test_filter_response():
    for taps, kept, lost in ((P.fir(500, 1, 30), [5, 10, 25], [0, 60, 100]), (P.fir(500, None, 40), [0, 10, 30], [60, 200]), (P.fir(500, 58, 62, stop=True), [0, 40, 56, 64, 200], [60])):
        gain = lambda f, h=taps: abs(np.sum(h * np.exp(-2j * np.pi * f / 500 * np.arange(len(h)))))
        assert len(taps) % 2 == 1 and np.abs(taps - taps[::-1]).max() < 1e-12
        assert all(abs(gain(f) - 1) < 0.02 for f in kept) and all(gain(f) < 0.02 for f in lost)


def test_resample(wave):
    x, df = wave
    half = np.array([r["x"] for r in P.resample(df, 250, 125).orderBy("t").collect()])
    assert len(half) == 500 and np.abs(half - x[::2]).max() < 0.2


@pytest.mark.parametrize("n, rate, target", [(100, 100, 50), (100, 100, 60), (50, 50, 100), (64, 64, 48), (75, 75, 50), (99, 99, 33)])
def test_resample_equals_the_fourier_series(spark, n, rate, target):
    """Of the samples' trigonometric interpolation, the frequencies that the new rate holds; a middle one counts by its cosine."""
    x = np.random.default_rng(n).standard_normal(n)
    df = spark.createDataFrame([("a", i, 0, float(v)) for i, v in enumerate(x)], "subject string, t long, ch int, x double")
    got = np.array([r["x"] for r in P.resample(df, rate, target).orderBy("t").collect()])
    m, least = len(got), min(n, len(got))
    t, j = np.arange(m) / m, np.arange(n)
    want = np.full(m, x.mean())
    for k in range(1, (least - 1) // 2 + 1):
        want += 2 / n * (x @ np.cos(2 * np.pi * k * (j[:, None] / n - t)))
    if least % 2 == 0:
        k = least // 2
        want += (2 if m < n else 1) / n * (x @ np.cos(2 * np.pi * k * j / n)[:, None] * np.cos(2 * np.pi * k * t))
    assert np.abs(got - want).max() < 1e-9


def test_sequence_windows(spark):
    seq = spark.createDataFrame([("a", t, t % 3) for t in range(7)], "subject string, t long, state int")
    got = [(r["begin"], r["states"], r["target"]) for r in P.windows(seq, 3, 2, 1).orderBy("begin").collect()]
    assert got == [(0, [0, 1, 2], [1, 2, 0]), (2, [2, 0, 1], [0, 1, 2])]


def in_time(df):
    return np.array([r["x"] for r in df.orderBy("t").collect()])


@pytest.mark.parametrize("n, block", [(5000, 300), (700, 100), (130, 64), (3, 10)])
def test_filter_of_blocks_equals_the_whole_series(spark, n, block):
    x, taps = np.random.default_rng(n).standard_normal(n), np.hamming(101) * np.linspace(1, 2, 101)
    df = spark.createDataFrame([("a", i, 0, float(v)) for i, v in enumerate(x)], "subject string, t long, ch int, x double")
    m = min(50, n - 1)
    left, right = 2 * x[0] - x[m:0:-1], 2 * x[-1] - x[-2 : -m - 2 : -1]
    wide = np.r_[np.full(50 - m, 2 * x[0] - x[m]), left, x, right, np.full(50 - m, 2 * x[-1] - x[-m - 1])]
    assert np.abs(in_time(P.filtered(df, taps, block)) - np.convolve(wide, taps, mode="valid")).max() < 1e-9


@pytest.mark.parametrize("n, segment, overlap, together", [(3000, 100, 75, 4), (1000, 64, 0, 3), (517, 50, 49, 7), (30, 100, 75, 4)])
def test_welch_of_groups_of_segments_equals_the_mean_of_all(spark, n, segment, overlap, together):
    x = np.random.default_rng(n).standard_normal(n)
    df = spark.createDataFrame([("a", i, 0, float(v)) for i, v in enumerate(x)], "subject string, t long, ch int, x double")
    got = [(r["f"], r["p"]) for r in P.welch(df, 100, segment, overlap, together).orderBy("f").collect()]
    m = min(segment, n)
    step, w = m - min(overlap, m - 1), np.hamming(m + 1)[:-1]
    parts = np.stack([x[i : i + m] for i in range(0, n - m + 1, step)])
    p = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w)) ** 2).mean(axis=0) / (100 * (w**2).sum())
    p[1 : None if m % 2 else -1] *= 2
    assert np.allclose([f for f, _ in got], np.fft.rfftfreq(m, 0.01)) and np.allclose([v for _, v in got], p)
