"""Independent components and stationary wavelets: planted sources, inverses, plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelflow.operators import artefacts as A


def table(spark, x, subject="a", parts=5):
    rows = [(subject, t, [float(c) for c in v]) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "subject string, t long, v array<double>").repartition(parts)


def planted(n=4000, seed=3):
    rng, t = np.random.default_rng(seed), np.arange(n)
    s = np.stack([np.sign(np.sin(t / 17)), rng.laplace(size=n), rng.uniform(-1, 1, n), (t % 97) / 97 - 0.5], axis=1)
    mixing = rng.standard_normal((4, 6))
    return s, mixing, s @ mixing + 5.0


def values(df):
    return np.array([r["v"] for r in df.orderBy("subject", "t").collect()])


def test_planted_sources_come_back(spark):
    s, _, x = planted()
    df = table(spark, x)
    model = A.unmixed(df, tolerance=1e-6)
    row = model.first()
    assert len(row["unmixing"]) == 4 and row["tolerance"] == 1e-6  # six channels of four sources
    got = values(A.sources(df, model))
    r = np.abs(np.corrcoef(got.T, s.T)[:4, 4:])
    assert sorted(r.argmax(axis=0)) == [0, 1, 2, 3] and r.max(axis=0).min() > 0.98
    assert np.abs(np.cov(got.T, bias=True) - np.eye(4)).max() < 1e-9
    assert np.abs(values(A.mixed(A.sources(df, model), model)) - x).max() < 1e-9
    power = (np.array(row["mixing"]) ** 2).sum(axis=1)
    assert (np.diff(power) <= 0).all()
    again = A.unmixed(df.repartition(2), tolerance=1e-6).first()
    assert np.abs(np.array(again["unmixing"]) - np.array(row["unmixing"])).max() < 1e-6


def test_chosen_components_are_taken_out(spark):
    s, mixing, x = planted()
    df = table(spark, x)
    model = A.unmixed(df, tolerance=1e-6)
    got = values(A.sources(df, model))
    which = int(np.abs(np.corrcoef(got.T, s[:, 1])[:-1, -1]).argmax())
    drop = spark.createDataFrame([("a", which), ("a", which)], "subject string, component int")
    left = values(A.without_components(df, model, drop))
    centred = s - s.mean(axis=0)
    want = x - np.outer(centred[:, 1], mixing[1])
    assert np.abs(left - want).max() < 0.15 * np.abs(x - x.mean(axis=0)).max()
    assert np.abs(values(A.without_components(df, model, drop.limit(0))) - x).max() == 0
    highest = A.kurtosis(A.sources(df, model)).orderBy(F.desc("kurtosis")).first()
    assert highest["component"] == which


def test_several_recordings_at_once_and_dull_ones(spark, monkeypatch):
    s, _, x = planted(1500)
    flat = table(spark, np.ones((50, 3)), "flat")
    df = table(spark, x, "a").unionByName(table(spark, x[::-1], "b")).unionByName(flat)
    whole = {r["subject"]: r for r in A.unmixed(df, tolerance=1e-4).collect()}
    assert whole["flat"]["unmixing"] == [] and set(whole) == {"a", "b", "flat"}
    monkeypatch.setattr(A, "TOGETHER", 1)
    parts = {r["subject"]: r for r in A.unmixed(df, tolerance=1e-4).collect()}
    for k in whole:
        assert np.allclose(whole[k]["unmixing"], parts[k]["unmixing"], atol=1e-6)


def test_tolerance_widens_until_it_is_met(spark):
    """Four rounds an attempt aren't enough for so strict a tolerance."""
    x = np.random.default_rng(0).standard_normal((300, 5))
    row = A.unmixed(table(spark, x), rounds=4, attempts=2, tolerance=1e-9, widen=100.0).first()
    assert row["tolerance"] > 1e-9 and row["rounds"] > 4


@pytest.mark.parametrize("wavelet", ["haar", "coif5"])
def test_transform_and_inverse(wavelet):
    x = np.random.default_rng(1).standard_normal(256)
    parts = A.stationary(x, wavelet, 5)
    assert parts.shape == (6, 256) and np.abs(A.inverse_stationary(parts, wavelet) - x).max() < 1e-7
    low = np.array(A.WAVELETS[wavelet])
    assert abs(low.sum() - 2**0.5) < 1e-12 and abs((low**2).sum() - 1) < 1e-8
    line = A.stationary(np.full(64, 3.0), wavelet, 3)
    assert np.abs(line[:3]).max() < 1e-6 and np.abs(line[3] - 3 * 2**1.5).max() < 1e-6


def long(spark, series):
    rows = [(s, t, c, float(x)) for (s, c), xs in series.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "subject string, t long, ch int, x double").repartition(3)


def by_series(df):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault((r["subject"], r["ch"]), []).append(r["x"])
    return out


def plain_part(x, wavelet, levels, multiplier):
    n = len(x)
    wide = np.concatenate((x, np.zeros(-n % (1 << levels))))
    d = np.abs(np.array([x[i] - (x[i + 1] if i + 1 < n else 0) for i in range(0, n, 2)])) / 2**0.5
    median = np.sort(d)[-(-len(d) // 2) - 1]
    limit = multiplier * np.sqrt(2 * np.log(n)) * (median if median > 0 else 0.05 * d.max()) / 0.6745
    return A.inverse_stationary(A.soft(A.stationary(wide, wavelet, levels), limit), wavelet)[:n]


@pytest.mark.parametrize("wavelet, levels, n", [("coif5", 5, 9000), ("haar", 3, 1001), ("coif5", 2, 700), ("haar", 5, 7)])
def test_blocks_with_their_reach_equal_the_whole_series(spark, wavelet, levels, n):
    rng = np.random.default_rng(n)
    series = {("a", 0): rng.standard_normal(n), ("a", 1): np.cumsum(rng.standard_normal(n)), ("b", 0): np.where(np.arange(n - 1) % 50 == 0, 9.0, 0.0)}
    df = long(spark, series)
    for multiplier in (0.0, 1.0):
        got = by_series(A.wavelet_part(df, wavelet, levels, multiplier, block=1024 if n > 2000 else 100))
        for k, x in series.items():
            want = x if multiplier == 0 else plain_part(x, wavelet, levels, multiplier)
            assert len(got[k]) == len(x) and np.abs(np.array(got[k]) - want).max() < 1e-6


def test_spikes_go_and_the_rest_stays(spark):
    """A source of rare large spikes is an artefact: what the thresholds keep of it is taken off the channels."""
    rng, n = np.random.default_rng(5), 2048
    spikes = np.where(np.arange(n) % 256 < 12, 25.0, 0.0) * np.hanning(12)[np.minimum(np.arange(n) % 256, 11)]
    quiet = rng.uniform(-1, 1, (n, 3))
    mixing = rng.standard_normal((4, 4))
    x = np.c_[spikes + 0.05 * rng.standard_normal(n), quiet] @ mixing
    clean = quiet @ mixing[1:]
    left = values(A.without_artefacts(table(spark, x), levels=4, tolerance=1e-4))
    at = spikes > 5
    assert np.abs((left - clean)[at]).mean() < 0.25 * np.abs((x - clean)[at]).mean()


def test_a_recording_meets_its_model_in_slices(spark, monkeypatch):
    """One recording is several tasks, and samples and values are those of one slice."""
    _, _, x = planted(1200)
    df = table(spark, x)
    model = A.unmixed(df, tolerance=0.5)
    assert model.first()["n"] == 1200
    want = values(A.mixed(A.sources(df, model), model))
    drop = spark.createDataFrame([("a", 1)], "subject string, component int")
    less = values(A.without_components(df, model, drop))
    monkeypatch.setattr(A, "SLICE", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = A.sources(df, model)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert A.without_components(df, model, drop).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.array_equal(values(A.mixed(got, model)), want) and np.array_equal(values(A.without_components(df, model, drop)), less)
