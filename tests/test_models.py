"""Spherical splines, coupled components and condition classifiers: fields that splines span, costs that fall, planted sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelflow.operators import classification as K
from channelflow.operators import clustering as C
from channelflow.operators import multitask as T
from channelflow.operators import spectral as P
from channelflow.operators import splines as S


def montage(n=40, seed=1):
    rng = np.random.default_rng(seed)
    return rng.uniform(-180, 180, n), rng.uniform(0.02, 0.6, n)


def test_kernel_equals_legendre_sums():
    x = np.linspace(-1, 1, 21)
    want = sum((2 * n + 1) / (n * (n + 1)) ** 4 * np.polynomial.legendre.Legendre.basis(n)(x) for n in range(1, 51)) / (4 * np.pi)
    assert np.abs(S.kernel(x) - want).max() < 1e-14
    top, right, front = S.on_sphere(np.array([0.0, 90.0, 0.0]), np.array([0.0, 0.5, 0.5]))
    assert np.allclose(top, [0, 0, 1]) and np.allclose(right, [1, 0, 0]) and np.allclose(front, [0, 1, 0])


def test_spline_gives_fields_that_it_spans(spark):
    angle, radius = montage()
    at, rng = S.on_sphere(angle, radius), np.random.default_rng(2)
    bad = {"a": [3, 17, 18], "b": [0]}
    places = spark.createDataFrame([(i, float(a), float(r)) for i, (a, r) in enumerate(zip(angle, radius))], "ch int, angle double, radius double")
    rows, want = [], {}
    for subject in ("a", "b", "none"):
        good = [i for i in range(40) if i not in bad.get(subject, [])]
        for t in range(4):
            c = rng.standard_normal(len(good))
            field = 7.0 + S.kernel(at @ at[good].T) @ (c - c.mean()) * 100
            given = field.copy()
            given[bad.get(subject, [])] = 1e6
            want[subject, t] = field
            rows.append((subject, t, given.tolist()))
    df = spark.createDataFrame(rows, "subject string, t long, v array<double>")
    bads = spark.createDataFrame([(s, c) for s, cs in bad.items() for c in cs] + [("a", 3), ("a", 99)], "subject string, ch int")
    got = {(r["subject"], r["t"]): np.array(r["v"]) for r in S.spline_repaired(df, bads, places, smoothing=0.0).collect()}
    assert got.keys() == want.keys() and max(np.abs(got[k] - want[k]).max() for k in want) < 1e-5
    nulls = df.withColumn("v", F.transform("v", lambda x: F.when(x < 1e5, x)))
    again = {(r["subject"], r["t"]): np.array(r["v"]) for r in S.spline_repaired(nulls, bads, places, smoothing=0.0).collect()}
    assert max(np.abs(again[k] - want[k]).max() for k in want) < 1e-5


def test_spline_is_better_than_distance_weights_on_a_smooth_field():
    angle, radius = montage(60)
    at = S.on_sphere(angle, radius)
    field = at @ np.array([1.0, -2.0, 0.5]) + 3 * at[:, 0] * at[:, 1]
    spline = near = 0.0
    for i in range(60):
        bad = np.arange(60) == i
        spline += abs(S.interpolation(at, bad)[0] @ field - field[i])
        w = np.linalg.norm(at - at[i], axis=1)[~bad] ** -2.0
        near += abs((w / w.sum()) @ field[~bad] - field[i])
    assert spline < 0.2 * near


def test_all_channels_bad_gives_null(spark):
    places = spark.createDataFrame([(0, 0.0, 0.1), (1, 90.0, 0.2)], "ch int, angle double, radius double")
    df = spark.createDataFrame([("a", 0, [1.0, 2.0])], "subject string, t long, v array<double>")
    bads = spark.createDataFrame([("a", 0), ("a", 1)], "subject string, ch int")
    assert S.spline_repaired(df, bads, places).first()["v"] == [None, None]


def tasks(spark, datas, grp="g"):
    rows = [(grp, f"t{k}", t, [float(x) for x in v]) for k, data in enumerate(datas) for t, v in enumerate(data)]
    return spark.createDataFrame(rows, "grp string, task string, t long, v array<double>").repartition(4)


def projector(rows, task):
    u = np.array([r["vector"] for r in sorted((r for r in rows if r["task"] == task), key=lambda r: r["i"])])
    assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-9
    return u.T @ u


def test_coupled_components(spark):
    rng = np.random.default_rng(4)
    datas = [rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) for _ in range(3)]
    df = tasks(spark, datas)
    found = T.multitask_components(df, 2, [0.0, 1.0, 1000.0]).collect()
    by = {c: [r for r in found if r["coupling"] == c] for c in (0.0, 1.0, 1000.0)}
    for k, data in enumerate(datas):  # uncoupled: plain components
        c = np.cov(data.T)
        u = np.linalg.eigh(c)[1][:, -2:]
        assert np.abs(projector(by[0.0], f"t{k}") - u @ u.T).max() < 1e-8
        row = next(r for r in by[0.0] if r["task"] == f"t{k}")
        assert row["score"] == pytest.approx(np.trace(u.T @ c @ u) / np.trace(c)) and len(row["costs"]) == 1
    for c in (1.0, 1000.0):
        costs = np.array(by[c][0]["costs"])
        assert len(costs) > 1 and (np.diff(costs) <= 1e-9 * np.abs(costs[1:])).all()
    apart = lambda c: max(np.abs(projector(by[c], f"t{i}") - projector(by[c], f"t{j}")).max() for i in range(3) for j in range(i))
    assert apart(1000.0) < 0.05 < apart(0.0)
    # no subspace near the ones found has a lower cost
    covs = np.stack([np.cov(d.T) for d in datas])
    spaces, costs = T.coupled_spaces(covs, 2, 1.0)
    for _ in range(50):
        other = [np.linalg.qr((u + 0.01 * rng.standard_normal(u.shape)).T)[0].T for u in spaces]
        assert T.coupled_cost(covs, other, 1.0) >= costs[-1] - 1e-9


def test_equal_tasks_give_plain_components(spark):
    data = np.random.default_rng(5).standard_normal((100, 5)) * [3, 2, 1, 0.5, 0.1]
    df = tasks(spark, [data, data]).unionByName(tasks(spark, [data * 0 + 1], "dull"))
    rows = T.multitask_components(df, 2, [0.5]).collect()
    plain = C.principal_components(df.where("grp = 'g' and task = 't0'").select(F.lit("x").alias("subject"), "t", "v"), 1.0).where("i < 2").collect()
    u = np.array([r["vector"] for r in sorted(plain, key=lambda r: r["i"])])
    for task in ("t0", "t1"):
        assert np.abs(projector([r for r in rows if r["grp"] == "g"], task) - u.T @ u).max() < 1e-6
    assert all(r["score"] is None for r in rows if r["grp"] == "dull")


def markov(rng, p, n):
    out = [0]
    for _ in range(n - 1):
        out.append(int(rng.choice(len(p), p=p[out[-1]])))
    return out


def test_conditions_are_told_from_windows_of_new_subjects(spark):
    rng = np.random.default_rng(6)
    chains = {"rest": np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]), "work": np.array([[0.2, 0.7, 0.1], [0.1, 0.2, 0.7], [0.7, 0.1, 0.2]]), "play": np.array([[0.2, 0.1, 0.7], [0.7, 0.2, 0.1], [0.1, 0.7, 0.2]])}
    rows = [(f"s{s}/{c}", t, x) for s in range(12) for c, p in chains.items() for t, x in enumerate(markov(rng, p, 300))]
    cut = P.windows(spark.createDataFrame(rows, "subject string, t long, state int"), 30, 15)
    named = cut.select(F.split("subject", "/")[0].alias("subject"), F.split("subject", "/")[1].alias("condition"), "begin", "states")
    features = K.window_features(named, 3)
    row = features.first()
    assert len(row["features"]) == 12 and sum(row["features"][:3]) == pytest.approx(1) and sum(row["features"][3:]) == pytest.approx(1)
    judged = K.held_out_conditions(features, folds=4)
    assert judged.count() == features.count() and judged.groupBy("subject").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    for r in K.accuracy(judged).collect():
        assert r["correct"] > 0.9 and r["majority"] == pytest.approx(1 / 3, abs=0.01)


def test_window_features_of_odd_windows(spark):
    rows = [("a", "x", 0, [1]), ("a", "x", 1, [0, 7, None, 1, 1])]
    got = {r["begin"]: r["features"] for r in K.window_features(spark.createDataFrame(rows, "subject string, condition string, begin long, states array<int>"), 2).collect()}
    assert got[0] == [0, 1, 0, 0, 0, 0] and got[1] == pytest.approx([0.2, 0.4, 0, 0, 0, 0.25])
    one = K.held_out_conditions(K.window_features(spark.createDataFrame(rows, "subject string, condition string, begin long, states array<int>"), 2))
    assert {r["predicted"] for r in one.collect()} == {None}
