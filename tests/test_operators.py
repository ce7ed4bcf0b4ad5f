"""Operators on small made fixtures, against values found by hand or by plain NumPy."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.operators import alignment as A
from channelflow.operators import clustering as C
from channelflow.operators import inference as I
from channelflow.operators import maps as M
from channelflow.operators import sequences as S
from channelflow.operators import statistics as Q
from channelflow.operators import tasks as J
from channelflow.plans import hierarchy as H
from channelflow.sources import recordings as R
from channelflow.streaming import states as T


@pytest.fixture(scope="module")
def seq(spark):
    return spark.createDataFrame([("a", t, s) for t, s in enumerate([0, 0, 1, 1, 1, 0, 2, 2])], "subject string, t long, state int")


def by_state(df, column):
    return {r["state"]: r[column] for r in df.collect()}


def test_hand_made_sequence(seq):
    assert by_state(S.coverage(seq), "coverage") == {0: 3 / 8, 1: 3 / 8, 2: 2 / 8}
    assert by_state(S.duration_trimmed(seq), "duration") == {0: 1, 1: 3, 2: 0}
    assert by_state(S.duration_label(seq), "mean") == {0: 1, 1: 3, 2: 2}
    assert by_state(S.duration_sequence(seq), "duration") == {0: 1.5, 1: 3, 2: 1}
    assert {(r["s0"], r["s1"]): r["n"] for r in S.transition_matrix(seq).collect()} == {(0, 0): 1, (0, 1): 1, (1, 1): 2, (1, 0): 1, (0, 2): 1, (2, 2): 1}
    assert S.transition_frequency(seq).first()["transition_frequency"] == 3 / 7
    assert [(r["state"], r["length"]) for r in S.runs(seq).orderBy("run").collect()] == [(0, 2), (1, 3), (0, 1), (2, 2)]


def test_short_sequences(spark):
    one = spark.createDataFrame([("a", 0, 1)], "subject string, t long, state int")
    assert S.transition_frequency(one).first()["transition_frequency"] == 0
    assert S.duration_label(one).first()["segments"] == 0
    assert S.hurst_states(one).first()["hurst"] is None
    assert S.runs(one.limit(0)).count() == 0


def test_hurst_against_numpy(spark):
    x = np.random.default_rng(0).integers(0, 2, 700)
    got = S.hurst_rs(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "subject string, t long, x double"), ["subject"]).first()["hurst"]
    sizes, values = [], []
    for size in (16, 32, 64, 128):
        if len(x) // size < 4 or size > len(x) // 4:
            continue
        rs = []
        for b in range(len(x) // size):
            part = x[b * size : (b + 1) * size].astype(float)
            z = np.cumsum(part - part.mean())
            if part.std(ddof=1) > 0:
                rs.append((z.max() - z.min()) / part.std(ddof=1))
        sizes.append(size)
        values.append(np.mean(rs))
    assert got == pytest.approx(np.polyfit(np.log(sizes), np.log(values), 1)[0])


def test_dfa_against_numpy(spark):
    x = np.random.default_rng(1).choice([-1.0, 1.0], 300)
    got = S.dfa(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "subject string, t long, x double"), ["subject"], [4, 8, 16]).first()["dfa"]
    y, f = np.cumsum(x - x.mean()), []
    for s in (4, 8, 16):
        parts = y[: len(y) // s * s].reshape(-1, s)
        f.append(np.sqrt(np.mean([np.mean((p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s))) ** 2) for p in parts])))
    assert got == pytest.approx(np.polyfit(np.log2([4, 8, 16]), np.log2(f), 1)[0])


def planted(k=3, channels=16, n=600, noise=0.05, seed=2):
    rng = np.random.default_rng(seed)
    maps = rng.normal(size=(k, channels))
    maps -= maps.mean(axis=1, keepdims=True)
    maps /= np.linalg.norm(maps, axis=1, keepdims=True)
    label = np.repeat(rng.integers(0, k, n // 10 + 1), 10)[:n]
    amplitude = 2 + np.sin(np.arange(n) * 0.7)
    return maps, label, maps[label] * (amplitude * rng.choice([-1, 1], n))[:, None] + rng.normal(scale=noise, size=(n, channels))


def recovered(found, maps):
    found = found - found.mean(axis=1, keepdims=True)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    c = np.abs(found @ maps.T)
    return max(min(c[i, p] for i, p in enumerate(order)) for order in itertools.permutations(range(len(maps))))


def as_samples(spark, data, subject="a"):
    return spark.createDataFrame([(subject, i, v.tolist()) for i, v in enumerate(data)], "subject string, t long, v array<double>")


def test_kmeans_and_agglomeration_recover_planted_maps(spark):
    maps, _, data = planted()
    samples = as_samples(spark, data - data.mean(axis=1, keepdims=True))
    found = C.kmeans_modified(samples, 3, 3, 10).orderBy("k").collect()
    assert recovered(np.array([r["m"] for r in found]), maps) > 0.98
    few = as_samples(spark, data[:60] - data[:60].mean(axis=1, keepdims=True))
    again = C.aahc(few, 3, 3).orderBy("k").collect()
    assert len(again) == 3 and sum(r["gev"] for r in again) > 0.8
    assert C.kmeans_modified(samples.limit(2), 3, 3, 2).count() == 0


def peaks_of(spark, x, distance, deviations, block=1 << 16):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "subject string, t long, x double")
    return sorted(r["t"] for r in C.pick_peaks(df, "x", distance, deviations, block).collect())


def test_peaks_distance_and_plateau(spark):
    x = np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 1, 0], dtype=float)
    assert peaks_of(spark, x, 1, 3) == [1, 3, 6, 9]
    assert peaks_of(spark, x, 3, 3) == [3, 6, 9]
    assert peaks_of(spark, np.zeros(5), 1, 3) == []


def sequential_peaks(x, distance, deviations):
    """The rule, sample after sample."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i] > x[i - 1] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    left = sorted((p for p in found if abs(x[p] - x.mean()) <= deviations * x.std()), key=lambda p: (x[p], p))
    kept = []
    while left:
        top = left.pop()
        kept.append(top)
        left = [p for p in left if abs(p - top) >= distance]
    return sorted(kept)


@pytest.mark.parametrize("distance, deviations, block", [(1, 3, 64), (10, 2, 64), (25, 3, 50), (200, 3, 64), (7, 9, 1 << 16)])
def test_peaks_of_blocks_equal_the_sequential_rule(spark, distance, deviations, block):
    rng = np.random.default_rng(distance)
    smooth = np.convolve(rng.standard_normal(2000), np.ones(5))
    steps = np.repeat(rng.integers(0, 4, 500), rng.integers(1, 9, 500)).astype(float)
    quiet = np.where(rng.random(3000) < 0.02, rng.integers(1, 4, 3000), 0).astype(float)
    for x in (smooth, steps, quiet):
        assert peaks_of(spark, x, distance, deviations, block) == sequential_peaks(x, distance, deviations)


def plain_agglomeration(data, least, most):
    """The same with all correlations found again in every round."""
    maps, members = data / np.linalg.norm(data, axis=1, keepdims=True), [[i] for i in range(len(data))]
    while len(maps) >= least:
        _, cv, gev = C.criteria(data, maps, False)
        if len(maps) <= most:
            yield maps.copy(), cv, gev
        if len(maps) == 1:
            return
        worst = int(gev.argmin())
        maps, freed = np.delete(maps, worst, axis=0), members.pop(worst)
        targets = np.abs(C.map_correlations(data[freed], maps)).argmax(axis=1)
        for i, k in zip(freed, targets, strict=True):
            members[k].append(i)
        for k in np.unique(targets):
            maps[k] = C.principal_vector(data[members[k]])


def test_kept_correlations_give_the_same_agglomeration():
    for seed in range(3):
        data = np.random.default_rng(seed).standard_normal((70, 9))
        data -= data.mean(axis=1, keepdims=True)
        ours, plain = list(C.agglomerate(data, 1, 70)), list(plain_agglomeration(data, 1, 70))
        assert len(ours) == len(plain) == 70
        for (k, maps, cv, gev), (m, c, g) in zip(ours, plain, strict=True):
            assert k == len(m) and np.abs(maps - m).max() < 1e-9 and np.abs(gev - g).max() < 1e-9 and (cv == c or abs(cv - c) < 1e-9 * abs(c))


def test_samples_without_power_have_no_nan():
    for found in (C.kmeans_run(np.zeros((6, 7)), 2, 0, 1), next(C.agglomerate(np.zeros((5, 7)), 2, 3))[1:]):
        assert all(np.isfinite(np.asarray(x, dtype=float)).all() for x in found)


def test_hurst_of_several_subjects_and_states(spark):
    rng = np.random.default_rng(3)
    seqs = {"a": rng.integers(0, 3, 3000).tolist(), "b": np.repeat(rng.integers(0, 2, 200), 5).tolist(), "c": [0] * 30, "d": [None if x == 2 else int(x) for x in rng.integers(0, 3, 700)]}
    df = spark.createDataFrame([(s, t, x) for s, xs in seqs.items() for t, x in enumerate(xs)], "subject string, t long, state int")
    got = {(r["subject"], r["state"]): r["hurst"] for r in S.hurst_states(df).collect()}
    each = {(r["subject"], r["state"]): r["hurst"] for r in S.hurst_rs(S.indicators(df), ["subject", "state"]).collect()}
    assert got.keys() == each.keys() == {(s, k) for s in seqs for k in range(3)}
    assert all(got[k] == pytest.approx(each[k], abs=1e-12) if each[k] is not None else got[k] is None for k in each)
    assert got["c", 0] is None and got["b", 2] is None and got["a", 1] is not None


def test_fluctuation_of_odd_scales_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(1501) + 3
    scales = [5, 10, 20, 7, 63, 100]
    got = S.dfa(spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "subject string, t long, x double"), ["subject"], scales).first()["dfa"]
    y, f = np.cumsum(x - x.mean()), []
    for n in scales:
        parts = y[: len(y) // n * n].reshape(-1, n)
        line = np.polyfit(np.arange(n), parts.T, 1)
        f.append(np.sqrt(((parts - (np.outer(line[0], np.arange(n)) + line[1][:, None])) ** 2).mean(axis=1).mean()))
    assert got == pytest.approx(np.polyfit(np.log2(scales), np.log2(f), 1)[0], abs=1e-9)


def test_subjects_of_equal_letters_have_chains_of_their_own(spark):
    rows = [(s, a, b, 1, 0.25, 0.5) for s in ("ab", "ba") for a in range(2) for b in range(2)]
    matrix = spark.createDataFrame(rows, "subject string, s0 int, s1 int, n long, joint double, p double")
    chains = {s: [r["state"] for r in S_chain.orderBy("t").collect()] for s, S_chain in ((s, I.surrogates(matrix, 200, 1).where(F.col("subject") == s)) for s in ("ab", "ba"))}
    assert chains["ab"] != chains["ba"]


def test_backfit_midpoints_and_single_peak(spark):
    maps = spark.createDataFrame([("a", 0, [1.0, 0.0, -1.0]), ("a", 1, [1.0, -2.0, 1.0])], "subject string, k int, m array<double>")
    rows = as_samples(spark, np.array([[1, 0, -1]] * 3 + [[1, -2, 1]] * 5, dtype=float))
    labels = lambda peaks: [r["state"] for r in M.backfit(rows, rows.where(F.col("t").isin(peaks)), maps).orderBy("t").collect()]
    assert labels([1, 6]) == [0, 0, 0, 1, 1, 1, 1, 1]
    assert labels([6]) == [1] * 8
    assert labels([]) == [None] * 8


def test_assignment_equals_hungarian_and_all_permutations(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 6):
        cost = rng.normal(size=(n, n))
        best = min(itertools.permutations(range(n)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
        assert A.hungarian(cost) == list(best)
    sets = spark.createDataFrame([("s", k, rng.normal(size=8).tolist()) for k in range(4)], "subject string, k int, m array<double>")
    template = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(4)], "k int, m array<double>")
    a, b = (np.array([r["m"] for r in x.orderBy("k").collect()]) for x in (sets, template))
    c = np.corrcoef(a, b)[:4, 4:]
    got = {r["k_src"]: r["k_dst"] for r in A.assign(sets, template).collect()}
    assert [got[i] for i in range(4)] == A.hungarian(-c)


def test_assignment_of_sets_of_any_size(spark):
    rng = np.random.default_rng(15)
    cost = rng.normal(size=(12, 12))
    order = rng.permutation(12)
    cost[np.arange(12), order] -= 50
    assert A.hungarian(cost) == order.tolist()
    base = rng.normal(size=(11, 20))
    rows = [("same", k, (-base[order[k]] if order[k] < 11 else rng.normal(size=20)).tolist()) for k in range(12)] + [("few", k, base[k + 3].tolist()) for k in range(2)]
    sets = spark.createDataFrame(rows, "subject string, k int, m array<double>")
    template = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(base)], "k int, m array<double>")
    found = {(r["subject"], r["k_src"]): (r["k_dst"], r["r"]) for r in A.padded_similarity(sets, template, 0.95).collect()}
    assert all(found["same", k][0] == (order[k] if order[k] < 11 else -1) for k in range(12))
    assert found["few", 0] == (3, pytest.approx(1)) and found["few", 1] == (4, pytest.approx(1))
    assert sum(r["k_dst"] is None for r in A.assign(sets, template).where("subject = 'same'").collect()) == 1


def test_threshold_comes_before_the_assignment(spark):
    """Pairs of 0.8 and 0.5 would be assigned for their total; below 0.6 they count as nothing, and 0.7 is taken."""
    c = [[0.7, 0.8], [0.1, 0.5]]
    a, b = np.zeros((2, 6)), np.zeros((2, 6))
    b[0, :2], b[1, 2:4] = (1, -1), (1, -1)
    for i in range(2):
        a[i, :2], a[i, 2:4] = c[i][0] * b[0, :2], c[i][1] * b[1, 2:4]
        rest = 2 - 2 * (c[i][0] ** 2 + c[i][1] ** 2)
        a[i, 4:] = (1, -1) * np.array(np.sqrt(max(rest, 0) / 2))
    sets = spark.createDataFrame([("s", k, m.tolist()) for k, m in enumerate(a)], "subject string, k int, m array<double>")
    template = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(b)], "k int, m array<double>")
    got = {r["k_src"]: (r["k_dst"], round(r["r"], 1)) for r in A.padded_similarity(sets, template, 0.75).collect()}
    assert got[0] == (1, 0.8) and got[1] == (0, 0.0)


def test_orders_are_checked(spark):
    with pytest.raises(ValueError, match="no permutation"):
        A.checked_order([0, 2, 2], 3)
    sheet = spark.createDataFrame([("a", 1, 2)], "name string, p0 int, p1 int")
    assert A.reordered_sheet(sheet, ["name"], "p", [1, 0]).first().asDict() == {"name": "a", "p0": 2, "p1": 1}
    lists = spark.createDataFrame([([1, 2, 3], [2, 0, 0])], "v array<int>, o array<int>")
    with pytest.raises(Exception, match="no permutation"):
        lists.select(V.reordered(F.col("v"), F.col("o"))).collect()


def test_mean_of_permuted_copies_is_the_set(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 10))
    rows = [(1, s, i, base[p].tolist()) for s, order in enumerate([[0, 1, 2, 3], [2, 0, 3, 1], [3, 2, 1, 0]]) for i, p in enumerate(order)]
    out = A.mean_maps(spark.createDataFrame(rows, "grp int, subject int, k int, m array<double>"), "grp").collect()
    assert out[0]["similarity"] == pytest.approx(1)
    assert recovered(np.array([r["m"] for r in out]), (base - base.mean(axis=1, keepdims=True)) / np.linalg.norm(base - base.mean(axis=1, keepdims=True), axis=1, keepdims=True)) > 0.999


def test_principal_components_against_numpy(spark):
    x = np.random.default_rng(7).normal(size=(50, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    samples = as_samples(spark, x)
    found = C.principal_components(samples, 0.9).orderBy("i").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert len(found) == int(np.argmax(np.cumsum(values / values.sum()) >= 0.9)) + 1
    assert [r["eigenvalue"] for r in found] == pytest.approx(values[: len(found)].tolist())
    assert C.principal_components(samples, 2.0).count() == 5
    scores = C.component_scores(samples, C.principal_components(samples, 2.0), True).orderBy("t").first()["v"]
    assert np.linalg.norm(scores) == pytest.approx(np.linalg.norm(x[0] - x.mean(axis=0)))


def test_component_ratios_and_reconstruction(spark):
    x = np.random.default_rng(17).normal(size=(40, 6))
    samples = as_samples(spark, x)
    found = C.principal_components(samples, 2.0)
    rows = found.orderBy("i").collect()
    assert sum(r["ratio"] for r in rows) == pytest.approx(1)
    scores = np.array([r["v"] for r in C.component_scores(samples, found, True).orderBy("t").collect()])
    vectors = np.array([r["vector"] for r in rows])
    assert np.abs(scores @ vectors + x.mean(axis=0) - x).max() < 1e-9
    maps = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("a", 1, [0.5, 0.0, 0.0, 2.0, 0.0, 0.0])], "subject string, k int, m array<double>")
    back = {r["k"]: r["m"] for r in C.back_projection(maps, found).collect()}
    assert back[0] == pytest.approx(vectors[0].tolist()) and back[1] == pytest.approx((0.5 * vectors[0] + 2 * vectors[3]).tolist())
    parts = np.array([[r["i"], r["j"], r["c"]] for r in C.covariance(samples.repartition(3)).collect()])
    assert all(c == pytest.approx(np.cov(x.T)[int(i), int(j)]) for i, j, c in parts)


def test_k_sweep_finds_the_planted_number(spark):
    maps, _, data = planted(k=4, n=400, noise=0.03)
    found = C.kmeans_modified(as_samples(spark, data - data.mean(axis=1, keepdims=True)), 2, 6, 20)
    assert found.where("k_total = 4").count() == 4
    gev = {r["k_total"]: r["g"] for r in found.groupBy("k_total").agg(F.sum("gev").alias("g")).collect()}
    assert gev[4] - gev[3] > 5 * abs(gev[5] - gev[4]) and C.best_k(found).first()["k_total"] >= 4


def test_pairwise_similarity_of_permuted_sets(spark):
    base = np.random.default_rng(18).normal(size=(5, 12))
    rows = [(1, s, i, (sign * base[p]).tolist()) for s, (order, sign) in enumerate((([0, 1, 2, 3, 4], 1), ([4, 2, 0, 1, 3], -1))) for i, p in enumerate(order)]
    assert A.pairwise_similarity(spark.createDataFrame(rows, "grp int, subject int, k int, m array<double>")).first()["similarity"] == pytest.approx(1)


def test_surrogates_keep_their_transitions(spark):
    chain = [("a", t, s) for t, s in enumerate(([0, 1, 2] * 40) + [0])] + [("b", t, s) for t, s in enumerate([0, 0, 1, 1] * 30)]
    seq = spark.createDataFrame(chain, "subject string, t long, state int")
    one = {}
    for r in I.surrogates(S.transition_matrix(seq), 60, 2).orderBy("t").collect():
        one.setdefault((r["subject"], r["chain"]), []).append(r["state"])
    assert len(one) == 4 and all(len(x) == 60 for x in one.values())
    assert all((b - a) % 3 == 1 for (s, _), x in one.items() if s == "a" for a, b in itertools.pairwise(x))
    two = {}
    for r in I.surrogates(S.transition_matrix(seq, 2), 60, 2).orderBy("t").collect():
        two.setdefault((r["subject"], r["chain"]), []).append(r["state"])
    known = {(0, 0, 1), (0, 1, 1), (1, 1, 0), (1, 0, 0)}
    assert all(len(x) == 60 for x in two.values())
    assert all(t in known for (s, _), x in two.items() if s == "b" for t in zip(x, x[1:], x[2:], strict=False))


def test_bootstrap_and_tanova(spark):
    rng = np.random.default_rng(19)
    rows = [(k, s, c, (rng.normal(size=12) + (3 * np.sin(np.arange(12) * (c + 1)) if k else 0)).tolist()) for k in (0, 1) for s in range(12) for c in (0, 1)]
    df = spark.createDataFrame(rows, "k int, subject int, condition int, v array<double>")
    band = {r["k"]: r for r in I.bootstrap_test(df, 200).collect()}
    plain = {r["k"]: r["statistic"] for r in I.dissimilarity_of_conditions(df).collect()}
    assert all(band[k]["statistic"] == pytest.approx(plain[k]) and band[k]["low"] < band[k]["high"] for k in (0, 1)) and band[1]["low"] > band[0]["statistic"]
    effects = {r["effect"]: r["p"] for r in I.tanova(df.where("k = 1").unionByName(df.where("k = 1").withColumn("k", F.lit(2))).withColumn("group", F.lit(1)), 200).collect()}
    assert effects["condition"] <= 0.02 and effects["class"] > 0.9


def test_tails():
    assert I.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert I.chi_square_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert I.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert I.t_two_sided(0, 5) == pytest.approx(1)


def test_silhouette_blocks_agree(spark):
    rng = np.random.default_rng(8)
    rows = [("f", i, i % 3, (rng.normal(size=4) + (i % 3)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "file string, i long, label int, v array<double>")
    assert Q.silhouette(df, 7).first()["silhouette"] == pytest.approx(Q.silhouette(df, 1000).first()["silhouette"])
    assert Q.silhouette(df.where("label = 0")).first()["silhouette"] is None


def test_silhouette_of_parts_and_near_points(spark):
    """Several parts a file, copies and points so near that products lose their distance: as by definition, with no row that holds a block's points."""
    rng = np.random.default_rng(18)
    v = rng.normal(size=(60, 5)) + 1000
    v[1], v[2] = v[0], v[0] + 1e-7
    label = np.arange(60) % 4
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    mean = np.array([[d[i, (label == k) & (np.arange(60) != i)].mean() for k in range(4)] for i in range(60)])
    own = mean[np.arange(60), label]
    nearest = np.where(label[:, None] == np.arange(4), np.inf, mean).min(axis=1)
    df = spark.createDataFrame([("f", i, int(label[i]), v[i].tolist()) for i in range(60)], "file string, i long, label int, v array<double>")
    for block, together in ((4, 3), (7, 1), (2000, 8)):
        assert Q.silhouette(df, block, together).first()["silhouette"] == pytest.approx(((nearest - own) / np.maximum(nearest, own)).mean(), abs=1e-9)
    assert np.allclose(Q.distances(v, v), d, rtol=1e-9, atol=0)


def test_silhouette_finds_each_distance_once(monkeypatch):
    """Sums for both points of a pair from one distance, in tiles; copies of an id don't meet, points without label count for nobody."""
    rng = np.random.default_rng(24)
    i, code, v = rng.permutation(50), rng.integers(-1, 3, 50), rng.normal(size=(50, 4))
    i[[7, 30]] = i[3]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    cells, plain = [], Q._Side.distances

    def counted(*given):
        found = plain(*given)
        cells.append(found.size)
        return found

    monkeypatch.setattr(Q._Side, "distances", counted)

    def check(places, meet, block):
        cells.clear()
        sides = [Q._Part(i[at], code[at], v[at], v.mean(axis=0)) for at in places]
        for (s, n), side, at, to in zip(Q._met(sides[0], sides[-1], 3, block), sides, places, places[::-1], strict=True):
            rows = np.ix_(at[side.order], to)
            for k in range(3):
                held = (meet & (code == k)[None])[rows]
                assert np.allclose(s[:, k], (d[rows] * held).sum(axis=1)) and (n[:, k] == held.sum(axis=1)).all()

    for block, most in ((7, 50 * 57 // 2), (64, 50 * 50)):
        check([np.arange(50)], i[:, None] != i[None], block)
        assert sum(cells) <= most
    i[:] = np.arange(50)
    check([np.arange(29), np.arange(29, 50)], i[:, None] != i[None], 6)
    assert sum(cells) == 29 * 21


def test_silhouette_deals_pairs_of_parts(spark):
    """Pairs of parts are a number of tasks, whatever their bytes, and points meet their file's number of parts in shares of the file."""
    df = spark.createDataFrame([("f", t, t % 2, [float(t), 1.0]) for t in range(40)], "file string, i long, label int, v array<double>")
    plan = Q.silhouette(df, 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    pairs = next(x for x in plan.split("\n") if "RepartitionByExpression [file" in x and ", a#" in x and ", b#" in x)
    assert int(pairs.rsplit(" ", 1)[1]) >= 128 and "(deal#" in plan


def test_quality_summary_deals_its_pairs(spark):
    """The summary's silhouettes keep their tasks as dealt, where few bytes would have been put together, and are those of definition."""
    rng = np.random.default_rng(28)
    v, label, file = rng.normal(size=(30, 3)), np.arange(30) % 3, np.arange(30) % 2
    points = spark.createDataFrame([(int(file[i]), i, int(label[i]), v[i].tolist()) for i in range(30)], "file int, i long, label int, v array<double>")
    files = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "condition string, file int")
    found = Q.quality_summary(Q.within_cluster_squares(points).join(Q.silhouette(points, 5, 1), "file"), files)
    out = {r["condition"]: r for r in found.collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    means = []
    for f in (0, 1):
        at = np.flatnonzero(file == f)
        mean = np.array([[d[i, [j for j in at if label[j] == k and j != i]].mean() for k in range(3)] for i in at])
        own = mean[np.arange(15), label[at]]
        nearest = np.where(label[at][:, None] == np.arange(3), np.inf, mean).min(axis=1)
        means.append(((nearest - own) / np.maximum(nearest, own)).mean())
    assert out["a"]["mean_silhouette"] == pytest.approx(np.mean(means)) and out["b"]["mean_silhouette"] == pytest.approx(means[1]) and out["a"]["files"] == 2
    executed = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    place = next(i for i, x in enumerate(executed) if "FlatMapGroupsInArrow" in x)
    below = next(x for x in executed[place + 1 :] if "Exchange" in x or "AQEShuffleRead" in x)
    assert "REPARTITION_BY_NUM" in "".join(executed[place : place + 6]) and "AQEShuffleRead" not in below


def test_permutation_test_finds_a_planted_effect(spark):
    rng = np.random.default_rng(9)
    rows = [(k, s, c, (rng.normal(size=12) + (3 * np.sin(np.arange(12) * (c + 1)) if k else 0)).tolist()) for k in (0, 1) for s in range(12) for c in (0, 1)]
    out = {r["k"]: r["p"] for r in I.permutation_test(spark.createDataFrame(rows, "k int, subject int, condition int, v array<double>"), 200).collect()}
    assert out[1] <= 0.02 < out[0]


def test_bad_channels(spark):
    bad = spark.createDataFrame([("a", e, c, c == 2 or (c == 1 and e == 0)) for e in range(4) for c in range(4)], "subject string, epoch int, ch int, bad boolean")
    whole = Q.global_bad_channels(bad, 0.5)
    assert [(r["subject"], r["ch"]) for r in whole.collect()] == [("a", 2)]
    marked = {r["epoch"]: r for r in Q.marked_epochs(bad, 0.3, whole).collect()}
    assert marked[0]["ratio"] == pytest.approx(1 / 3) and marked[0]["dropped"] and marked[1]["interpolated"] == []
    mask = {r["ch"]: r["mask"] for r in Q.channel_mask(bad.select("subject", "ch").distinct(), whole, bad.where("epoch = 0 and bad")).collect()}
    assert mask == {0: 0, 1: 1, 2: 1, 3: 0}
    places = spark.createDataFrame([(0, 0.0, 0.5), (1, 90.0, 0.5), (2, 45.0, 0.5)], "ch int, angle double, radius double")
    samples = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 0, 2, 99.0)], "subject string, t long, ch int, x double")
    fixed = {r["ch"]: r["x"] for r in Q.repaired_channels(samples, whole, places).collect()}
    assert fixed == {0: 1.0, 1: 3.0, 2: pytest.approx(2.0)}


def test_reading_with_choices(spark, tmp_path):
    (tmp_path / "long.json").write_text(json.dumps({"rest": [[1, 2], [3, 4], [5, 6]]}))
    assert [r["v"] for r in R.read_recordings(spark, str(tmp_path / "long.json"), channels_first=None).orderBy("t").collect()] == [[1, 2], [3, 4], [5, 6]]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_text("n,x,microstate_label\n4,0.5,1\n5,0.25,2\n6,1.5,1\n")
    path = str(tmp_path / "csv")
    assert R.has_header(spark, path)
    assert [r["v"] for r in R.read_labelled_csv(spark, path, "microstate_label").collect()] == [[0.5], [0.25], [1.5]]
    assert len(R.read_labelled_csv(spark, path, "microstate_label", index=False).first()["v"]) == 2
    assert len(R.read_labelled_csv(spark, path, "microstate_label", index="x").first()["v"]) == 1
    df = spark.createDataFrame([("1", "x1", "1.5"), ("-2", "", "e")], "a string, b string, c string")
    checks = df.select(R.whole_number_like(F.col("a")).alias("w"), R.has_letter(F.col("b")).alias("l"), R.number_like(F.col("c")).alias("n")).collect()
    assert [tuple(r) for r in checks] == [(True, True, True), (True, False, False)]


def test_segments_and_merges(spark):
    rows = spark.createDataFrame([("a", "x", t) for t in range(5)] + [("a", "y", t) for t in range(3)], "subject string, task string, t long")
    merged = J.merged_tasks(rows, spark.createDataFrame([("y#x",)], "merged string")).orderBy("place").collect()
    assert [(r["task"], r["t"]) for r in merged] == [("y", 0), ("y", 1), ("y", 2)] + [("x", t) for t in range(5)]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/s1.json").write_text(json.dumps({"rest": [[1, 2, 3], [4, 5, 6]], "work": [[1], [2]]}))
    got = R.read_recordings(spark, str(tmp_path / "rec"), ["rest"]).orderBy("t").collect()
    assert [(r["subject"], r["t"], r["v"]) for r in got] == [("s1", 0, [1, 4]), ("s1", 1, [2, 5]), ("s1", 2, [3, 6])]
    with pytest.raises(Exception, match="no such task"):
        R.read_recordings(spark, str(tmp_path / "rec"), ["nap"]).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/s.json").write_text('{"rest": [[1, 2], [3]]}')
    with pytest.raises(Exception, match="ragged"):
        R.read_recordings(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert [r["v"] for r in R.read_matrices(spark, str(tmp_path / "m.csv"), 2).orderBy("t").collect()] == [[1, 2], [3, 4]]
    for name, text in (("a", '{"maps": [[1, 2], [3, 4]]}'), ("b", "[[5, 6]]")):
        (tmp_path / "maps").mkdir(exist_ok=True)
        (tmp_path / f"maps/{name}.json").write_text(text)
    assert [(r["subject"], r["k"], r["m"]) for r in R.read_maps(spark, str(tmp_path / "maps")).orderBy("subject", "k").collect()] == [("a", 0, [1, 2]), ("a", 1, [3, 4]), ("b", 0, [5, 6])]
    (tmp_path / "t.txt").write_text("1.5  2 \n\n3 4\n")
    assert [r["v"] for r in R.read_text_matrix(spark, str(tmp_path / "t.txt")).collect()] == [[1.5, 2], [3, 4]]
    (tmp_path / "k.vmrk").write_text("Mk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,345,1,0\n")
    assert [(r["marker"], r["sample"]) for r in R.read_markers(spark, str(tmp_path / "k.vmrk")).collect()] == [(2, 345)]
    (tmp_path / "c.locs").write_text("1\t-18\t0.511\tFp1\n2\t0\t0.25\tFz\n")
    assert [(r["ch"], r["name"]) for r in R.read_montage(spark, str(tmp_path / "c.locs")).collect()] == [(0, "Fp1"), (1, "Fz")]
    R.write_json(spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "x double, y array<double>"), str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out").glob("part*.json")).read_text()) == {"x": None, "y": [1.0, None]}


def test_four_levels(spark):
    rows = []
    for s, subject in enumerate(("p", "q")):
        for t, task in enumerate(("rest_1", "rest_2", "work_1")):
            _, _, data = planted(n=300, seed=2, noise=0.02 + 0.01 * (s + t))
            rows += [(subject, task, i, v.tolist()) for i, v in enumerate(data)]
    recordings = spark.createDataFrame(rows, "subject string, task string, t long, v array<double>")
    maps = H.individual_maps(recordings, 3, 3, 5, distance=2).cache()
    runs = H.across_runs(maps, R.conditions(spark, {"rest": ["rest_1", "rest_2"], "work": ["work_1"]}), 3)
    assert runs.select("subject", "condition").distinct().count() == 4
    groups = H.across_subjects(runs)
    final = H.across_conditions(groups).orderBy("k").collect()
    assert len(final) == 3 and final[0]["similarity"] > 0.95
    metrics = H.recording_metrics(recordings, spark.createDataFrame([(r["k"], r["m"]) for r in final], "k int, m array<double>"), sfreq=100, seconds=1.0, distance=2, chosen=["coverage", "transition_frequency"])
    total = metrics.where("metric = 'coverage'").groupBy("subject", "task", "epoch").agg(F.sum("value").alias("c")).collect()
    assert len(total) == 2 * 3 * 3 and all(r["c"] == pytest.approx(1) for r in total)
    assert {r["metric"] for r in metrics.select("metric").distinct().collect()} == {"coverage", "transition_frequency"}
    with pytest.raises(ValueError, match="no such metrics"):
        H.recording_metrics(recordings, maps, chosen=["beauty"])


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{i:02d}", "u", s) for i, s in enumerate("aabbab")]
    source = spark.createDataFrame(rows, "ts string, user string, state string").select(F.to_timestamp("ts").alias("ts"), "user", "state")
    source.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def result(df, mode):
        q = df.writeStream.format("memory").queryName(f"q{abs(hash((mode, str(df.schema))))}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(q.name).collect()

    moved = {(r["s0"], r["s1"]): r["n"] for r in result(T.transitions(stream, "ts", "user", "state"), "append")}
    assert moved == {("a", "a"): 1, ("a", "b"): 2, ("b", "b"): 1, ("b", "a"): 1}
    seen = result(T.windowed_coverage(stream, "ts", "user", "state", "10 seconds", "5 seconds"), "complete")
    assert {r["state"]: r["samples"] for r in seen} == {"a": 3, "b": 3}
    assert result(T.sessions(stream, "ts", "user", "5 seconds", "1 second"), "complete")[0]["samples"] == 6


def test_metrics_of_one_profile_equal_those_found_one_by_one(spark):
    rng = np.random.default_rng(7)
    seqs = {"a": rng.integers(0, 4, 400).tolist(), "b": np.repeat(rng.integers(0, 3, 60), rng.integers(1, 9, 60)).tolist(), "c": [2] * 9, "d": [0, 1], "e": [1], "f": [3, 3, 0, 3, 0, 0]}
    df = spark.createDataFrame([(s, t, int(x)) for s, xs in seqs.items() for t, x in enumerate(xs)], "subject string, t long, state int")
    long = df.where("subject <> 'e'")
    one_by_one = {
        "coverage": S.coverage(long), "duration": S.duration_trimmed(long), "duration_seconds": S.duration_label(long, 5).select("subject", "state", "mean"), "occurrence": S.occurrence(long, 5), "segments": S.segments(long),
        "transition_frequency": S.transition_frequency(long, 5), "entropy_rate": S.entropy_rate(long), "transition_matrix": S.transition_matrix(long).select("subject", "s0", "s1", "p"), "hurst": S.hurst_states(long),
    }
    got = {}
    for r in H.sequence_metrics(df, 5).collect():
        got[tuple(r)[:4]] = r["value"]
    want = {}
    for name, found in one_by_one.items():
        for r in found.collect():
            subject, *states, x = tuple(r)
            want[subject, name, *(states + [None, None])[:2]] = x
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-12) if x is not None else got[k] is None, k
    assert {k for k in got if k[0] != "e"} == want.keys() and {k[1] for k in got if k[0] == "e"} == set(H.METRICS)


def test_metrics_leave_unlabelled_samples_out(spark):
    df = spark.createDataFrame([("a", t, s) for t, s in enumerate([None, 0, None, 0, 1, None])], "subject string, t long, state int")
    got = {tuple(r)[1:4]: r["value"] for r in H.sequence_metrics(df, 1, ["coverage", "segments", "transition_matrix"]).collect()}
    assert got == {("coverage", 0, None): 2 / 3, ("coverage", 1, None): 1 / 3, ("segments", 0, None): 1, ("segments", 1, None): 1, ("transition_matrix", 0, 0): 0.5, ("transition_matrix", 0, 1): 0.5}


def test_decay_is_fitted_by_least_squares(spark):
    rng, lag = np.random.default_rng(8), np.arange(1, 41)
    curves = {"a": (2.5, 0.13, 0.5), "b": (-1.0, 0.4, 0.1), "c": (0.3, 0.02, -0.2)}
    rows = [(s, int(t), float(a * np.exp(-b * t) + c + 0.001 * rng.standard_normal())) for s, (a, b, c) in curves.items() for t in lag] + [("few", 1, 1.0), ("few", 2, None)]
    for r in I.exponential_fit(spark.createDataFrame(rows, "subject string, lag int, value double")).collect():
        if r["subject"] == "few":
            assert r["a"] is None and r["left"] is None
            continue
        x = np.array([v for s, _, v in rows if s == r["subject"]])
        miss = x - (r["a"] * np.exp(-r["b"] * lag) + r["c"])
        e = np.exp(-r["b"] * lag)
        assert max(abs(miss @ e), abs(miss @ (lag * e)), abs(miss.sum())) < 1e-4  # no direction lowers the sum
        assert r["left"] < 0.02 and r["b"] == pytest.approx(curves[r["subject"]][1], rel=0.4)


def test_places_of_many_pairs(spark):
    """Squares of 60,000 don't fit an int, and roots of longer lists are rounded."""
    for n in (60_000, 80_000_000):
        last = n * (n - 1) // 2 - 1
        rows = [(k,) for k in (0, n - 2, n - 1, 2 * n - 4, 2 * n - 3, last // 2, last - 3, last - 2, last - 1, last)]
        found = spark.createDataFrame(rows, "k long").withColumn("p", V.square_place(F.col("k"), F.lit(n)))
        for r in found.select("k", "p.i", "p.j", V.condensed_place(F.col("p.j"), F.col("p.i"), F.lit(n)).alias("again")).collect():
            assert 0 <= r["i"] < r["j"] < n
            assert r["again"] == r["k"] == r["i"] * n - r["i"] * (r["i"] + 1) // 2 + r["j"] - 1 - r["i"]


def test_kmeans_rounds_add_what_moved(spark):
    """Sums of products that are kept between rounds, and their leading vectors by squaring, give the maps that each round's own samples would."""
    rng = np.random.default_rng(19)
    data = rng.normal(size=(600, 8)) + 3 * rng.normal(size=(5, 8))[rng.integers(0, 5, 600)]
    summed = []
    grown, C._regroup = C._regroup, lambda maps, grams, data, moved, *labels: (summed.append(len(moved)), grown(maps, grams, data, moved, *labels))[1]
    try:
        maps, label, cv, _ = C.kmeans_run(data, 5, 0, 1)
    finally:
        C._regroup = grown
    assert summed[0] == 600 and min(summed) < 100
    plain = data[np.random.default_rng([1, 5, 0]).permutation(600)[:5]]
    plain = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    for _ in summed:
        own = ((data @ plain.T) ** 2).argmax(axis=1)
        for i in np.unique(own):
            found = np.linalg.eigh(data[own == i].T @ data[own == i])[1][:, -1]
            plain[i] = found * (1 if found[np.abs(found).argmax()] >= 0 else -1)
    assert np.allclose(maps, plain, atol=1e-9)
    even = np.diag([2.0, 2.0 - 1e-9, 1.0])
    assert np.abs(C.leading_vector(even)).round(6).tolist() == [1, 0, 0]


def test_kmeans_spreads_short_rows(spark):
    """Runs of few samples are spread over as many tasks as the session's exchanges have, not joined because they have few bytes."""
    rows = spark.createDataFrame([(0, t, [float((t * j) % 7) for j in range(1, 5)]) for t in range(30)], "subject int, t long, v array<double>")
    tasks = C.kmeans_modified(rows, 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [subject" in tasks and tasks.split("RepartitionByExpression [subject")[1].split("\n")[0].endswith("4")


def test_kmeans_samples_travel_packed(spark):
    """No row has all of a subject's samples; neither the parts that they come in nor the order of samples of one time change the result."""
    rng = np.random.default_rng(25)
    rows = [("a", t // 2 if t < 20 else t, rng.normal(size=4).tolist()) for t in range(300)]
    df = spark.createDataFrame(rows, "subject string, t long, v array<double>").coalesce(1)
    pack, C.PACK = C.PACK, 64
    try:
        packed = C._packed_times(df).collect()
        found = C.kmeans_modified(df, 2, 4, 12)
        one = found.orderBy("k_total", "k").collect()
    finally:
        C.PACK = pack
    assert sorted(len(r["x"]) // 32 for r in packed) == [44, 64, 64, 64, 64] and all(len(r["t"]) * 4 == len(r["x"]) for r in packed)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInPandas" in plan
    assert one == C.kmeans_modified(df.orderBy(F.rand(3)).repartition(3), 2, 4, 12).orderBy("k_total", "k").collect()
    best = min((C.kmeans_run(C._in_order([r["t"] for r in packed], [r["x"] for r in packed]), 3, i, 1) for i in range(12)), key=lambda x: x[2])
    assert np.array_equal([r["m"] for r in one if r["k_total"] == 3], best[0]) and [r["gev"] for r in one if r["k_total"] == 3] == best[3].tolist()


def test_only_kept_numbers_of_maps_are_run(spark):
    """A level that keeps one K of a sweep has that K run only: the filter goes below the runs and their exchange."""
    rng = np.random.default_rng(27)
    recordings = spark.createDataFrame([("p", task, t, rng.normal(size=5).tolist()) for task in ("a", "b") for t in range(40)], "subject string, task string, t long, v array<double>")
    maps = H.individual_maps(recordings, 2, 6, 3, distance=2)
    runs = H.across_runs(maps, R.conditions(spark, {"rest": ["a", "b"]}), 3)
    plan = H.across_subjects(runs)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression [subject")
    assert "best_run(" in above and any("Filter" in x and "k_total" in x and "= 3" in x for x in below.split("\n")) and not any("Filter" in x and "= 3" in x for x in above.split("\n"))
    whole = {r["k"]: r["similarity"] for r in H.across_subjects(H.across_runs(maps.cache(), R.conditions(spark, {"rest": ["a", "b"]}), 3)).collect()}
    maps.unpersist()
    assert whole.keys() == {0, 1, 2} and {r["k"]: r["similarity"] for r in H.across_subjects(runs).collect()} == whole


def test_kmeans_runs_go_side_by_side():
    """Restarts of one task are those that go alone, whatever the tile; few samples, a run cut by rounds and equal products among them."""
    rng = np.random.default_rng(26)
    data = rng.normal(size=(500, 6)) + 2 * rng.normal(size=(4, 6))[rng.integers(0, 4, 500)]
    data[40:60] = data[:20]
    tile, C.TILE = C.TILE, 128
    try:
        together = [list(C.kmeans_runs(x, 4, range(2, 9), 5, rounds=rounds)) for x, rounds in ((data, 1000), (data, 3), (data[:5], 1000))]
    finally:
        C.TILE = tile
    for found, (x, rounds) in zip(together, ((data, 1000), (data, 3), (data[:5], 1000)), strict=True):
        assert [f[0] for f in found] == list(range(2, 9))
        for restart, maps, label, cv, gev in found:
            alone = C.kmeans_run(x, 4, restart, 5, rounds=rounds)
            assert np.allclose(maps, alone[0], atol=1e-9) and (label == alone[1]).all() and cv == pytest.approx(alone[2]) and gev == pytest.approx(alone[3])
    own, reached = C._nearest(data, data[None, [7, 7, 9]])
    products = (data @ data[[7, 7, 9]].T) ** 2
    assert (own[0] == products.argmax(axis=1)).all() and reached[0] == pytest.approx(products.max(axis=1).sum())


def test_decays_of_a_batch_are_those_of_each(spark):
    rng = np.random.default_rng(20)
    lag = np.tile(np.arange(1.0, 7.0), (30, 1))
    value = 2 * np.exp(-rng.uniform(0.2, 2, 30)[:, None] * lag) + 0.3 + rng.normal(size=(30, 6)) * 0.01
    value[3] = 1.0
    found, left = I.fitted_decays(lag, value)
    for i in range(30):
        one = I.fitted_decay(lag[i], value[i])
        assert np.allclose(found[i], one[0], atol=1e-6) and left[i] == pytest.approx(one[1], abs=1e-12)
    rows = [(i, int(t), None if i == 5 and t > 4 else float(v)) for i in range(30) for t, v in zip(lag[i], value[i])] + [(99, 1, 1.0), (99, 2, None)]
    plan = I.exponential_fit(spark.createDataFrame(rows, "subject int, lag int, value double"))
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().optimizedPlan().toString()
    out = {r["subject"]: r for r in plan.collect()}
    assert len(out) == 31 and out[99]["a"] is None
    assert out[0]["b"] == pytest.approx(found[0][1], abs=1e-6) and out[5]["left"] < 0.05


def test_criteria_of_sets_are_those_of_samples(spark):
    """Several sets a subject against criteria() of its samples, without a row for each sample and set."""
    rng = np.random.default_rng(21)
    data = rng.normal(size=(50, 6))
    data -= data.mean(axis=1, keepdims=True)
    sets = {k: rng.normal(size=(k, 6)) for k in (2, 3)}
    sets = {k: (m - m.mean(axis=1, keepdims=True)) / np.linalg.norm(m - m.mean(axis=1, keepdims=True), axis=1, keepdims=True) for k, m in sets.items()}
    rows = spark.createDataFrame([("s", t, v.tolist()) for t, v in enumerate(data)] + [("s", 50, [0.0] * 6)], "subject string, t long, v array<double>")
    maps = spark.createDataFrame([("s", k, i, m.tolist()) for k, ms in sets.items() for i, m in enumerate(ms)], "subject string, k_total int, k int, m array<double>")
    plan = H.channel_criteria(rows, maps)
    out = {(r["k_total"], r["k"]): r for r in plan.collect()}
    for k, ms in sets.items():
        _, cv, gev = C.criteria(data, ms, False)
        for i in range(k):
            assert out[k, i]["cv"] == pytest.approx(cv) and out[k, i]["gev"] == pytest.approx(gev[i])
    assert "zip_with" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_surrogates_of_blocks(spark):
    """A row has the steps of several chains, and each chain is its own."""
    matrix = spark.createDataFrame([(7, "a", "b", 3, 0.5, 0.6), (7, "a", "a", 2, 0.3, 0.4), (7, "b", "a", 1, 0.2, 1.0)], "subject int, s0 string, s1 string, n long, joint double, p double")
    plan = I.surrogates(matrix, 12, 23)
    assert "sequence(0, 2" in plan._jdf.queryExecution().analyzed().toString()
    rows = plan.collect()
    assert sorted((r["chain"], r["t"]) for r in rows) == [(c, t) for c in range(23) for t in range(12)]
    chain = {c: "".join(r["state"] for r in sorted(rows, key=lambda r: r["t"]) if r["chain"] == c) for c in range(23)}
    assert all("bb" not in x for x in chain.values()) and len(set(chain.values())) > 10
    fewer = I.surrogates(matrix, 12, 11).collect()
    assert {c: "".join(r["state"] for r in sorted(fewer, key=lambda r: r["t"]) if r["chain"] == c) for c in range(11)} == {c: chain[c] for c in range(11)}


def test_subjects_of_several_parts_stay_apart(spark):
    """Keys that differ after a null character only, in one batch."""
    rng = np.random.default_rng(22)
    rows = [(f"s\u0000{task}", t, (rng.normal(size=4) * (1 + 5 * (np.arange(4) == j))).tolist()) for t in range(40) for j, task in enumerate(("a", "b", "c"))]
    df = spark.createDataFrame(rows, "subject string, t long, v array<double>").coalesce(1)
    found = {r["subject"]: np.abs(r["vector"]).argmax() for r in C.principal_components(df, 1.0).where("i = 0").collect()}
    assert found == {"s\u0000a": 0, "s\u0000b": 1, "s\u0000c": 2}
    recordings = df.selectExpr("'s' AS subject", "substr(subject, 3) AS task", "t", "v")
    assert {r["task"] for r in H.principal_maps(recordings, 1.0, least=2, most=2, restarts=2, peaks_only=False).collect()} == {"a", "b", "c"}


def test_agglomeration_keeps_no_square():
    """The memory of samples, not of their square; and the maps of each round's search among all."""
    import tracemalloc

    rng = np.random.default_rng(23)
    data = rng.normal(size=(1500, 4))
    tracemalloc.start()
    found = list(C.agglomerate(data[:300], 2, 4))
    short = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for k, *_ in found] == [4, 3, 2]
    tracemalloc.start()
    cells, C.CELLS = C.CELLS, 3000
    try:
        next(C.agglomerate(data, 4, 4))
        again = list(C.agglomerate(data[:300], 2, 4))
    finally:
        C.CELLS = cells
    assert tracemalloc.get_traced_memory()[1] < 1500 * 1500 * 8 / 4
    tracemalloc.stop()
    assert short > 0 and all(np.allclose(a[1], b[1]) and a[2] == pytest.approx(b[2]) for a, b in zip(found, again, strict=True))


def test_block_entropies_from_one_order(spark):
    """All lengths of block from one order by time, null states and short sequences among them."""
    given = {1: list("abcabbac") + [None, "a", None], 2: ["a", "b"], 3: ["a"]}
    seq = spark.createDataFrame([(s, t, x) for s, xs in given.items() for t, x in enumerate(xs)], "subject int, t long, state string")
    plan = S.block_entropies(seq, 3)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    out = {(r["subject"], r["k"]): r["entropy"] for r in plan.collect()}
    assert out.keys() == {(1, 1), (1, 2), (1, 3), (2, 1)}
    for k in (1, 2, 3):
        blocks = [tuple(given[1][i : i + k]) for i in range(len(given[1]) - k)]
        shares = np.array([blocks.count(b) for b in set(blocks)]) / len(blocks)
        assert out[1, k] == pytest.approx(-(shares * np.log2(shares)).sum())
