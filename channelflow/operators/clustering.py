"""Prototype maps by iteration: modified k-means, agglomeration, a sweep over K, principal components.

What is iterated is a recording's field-power peaks, at most one sample in `distance`; a task holds the peaks of one recording and one K. Peaks themselves are found in blocks of time.
Seeds are fixed and eigenvectors have a canonical sign, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.functions.batches import by_key


def _canonical(vector: np.ndarray) -> np.ndarray:
    return vector * (1 if vector[np.abs(vector).argmax()] >= 0 else -1)


def leading_vector(square: np.ndarray) -> np.ndarray:
    """Unit eigenvector of the greatest eigenvalue of a matrix of products: a column of a high power, squared until the others' share is gone; where two eigenvalues are within about 2 %, by decomposition."""
    total = square.trace()
    if total > 0:
        power = square / total
        for _ in range(10):
            power = power @ power
            power /= power.trace()
            if 1 - np.vdot(power, power) < 1e-8:  # the others' share, which the last squaring takes below a double's digits
                power = power @ power
                column = power[:, power.diagonal().argmax()]
                return column / np.linalg.norm(column)
    return np.linalg.eigh(square)[1][:, -1]


def principal_vector(rows: np.ndarray) -> np.ndarray:
    """Unit eigenvector of the greatest eigenvalue of rows' rows; its largest component is positive."""
    if len(rows) < rows.shape[1]:  # fewer rows than channels: the smaller matrix has the same eigenvalues
        found = rows.T @ leading_vector(rows @ rows.T)
        found = found / max(np.linalg.norm(found), 1e-300)
    else:
        found = leading_vector(rows.T @ rows)
    return _canonical(found)


def principal_vectors(samples: DataFrame) -> DataFrame:
    """subject and vector: principal_vector() of each subject's samples(subject, v), from sums of products of the batches. Nothing is centred."""
    kind = dict(samples.dtypes)["subject"]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, part in by_key(batch, "subject"):
                x = np.stack(part["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"subject": [subject], "p": [(x.T @ x).tobytes()]})

    def leading(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p) for p in rows["p"]], axis=0)
        found = np.linalg.eigh(total.reshape(2 * [int(len(total) ** 0.5)]))[1][:, -1]
        return pd.DataFrame({"subject": rows["subject"].iloc[:1], "vector": [found * (1 if found[np.abs(found).argmax()] >= 0 else -1)]})

    parts = samples.select("subject", "v").mapInPandas(products, f"subject {kind}, p binary")
    return parts.groupBy("subject").applyInPandas(leading, f"subject {kind}, vector array<double>")


def map_correlations(data: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Spatial correlations (samples x maps)."""
    deviation = np.outer(data.std(axis=1), maps.std(axis=1)) * data.shape[1]
    product = data @ (maps - maps.mean(axis=1, keepdims=True)).T
    return np.divide(product, deviation, out=np.zeros_like(product), where=deviation > 0)


def criteria(data: np.ndarray, maps: np.ndarray, polarity: bool, n_total: int | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Labels, cross-validation criterion and explained variance of each map; n_total is the recording's length if data are its peaks."""
    c = map_correlations(data, maps)
    c = c if polarity else np.abs(c)
    label = c.argmax(axis=1)
    channels, k = data.shape[1], len(maps)
    left = (data**2).sum() - ((maps[label] * data).sum(axis=1) ** 2).sum()
    variance = left / ((n_total or len(data)) * (channels - 1))
    free = channels - k - 1
    power = data.std(axis=1) ** 2
    own = c[np.arange(len(data)), label]
    total = power.sum()
    gev = np.bincount(label, weights=power * own**2, minlength=k) / (total if total > 0 else np.inf)  # of samples without power: 0
    return label, variance * (channels - 1) ** 2 / free**2 if free else np.inf, gev


def _regroup(maps: np.ndarray, grams: dict[int, np.ndarray], data: np.ndarray, moved: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Makes maps their samples' principal vectors after some have moved. A map with as many samples as channels keeps the sum of their products, to which those that came are added and from which
    those that went are taken; where that is more than half of its samples, it is summed anew. Maps that no sample joined or left stay."""
    went, came = (np.bincount(side[moved][side[moved] >= 0], minlength=len(maps)) for side in (before, after))
    number = np.bincount(after, minlength=len(maps))
    for i in np.flatnonzero((went + came > 0) & (number > 0)):
        if number[i] < data.shape[1]:
            grams.pop(i, None)
            maps[i] = principal_vector(data[after == i])
            continue
        if i in grams and 2 * (went[i] + came[i]) <= number[i]:
            new, old = data[moved[after[moved] == i]], data[moved[before[moved] == i]]
            grams[i] += new.T @ new - old.T @ old
        else:
            own = data[after == i]
            grams[i] = own.T @ own
        maps[i] = _canonical(leading_vector(grams[i]))


TILE = 4096  # samples that meet the maps of several runs at once


def _nearest(data: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of maps (runs x k x channels) each run's map of greatest squared product with each sample, the first one on ties, and the sum of those products. All runs read a tile of samples together."""
    runs, k, channels = maps.shape
    every, own, reached = maps.reshape(-1, channels), np.empty((runs, len(data)), dtype=np.int32), np.zeros(runs)
    for begin in range(0, len(data), TILE):
        at = slice(begin, begin + TILE)
        products = (every @ data[at].T).reshape(runs, k, -1)
        products *= products
        best, first = products[:, 0].copy(), np.zeros(products[:, 0].shape, dtype=np.int32)
        for j in range(1, k):
            np.maximum(first, (products[:, j] > best) * np.int32(j), out=first)
            np.maximum(best, products[:, j], out=best)
        own[:, at] = first
        reached += best.sum(axis=1)
    return own, reached


def kmeans_runs(
    data: np.ndarray, k: int, restarts: Sequence[int], seed: int, polarity: bool = False, tolerance: float = 1e-6, rounds: int = 1000, n_total: int | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, float, np.ndarray]]:
    """Restart, maps, labels, criterion and explained variances of each restart; their rounds go side by side, so that samples are read once for all.

    Samples go to the map of greatest squared product, maps become their samples' principal vector. A map that loses all samples stays. A run ends when no sample changes its map, or
    when what the maps explain of the samples' power grows by less than the tolerance's share of what is left.
    """
    power = (data**2).sum()
    maps = np.stack([data[np.random.default_rng([seed, k, restart]).permutation(len(data))[:k]] for restart in restarts])
    maps = maps / np.maximum(np.linalg.norm(maps, axis=2, keepdims=True), 1e-300)
    label, explained = np.full((len(restarts), len(data)), -1, dtype=np.int32), np.full(len(restarts), -np.inf)
    grams: list[dict[int, np.ndarray]] = [{} for _ in restarts]
    open_ = np.arange(len(restarts))
    for _ in range(rounds):
        found, reached = _nearest(data, maps[open_])
        going = []
        for run, own, sum_ in zip(open_, found, reached, strict=True):
            moved = np.flatnonzero(own != label[run])
            if len(moved) and sum_ - explained[run] > tolerance * (power - sum_):
                explained[run] = sum_
                _regroup(maps[run], grams[run], data, moved, label[run], own)
                label[run] = own
                going.append(run)
        open_ = np.array(going, dtype=int)
        if not going:
            break
    for restart, own in zip(restarts, maps, strict=True):
        yield restart, own, *criteria(data, own, polarity, n_total)


def kmeans_run(data: np.ndarray, k: int, restart: int, seed: int, polarity: bool = False, **options) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Maps, labels, criterion and explained variances of one restart."""
    return next(kmeans_runs(data, k, [restart], seed, polarity, **options))[1:]


CELLS = 1 << 21  # correlations that are held at once


class _Alive:
    """The maps that are left, centred, and their places among all; dissolved ones are passed over, and leave when they are half of what is kept."""

    def __init__(self, maps: np.ndarray, polarity: bool) -> None:
        self.at, self.polarity, self.dead = np.arange(len(maps)), polarity, np.zeros(len(maps), dtype=bool)
        self.spread, self.centred = maps.std(axis=1), maps - maps.mean(axis=1, keepdims=True)

    def drop(self, i: int) -> None:
        self.dead[np.searchsorted(self.at, i)] = True
        if 2 * self.dead.sum() > len(self.at):
            keep = ~self.dead
            self.at, self.spread, self.centred, self.dead = self.at[keep], self.spread[keep], self.centred[keep], self.dead[keep]

    def put(self, i: np.ndarray, maps: np.ndarray) -> None:
        k = np.searchsorted(self.at, i)
        self.spread[k], self.centred[k] = maps.std(axis=1), maps - maps.mean(axis=1, keepdims=True)

    def best(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The map of greatest correlation with each sample, the first one on ties, and that correlation."""
        at, value = np.empty(len(data), dtype=np.int64), np.empty(len(data))
        step = max(1, CELLS // len(self.at))
        for begin in range(0, len(data), step):
            x = data[begin : begin + step]
            deviation = np.outer(x.std(axis=1), self.spread) * x.shape[1]
            c = np.divide(x @ self.centred.T, deviation, out=np.zeros(deviation.shape), where=deviation > 0)
            c = c if self.polarity else np.abs(c, out=c)
            c[:, self.dead] = -np.inf
            own = c.argmax(axis=1)
            at[begin : begin + step], value[begin : begin + step] = self.at[own], c[np.arange(len(x)), own]
        return at, value


def agglomerate(data: np.ndarray, least: int, most: int, polarity: bool = False) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
    """Atomise and agglomerate: every sample begins as a map; the map of least explained variance is dissolved, its members go to their best
    remaining map, whose vector is found again. Yields (k, maps, criterion, explained variances) from most to least maps.

    Each sample keeps its best map and that correlation only, not those with all maps: a round compares all samples with the maps that it touched, and looks again among all maps for samples whose own was
    touched or dissolved. So memory grows with the samples, not with their square.
    """
    n = len(data)
    size = np.abs if not polarity else np.asarray
    maps = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
    members = {i: [i] for i in range(n)}
    alive_maps = _Alive(maps, polarity)
    best, own = alive_maps.best(data)
    power = data.std(axis=1) ** 2
    while len(members) >= max(1, least):
        alive = np.fromiter(members, dtype=np.int64)
        if len(members) <= most:
            _, cv, gev = criteria(data, maps[alive], polarity)
            yield len(members), maps[alive].copy(), cv, gev
        if len(members) == 1:
            return
        explained = np.bincount(best, weights=power * own**2, minlength=n)
        worst = int(alive[explained[alive].argmin()])
        freed = members.pop(worst)
        alive_maps.drop(worst)
        targets, _ = alive_maps.best(data[freed])
        for i, target in zip(freed, targets, strict=True):
            members[int(target)].append(i)
        touched = np.unique(targets)
        again = np.isin(best, np.append(touched, worst))
        for target in touched:
            maps[target] = principal_vector(data[members[int(target)]])
        alive_maps.put(touched, maps[touched])
        for begin in range(0, len(touched), max(1, CELLS // n)):
            some = touched[begin : begin + max(1, CELLS // n)]
            c = size(map_correlations(data, maps[some]))
            nearest, value = some[c.argmax(axis=1)], c.max(axis=1)
            better = ~again & ((value > own) | (value == own) & (nearest < best))
            best[better], own[better] = nearest[better], value[better]
        best[again], own[again] = alive_maps.best(data[again])


MAPS = "subject {kind}, k_total int, k int, m array<double>, cv double, gev double"


def _rows(subject: object, found: list[tuple[int, np.ndarray, float, np.ndarray]]) -> pd.DataFrame:
    rows = [(subject, k, i, m, cv, float(g)) for k, maps, cv, gev in found for i, (m, g) in enumerate(zip(maps, gev, strict=True))]
    return pd.DataFrame(rows, columns=["subject", "k_total", "k", "m", "cv", "gev"])


def _data(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows.sort_values("t")["v"].to_numpy()).astype(float)


RESTARTS = 10  # of a task
PACK = 2048  # samples of a packed row


def _packed_times(samples: DataFrame) -> DataFrame:
    """subject, t and x (binary) of up to PACK samples(subject, t, v) each, where they are read."""
    kind = dict(samples.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, part in by_key(batch, "subject"):
                for begin in range(0, len(part), PACK):
                    some = part.iloc[begin : begin + PACK]
                    yield pd.DataFrame({"subject": [subject], "t": [some["t"].to_numpy().astype(float).tobytes()], "x": [np.stack(some["v"].to_numpy()).astype(float).tobytes()]})

    return samples.select("subject", "t", "v").mapInPandas(run, f"subject {kind}, t binary, x binary")


def _in_order(t: pd.Series, x: pd.Series) -> np.ndarray:
    """Packed samples by time; those of one time by their values."""
    t = np.frombuffer(b"".join(t))
    data = np.frombuffer(b"".join(x)).reshape(len(t), -1)
    order = t.argsort(kind="stable")
    if (np.diff(t[order]) == 0).any():
        order = np.lexsort((*data.T[::-1], t))
    return data[order]


def kmeans_modified(samples: DataFrame, least: int = 2, most: int = 10, restarts: int = 100, polarity: bool = False, seed: int = 1) -> DataFrame:
    """Maps of each subject for every K from least to most (or its number of samples): subject, k_total, k, m, cv, gev, of the restart of least criterion.

    samples(subject, t, v), usually peaks, travel in packed rows; a task has a subject, a K and a few restarts, so restarts spread over the cluster and a task holds one subject's samples once, as numbers.
    These are groups of an aggregate, so whoever keeps some K only (a filter on k_total) has only these run.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-restarts // RESTARTS) - 1))).alias("block")
    totals = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("k_total")
    runs = _packed_times(samples).select("subject", "t", "x", totals).select("subject", "t", "x", "k_total", blocks)
    runs = runs.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "subject", "k_total", "block")  # a number, or few bytes would become few tasks

    @F.pandas_udf("array<double>")
    def best_run(t: pd.Series, x: pd.Series, k_total: pd.Series, block: pd.Series) -> list:
        """Criterion, restart, and the maps' explained variances and vectors."""
        data, k, first = _in_order(t, x), int(k_total.iloc[0]), int(block.iloc[0]) * RESTARTS
        if len(data) < k:
            return None
        found = kmeans_runs(data, k, range(first, min(restarts, first + RESTARTS)), seed, polarity)
        restart, maps, _, cv, gev = min(found, key=lambda run: (run[3], run[0]))
        return [float(cv), float(restart), *gev.tolist(), *maps.ravel().tolist()]

    found = runs.groupBy("subject", "k_total", "block").agg(best_run("t", "x", "k_total", "block").alias("run")).where("run is not null")
    best = found.groupBy("subject", "k_total").agg(F.min_by("run", F.struct(F.get("run", F.lit(0)), F.get("run", F.lit(1)))).alias("b"))
    channels = F.floor((F.size("b") - 2) / F.col("k_total")).cast("int") - 1
    rows = best.select("subject", "k_total", "b", channels.alias("channels"), F.explode(F.sequence(F.lit(0), F.col("k_total") - 1)).alias("k"))
    vector = F.slice("b", 3 + F.col("k_total") + F.col("k") * F.col("channels"), F.col("channels"))
    return rows.select("subject", "k_total", "k", vector.alias("m"), F.get("b", F.lit(0)).alias("cv"), F.get("b", F.col("k") + 2).alias("gev"))


def best_k(maps: DataFrame) -> DataFrame:
    """subject, k_total: the number of maps of least criterion, the smaller one on ties."""
    return maps.select("subject", "k_total", "cv").distinct().groupBy("subject").agg(F.min(F.struct("cv", "k_total")).alias("b")).select("subject", F.col("b.k_total").alias("k_total"))


def aahc(samples: DataFrame, least: int = 2, most: int = 10, polarity: bool = False) -> DataFrame:
    """The same table by agglomeration; one task a subject, whose rounds grow with its samples, so give it peaks."""
    kind = dict(samples.dtypes)["subject"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(rows["subject"].iloc[0], list(agglomerate(_data(rows), least, most, polarity)))

    return samples.groupBy("subject").applyInPandas(run, MAPS.format(kind=kind))


def covariance(samples: DataFrame) -> DataFrame:
    """subject, i, j, c for j <= i: sample covariances of channels. Each batch gives its number of samples, its means and sums of products around them, so what moves
    doesn't grow with the samples of a batch."""
    kind = dict(samples.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, part in by_key(batch, "subject"):
                x = np.stack(part["v"].to_numpy()).astype(float)
                mean = x.mean(axis=0)
                i, j = np.tril_indices(x.shape[1])
                yield pd.DataFrame({"subject": subject, "i": i, "j": j, "n": len(x), "mi": mean[i], "mj": mean[j], "s": ((x - mean).T @ (x - mean))[i, j]})

    parts = samples.select("subject", "v").mapInPandas(run, f"subject {kind}, i int, j int, n long, mi double, mj double, s double")
    n, n_i, n_j = F.sum("n"), F.sum(F.col("n") * F.col("mi")), F.sum(F.col("n") * F.col("mj"))
    between = F.sum(F.col("n") * F.col("mi") * F.col("mj")) - n_i * n_j / n
    return parts.groupBy("subject", "i", "j").agg(F.try_divide(F.sum("s") + between, n - 1).alias("c"))


def principal_components(samples: DataFrame, share: float) -> DataFrame:
    """subject, i, eigenvalue, ratio, vector: components up to the first whose cumulated ratio reaches the share (all, if none does). The eigenproblem is a task of channels x channels numbers."""
    kind = dict(samples.dtypes)["subject"]

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        n = int(cells["i"].max()) + 1
        c = np.zeros((n, n))
        c[cells["i"], cells["j"]] = cells["c"]
        values, vectors = np.linalg.eigh(c + np.tril(c, -1).T)
        order = values.argsort()[::-1]
        vectors = vectors[:, order].T
        vectors = vectors * np.where(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
        return pd.DataFrame({"subject": cells["subject"].iloc[0], "i": np.arange(n, dtype=np.int32), "eigenvalue": values[order], "vector": list(vectors)})

    found = covariance(samples).groupBy("subject").applyInPandas(run, f"subject {kind}, i int, eigenvalue double, vector array<double>")
    w = Window.partitionBy("subject")
    found = found.withColumn("ratio", F.col("eigenvalue") / F.sum("eigenvalue").over(w))
    before = F.coalesce(F.sum("ratio").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return found.withColumn("_b", before).where(F.col("_b") < share - 1e-12).select("subject", "i", "eigenvalue", "ratio", "vector")


def component_scores(samples: DataFrame, components: DataFrame, centre: bool) -> DataFrame:
    """subject, t, v: samples in component space; centred on the channels' means or, by choice, as they are."""
    sets = components.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("i", "vector"))).alias("components"))
    rows = samples.join(sets, "subject")
    if centre:
        means = samples.select("subject", F.posexplode("v").alias("ch", "x")).groupBy("subject", "ch").agg(F.avg("x").alias("m"))
        means = means.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "m"))), lambda s: s["m"]).alias("means"))
        rows = rows.join(means, "subject").withColumn("v", F.zip_with("v", "means", lambda x, m: x - m))
    return rows.select("subject", "t", F.transform("components", lambda c: V.dot(F.col("v"), c["vector"])).alias("v"))


def back_projection(maps: DataFrame, components: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Maps(keys, k, m) of component space in channel space: sum of components by the map's weights. The first key is the components' subject."""
    rows = maps.select(*keys, "k", F.posexplode("m").alias("i", "w")).join(components.select(F.col("subject").alias(keys[0]), "i", "vector"), [keys[0], "i"])
    cells = rows.select(*keys, "k", "w", F.posexplode("vector").alias("ch", "x")).groupBy(*keys, "k", "ch").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return cells.groupBy(*keys, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda s: s["x"]).alias("m"))


def reclustered(maps: DataFrame, least: int = 2, most: int = 10, restarts: int = 100, seed: int = 1) -> DataFrame:
    """The maps of many recordings, (subject, k, m) by group, clustered themselves as if they were samples: subject (the group), k_total, k, m, cv, gev."""
    w = Window.partitionBy("grp").orderBy("subject", "k")
    samples = maps.select(F.col("grp"), (F.row_number().over(w) - 1).alias("t"), F.col("m").alias("v")).select(F.col("grp").alias("subject"), "t", "v")
    return kmeans_modified(samples, least, most, restarts, seed=seed)


def thinned(t: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay: from the highest down (of equal ones the later first), each that has no kept one nearer than `distance`. t ascends."""
    keep, open_ = np.zeros(len(t), dtype=bool), np.ones(len(t), dtype=bool)
    begin, end = np.searchsorted(t, t - distance, side="right"), np.searchsorted(t, t + distance, side="left")
    for i in np.argsort(height, kind="stable")[::-1]:
        if open_[i]:
            keep[i] = True
            open_[begin[i] : end[i]] = False
    return keep


def all_peaks(series: DataFrame, value: str, block: int) -> DataFrame:
    """subject, t, x of the local maxima of series(subject, t, value), of a plateau its middle.

    Neighbours meet in blocks of time that hold one row of either neighbouring block. Only the ends of plateaus are ordered over a whole recording.
    """
    rows = series.select("subject", "t", F.col(value).cast("double").alias("x"))
    own = F.floor(F.col("t") / block)
    at_edges = F.array(own, F.when(F.col("t") % block == 0, own - 1), F.when((F.col("t") + 1) % block == 0, own + 1))
    dealt = rows.withColumn("own", own).withColumn("block", F.explode(F.array_compact(at_edges)))
    w = Window.partitionBy("subject", "block").orderBy("t")
    beside = dealt.withColumn("a", F.lag("x").over(w)).withColumn("b", F.lead("x").over(w)).where("block = own")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    sharp = beside.where((x > a) & (x > b)).select("subject", "t", "x")
    begins, ends = (x == b) & F.coalesce(x != a, F.lit(True)), (x == a) & F.coalesce(x != b, F.lit(True))
    bounds = beside.where(begins | ends).select("subject", "t", "x", begins.alias("begins"), (x > a).alias("rises"), (x > b).alias("falls"))
    run = Window.partitionBy("subject").orderBy("t")
    flat = bounds.withColumn("t1", F.lead("t").over(run)).withColumn("down", F.lead("falls").over(run)).where("begins and rises and down")
    return sharp.unionByName(flat.select("subject", F.floor((F.col("t") + F.col("t1")) / 2).alias("t"), "x"))


def pick_peaks(series: DataFrame, value: str, distance: int = 10, deviations: float = 3, block: int = 1 << 16) -> DataFrame:
    """subject, t of the peaks of series(subject, t, value): local maxima within so many deviations of the mean, thinned from the highest down so that none is nearer than `distance` to a higher one.

    t counts samples without gaps. Peaks on either side of a stretch of `distance` without any don't touch each other, so the pieces between such stretches are thinned apart: those that begin in one block of time
    are a task's, whatever the recording's length. The result doesn't depend on the block.
    """
    kind = dict(series.dtypes)["subject"]
    block = max(block, distance)
    frame = series.groupBy("subject").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    found = all_peaks(series, value, block).join(frame, "subject").where(F.abs(F.col("x") - F.col("m")) <= deviations * F.col("s")).select("subject", "t", "x")
    own = F.floor(F.col("t") / block)
    dealt = found.withColumn("own", own).withColumn("block", F.explode(F.array_compact(F.array(own, F.when((F.col("t") + distance) >= (own + 1) * block, own + 1)))))
    w = Window.partitionBy("subject", "block").orderBy("t")
    begins = F.coalesce(F.col("t") - F.lag("t").over(w) >= distance, F.lit(True))
    inside = dealt.withColumn("begins", begins & (F.col("block") == F.col("own"))).withColumn("begun", F.max("begins").over(w)).where("block = own")
    # where a block goes on with a piece of an earlier one: the last block before it in which a piece begins
    of_block = inside.groupBy("subject", "block").agg(F.max("begins").alias("any"))
    last = F.last(F.when(F.col("any"), F.col("block")), ignorenulls=True).over(Window.partitionBy("subject").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    home = of_block.select("subject", "block", last.alias("before"))
    pieces = inside.join(home, ["subject", "block"]).withColumn("home", F.when(F.col("begun"), F.col("block")).otherwise(F.col("before")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return rows.loc[thinned(rows["t"].to_numpy(), rows["x"].to_numpy(), distance), ["subject", "t"]]

    return pieces.select("subject", "t", "x", "home").groupBy("subject", "home").applyInPandas(run, f"subject {kind}, t long")
