"""Permutation tests and surrogate sequences with fixed seeds, and tails of the chi-square and t distributions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi_square_tail(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def chi_square_p(g: Column, df: Column) -> Column:
    """p of a G or chi-square statistic: a vectorised function over what is one row a test."""

    @F.pandas_udf("double")
    def p(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or b <= 0 or math.isnan(a) else chi_square_tail(a, b) for a, b in zip(x, n, strict=True)])

    return p(g.cast("double"), df.cast("double"))


def t_p(t: Column, n: Column) -> Column:
    """Two-sided p of t with n - 1 degrees of freedom."""

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or math.isnan(a) or b < 2 else t_two_sided(a, b - 1) for a, b in zip(x, k, strict=True)])

    return p(t.cast("double"), n.cast("double"))


def generalised_dissimilarity(cube: np.ndarray) -> float:
    """cube(subjects, conditions, channels), normalised: sum over conditions of the root mean square distance of the condition's mean from the grand mean."""
    mean = cube.mean(axis=0)
    return float(np.sqrt(((mean - mean.mean(axis=0)) ** 2).mean(axis=1)).sum())


def normalised(cube: np.ndarray) -> np.ndarray:
    """Each subject's map with zero mean and unit deviation over channels."""
    cube = cube - cube.mean(axis=2, keepdims=True)
    spread = cube.std(axis=2, keepdims=True)
    return cube / np.where(spread == 0, 1, spread)


def dissimilarity_of_conditions(rows: DataFrame) -> DataFrame:
    """rows(k, subject, condition, v): for each map k the sum over conditions of the root mean square distance of the condition's mean map from the grand mean, each
    subject's map with zero mean and unit deviation over channels: k, statistic. Sums of channels, in the JVM; permutation tests repeat it on packed cubes."""
    scaled = V.let(V.centred(F.col("v")), lambda c: V.let(V.root_mean_square(c), lambda r: F.transform(c, lambda x: x / F.when(r == 0, 1.0).otherwise(r))))
    cells = rows.select("k", "condition", F.posexplode(scaled).alias("ch", "x")).groupBy("k", "condition", "ch").agg(F.avg("x").alias("x"))
    grand = F.avg("x").over(Window.partitionBy("k", "ch"))  # a map's conditions by channels
    distance = cells.withColumn("d", F.col("x") - grand).groupBy("k", "condition").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("d"))
    return distance.groupBy("k").agg(F.sum("d").alias("statistic"))


BLOCK = 50  # shufflings of a task
CHAINS = 10  # surrogates of a task's row


def _cubes(rows: DataFrame, key: str, places: list[str]) -> DataFrame:
    """One row for each key: cells array<struct<subject, places..., v>>, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("subject", *places, "v"))).alias("cells"))


def complete(cells: list, places: list[str]) -> np.ndarray | None:
    """cells as (subjects, cells of a subject, channels), of the subjects that have every combination of places once; None without any."""
    kinds = [sorted({c[p] for c in cells}) for p in places]
    size = math.prod(map(len, kinds))
    by: dict[object, list] = {}
    for c in cells:
        by.setdefault(c["subject"], []).append(c)
    full = [np.stack([c["v"] for c in found]) for _, found in sorted(by.items()) if len(found) == size and len({tuple(c[p] for p in places) for c in found}) == size]
    return np.stack(full).astype(float) if full else None


def _shuffled(packed: DataFrame, key: str, kind: str, times: int, seed: int, names: list[str], prepared: Callable, measure: Callable[..., np.ndarray]) -> DataFrame:
    """key, effect, statistic, p: the observed measure of each name, and the share of shufflings (the observed order among them) that reach it, in blocks of shufflings.

    A task prepares its array once a block (None: no test) and shuffles that.
    """
    blocks = packed.select(key, "cells", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-(times - 1) // BLOCK) - 1)))).alias("block")).repartition(key, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, cells, block in zip(batch[key], batch["cells"], batch["block"], strict=True):
                ready = prepared(cells)
                if ready is None:
                    rows += [(name, e, None, None) for e in names]
                    continue
                observed = measure(*ready, None)
                rng = np.random.default_rng([seed, block])
                n = max(0, min(BLOCK, times - 1 - block * BLOCK))
                reached = sum((measure(*ready, rng) >= observed - 1e-12 for _ in range(n)), np.zeros(len(names)))
                rows += [(name, e, float(s), float(r)) for e, s, r in zip(names, observed, reached, strict=True)]
            yield pd.DataFrame(rows, columns=[key, "effect", "statistic", "reached"])

    found = blocks.mapInPandas(run, f"{key} {kind}, effect string, statistic double, reached double")
    return found.groupBy(key, "effect").agg(F.max("statistic").alias("statistic"), ((1 + F.sum("reached")) / times).alias("p"))


def permutation_test(rows: DataFrame, times: int = 1000, seed: int = 3) -> DataFrame:
    """rows(k, subject, condition, v): for each map k, the observed dissimilarity of conditions and its p, the share of within-subject shufflings (the observed one
    among them) that reach it. Only subjects with every condition take part. A task has a map's subjects x conditions and a block of shufflings."""

    def prepared(cells: list) -> tuple | None:
        cube = complete(cells, ["condition"])
        return None if cube is None or cube.shape[1] < 2 else (normalised(cube),)

    def measure(cube: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        if rng is not None:
            order = rng.permuted(np.arange(cube.shape[1])[None, :].repeat(len(cube), 0), axis=1)
            cube = np.take_along_axis(cube, order[..., None], axis=1)
        return np.array([generalised_dissimilarity(cube)])

    return _shuffled(_cubes(rows, "k", ["condition"]), "k", dict(rows.dtypes)["k"], times, seed, ["condition"], prepared, measure).drop("effect")


def tanova(rows: DataFrame, times: int = 1000, seed: int = 3) -> DataFrame:
    """rows(group, subject, condition, k, v): p of the condition, class and interaction effects in each group, by shuffling within subjects (the observed order counts once).

    Effects are sums of root mean square distances from the grand mean: of conditions over classes, of classes over conditions, and of cells without their class's mean.
    """

    def prepared(cells: list) -> tuple | None:
        flat = complete(cells, ["condition", "k"])
        return None if flat is None else (flat - flat.mean(axis=2, keepdims=True), len({c["condition"] for c in cells}))

    def measure(flat: np.ndarray, conditions: int, rng: np.random.Generator | None) -> np.ndarray:
        if rng is not None:
            order = np.argsort(rng.random(flat.shape[:2]), axis=1)
            flat = np.take_along_axis(flat, order[..., None], axis=1)
        mean = flat.reshape(len(flat), conditions, -1, flat.shape[-1]).mean(axis=0)
        distance = lambda x: np.sqrt((x**2).mean(axis=-1)).sum()
        grand = mean.mean(axis=(0, 1))
        of_condition, of_class = mean.mean(axis=1) - grand, mean.mean(axis=0) - grand
        return np.array([distance(of_condition), distance(of_class), distance(mean - grand - of_condition[:, None] - of_class[None])])

    return _shuffled(_cubes(rows, "group", ["condition", "k"]), "group", dict(rows.dtypes)["group"], times, seed, ["condition", "class", "interaction"], prepared, measure)


def bootstrap_test(rows: DataFrame, times: int = 1000, seed: int = 3) -> DataFrame:
    """rows(k, subject, condition, v): the dissimilarity of conditions of each map over subjects drawn with replacement: its observed value and the 2.5 and
    97.5 percentiles: k, statistic, low, high. Only subjects with every condition take part."""
    kind = dict(rows.dtypes)["k"]
    packed = _cubes(rows, "k", ["condition"])
    blocks = packed.select("k", "cells", F.explode(F.sequence(F.lit(0), F.lit(-(-times // BLOCK) - 1))).alias("block")).repartition("k", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, cells, block in zip(batch["k"], batch["cells"], batch["block"], strict=True):
                cube = complete(cells, ["condition"])
                if cube is not None:
                    cube, rng = normalised(cube), np.random.default_rng([seed, block])
                    drawn = [generalised_dissimilarity(cube[rng.integers(0, len(cube), len(cube))]) for _ in range(min(BLOCK, times - block * BLOCK))]
                    yield pd.DataFrame({"k": name, "observed": generalised_dissimilarity(cube), "drawn": drawn})

    found = blocks.mapInPandas(run, f"k {kind}, observed double, drawn double").groupBy("k")
    out = found.agg(F.max("observed").alias("statistic"), F.percentile("drawn", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("k", "statistic", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def surrogates(matrix: DataFrame, length: int, count: int, seed: int = 5) -> DataFrame:
    """Chains with each subject's transition probabilities of any order: subject, chain, t, state.

    matrix(subject, s0, ..., sk, n, joint, p) is a transition matrix of order k. A chain's first k states are drawn by their joint share, each further one
    given the k before; a past without a successor begins anew.
    """
    kinds = dict(matrix.dtypes)
    names = sorted((c for c in matrix.columns if c[0] == "s" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    order = len(names) - 1
    steps = matrix.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct(F.array(*names).alias("states"), "joint", "p"))).alias("steps"))
    columns = [F.col(f"steps.{c}").alias(c) for c in ("states", "joint", "p")]
    blocks = F.explode(F.sequence(F.lit(0), F.lit((count - 1) // CHAINS))).alias("block")
    tasks = steps.select("subject", *columns, blocks).repartition("subject", "block")

    def chain_of(subject: object, chain: int, follow: dict, pasts: list, weights: np.ndarray) -> list:
        number = int.from_bytes(hashlib.blake2b(str(subject).encode(), digest_size=8).digest())
        u = np.random.default_rng([seed, chain, number]).random(2 * length)
        pick = lambda total, x: int(min(np.searchsorted(total, x * total[-1], side="right"), len(total) - 1))
        out = list(pasts[pick(weights, u[0])])
        for x, again in zip(u[1:length], u[length:], strict=False):
            if len(out) >= length:
                break
            past = tuple(out[len(out) - order :])
            if past not in follow:
                out += pasts[pick(weights, again)]
                continue
            states, total = follow[past]
            out.append(states[pick(total, x)])
        return out[:length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one row's objects at a time: those of a batch are many times its bytes
                subject, moves, joint, p, block = (batch.column(c)[i].as_py() for c in ("subject", "states", "joint", "p", "block"))
                follow: dict[tuple, tuple[list, list]] = {}
                begin: dict[tuple, float] = {}
                for m, share, chance in zip(moves, joint, p, strict=True):
                    past = tuple(m[:order])
                    states, shares = follow.setdefault(past, ([], []))
                    states.append(m[order])
                    shares.append(chance)
                    begin[past] = begin.get(past, 0.0) + share
                follow = {past: (states, np.cumsum(shares)) for past, (states, shares) in follow.items()}
                pasts, weights = list(begin), np.cumsum(list(begin.values()))
                chains = range(block * CHAINS, min(count, (block + 1) * CHAINS))
                out = [chain_of(subject, c, follow, pasts, weights) for c in chains]
                n = len(out[0])
                columns = [pa.array([subject] * (n * len(out)), batch.schema.field("subject").type), pa.array(np.repeat(np.array(chains, dtype=np.int32), n)), pa.array(np.tile(np.arange(n), len(out)))]
                state = batch.schema.field("states").type.value_type.value_type
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for c in out for x in c], state)], names=["subject", "chain", "t", "state"])

    return tasks.mapInArrow(run, f"subject {kinds['subject']}, chain int, t long, state {kinds['s0']}")


def exponential_decay(points: DataFrame) -> DataFrame:
    """points(subject, lag, value): a and b of a * exp(-b * lag) by a line through the logarithms of the values above 0: subject, a, b."""
    known = points.where("value > 0").withColumn("log", F.ln("value"))
    return known.groupBy("subject").agg(F.exp(F.regr_intercept("log", "lag")).alias("a"), (-F.regr_slope("log", "lag")).alias("b"))


def fitted_decays(lag: np.ndarray, value: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """For each row of lag and value (series x points): a, b, c of a * exp(-b * lag) + c with the least sum of squares, and that sum, by damped Gauss-Newton steps from several rates. All series step together,
    each with its own damping, until it is done."""
    n, within = len(lag), 3 * np.finfo(float).eps
    best, least = np.zeros((n, 3)), np.full(n, np.inf)
    span = np.maximum(np.ptp(lag, axis=1) / 4, 1e-9)
    rise = value[:, 0] - value[:, -1]
    for rate in (0.1, 1.0, 10.0):
        p = np.stack((np.where(rise == 0, 1.0, rise), rate / span, value[:, -1]), axis=1)
        damping = np.full(n, 1e-3)
        miss = value - (p[:, :1] * np.exp(-p[:, 1:2] * lag) + p[:, 2:])
        square = (miss**2).sum(axis=1)
        left = np.arange(n)
        for _ in range(rounds):
            if len(left) == 0:
                break
            x, y, q = lag[left], value[left], p[left]
            e = np.exp(-q[:, 1:2] * x)
            j = np.stack((e, -q[:, :1] * x * e, np.ones_like(x)), axis=2)
            matrix = j.swapaxes(1, 2) @ j
            diagonal = np.maximum(matrix[:, range(3), range(3)], 1e-12) * damping[left, None]
            matrix[:, range(3), range(3)] += diagonal
            step = (np.linalg.pinv(matrix, rcond=within) @ (j.swapaxes(1, 2) @ miss[left][..., None]))[..., 0]
            with np.errstate(over="ignore", invalid="ignore"):
                new = q + step
                after = y - (new[:, :1] * np.exp(-new[:, 1:2] * x) + new[:, 2:])
                square_after = (after**2).sum(axis=1)
            better = np.isfinite(square_after) & (square_after <= square[left])
            done = better & (square[left] - square_after <= 1e-14 * square[left])
            taken = left[better]
            p[taken], miss[taken], square[taken] = new[better], after[better], square_after[better]
            damping[left] *= np.where(better, 0.2, 5.0)
            left = left[~done]
        lower = square < least
        best[lower], least[lower] = p[lower], square[lower]
    return best, least


def fitted_decay(lag: np.ndarray, value: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float] | None:
    """fitted_decays() of one series; None for fewer than three points."""
    if len(lag) < 3:
        return None
    best, left = fitted_decays(np.asarray(lag, dtype=float)[None], np.asarray(value, dtype=float)[None], rounds)
    return best[0], float(left[0])


def exponential_fit(points: DataFrame) -> DataFrame:
    """points(subject, lag, value): a, b and c of a * exp(-b * lag) + c by nonlinear least squares, with the root mean square of what is left. Values may be negative; null ones are left out.

    A row has a subject's points, one a lag; the subjects of a batch that have equally many are fitted together. Subjects of fewer than three points have nulls.
    """
    kind = dict(points.dtypes)["subject"]
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("lag").cast("double").alias("lag"), F.col("value").cast("double").alias("value")))
    packed = points.groupBy("subject").agg(F.array_sort(F.collect_list(known)).alias("p")).select("subject", F.transform("p", lambda x: x["lag"]).alias("lags"), F.transform("p", lambda x: x["value"]).alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["lags"].map(len)
            for n, rows in batch.groupby(sizes.to_numpy(), sort=False):
                out = rows[["subject"]].assign(a=None, b=None, c=None, left=None)
                if n >= 3:
                    found, left = fitted_decays(np.stack(rows["lags"].to_numpy()), np.stack(rows["values"].to_numpy()))
                    out = rows[["subject"]].assign(a=found[:, 0], b=found[:, 1], c=found[:, 2], left=np.sqrt(left / n))
                yield out

    return packed.mapInPandas(run, f"subject {kind}, a double, b double, c double, left double")


def percentile_band(points: DataFrame, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The percentiles of the value over all rows of each key: the confidence band of surrogate statistics."""
    found = points.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    return found.select(*keys, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
