"""Artefact removal: independent components by fixed-point iteration, and stationary wavelet thresholding of them.

Components: a recording's samples are packed once into blocks; every round is an aggregate over them, the sums of g(w x) x and g'(w x), which are as
large as channels x channels whatever the recording's length. Only such matrices reach the driver, for a bounded number of recordings at a time.
A recording's samples meet its model in slices, so a recording isn't one task.
Wavelets: a series is cut into blocks of time that bring along as many neighbouring samples as the filters reach, so a channel isn't one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.functions.batches import by_key
from channelflow.functions.lineage import kept

TOGETHER = 256  # recordings that are unmixed at once
ROUNDS, ATTEMPTS, TOLERANCE, WIDEN = 200, 3, 0.025, 5.0
BLOCK = 1 << 15  # samples of a block of a series
FEW_TASKS = 64  # whose sums may meet on the driver
SLICE = 2048  # samples of a recording that meet one copy of its model

# Low-pass decomposition filters of the wavelets, in order.
WAVELETS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "coif5": [
        -9.517657273819165e-08, -1.6744288576823017e-07, 2.0637618513646814e-06, 3.7346551751414047e-06, -2.1315026809955787e-05, -4.134043227251251e-05,
        0.00014054114970203437, 0.0003022595818430635, -0.0006381313430451114, -0.0016628637020130838, 0.0024333732126576722, 0.006764185448053083,
        -0.009164231162481846, -0.01976177894257264, 0.03268357426711183, 0.0412892087501817, -0.10557420870333893, -0.06203596396290357,
        0.4379916261718371, 0.7742896036529562, 0.4215662066908515, -0.05204316317624377, -0.09192001055969624, 0.02816802897093635,
        0.023408156785839195, -0.010131117519849788, -0.004159358781386048, 0.0021782363581090178, 0.00035858968789573785, -0.00021208083980379827,
    ],
}


def packed(samples: DataFrame) -> DataFrame:
    """subject, n and x (n samples, binary) of samples(subject, t, v), where they are read: nothing moves."""
    kind = dict(samples.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, part in by_key(batch, "subject"):
                x = np.stack(part["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"subject": [subject], "n": [len(x)], "x": [x.tobytes()]})

    return samples.where("v is not null").select("subject", "v").mapInPandas(run, f"subject {kind}, n long, x binary")


def _summed(blocks: DataFrame, sums, width: dict, tasks: int = FEW_TASKS) -> dict:
    """subject -> sum over its blocks of the array sums(subject, block); tasks add up first, then each subject's rows meet: of few tasks on the driver, else in tasks of their own."""
    kind = dict(blocks.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for subject, n, x in zip(batch["subject"], batch["n"], batch["x"], strict=True):
                if subject in width:
                    found = sums(subject, np.frombuffer(x).reshape(n, -1))
                    total[subject] = total[subject] + found if subject in total else found
        if total:
            yield pd.DataFrame({"subject": list(total), "s": [x.tobytes() for x in total.values()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"subject": rows["subject"].iloc[:1], "s": [np.sum([np.frombuffer(s) for s in rows["s"]], axis=0).tobytes()]})

    parts = blocks.mapInPandas(run, f"subject {kind}, s binary")
    if tasks > FEW_TASKS:
        return {r["subject"]: np.frombuffer(r["s"]) for r in parts.groupBy("subject").applyInPandas(add, f"subject {kind}, s binary").collect()}
    total: dict = {}
    for r in parts.collect():
        total[r["subject"]] = total.get(r["subject"], 0) + np.frombuffer(r["s"])
    return total


def decorrelated(w: np.ndarray) -> np.ndarray:
    """The nearest matrix of orthonormal rows."""
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def whitener(covariance: np.ndarray, components: int | None) -> np.ndarray:
    """Rows that bring centred samples to unit covariance: of the greatest eigenvalues, those that are 0 left out."""
    values, vectors = np.linalg.eigh(covariance)
    order = values.argsort()[::-1][: components or len(values)]
    order = order[values[order] > 1e-10 * max(values.max(), 1e-300)]
    return (vectors[:, order] / np.sqrt(values[order])).T


def unmixed(samples: DataFrame, components: int | None = None, rounds: int = ROUNDS, attempts: int = ATTEMPTS, tolerance: float = TOLERANCE, widen: float = WIDEN, seed: int = 1) -> DataFrame:
    """The independent components of each recording of samples(subject, t, v): subject, n (its samples), mean, unmixing and mixing (components x channels), rounds, tolerance.

    Symmetric fixed-point iteration with g = tanh after whitening. A recording that `attempts` starts of `rounds` rounds don't bring within the tolerance is tried at `widen` times that, and so on; the one that it
    met is told. Components stand by the variance that they explain, the greatest first, and have a positive largest weight, so reruns agree.
    Channels that depend on others give fewer components. A recording of constant samples has none; null samples are left out.
    """
    spark = samples.sparkSession
    blocks = kept(packed(samples))
    groups = max(1, -(-blocks.select("subject").distinct().count() // TOGETHER))  # by a hash, so about so many recordings each
    kind = dict(samples.dtypes)["subject"]
    schema = f"subject {kind}, n long, mean array<double>, unmixing array<array<double>>, mixing array<array<double>>, rounds int, tolerance double"
    out = None
    for g in range(groups):
        own = blocks if groups == 1 else blocks.where(F.pmod(F.xxhash64("subject"), F.lit(groups)) == g)
        found = spark.createDataFrame(_unmix(own, components, rounds, attempts, tolerance, widen, seed), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _unmix(blocks: DataFrame, components: int | None, rounds: int, attempts: int, tolerance: float, widen: float, seed: int) -> list[tuple]:
    tasks = blocks.rdd.getNumPartitions()
    widths = {r["subject"]: r["c"] for r in blocks.groupBy("subject").agg(F.max(F.expr("length(x) div (8 * n)")).cast("int").alias("c")).collect()}
    moments = _summed(blocks, lambda _, x: np.concatenate(([len(x)], x.sum(axis=0))), widths, tasks)
    means = {s: (m[0], m[1:] / m[0]) for s, m in moments.items()}
    squares = _summed(blocks, lambda s, x: ((x - means[s][1]).T @ (x - means[s][1])).ravel(), widths, tasks)
    white = {s: whitener(q.reshape(widths[s], -1) / means[s][0], components) for s, q in squares.items()}
    done: dict = {s: (k, 0, tolerance) for s, k in white.items() if len(k) == 0}
    state = {s: decorrelated(np.random.default_rng([seed, 0]).standard_normal((len(k), len(k)))) for s, k in white.items() if len(k)}
    limits, tries, ran = dict.fromkeys(state, tolerance), dict.fromkeys(state, 0), dict.fromkeys(state, 0)
    while state:

        def sums(s, x, state=state):
            z = (x - means[s][1]) @ white[s].T
            u = np.tanh(z @ state[s].T)
            return np.concatenate(((u.T @ z).ravel(), (1 - u**2).sum(axis=0)))

        total = _summed(blocks, sums, state, tasks)
        after = {}
        for s, w in state.items():
            k, n = len(w), means[s][0]
            new = decorrelated(total[s][: k * k].reshape(k, k) / n - (total[s][k * k :] / n)[:, None] * w)
            ran[s] += 1
            moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
            if moved < limits[s]:
                done[s] = (new @ white[s], ran[s], limits[s])
                continue
            if ran[s] % rounds == 0:
                tries[s] += 1
                limits[s] *= widen if tries[s] % attempts == 0 else 1
                new = decorrelated(np.random.default_rng([seed, tries[s]]).standard_normal((k, k)))
            after[s] = new
        state = after
    rows = []
    for s, (unmixing, n, limit) in done.items():
        mixing = np.linalg.pinv(unmixing).T if len(unmixing) else unmixing
        order = np.argsort(-(mixing**2).sum(axis=1), kind="stable")
        sign = np.where(mixing[np.arange(len(mixing)), np.abs(mixing).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if len(mixing) else 1.0
        rows.append((s, int(means[s][0]), means[s][1].tolist(), (unmixing * sign)[order].tolist(), (mixing * sign)[order].tolist(), n, float(limit)))
    return rows


def times(matrix: Column, v: Column) -> Column:
    """matrix v, row by row."""
    return F.transform(matrix, lambda row: V.dot(row, v))


def combined(weights: Column, rows: Column, n: Column) -> Column:
    """The sum of rows by their weights, of n elements."""
    zero = F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(0.0))
    return F.aggregate(F.zip_with(rows, weights, lambda r, w: F.transform(r, lambda x: x * w)), zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y))


def with_model(samples: DataFrame, model: DataFrame, *columns: Column | str, how: str = "inner") -> DataFrame:
    """samples(subject, t, v) beside the columns of their recording's model(subject, n, ...).

    A recording is dealt over slices of about SLICE samples, each with a copy of the model, so a long one is many tasks. How many slices it has, two numbers a recording, is broadcast: unmixed() held more of each on the driver.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE)).cast("int")
    dealt = samples.select("subject", "t", "v").join(F.broadcast(model.select("subject", slices.alias("_slices"))), "subject", how)
    dealt = dealt.withColumn("_slice", F.pmod(F.xxhash64("t"), F.coalesce("_slices", F.lit(SLICE))).cast("int")).drop("_slices")
    copies = model.select("subject", *columns, F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"))
    return dealt.join(copies.hint("merge"), ["subject", "_slice"], how).drop("_slice")


def sources(samples: DataFrame, model: DataFrame) -> DataFrame:
    """subject, t, v: each sample's components."""
    joined = with_model(samples, model, "mean", "unmixing")
    return joined.select("subject", "t", times(F.col("unmixing"), F.zip_with("v", "mean", lambda x, m: x - m)).alias("v"))


def mixed(parts: DataFrame, model: DataFrame) -> DataFrame:
    """subject, t, v: samples of the components parts(subject, t, v), the inverse of sources()."""
    joined = with_model(parts, model, "mean", "mixing")
    back = combined(F.col("v"), F.col("mixing"), F.size("mean"))
    return joined.select("subject", "t", F.zip_with(back, "mean", lambda x, m: x + m).alias("v"))


def kurtosis(parts: DataFrame) -> DataFrame:
    """subject, component, kurtosis (excess) of each component; null for constant ones."""
    cells = parts.select("subject", F.posexplode("v").alias("component", "x"))
    return cells.groupBy("subject", "component").agg(F.kurtosis("x").alias("kurtosis"))


def without_components(samples: DataFrame, model: DataFrame, drop: DataFrame) -> DataFrame:
    """samples(subject, t, v) less what the components of drop(subject, component) add to them. Recordings without a model, or without a row in drop, stay as they are."""
    chosen = drop.select("subject", "component").distinct().groupBy("subject").agg(F.collect_list(F.col("component").cast("int")).alias("chosen"))
    picked = lambda rows: F.transform("chosen", lambda i: F.get(rows, i)).alias(rows)
    of = model.join(chosen, "subject").select("subject", "n", "mean", picked("unmixing"), picked("mixing"))
    joined = with_model(samples, of, "mean", "unmixing", "mixing", how="left")
    weights = times(F.col("unmixing"), F.zip_with("v", "mean", lambda x, m: x - m))
    gone = combined(weights, F.col("mixing"), F.size("mean"))
    return joined.select("subject", "t", F.when(F.col("mean").isNull(), F.col("v")).otherwise(F.zip_with("v", gone, lambda x, g: x - g)).alias("v"))


def _spread(x: np.ndarray, h: np.ndarray, step: int) -> np.ndarray:
    """Circular sum of h[k] x[t + k step]."""
    return sum(c * np.roll(x, -k * step) for k, c in enumerate(h))


def _gathered(x: np.ndarray, h: np.ndarray, step: int) -> np.ndarray:
    return sum(c * np.roll(x, k * step) for k, c in enumerate(h))


def stationary(x: np.ndarray, wavelet: str, levels: int) -> np.ndarray:
    """Undecimated transform of a circular series: details of each level, then the last approximation."""
    low = np.array(WAVELETS[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    out = []
    for level in range(levels):
        out.append(_spread(x, high, 1 << level))
        x = _spread(x, low, 1 << level)
    return np.stack([*out, x])


def inverse_stationary(parts: np.ndarray, wavelet: str) -> np.ndarray:
    low = np.array(WAVELETS[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    x = parts[-1]
    for level in reversed(range(len(parts) - 1)):
        x = (_gathered(x, low, 1 << level) + _gathered(parts[level], high, 1 << level)) / 2
    return x


def soft(x: np.ndarray, threshold: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - threshold, 0)


def noise_thresholds(series: DataFrame) -> DataFrame:
    """subject, ch, n, threshold of series(subject, t, ch, x): sqrt(2 log n) times the noise's deviation, the median of the finest Haar details' sizes over 0.6745.

    Details of neighbouring pairs meet by a grouping, not by a window. The median is one of the middle values, exact up to a million pairs and beyond that within a millionth of the rank; where it is 0, a twentieth of the largest stands for it.
    """
    pairs = series.groupBy("subject", "ch", F.floor(F.col("t") / 2).alias("pair")).agg(
        F.sum(F.when(F.col("t") % 2 == 0, F.col("x")).otherwise(-F.col("x"))).alias("d"), F.count("*").alias("m")
    )
    size = F.abs("d") / F.sqrt(F.lit(2.0))
    found = pairs.groupBy("subject", "ch").agg(F.sum("m").alias("n"), F.percentile_approx(size, 0.5, 1_000_000).alias("median"), F.max(size).alias("most"))
    deviation = F.when(F.col("median") > 0, F.col("median")).otherwise(0.05 * F.col("most"))
    return found.select("subject", "ch", "n", (F.sqrt(2 * F.log("n")) * deviation / 0.6745).alias("threshold"))


def wavelet_part(series: DataFrame, wavelet: str = "coif5", levels: int = 5, multiplier: float = 1.0, keep_approximation: bool = False, block: int = BLOCK) -> DataFrame:
    """series(subject, t, ch, x) with what its stationary wavelet coefficients keep above a soft threshold: multiplier times noise_thresholds(), 0 keeps all.

    t counts from 0 without gaps. A series is padded with zeros to a multiple of 2 ** levels and then circular. Blocks of time take along the samples that the filters
    reach, by index, so a long channel is many tasks; results don't depend on the block. The approximation is shrunk too unless told otherwise.
    """
    kinds = dict(series.dtypes)
    reach = 2 * (len(WAVELETS[wavelet]) - 1) * ((1 << levels) - 1)
    limits = noise_thresholds(series)
    rows = series.select("subject", "t", "ch", F.col("x").cast("double").alias("x")).join(limits, ["subject", "ch"])
    unit = 1 << levels
    whole = (F.ceil(F.col("n") / unit) * unit).cast("long").alias("whole")
    rows = rows.withColumn("whole", whole).withColumn("blocks", F.ceil(F.col("whole") / block).cast("long"))
    # the blocks whose reach holds the sample: its own, and those before and after, circularly
    own = F.floor(F.col("t") / block)
    last = F.col("whole") - (F.col("blocks") - 1) * block
    away = -(-reach // block) + 1

    def inside(b: Column) -> Column:
        begin = b * block
        length = F.when(b == F.col("blocks") - 1, last).otherwise(F.lit(block))
        ahead = F.pmod(F.col("t") - begin, F.col("whole"))
        return (ahead < length + reach) | (ahead >= F.col("whole") - reach)

    near = F.filter(F.array_distinct(F.transform(F.sequence(own - away, own + away), lambda b: F.pmod(b, F.col("blocks")))), inside)
    dealt = rows.withColumn("block", F.explode(near))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b, n, size = int(part["block"].iloc[0]), int(part["n"].iloc[0]), int(part["whole"].iloc[0])
        begin = b * block
        length = min(block, size - begin)
        at = part["t"].to_numpy()
        if length + 2 * reach >= size:  # the whole circle
            x = np.zeros(size)
            x[at] = part["x"]
            offset = begin
        else:
            x = np.zeros(length + 2 * reach)
            x[(at - begin + reach) % size] = part["x"]
            offset = reach
        parts = stationary(x, wavelet, levels)
        threshold = multiplier * float(part["threshold"].iloc[0])
        shrunk = slice(0, levels if keep_approximation else levels + 1)
        parts[shrunk] = soft(parts[shrunk], threshold)
        core = inverse_stationary(parts, wavelet)[offset : offset + length]
        keep = min(length, n - begin)
        return pd.DataFrame({"subject": part["subject"].iloc[0], "t": begin + np.arange(max(0, keep)), "ch": part["ch"].iloc[0], "x": core[: max(0, keep)]})

    return dealt.groupBy("subject", "ch", "block").applyInPandas(run, f"subject {kinds['subject']}, t long, ch {kinds['ch']}, x double")


def without_artefacts(samples: DataFrame, wavelet: str = "coif5", levels: int = 5, multiplier: float = 1.0, model: DataFrame | None = None, **options: object) -> DataFrame:
    """samples(subject, t, v) less their artefacts: what wavelet thresholds leave of the independent components is mixed back and taken off.

    model is that of unmixed(), or found here with the options.
    """
    model = kept(unmixed(samples, **options)) if model is None else model
    series = sources(samples, model).select("subject", "t", F.posexplode("v").alias("ch", "x"))
    shrunk = wavelet_part(series, wavelet, levels, multiplier)
    parts = shrunk.groupBy("subject", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda s: s["x"]).alias("v"))
    artefacts = mixed(parts, model).withColumnRenamed("v", "a")
    return samples.join(artefacts, ["subject", "t"]).select("subject", "t", F.zip_with("v", "a", lambda x, a: x - a).alias("v"))
