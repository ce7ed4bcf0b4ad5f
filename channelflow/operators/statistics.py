"""Grouped statistics: weighted moments, outliers, cluster quality, confusion measures, paired comparisons, bad epochs, band power."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V


def weighted_stats(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """Weighted mean and population deviation. Both from one pass over shifted sums would lose digits, so the mean is joined back."""
    means = df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias("mean"))
    beside = df.join(means, list(keys)) if keys else df.join(F.broadcast(means), how="cross")  # one row
    squares = F.sum(F.pow(F.col(x) - F.col("mean"), F.lit(2)) * F.col(w))
    return beside.groupBy(*keys).agg(F.first("mean").alias("mean"), F.sqrt(F.try_divide(squares, F.sum(w))).alias("std"))


def iqr_filter(df: DataFrame, keys: Sequence[str], x: str, factor: float = 1.5) -> DataFrame:
    """Rows within factor interquartile ranges of the quartiles (linear interpolation)."""
    q = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return df.join(q, list(keys)).where(F.col(x).between(lo - factor * (hi - lo), hi + factor * (hi - lo))).drop("q")


def nonzero_mean(x: Column) -> Column:
    return F.try_divide(F.sum(x), F.count_if(x != 0))


def within_cluster_squares(points: DataFrame) -> DataFrame:
    """points(file, label, v): sum over clusters of squared distances to the centroid, from sums per cluster and dimension."""
    per = points.select("file", "label", F.posexplode("v").alias("d", "x")).groupBy("file", "label", "d").agg((F.var_pop("x") * F.count("*")).alias("ss"))
    return per.groupBy("file").agg(F.sum("ss").alias("wcss"))


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from products; those that are small beside the rows' lengths, where products lose digits, from differences."""
    middle = one.mean(axis=0)
    return _Side(one, middle).distances(slice(None), _Side(other, middle), slice(None))


class _Side:
    """Points as products give their distances: less a middle, which leaves distances as they are, with the sums of squares in two more columns."""

    def __init__(self, points: np.ndarray, middle: np.ndarray) -> None:
        self.points, x = points, points - middle
        self.squares = (x**2).sum(axis=1)
        self.rows = np.column_stack([-2 * x, self.squares, np.ones(len(x))])
        self.columns = np.column_stack([x, np.ones(len(x)), self.squares])

    def distances(self, at: slice, other: _Side, there: slice) -> np.ndarray:
        found = self.rows[at] @ other.columns[there].T
        a, b = self.squares[at], other.squares[there]
        if found.size and not found.min() >= 1e-4 * (a.max() + b.max()):
            near, to = np.nonzero(found < 1e-4 * (a[:, None] + b[None]))
            x, y = self.points[at], other.points[there]
            for begin in range(0, len(near), 1 << 14):
                i, j = near[begin : begin + (1 << 14)], to[begin : begin + (1 << 14)]
                found[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
        return np.sqrt(found, out=found)


class _Part:
    """Points in order of their labels' codes, those without label first, and what they are from the points of each label elsewhere."""

    def __init__(self, i: np.ndarray, code: np.ndarray, points: np.ndarray, middle: np.ndarray) -> None:
        self.order = code.argsort(kind="stable")
        self.i, self.code, self.side = i[self.order], code[self.order], _Side(points[self.order], middle)

    def cuts(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Where the labels of these points begin, and their codes."""
        code = self.code[at]
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return begins, code[begins]


ROWS, COLUMNS = 256, 2048  # points of either side whose distances are held at once: what a core's cache holds


def _add(sums: np.ndarray, there: slice, values: np.ndarray, code: np.ndarray) -> None:
    known = code >= 0
    sums[there, code[known]] += values[:, known]


def _met(one: _Part, other: _Part, names: int, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each point of either part (one and the same, if they are the same object) the sums and numbers of its distances to the points of each label in the other part; points of one id don't meet.
    A distance is found once, for both its points."""
    same = one is other
    numbers = [np.bincount(p.code[p.code >= 0], minlength=names).astype(np.int64) for p in (one, other)]
    out = [(np.zeros((len(p.i), names)), np.tile(n, (len(p.i), 1))) for p, n in ((one, numbers[1]), (other, numbers[0]))]
    s, n = out[0]
    back = s if same else out[1][0]
    alike = same and len(np.unique(one.i)) < len(one.i)
    high, wide = min(block, ROWS), min(block, COLUMNS)
    for h in range(0, len(one.i), high):
        here = slice(h, min(h + high, len(one.i)))
        begins, codes = one.cuts(here)
        ends = np.append(begins[1:], here.stop - h)
        if same:
            d = one.side.distances(here, one.side, here)
            own = one.i[here, None] == one.i[None, here]
            own |= np.eye(len(d), dtype=bool)
            d[own] = 0
            _add(s, here, np.add.reduceat(d, begins, axis=1), codes)
            _add(n, here, -np.add.reduceat(own, begins, axis=1, dtype=np.int64), codes)
        for k in range(here.stop if same else 0, len(other.i), wide):
            there = slice(k, min(k + wide, len(other.i)))
            d = one.side.distances(here, other.side, there)
            begins_there, codes_there = other.cuts(there)
            if alike:
                own = one.i[here, None] == other.i[None, there]
                if own.any():
                    d[own] = 0
                    _add(n, here, -np.add.reduceat(own, begins_there, axis=1, dtype=np.int64), codes_there)
                    _add(n, there, -np.add.reduceat(own.T, begins, axis=1, dtype=np.int64), codes)
            _add(s, here, np.add.reduceat(d, begins_there, axis=1), codes_there)
            _add(back, there, np.stack([d[b:e].sum(axis=0) for b, e in zip(begins, ends, strict=True)], axis=1), codes)
    return out[:1] if same else out


PARTS = 12  # of a file, until they would have four times the rows
SPREAD = 128  # tasks at least, over which pairs of parts are dealt
DEALS = 64  # shares of a file in which its points meet its number of parts


def silhouette(points: DataFrame, rows_a_block: int = 2000, blocks_a_part: int = 8) -> DataFrame:
    """points(file, i, label, v): mean silhouette width with Euclidean distances; null unless there are two labels and fewer labels than points.

    Distances are exact over all pairs of a file, which is the measure's definition, so its work grows with the square of a file. Parts of a file meet in tasks of their own, each pair of parts once for
    both its sides; in a task blocks of rows_a_block points at most meet, and only a row of sums by label for each point leaves it. A part has at most four times rows_a_block * blocks_a_part points,
    so what a task holds doesn't grow with a file.
    """
    kinds = dict(points.dtypes)
    size = rows_a_block * blocks_a_part
    count = F.count("*")
    parts = F.greatest(F.least(F.ceil(count / size), F.lit(PARTS)), F.ceil(count / (4 * size)), F.lit(1))
    number = points.groupBy("file").agg(parts.cast("long").alias("parts")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = points.withColumn("deal", F.pmod(F.xxhash64("i"), F.lit(DEALS)).cast("int")).join(number, ["file", "deal"]).withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")))
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least("part", p).alias("a"), F.greatest("part", p).alias("b"))))
    rows = dealt.select("file", "i", "label", "v", "part", met.alias("p")).select("file", "p.a", "p.b", "part", "i", "label", "v")
    tasks = max(SPREAD, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartition(tasks, "file", "a", "b")  # a number, or few bytes would become few tasks

    def run(rows: pa.Table) -> pa.Table:
        name = lambda c: rows[c].combine_chunks().dictionary_encode()
        label, code, i = name("label"), *(name(c).indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("label", "i"))
        v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(float)
        of_part, middle = rows["part"].to_numpy(), v.mean(axis=0)
        places = [np.flatnonzero(of_part == p) for p in dict.fromkeys(rows[c][0].as_py() for c in ("a", "b"))]
        sides = [_Part(i[at], code[at], v[at], middle) for at in places]
        met = _met(sides[0], sides[-1], len(label.dictionary), rows_a_block)
        s, n = (np.concatenate(x) for x in zip(*met, strict=True))
        each = pa.array(np.tile(np.arange(s.shape[1]), len(s)))
        held = pa.StructArray.from_arrays([label.dictionary.take(each), pa.array(s.ravel()), pa.array(n.ravel())], names=["other", "s", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), held)
        points = pa.array(np.concatenate([at[side.order] for at, side in zip(places, sides, strict=True)]))
        return rows.select(["file", "i", "label"]).take(points).append_column("sums", lists)

    shape = f"file {kinds['file']}, i {kinds['i']}, label {kinds['label']}, sums array<struct<other {kinds['label']}, s double, n long>>"
    found = spread.groupBy("file", "a", "b").applyInArrow(run, shape)
    sums = found.repartition("file", "i").select("file", "i", "label", F.inline("sums")).where("n > 0")  # rows of a point meet before they are taken apart
    mean = sums.groupBy("file", "i", "label", "other").agg((F.sum("s") / F.sum("n")).alias("d"))
    per = mean.groupBy("file", "i", "label").agg(F.min(F.when(F.col("other") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("d"))).alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    sizes = points.groupBy("file").agg(F.countDistinct("label").alias("k"), F.count("*").alias("n"))
    return per.groupBy("file").agg(F.avg(width).alias("s")).join(sizes, "file").select("file", F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), F.col("s")).alias("silhouette"))


def confusion_measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Sensitivity, specificity, precision (0 without predictions) and F1 of each class."""
    cells = df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    classes = cells.select(F.col("y").alias("class")).union(cells.select("p")).distinct()
    joined = classes.join(cells, how="cross")  # classes by cells: dimensions, not rows
    is_y, is_p = F.col("y") == F.col("class"), F.col("p") == F.col("class")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    c = joined.groupBy("class").agg(count(is_y & is_p).alias("tp"), count(is_y & ~is_p).alias("fn"), count(~is_y & is_p).alias("fp"), count(~is_y & ~is_p).alias("tn"))
    return c.select(
        "class",
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("sensitivity"),
        F.try_divide("tn", F.col("tn") + F.col("fp")).alias("specificity"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def paired_t(df: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """t of paired differences for each pair of conditions (a < b): a subject's conditions are paired within its own few rows."""
    per = df.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(F.col(condition).alias("c"), F.col(value).alias("x")))).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: b["c"] > a["c"]), lambda b: F.struct(a["c"].alias("a"), b["c"].alias("b"), (a["x"] - b["x"]).alias("d")))))
    d = per.select(F.explode(pairs).alias("p")).select("p.*")
    n = F.count("d")
    return d.groupBy("a", "b").agg(n.alias("n"), F.avg("d").alias("difference"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(n)).alias("t"))


def bonferroni(df: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds adjusted: p times the number of tests (of the keys' group), 1 at most. The numbers come from one aggregate and are joined back."""
    tests = df.groupBy(*keys).agg(F.count(p).alias("_tests"))
    joined = df.join(tests, list(keys)) if keys else df.join(F.broadcast(tests), how="cross")  # one row
    return joined.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_tests"))).drop("_tests")


def bad_epochs(samples: DataFrame, length: int, thresholds: Sequence[float]) -> DataFrame:
    """(subject, epoch, ch, bad) by four criteria: variance, median gradient, range, and deviation of the channel's mean from the epoch's; bad if any z score over the
    subject's epochs is above its threshold. samples(subject, t, ch, x), whole epochs only."""
    per = Window.partitionBy("subject", "ch", "epoch").orderBy("place")
    rows = samples.withColumn("epoch", F.floor(F.col("t") / length)).withColumn("place", F.col("t") % length)
    before, after = F.lag("x").over(per), F.lead("x").over(per)
    slope = F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2)
    crit = (
        rows.withColumn("slope", slope)
        .groupBy("subject", "epoch", "ch")
        .agg(F.var_pop("x").alias("c0"), F.percentile("slope", 0.5).alias("c1"), (F.max("x") - F.min("x")).alias("c2"), F.avg("x").alias("m"), F.count("*").alias("n"))
        .where(F.col("n") == length)
    )
    crit = crit.withColumn("c3", F.col("m") - F.avg("m").over(Window.partitionBy("subject", "epoch")))
    channel = Window.partitionBy("subject", "ch")
    flags = [F.coalesce(F.try_divide(F.col(f"c{i}") - F.avg(f"c{i}").over(channel), F.stddev_pop(f"c{i}").over(channel)) > z, F.lit(False)) for i, z in enumerate(thresholds)]
    return crit.select("subject", "epoch", "ch", (flags[0] | flags[1] | flags[2] | flags[3]).alias("bad"))


def marked_epochs(bad: DataFrame, drop_ratio: float = 0.25, global_bads: DataFrame | None = None) -> DataFrame:
    """subject, epoch, ratio, dropped, interpolated: an epoch is dropped if so large a share of its channels is bad, else its bad channels are left to interpolation.

    global_bads(subject, ch) are bad in all epochs: they neither count for the ratio nor are interpolated with an epoch.
    """
    judged = bad.join(global_bads, ["subject", "ch"], "left_anti") if global_bads is not None else bad
    per = judged.groupBy("subject", "epoch").agg(F.avg(F.col("bad").cast("double")).alias("ratio"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("ch")))).alias("found"))
    dropped = F.col("ratio") >= drop_ratio
    return per.select("subject", "epoch", "ratio", dropped.alias("dropped"), F.when(dropped, F.array().cast("array<int>")).otherwise(F.col("found")).alias("interpolated"))


def global_bad_channels(bad: DataFrame, share: float = 0.5) -> DataFrame:
    """subject, ch of the channels that are bad in more than so large a share of the subject's epochs."""
    per = bad.groupBy("subject", "ch").agg(F.avg(F.col("bad").cast("double")).alias("votes"))
    return per.where(F.col("votes") > share).select("subject", "ch")


def channel_mask(channels: DataFrame, global_bads: DataFrame, local_bads: DataFrame) -> DataFrame:
    """subject, ch, mask of channels(subject, ch): 1 where the channel is in either table of bad channels, else 0."""
    bads = global_bads.select("subject", "ch").union(local_bads.select("subject", "ch")).distinct().withColumn("mask", F.lit(1))
    return channels.select("subject", "ch").join(bads, ["subject", "ch"], "left").select("subject", "ch", F.coalesce("mask", F.lit(0)).alias("mask"))


def channel_groups(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """subject, t, grp, x: mean over the channels of each group (a lobe, a subset); samples(subject, t, ch, x), groups(grp, ch). A channel may be in several groups."""
    return samples.join(groups, "ch").groupBy("subject", "t", "grp").agg(F.avg("x").alias("x"))


def repaired_channels(samples: DataFrame, bads: DataFrame, places: DataFrame, power: float = 2.0) -> DataFrame:
    """samples(subject, t, ch, x) with channels of bads(subject, ch) replaced by the mean of the subject's other ones, weighted by distance ** -power.

    places(ch, angle, radius) is the montage: degrees from the front, and distance from the top. Without other channels x is null.
    """
    at = places.select("ch", (F.col("radius") * F.sin(F.radians("angle"))).alias("px"), (F.col("radius") * F.cos(F.radians("angle"))).alias("py"))
    other = at.select(F.col("ch").alias("from_ch"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    apart = F.sqrt(F.pow(F.col("px") - F.col("qx"), F.lit(2)) + F.pow(F.col("py") - F.col("qy"), F.lit(2)))
    weights = bads.join(at, "ch").join(other, F.col("ch") != F.col("from_ch")).join(bads.select("subject", F.col("ch").alias("from_ch")), ["subject", "from_ch"], "left_anti")
    weights = weights.select("subject", "ch", "from_ch", F.pow(F.greatest(apart, F.lit(1e-9)), F.lit(-power)).alias("w"))  # bad channels by channels: a dimension
    good = samples.join(bads, ["subject", "ch"], "left_anti")
    weighed = good.select("subject", "t", F.col("ch").alias("from_ch"), "x").join(weights, ["subject", "from_ch"])
    made = weighed.groupBy("subject", "t", "ch").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    lost = samples.join(bads, ["subject", "ch"], "left_semi").select("subject", "t", "ch").join(made, ["subject", "t", "ch"], "left")
    return good.select("subject", "t", "ch", "x").unionByName(lost.select("subject", "t", "ch", "x"))


def rereferenced(samples: DataFrame, reference: list[int] | None = None) -> DataFrame:
    """samples(subject, t, ch, x) less the mean of the reference channels (by choice of all) at the same time."""
    chosen = F.avg(F.when(F.col("ch").isin(reference), F.col("x")) if reference else F.col("x"))
    means = samples.groupBy("subject", "t").agg(chosen.alias("_m"))
    return samples.join(means, ["subject", "t"]).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def vote_statistics(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """flags(keys, subject, flagged): mean over subjects of the number flagged, and its standard error, null for one subject."""
    per = flags.groupBy(*keys, "subject").agg(F.count_if("flagged").cast("double").alias("n"))
    return per.groupBy(*keys).agg(F.avg("n").alias("mean"), (F.stddev_samp("n") / F.sqrt(F.count("n"))).alias("sem"), F.count("*").alias("subjects"))


def quality_summary(quality: DataFrame, files: DataFrame) -> DataFrame:
    """condition, files, and mean and population deviation of WCSS and silhouette over the condition's files; quality(file, wcss, silhouette), files(condition, file)."""
    rows = files.join(quality, "file")
    measures = [f(c).alias(f"{name}_{c}") for c in ("wcss", "silhouette") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return rows.groupBy("condition").agg(F.greatest(F.count("wcss"), F.count("silhouette")).alias("files"), *measures)


def mean_best_k(best: DataFrame, least: int = 2) -> DataFrame:
    """task, mean_opt_k, place: the mean best number of maps of each task over its subjects, cut to a whole number, and its place in lists that begin with `least` maps.

    best(subject, task, k_total)."""
    per = best.groupBy("task").agg(F.floor(F.avg("k_total")).cast("int").alias("mean_opt_k"))
    return per.withColumn("place", F.col("mean_opt_k") - least)


def condition_parameters(parameters: DataFrame, conditions: DataFrame) -> DataFrame:
    """subject, condition, state and its duration and occurrence (means of the epochs that have any) and coverage (mean of all), over the epochs of the condition's tasks.

    parameters(subject, task, epoch, state, duration, occurrence, coverage), conditions(condition, place, task)."""
    rows = parameters.join(conditions.select("condition", "task"), "task")
    lengths = [nonzero_mean(F.col(c)).alias(c) for c in ("duration", "occurrence")]
    return rows.groupBy("subject", "condition", "state").agg(*lengths, F.avg("coverage").alias("coverage"))


def in_bands(spectrum: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows of spectrum(f, ...) with each band(band, low, high) that holds their frequency, ends included. The bands travel as one array."""
    all_of = bands.agg(F.collect_list(F.struct("band", "low", "high")).alias("_bands"))
    held = F.filter("_bands", lambda b: F.col("f").between(b["low"], b["high"]))
    rows = spectrum.join(F.broadcast(all_of), how="cross").select(*spectrum.columns, F.explode(held).alias("_band"))  # one row
    return rows.select(*spectrum.columns, "_band.band", "_band.low", "_band.high")


def band_power(spectrum: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spectrum(keys, f, p), bands(band, low, high): area under p from low to high, inclusive, by trapezoids between neighbouring frequencies."""
    joined = in_bands(spectrum, bands)
    w = Window.partitionBy(*keys, "band").orderBy("f")
    area = (F.col("f") - F.lag("f").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2
    return joined.withColumn("area", area).groupBy(*keys, "band").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("power"))
