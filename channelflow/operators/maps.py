"""Sample vectors against prototype maps: field power, spatial correlation, labels and explained variance.

Samples are (subject, t, v array<double>), maps (subject, k, m array<double>): a handful for each subject. Each subject's maps travel as
one array, joined by subject, so a sample meets all of them in one row and nothing is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V


def field_power(samples: DataFrame) -> DataFrame:
    """Adds gfp, the population deviation over channels."""
    return samples.withColumn("gfp", V.spread(F.col("v")))


def map_sets(maps: DataFrame) -> DataFrame:
    """One row a subject: maps array<struct<k, m>> by k."""
    return maps.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("maps"))


def correlated(samples: DataFrame, maps: DataFrame, polarity: bool = False) -> DataFrame:
    """Adds r array<struct<k, r>>: spatial correlation with each map, its absolute value unless polarity counts. Maps without a subject are one set for all samples."""
    value = lambda r: r if polarity else F.abs(r)
    if "subject" in maps.columns:
        joined = samples.join(map_sets(maps), "subject")
    else:
        joined = samples.join(F.broadcast(maps.agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("maps"))), how="cross")  # one row
    return joined.withColumn("r", F.transform("maps", lambda x: F.struct(x["k"].alias("k"), value(V.correlation(F.col("v"), x["m"])).alias("r")))).drop("maps")


def best(r: Column) -> Column:
    """The entry of greatest r, the smaller k on ties; null if no r is known."""
    known = F.filter(r, lambda x: x["r"].isNotNull())
    return F.aggregate(known, F.lit(None).cast("struct<k:int,r:double>"), lambda a, x: F.when(a.isNull() | (x["r"] > a["r"]), F.struct(x["k"].cast("int").alias("k"), x["r"].alias("r"))).otherwise(a))


def labelled(samples: DataFrame, maps: DataFrame, polarity: bool = False, threshold: float | None = None) -> DataFrame:
    """subject, t, v, gfp, state, r: each sample's best map; with a threshold only samples whose r is above it."""
    found = correlated(samples, maps, polarity).withColumn("best", best(F.col("r")))
    out = field_power(found).select("subject", "t", "v", "gfp", F.col("best.k").alias("state"), F.col("best.r").alias("r"))
    return out.where(F.col("r") > threshold) if threshold is not None else out


def explained_variance(labels: DataFrame) -> DataFrame:
    """Global explained variance of each state: sum of gfp^2 r^2 of its samples over that of gfp^2 of all labelled ones."""
    per = labels.where("state is not null").groupBy("subject", "state").agg(F.sum(F.col("gfp") * F.col("gfp") * F.col("r") * F.col("r")).alias("e"), F.sum(F.col("gfp") * F.col("gfp")).alias("g"))
    return per.select("subject", "state", F.try_divide("e", F.sum("g").over(Window.partitionBy("subject"))).alias("gev"))


def residual_variance(labels: DataFrame, maps: DataFrame, normaliser: DataFrame | None = None) -> DataFrame:
    """Variance that the unit maps leave: (sum v^2 - sum (m . v)^2) / (n (channels - 1)); n from normaliser(subject, n) or the rows given."""
    rows = labels.join(maps.withColumnRenamed("k", "state"), ["subject", "state"]).withColumn("p", V.dot(F.col("v"), F.col("m")))
    sums = rows.groupBy("subject").agg(F.sum(V.dot(F.col("v"), F.col("v"))).alias("vv"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.count("*").alias("rows"), F.first(F.size("v")).alias("channels"))
    sums = sums.join(normaliser, "subject") if normaliser is not None else sums.withColumn("n", F.col("rows"))
    return sums.select("subject", "channels", ((F.col("vv") - F.col("pp")) / (F.col("n") * (F.col("channels") - 1))).alias("variance"))


def cross_validation(variance: Column, channels: Column, n_maps: Column) -> Column:
    """Criterion over K: variance (channels - 1)^2 / (channels - K - 1)^2; null where K is channels - 1."""
    return variance * F.try_divide(F.pow(channels - F.lit(1.0), F.lit(2)), F.pow(channels - n_maps - F.lit(1.0), F.lit(2)))


def dissimilarity(r: Column) -> Column:
    return F.sqrt(2 * (1 - r))


def local_maxima(series: DataFrame, value: str) -> DataFrame:
    """Rows above both neighbours in time; the ends have none."""
    w = Window.partitionBy("subject").orderBy("t")
    return series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def peaks_in_range(series: DataFrame, value: str, deviations: float = 3) -> DataFrame:
    """Local maxima within so many population deviations of the series' mean."""
    whole = Window.partitionBy("subject")
    framed = series.withColumn("_m", F.avg(value).over(whole)).withColumn("_s", F.stddev_pop(value).over(whole))
    return local_maxima(framed, value).where(F.abs(F.col(value) - F.col("_m")) <= deviations * F.col("_s")).drop("_m", "_s")


def backfit(samples: DataFrame, peaks: DataFrame, maps: DataFrame, polarity: bool = False) -> DataFrame:
    """subject, t, state: each sample takes the state of the peak whose stretch holds it; a stretch begins midway (rounded down) from the peak before.

    The first peak's stretch begins with the recording, the last one's ends with it; one peak labels all, without peaks states are null. Stretches aren't joined by range:
    the state is set on the row where each begins, and carried forward.
    """
    w = Window.partitionBy("subject").orderBy("t")
    states = labelled(peaks.select("subject", "t", "v"), maps, polarity)
    begins = states.withColumn("before", F.lag("t").over(w)).select("subject", F.coalesce(F.floor((F.col("t") + F.col("before")) / 2), F.lit(0)).cast("long").alias("t"), "state")
    rows = samples.select("subject", "t").join(begins, ["subject", "t"], "left")
    return rows.select("subject", "t", F.last("state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("state"))


def epochs(rows: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """Adds epoch (t / length) and place (t mod length); whole drops a short last epoch."""
    out = rows.withColumn("epoch", F.floor(F.col("t") / length).cast("long")).withColumn("place", F.col("t") % length)
    if whole:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("subject", "epoch"))).where(F.col("_n") == length).drop("_n")
    return out


def long_format(samples: DataFrame, column: str = "v") -> DataFrame:
    """One row a channel: subject, t, ch, x."""
    return samples.select("subject", "t", F.posexplode(column).alias("ch", "x"))
