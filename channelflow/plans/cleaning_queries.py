"""Queries over cleaned and modelled recordings: independent components, wavelets, splines, coupled components, classifiers; and vendor files, written from the tables and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelflow.functions.lineage import kept
from channelflow.operators import artefacts as W
from channelflow.operators import classification as K
from channelflow.operators import maps as M
from channelflow.operators import multitask as T
from channelflow.operators import spectral as P
from channelflow.operators import splines as L
from channelflow.sources import brainvision as B
from channelflow.sources import matlab as D
from channelflow.sources import sheets as S
from channelflow.sources.recordings import CAP63

from .map_queries import X, long_samples, samples
from .registry import query, rounded, table
from .sequence_queries import states
from .source_queries import new_folder


def recording(spark: SparkSession, folder: str, subjects: int = 1) -> DataFrame:
    return samples(spark, folder, subjects).select("subject", "t", "v")


@query(f"WITH {long_samples(2)}, c AS (SELECT DISTINCT subject, ch FROM x) SELECT a.subject, a.ch AS i, b.ch AS j, CASE WHEN a.ch = b.ch THEN 1.0 ELSE 0.0 END AS c FROM c a JOIN c b USING (subject)")
def independent_components(spark: SparkSession, folder: str) -> DataFrame:
    """Covariances of each recording's components, which are as many as the channels here: 1 with themselves, 0 with others."""
    rows = recording(spark, folder, 2)
    parts = W.sources(rows, kept(W.unmixed(rows))).select("subject", "t", F.posexplode("v").alias("i", "x"))
    n = F.count("*")
    pairs = parts.join(parts.select("subject", "t", F.col("i").alias("j"), F.col("x").alias("y")), ["subject", "t"])  # components x components of each sample
    return rounded(pairs.groupBy("subject", "i", "j").agg((F.sum(F.col("x") * F.col("y")) / n - F.avg("x") * F.avg("y")).alias("c")))


@query(f"WITH {long_samples(2)} SELECT subject, t, ch, round(x, 3) + 0.0 AS x FROM x")
def components_mixed_back(spark: SparkSession, folder: str) -> DataFrame:
    """Samples to components and back."""
    rows = recording(spark, folder, 2)
    model = kept(W.unmixed(rows))
    back = M.long_format(W.mixed(W.sources(rows, model), model))
    return back.select("subject", "t", "ch", (F.round("x", 3) + F.lit(0.0)).alias("x"))


@query()
def components_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Samples without each recording's components of an excess kurtosis above 1."""
    rows = recording(spark, folder, 2)
    model = kept(W.unmixed(rows))
    drop = W.kurtosis(W.sources(rows, model)).where("kurtosis > 1")
    return rounded(M.long_format(W.without_components(rows, model, drop)))


@query(f"WITH {X}, n AS (SELECT ch, count(*) AS n FROM x GROUP BY ch) SELECT ch, 0.0 AS worst, n FROM n")
def wavelet_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """The largest error of each channel after five levels and back, without a threshold; and its length."""
    series = M.long_format(samples(spark, folder))
    back = W.wavelet_part(series, multiplier=0.0).withColumnRenamed("x", "y")
    both = series.join(back, ["subject", "t", "ch"])
    worst = F.max(F.abs(F.col("x") - F.col("y")))
    return both.groupBy("ch").agg((F.round(worst, 5) + F.lit(0.0)).alias("worst"), F.count("*").alias("n"))


@query(
    f"""WITH {X}, p AS (SELECT ch, t // 2 AS k, abs(sum(CASE WHEN t % 2 = 0 THEN x ELSE -x END)) / sqrt(2.0) AS d FROM x GROUP BY ALL),
l AS (SELECT ch, sqrt(2 * ln(n)) * CASE WHEN med > 0 THEN med ELSE 0.05 * most END / 0.6745 AS thr, n, (n + 1) // 2 * 2 AS whole FROM (SELECT ch, quantile_disc(d, 0.5) AS med, max(d) AS most FROM p GROUP BY ch) JOIN (SELECT ch, count(*) AS n FROM x GROUP BY ch) USING (ch)),
g AS (SELECT ch, unnest(range(whole)) AS t, whole, thr, n FROM l), y AS (SELECT g.*, coalesce(x, 0.0) AS x FROM g LEFT JOIN x ON x.ch = g.ch AND x.t = g.t),
z AS (SELECT a.ch, a.t, a.whole, a.n, a.thr, (a.x + b.x) / sqrt(2.0) AS lo, (a.x - b.x) / sqrt(2.0) AS hi FROM y a JOIN y b ON a.ch = b.ch AND b.t = (a.t + 1) % a.whole),
s AS (SELECT ch, t, whole, n, sign(lo) * greatest(abs(lo) - thr, 0) AS lo, sign(hi) * greatest(abs(hi) - thr, 0) AS hi FROM z)
SELECT a.t, a.ch, round(((a.lo + b.lo) / sqrt(2.0) + (a.hi - b.hi) / sqrt(2.0)) / 2, 6) + 0.0 AS x FROM s a JOIN s b ON a.ch = b.ch AND b.t = (a.t + a.whole - 1) % a.whole WHERE a.t < a.n"""
)
def wavelet_shrunk(spark: SparkSession, folder: str) -> DataFrame:
    """One level of the shortest wavelet, details and approximation shrunk by the noise's threshold."""
    return rounded(W.wavelet_part(M.long_format(samples(spark, folder)), "haar", 1).select("t", "ch", "x"))


@query()
def artefacts_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Samples less what wavelet thresholds leave of their independent components, five levels of the long wavelet."""
    return rounded(M.long_format(W.without_artefacts(recording(spark, folder, 2))))


def spread_out(spark: SparkSession) -> DataFrame:
    """A montage of 64 channels: around the head, and down from the top."""
    return spark.range(64).select(F.col("id").cast("int").alias("ch"), (F.col("id") * 137.5 % 360 - 180).alias("angle"), (0.03 + F.col("id") * 0.008).alias("radius"))


def loud_channels(rows: DataFrame) -> DataFrame:
    """subject, ch of each recording's two channels of greatest deviation."""
    per = M.long_format(rows).groupBy("subject", "ch").agg(F.stddev_pop("x").alias("s"))
    top = per.groupBy("subject").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("s", "ch")))), 1, 2).alias("two"))  # the channels of a recording
    return top.select("subject", F.explode("two.ch").alias("ch"))


@query(f"WITH {long_samples(3)}, s AS (SELECT subject, ch, stddev_pop(x) AS s FROM x GROUP BY ALL), b AS (SELECT subject, ch FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY s DESC, ch DESC) AS r FROM s) WHERE r <= 2) SELECT subject, ch, 1.0 AS whole, 62 AS others FROM b")
def spline_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Bad channels' weights give back a constant, so they sum to 1, over all good channels."""
    found = L.spline_weights(loud_channels(recording(spark, folder, 3)), spread_out(spark))
    rows = found.select("subject", F.posexplode("rows").alias("ch", "w")).where("w is not null")
    return rounded(rows.select("subject", "ch", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("whole"), F.size(F.filter("w", lambda x: x != 0)).alias("others")))


@query()
def spline_repaired(spark: SparkSession, folder: str) -> DataFrame:
    rows = recording(spark, folder, 3)
    return rounded(M.long_format(L.spline_repaired(rows, loud_channels(rows), spread_out(spark))))


@query()
def multitask_components(spark: SparkSession, folder: str) -> DataFrame:
    """Eight components of three tasks in each of two groups, from uncoupled to strongly coupled."""
    rows = samples(spark, folder, 2).select(F.col("subject").alias("grp"), (F.col("label") % 3).cast("string").alias("task"), "t", "v")
    found = T.multitask_components(rows, 8, [0.0, 0.01, 0.1, 1.0, 10.0])
    return rounded(found.where("i = 0").select("grp", "coupling", "task", "score", F.size("costs").alias("rounds"), F.element_at("costs", -1).alias("cost")))


KINDS = ["click", "error", "purchase", "signup", "view"]
LENGTH, STRIDE = 20, 10


def state_windows(spark: SparkSession, folder: str) -> DataFrame:
    """subject, condition (which half of its sequence), begin, states: windows of each user's event types, numbered in alphabetical order."""
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("state")) - 1
    rows = states(spark, folder).select("subject", "t", number.cast("int").alias("state"))
    halves = rows.groupBy("subject").agg((F.count("*") / 2).alias("half"))
    cut = P.windows(rows, LENGTH, STRIDE).join(halves, "subject")
    return cut.select("subject", F.when(F.col("begin") < F.col("half"), "first").otherwise("second").alias("condition"), "begin", "states")


@query(
    f"""WITH seq AS (SELECT user_id AS subject, list_position({KINDS}, event_type)::INT - 1 AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
w AS (SELECT a.subject, a.t AS begin, b.t - a.t AS i, b.state FROM seq a JOIN seq b ON a.subject = b.subject AND b.t >= a.t AND b.t < a.t + {LENGTH} WHERE a.t % {STRIDE} = 0),
full_w AS (SELECT *, lead(state) OVER (PARTITION BY subject, begin ORDER BY i) AS next, count(*) OVER (PARTITION BY subject, begin) AS n FROM w), k AS (SELECT * FROM full_w WHERE n = {LENGTH}),
f AS (SELECT subject, begin, state AS feature, count(*) / {LENGTH}.0 AS x FROM k GROUP BY ALL UNION ALL SELECT subject, begin, 5 + state * 5 + next, count(*) / {LENGTH - 1}.0 FROM k WHERE next IS NOT NULL GROUP BY ALL)
SELECT subject, begin, feature::INT AS feature, round(x::DOUBLE, 6) AS x FROM f"""
)
def window_features(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of states and transitions in each window that are not 0."""
    rows = K.window_features(state_windows(spark, folder), len(KINDS)).select("subject", "begin", F.posexplode("features").alias("feature", "x"))
    return rounded(rows.where("x > 0"))


@query()
def held_out_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """How well the half of a user's sequence is told from its windows, by fold of users that the model hasn't seen."""
    return rounded(K.accuracy(K.held_out_conditions(K.window_features(state_windows(spark, folder), len(KINDS)))))


NAMES = [*CAP63, "EOG"]


def brainvision_folder(spark: SparkSession, folder: str) -> str:
    """The samples as four recordings, one task a recording, since each is one file; markers stand where the label is 0."""
    path = new_folder(spark, "brainvision")
    rows = samples(spark, folder, 4)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        marks = tuple(("Stimulus", f"label {x}", t, 1, 0) for t, x in zip(part["t"], part["label"], strict=True) if x < 3)
        name = f"rec_{part['subject'].iloc[0]}"
        B.write_recording(path, name, np.stack(part["v"].to_numpy()).astype(float), NAMES, kind="IEEE_FLOAT_64", multiplexed=bool(part["subject"].iloc[0] % 2), resolution=1.0, markers=marks)
        return pd.DataFrame({"name": [name]})

    rows.groupBy("subject").applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return path


@query(f"WITH {long_samples(4)} SELECT 'rec_' || subject AS subject, t, ch, round(x, 6) + 0.0 AS x FROM x")
def brainvision_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of two layouts, read in ranges of 50 samples."""
    return rounded(M.long_format(B.read_brainvision(spark, brainvision_folder(spark, folder), rows=50)))


@query(
    """WITH e AS (SELECT vec_id % 4 AS s, vec_id // 4 AS t, label FROM embeddings)
SELECT 'rec_' || s AS subject, t, last_value(CASE WHEN label < 3 THEN 'label ' || label END IGNORE NULLS) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS task FROM e"""
)
def brainvision_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Each sample with the last marker before it."""
    path = brainvision_folder(spark, folder)
    return B.marked_stretches(B.read_brainvision(spark, path), B.brainvision_markers(spark, path)).select("subject", "t", "task")


@query(f"WITH {long_samples(4)} SELECT 'sub_' || subject % 2 AS subject, 'task_' || subject // 2 AS task, t, ch, round(x, 6) + 0.0 AS x FROM x")
def mat_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Two deflated MAT files of two matrices each, one task a file."""
    path = new_folder(spark, "mat")
    rows = samples(spark, folder, 4).withColumn("file", F.col("subject") % 2)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        name = f"sub_{part['file'].iloc[0]}"
        given = {f"task_{s // 2}": np.stack(own.sort_values("t")["v"].to_numpy()).T for s, own in part.groupby("subject")}
        files, place = B.file_system(path)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/{name}.mat") as f:
            f.write(D.mat_bytes(given))
        return pd.DataFrame({"name": [name]})

    rows.groupBy("file").applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return rounded(M.long_format(D.read_mat(spark, path).withColumn("subject", F.struct("subject", "task"))).select("subject.subject", "subject.task", "t", "ch", "x"))


@query(
    """WITH n AS (SELECT r_name AS file, n_name AS segment, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT file, 'trials' AS sheet, segment, 0 AS part, k * 10 AS begin, k * 10 + 3 AS "end" FROM n UNION ALL SELECT file, 'trials', segment, 1, k * 10 + 5, k * 10 + 9 FROM n WHERE k % 2 = 1"""
)
def trial_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook for each region, with a row for each of its nations; odd ones have two parts."""
    path = new_folder(spark, "sheets")
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").cast("long").alias("k"))

    def write(part: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = [["trials", "Name", "Start", "End"]]
        for name, k in zip(part["n_name"], part["k"].astype(int).tolist(), strict=True):
            rows.append([name, f"{k * 10},{k * 10 + 5}", f"{k * 10 + 3}, {k * 10 + 9}"] if k % 2 else [name, k * 10, k * 10 + 3])
        region = part["r_name"].iloc[0]
        files, place = B.file_system(path)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/{region}.xlsx") as f:
            f.write(S.workbook_bytes({"trials": rows, "notes": [["nothing"]]}))
        return pd.DataFrame({"name": [region]})

    nations.groupBy("r_name").applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return S.trial_segments(S.read_sheets(spark, path, "trials"))
