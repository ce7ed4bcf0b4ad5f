"""The four levels: recordings to maps, runs to conditions, subjects to groups, conditions to one global set.

Each level is a DataFrame of (key..., k, m); a level's sets are averaged by iterated alignment in one task for each group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.functions.lineage import kept
from channelflow.operators import alignment as A
from channelflow.operators import artefacts as W
from channelflow.operators import clustering as C
from channelflow.operators import maps as M
from channelflow.operators import sequences as S
from channelflow.operators import statistics as Q
from channelflow.operators.tasks import by_condition

KEY = "\u0000"


def individual_maps(recordings: DataFrame, least: int = 2, most: int = 10, restarts: int = 100, distance: int = 10, deviations: float = 3, peaks_only: bool = True, method: str = "kmeans") -> DataFrame:
    """Maps of every recording(subject, task, t, v) for each K: subject, task, k_total, k, m, cv, gev. Samples are average-referenced; peaks alone are clustered unless told otherwise."""
    rows = recordings.select(F.concat_ws(KEY, "subject", "task").alias("subject"), "t", V.centred(F.col("v")).alias("v"))
    if peaks_only:
        powered = M.field_power(rows)
        rows = rows.join(C.pick_peaks(powered, "gfp", distance, deviations), ["subject", "t"])
    found = C.aahc(rows, least, most) if method == "aahc" else C.kmeans_modified(rows, least, most, restarts)
    parts = F.split("subject", KEY)
    return found.select(F.get(parts, F.lit(0)).alias("subject"), F.get(parts, F.lit(1)).alias("task"), "k_total", "k", "m", "cv", "gev")


def principal_maps(recordings: DataFrame, share: float = 0.95, **options: object) -> DataFrame:
    """Individual maps found in principal components of the recordings and brought back to channels. Components and maps are kept in the shared folder, so each is found once."""
    rows = recordings.select(F.concat_ws(KEY, "subject", "task").alias("subject"), "t", V.centred(F.col("v")).alias("v"))
    components = kept(C.principal_components(rows, share))
    scores = C.component_scores(rows, components, centre=True)
    parts = F.split("subject", KEY)
    split = lambda df: df.select(F.get(parts, F.lit(0)).alias("subject"), F.get(parts, F.lit(1)).alias("task"), *[c for c in df.columns if c != "subject"])
    found = individual_maps(split(scores), **options)
    keyed = found.select(F.concat_ws(KEY, "subject", "task").alias("subject"), "k_total", "k", "m")
    back = kept(C.back_projection(keyed, components, ("subject", "k_total")))
    judged = channel_criteria(rows, back)
    return split(back.join(judged, ["subject", "k_total", "k"]))


def channel_criteria(samples: DataFrame, maps: DataFrame) -> DataFrame:
    """subject, k_total, k, cv, gev of maps(subject, k_total, k, m), several sets a subject, on samples(subject, t, v).

    Samples are packed where they are read and meet all sets of their subject at once; only sums by map leave a block. Samples without a known correlation have no map and don't count.
    """
    kind = dict(samples.dtypes)["subject"]
    sets = maps.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("k_total", "k", "m"))).alias("sets"))
    joined = W.packed(samples).join(sets.select("subject", F.transform("sets", lambda s: s["k_total"]).alias("totals"), F.transform("sets", lambda s: s["k"]).alias("ks"), F.transform("sets", lambda s: s["m"]).alias("ms")), "subject")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, n, x, totals, ks, ms in batch[["subject", "n", "x", "totals", "ks", "ms"]].itertuples(index=False):
                x, ms = np.frombuffer(x).reshape(n, -1), np.stack(ms).astype(float)
                r = np.abs(C.map_correlations(x, ms))
                r[:, ms.std(axis=1) == 0] = -1.0
                length = np.linalg.norm(ms, axis=1)
                power, squares = x.var(axis=1), (x**2).sum(axis=1)
                along = (x @ np.divide(ms, length[:, None], out=np.zeros_like(ms), where=length[:, None] > 0).T) ** 2
                for total in np.unique(totals):
                    at = np.flatnonzero(totals == total)
                    own = at[r[:, at].argmax(axis=1)]
                    known = (power > 0) & (r[np.arange(n), own] >= 0)
                    own, rows = own[known], np.flatnonzero(known)
                    of = lambda w, own=own: np.bincount(own, weights=w, minlength=len(ms))
                    sums = {"e": of(power[rows] * r[rows, own] ** 2), "g": of(power[rows]), "vv": of(squares[rows]), "pp": of(along[rows, own]), "n": of(np.ones(len(rows)))}
                    yield pd.DataFrame({"subject": subject, "k_total": total, "k": ks[at], "channels": x.shape[1], **{c: v[at] for c, v in sums.items()}})

    sums = joined.mapInPandas(run, f"subject {kind}, k_total int, k int, channels int, e double, g double, vv double, pp double, n double")
    by_map = sums.groupBy("subject", "k_total", "k").agg(F.max("channels").alias("channels"), *[F.sum(c).alias(c) for c in ("e", "g", "vv", "pp", "n")])
    w = Window.partitionBy("subject", "k_total")
    whole = lambda c: F.sum(c).over(w)
    variance = F.try_divide(whole("vv") - whole("pp"), whole("n") * (F.col("channels") - 1))
    cv = M.cross_validation(variance, F.col("channels"), F.count("*").over(w))
    return by_map.select("subject", "k_total", "k", cv.alias("cv"), F.coalesce(F.try_divide("e", whole("g")), F.lit(0.0)).alias("gev"))


def across_runs(maps: DataFrame, conditions: DataFrame, n_maps: int) -> DataFrame:
    """Mean maps of each subject and condition over its tasks: subject, condition, k, m, similarity, deviation."""
    chosen, _ = by_condition(maps.where(F.col("k_total") == n_maps).select("subject", "task", "k", "m"), conditions)
    sets = chosen.select(F.concat_ws(KEY, "subject", "condition").alias("grp"), F.col("task").alias("subject"), "k", "m")
    p = F.split("grp", KEY)
    return A.mean_maps(sets, "grp").select(F.get(p, F.lit(0)).alias("subject"), F.get(p, F.lit(1)).alias("condition"), "k", "m", "similarity", "deviation")


def across_subjects(maps: DataFrame) -> DataFrame:
    """Mean maps of each condition over subjects: condition, k, m, similarity, deviation."""
    return A.mean_maps(maps.select("condition", "subject", "k", "m"), "condition")


def across_conditions(maps: DataFrame) -> DataFrame:
    """One set over all conditions: k, m, similarity, deviation."""
    return A.mean_maps(maps.select(F.lit(0).alias("grp"), F.col("condition").alias("subject"), "k", "m"), "grp").drop("grp")


#: Metrics of one sequence a subject, each as (subject, state or s0 and s1, value).
METRICS = ("coverage", "duration", "duration_seconds", "occurrence", "segments", "transition_frequency", "entropy_rate", "transition_matrix", "hurst")


def _measured(sfreq: float, chosen: Sequence[str]) -> Column:
    """An array of (metric, state_from, state_to, value) from a row of S.profile() and _all, the table's states."""
    c = F.col
    value = lambda name, one, two, x: F.struct(F.lit(name).alias("metric"), one.alias("state_from"), two.alias("state_to"), x.cast("double").alias("value"))
    none = F.lit(None)
    own = lambda state: F.get(F.filter("states", lambda s: s["state"] == state), F.lit(0))
    each = lambda name, of: F.transform("_all", lambda state: value(name, state, none, of(own(state), state)))

    def trimmed(s: Column, state: Column) -> Column:
        lost = F.when(state == c("first_state"), s["first_stored"]).when(state == c("last_state"), s["last_stored"])
        return F.coalesce(F.try_divide(s["stored"] - F.coalesce(lost, F.lit(0)), s["stored_n"] - lost.isNotNull().cast("int")), F.lit(0.0))

    steps = lambda s: F.concat(F.array(F.struct(s["state"].alias("state"), (s["k"] - s["segments"]).alias("n"))), s["nexts"])
    total = lambda s: F.aggregate(steps(s), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    moves = F.flatten(F.transform("states", lambda s: F.transform(F.filter(steps(s), lambda x: x["n"] > 0), lambda x: F.struct(s["state"].alias("a"), x["state"].alias("b"), (x["n"] / total(s)).alias("p"), (s["k"] / c("n")).alias("share")))))
    chunks = F.floor(c("last_t") / int(sfreq)) + 1
    found = {
        "coverage": lambda: each("coverage", lambda s, _: F.coalesce(s["k"], F.lit(0)) / c("n")),
        "duration": lambda: each("duration", trimmed),
        "duration_seconds": lambda: each("duration_seconds", lambda s, _: F.try_divide(s["length"] / sfreq, s["m"])),
        "occurrence": lambda: each("occurrence", lambda s, _: F.coalesce(s["k"], F.lit(0)) / chunks),
        "segments": lambda: F.transform("states", lambda s: value("segments", s["state"], none, s["segments"])),
        "transition_frequency": lambda: F.array(value("transition_frequency", none, none, (c("runs") - 1) / (c("n") / sfreq))),
        "entropy_rate": lambda: F.array(value("entropy_rate", none, none, -F.aggregate(moves, F.lit(0.0), lambda a, x: a + x["share"] * x["p"] * F.ln(x["p"])))),
        "transition_matrix": lambda: F.transform(moves, lambda x: value("transition_matrix", x["a"], x["b"], x["p"])),
    }
    return F.concat(*[found[m]() for m in chosen])


def sequence_metrics(seq: DataFrame, sfreq: float, chosen: Sequence[str] = METRICS) -> DataFrame:
    """subject, metric, state_from, state_to, value: the chosen metrics of each subject's sequence(subject, t, state) in one long table; no other is computed.

    state_from is the state of metrics by state; both are null for metrics of the whole sequence. Unlabelled (null) samples are left out. Subjects of fewer than two labelled samples have one row a metric, with no value.
    All metrics but the Hurst exponent come from one profile of each sequence, so samples are exchanged and ordered once.
    """
    unknown = set(chosen) - set(METRICS)
    if unknown:
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    kind = dict(seq.dtypes)["state"]
    none = F.lit(None).cast(kind)
    subjects = seq.groupBy("subject").agg(F.count("state").alias("_n"))
    enough = seq.where("state is not null").join(subjects.where("_n >= 2").select("subject"), "subject", "left_semi")
    short = subjects.where("_n < 2").select("subject", F.explode(F.array(*[F.lit(m) for m in chosen])).alias("metric"), none.alias("state_from"), none.alias("state_to"), F.lit(None).cast("double").alias("value"))
    out = short
    by_profile = [m for m in chosen if m != "hurst"]
    if by_profile:
        states = enough.select("state").distinct().agg(F.array_sort(F.collect_list("state")).alias("_all"))  # one row: the few states travel as an array
        rows = S.profile(enough).join(F.broadcast(states), how="cross")
        shape = f"array<struct<metric:string, state_from:{kind}, state_to:{kind}, value:double>>"
        out = out.unionByName(rows.select("subject", F.inline(_measured(sfreq, by_profile).cast(shape))))
    if "hurst" in chosen:
        found = S.hurst_states(enough)
        out = out.unionByName(found.select("subject", F.lit("hurst").alias("metric"), F.col("state").alias("state_from"), none.alias("state_to"), F.col("hurst").alias("value")))
    return out


def epoch_sequences(recordings: DataFrame, maps: DataFrame, sfreq: float = 500, seconds: float = 2.0, distance: int = 10, deviations: float = 3, polarity: bool = False) -> DataFrame:
    """subject (recording and epoch), t, state: every epoch of every recording against one map set(k, m). A back-fit begins anew in each epoch."""
    length = int(sfreq * seconds)
    rows = recordings.withColumn("epoch", F.floor(F.col("t") / length)).select(F.concat_ws(KEY, "subject", "task", F.col("epoch").cast("string")).alias("subject"), (F.col("t") % length).alias("t"), V.centred(F.col("v")).alias("v"))
    peaks = rows.join(C.pick_peaks(M.field_power(rows), "gfp", distance, deviations), ["subject", "t"])
    return M.backfit(rows, peaks, maps.select("k", "m"), polarity)


def recording_metrics(
    recordings: DataFrame,
    maps: DataFrame,
    sfreq: float = 500,
    seconds: float = 2.0,
    distance: int = 10,
    deviations: float = 3,
    polarity: bool = False,
    chosen: Sequence[str] = METRICS,
) -> DataFrame:
    """The chosen metrics of every epoch of every recording against one map set(k, m): subject, task, epoch, metric, state_from, state_to, value.

    The sequences that the metrics read are kept in the shared folder.
    """
    seq = kept(epoch_sequences(recordings, maps, sfreq, seconds, distance, deviations, polarity))
    p = F.split("subject", KEY)
    found = sequence_metrics(seq, sfreq, chosen)
    return found.select(F.get(p, F.lit(0)).alias("subject"), F.get(p, F.lit(1)).alias("task"), F.get(p, F.lit(2)).cast("long").alias("epoch"), "metric", "state_from", "state_to", "value")


def explained_by(recordings: DataFrame, maps: DataFrame, conditions: DataFrame | None = None, distance: int = 10, deviations: float = 3) -> DataFrame:
    """Explained variance of each recording(subject, task, t, v), on peaks and on all samples, with its length: subject, task, condition, gev_peaks, gev_raw, n.

    maps(k, m) are one set for all, with condition null; or maps(condition, k, m) with conditions(condition, place, task): a recording meets its task's condition's.
    """
    if conditions is None:
        rows = recordings.withColumn("condition", F.lit(None).cast("string"))
    else:
        rows, _ = by_condition(recordings, conditions)
    key = F.concat_ws(KEY, "subject", "task", F.coalesce("condition", F.lit("")))
    keyed = rows.select(key.alias("subject"), "t", V.centred(F.col("v")).alias("v"))
    if conditions is not None:
        own = rows.select(key.alias("subject"), "condition").distinct().join(maps, "condition")
        maps = own.select("subject", "k", "m")
    labels = M.labelled(keyed, maps)
    peaks = C.pick_peaks(labels.select("subject", "t", "gfp"), "gfp", distance, deviations).withColumn("peak", F.lit(True))
    e, g = F.col("gfp") * F.col("gfp") * F.col("r") * F.col("r"), F.col("gfp") * F.col("gfp")
    joined = labels.join(peaks, ["subject", "t"], "left")
    out = joined.groupBy("subject").agg(F.try_divide(F.sum(F.when(F.col("peak"), e)), F.sum(F.when(F.col("peak"), g))).alias("gev_peaks"), F.try_divide(F.sum(e), F.sum(g)).alias("gev_raw"), F.count("*").alias("n"))
    p = F.split("subject", KEY)
    condition = F.when(F.get(p, F.lit(2)) != "", F.get(p, F.lit(2)))
    return out.select(F.get(p, F.lit(0)).alias("subject"), F.get(p, F.lit(1)).alias("task"), condition.alias("condition"), "gev_peaks", "gev_raw", "n")


def explained_summary(explained: DataFrame, value: str = "gev_raw") -> DataFrame:
    """condition, mean, std of the explained variance, recordings weighted by their length."""
    return Q.weighted_stats(explained.where(F.col(value).isNotNull()), ["condition"], value, "n")
