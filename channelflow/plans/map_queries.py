"""Queries over sample vectors: embeddings are 64-channel samples at t = vec_id; a label's mean vector is a prototype map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.operators import alignment as A
from channelflow.operators import clustering as C
from channelflow.operators import inference as I
from channelflow.operators import maps as M
from channelflow.operators import spectral as P
from channelflow.operators import statistics as Q
from channelflow.sources import recordings as R
from channelflow.sources.recordings import CAP63

from . import hierarchy as H
from .registry import SQL, query, rounded, table


def samples(spark: SparkSession, folder: str, subjects: int = 1) -> DataFrame:
    """subject, t, v; with several subjects, vec_ids are dealt to them and numbered anew."""
    rows = table(spark, folder, "embeddings").select((F.col("vec_id") % subjects).cast("int").alias("subject"), F.floor(F.col("vec_id") / subjects).alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return rows.where("v is not null")


def prototypes(spark: SparkSession, folder: str, subjects: int = 1) -> DataFrame:
    """subject, k, m: mean vectors by label."""
    per = samples(spark, folder, subjects).select("subject", "label", F.posexplode("v").alias("ch", "x")).groupBy("subject", "label", "ch").agg(F.avg("x").alias("x"))
    return per.groupBy("subject", F.col("label").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda s: s["x"]).alias("m"))


def long_samples(subjects: int) -> str:
    return f"x AS (SELECT (vec_id % {subjects})::INT AS subject, vec_id // {subjects} AS t, label, unnest(range(len(embedding)))::INT AS ch, unnest(embedding)::DOUBLE AS x FROM embeddings)"


X = long_samples(1)
#: Samples centred over channels, and the field power.
GFP = "g AS (SELECT subject, t, avg(x) AS mean, stddev_pop(x) AS gfp, sqrt(avg(x * x)) AS rms, sqrt(sum(x * x)) AS norm FROM x GROUP BY subject, t)"
MAPS = "maps AS (SELECT subject, label AS k, ch, avg(x) AS m FROM x GROUP BY subject, label, ch), mg AS (SELECT subject, k, avg(m) AS mean, stddev_pop(m) AS s FROM maps GROUP BY subject, k)"
CORR = "corr AS (SELECT x.subject, x.t, maps.k, abs(sum((x.x - g.mean) * (maps.m - mg.mean)) / (count(*) * any_value(g.gfp) * any_value(mg.s))) AS r FROM x JOIN g USING (subject, t) JOIN maps ON maps.subject = x.subject AND maps.ch = x.ch JOIN mg ON mg.subject = maps.subject AND mg.k = maps.k GROUP BY x.subject, x.t, maps.k)"
BEST = "best AS (SELECT subject, t, k AS state, r FROM (SELECT *, row_number() OVER (PARTITION BY subject, t ORDER BY r DESC, k) AS i FROM corr) WHERE i = 1)"
ALL = f"{X}, {GFP}, {MAPS}, {CORR}, {BEST}"


@query(f"WITH {X}, {GFP} SELECT t, round(gfp, 6) AS gfp FROM g")
def gfp(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.field_power(samples(spark, folder)).select("t", "gfp"))


@query(f"WITH {X}, {GFP} SELECT t, round(rms, 6) AS rms FROM g")
def gfp_rms(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(samples(spark, folder).select("t", V.root_mean_square(F.col("v")).alias("rms")))


@query(f"WITH {X}, {GFP} SELECT t, ch, round(x - mean, 6) + 0.0 AS x FROM x JOIN g USING (subject, t)")
def zero_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.long_format(samples(spark, folder).withColumn("v", V.centred(F.col("v")))).select("t", "ch", "x"))


@query(f"WITH {X}, {GFP} SELECT t, ch, round(x / norm, 6) + 0.0 AS x FROM x JOIN g USING (subject, t) WHERE norm > 0")
def unit_norm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.long_format(samples(spark, folder).withColumn("v", V.unit(F.col("v")))).select("t", "ch", "x"))


LOCAL = "lm AS (SELECT subject, t, gfp FROM (SELECT *, lag(gfp) OVER w AS a, lead(gfp) OVER w AS b FROM g WINDOW w AS (PARTITION BY subject ORDER BY t)) WHERE gfp > a AND gfp > b)"


@query(f"WITH {long_samples(4)}, {GFP}, {LOCAL} SELECT subject, t, round(gfp, 6) AS gfp FROM lm")
def local_max(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.local_maxima(M.field_power(samples(spark, folder, 4)).select("subject", "t", "gfp"), "gfp"))


@query(f"WITH {ALL} SELECT t, k, round(r, 6) AS r FROM corr")
def map_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.correlated(samples(spark, folder), prototypes(spark, folder)).select("t", F.explode("r").alias("x")).select("t", "x.k", "x.r"))


@query(f"WITH {ALL} SELECT t, state, round(r, 6) AS r FROM best")
def map_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.labelled(samples(spark, folder), prototypes(spark, folder)).select("t", "state", "r"))


@query(f"WITH {ALL} SELECT t, state, round(r, 6) AS r FROM best WHERE r > 0.3")
def threshold_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.labelled(samples(spark, folder), prototypes(spark, folder), threshold=0.3).select("t", "state", "r"))


@query(f"WITH {ALL} SELECT state, round(sum(gfp * gfp * r * r) / (SELECT sum(gfp * gfp) FROM g), 6) AS gev FROM best JOIN g USING (subject, t) GROUP BY state")
def gev(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.explained_variance(M.labelled(samples(spark, folder), prototypes(spark, folder))).select("state", "gev"))


@query(
    f"""WITH {ALL}, {LOCAL}, p AS (SELECT best.*, g.gfp, lm.t IS NOT NULL AS peak FROM best JOIN g USING (subject, t) LEFT JOIN lm USING (subject, t))
SELECT round(sum(gfp * gfp * r * r) FILTER (peak) / sum(gfp * gfp) FILTER (peak), 6) AS gev_peaks, round(sum(gfp * gfp * r * r) / sum(gfp * gfp), 6) AS gev_raw FROM p"""
)
def gev_totals(spark: SparkSession, folder: str) -> DataFrame:
    labels = M.labelled(samples(spark, folder), prototypes(spark, folder))
    peaks = M.local_maxima(labels.select("subject", "t", "gfp"), "gfp").select("subject", "t", F.lit(True).alias("peak"))
    rows = labels.join(peaks, ["subject", "t"], "left")
    e, g = F.col("gfp") * F.col("gfp") * F.col("r") * F.col("r"), F.col("gfp") * F.col("gfp")
    return rounded(rows.agg(F.try_divide(F.sum(F.when(F.col("peak"), e)), F.sum(F.when(F.col("peak"), g))).alias("gev_peaks"), F.try_divide(F.sum(e), F.sum(g)).alias("gev_raw")))


RESIDUAL = f"""WITH {ALL}, un AS (SELECT k, ch, m / sqrt(sum(m * m) OVER (PARTITION BY k)) AS m FROM maps),
p AS (SELECT best.t, sum(x.x * x.x) AS vv, sum(x.x * un.m) AS p FROM best JOIN x USING (subject, t) JOIN un ON un.k = best.state AND un.ch = x.ch GROUP BY best.t),
v AS (SELECT (sum(vv) - sum(p * p)) / (count(*) * 63) AS variance FROM p)"""


def residual(spark: SparkSession, folder: str) -> DataFrame:
    maps = prototypes(spark, folder)
    return M.residual_variance(M.labelled(samples(spark, folder), maps), maps.withColumn("m", V.unit(F.col("m"))))


@query(f"{RESIDUAL} SELECT round(variance, 6) AS variance FROM v")
def residual_variance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(residual(spark, folder).select("variance"))


@query(f"{RESIDUAL} SELECT round(variance * 63.0 ** 2 / (63.0 - (SELECT count(DISTINCT k) FROM maps)) ** 2, 6) AS cv FROM v")
def cv_criterion(spark: SparkSession, folder: str) -> DataFrame:
    n = prototypes(spark, folder).groupBy("subject").agg(F.count("*").alias("k"))
    rows = residual(spark, folder).join(n, "subject")
    return rounded(rows.select(M.cross_validation(F.col("variance"), F.col("channels"), F.col("k")).alias("cv")))


@query(f"WITH {ALL} SELECT t, round(sqrt(2 * (1 - r)), 6) AS d FROM best")
def dissimilarity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.labelled(samples(spark, folder), prototypes(spark, folder)).select("t", M.dissimilarity(F.col("r")).alias("d")))


FOUR = f"{long_samples(4)}, {GFP}, {MAPS}, {CORR}, {BEST}"
BACKFIT = f"""{FOUR}, {LOCAL}, pk AS (SELECT subject, t, state FROM best JOIN lm USING (subject, t)),
iv AS (SELECT subject, state, coalesce((t + lag(t) OVER w) // 2, 0) AS a, coalesce((t + lead(t) OVER w) // 2, 1000000000000) AS b FROM pk WINDOW w AS (PARTITION BY subject ORDER BY t)),
fit AS (SELECT g.subject, g.t, iv.state FROM g LEFT JOIN iv ON iv.subject = g.subject AND g.t >= a AND g.t < b)"""


def backfitted(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.field_power(samples(spark, folder, 4))
    return M.backfit(rows, M.local_maxima(rows.select("subject", "t", "v", "gfp"), "gfp"), prototypes(spark, folder, 4))


@query(f"WITH {BACKFIT} SELECT subject, t, state FROM fit")
def backfit_labels(spark: SparkSession, folder: str) -> DataFrame:
    return backfitted(spark, folder)


@query(f"WITH {BACKFIT} SELECT subject, t // 25 AS epoch, state, round(count(*) / sum(count(*)) OVER (PARTITION BY subject, t // 25), 6) AS coverage, count(*) AS samples FROM fit GROUP BY subject, t // 25, state")
def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = M.epochs(backfitted(spark, folder), 25).groupBy("subject", "epoch", "state").agg(F.count("*").alias("samples"))
    return rounded(rows.select("subject", "epoch", "state", (F.col("samples") / F.sum("samples").over(Window.partitionBy("subject", "epoch"))).alias("coverage"), "samples"))


def map_sets_and_template(spark: SparkSession, folder: str, subjects: int = 5) -> tuple[DataFrame, DataFrame]:
    """The map sets of all labels of each subject, and the template over all samples."""
    return prototypes(spark, folder, subjects), prototypes(spark, folder).select("k", "m")


MATRIX = f"""{long_samples(5)}, y AS (SELECT label, unnest(range(len(embedding)))::INT AS ch, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS (SELECT subject, label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), b AS (SELECT label AS k, ch, avg(x) AS m FROM y GROUP BY ALL),
c AS (SELECT a.subject, a.k AS i, b.k AS j, round({{value}}, 12) AS s, {{value}} AS r FROM a JOIN b USING (ch) GROUP BY ALL)"""


#: The best assignment in c(subject, i, j, s) by dynamic programming: for each map in turn, the best total over every set of columns used so far.
BEST_PATH = """dp AS (SELECT subject, 0 AS n, 0 AS used, []::INT[] AS path, 0.0::DOUBLE AS total FROM (SELECT DISTINCT subject FROM c)
UNION ALL SELECT dp.subject, dp.n + 1 AS n, dp.used + (1 << c.j) AS used, arg_max(list_append(dp.path, c.j::INT), dp.total + c.s) AS path, max(dp.total + c.s) AS total
FROM dp JOIN c ON c.subject = dp.subject AND c.i = dp.n AND (dp.used >> c.j) % 2 = 0 GROUP BY dp.subject, dp.n + 1, dp.used + (1 << c.j)),
w AS (SELECT subject, path FROM dp WHERE n = (SELECT max(i) + 1 FROM c))"""


def assigned_sql(value: str, out: str = "c.subject, c.i AS k_src, c.j AS k_dst, round(c.r, 6) + 0.0 AS r", matrix: str = MATRIX) -> str:
    return f"WITH RECURSIVE {matrix.format(value=value)}, {BEST_PATH} SELECT {out} FROM w JOIN c ON c.subject = w.subject AND w.path[c.i + 1] = c.j"


@query(assigned_sql("corr(a.m, b.m)"))
def assign_signed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.assign(*map_sets_and_template(spark, folder)))


@query(assigned_sql("abs(corr(a.m, b.m))"))
def assign_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.assign(*map_sets_and_template(spark, folder), absolute=True))


CUT = "CASE WHEN abs(corr(a.m, b.m)) < 0.9 THEN 0 ELSE abs(corr(a.m, b.m)) END"


@query(assigned_sql(CUT, "c.subject, count(*) AS pairs, round(sum(c.r), 6) + 0.0 AS total") + " GROUP BY c.subject")
def padded_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs below the threshold tie at 0, so what is compared is each set's number of pairs and total."""
    found = A.padded_similarity(*map_sets_and_template(spark, folder), 0.9)
    return rounded(found.groupBy("subject").agg(F.count_if(F.col("k_dst") >= 0).alias("pairs"), F.sum("r").alias("total")))


@query(
    f"""WITH RECURSIVE {MATRIX.format(value="abs(corr(a.m, b.m))")}, v AS (SELECT subject, i, j, s AS r FROM c),
pick AS (SELECT subject, 1 AS n, [i] AS used_i, [j] AS used_j, i, j, r FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY r DESC, i, j) AS o FROM v) WHERE o = 1
UNION ALL SELECT subject, n, used_i, used_j, i, j, r FROM (SELECT p.subject, p.n + 1 AS n, list_append(p.used_i, v.i) AS used_i, list_append(p.used_j, v.j) AS used_j, v.i, v.j, v.r, row_number() OVER (PARTITION BY p.subject ORDER BY v.r DESC, v.i, v.j) AS o FROM pick p JOIN v ON v.subject = p.subject AND NOT list_contains(p.used_i, v.i) AND NOT list_contains(p.used_j, v.j)) WHERE o = 1)
SELECT subject, i AS k_src, j AS k_dst, round(r, 6) AS r FROM pick"""
)
def greedy_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.greedy_similarity(*map_sets_and_template(spark, folder)))


FIRST_AS_TEMPLATE = MATRIX.replace("y AS (SELECT label,", "y AS (SELECT label, vec_id,").replace("b AS (SELECT label AS k, ch, avg(x) AS m FROM y GROUP BY ALL)", "b AS (SELECT label AS k, ch, avg(x) AS m FROM y WHERE vec_id % 5 = 0 GROUP BY ALL)")
GRID = [3, 5, 4, 1, 0, 2, 9, 7, 8, 6]


@query(assigned_sql("abs(corr(a.m, b.m))", f"c.subject, list_position({GRID}, c.j) - 1 AS place, c.i AS k", FIRST_AS_TEMPLATE))
def grid_order(spark: SparkSession, folder: str) -> DataFrame:
    return A.grid_order(prototypes(spark, folder, 5), 0, GRID)


@query(
    f"""WITH {long_samples(5)}, a AS (SELECT subject, label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT a.subject, a.k, b.k AS o, abs(corr(a.m, b.m)) AS r FROM a JOIN a b ON a.subject = b.subject AND a.ch = b.ch AND a.k <> b.k GROUP BY ALL),
s AS (SELECT subject, k, round(sum(r) / count(*), 12) AS r FROM c GROUP BY ALL) SELECT subject AS grp, k, round(r, 6) AS mean_r FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY r DESC, k) AS o FROM s) WHERE o = 1"""
)
def representative(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.representative(prototypes(spark, folder, 5).withColumnRenamed("subject", "grp")))


ORDER = [3, 5, 4, 1, 0, 2, 9, 7, 8, 6]


@query(f"WITH {X}, {MAPS}, o AS (SELECT unnest(range(10)) AS place, unnest({ORDER}) AS k) SELECT o.place AS k, ch, round(m, 6) + 0.0 AS x FROM maps JOIN o USING (k)")
def reorder_maps(spark: SparkSession, folder: str) -> DataFrame:
    order = spark.createDataFrame([(0, place, k) for place, k in enumerate(ORDER)], "subject int, place int, k int")
    return rounded(A.reordered(prototypes(spark, folder), order).select("k", F.posexplode("m").alias("ch", "x")))


@query(f"WITH {X}, c AS (SELECT label, ch, var_pop(x) * count(*) AS ss FROM x GROUP BY ALL) SELECT round(sum(ss), 6) AS wcss FROM c")
def wcss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.within_cluster_squares(samples(spark, folder).select(F.col("subject").alias("file"), "label", "v")).select("wcss"))


@query(
    """WITH e AS (SELECT vec_id AS i, vec_id % 2 AS file, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.file, a.i, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.file = b.file AND a.i <> b.i GROUP BY ALL),
w AS (SELECT file, i, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY file, i, label)
SELECT file::INT AS file, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM w GROUP BY file"""
)
def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.silhouette(samples(spark, folder, 2).select(F.col("subject").alias("file"), F.col("t").alias("i"), "label", "v")))


@query(
    f"""WITH {long_samples(4)}, y AS (SELECT *, t // 25 AS epoch, t % 25 AS place FROM x), z AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM y WINDOW w AS (PARTITION BY subject, ch, epoch ORDER BY place)),
c AS (SELECT subject, epoch, ch, var_pop(x) AS c0, quantile_cont(CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END, 0.5) AS c1, max(x) - min(x) AS c2, avg(x) AS m FROM z GROUP BY ALL HAVING count(*) = 25),
e AS (SELECT *, m - avg(m) OVER (PARTITION BY subject, epoch) AS c3 FROM c),
s AS (SELECT subject, epoch, ch, (c0 - avg(c0) OVER w) / stddev_pop(c0) OVER w AS z0, (c1 - avg(c1) OVER w) / stddev_pop(c1) OVER w AS z1, (c2 - avg(c2) OVER w) / stddev_pop(c2) OVER w AS z2, (c3 - avg(c3) OVER w) / stddev_pop(c3) OVER w AS z3 FROM e WINDOW w AS (PARTITION BY subject, ch))
SELECT subject, epoch, ch, z0 > 1.2 OR z1 > 1.3 OR z2 > 1.2 OR z3 > 1.3 AS bad FROM s"""
)
def bad_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return Q.bad_epochs(M.long_format(samples(spark, folder, 4)), 25, [1.2, 1.3, 1.2, 1.3])


BANDS = [("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]


@query(
    f"""WITH {X}, b AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in BANDS)}) v(band, low, high)),
j AS (SELECT t, band, ch, x * x AS p, lag(ch) OVER w AS f0, lag(x * x) OVER w AS p0 FROM x JOIN b ON ch BETWEEN low AND high WINDOW w AS (PARTITION BY t, band ORDER BY ch))
SELECT t, band, round(coalesce(sum((ch - f0) * (p + p0) / 2), 0), 6) AS power FROM j GROUP BY ALL"""
)
def band_power(spark: SparkSession, folder: str) -> DataFrame:
    spectrum = M.long_format(samples(spark, folder)).select("t", F.col("ch").cast("double").alias("f"), (F.col("x") * F.col("x")).alias("p"))
    return rounded(Q.band_power(spectrum, spark.createDataFrame(BANDS, "band string, low double, high double"), ["t"]))


@query()
def peak_pick(spark: SparkSession, folder: str) -> DataFrame:
    return C.pick_peaks(M.field_power(samples(spark, folder, 4)).select("subject", "t", "gfp"), "gfp")


def peak_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.field_power(samples(spark, folder, 4)).select("subject", "t", "v", "gfp")
    return rows.join(C.pick_peaks(rows, "gfp", distance=2), ["subject", "t"]).select("subject", "t", "v")


@query()
def kmeans_modified(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.kmeans_modified(peak_samples(spark, folder), 4, 4).select("subject", "k_total", "k", "cv", "gev"))


@query()
def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return C.best_k(C.kmeans_modified(peak_samples(spark, folder)))


@query()
def aahc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.aahc(peak_samples(spark, folder), 3, 6).select("subject", "k_total", "k", "cv", "gev"))


@query()
def pca_cut(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.principal_components(samples(spark, folder).select("subject", "t", "v"), 0.9).select("i", "eigenvalue", "ratio"))


@query(f"WITH {X}, m AS (SELECT ch, x - avg(x) OVER (PARTITION BY ch) AS x, t FROM x) SELECT a.ch AS i, b.ch AS j, round(sum(a.x * b.x) / (count(*) - 1), 6) + 0.0 AS c FROM m a JOIN m b ON a.t = b.t AND b.ch <= a.ch GROUP BY ALL")
def covariance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.covariance(samples(spark, folder)).select("i", "j", "c"))


@query()
def mean_maps(spark: SparkSession, folder: str) -> DataFrame:
    sets = prototypes(spark, folder, 5).withColumn("grp", F.lit(1))
    return rounded(A.mean_maps(sets, "grp").select("k", F.posexplode("m").alias("ch", "x"), "similarity", "deviation"))


@query(
    f"""WITH RECURSIVE {long_samples(5)}, m AS (SELECT subject, label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT a.subject * 10 + b.subject AS subject, a.k AS i, b.k AS j, round(abs(corr(a.m, b.m)), 12) AS s FROM m a JOIN m b ON a.ch = b.ch AND a.subject < b.subject GROUP BY ALL),
{BEST_PATH} SELECT 1 AS grp, w.subject // 10 AS a, w.subject % 10 AS b, round(avg(c.s), 6) AS similarity FROM w JOIN c ON c.subject = w.subject AND w.path[c.i + 1] = c.j GROUP BY w.subject"""
)
def pairwise_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.pairwise_similarity(prototypes(spark, folder, 5).withColumn("grp", F.lit(1))))


def subjects_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    """k, subject, condition, v: maps of all labels, five subjects under two conditions each."""
    rows = prototypes(spark, folder, 10)
    return rows.select((F.col("subject") % 5).alias("subject"), F.floor(F.col("subject") / 5).cast("int").alias("condition"), "k", F.col("m").alias("v"))


@query()
def permutation_test(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.permutation_test(subjects_by_condition(spark, folder)))


@query()
def bootstrap_test(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.bootstrap_test(subjects_by_condition(spark, folder)))


@query()
def tanova(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.tanova(subjects_by_condition(spark, folder).withColumn("group", F.lit(1))))


@query(
    f"""WITH {long_samples(10)}, m AS (SELECT subject % 5 AS subject, subject // 5 AS condition, label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), z AS (SELECT *, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM m WINDOW w AS (PARTITION BY subject, condition, k)),
c AS (SELECT k, condition, ch, avg(z) AS x FROM z GROUP BY ALL), d AS (SELECT k, condition, sqrt(avg(d * d)) AS d FROM (SELECT *, x - avg(x) OVER (PARTITION BY k, ch) AS d FROM c) GROUP BY ALL) SELECT k, round(sum(d), 6) AS statistic FROM d GROUP BY k"""
)
def dissimilarity_of_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.dissimilarity_of_conditions(subjects_by_condition(spark, folder)))


@query(f"WITH {X}, {GFP}, z AS (SELECT t, ch, x - mean AS x FROM x JOIN g USING (subject, t)), n AS (SELECT t, sqrt(sum(x * x)) AS n FROM z GROUP BY t) SELECT t, ch, round(x / n, 6) + 0.0 AS x FROM z JOIN n USING (t) WHERE n > 0")
def standardised(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.long_format(samples(spark, folder).withColumn("v", V.standardised(F.col("v")))).select("t", "ch", "x"))


@query(
    f"""WITH {long_samples(2)}, c AS (SELECT subject AS file, label, ch, var_pop(x) * count(*) AS ss FROM x GROUP BY ALL), wc AS (SELECT file, sum(ss) AS wcss FROM c GROUP BY file), f AS (SELECT * FROM (VALUES ('a', 0), ('a', 1), ('b', 1)) v(condition, file)),
e AS (SELECT vec_id AS i, vec_id % 2 AS file, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.file, a.i, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.file = b.file AND a.i <> b.i GROUP BY ALL),
w AS (SELECT file, i, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY file, i, label), si AS (SELECT file, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM w GROUP BY file)
SELECT condition, count(*) AS files, round(avg(wcss), 4) AS mean_wcss, round(stddev_pop(wcss), 4) AS std_wcss, round(avg(silhouette), 6) + 0.0 AS mean_silhouette, round(stddev_pop(silhouette), 6) + 0.0 AS std_silhouette FROM f JOIN wc USING (file) JOIN si USING (file) GROUP BY condition"""
)
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    points = samples(spark, folder, 2).select(F.col("subject").alias("file"), F.col("t").alias("i"), "label", "v")
    quality = Q.within_cluster_squares(points).join(Q.silhouette(points), "file")
    files = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "condition string, file int")
    found = rounded(Q.quality_summary(quality, files))
    return found.select("condition", "files", F.round("mean_wcss", 4).alias("mean_wcss"), F.round("std_wcss", 4).alias("std_wcss"), "mean_silhouette", "std_silhouette")


LOBES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(CAP63))


@query(f"WITH {X}, n AS (SELECT * FROM (VALUES {LOBES}) v(ch, name)), g AS (SELECT ch, upper(regexp_extract(name, '^([A-Za-z]+?)[zZ]?[0-9]*$', 1)) AS grp FROM n) SELECT t, grp, round(avg(x), 6) + 0.0 AS x FROM x JOIN g USING (ch) GROUP BY t, grp")
def channel_lobes(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.long_format(samples(spark, folder))
    return rounded(Q.channel_groups(rows, R.channel_lobes(R.channels(spark))).select("t", "grp", "x"))


@query(f"WITH {X}, n AS (SELECT ch, regexp_replace(name, '[0-9]+$', '') AS place, regexp_extract(name, '[0-9]+$')::INT AS number FROM (VALUES {LOBES}) v(ch, name) WHERE regexp_matches(name, '[0-9]$')), p AS (SELECT a.ch::INT AS left, b.ch::INT AS right FROM n a JOIN n b ON a.place = b.place AND b.number = a.number + 1 WHERE a.number % 2 = 1) SELECT p.left, p.right, round(avg(a.x - b.x), 6) + 0.0 AS difference FROM p JOIN x a ON a.ch = p.left JOIN x b ON b.ch = p.right AND b.t = a.t GROUP BY ALL")
def mirrored_channels(spark: SparkSession, folder: str) -> DataFrame:
    """The mean difference of the samples of each pair of mirrored channels."""
    pairs, rows = R.mirrored_channels(R.channels(spark)), samples(spark, folder)
    each = rows.join(pairs.agg(F.collect_list(F.struct("left", "right")).alias("pairs")), how="cross").select("v", F.explode("pairs").alias("p"))  # one row of channels' pairs
    difference = F.get("v", F.col("p.left")) - F.get("v", F.col("p.right"))
    return rounded(each.groupBy("p.left", "p.right").agg(F.avg(difference).alias("difference")))


@query(f"WITH {X} SELECT t, ch, round(x - avg(x) FILTER (ch IN (9, 20)) OVER (PARTITION BY t), 6) + 0.0 AS x FROM x")
def rereferenced(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.rereferenced(M.long_format(samples(spark, folder)), [9, 20]).select("t", "ch", "x"))


@query(
    f"""WITH {X}, p AS (SELECT ch, (0.1 + ch % 8 * 0.05) * sin(radians(ch * 5.5 - 170)) AS px, (0.1 + ch % 8 * 0.05) * cos(radians(ch * 5.5 - 170)) AS py FROM (SELECT unnest(range(64)) AS ch)),
w AS (SELECT a.ch, b.ch AS o, 1 / ((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS w FROM p a, p b WHERE a.ch IN (3, 17) AND b.ch NOT IN (3, 17)), m AS (SELECT t, w.ch, sum(w * x) / sum(w) AS x FROM x JOIN w ON x.ch = w.o GROUP BY t, w.ch)
SELECT t, ch, round(x, 6) + 0.0 AS x FROM (SELECT t, ch, x FROM x WHERE ch NOT IN (3, 17) UNION ALL SELECT t, ch, x FROM m)"""
)
def repaired_channels(spark: SparkSession, folder: str) -> DataFrame:
    places = spark.range(64).select(F.col("id").cast("int").alias("ch"), (F.col("id") * 5.5 - 170).alias("angle"), (0.1 + F.col("id") % 8 * 0.05).alias("radius"))
    bads = spark.createDataFrame([(0, 3), (0, 17)], "subject int, ch int")
    return rounded(Q.repaired_channels(M.long_format(samples(spark, folder)), bads, places).select("t", "ch", "x"))


BAD = SQL["bad_epochs"]
GLOBAL = "g AS (SELECT subject, ch FROM e GROUP BY ALL HAVING avg(bad::INT) > 0.3)"


@query(f"WITH e AS ({BAD}), {GLOBAL}, l AS (SELECT e.* FROM e ANTI JOIN g USING (subject, ch)), m AS (SELECT subject, epoch, avg(bad::INT) AS ratio, list_sort(list(ch) FILTER (bad)) AS found FROM l GROUP BY ALL) SELECT subject, epoch, round(ratio, 6) AS ratio, ratio >= 0.25 AS dropped, CASE WHEN ratio >= 0.25 THEN '' ELSE coalesce(array_to_string(found, ','), '') END AS interpolated FROM m")
def marked_epochs(spark: SparkSession, folder: str) -> DataFrame:
    bad = bad_epochs(spark, folder)
    found = Q.marked_epochs(bad, 0.25, Q.global_bad_channels(bad, 0.3))
    return rounded(found.withColumn("interpolated", F.array_join("interpolated", ",")))


@query(f"WITH e AS ({BAD}), {GLOBAL}, l AS (SELECT DISTINCT subject, ch FROM e WHERE epoch = 0 AND bad), c AS (SELECT DISTINCT subject, ch FROM e) SELECT c.subject, c.ch, (g.ch IS NOT NULL OR l.ch IS NOT NULL)::INT AS mask FROM c LEFT JOIN g USING (subject, ch) LEFT JOIN l USING (subject, ch)")
def channel_mask(spark: SparkSession, folder: str) -> DataFrame:
    bad = bad_epochs(spark, folder)
    return Q.channel_mask(bad.select("subject", "ch").distinct(), Q.global_bad_channels(bad, 0.3), bad.where("epoch = 0 AND bad"))


@query(f"WITH e AS ({BAD}), n AS (SELECT epoch, subject, count(*) FILTER (bad) AS n FROM e GROUP BY ALL) SELECT epoch, round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem, count(*) AS subjects FROM n GROUP BY epoch")
def vote_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.vote_statistics(bad_epochs(spark, folder).withColumnRenamed("bad", "flagged"), ["epoch"]))


SPECTRUM = f"""{X}, seg AS (SELECT ch, s, x - avg(x) OVER (PARTITION BY ch, s) AS x, (t - s * 25)::INT AS i FROM x, (SELECT unnest(range(100000)) AS s) q WHERE s * 25 <= t AND t < s * 25 + 50 AND s * 25 + 50 <= (SELECT max(t) + 1 FROM x)),
win AS (SELECT i::INT AS i, 0.54 - 0.46 * cos(2 * pi() * i / 50) AS w FROM (SELECT unnest(range(50)) AS i)), ft AS (SELECT ch, s, f, sum(x * w * cos(2 * pi() * f * i / 50)) AS re, sum(x * w * sin(2 * pi() * f * i / 50)) AS im FROM seg JOIN win USING (i), (SELECT unnest(range(26)) AS f) q GROUP BY ALL),
ps AS (SELECT ch, f * 2.0::DOUBLE AS f, avg(re * re + im * im) / (100 * (SELECT sum(w * w) FROM win)) * CASE WHEN f IN (0, 25) THEN 1 ELSE 2 END AS p FROM ft GROUP BY ch, f)"""


@query(f"WITH {SPECTRUM} SELECT ch, f, round(p, 6) + 0.0 AS p FROM ps")
def welch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.welch(M.long_format(samples(spark, folder)), 100, 50, 25).select("ch", "f", "p"))


WIDE = [("low", 2.0, 10.0), ("middle", 10.0, 24.0), ("total", 0.0, 48.0)]
#: Simpson's weights over an odd number of points, and a trapezoid beside them for the last interval of an even number.
SIMPSON = f"""{SPECTRUM}, bd AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, lo, hi in WIDE)}) v(band, low, high)), bi AS (SELECT ch, band, p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ch, band) AS n FROM ps JOIN bd ON f BETWEEN low AND high WINDOW w AS (PARTITION BY ch, band ORDER BY f)),
wt AS (SELECT *, CASE WHEN n % 2 = 1 THEN n - 1 ELSE n - 2 END AS z FROM bi), pw AS (SELECT ch, band, 2.0 * sum(p * (CASE WHEN i > z THEN 0 WHEN i IN (0, z) THEN CASE WHEN z > 0 THEN 1 ELSE 0 END WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0 + CASE WHEN n % 2 = 0 AND i >= n - 2 THEN 0.5 ELSE 0 END)) AS power FROM wt GROUP BY ch, band)"""


@query(f"WITH {SIMPSON} SELECT a.ch, a.band, round(log10(a.power / b.power), 6) + 0.0 AS log_power FROM pw a JOIN pw b ON a.ch = b.ch AND b.band = 'total' WHERE a.band <> 'total'")
def relative_band_power(spark: SparkSession, folder: str) -> DataFrame:
    spectrum = P.welch(M.long_format(samples(spark, folder)), 100, 50, 25)
    powers = P.simpson_band_power(spectrum, spark.createDataFrame(WIDE, "band string, low double, high double"), ["subject", "ch"])
    return rounded(P.relative_log_power(powers, ["subject", "ch"], "total").select("ch", "band", "log_power"))


def filter_sql(taps: list[float]) -> str:
    half = len(taps) // 2
    return f"""WITH {X}, n AS (SELECT ch, count(*) AS n, arg_min(x, t) AS x0, arg_max(x, t) AS x1 FROM x GROUP BY ch), c AS (SELECT unnest(range({len(taps)})) AS i, unnest({taps}) AS h),
p AS (SELECT x.t, x.ch, h, t + i - {half} AS u, n, x0, x1 FROM x JOIN n USING (ch), c), q AS (SELECT t, ch, h, CASE WHEN u < 0 THEN -u WHEN u >= n THEN 2 * n - 2 - u ELSE u END AS u, CASE WHEN u < 0 THEN 2 * x0 WHEN u >= n THEN 2 * x1 ELSE 0 END AS shift, CASE WHEN u < 0 OR u >= n THEN -1 ELSE 1 END AS sign FROM p)
SELECT q.t, q.ch, round(sum(h * (shift + sign * x.x)), 6) + 0.0 AS x FROM q JOIN x ON x.ch = q.ch AND x.t = q.u GROUP BY q.t, q.ch"""


@query(filter_sql(P.fir(100, 8, 20).tolist()))
def band_pass(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.band_pass(M.long_format(samples(spark, folder)), 8, 20, 100).select("t", "ch", "x"))


@query(filter_sql(P.fir(40, 8, 12, stop=True).tolist()))
def notch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.notch(M.long_format(samples(spark, folder)), 10, 40).select("t", "ch", "x"))


@query(
    f"""WITH {X}, n AS (SELECT count(DISTINCT t) AS n, round_even(count(DISTINCT t) / 2.0, 0)::BIGINT AS m FROM x), s AS (SELECT unnest(range(m)) AS i, n, m FROM n),
d AS (SELECT s.*, x.ch, x.t, x.x, i::DOUBLE / m - t::DOUBLE / n AS a, CASE WHEN m % 2 = 0 THEN m - 1 ELSE m END AS terms FROM s, x),
e AS (SELECT i, ch, x, n, CASE WHEN abs(sin(pi() * a)) < 1e-12 THEN terms ELSE sin(pi() * terms * a) / sin(pi() * a) END + CASE WHEN m % 2 = 0 THEN 2 * cos(pi() * m * t / n) * cos(pi() * i) ELSE 0 END AS w FROM d)
SELECT i AS t, ch, round(sum(w * x) / any_value(n), 6) + 0.0 AS x FROM e GROUP BY i, ch"""
)
def resample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.resample(M.long_format(samples(spark, folder)), 100, 50).select("t", "ch", "x"))


@query()
def principal_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The unit vector of greatest sum of squared products with each quarter of the samples, as k-means takes it from a map's samples."""
    return rounded(C.principal_vectors(samples(spark, folder, 4)).select("subject", F.posexplode("vector").alias("ch", "x")))


@query(f"WITH {long_samples(4)}, n AS (SELECT subject, ch, count(*) AS n FROM x GROUP BY ALL) SELECT subject, ch, 0.0 AS rest, 1.0 AS length, n FROM n")
def principal_vector_residual(spark: SparkSession, folder: str) -> DataFrame:
    """By channel, what the samples' sum of products leaves of each principal vector beside a multiple of it, its length, and the number of samples."""
    rows = samples(spark, folder, 4)
    met = rows.join(C.principal_vectors(rows), "subject").withColumn("p", V.dot(F.col("v"), F.col("vector")))
    power = met.groupBy("subject").agg(F.sum(F.col("p") * F.col("p")).alias("power"))
    moved = met.select("subject", "p", F.posexplode(F.arrays_zip("v", "vector")).alias("ch", "x")).groupBy("subject", "ch").agg(F.sum(F.col("p") * F.col("x.v")).alias("moved"), F.max("x.vector").alias("own"), F.count("*").alias("n"))
    length = C.principal_vectors(rows).select("subject", V.norm(F.col("vector")).alias("length"))
    both = moved.join(power, "subject").join(length, "subject")
    return rounded(both.select("subject", "ch", (F.col("moved") - F.col("power") * F.col("own")).alias("rest"), "length", "n"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """subject, task, t, v: two subjects with four runs each."""
    rows = samples(spark, folder, 8)
    return rows.select((F.col("subject") % 2).cast("string").alias("subject"), F.concat(F.when(F.col("subject") < 4, "rest_").otherwise("work_"), F.floor(F.col("subject") / 2) % 2).alias("task"), "t", "v")


RUNS = {"rest": ["rest_0", "rest_1"], "work": ["work_0", "work_1"]}


def some_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of all recordings by the operator's own defaults (2 to 10 maps, 100 restarts); the recordings are short, so peaks may be near."""
    return H.individual_maps(recordings(spark, folder), distance=2)


@query()
def individual_maps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(some_maps(spark, folder).select("subject", "task", "k_total", "k", "cv", "gev"))


@query()
def principal_maps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(H.principal_maps(recordings(spark, folder), 0.9, distance=2).select("subject", "task", "k_total", "k", "cv", "gev"))


@query()
def across_runs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(H.across_runs(some_maps(spark, folder), R.conditions(spark, RUNS), 4).select("subject", "condition", "k", "similarity", "deviation"))


@query()
def across_subjects(spark: SparkSession, folder: str) -> DataFrame:
    runs = H.across_runs(some_maps(spark, folder), R.conditions(spark, RUNS), 4)
    return rounded(H.across_subjects(runs).select("condition", "k", "similarity", "deviation"))


@query()
def across_conditions(spark: SparkSession, folder: str) -> DataFrame:
    runs = H.across_runs(some_maps(spark, folder), R.conditions(spark, RUNS), 4)
    return rounded(H.across_conditions(H.across_subjects(runs)).select("k", "similarity", "deviation"))


@query()
def reclustered(spark: SparkSession, folder: str) -> DataFrame:
    maps = some_maps(spark, folder).where("k_total = 4").select(F.col("subject").alias("grp"), F.col("task").alias("subject"), "k", "m")
    return rounded(C.reclustered(maps).select("subject", "k_total", "k", "cv", "gev"))


EXPLAINED = f"""WITH x AS (SELECT vec_id % 2 AS s, CASE WHEN vec_id % 8 < 4 THEN 'rest_' ELSE 'work_' END || (vec_id % 8 // 2 % 2) AS task, vec_id // 8 AS t, label, unnest(range(len(embedding)))::INT AS ch, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT s, task, t, avg(x) AS mean, stddev_pop(x) AS gfp FROM x GROUP BY ALL), maps AS (SELECT label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), mg AS (SELECT k, avg(m) AS mean, stddev_pop(m) AS sd FROM maps GROUP BY k),
corr AS (SELECT s, task, t, maps.k, abs(sum((x.x - g.mean) * (maps.m - mg.mean)) / (count(*) * any_value(g.gfp) * any_value(mg.sd))) AS r FROM x JOIN g USING (s, task, t) JOIN maps USING (ch) JOIN mg ON mg.k = maps.k GROUP BY ALL),
best AS (SELECT s, task, t, max(r) AS r FROM corr GROUP BY ALL), w AS (SELECT s, task, gfp, r, lag(gfp) OVER o AS a, lead(gfp) OVER o AS b, avg(gfp) OVER (PARTITION BY s, task) AS mu, stddev_pop(gfp) OVER (PARTITION BY s, task) AS sd FROM g JOIN best USING (s, task, t) WINDOW o AS (PARTITION BY s, task ORDER BY t)),
e AS (SELECT *, gfp > a AND gfp > b AND abs(gfp - mu) <= 3 * sd AS peak FROM w), out AS (SELECT s::VARCHAR AS subject, task, sum(gfp * gfp * r * r) FILTER (peak) / sum(gfp * gfp) FILTER (peak) AS gev_peaks, sum(gfp * gfp * r * r) / sum(gfp * gfp) AS gev_raw, count(*) AS n FROM e GROUP BY ALL)"""


@query(f"{EXPLAINED} SELECT subject, task, round(gev_peaks, 6) AS gev_peaks, round(gev_raw, 6) AS gev_raw, n FROM out")
def explained_by(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(H.explained_by(recordings(spark, folder), prototypes(spark, folder).select("k", "m"), distance=1).drop("condition"))


@query(f"{EXPLAINED}, c AS (SELECT split_part(task, '_', 1) AS condition, gev_raw AS v, n FROM out), m AS (SELECT condition, sum(v * n) / sum(n) AS mean FROM c GROUP BY 1) SELECT condition, round(mean, 6) AS mean, round(sqrt(sum((v - mean) ** 2 * n) / sum(n)), 6) AS std FROM c JOIN m USING (condition) GROUP BY condition, mean")
def explained_summary(spark: SparkSession, folder: str) -> DataFrame:
    maps = prototypes(spark, folder).select("k", "m").join(spark.createDataFrame([("rest",), ("work",)], "condition string"), how="cross")  # the same few maps for two conditions
    return rounded(H.explained_summary(H.explained_by(recordings(spark, folder), maps, R.conditions(spark, RUNS), distance=1)))


@query()
def recording_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(H.recording_metrics(recordings(spark, folder), prototypes(spark, folder).select("k", "m"), sfreq=10, distance=2))


@query(
    """WITH x AS (SELECT vec_id % 2 AS s, CASE WHEN vec_id % 8 < 4 THEN 'rest_' ELSE 'work_' END || (vec_id % 8 // 2 % 2) AS task, vec_id // 8 // 20 AS e, vec_id // 8 % 20 AS t, label,
  unnest(range(len(embedding)))::INT AS ch, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT s, task, e, t, avg(x) AS mean, stddev_pop(x) AS gfp FROM x GROUP BY ALL), maps AS (SELECT label AS k, ch, avg(x) AS m FROM x GROUP BY ALL), mg AS (SELECT k, avg(m) AS mean, stddev_pop(m) AS sd FROM maps GROUP BY k),
w AS (SELECT *, lag(gfp) OVER o AS a, lead(gfp) OVER o AS b, avg(gfp) OVER (PARTITION BY s, task, e) AS mu, stddev_pop(gfp) OVER (PARTITION BY s, task, e) AS sd FROM g WINDOW o AS (PARTITION BY s, task, e ORDER BY t)),
p AS (SELECT s, task, e, t FROM w WHERE gfp > a AND gfp > b AND abs(gfp - mu) <= 3 * sd),
corr AS (SELECT s, task, e, t, maps.k, abs(sum((x.x - g.mean) * (maps.m - mg.mean)) / (count(*) * any_value(g.gfp) * any_value(mg.sd))) AS r FROM p JOIN x USING (s, task, e, t) JOIN g USING (s, task, e, t) JOIN maps USING (ch) JOIN mg ON mg.k = maps.k GROUP BY ALL),
best AS (SELECT s, task, e, t, k FROM (SELECT *, row_number() OVER (PARTITION BY s, task, e, t ORDER BY r DESC, k) AS i FROM corr) WHERE i = 1),
iv AS (SELECT s, task, e, k, coalesce((t + lag(t) OVER o) // 2, 0) AS a, coalesce((t + lead(t) OVER o) // 2, 1000) AS b FROM best WINDOW o AS (PARTITION BY s, task, e ORDER BY t)),
fit AS (SELECT g.s, g.task, g.e, g.t, iv.k FROM g LEFT JOIN iv ON iv.s = g.s AND iv.task = g.task AND iv.e = g.e AND g.t >= a AND g.t < b),
n AS (SELECT s, task, e, count(k) AS n FROM fit GROUP BY ALL), q AS (SELECT fit.*, n.n, lag(k) OVER o AS before, lead(k) OVER o AS next FROM fit JOIN n USING (s, task, e) WHERE n.n >= 2 AND k IS NOT NULL WINDOW o AS (PARTITION BY s, task, e ORDER BY t)),
states AS (SELECT DISTINCT k FROM q), c AS (SELECT s, task, e, k, count(*) AS c, count(*) FILTER (before IS DISTINCT FROM k) AS runs FROM q GROUP BY ALL), m AS (SELECT s, task, e, k, next, count(*) AS c FROM q WHERE next IS NOT NULL GROUP BY ALL),
out AS (SELECT n.s, n.task, n.e, 'coverage' AS metric, states.k AS a, NULL AS b, coalesce(c.c, 0) / n.n AS value FROM n CROSS JOIN states LEFT JOIN c ON c.s = n.s AND c.task = n.task AND c.e = n.e AND c.k = states.k WHERE n.n >= 2
  UNION ALL SELECT s, task, e, 'segments', k, NULL, runs FROM c UNION ALL SELECT s, task, e, 'transition_matrix', k, next, c / sum(c) OVER (PARTITION BY s, task, e, k) FROM m
  UNION ALL SELECT s, task, e, unnest(['coverage', 'segments', 'transition_matrix']), NULL, NULL, NULL FROM n WHERE n < 2)
SELECT s::VARCHAR AS subject, task, e AS epoch, metric, coalesce(a, -1)::INT AS state_from, coalesce(b, -1)::INT AS state_to, round(value, 6) AS value FROM out"""
)
def recording_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, segments and transitions of every epoch of every recording, from field power peaks to a back-fit against one map set."""
    found = H.recording_metrics(recordings(spark, folder), prototypes(spark, folder).select("k", "m"), sfreq=10, distance=2, chosen=("coverage", "segments", "transition_matrix"))
    return rounded(found.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in ("state_from", "state_to")}))
