"""Queries through the readers and writers: tables are written as the files that recordings come in, and read back.

Files lie in the shared folder that the cluster names in spark.checkpoint.dir; in local mode, where it may be unset, in a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelflow.operators import clustering as C
from channelflow.operators import maps as M
from channelflow.sources import recordings as R

from .map_queries import long_samples, prototypes, samples
from .registry import query, rounded, table


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of a run's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="files-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def matrix_text(rows: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """key and the JSON text of a matrix whose rows are v in order: one recording in one file, as the format has it."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct(order, v))), lambda x: x[v])
    return rows.groupBy(key).agg(F.to_json(cells).alias("text"))


@query(f"WITH {long_samples(4)} SELECT 'task_' || subject AS task, t, ch, round(x, 6) + 0.0 AS x FROM x")
def json_recordings(spark: SparkSession, folder: str) -> DataFrame:
    rows = samples(spark, folder, 4).select(F.concat(F.lit("task_"), "subject").alias("task"), "t", "v")
    whole = matrix_text(rows, "task", "t", "v").select("task", F.concat(F.lit('{"'), "task", F.lit('":'), "text", F.lit("}")).alias("value"))
    path = new_folder(spark, "recordings")
    whole.write.partitionBy("task").text(path)  # one file a recording
    read = R.read_recordings(spark, path, channels_first=None)
    return rounded(read.select("task", "t", F.posexplode("v").alias("ch", "x")))


@query("SELECT event_id, user_id, round(value, 6) AS value FROM (SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, value FROM events)")
def csv_matrices(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "matrices")
    table(spark, folder, "events").select("event_id", "user_id", "value").write.csv(path)
    v = F.col("v")
    return rounded(R.read_matrices(spark, path, 3).select(F.get(v, F.lit(0)).alias("event_id"), F.get(v, F.lit(1)).alias("user_id"), F.get(v, F.lit(2)).alias("value")))


@query("SELECT s_nationkey AS label, round(s_acctbal, 6) AS balance, 1 AS width FROM supplier")
def labelled_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The first column only numbers the rows, so it is left out."""
    path = new_folder(spark, "labelled")
    rows = table(spark, folder, "supplier").select((F.col("s_suppkey") - 1).alias("n"), "s_acctbal", F.col("s_nationkey").alias("microstate_label"), "s_name")
    rows.write.csv(path, header=True)
    if not R.has_header(spark, path):
        raise ValueError("no header found")
    read = R.read_labelled_csv(spark, path, "microstate_label")
    return rounded(read.select("label", F.get("v", F.lit(0)).alias("balance"), F.size("v").alias("width")))


@query("SELECT round(l_quantity, 6) AS a, round(l_tax, 6) AS b FROM lineitem")
def text_matrix(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "text")
    table(spark, folder, "lineitem").select(F.concat_ws("  ", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"))).write.text(path)
    return rounded(R.read_text_matrix(spark, path).select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")))


PROTOTYPES = f"{long_samples(1)}, maps AS (SELECT label AS k, ch, avg(x) AS m FROM x GROUP BY ALL)"


@query(f"WITH {PROTOTYPES} SELECT k, ch, round(m, 6) + 0.0 AS x FROM maps")
def map_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "maps")
    text = matrix_text(prototypes(spark, folder), "subject", "k", "m").select(F.concat(F.lit('{"maps": '), "text", F.lit("}")))
    text.coalesce(1).write.text(path)
    return rounded(R.read_maps(spark, path).select("k", F.posexplode("m").alias("ch", "x")))


@query(f"WITH {PROTOTYPES} SELECT 'rest' AS task, k_total, k, ch, round(m * (k_total - 1), 6) + 0.0 AS x, k_total / 4 AS cv, (k_total + k / 8)::DOUBLE AS gev FROM maps, (SELECT unnest([2, 3]) AS k_total)")
def map_lists(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "lists")
    maps = prototypes(spark, folder)
    once, twice = (matrix_text(maps.withColumn("m", F.transform("m", lambda x: x * n)), "subject", "k", "m").withColumnRenamed("text", f"m{n}") for n in (1, 2))
    n = maps.count()
    numbers = [f"[{','.join(str(k_total + k / 8) for k in range(n))}]" for k_total in (2, 3)]
    text = F.concat(F.lit('{"rest": {"maps_list": ['), "m1", F.lit(","), "m2", F.lit(f'], "cv_list": [0.5, 0.75], "gev_list": [{",".join(numbers)}], "min_maps": 2}}}}'))
    once.join(twice, "subject").select(text).coalesce(1).write.text(path)
    read = R.read_map_lists(spark, path)
    return rounded(read.select("task", "k_total", "k", F.posexplode("m").alias("ch", "x"), "cv", "gev"))


@query(f"WITH {long_samples(1)} SELECT i::INT AS ch, name, round(i * 5.5 - 170, 6) AS angle, CASE WHEN i % 9 < 8 THEN 0.25 END AS radius, round(m, 6) + 0.0 AS mean FROM (VALUES {', '.join(f'({i}, {name!r})' for i, name in enumerate(R.CAP63))}) v(i, name) JOIN (SELECT ch, avg(x) AS m FROM x GROUP BY ch) ON ch = i".replace("round(i * 5.5 - 170, 6) AS angle", "CASE WHEN i % 9 < 8 THEN round(i * 5.5 - 170, 6) END AS angle"))
def montage(spark: SparkSession, folder: str) -> DataFrame:
    """A montage that lacks every ninth channel, by name with the recording's channels and their samples' means."""
    path = new_folder(spark, "montage")
    lines = [(f"{i + 1}\t{i * 5.5 - 170}\t0.25\t{name}",) for i, name in reversed(list(enumerate(R.CAP63))) if i % 9 < 8]
    spark.createDataFrame(lines, "value string").write.text(path)
    means = M.long_format(samples(spark, folder)).groupBy("ch").agg(F.avg("x").alias("mean"))
    return rounded(R.placed_channels(spark, path).join(means, "ch"))


@query("SELECT (event_id % 100)::INT AS marker, event_id * 3 AS sample FROM events WHERE event_type = 'click'")
def markers(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "markers")
    kind = F.when(F.col("event_type") == "click", "Stimulus").otherwise("Response")
    table(spark, folder, "events").select(F.concat(F.lit("Mk"), F.col("event_id") % 100, F.lit("="), kind, F.lit(",S  1,"), F.col("event_id") * 3, F.lit(",1,0"))).write.text(path)
    return R.read_markers(spark, path).select("marker", "sample")


@query("SELECT n_name AS task, (2 + n_nationkey % 9)::INT AS mean_opt_k FROM nation")
def prior_statistic(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "statistic")
    one = F.concat(F.lit('"'), "n_name", F.lit('": {"mean_opt_k": '), 2 + F.col("n_nationkey") % 9, F.lit(', "note": [1, 2]}'))
    table(spark, folder, "nation").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(one), ","), F.lit("}"))).write.text(path)
    return R.read_prior_statistic(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS x, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS y, 1.5 AS z FROM orders")
def json_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that JSON doesn't have, in structs and nested arrays, are null in what was written."""
    path = new_folder(spark, "json")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    odd = lambda n, value: F.when(key % n == 0, F.lit(value)).otherwise(price)
    rows = table(spark, folder, "orders").select("o_orderkey", F.struct(F.array(F.array(odd(3, float("nan")))).alias("x"), F.create_map(F.lit("y"), odd(5, float("-inf"))).alias("m")).alias("s"), F.lit(1.5).alias("z"))
    R.write_json(rows, path)
    read = spark.read.schema("o_orderkey long, s struct<x: array<array<double>>, m: map<string, double>>, z double").json(path)
    return read.select("o_orderkey", F.get(F.get("s.x", F.lit(0)), F.lit(0)).alias("x"), F.element_at("s.m", "y").alias("y"), "z")


@query()
def component_files(spark: SparkSession, folder: str) -> DataFrame:
    """Eigenvalues as they are read back from the components' CSV files."""
    path = new_folder(spark, "components")
    rows = samples(spark, folder).select("subject", "t", "v")
    found = C.principal_components(rows, 0.9)
    R.write_components(found, C.component_scores(rows, found, centre=True), 90, path)
    return rounded(spark.read.schema("i int, eigenvalue double, pct int, subject int").csv(f"{path}/eigenvalues").select("pct", "subject", "i", "eigenvalue"))
