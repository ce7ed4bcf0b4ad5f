"""Readers and writers: recordings, numeric matrices, map files, montages, markers, condition dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
RECORDING = T.MapType(T.StringType(), MATRIX)

# The channel names of a recording, in channel order.
CAP63 = [
    "Fp1", "Fz", "F3", "F7", "FT9", "FC5", "FC1", "C3", "T7", "TP9", "CP5", "CP1", "Pz", "P3", "P7", "O1", "Oz",
    "O2", "P4", "P8", "TP10", "CP6", "CP2", "C4", "T8", "FT10", "FC6", "FC2", "F4", "F8", "Fp2", "AF7", "AF3",
    "AFz", "F1", "F5", "FT7", "FC3", "FCz", "C1", "C5", "TP7", "CP3", "P1", "P5", "PO7", "PO3", "POz", "PO4",
    "PO8", "P6", "P2", "CPz", "CP4", "TP8", "C6", "C2", "FC4", "FT8", "F6", "F2", "AF4", "AF8",
]


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file; a recording is one JSON document."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def read_recordings(spark: SparkSession, path: str, tasks: list[str] | None = None, channels_first: bool | None = True) -> DataFrame:
    """{subject}.json files of {task: matrix} as (subject, task, t, v array<double>).

    Matrices are channels x times (or, by choice, times x channels; None: times are the longer side). A missing task, or a ragged matrix, is an error when it is read.
    """
    files = _whole_files(spark, path).select(file_stem(F.col("path")).alias("subject"), F.from_json("text", RECORDING).alias("data"))
    if tasks:
        have = F.map_keys("data")
        missing = F.array_except(F.array(*[F.lit(t) for t in tasks]), have)
        files = files.where(F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("no such task: "), F.array_join(missing, ", "), F.lit(" of "), F.col("subject"))).cast("boolean")).otherwise(True))
    rows = files.select("subject", F.explode("data").alias("task", "x"))
    if tasks:
        rows = rows.where(F.col("task").isin(*tasks))
    width = F.size(F.get("x", F.lit(0)))
    even = F.when(F.exists("x", lambda r: F.size(r) != width), F.raise_error(F.concat(F.lit("ragged matrix: "), F.col("subject"), F.lit("/"), F.col("task"))).cast("boolean")).otherwise(True)
    rows = rows.where(even)
    if channels_first is not False:
        turned = F.transform(F.sequence(F.lit(0), width - 1), lambda t: F.transform("x", lambda channel: F.get(channel, t)))
        rows = rows.where(width > 0).withColumn("x", turned if channels_first else F.when(F.size("x") <= width, turned).otherwise(F.col("x")))
    return rows.select("subject", "task", F.posexplode("x").alias("t", "v")).withColumn("t", F.col("t").cast("long"))


def read_matrices(spark: SparkSession, path: str, columns: int, header: bool = False, sep: str = ",") -> DataFrame:
    """CSV files of numbers as (path, t, v): rows are times. The header is an explicit choice. Lines that aren't numbers give nulls inside v, none is dropped."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(columns)])
    lines = spark.read.option("recursiveFileLookup", True).csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE")
    v = F.array(*[F.col(f"c{i}") for i in range(columns)]).alias("v")
    rows = lines.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), v)
    order = Window.partitionBy("path").orderBy("block", "i")
    return rows.select("path", (F.row_number().over(order) - 1).cast("long").alias("t"), "v")


def whole_number_like(x: Column) -> Column:
    return F.trim(x).rlike(r"^[+-]?\d+(\.0*)?$")


def number_like(x: Column) -> Column:
    return F.trim(x).try_cast("double").isNotNull()


def has_letter(x: Column) -> Column:
    return x.rlike(r"\p{L}")


def has_header(spark: SparkSession, path: str) -> bool:
    """Whether the first line of the CSV files holds a value that is no number: judged by all files' first lines, an error if they differ."""
    first = _whole_files(spark, path).select(F.split(F.substring_index("text", "\n", 1), ",").alias("xs"))
    found = first.select(F.exists("xs", lambda x: ~number_like(F.regexp_replace(x, "[\"\r]", ""))).alias("header")).distinct().collect()
    if len(found) != 1:
        raise ValueError(f"files with and without a header, or none: {path}")
    return found[0]["header"]


def index_column(df: DataFrame, column: str) -> bool:
    """Whether a column of df(path, ...) numbers the rows of each file: whole numbers, all different, without gaps."""
    x = F.col(column).cast("double")
    whole = F.bool_and(F.coalesce(x == F.floor(x), F.lit(False))).alias("whole")
    per = df.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct(x).alias("different"), (F.max(x) - F.min(x)).alias("span"), whole)
    return bool(per.agg(F.bool_and(F.col("whole") & (F.col("different") == F.col("n")) & (F.col("span") == F.col("n") - 1))).first()[0])


def read_labelled_csv(spark: SparkSession, path: str, label: str, index: str | bool | None = None) -> DataFrame:
    """CSV files with a header: (path, label, v) of all numeric columns but the label and the index.

    index names a column that only numbers the rows; True: the first one does; False: there is none; None: the first one if it does (one more pass over the files).
    """
    df = spark.read.option("recursiveFileLookup", True).csv(path, header=True, inferSchema=True)
    numbers = [c for c, kind in df.dtypes if c != label and kind in ("int", "bigint", "double")]
    df = df.select(F.input_file_name().alias("path"), *[F.col(f"`{c}`") for c in df.columns])
    first = df.columns[1]
    if index is None:
        index = first in numbers and index_column(df.select("path", F.col(f"`{first}`").alias("x")), "x")
    left_out = index if isinstance(index, str) else first if index else None
    return df.select("path", F.col(f"`{label}`").alias("label"), F.array(*[F.col(f"`{c}`").cast("double") for c in numbers if c != left_out]).alias("v"))


def read_text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers between spaces as (path, v); blank lines and repeated spaces are skipped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.transform(F.filter(F.split("value", " "), lambda x: x != ""), lambda x: x.cast("double")).alias("v"))
    return lines.where(F.size("v") > 0)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Map files, {"maps": [...]} or a bare list, as (subject, k, m)."""
    files = _whole_files(spark, path)
    named, bare = F.from_json("text", T.StructType([T.StructField("maps", MATRIX)]))["maps"], F.from_json("text", MATRIX)
    return files.select(file_stem(F.col("path")).alias("subject"), F.posexplode(F.coalesce(F.when(F.ltrim("text").startswith("["), bare), named)).alias("k", "m"))


def read_map_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files of {task: {maps_list, cv_list, gev_list, min_maps, ...}} as (subject, task, k_total, k, m, cv, gev)."""
    fields = {"maps_list": T.ArrayType(MATRIX), "cv_list": T.ArrayType(T.DoubleType()), "gev_list": MATRIX, "min_maps": T.IntegerType()}
    entry = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    files = _whole_files(spark, path).select(file_stem(F.col("path")).alias("subject"), F.explode(F.from_json("text", T.MapType(T.StringType(), entry))).alias("task", "e"))
    lists = files.select("subject", "task", F.posexplode("e.maps_list").alias("i", "maps"), "e")
    k_total = (F.col("i") + F.coalesce("e.min_maps", F.lit(2))).alias("k_total")
    of_set = F.get("e.cv_list", F.col("i")).alias("cv"), F.get("e.gev_list", F.col("i")).alias("gevs")
    return lists.select("subject", "task", k_total, F.posexplode("maps").alias("k", "m"), *of_set).withColumn("gev", F.get("gevs", F.col("k"))).drop("gevs")


def read_montage(spark: SparkSession, path: str) -> DataFrame:
    """.locs files (number, angle, radius, name) as (ch, angle, radius, name)."""
    p = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(p, F.lit(i)).cast("double")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select((number(0).cast("int") - 1).alias("ch"), number(1).alias("angle"), number(2).alias("radius"), F.rtrim(F.get(p, F.lit(3))).alias("name"))


def channels(spark: SparkSession) -> DataFrame:
    """ch, name of a recording's channels."""
    return spark.createDataFrame(list(enumerate(CAP63)), "ch int, name string")


def placed_channels(spark: SparkSession, path: str) -> DataFrame:
    """ch, name, angle, radius of a recording's channels, by the montage file's places; channels that it doesn't name have none."""
    return channels(spark).join(read_montage(spark, path).select("name", "angle", "radius"), "name", "left").select("ch", "name", "angle", "radius")


def mirrored_channels(named: DataFrame) -> DataFrame:
    """left, right of channels(ch, name): an odd number is on the left, the next even one on the right of the same place."""
    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("int")
    parts = named.select("ch", F.regexp_replace("name", r"\d+$", "").alias("place"), number.alias("number")).where("number is not null")
    right = parts.select(F.col("ch").alias("right"), "place", (F.col("number") - 1).alias("number"))
    return parts.where("number % 2 = 1").join(right, ["place", "number"]).select(F.col("ch").alias("left"), "right")


def channel_lobes(named: DataFrame) -> DataFrame:
    """grp, ch of channels(ch, name): the letters of a name tell its region, such as F, FC or PO."""
    return named.select(F.upper(F.regexp_extract("name", r"^([A-Za-z]+?)[zZ]?\d*$", 1)).alias("grp"), "ch")


def read_prior_statistic(spark: SparkSession, path: str) -> DataFrame:
    """task, mean_opt_k of statistic files {task: {mean_opt_k, ...}}."""
    entry = T.StructType([T.StructField("mean_opt_k", T.IntegerType())])
    found = _whole_files(spark, path).select(F.explode(F.from_json("text", T.MapType(T.StringType(), entry))).alias("task", "e"))
    return found.select("task", "e.mean_opt_k")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker files' stimulus lines as (path, marker, sample)."""
    line = r"^Mk(\d+)=Stimulus,[^,]*,(\d+)"
    part = lambda i: F.regexp_extract("value", line, i)
    found = spark.read.text(path).where(F.col("value").rlike(line))
    return found.select(F.input_file_name().alias("path"), part(1).cast("int").alias("marker"), part(2).cast("long").alias("sample"))


def conditions(spark: SparkSession, mapping: dict[str, list[str]] | str) -> DataFrame:
    """{condition: [task, ...]}, or its JSON text, as (condition, place, task)."""
    found = json.loads(mapping) if isinstance(mapping, str) else mapping
    return spark.createDataFrame([(c, i, t) for c, tasks in found.items() for i, t in enumerate(tasks)], "condition string, place int, task string")


def json_safe(x: Column, kind: T.DataType | None = None) -> Column:
    """NaN and infinities as null, as JSON has neither, at any depth of arrays, structs and map values; binary values as base64, decimals as doubles."""
    kind = kind or T.DoubleType()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: json_safe(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[json_safe(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.BinaryType):
        return F.base64(x)
    if isinstance(kind, T.DecimalType):
        return x.cast("double")
    return x


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row, made safe. Errors are raised."""
    safe = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    df.select(*safe).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_components(components: DataFrame, scores: DataFrame, percentage: int, path: str, mode: str = "overwrite") -> None:
    """Principal components as CSV in folders by percentage and subject: eigenvalues, eigenvectors, projected samples."""
    pct = F.lit(percentage).alias("pct")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    components.select(pct, "subject", "i", "eigenvalue").write.mode(mode).partitionBy("pct", "subject").csv(f"{path}/eigenvalues")
    components.select(pct, "subject", "i", text("vector").alias("vector")).write.mode(mode).partitionBy("pct", "subject").csv(f"{path}/eigenvectors")
    scores.select(pct, "subject", "t", text("v").alias("v")).write.mode(mode).partitionBy("pct", "subject").csv(f"{path}/projected")
