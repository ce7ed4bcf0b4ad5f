"""Conditions, segments and task merges: the joins around recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_condition(rows: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the first condition that lists their task, and the rows of no condition. conditions(condition, place, task) is a small dimension."""
    first = conditions.groupBy("task").agg(F.min(F.struct("place", "condition")).alias("c")).select("task", F.col("c.condition").alias("condition"))
    return rows.join(first, "task"), rows.join(first, "task", "left_anti")


def by_pattern(rows: DataFrame, name: str, patterns: DataFrame, prefix: bool) -> DataFrame:
    """Rows with every condition whose pattern begins (or is in, without regard to case) their name. patterns(condition, pattern) travel as one array to each row."""
    all_of = patterns.agg(F.array_sort(F.collect_list(F.struct("condition", "pattern"))).alias("patterns"))
    fits = (lambda p: F.startswith(F.col(name), p["pattern"])) if prefix else (lambda p: F.contains(F.lower(F.col(name)), F.lower(p["pattern"])))
    return rows.join(F.broadcast(all_of), how="cross").select(*rows.columns, F.explode(F.filter("patterns", fits)).alias("p")).select(*rows.columns, F.col("p.condition").alias("condition"))


def in_segments(rows: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """Samples of each segment [begin, end), numbered anew (place) in order of parts: rows(subject, t, ...), segments(subject, segment, part, begin, end).

    A range join by buckets of `width`: a segment is there once for each bucket that it touches, and meets samples by an equi-join.
    """
    touched = segments.where("end > begin").withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    found = rows.withColumn("_b", F.floor(F.col("t") / width)).join(touched, ["subject", "_b"]).where((F.col("t") >= F.col("begin")) & (F.col("t") < F.col("end")))
    order = Window.partitionBy("subject", "segment").orderBy("part", "t")
    return found.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("_b", "begin", "end")


def merged_tasks(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Tasks laid end to end: merges(merged), names such as a#b, gives rows(subject, task, t, ...) of task a, then b, as (subject, merged, place, ...)."""
    parts = merges.select("merged", F.posexplode(F.split("merged", "#")).alias("part", "task"))
    order = Window.partitionBy("subject", "merged").orderBy("part", "t")
    return rows.join(parts, "task").withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("part")


def complete_pairs(rows: DataFrame, active: str, reference: str) -> DataFrame:
    """log power of the active task less that of the reference task: rows(subject, task, band, ch, log_power)."""
    one = lambda task, name: F.max(F.when(F.col("task") == task, F.col("log_power"))).alias(name)
    both = rows.where(F.col("task").isin(active, reference)).groupBy("subject", "band", "ch").agg(one(active, "a"), one(reference, "r")).where("a is not null and r is not null")
    return both.select("subject", "band", "ch", (F.col("a") - F.col("r")).alias("related_power"))


def joined_tasks(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_keys(one: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that both tables have."""
    return one.select(*keys).intersect(other.select(*keys))
