"""Queries over the relational tables: weighted statistics, filters, paired comparison, condition joins, segments, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.operators import alignment as A
from channelflow.operators import inference as I
from channelflow.operators import sequences as S
from channelflow.operators import statistics as Q
from channelflow.operators import tasks as J
from channelflow.sources.recordings import conditions

from .registry import query, rounded, table
from .sequence_queries import states


@query(
    """WITH m AS (SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(mean, 4) AS mean, round(sqrt(sum((l_extendedprice - mean) ** 2 * l_quantity) / sum(l_quantity)), 4) AS std FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag, mean"""
)
def weighted_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = Q.weighted_stats(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
SELECT o_orderkey, o_totalprice FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)"""
)
def iqr_filter(spark: SparkSession, folder: str) -> DataFrame:
    return Q.iqr_filter(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", 0.2).select("o_orderkey", "o_totalprice")


@query("SELECT l_linestatus, round(sum(l_discount) / count(*) FILTER (l_discount <> 0), 6) AS mean FROM lineitem GROUP BY 1")
def nonzero_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(table(spark, folder, "lineitem").groupBy("l_linestatus").agg(Q.nonzero_mean(F.col("l_discount")).alias("mean")))


PAIRS = """WITH v AS (SELECT user_id, event_type AS c, avg(value) AS x FROM events GROUP BY ALL), d AS (SELECT a.c AS a, b.c AS b, a.x - b.x AS d FROM v a JOIN v b ON a.user_id = b.user_id AND a.c < b.c)"""


def paired(spark: SparkSession, folder: str) -> DataFrame:
    means = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    return Q.paired_t(means, "user_id", "event_type", "x")


@query(f"{PAIRS} SELECT a, b, count(*) AS n, round(avg(d), 6) AS difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d GROUP BY a, b")
def paired_t(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(paired(spark, folder))


@query()
def paired_t_p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.bonferroni(paired(spark, folder).withColumn("p", I.t_p(F.col("t"), F.col("n"))), "p"))


@query("SELECT doc_id, p, least(1.0, p * count(*) OVER ())::DOUBLE AS adjusted FROM (SELECT doc_id, round(1.0 / (10 + doc_id), 6)::DOUBLE AS p FROM labels)")
def bonferroni(spark: SparkSession, folder: str) -> DataFrame:
    return Q.bonferroni(table(spark, folder, "labels").select("doc_id", F.round(1.0 / (10 + F.col("doc_id")), 6).alias("p")), "p")


@query()
def markov_p(spark: SparkSession, folder: str) -> DataFrame:
    g = S.markov_g(states(spark, folder), 1)
    return rounded(g.withColumn("p", I.chi_square_p(F.col("g"), F.col("df"))))


@query(
    """WITH c AS (SELECT unnest([0, 1]) AS class), n AS (SELECT class, count(*) FILTER (quality = class AND toxic = class) AS tp, count(*) FILTER (quality = class AND toxic <> class) AS fn, count(*) FILTER (quality <> class AND toxic = class) AS fp, count(*) FILTER (quality <> class AND toxic <> class) AS tn FROM c, labels GROUP BY class)
SELECT class, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n"""
)
def confusion_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Q.confusion_measures(table(spark, folder, "labels"), "quality", "toxic"))


CONDITIONS = {"home": ["HOUSEHOLD", "FURNITURE"], "work": ["MACHINERY", "BUILDING", "HOUSEHOLD"]}


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'work' END AS condition FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY', 'BUILDING')")
def condition_equi_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "task")
    return J.by_condition(rows, conditions(spark, CONDITIONS))[0].select("c_custkey", "condition")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY', 'BUILDING') OR c_mktsegment IS NULL")
def condition_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "task")
    return J.by_condition(rows, conditions(spark, CONDITIONS))[1].select("c_custkey")


PATTERNS = [("a", "small"), ("b", "red"), ("c", "sm"), ("d", "widget")]


@query(f"SELECT p_partkey, condition FROM part JOIN (VALUES {', '.join(map(str, PATTERNS))}) v(condition, pattern) ON starts_with(p_name, pattern)")
def condition_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return J.by_pattern(table(spark, folder, "part"), "p_name", spark.createDataFrame(PATTERNS, "condition string, pattern string"), True).select("p_partkey", "condition")


@query(f"SELECT p_partkey, condition FROM part JOIN (VALUES {', '.join(map(str, PATTERNS))}) v(condition, pattern) ON contains(lower(p_name), pattern)")
def condition_contains_join(spark: SparkSession, folder: str) -> DataFrame:
    return J.by_pattern(table(spark, folder, "part"), "p_name", spark.createDataFrame(PATTERNS, "condition string, pattern string"), False).select("p_partkey", "condition")


SEGMENTS = [("rest", 0, 5, 15), ("rest", 1, 30, 38), ("task", 0, 10, 34)]


@query(
    f"""WITH s AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_type AS state FROM events), g AS (SELECT * FROM (VALUES {', '.join(map(str, SEGMENTS))}) v(segment, part, a, b))
SELECT subject, segment, part, t, row_number() OVER (PARTITION BY subject, segment ORDER BY part, t) - 1 AS place, state FROM s JOIN g ON t >= a AND t < b"""
)
def segment_range_join(spark: SparkSession, folder: str) -> DataFrame:
    seq = states(spark, folder)
    segments = spark.createDataFrame(SEGMENTS, "segment string, part int, begin long, end long")
    every = seq.select("subject").distinct().join(segments, how="cross")  # the same few segments for each subject
    return J.in_segments(seq, every, 10).select("subject", "segment", "part", "t", "place", "state")


@query(
    """WITH s AS (SELECT user_id AS subject, event_type AS task, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t FROM events)
SELECT subject, 'click#view' AS merged, task, t, row_number() OVER (PARTITION BY subject ORDER BY task <> 'click', t) - 1 AS place FROM s WHERE task IN ('click', 'view')"""
)
def task_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("task"), (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1).alias("t"))
    return J.merged_tasks(rows, spark.createDataFrame([("click#view",)], "merged string")).select("subject", "merged", "task", "t", "place")


@query("SELECT user_id % 7 AS subject, event_type AS band, round(avg(CASE WHEN user_id % 2 = 0 THEN ln(1 + abs(value)) END) - avg(CASE WHEN user_id % 2 = 1 THEN ln(1 + abs(value)) END), 6) AS related FROM events GROUP BY ALL")
def task_related_power(spark: SparkSession, folder: str) -> DataFrame:
    power = table(spark, folder, "events").groupBy((F.col("user_id") % 7).alias("subject"), F.when(F.col("user_id") % 2 == 0, "active").otherwise("rest").alias("task"), F.col("event_type").alias("band")).agg(F.avg(F.ln(1 + F.abs("value"))).alias("log_power"))
    return rounded(J.complete_pairs(power.withColumn("ch", F.lit(0)), "active", "rest").select("subject", "band", F.col("related_power").alias("related")))


@query("SELECT r_name, n_name, count(*) AS suppliers, round(avg(s_acctbal), 6) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(rows.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.avg("s_acctbal").alias("mean")))


@query("SELECT o_orderpriority AS task, floor(avg(2 + o_orderkey % 9))::INT AS mean_opt_k, floor(avg(2 + o_orderkey % 9))::INT - 2 AS place FROM orders GROUP BY 1")
def mean_best_k(spark: SparkSession, folder: str) -> DataFrame:
    best = table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("task"), (2 + F.col("o_orderkey") % 9).alias("k_total"))
    return Q.mean_best_k(best)


@query(
    """WITH p AS (SELECT user_id AS subject, CASE WHEN user_id % 3 = 2 THEN 'work' ELSE 'rest' END AS condition, event_type AS state, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS d, value AS c FROM events)
SELECT subject, condition, state, round(sum(d) / nullif(count(*) FILTER (d <> 0), 0), 6) AS duration, round(sum(d) / nullif(count(*) FILTER (d <> 0), 0), 6) AS occurrence, round(avg(c), 6) AS coverage FROM p GROUP BY ALL"""
)
def condition_parameters(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value"))
    epochs = table(spark, folder, "events").select(F.col("user_id").alias("subject"), F.concat(F.lit("task_"), F.col("user_id") % 3).alias("task"), F.col("event_id").alias("epoch"), F.col("event_type").alias("state"), value.alias("duration"), value.alias("occurrence"), F.col("value").alias("coverage"))
    return rounded(Q.condition_parameters(epochs, conditions(spark, {"rest": ["task_0", "task_1"], "work": ["task_2"]})))


@query(
    """WITH RECURSIVE c AS (SELECT n_regionkey AS grp, (n_nationkey * 7 % 25)::DOUBLE AS score, [n_nationkey % 6, 6 + n_nationkey % 4]::BIGINT[] AS members FROM nation),
pick AS (SELECT grp, 0 AS place, score, members, members AS used FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC) AS o FROM c) WHERE o = 1
UNION ALL SELECT grp, place, score, members, used FROM (SELECT p.grp, p.place + 1 AS place, c.score, c.members, list_concat(p.used, c.members) AS used, row_number() OVER (PARTITION BY p.grp ORDER BY c.score DESC) AS o FROM pick p JOIN c ON c.grp = p.grp AND NOT list_has_any(p.used, c.members) AND c.score < p.score) WHERE o = 1)
SELECT grp, place, score, array_to_string(members, '-') AS members FROM pick"""
)
def best_combinations(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    scored = table(spark, folder, "nation").select(F.col("n_regionkey").alias("grp"), (n * 7 % 25).cast("double").alias("score"), F.array(n % 6, 6 + n % 4).alias("members"))
    return A.best_combinations(scored).withColumn("members", F.array_join("members", "-"))


@query("SELECT o_orderkey, m1 AS m0, m2 AS m1, m0 AS m2 FROM (SELECT o_orderkey, o_totalprice AS m0, o_totalprice * 2 AS m1, o_totalprice * 3 AS m2 FROM orders)")
def reordered_sheet(spark: SparkSession, folder: str) -> DataFrame:
    sheet = table(spark, folder, "orders").select("o_orderkey", *[(F.col("o_totalprice") * (i + 1)).alias(f"m{i}") for i in range(3)])
    return A.reordered_sheet(sheet, ["o_orderkey"], "m", [1, 2, 0])


@query("SELECT l_suppkey, l_returnflag, " + ", ".join(f'round(avg(l_quantity) FILTER (l_linenumber = {i}), 6) AS "p{i}"' for i in range(1, 8)) + " FROM lineitem GROUP BY ALL")
def condition_sheet(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "lineitem").withColumn("place", F.concat(F.lit("p"), "l_linenumber"))
    found = rounded(A.condition_sheet(runs, "l_suppkey", "l_returnflag", "l_quantity", "place"))
    return found.select("l_suppkey", "l_returnflag", *[F.col(f"p{i}") if f"p{i}" in found.columns else F.lit(None).cast("double").alias(f"p{i}") for i in range(1, 8)])


@query("SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 0 ELSE ceil(log2(p_partkey)) END::BIGINT AS power, CASE WHEN p_partkey % 12 > 9 THEN 0 ELSE factorial(9) // (factorial((p_partkey % 12)::INT) * factorial((9 - least(9, p_partkey % 12))::INT)) END::BIGINT AS nine_over, ceil(p_partkey / 7 * 100) / 100 AS up, round(1 / (1 + exp(-0.1 * (p_partkey - 50))), 6) AS ramp FROM part")
def math_helpers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    out = table(spark, folder, "part").select("p_partkey", V.next_power_of_two(k).alias("power"), V.choose(F.lit(9), (k % 12).cast("int")).alias("nine_over"), V.ceil_to(k / 7, 2).alias("up"), F.round(V.ramp(k, 50, 0.1), 6).alias("ramp"))
    return out


@query(
    """WITH n AS (SELECT count(*) AS n FROM supplier), o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), r AS (SELECT range AS i, range * n - range * (range + 1) // 2 AS before, n FROM n, range(100000) WHERE range < n)
SELECT r.i, k - before + r.i + 1 AS j, k FROM o JOIN r ON k >= before AND k < before + n - 1 - r.i"""
)
def condensed_places(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, numbered by key, as places of the condensed list of pairs of suppliers: the pair that stands there, and the place found again from it. Only as many pairs as orders are made."""
    n = table(spark, folder, "supplier").count()
    orders = table(spark, folder, "orders").select("o_orderkey")
    # numbers by key from counts of ranges of keys, so that no task orders the table
    width = 10_000
    ranges = orders.groupBy(F.floor(F.col("o_orderkey") / width).alias("r")).agg(F.count("*").alias("m"))
    before = ranges.select("r", (F.sum("m").over(Window.orderBy("r")) - F.col("m")).alias("before"))
    within = F.row_number().over(Window.partitionBy("r").orderBy("o_orderkey")) - 1
    numbered = orders.withColumn("r", F.floor(F.col("o_orderkey") / width)).withColumn("i", within).join(before, "r").select((F.col("i") + F.col("before")).alias("k"))
    found = numbered.where(F.col("k") < n * (n - 1) // 2).withColumn("p", V.square_place(F.col("k"), F.lit(n)))
    return found.select("p.i", "p.j", V.condensed_place(F.col("p.j"), F.col("p.i"), F.lit(n)).alias("k"))


@query("SELECT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def shared_keys(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"))
    other = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return J.shared_keys(one, other, "custkey")


@query("SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def joined_tasks(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    other = table(spark, folder, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return J.joined_tasks(one, other)


@query("SELECT l_orderkey, l_linenumber, l_tax AS x0, l_quantity AS x1, l_discount AS x2 FROM lineitem")
def reordered_lists(spark: SparkSession, folder: str) -> DataFrame:
    v = V.reordered(F.array("l_quantity", "l_discount", "l_tax"), F.array(F.lit(2), F.lit(0), F.lit(1)))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(3)])
