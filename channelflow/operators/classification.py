"""Conditions told from windows of state sequences: shares of states and of transitions, multinomial logistic regression, whole subjects held out."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelflow.functions.lineage import kept


def window_features(windows: DataFrame, n_states: int) -> DataFrame:
    """windows(subject, condition, begin, states) with features array<double>: the share of each state 0 to n_states - 1, and of each transition (row by row) among the window's steps.

    States outside of that range, or null, count for nothing. A window of one state has no steps and zeros for them.
    """
    n = F.size("states")
    steps = F.zip_with(F.slice("states", 1, F.greatest(n - 1, F.lit(0))), F.slice("states", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a.between(0, n_states - 1) & b.between(0, n_states - 1), a * n_states + b))
    share = lambda xs, of, k: F.coalesce(F.try_divide(F.size(F.filter(xs, lambda x: x == k)), of), F.lit(0.0))
    both = windows.withColumn("_steps", steps)
    states = F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)), lambda k: share(F.col("states"), n, k))
    moves = F.transform(F.sequence(F.lit(0), F.lit(n_states * n_states - 1)), lambda k: share(F.col("_steps"), n - 1, k))
    return both.withColumn("features", F.concat(states, moves)).drop("_steps")


def fold_of(subject: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(subject.cast("string")), F.lit(folds)).cast("int")


def held_out_conditions(rows: DataFrame, folds: int = 5, regularisation: float = 0.01, rounds: int = 100) -> DataFrame:
    """subject, begin, condition, fold, predicted and probability (of the predicted condition) of rows(subject, begin, condition, features).

    Each fold's subjects are judged by a model of the others: multinomial logistic regression with a squared penalty, whose gradients Spark sums over all windows in every round. Conditions stand in
    ascending order; of equal probabilities the first wins. A fold whose training rows have a single condition predicts that one; without any, null. Null conditions or features are an error.
    """
    rows = kept(rows.select("subject", "begin", "condition", fold_of(F.col("subject"), folds).alias("fold"), array_to_vector("features").alias("features")))
    present = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    names = sorted(r["condition"] for r in rows.select("condition").distinct().collect())
    schema_names = F.array(*[F.lit(x) for x in names])
    numbered = rows.withColumn("label", (F.array_position(schema_names, F.col("condition")) - 1).cast("double"))
    out = None
    for fold in present:
        train, held = numbered.where(F.col("fold") != fold), numbered.where(F.col("fold") == fold)
        classes = [r["condition"] for r in train.select("condition").distinct().limit(2).collect()]
        columns = ["subject", "begin", "condition", "fold"]
        if len(classes) < 2:
            only = F.lit(classes[0]) if classes else F.lit(None)
            part = held.select(*columns, only.cast("string").alias("predicted"), F.lit(1.0 if classes else None).cast("double").alias("probability"))
        else:
            model = LogisticRegression(family="multinomial", regParam=regularisation, maxIter=rounds).fit(train)
            scored = model.transform(held).withColumn("p", vector_to_array("probability"))
            best = F.array_max("p")
            part = scored.select(*columns, F.get(schema_names, (F.array_position("p", best) - 1).cast("int")).alias("predicted"), best.alias("probability"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return numbered.select("subject", "begin", "condition", "fold", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("probability"))
    return out


def accuracy(judged: DataFrame) -> DataFrame:
    """fold, windows, correct (their share predicted right) and majority (the share of the fold's most frequent condition)."""
    per = judged.groupBy("fold", "condition").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("condition")).alias("hits"))
    n = F.sum("n")
    return per.groupBy("fold").agg(n.alias("windows"), (F.sum("hits") / n).alias("correct"), (F.max("n") / n).alias("majority"))
