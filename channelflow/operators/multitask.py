"""Principal components of several tasks at once, drawn towards one another.

The tasks of a group have a subspace each; together they minimise
    - 1/2 sum_i tr(U_i' C_i U_i) - coupling/4 sum_{i<>j} tr(U_i U_i' U_j U_j').
With the others fixed, the best U_i is the leading eigenspace of C_i + coupling * sum_{j<>i} U_j U_j', so each step lowers the cost. All that is needed of the data are the tasks'
covariances, which Spark sums from the samples; a task of the job holds those of one group, and one coupling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import covariance


def leading(matrix: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal rows of the greatest eigenvalues, each with a positive largest component."""
    rows = np.linalg.eigh(matrix)[1][:, ::-1][:, :count].T
    return rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1, 1)[:, None]


def coupled_cost(covariances: np.ndarray, spaces: list[np.ndarray], coupling: float) -> float:
    projectors = np.stack([u.T @ u for u in spaces])
    total = projectors.sum(axis=0)
    own = sum(np.trace(u @ c @ u.T) for c, u in zip(covariances, spaces, strict=True))
    return float(-own / 2 - coupling / 4 * ((total * total).sum() - (projectors * projectors).sum()))


def coupled_spaces(covariances: np.ndarray, count: int, coupling: float, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[list[np.ndarray], list[float]]:
    """The tasks' subspaces and the cost after each round, from each task's own components on."""
    spaces = [leading(c, count) for c in covariances]
    costs = [coupled_cost(covariances, spaces, coupling)]
    total = sum(u.T @ u for u in spaces)
    for _ in range(rounds if coupling else 0):
        for i, c in enumerate(covariances):
            others = total - spaces[i].T @ spaces[i]
            spaces[i] = leading(c + coupling * others, count)
            total = others + spaces[i].T @ spaces[i]
        costs.append(coupled_cost(covariances, spaces, coupling))
        if costs[-2] - costs[-1] <= tolerance * max(1.0, abs(costs[-1])):
            break
    return spaces, costs


def multitask_components(samples: DataFrame, count: int, couplings: Sequence[float], rounds: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """grp, coupling, task, i, vector, score (the share of the task's variance in its subspace) and costs (after each round) for samples(grp, task, t, v).

    Coupling 0 gives each task's own components. For components of all tasks' samples as one, use principal_components() by group. A group may have one task; of constant samples the score is null.
    """
    kind = dict(samples.dtypes)["grp"]
    keyed = samples.select(F.to_json(F.struct("grp", "task")).alias("subject"), "v")
    keys = samples.select("grp", F.col("task").cast("string").alias("task"), F.to_json(F.struct("grp", "task")).alias("subject")).distinct()
    cells = covariance(keyed).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("i", "j", "c"))).alias("cells"))
    tasks = cells.join(keys, "subject").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("task", "cells"))).alias("tasks"))
    jobs = tasks.withColumn("coupling", F.explode(F.array(*[F.lit(float(x)) for x in couplings]))).repartition("grp", "coupling")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, given, coupling in zip(batch["grp"], batch["tasks"], batch["coupling"], strict=True):
                n = max(c["i"] for c in given[0]["cells"]) + 1
                covariances = np.zeros((len(given), n, n))
                for matrix, task in zip(covariances, given, strict=True):
                    for c in task["cells"]:
                        matrix[c["i"], c["j"]] = matrix[c["j"], c["i"]] = c["c"] or 0.0
                spaces, costs = coupled_spaces(covariances, min(count, n), coupling, rounds, tolerance)
                for task, c, u in zip(given, covariances, spaces, strict=True):
                    whole = np.trace(c)
                    score = float(np.trace(u @ c @ u.T) / whole) if whole > 0 else None
                    k = len(u)
                    yield pd.DataFrame(
                        {"grp": [grp] * k, "coupling": [coupling] * k, "task": [task["task"]] * k, "i": np.arange(k, dtype=np.int32), "vector": list(u), "score": [score] * k, "costs": [costs] * k}
                    )

    return jobs.mapInPandas(run, f"grp {kind}, coupling double, task string, i int, vector array<double>, score double, costs array<double>")
