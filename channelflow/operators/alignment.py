"""Matching map sets: optimal assignment, greedy similarity, mean maps, best combinations, reordering.

Map sets have K maps each, a handful. Correlations are expressions; the assignment over the K x K matrix is a vectorised function of one row for each
set. Mean maps iterate in tasks of one group's sets and one start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelflow.functions import vectors as V
from channelflow.functions.batches import by_key

from .maps import map_sets


def correlation_matrix(a: Column, b: Column, absolute: bool) -> Column:
    """array<array<double>>: correlations of maps a (rows) with maps b."""
    value = lambda r: F.abs(r) if absolute else r
    return F.transform(a, lambda x: F.transform(b, lambda y: F.coalesce(value(V.correlation(x["m"], y["m"])), F.lit(0.0))))


def matched(sets: DataFrame) -> DataFrame:
    """Rows of sets(..., c), a matrix of correlations, for each of its rows i with its column j in the one-to-one assignment of greatest total; j is -1 for rows without
    one, if there are more rows than columns."""
    schema = f"{', '.join(f'{name} {kind}' for name, kind in sets.dtypes)}, p array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m in batch["c"]:
                c = np.stack(m) if len(m) else np.zeros((0, 0))
                n = max(c.shape)
                padded = np.zeros((n, n))
                padded[: c.shape[0], : c.shape[1]] = c
                # rounding makes sums that differ only in the order of addition tie
                out.append([j if j < c.shape[1] else -1 for j in hungarian(-np.round(padded, 12))[: c.shape[0]]])
            yield batch.assign(p=out)

    return sets.mapInPandas(run, schema).select(*sets.columns, F.posexplode("p").alias("i", "j"))


def _with_target(sets: DataFrame, template: DataFrame) -> DataFrame:
    """subject, maps, target: the template's maps, one row, beside each set."""
    target = template.agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("target"))
    return map_sets(sets).join(F.broadcast(target), how="cross")  # one row


def assign(sets: DataFrame, template: DataFrame, absolute: bool = False) -> DataFrame:
    """subject, k_src, k_dst, r: the one-to-one assignment of each set's maps to the template's of greatest total correlation.

    template(k, m) is one set. Sets may be larger or smaller than it: maps without a partner have k_dst and r null.
    """
    matrix = _with_target(sets, template).withColumn("c", correlation_matrix(F.col("maps"), F.col("target"), absolute))
    rows = matched(matrix)
    at = F.when(F.col("j") >= 0, F.col("j"))
    return rows.select("subject", F.get("maps", F.col("i"))["k"].alias("k_src"), F.get("target", at)["k"].alias("k_dst"), F.get(F.get(F.col("c"), F.col("i")), at).alias("r"))


def padded_similarity(sets: DataFrame, template: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The absolute assignment of sets of any sizes, with correlations below the threshold taken as 0 before; maps without a partner have k_dst and r -1."""
    matrix = _with_target(sets, template).withColumn("c", correlation_matrix(F.col("maps"), F.col("target"), True))
    matrix = matrix.withColumn("c", F.transform("c", lambda row: F.transform(row, lambda r: F.when(r < threshold, 0.0).otherwise(r))))
    rows = matched(matrix)
    at = F.when(F.col("j") >= 0, F.col("j"))
    return rows.select(
        "subject",
        F.get("maps", F.col("i"))["k"].alias("k_src"),
        F.coalesce(F.get("target", at)["k"], F.lit(-1)).alias("k_dst"),
        F.coalesce(F.get(F.get(F.col("c"), F.col("i")), at), F.lit(-1.0)).alias("r"),
    )


def greedy_similarity(sets: DataFrame, template: DataFrame) -> DataFrame:
    """Repeatedly the greatest absolute correlation left, its row and column struck out; ties by row, then column."""
    joined = _with_target(sets, template)
    less = lambda x, y: -F.round(F.coalesce(F.abs(V.correlation(x["m"], y["m"])), F.lit(0.0)), 12)
    cell = lambda x, y: F.struct(less(x, y).alias("n"), x["k"].cast("int").alias("i"), y["k"].cast("int").alias("j"))
    cells = F.flatten(F.transform("maps", lambda x: F.transform("target", lambda y: cell(x, y))))
    empty = F.expr("cast(array() as array<struct<n: double, i: int, j: int>>)")
    taken = lambda got, c: F.exists(got, lambda g: (g["i"] == c["i"]) | (g["j"] == c["j"]))
    pick = F.aggregate(F.array_sort(cells), empty, lambda got, c: F.when(taken(got, c), got).otherwise(F.concat(got, F.array(c))))
    return joined.select("subject", F.explode(pick).alias("g")).select("subject", F.col("g.i").alias("k_src"), F.col("g.j").alias("k_dst"), (-F.col("g.n")).alias("r"))


def reordered(maps: DataFrame, order: DataFrame) -> DataFrame:
    """maps(subject, k, m) at the places of order(subject, place, k)."""
    return maps.join(order, ["subject", "k"]).select("subject", F.col("place").alias("k"), "m")


def checked_order(order: list[int], n: int) -> list[int]:
    """The order, if it is a permutation of 0 to n - 1; an error otherwise."""
    if sorted(order) != list(range(n)):
        raise ValueError(f"no permutation of {n} places: {order}")
    return order


def reordered_sheet(sheet: DataFrame, keys: list[str], prefix: str, order: list[int]) -> DataFrame:
    """A wide sheet whose columns prefix0, prefix1, ... hold one value for each map: the value of map order[i] becomes that of place i. Other columns stay."""
    places = checked_order(order, sum(c.startswith(prefix) and c[len(prefix) :].isdigit() for c in sheet.columns))
    moved = {f"{prefix}{place}": F.col(f"{prefix}{k}").alias(f"{prefix}{place}") for place, k in enumerate(places)}
    return sheet.select(*[moved.get(c, F.col(c)) for c in sheet.columns])


def condition_sheet(runs: DataFrame, key: str, condition: str, value: str, place: str) -> DataFrame:
    """Run parameters in long form as one wide row for each key and condition: the mean over the condition's runs in a column for each place."""
    return runs.groupBy(key, condition).pivot(place).agg(F.avg(value))


def grid_order(sets: DataFrame, first: object, order: list[int]) -> DataFrame:
    """subject, place, k: how to lay out map sets in a grid. The set `first` stands in the given order, every other set's maps below those that they match best, whatever the polarity."""
    n = len(order)
    template = sets.where(F.col("subject") == F.lit(first)).select("k", "m")
    places = sets.sparkSession.createDataFrame([(i, k) for i, k in enumerate(checked_order(order, n))], "place int, k_dst int")
    found = assign(sets, template, absolute=True).join(places, "k_dst")
    return found.select("subject", "place", F.col("k_src").alias("k"))


def best_combinations(scored: DataFrame) -> DataFrame:
    """scored(grp, score, members array): of each group the combinations of greatest score that share no member with a better one; equal scores by members.

    Groups are of few combinations: those of one K over a handful of runs.
    """
    each = F.struct((-F.col("score")).alias("n"), F.col("members").alias("ms"))
    empty = F.expr(f"cast(array() as array<struct<n: double, ms: {dict(scored.dtypes)['members']}>>)")
    kept = F.aggregate(
        F.array_sort(F.collect_list(each)),
        empty,
        lambda got, x: F.when(F.exists(got, lambda g: F.arrays_overlap(g["ms"], x["ms"])), got).otherwise(F.concat(got, F.array(F.struct(x["n"].cast("double").alias("n"), x["ms"].alias("ms"))))),
    )
    return scored.groupBy("grp").agg(kept.alias("kept")).select("grp", F.posexplode("kept").alias("place", "x")).select("grp", "place", (-F.col("x.n")).alias("score"), F.col("x.ms").alias("members"))


def representative(maps: DataFrame) -> DataFrame:
    """maps(grp, k, m), few in a group: the one of greatest mean absolute correlation with the others of its group, the least k on ties: grp, k, mean_r."""
    sets = maps.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("maps"))
    others = lambda x: F.filter("maps", lambda y: y["k"] != x["k"])
    total = lambda x: F.aggregate(others(x), F.lit(0.0), lambda s, y: s + F.coalesce(F.abs(V.correlation(x["m"], y["m"])), F.lit(0.0)))
    each = F.transform("maps", lambda x: F.struct((-F.round(F.try_divide(total(x), F.size("maps") - 1), 12)).alias("n"), x["k"].alias("k")))
    return sets.select("grp", F.array_min(each).alias("best")).select("grp", F.col("best.k").alias("k"), (-F.col("best.n")).alias("mean_r"))


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in the assignment of least cost of a square matrix: shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        slack, seen, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while True:
            seen[at] = True
            free = ~seen
            free[0] = False
            reach = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = free[1:] & (reach < slack[1:])
            slack[1:][better], back[1:][better] = reach[better], at
            nxt = int(np.where(free, slack, np.inf).argmin())
            step = slack[nxt]
            u[match[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            at = nxt
            if match[at] == 0:
                break
        while at:
            match[at], at = match[back[at]], back[at]
    out = [0] * n
    for column in range(1, n + 1):
        out[match[column] - 1] = column - 1
    return out


def _standard(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def aligned_from(sets: list[np.ndarray], start: int, absolute: bool = False, rounds: int = 100) -> tuple[np.ndarray, list[list[int]], list[list[int]], float, float]:
    """Mean maps by iterated alignment with the set `start` as the first template.

    Returns maps, each set's assignment and signs, mean and deviation of the absolute correlations.
    """
    unit = [_standard(np.asarray(s, dtype=float)) for s in sets]
    template, last = unit[start], None
    for _ in range(rounds):
        matrices = [s @ template.T for s in unit]
        labels = [hungarian(-(np.abs(c) if absolute else c)) for c in matrices]
        values = np.array([[c[i, j] for i, j in enumerate(p)] for c, p in zip(matrices, labels, strict=True)])
        signs = np.where(values >= 0, 1, -1)
        if labels == last:
            break
        last, used = labels, template
        total = np.zeros_like(template)
        for s, p, g in zip(unit, labels, signs, strict=True):
            np.add.at(total, p, s * g[:, None])
        template = _standard(total / len(unit))
    else:
        template = used
    return template, labels, signs.tolist(), float(np.abs(values).mean()), float(np.abs(values).std())


STARTS = 16  # first templates of a task


def mean_maps(sets: DataFrame, group: str) -> DataFrame:
    """sets(group, subject, k, m) of equal K: the group's mean maps (group, k, m, similarity, deviation), each set in turn as the first template; the best by mean
    similarity, then by lower deviation, then by order of subjects. A task has a block of starts and the group's sets, K maps each, so a group's sets are copied once for STARTS of them."""
    kind = dict(sets.dtypes)[group]
    packed = sets.groupBy(group, "subject").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("maps"))
    packed = packed.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("subject", "maps"))), lambda x: F.transform(x["maps"], lambda m: m["m"])).alias("sets"))
    blocks = packed.select(group, "sets", F.explode(F.sequence(F.lit(0), F.floor((F.size("sets") - 1) / STARTS).cast("int"))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, given, block in zip(batch[group], batch["sets"], batch["block"], strict=True):
                sets_of = [np.stack(s) for s in given]
                for start in range(block * STARTS, min(len(sets_of), (block + 1) * STARTS)):
                    maps, _, _, similarity, deviation = aligned_from(sets_of, start)
                    rows.append((name, start, maps.tolist(), similarity, deviation))
            yield pd.DataFrame(rows, columns=[group, "start", "maps", "similarity", "deviation"])

    spread = blocks.repartition(group, "block")
    found = spread.mapInPandas(run, f"{group} {kind}, start int, maps array<array<double>>, similarity double, deviation double")
    order = F.struct(F.round("similarity", 12), -F.round("deviation", 12), -F.col("start"))
    best = found.groupBy(group).agg(F.max_by(F.struct("maps", "similarity", "deviation"), order).alias("b"))
    return best.select(group, F.posexplode("b.maps").alias("k", "m"), "b.similarity", "b.deviation")


def pairwise_similarity(sets: DataFrame) -> DataFrame:
    """Mean matched absolute correlation of each pair of a group's map sets: sets(grp, subject, k, m), few sets a group; pairs within the group's own array."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(s, _standard(np.stack(p.sort_values("k")["m"].to_numpy()))) for s, p in sorted(by_key(rows, "subject"), key=lambda x: x[0])]
        out = []
        for i, (a, x) in enumerate(parts):
            for b, y in parts[i + 1 :]:
                c = np.abs(x @ y.T)
                out.append((rows["grp"].iloc[0], a, b, float(np.mean([c[r, j] for r, j in enumerate(hungarian(-c))]))))
        return pd.DataFrame(out, columns=["grp", "a", "b", "similarity"])

    kinds = dict(sets.dtypes)
    return sets.groupBy("grp").applyInPandas(run, f"grp {kinds['grp']}, a {kinds['subject']}, b {kinds['subject']}, similarity double")
