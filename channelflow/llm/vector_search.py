"""Exact top-k by inner product: columnar branch-and-bound.

Candidates are dealt once to cells of bounded size and stay there; queries pass through the cells in batches. In a cell, candidates lie in vertical layout, one
row a dimension, and scores are accumulated dimension block by block. After each, the norms of the dimensions still to come bound what is left of every
score; candidates whose upper bound is below the query's floor are dropped, and the survivors compacted. The floor begins with the
k-th best score among a few pivots, which are candidates themselves, and rises with the best lower bounds. Sums are of integers, so scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
EVERY = 50
CELL = 4_000_000  # components of a cell's candidates, about
SMALL_CELL = 65_536  # of a table too small to fill a cell for each task
PIVOTS = 2048  # candidates at most that give the first floors
PIVOT_DIMENSIONS = 1024  # of such a candidate at most: with the line above, the bound of what is broadcast
TILE = 4096  # candidates that share a step
DIMENSIONS = 16  # of a step
LONG = 1 << 63  # scores beyond a long are given as its least or greatest value
EXACT = 2.0**53  # sums of doubles are exact below

Found = list[tuple[int, int, int]]


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x) as a whole number of any size."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(scale * x)


def best_of_doubles(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray) -> Found:
    """(query, candidate, score) of each query's k best other candidates that reach its floor, ties to smaller ids. q is (queries, dims), c (dims, candidates), of whole
    numbers so small that sums are exact."""
    dims = c.shape[0]
    steps = [(d, min(d + DIMENSIONS, dims)) for d in range(0, dims, DIMENSIONS)] or [(0, 0)]
    out = []
    rest_q = [np.sqrt((q[:, e:] ** 2).sum(axis=1)) for _, e in steps]
    tiles = [(slice(a, a + TILE), [np.sqrt((c[e:, a : a + TILE] ** 2).sum(axis=0)) for _, e in steps]) for a in range(0, c.shape[1], TILE)]
    for i, query in enumerate(q):
        scores, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        for part, rest_c in tiles:
            block, own = c[:, part], c_ids[part]
            alive = np.flatnonzero(own != q_ids[i])
            partial = np.zeros(len(alive))
            floor = max(floors[i], np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf)
            for (d, e), rq, rc in zip(steps, rest_q, rest_c, strict=True):
                partial = partial + query[d:e] @ (block[d:e] if len(alive) == block.shape[1] else block[d:e, alive])
                if e == dims or not len(alive):
                    break
                mass = rq[i] * rc[alive]
                if len(alive) >= k:
                    floor = max(floor, np.partition(partial - mass, -k)[-k])
                if floor > -np.inf:
                    keep = partial + mass >= floor - 1e-6 * (1 + abs(floor))
                    alive, partial = alive[keep], partial[keep]
            scores, ids = np.concatenate((scores, partial)), np.concatenate((ids, own[alive]))
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
        out += [(int(q_ids[i]), int(x), int(s)) for x, s in zip(ids, scores, strict=True) if s >= floors[i]]
    return out


def best_of_integers(q_ids: np.ndarray, q: list[list[int]], c_ids: np.ndarray, c: list[list[int]], k: int) -> Found:
    """The same for rows of whole numbers of any size, without bounds. Scores beyond a long are cut to it, and tie."""
    out = []
    for i, query in zip(q_ids.tolist(), q, strict=True):
        dot = lambda row: max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(query, row, strict=True))))  # noqa: B023, E731
        scored = sorted((-dot(row), j) for j, row in zip(c_ids.tolist(), c, strict=True) if j != i)
        out += [(i, j, -s) for s, j in scored[:k]]
    return out


def best_in_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, scale: int = 1, floors: np.ndarray | None = None) -> Found:
    """k rows at most for each query and part of the candidates. q and c have a row for each vector, of unscaled components.

    Rows with so great a component that sums of doubles might not be exact are met with whole numbers, all others with doubles.
    """
    floors = np.full(len(q), -np.inf) if floors is None else floors
    limit = math.sqrt(EXACT / max(1, q.shape[1])) / scale - 1
    small_q, small_c = (np.abs(x).max(axis=1, initial=0) < limit for x in (q, c))
    scaled = lambda x: np.floor(x * scale)
    found = best_of_doubles(q_ids[small_q], scaled(q[small_q]), c_ids[small_c], np.ascontiguousarray(scaled(c[small_c]).T), k, floors[small_q])
    whole = lambda x: [[whole_number(v, scale) for v in row] for row in x.tolist()]
    if not small_c.all():
        found += best_of_integers(q_ids[small_q], whole(q[small_q]), c_ids[~small_c], whole(c[~small_c]), k)
    if not small_q.all():
        found += best_of_integers(q_ids[~small_q], whole(q[~small_q]), c_ids, whole(c), k)
    return found


def stacked(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float).reshape(len(vectors), dims)


def top_vectors(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) vectors for each query, a row whose vec_id `every` divides.

    Candidates are all rows with another vec_id; ties go to smaller vec_ids, a query with fewer candidates has fewer rows. Vectors that are null or hold
    null or non-finite components, and rows without vec_id, take no part; vectors are compared with those of equal length only. Repeated rows are candidates of
    their own and queries once. Further columns are dropped. Candidates move once; a query is sent to every cell of its length, where a task holds one cell's
    candidates and a batch of queries, and k rows of each meeting move on.
    """
    spark = vectors.sparkSession
    unfit = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fit = fit.where(~F.exists("v", unfit)).withColumn("dims", F.size("v"))
    total, rows = fit.agg(F.coalesce(F.sum("dims"), F.lit(0)), F.count("*")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, -(-total // cell), min(tasks, -(-total // min(cell, SMALL_CELL))))
    few = fit.where((F.col("dims") <= PIVOT_DIMENSIONS) & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, rows // PIVOTS))) == 0)).limit(PIVOTS).collect()
    by_length: dict[int, list] = {}
    for r in few:
        by_length.setdefault(r["dims"], []).append(r)
    pivots = spark.sparkContext.broadcast({d: (np.array([r["vec_id"] for r in rs]), np.array([r["v"] for r in rs], dtype=float).reshape(len(rs), d)) for d, rs in by_length.items()})

    @F.pandas_udf("double")
    def first_floor(ids: pd.Series, given: pd.Series, dims: pd.Series) -> pd.Series:
        out = pd.Series(-np.inf, index=ids.index)
        for d in dims.unique():
            if d in pivots.value:
                at = dims.index[dims == d]
                found: dict[int, list[int]] = {}
                for i, (query, v) in enumerate(zip(ids[at], given[at], strict=True)):
                    scores = best_in_cell(np.array([query]), stacked(pd.Series([v]), d), *pivots.value[d], k, scale)
                    found[i] = sorted((s for _, _, s in scores), reverse=True)
                out[at] = [float(found[i][k - 1]) if len(found[i]) >= k and abs(found[i][k - 1]) < EXACT else -np.inf for i in range(len(at))]
        return out

    queries = fit.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("floor", first_floor("vec_id", "v", "dims"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c"), F.lit(1).alias("asks"), "dims", "vec_id", "v", "floor")
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(1), F.monotonically_increasing_id()), F.lit(cells)).cast("int")
    candidates = fit.select(dealt.alias("c"), F.lit(0).alias("asks"), "dims", "vec_id", "v", F.lit(None).cast("double").alias("floor"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, vectors_of = None, [], []
        for batch in batches:
            for (c, dims, asks), part in batch.groupby(["c", "dims", "asks"], sort=True):
                if held != (c, dims):
                    held, ids, vectors_of = (c, dims), [], []
                own = part["vec_id"].to_numpy(dtype=np.int64), stacked(part["v"], dims)
                if not asks:
                    ids.append(own[0])
                    vectors_of.append(own[1])
                elif ids:
                    if len(ids) > 1:
                        ids, vectors_of = [np.concatenate(ids)], [np.concatenate(vectors_of)]
                    found = best_in_cell(*own, ids[0], vectors_of[0], k, scale, part["floor"].to_numpy(dtype=float))
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    laid = candidates.unionByName(queries).repartitionById(min(cells, tasks), F.pmod("c", F.lit(min(cells, tasks)))).sortWithinPartitions("c", "dims", "asks")
    found = laid.mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB's SQL, with the defaults above.
TOP_SQL = """
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM fit q JOIN fit c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
