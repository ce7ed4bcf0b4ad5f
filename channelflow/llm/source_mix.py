"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

A block is one document. Every source gets an exact quota in words; its documents stand in a keyed
permutation, and its draws are the documents in that order, pass after pass, until the quota is met
(the last one is cut to the words that are left). How many draws of each source an output shard gets is
decided by a tree: the shards of a node are halved, and the node's draws go left or right as one
multivariate-hypergeometric sample. Shards then take disjoint runs of each source's permuted draws.

Ranks and running sums within a source come in two levels (a histogram over hash bins, then a window within a
bin), so a source with a third of all rows is spread over many groups of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal, localcontext
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

WEIGHTS = (3, 1, 2)  # by the sources' order, repeating
SHARE = 1.5  # the mix's words, as a share of all words
MOST = 2  # times its own words that a source, and so a document, can give
ROWS_A_BIN = 10_000  # of all sources' rows, about: bins of the permutation grow with the table
LEAST_BINS = 256
SHARDS = 16
FEW_SOURCES = 10_000  # up to so many, the table of sources is broadcast
PI = Decimal("3.14159265358979323846264338327950288419716939937510")
NO_DRAWS = "cast(array() as array<struct<shard: int, slot: bigint, words: bigint>>)"


def size_in_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: share of the total by weight, none above `most` times its size, the excess reshared.

    Sources are met in the order in which their caps bind; the first one whose cap is not reached ends it.
    """
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = share * sum(sizes), float(sum(weights))
    out = [float(most * s) for s in sizes]
    for k, i in enumerate(order):
        per_weight = left / weight
        if per_weight <= most * sizes[i] / weights[i]:
            for j in order[k:]:
                out[j] = weights[j] * per_weight
            break
        left -= most * sizes[i]
        weight -= weights[i]
    return out


def log_factorial(n: int) -> Decimal:
    """ln n! to about 30 digits, by Stirling's series."""
    if n < 64:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return x * x.ln() - x + (2 * PI * x).ln() / 2 + series


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad blocks are good.

    NumPy samples populations below a billion. The law is the same beyond: it is log-concave, so draws under a flat middle with exponential tails
    around its mode are accepted by the exact ratio of probabilities (Devroye, 1987).
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    with localcontext() as context:
        context.prec = 50
        least, most = max(0, n - bad), min(n, good)
        mode = min(most, max(least, (n + 1) * (good + 1) // (good + bad + 2)))
        weight = lambda k: -(log_factorial(k) + log_factorial(good - k) + log_factorial(n - k) + log_factorial(bad - n + k))
        at_mode = weight(mode)
        whole = log_factorial(good) + log_factorial(bad) + log_factorial(n) + log_factorial(good + bad - n) - log_factorial(good + bad)
        top = float((at_mode + whole).exp())
        w = 1 + top / 2
        while True:
            if rng.random() <= w / (1 + w):
                y = rng.random() * w / top
            else:
                y = (w + rng.exponential()) / top
            k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
            height = rng.random() * min(1.0, math.exp(w - top * y))
            if least <= k <= most and height <= float((weight(k) - at_mode).exp()):
                return k


def splitting_tree(draws: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard, how many draws of each source it gets; column sums are the draws, shard totals differ by one or two.

    A node's draws go left or right as one multivariate-hypergeometric sample, taken source by source from what is left.
    """
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(counts: list[int], first: int, last: int) -> list[list[int]]:
        if last - first == 1:
            return [counts]
        middle, total = (first + last) // 2, sum(counts)
        wanted, left = total * (middle - first) // (last - first), []
        for c in counts:
            total -= c
            left.append(hypergeometric(rng, c, total, wanted) if wanted else 0)
            wanted -= left[-1]
        return split(left, first, middle) + split([c - x for c, x in zip(counts, left, strict=True)], middle, last)

    return split([int(d) for d in draws], 0, shards)


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    shards: int = SHARDS,
    seed: int = 42,
    rows_a_bin: int = ROWS_A_BIN,
    sized: bool = False,
) -> DataFrame:
    """Adds size, source_size, target, rank and draws array<struct<shard int, slot long, words long>> to every row of docs.

    docs has doc_id, source and text, or instead of text the columns size and text_key (md5 of the text) if sized says so. Columns of docs with the added names are replaced, others kept. Sources
    are weighed in code point order, null last (null is a source of its own). A null or empty text has size 0: it is drawn with its source's passes and
    gives no words. Repeated rows are blocks of their own. The key that permutes a source is a hash of doc_id and
    text, so rows without id, or with one id, spread as others do; rows equal in both are interchangeable. An empty table gives an empty result.

    rank is the row's place in its source's permutation. A source's draws are numbered slots: all ranks, pass after pass. The splitting tree gives each shard
    a run of every source's slots, and a row's draws are its slots in the shards' runs: what no shard draws isn't taken.
    One row a source reaches the driver. Words are counted in one pass for the totals and in one for the rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "rank", "draws")
    docs = docs if sized else docs.drop("size")
    columns = docs.columns
    bins = max(LEAST_BINS, -(-docs.count() // rows_a_bin))
    text_key = F.col("text_key") if sized and "text_key" in columns else F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if "text" in columns else F.lit("")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_key).cast("binary"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "source", "doc_id", key.alias("key"))
    base = base.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / F.lit(1 << 32)))
    size = F.col("row")["size"].cast("long") if sized else size_in_words(F.coalesce(F.col("row")["text"], F.lit("")))

    by_bin = cut(base.select("source", "bin", size.alias("size")).groupBy("source", "bin").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("rows")))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = by_bin.select("source", "bin", "words", "rows", offset("words").alias("words_before"), offset("rows").alias("rows_before"))

    totals = [(r["source"], int(r["words"]), int(r["rows"])) for r in by_bin.groupBy("source").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows")).collect()]
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    aims = targets([w for _, w, _ in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    quotas = [min(most * w, int(aim + 0.5)) for (_, w, _), aim in zip(totals, aims, strict=True)]
    passes = [q // w if w else 0 for q, (_, w, _) in zip(quotas, totals, strict=True)]
    rests = [q - p * w for q, p, (_, w, _) in zip(quotas, passes, totals, strict=True)]
    small = F.broadcast if len(totals) <= FEW_SOURCES else lambda df: df

    # draws of the last, partial pass by source, a contiguous start of the permutation: whole bins, and rows of the one bin where it ends
    rest_of = small(spark.createDataFrame([(s, r) for (s, _, _), r in zip(totals, rests, strict=True)], "of string, rest long"))
    begun = offsets.join(rest_of, F.col("source").eqNullSafe(F.col("of"))).where("words_before < rest")
    whole = begun.where("words_before + words < rest").groupBy("of").agg(F.sum("rows").alias("n"))
    last_bin = begun.where("words_before + words >= rest").select("of", F.col("bin").alias("of_bin"), (F.col("rest") - F.col("words_before")).alias("rest"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at_end = base.join(small(last_bin), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("of_bin"))).select("source", "bin", "key", "doc_id", size.alias("size"), "rest", "of")
    at_end = at_end.withColumn("before", running).where("before < rest").groupBy("of").agg(F.count("*").alias("n"))
    partial = {r["of"]: int(r["n"]) for r in whole.unionByName(at_end).groupBy("of").agg(F.sum("n").alias("n")).collect()}

    draws = [p * n + partial.get(s, 0) for (s, _, n), p in zip(totals, passes, strict=True)]
    tree = splitting_tree(draws, shards, seed)
    tops = [list(accumulate(part[i] for part in tree)) for i in range(len(draws))]
    known = [(s, w, aim, p, rest, n, top) for (s, w, n), aim, p, rest, top in zip(totals, aims, passes, rests, tops, strict=True)]
    plan = small(spark.createDataFrame(known, "of string, source_size long, target double, passes long, rest long, n long, tops array<long>"))

    ranked = base.withColumn("size", size).withColumn("before", running).withColumn("rank", F.row_number().over(within) - 1)
    at = offsets.select(F.col("source").alias("at_source"), F.col("bin").alias("at_bin"), "words_before", "rows_before")
    ranked = ranked.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bin") == F.col("at_bin"))).join(plan, F.col("source").eqNullSafe(F.col("of")))
    ranked = ranked.withColumn("before", F.col("before") + F.col("words_before")).withColumn("rank", F.col("rank") + F.col("rows_before"))

    def drawn_by(shard: Column) -> Column:
        """The row's slots in the run of slots that the shard has of its source."""
        first = F.when(shard == 0, F.lit(0).cast("long")).otherwise(F.get("tops", shard - 1))
        passes_from = F.greatest(F.lit(0).cast("long"), F.ceil((first - F.col("rank")) / F.col("n")))
        passes_to = F.floor((F.get("tops", shard) - 1 - F.col("rank")) / F.col("n"))
        words = lambda p: F.when(p < F.col("passes"), F.col("size")).otherwise(F.least(F.col("size"), F.col("rest") - F.col("before")))
        draw = lambda p: F.struct(shard.cast("int").alias("shard"), (p * F.col("n") + F.col("rank")).alias("slot"), words(p).alias("words"))
        return F.when(passes_to >= passes_from, F.transform(F.sequence(passes_from, passes_to), draw)).otherwise(F.expr(NO_DRAWS))

    draws_of = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), drawn_by))
    placed = ranked.select("row", F.struct("size", "source_size", "target", F.col("rank").cast("long").alias("rank"), draws_of.alias("draws")).alias("added"))
    kept = [F.col("row")[c].alias(c) for c in columns if c != "size"]
    return placed.select(*kept, "added.*")


def draw_mix(planned: DataFrame, seed: int = 42, shards: int = SHARDS) -> DataFrame:
    """One row for each draw, in shards whose rows stand in a keyed shuffle; a cut draw keeps its text's first words.

    Adds shard, slot and words. Draws are exchanged by (shard, slot hash): a partition holds one shard's draws only, shard k has the partitions from k * pieces on,
    and pieces grows with spark.sql.shuffle.partitions. Within a partition rows stand by slot hash, so written files are the shards' pieces in order.
    shards is the number that the plan was made for. Without a column text (a plan of sizes) there is nothing to cut.
    """
    pieces = -(-int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    columns = [c for c in planned.columns if c not in ("draws", "shard", "slot", "words")]
    drawn = planned.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.explode("draws").alias("draw"))
    drawn = drawn.withColumn("mixed", F.xxhash64(F.col("row")["source"], F.col("draw.slot"), F.lit(seed)))
    piece = F.col("draw.shard") * pieces + F.pmod(F.shiftright("mixed", 32), F.lit(pieces)).cast("int")
    drawn = drawn.repartitionById(shards * pieces, piece).sortWithinPartitions("mixed")
    words = F.col("draw.words")
    first = F.slice(F.regexp_extract_all(F.col("row")["text"], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, words.cast("int")) if "text" in columns else None
    text = lambda: F.when(words < F.col("row")["size"], F.array_join(first, "")).otherwise(F.col("row")["text"])
    kept = [(text() if c == "text" else F.col("row")[c]).alias(c) for c in columns]
    return drawn.select(*kept, F.col("draw.shard").alias("shard"), F.col("draw.slot").alias("slot"), words.alias("words"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the document, repeats counted) for every row.

    Words are counted once, into a narrow table; the shards draw their blocks from it, and taken sums what they drew of each block.
    """
    sized = cut(docs.select("doc_id", "source", size_in_words(text_of()).alias("size"), F.md5(text_of().cast("binary")).alias("text_key")))
    planned = cut(plan_mix(sized, sized=True))
    drawn = draw_mix(planned).groupBy(F.col("source").alias("of"), F.col("rank").alias("at")).agg(F.sum("words").alias("words"))
    taken = planned.join(drawn, F.col("source").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("at")), "left")
    return taken.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


#: The same rows in DuckDB's SQL, with the defaults above.
TAKEN_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sized GROUP BY source),
capped AS (SELECT *, 2 * s / w::DOUBLE AS ratio, (sum(s) OVER ())::DOUBLE AS total, sum(w) OVER ()::DOUBLE AS weight FROM sources),
met AS (SELECT *, (1.5 * total - coalesce(sum(2 * s) OVER earlier, 0)::DOUBLE) / (weight - coalesce(sum(w) OVER earlier, 0)::DOUBLE) AS per
        FROM capped WINDOW earlier AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT per FROM met WHERE per <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
aims AS (SELECT source, s, CASE WHEN ratio >= (SELECT per FROM level) THEN w * (SELECT per FROM level) ELSE (2 * s)::DOUBLE END AS target FROM capped),
quotas AS (SELECT *, least(2 * s, floor(target + 0.5)::BIGINT) AS q FROM aims),
placed AS (SELECT d.doc_id, d.size, d.source, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized d)
SELECT p.doc_id, p.size, q.s AS source_size, q.target,
       CASE WHEN q.s = 0 THEN 0 ELSE (q.q // q.s) * p.size + greatest(0, least(p.size, q.q % q.s - p.before)) END::BIGINT AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
"""
