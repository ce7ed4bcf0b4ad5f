"""State sequences: runs, durations, transitions, entropies, long-range dependence, Markov statistics.

A sequence table has subject, t (0, 1, ..., without gaps) and state; one sequence a subject. Every operator is windows and
grouped sums within a subject. Results are undefined (null) rather than NaN where the data don't determine them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("subject").orderBy("t")


def sequence(df: DataFrame, subject: Column | str, state: Column | str, *order: Column | str) -> DataFrame:
    """Numbers the rows of each subject by the given order."""
    columns = df.select((F.col(subject) if isinstance(subject, str) else subject).alias("subject"), (F.col(state) if isinstance(state, str) else state).alias("state"), *order)
    names = [o for o in order if isinstance(o, str)]
    return columns.withColumn("t", (F.row_number().over(Window.partitionBy("subject").orderBy(*names)) - 1).cast("long")).select("subject", "t", "state")


def all_states(seq: DataFrame) -> DataFrame:
    """Every subject with every state that the table knows: the base of results with zeros. Both sides are dimensions, broadcast when small."""
    return seq.select("subject").distinct().join(seq.select("state").where("state is not null").distinct(), how="cross")


def runs(seq: DataFrame) -> DataFrame:
    """Maximal runs of equal states: subject, run (from 1), state, start, length, first, last (whether it begins or ends the sequence)."""
    changed = (~F.lag("state").over(by_time()).eqNullSafe(F.col("state")) | (F.col("t") == 0)).cast("int")
    marked = seq.withColumn("run", F.sum(changed).over(by_time()))
    grouped = marked.groupBy("subject", "run").agg(F.first("state").alias("state"), F.min("t").alias("start"), F.count("*").alias("length"))
    whole = Window.partitionBy("subject")
    return grouped.withColumn("first", F.col("run") == 1).withColumn("last", F.col("run") == F.max("run").over(whole))


def coverage(seq: DataFrame) -> DataFrame:
    """Share of each state in all samples of the subject, unlabelled (null) ones included."""
    n = seq.groupBy("subject").agg(F.count("*").alias("n"))
    found = seq.groupBy("subject", "state").agg(F.count("*").alias("k"))
    return all_states(seq).join(found, ["subject", "state"], "left").join(n, "subject").select("subject", "state", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("coverage"))


def occurrence(seq: DataFrame, window: int) -> DataFrame:
    """Mean number of a state's samples in chunks of `window` samples, the last one maybe shorter."""
    chunks = seq.groupBy("subject").agg((F.floor(F.max("t") / window) + 1).alias("chunks"))
    found = seq.groupBy("subject", "state").agg(F.count("*").alias("k"))
    return all_states(seq).join(found, ["subject", "state"], "left").join(chunks, "subject").select("subject", "state", (F.coalesce("k", F.lit(0)) / F.col("chunks")).alias("occurrence"))


def segments(seq: DataFrame) -> DataFrame:
    """Number of runs of each state."""
    return runs(seq).groupBy("subject", "state").agg(F.count("*").alias("segments"))


def duration_trimmed(seq: DataFrame) -> DataFrame:
    """Mean run in samples without the sequence's last run; the first run's state loses its first one, or else the last run's state its last stored one. 0 without runs."""
    stored = runs(seq)
    whole = Window.partitionBy("subject")
    at_end = lambda end: F.max(F.when(F.col(end), F.col("state"))).over(whole)
    stored = stored.withColumn("first_state", at_end("first")).withColumn("last_state", at_end("last")).where("not last")
    by_state = Window.partitionBy("subject", "state")
    stored = stored.withColumn("i", F.row_number().over(by_state.orderBy("run"))).withColumn("n", F.count("*").over(by_state))
    lost = F.when(F.col("state") == F.col("first_state"), F.col("i") == 1).when(F.col("state") == F.col("last_state"), F.col("i") == F.col("n")).otherwise(False)
    kept = stored.where(~lost).groupBy("subject", "state").agg(F.avg("length").alias("d"))
    return all_states(seq).join(kept, ["subject", "state"], "left").select("subject", "state", F.coalesce("d", F.lit(0.0)).alias("duration"))


def duration_label(seq: DataFrame, sfreq: float | None = None) -> DataFrame:
    """Mean, sample deviation (0 for one run), median and number of runs without the sequence's first one; null and 0 where a state has none."""
    unit = F.col("length") / sfreq if sfreq else F.col("length").cast("double")
    kept = runs(seq).where("not first").groupBy("subject", "state").agg(F.avg(unit).alias("mean"), F.stddev_samp(unit).alias("sd"), F.percentile(unit, 0.5).alias("median"), F.count("*").alias("n"))
    return all_states(seq).join(kept, ["subject", "state"], "left").select(
        "subject", "state", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")).alias("std"), "median", F.coalesce("n", F.lit(0)).alias("segments")
    )


def profile(seq: DataFrame) -> DataFrame:
    """What the metrics of a sequence are made of, in one row a subject: n, last_t, runs, first_state, last_state and states, an array of one struct a state that the subject has.

    A state has k (samples), segments, length and m (of its runs but the sequence's first), stored and stored_n (of those but the last), the first and last stored run's length, and
    nexts (next state, n). One exchange by subject and one order by time serve all; runs, then states, then subjects are grouped where they are. Null states are runs of their own.
    """
    changed = (~F.lag("state").over(by_time()).eqNullSafe(F.col("state")) | F.lag("t").over(by_time()).isNull()).cast("int")
    marked = seq.withColumn("run", F.sum(changed).over(by_time()))
    found = marked.groupBy("subject", "run").agg(F.first("state").alias("state"), F.max("t").alias("end"), F.count("*").alias("length"))
    in_order = Window.partitionBy("subject").orderBy("run")
    found = found.withColumn("next", F.lead("state").over(in_order)).withColumn("last", F.lead("run").over(in_order).isNull())
    length, later, stored = F.col("length"), F.col("run") > 1, ~F.col("last")
    sums = [
        F.sum("length").alias("k"),
        F.count("*").alias("segments"),
        F.coalesce(F.sum(F.when(later, length)), F.lit(0)).alias("length"),
        F.count_if(later).alias("m"),
        F.coalesce(F.sum(F.when(stored, length)), F.lit(0)).alias("stored"),
        F.count_if(stored).alias("stored_n"),
        F.min(F.when(stored, F.struct("run", "length"))).alias("first_stored"),
        F.max(F.when(stored, F.struct("run", "length"))).alias("last_stored"),
        F.min("run").alias("run"),
        F.max("end").alias("end"),
    ]
    pairs = found.groupBy("subject", "state", "next", "last").agg(*sums)
    add = lambda c: F.sum(c).alias(c)
    nexts = F.collect_list(F.when(~F.col("last"), F.struct(F.col("next").alias("state"), F.col("segments").alias("n")))).alias("nexts")
    by_state = pairs.groupBy("subject", "state").agg(
        add("k"), add("segments"), add("length"), add("m"), add("stored"), add("stored_n"), F.min("first_stored").alias("first_stored"), F.max("last_stored").alias("last_stored"), F.min("run").alias("run"), F.max("end").alias("end"), F.bool_or("last").alias("last"), nexts
    )
    one = F.struct("state", "k", "segments", "length", "m", "stored", "stored_n", F.col("first_stored.length").alias("first_stored"), F.col("last_stored.length").alias("last_stored"), "nexts")
    return by_state.groupBy("subject").agg(
        F.sum("k").alias("n"), F.max("end").alias("last_t"), F.sum("segments").alias("runs"), F.min_by("state", "run").alias("first_state"), F.max(F.when(F.col("last"), F.col("state"))).alias("last_state"), F.collect_list(one).alias("states")
    )


def in_windows(seq: DataFrame, window: int) -> DataFrame:
    """Whole windows as subjects of their own: subject becomes a struct of subject and w."""
    whole = seq.withColumn("n", F.count("*").over(Window.partitionBy("subject"))).withColumn("w", F.floor(F.col("t") / window)).where(F.col("w") < F.floor(F.col("n") / window))
    return whole.select(F.struct("subject", "w").alias("subject"), (F.col("t") % window).alias("t"), "state")


def duration_sequence(seq: DataFrame, window: int | None = None) -> DataFrame:
    """Mean run without the sequence's last one, 1 for states without; with a window, of whole windows, averaged."""
    base = in_windows(seq, window) if window else seq
    kept = runs(base).where("not last").groupBy("subject", "state").agg(F.avg("length").alias("d"))
    states = seq.select("state").where("state is not null").distinct()
    each = base.select("subject").distinct().join(states, how="cross").join(kept, ["subject", "state"], "left").withColumn("d", F.coalesce("d", F.lit(1.0)))
    if window:
        return each.groupBy(F.col("subject.subject").alias("subject"), "state").agg(F.avg("d").alias("duration"))
    return each.select("subject", "state", F.col("d").alias("duration"))


def frequency(seq: DataFrame, window: int) -> DataFrame:
    """Completed runs of a state a whole window, averaged over the windows in which it completes one."""
    done = runs(in_windows(seq, window)).where("not last").groupBy("subject", "state").agg(F.count("*").alias("k"))
    return done.groupBy(F.col("subject.subject").alias("subject"), "state").agg(F.avg("k").alias("frequency"))


def grams(seq: DataFrame, k: int) -> DataFrame:
    """subject, t and s0 .. s(k-1): the k states from each sample on, where there are as many."""
    out = seq
    for i in range(k):
        out = out.withColumn(f"s{i}", F.lead("state", i).over(by_time()))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("subject"))).where(F.col("t") + k <= F.col("_n")).drop("_n", "state")


def transition_matrix(seq: DataFrame, order: int = 1) -> DataFrame:
    """Counts of (order + 1)-tuples, their joint share and the conditional probability of the last state."""
    names = [f"s{i}" for i in range(order + 1)]
    counted = grams(seq, order + 1).groupBy("subject", *names).agg(F.count("*").alias("n"))
    past = Window.partitionBy("subject", *names[:-1])
    return counted.withColumn("joint", F.col("n") / F.sum("n").over(Window.partitionBy("subject"))).withColumn("p", F.col("n") / F.sum("n").over(past))


def transition_frequency(seq: DataFrame, sfreq: float | None = None) -> DataFrame:
    """Changes of state a second, or without a rate a step; 0 for sequences of one sample."""
    moved = seq.withColumn("moved", (~F.lag("state").over(by_time()).eqNullSafe(F.col("state")) & (F.col("t") > 0)).cast("int"))
    n = F.count("*")
    base = n / sfreq if sfreq else n - 1
    return moved.groupBy("subject").agg(F.when(n <= 1, 0.0).otherwise(F.try_divide(F.sum("moved"), base)).alias("transition_frequency"))


def entropy(counted: DataFrame, keys: Sequence[str], n: str = "n", base: float = 2.0) -> DataFrame:
    """Shannon entropy over the counts of each key: log n - sum(n log n) / n, one pass."""
    log = lambda x: F.ln(x) / F.lit(math.log(base))
    total = F.sum(n)
    return counted.groupBy(*keys).agg((log(total) - F.sum(F.col(n) * log(F.col(n))) / total).alias("entropy"))


def shannon_entropy(seq: DataFrame) -> DataFrame:
    return entropy(seq.groupBy("subject", "state").agg(F.count("*").alias("n")), ["subject"])


def lagged_pairs(seq: DataFrame, lags: int) -> DataFrame:
    """subject, lag, x, y for lags 0 to lags - 1: shifted within one sort of the subject."""
    later = F.array(*[F.struct(F.lit(i).alias("lag"), F.lead("state", i).over(by_time()).alias("y"), (F.lead("t", i).over(by_time()).isNotNull()).alias("there")) for i in range(lags)])
    shifted = seq.withColumn("later", later)
    return shifted.select("subject", F.col("state").alias("x"), F.explode("later").alias("p")).where("p.there").select("subject", "x", "p.lag", "p.y")


def joint_entropy(seq: DataFrame, lag: int) -> DataFrame:
    """Entropy of (state, state `lag` samples later)."""
    pairs = lagged_pairs(seq, lag + 1).where(F.col("lag") == lag)
    return entropy(pairs.groupBy("subject", "x", "y").agg(F.count("*").alias("n")), ["subject"])


def mutual_information(seq: DataFrame, lags: int) -> DataFrame:
    """Of the sequence and itself some samples later, in bits, for lags 0 to lags - 1."""
    counted = lagged_pairs(seq, lags).groupBy("subject", "lag", "x", "y").agg(F.count("*").alias("n"))
    keys = ["subject", "lag"]
    x = entropy(counted.groupBy(*keys, "x").agg(F.sum("n").alias("n")), keys).withColumnRenamed("entropy", "hx")
    y = entropy(counted.groupBy(*keys, "y").agg(F.sum("n").alias("n")), keys).withColumnRenamed("entropy", "hy")
    both = entropy(counted, keys).withColumnRenamed("entropy", "hxy")
    return x.join(y, keys).join(both, keys).select(*keys, (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mutual_information"))


def block_entropy(seq: DataFrame, k: int) -> DataFrame:
    """Entropy of k states in a row, over the blocks that begin in the first n - k samples."""
    names = [f"s{i}" for i in range(k)]
    whole = Window.partitionBy("subject")
    kept = grams(seq, k).withColumn("_m", F.max("t").over(whole)).where(F.col("t") < F.col("_m"))
    return entropy(kept.groupBy("subject", *names).agg(F.count("*").alias("n")), ["subject"])


def block_entropies(seq: DataFrame, most: int) -> DataFrame:
    """subject, entropy, k: block_entropy() for 1 to `most` states, from one order by time. States are numbered, so that a block is a short array of numbers."""
    known = seq.where("state is not null").select("state").distinct().agg(F.array_sort(F.collect_list("state")).alias("_all"))  # one row: the few states travel as an array
    number = F.coalesce(F.array_position("_all", F.col("state")), F.lit(0)).cast("int")  # null is a state too
    rows = seq.join(F.broadcast(known), how="cross").select("subject", "t", number.alias("state"))
    ahead = rows.select("subject", *[F.lead("state", i).over(by_time()).alias(f"s{i}") for i in range(most + 1)])
    blocks = [F.when(F.col(f"s{k}").isNotNull(), F.array(*[F.col(f"s{i}") for i in range(k)])) for k in range(1, most + 1)]  # the sequence goes on, so the block begins in the first n - k
    counted = ahead.select("subject", F.explode(F.array_compact(F.array(*blocks))).alias("block")).groupBy("subject", "block").agg(F.count("*").alias("n"))
    return entropy(counted.withColumn("k", F.size("block")), ["subject", "k"]).select("subject", "entropy", "k")


def excess_entropy(seq: DataFrame, most: int) -> DataFrame:
    """Line through the block entropies of 1 to `most` states: its slope is the entropy rate, its intercept the excess entropy."""
    return block_entropies(seq, most).groupBy("subject").agg(F.regr_slope("entropy", "k").alias("entropy_rate"), F.regr_intercept("entropy", "k").alias("excess_entropy"))


def partial_mutual_information(seq: DataFrame, lags: int) -> DataFrame:
    """Lags 0 and 1 as mutual information; from 2 on 2 H(k) - H(k - 1) - H(k + 1) of the block entropies, each lag with its own k."""
    early = mutual_information(seq, 2).select("subject", "lag", F.col("mutual_information").alias("partial"))
    h = block_entropies(seq, lags)
    a, b, c = (h.select("subject", (F.col("k") + d).alias("lag"), F.col("entropy").alias(name)) for d, name in ((0, "h1"), (1, "h2"), (-1, "h3")))
    late = a.join(b, ["subject", "lag"]).join(c, ["subject", "lag"]).where(F.col("lag").between(2, lags - 1)).select("subject", "lag", (2 * F.col("h1") - F.col("h2") - F.col("h3")).alias("partial"))
    return early.unionByName(late)


def entropy_rate(seq: DataFrame) -> DataFrame:
    """-sum of coverage times p log p over the order-1 transitions, in nats."""
    p = transition_matrix(seq).select("subject", F.col("s0").alias("state"), "p")
    rows = p.join(coverage(seq), ["subject", "state"])
    return rows.groupBy("subject").agg((-F.sum(F.col("coverage") * F.col("p") * F.ln("p"))).alias("entropy_rate"))


def indicators(seq: DataFrame) -> DataFrame:
    """One 0/1 series for each subject and state: subject, state, t, x."""
    states = seq.where("state is not null").agg(F.array_sort(F.collect_set("state")).alias("_states"))  # one row: the few states travel as an array
    each = seq.join(F.broadcast(states), how="cross").select("subject", "t", F.col("state").alias("_own"), F.explode("_states").alias("state"))
    return each.select("subject", "state", "t", F.coalesce((F.col("_own") == F.col("state")).cast("double"), F.lit(0.0)).alias("x"))


def _rescaled(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, float, int]]:
    """Of each size, the sum of range over deviation of its whole blocks, and their number; blocks of constant numbers have none."""
    for size in sizes:
        blocks = codes[: len(codes) // size * size].reshape(-1, size)
        deviation = blocks.std(axis=1, ddof=1)
        blocks, deviation = blocks[deviation > 0], deviation[deviation > 0]
        if len(blocks):
            walk = np.cumsum(blocks - blocks.mean(axis=1, keepdims=True), axis=1)
            yield size, float(((walk.max(axis=1) - walk.min(axis=1)) / deviation).sum()), len(blocks)


def _fitted(sums: DataFrame, lengths: DataFrame, keys: Sequence[str], by: Sequence[str], least: int, most: int) -> DataFrame:
    """keys and hurst from sums(keys, size, rs, blocks) of the largest blocks, and lengths(by, n)."""
    fits = (F.col("n") >= 4 * least) & (F.col("size") <= F.greatest(F.least(F.floor(F.col("n") / 4), F.lit(most)), F.lit(least))) & (F.floor(F.col("n") / F.col("size")) >= 4)
    means = sums.groupBy(*keys, "size").agg((F.sum("rs") / F.sum("blocks")).alias("rs")).join(lengths, list(by)).where(fits)
    return means.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.regr_slope(F.ln("rs"), F.ln("size"))).alias("hurst"))


def _kind(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in columns)


def _largest_blocks(rows: DataFrame, keys: Sequence[str], value: str, least: int, most: int) -> tuple[DataFrame, list[int]]:
    """keys and xs: the values of each stretch of the largest size by t, which holds whole blocks of all smaller ones; and the sizes."""
    sizes = [least << i for i in range(20) if least << i <= most]
    packed = rows.groupBy(*keys, F.floor(F.col("t") / sizes[-1]).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("x")))).alias("xs"))
    return packed.select(*keys, F.transform("xs", lambda s: s["x"]).alias("xs")), sizes


def hurst_rs(series: DataFrame, keys: Sequence[str], least: int = 16, most: int = 1024) -> DataFrame:
    """Hurst exponent by rescaled range: series(keys, t, x). Chunks of 16 * 2^i samples up to min(n / 4, 1024), four at least; null below 64 samples or with one size only.

    t counts from 0 without gaps. Samples are gathered once, in stretches of the largest chunk, and all sizes' sums come from these.
    """
    packed, sizes = _largest_blocks(series, keys, "x", least, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, *found) for *key, xs in batch[[*keys, "xs"]].itertuples(index=False) for found in _rescaled(np.asarray(xs, dtype=float), sizes)]
            yield pd.DataFrame(rows, columns=[*keys, "size", "rs", "blocks"])

    sums = packed.mapInPandas(run, f"{_kind(series, keys)}, size int, rs double, blocks long")
    lengths = series.groupBy(*keys).agg(F.count("*").alias("n"))
    return lengths.select(*keys).join(_fitted(sums, lengths, keys, keys, least, most), list(keys), "left")


def hurst_states(seq: DataFrame, least: int = 16, most: int = 1024) -> DataFrame:
    """Hurst exponent of each state's 0/1 series, for the states that the table has. A stretch of the sequence gives the sums of all its states, so rows aren't copied by state."""
    packed, sizes = _largest_blocks(seq, ["subject"], "state", least, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for subject, xs in zip(batch["subject"], batch["xs"], strict=True):
                xs = np.array(list(xs), dtype=object)
                for state in {x for x in xs if x is not None}:
                    rows += [(subject, state, *found) for found in _rescaled((xs == state).astype(float), sizes)]
            yield pd.DataFrame(rows, columns=["subject", "state", "size", "rs", "blocks"])

    sums = packed.mapInPandas(run, f"{_kind(seq, ['subject', 'state'])}, size int, rs double, blocks long")
    lengths = seq.groupBy("subject").agg(F.count("*").alias("n"))
    states = seq.where("state is not null").select("state").distinct().agg(F.collect_list("state").alias("_states"))  # one row: the few states travel as an array
    each = lengths.select("subject").join(F.broadcast(states), how="cross").select("subject", F.explode("_states").alias("state"))
    return each.join(_fitted(sums, lengths, ["subject", "state"], ["subject"], least, most), ["subject", "state"], "left")


def random_walk(seq: DataFrame, up: Sequence[object]) -> DataFrame:
    """subject, t, x: 1 where the state is among `up`, else -1."""
    return seq.select("subject", "t", F.when(F.col("state").isin(*up), 1.0).otherwise(-1.0).alias("x"))


def _joined_walks(parts: Column) -> Column:
    """Sums of a walk over consecutive parts from the parts' own: n samples, s their sum, and over the walk y (the cumulated samples) and the places t the sums of y, y * y and t * y."""
    none = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("s", "y", "yy", "ty")])

    def put(a: Column, b: Column) -> Column:
        places = b["n"] * (b["n"] - 1) / 2
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            (a["s"] + b["s"]).alias("s"),
            (a["y"] + b["y"] + b["n"] * a["s"]).alias("y"),
            (a["yy"] + b["yy"] + 2 * a["s"] * b["y"] + b["n"] * a["s"] * a["s"]).alias("yy"),
            (a["ty"] + b["ty"] + a["s"] * places + a["n"] * b["y"] + a["n"] * a["s"] * b["n"]).alias("ty"),
        )

    return F.aggregate(parts, none, put)


def dfa(series: DataFrame, keys: Sequence[str], scales: Sequence[int]) -> DataFrame:
    """Detrended fluctuation: slope of log2 F(scale) over log2 scale. F is the root mean square of what is left of the cumulated, centred series(keys, t, x) after a line in each whole window.

    A line takes up where a window's walk begins, so each window's walk is its own; sums of windows of one scale are joined to those of the next scale that it divides, and samples are
    gathered once for such a chain of scales. t counts from 0 without gaps.
    """
    means = series.groupBy(*keys).agg(F.avg("x").alias("_m"))
    x = F.col("x") - F.col("_m")
    samples = series.join(means, list(keys)).select(*keys, F.col("t").alias("w"), F.struct(F.lit(1).cast("long").alias("n"), x.alias("s"), x.alias("y"), (x * x).alias("yy"), F.lit(0.0).alias("ty")).alias("p"))
    levels: dict[int, DataFrame] = {1: samples}
    for scale in sorted(set(scales) - {1}):
        below = max(s for s in levels if scale % s == 0)
        parts = levels[below].groupBy(*keys, F.floor(F.col("w") / (scale // below)).alias("w")).agg(F.array_sort(F.collect_list(F.struct(F.col("w").alias("i"), "p"))).alias("parts"))
        levels[scale] = parts.select(*keys, "w", _joined_walks(F.transform("parts", lambda s: s["p"])).alias("p")).where(F.col("p.n") == scale)
    flats = None
    for scale in sorted(set(scales)):
        n, middle = float(scale), (scale - 1) / 2
        yy, ty = F.col("p.yy") - F.col("p.y") * F.col("p.y") / n, F.col("p.ty") - middle * F.col("p.y")
        left = yy - ty * ty / (n * (n * n - 1) / 12) if scale > 1 else F.lit(0.0)
        flat = levels[scale].groupBy(*keys).agg(F.lit(scale).alias("scale"), F.sqrt(F.avg(F.greatest(left, F.lit(0.0)) / n)).alias("f"))
        flats = flat if flats is None else flats.unionByName(flat)
    return flats.where("f > 0").groupBy(*keys).agg(F.regr_slope(F.log2("f"), F.log2("scale")).alias("dfa"))


def markov_g(seq: DataFrame, order: int) -> DataFrame:
    """G statistic and degrees of freedom of the test that states depend on the `order` states before only."""
    names = [f"s{i}" for i in range(order + 2)]
    counted = grams(seq, order + 2).groupBy("subject", *names).agg(F.count("*").cast("double").alias("n"))
    over = lambda cols: F.sum("n").over(Window.partitionBy("subject", *cols))
    n, left, right, inner = F.col("n"), over(names[:-1]), over(names[1:]), over(names[1:-1])
    terms = counted.withColumn("g", n * F.ln(n * inner / (left * right)))
    k = seq.select("state").distinct().count()
    df = k ** (2 + order) - 2 * k ** (1 + order) + k**order
    return terms.groupBy("subject").agg((2 * F.sum("g")).alias("g")).withColumn("df", F.lit(df))


def homogeneity_g(seq: DataFrame, block: int) -> DataFrame:
    """G statistic of the test that order-1 transitions are alike in whole blocks of the sequence; pairs don't cross blocks."""
    whole = Window.partitionBy("subject")
    blocked = seq.withColumn("len", F.count("*").over(whole)).withColumn("b", F.floor(F.col("t") / block)).where(F.col("b") < F.floor(F.col("len") / block))
    inside = Window.partitionBy("subject", "b").orderBy("t")
    pairs = blocked.withColumn("next", F.lead("state").over(inside)).withColumn("there", F.lead("t").over(inside).isNotNull()).where("there")
    counted = pairs.groupBy("subject", "b", "state", "next").agg(F.count("*").cast("double").alias("n"))
    over = lambda *cols: F.sum("n").over(Window.partitionBy("subject", *cols))
    n = F.col("n")
    terms = counted.withColumn("g", n * F.ln(n * over("state") / (over("b", "state") * over("state", "next"))))
    blocks = seq.groupBy("subject").agg(F.floor(F.count("*") / block).alias("blocks"))
    k = seq.select("state").distinct().count()
    return terms.groupBy("subject").agg((2 * F.sum("g")).alias("g")).join(blocks, "subject").select("subject", "g", ((F.col("blocks") - 1) * (k - 1) * k).alias("df"))
