"""N-gram Jaccard join with set-relation skipping.

Equal sets are one class. Every class puts the start of its set, in one global order that has rare shingles first, into an index;
two sets that reach the threshold share a shingle there. Pairs are skipped by size, by position (the first shared
place must leave enough shingles after it) and by their starts as a whole, which must share more than a few lists. Answers are derived from those of a highly similar set:
every set is first compared with one hub, the set that it shares most lists with. Pairs that hubs have brought into one component aren't compared again. For two sets with the same
hub, their overlaps with it bound their own from both sides, and what each lacks of it and has beside it gives the exact overlap
without either set. Only pairs of different hubs are intersected anew. No pair that may link is left out, and no pair of one
component of a long list is spelled out; long lists with several components are met in parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release_memory, text_of
from .components import components

WORDS = 4
PERCENT = 85
COUNTERS = 22  # bits: the frequency sketch has a fixed size, 4 MiB on the driver and in each worker
SLICE = 1 << 16
SHORT = 8  # sets of a list whose pairs are all written out
LIST_PARTS = 0.25  # parts of a long list, times the root of its size: entries outside its main component are copied to each
FILTER = 26  # bits: so does the filter of documents whose sets are fetched, 8 MiB at most

_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text's words are one shingle; none without words."""
    split = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(split)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=np.uint64, count=n)
    size = min(words, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * _C + w[k : n - size + 1 + k]
    return np.unique(_mix(h))


def in_pieces(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Arrow batches in smaller pieces, to bound what a worker holds beside them."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def set_id(s: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), dtype=np.int64)[0])


def at_least(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that sets of n and m need."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def count_in_place(total: np.ndarray, found: np.ndarray) -> None:
    """Counts shingles in their counters: no second array of all counters stands beside the first."""
    np.add.at(total, (found >> np.uint64(64 - COUNTERS)).astype(np.int64), np.uint32(1))


def frequency_levels(docs: DataFrame, words: int) -> np.ndarray:
    """About log2 of each shingle's count over all documents, by hash: counted in all tasks, summed in slices, 2 ** COUNTERS bytes in all.

    It only fixes the global order, so collisions cost time, never results.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNTERS, dtype=np.uint32)
        for batch in batches:
            for texts in np.array_split(batch["text"].to_numpy(), max(1, len(batch) // 500)):
                found = [shingles(t, words) for t in texts]
                if found:
                    count_in_place(total, np.concatenate(found))
        if total.any():
            parts = total.reshape(-1, SLICE)
            yield pd.DataFrame({"slice": np.arange(len(parts)), "counts": [zlib.compress(np.minimum(p, 65535).astype(np.uint16).tobytes(), 1) for p in parts]})
            del parts
        del total
        release_memory()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.uint64)
        for c in group["counts"]:
            raw = zlib.decompress(c)
            total += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * SLICE else np.uint64)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = docs.select("text").mapInPandas(count, "slice int, counts binary").withColumn("group", (F.spark_partition_id() / 64).cast("int"))
    some = parts.groupBy("slice", "group").applyInPandas(add, "slice int, counts binary")
    levels = np.zeros(1 << COUNTERS, dtype=np.uint8)
    for row in some.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        total = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.uint64)
        levels[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.log2(total + 1.0)
    # sketch counts below the usual fill of a counter tell nothing of their shingle
    usual = int(np.median(levels)) + 1
    return np.where(levels <= usual, 0, levels - usual).astype(np.uint8)


def document_sets(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, key, n, sid (a hash of the set, null for an empty one) and the start of the set, rare shingles first, that the index needs."""
    level = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            n, sid, start = [], [], []
            for text in batch["text"]:
                s = shingles(text, words)
                k = len(s)
                n.append(k)
                sid.append(set_id(s) if k else None)
                least = -(-percent * k // 100)
                if not k or least == k and 100 * k // percent == k:
                    start.append(None)  # only an equal set can link
                    continue
                length = k - least + 1
                key = level.value[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.int64)
                # by level, then by hash: s is sorted, so a stable sort of the levels does it
                start.append(s[np.argsort(key, kind="stable")[:length]].view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n": np.array(n, dtype=np.int32), "sid": pd.array(sid, dtype="Int64"), "start": start}, index=batch.index)
        release_memory()

    return docs.mapInPandas(run, "doc_id long, key long, n int, sid long, start array<long>")


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of 2 ** FILTER bits whatever their number; full, it lets all pass."""
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER)).alias("bit"))
    words = bits.select(F.expr("cast(bit div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toPandas()
    out = np.zeros(1 << (FILTER - 6), dtype=np.int64)
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64)
    return out


def overlaps(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, with_difference: bool) -> DataFrame:
    """Adds the exact overlap to pairs(a, b, na, nb) of set ids, and by choice what a lacks of b (places in b) and has beside it.

    docs(key, text) are read again, and those whose key stands for such a set in reps(sid, rep) made into sets, once for each side of the pairs; of repeated rows each task gives one. Sets travel as 48 bits a shingle.
    """

    def fetched(side: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("sid")).distinct().join(reps, "sid")
        wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.col("rep").alias("id"))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            met: set[int] = set()
            for batch in in_pieces(batches):
                bit = batch["bit"].to_numpy(dtype=np.int64)
                batch = batch[(wanted.value[bit >> 6] >> (bit & 63)) & 1 == 1].drop_duplicates("key")
                batch = batch[~batch["key"].isin(met)]
                met.update(batch["key"])
                if len(batch):
                    found = [shingles(t, words) for t in batch["text"]]
                    yield pd.DataFrame({side: [set_id(s) for s in found], f"set_{side}": [(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in found]})
            release_memory()

        bit = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER)).alias("bit")
        return docs.select("key", "text", bit).mapInPandas(run, f"{side} long, set_{side} binary")

    def unpacked(packed: bytes) -> np.ndarray:
        out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
        out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
        return out.view(np.uint64).ravel()

    @F.pandas_udf("struct<common: int, lost: binary, own: binary>")
    def compared(one: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(one, other, strict=True):
            x, y = unpacked(x), unpacked(y)
            shared, in_x, in_y = np.intersect1d(x, y, return_indices=True)
            if not with_difference or 2 * len(shared) < max(len(x), len(y)):  # far apart: nothing to derive
                rows.append((len(shared), None, None))
                continue
            lost, own = np.ones(len(y), dtype=bool), np.ones(len(x), dtype=bool)
            lost[in_y], own[in_x] = False, False
            rows.append((len(shared), np.flatnonzero(lost).astype(np.uint32).tobytes(), x[own].tobytes()))
        return pd.DataFrame(rows, columns=["common", "lost", "own"]).astype({"common": "int32"})

    # repeated rows of a document give repeated pairs
    return pairs.join(fetched("b"), "b").join(fetched("a"), "a").withColumn("x", compared("set_a", "set_b")).select("a", "b", "na", "nb", "x.common", "x.lost", "x.own").dropDuplicates(["a", "b"])


def derived_common(*columns: str) -> Column:
    """Overlap of two sets from their differences to one hub: what of the hub neither lost, and what both have beside it."""

    @F.pandas_udf("int")
    def derived(lost_x: pd.Series, own_x: pd.Series, lost_y: pd.Series, own_y: pd.Series, hub_size: pd.Series) -> pd.Series:
        out = []
        for lx, ox, ly, oy, n in zip(lost_x, own_x, lost_y, own_y, hub_size, strict=True):
            lost = np.union1d(np.frombuffer(lx, dtype=np.uint32), np.frombuffer(ly, dtype=np.uint32))
            out.append(n - len(lost) + len(np.intersect1d(np.frombuffer(ox, dtype=np.uint64), np.frombuffer(oy, dtype=np.uint64))))
        return pd.Series(out, dtype="int32")

    return derived(*columns)


def linked_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of docs(doc_id, text).

    Two documents link when percent * union <= 100 * intersection of their distinct shingles of `words` words, A-Z taken as a-z. A text
    without words (or a null one) has no shingles and its own doc_id as component. Repeated rows, copies and texts of equal sets
    share a component. Rows with a null doc_id link as any other but can't name a component; if a component has no other, its id is null. A hash of id and text stands for a row inside.
    """
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = cut(document_sets(docs, frequency_levels(docs, words), words, percent))
    some = rows.where("sid is not null").groupBy("sid")
    reps = some.agg(F.min("key").alias("rep"), F.min("doc_id").alias("first_id"))
    starts = some.agg(F.first("n").alias("n"), F.first("start").alias("start"))

    # the index: lists of two or more sets, each with its hub
    entry = starts.where("start is not null").select("sid", "n", F.posexplode("start").alias("pos", "h"))
    in_list = Window.partitionBy("h")  # one exchange; long lists spill, and rare-first order keeps them to groups of copies
    lists = entry.withColumn("size", F.count("*").over(in_list)).withColumn("hub", F.min(F.struct("pos", "n", "sid")).over(in_list)).where("size > 1")
    live = cut(lists.select("h", "sid", "n", "pos", "size", "hub"))

    c, hub = F.col, F.col("hub")
    reached = live.groupBy("sid").agg(F.count("*").alias("shared"), F.count_if(c("size") > SHORT).alias("long"))
    reached = cut(reached)

    def fits(n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def can_link(n: Column, pos: Column, m: Column, mpos: Column) -> Column:
        """Whether a pair may link whose first shared place this is."""
        return fits(n, m) & (F.least(n - pos, m - mpos) >= at_least(n, m, percent))

    def plausible(pairs: DataFrame, exact: bool) -> DataFrame:
        """Pairs(a, b, na, nb, lists) whose starts have enough in common: all shingles that both sets have up to where the first start ends are shared
        lists, and what follows is bounded by the rest of that set. lists counts shared short lists if exact; else each set's lists bound it."""
        rest = lambda n: F.ceil(n * percent / 100 - 1e-9) - 1
        side = lambda x: reached.select(c("sid").alias(x), c("shared").alias(f"shared_{x}"), c("long").alias(f"long_{x}"))
        most = F.least("shared_a", "shared_b")
        if exact:
            most = F.least(most, c("lists") + F.least("long_a", "long_b"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        if exact:  # a pair whose first shared place is in a long list may have none in a short one that would do
            joined = joined.where("can or long_a > 0")
        return joined.where(most + F.greatest(rest(c("na")), rest(c("nb"))) >= at_least(c("na"), c("nb"), percent)).select("a", "b", "na", "nb", "lists")

    # short lists give their pairs, counted over all lists; of long ones each set is paired with the hub only
    short = live.where(c("size") <= SHORT).groupBy("h").agg(F.collect_list(F.struct("sid", "n", "pos")).alias("xs"))
    pair = lambda x, y: F.struct(
        x["sid"].alias("a"), y["sid"].alias("b"), x["n"].alias("na"), y["n"].alias("nb"), can_link(x["n"], x["pos"], y["n"], y["pos"]).alias("can")
    )
    after = lambda x: F.filter("xs", lambda y: (y["sid"] > x["sid"]) & fits(x["n"], y["n"]))
    within = F.flatten(F.transform("xs", lambda x: F.transform(after(x), lambda y: pair(x, y))))
    counted = short.select(F.explode(within).alias("p")).groupBy("p.a", "p.b", "p.na", "p.nb").agg(F.count("*").alias("lists"), F.bool_or("p.can").alias("can"))
    paired = cut(plausible(counted, True))
    long_lists = live.where((c("size") > SHORT) & (c("sid") != hub["sid"]))
    with_hub = long_lists.where(fits(c("n"), hub["n"])).groupBy(c("sid").alias("a"), hub["sid"].alias("b"), c("n").alias("na"), hub["n"].alias("nb")).agg(F.count("*").alias("lists"))

    # each set is compared with the one, of greater id in short lists, that it shares most lists with
    either = paired.unionByName(plausible(with_hub, False))
    to_hub = cut(either.groupBy("a", "na").agg(F.max(F.struct("lists", "b", "nb")).alias("h")).select("a", c("h.b").alias("b"), "na", c("h.nb").alias("nb")))
    tested = cut(overlaps(to_hub, reps, docs, words, True))
    is_link = c("common") * (100 + percent) >= (c("na") + c("nb")) * percent
    links = tested.where(is_link).select("a", "b")
    member = components(links)

    # pairs across components are left: those of short lists, and of the long lists that still hold several
    of = member.withColumnRenamed("node", "sid")
    home = lambda side: of.select(c("sid").alias(side), c("component").alias(f"home_{side}"))
    apart = paired.join(home("a"), "a", "left").join(home("b"), "b", "left").where(F.coalesce("home_a", "a") != F.coalesce("home_b", "b")).select("a", "b", "na", "nb")
    entries = live.where(c("size") > SHORT).select("h", "sid", "n", "pos", "size").join(of, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    by_component = entries.groupBy("h", "size", "component").agg(F.count("*").alias("m"))
    several = by_component.groupBy("h", "size").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")

    # a list's entries stay in parts; those outside its main component visit each part
    parts = F.ceil(F.sqrt(c("size")) * LIST_PARTS).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    own_part = F.pmod(F.xxhash64("sid"), parts).cast("int")
    open_lists = cut(entries.withColumn("part", own_part).join(several.select("h", "main", every_part), ["h", "part"]))
    x, y = open_lists.alias("x"), open_lists.where("component <> main").drop("part").select("*", every_part).alias("y")
    once = (c("x.component") == c("x.main")) | (c("x.sid") < c("y.sid"))
    fit = can_link(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"))
    met = x.join(y, (c("x.h") == c("y.h")) & (c("x.part") == c("y.part")) & (c("x.component") != c("y.component")) & once & fit)
    ahead = c("x.sid") < c("y.sid")
    either_way = lambda one, two: F.when(ahead, c(one)).otherwise(c(two))
    met = met.select(either_way("x.sid", "y.sid").alias("a"), either_way("y.sid", "x.sid").alias("b"), either_way("x.n", "y.n").alias("na"), either_way("y.n", "x.n").alias("nb"))
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("lists"))
    across = apart.unionByName(plausible(met, False).drop("lists")).distinct()

    # overlaps with a common hub decide a pair where they can; else the differences to it give the exact overlap
    to = tested.select(c("a").alias("sid"), c("b").alias("hub"), c("nb").alias("hub_n"), c("common").alias("o"), c("lost").isNotNull().alias("close"))

    def hub_of(s: str) -> DataFrame:
        return to.select(c("sid").alias(s), c("hub").alias(f"hub_{s}"), c("o").alias(f"o_{s}"), c("close").alias(f"close_{s}"), *([c("hub_n")] if s == "a" else []))

    known = across.join(hub_of("a"), "a", "left").join(hub_of("b"), "b", "left")
    known = known.where(~F.coalesce((c("hub_a") == c("b")) | (c("hub_b") == c("a")), F.lit(False)))  # compared already
    same = F.coalesce((c("hub_a") == c("hub_b")) & c("close_a") & c("close_b"), F.lit(False))
    need = at_least(c("na"), c("nb"), percent)
    upper = F.least("o_a", "o_b") + F.least(c("na") - c("o_a"), c("nb") - c("o_b"))
    known = cut(known.where(~(same & (upper < need))).select("a", "b", "na", "nb", same.alias("same"), "hub_n", (same & (c("o_a") + c("o_b") - c("hub_n") >= need)).alias("sure")))
    sure = known.where("sure").select("a", "b")
    diff = lambda s: tested.select(c("a").alias(s), c("lost").alias(f"lost_{s}"), c("own").alias(f"own_{s}"))
    derived = known.where("same and not sure").join(diff("a"), "a").join(diff("b"), "b").withColumn("common", derived_common("lost_a", "own_a", "lost_b", "own_b", "hub_n")).where(is_link).select("a", "b")
    fetched = overlaps(known.where("not same").select("a", "b", "na", "nb"), reps, docs, words, False).where(is_link).select("a", "b")
    late = cut(sure.unionByName(derived).unionByName(fetched))
    if not late.isEmpty():
        member = components(links.unionByName(late))

    classes = reps.join(member.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "component").select("sid", "component_id")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
