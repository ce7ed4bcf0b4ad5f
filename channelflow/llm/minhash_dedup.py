"""Near-duplicate documents by MinHash with tensored banding.

A band of an ordinary MinHash table is a key of k minhashes, and L tables take k * L of them. Here two small collections of HALVES half-keys of ROWS minhashes each are formed,
and every pair of a left and a right half is a table's key (tensoring: Andoni and Indyk, 2006; Christiani, 2019): HALVES squared tables of 2 * ROWS minhashes from 2 * HALVES * ROWS hash functions,
about the square root of what separate tables take. Sets of similarity s meet in some table with probability (1 - (1 - s^ROWS)^HALVES)^2, 0.9998 at the threshold.
A key can only be shared where both of its halves are, so halves that no other set has are dropped before any pair is formed.

Equal sets are one class. Every set is compared with the most central set of its tables, and with that one's own centre; links are confirmed on full sets, and what they have brought into
one component isn't compared again. Keys that still hold several components give their pairs across these. All sets of such a key are compared with one anchor: masks of the places that each lacks of it, and of what
each has beside it that any other set has too, bound the overlap of two, and the full lists of both give the exact number. Other pairs go on if four bits of each of the
minhashes, kept beside a set, allow the similarity (the bound is five standard deviations below what the threshold expects), and are then confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release_memory, shuffles_removed, text_of
from .components import components
from .shingle_join import at_least, derived_common, in_pieces, overlaps, set_id, shingles

WORDS = 3
PERCENT = 85
HALVES = 10  # half-keys of either side; their square is the number of tables
ROWS = 3  # minhashes of a half
DEVIATIONS = 5  # standard deviations that a sketch may lie below the threshold's expectation

MASKS = 4  # words of 64 bits that stand for the elements in which a set differs from its anchor
_SKETCH = 16  # hashes a word of the sketch, four bits each
_TOP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the minhash functions, fixed by their number."""
    seeds = _mixed(_mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _TOP))
    return seeds[:count] | np.uint64(1), seeds[count:]


def minhashes(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each function over the set, long sets in pieces."""
    factors, shifts = functions
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        h = s[None, i : i + 4096] * factors[:, None] + shifts[:, None]
        h = (h ^ (h >> np.uint64(29))) * _TOP
        np.minimum(least, h.min(axis=1), out=least)
    return least


def half_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit number for each half, which differs by place."""
    halves = least.reshape(-1, rows)
    key = np.arange(1, len(halves) + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * _TOP + halves[:, k])
    return key


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minhash, sixteen a word."""
    bits = (_mixed(least) >> np.uint64(60)).astype(np.uint64)
    padded = np.zeros(-(-len(bits) // _SKETCH) * _SKETCH, dtype=np.uint64)
    padded[: len(bits)] = bits
    return np.bitwise_or.reduce(padded.reshape(-1, _SKETCH) << (np.arange(_SKETCH, dtype=np.uint64) * np.uint64(4)), axis=1)


def differing(one: list[Column], other: list[Column]) -> Column:
    """In how many minhashes two sketches differ."""
    total = F.lit(0)
    for x, y in zip(one, other, strict=True):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def most_differing(hashes: int, percent: int, deviations: float = DEVIATIONS) -> int:
    p = (1 - percent / 100) * 15 / 16
    return int(hashes * p + deviations * (hashes * p * (1 - p)) ** 0.5)


def longs(column: str) -> Column:
    """The packed numbers as an array."""

    @F.pandas_udf("array<long>")
    def unpacked(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.int64) for x in packed], dtype=object)

    return unpacked(column)


def position_masks(column: str) -> Column:
    """The packed places as MASKS words of 64 bits, place modulo their number."""
    names = [f"lost{w}" for w in range(MASKS)]

    @F.pandas_udf(", ".join(f"{x} long" for x in names))
    def masked(packed: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(packed), MASKS), dtype=np.uint64)
        for i, x in enumerate(packed):
            at = np.frombuffer(x, dtype=np.uint32) % (64 * MASKS)
            np.bitwise_or.at(out[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return pd.DataFrame(out.view(np.int64), columns=names)

    return masked(column)


def at_most_common(mask: str, size: str) -> Column:
    """A bound of what two sets a and b of `size` elements share, from their masks: shared bits, and the elements that a mask has no bit of their own for."""
    shared = sum((F.bit_count(F.col(f"{mask}{w}_a").bitwiseAND(F.col(f"{mask}{w}_b"))) for w in range(MASKS)), F.lit(0))
    spare = [F.col(f"{size}_{x}") - sum((F.bit_count(f"{mask}{w}_{x}") for w in range(MASKS)), F.lit(0)) for x in "ab"]
    return F.least(shared + F.least(*spare), F.col(f"{size}_a"), F.col(f"{size}_b"))


def document_halves(docs: DataFrame, words: int, percent: int, halves: int, rows: int) -> DataFrame:
    """doc_id, key, n, sid (null for an empty set), the half-keys of both sides in one array (null if only an equal set can link) and the sketch's words."""
    words_of_sketch = -(-2 * halves * rows // _SKETCH)
    schema = "doc_id long, key long, n int, sid long, half array<long>, " + ", ".join(f"s{i} long" for i in range(words_of_sketch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        functions = hash_functions(2 * halves * rows)
        for batch in in_pieces(batches):
            n, sid, half, sketches = [], [], [], []
            for text in batch["text"]:
                s = shingles(text, words)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                alone = len(s) * (100 - percent) < percent and (len(s) + 1) * percent > 100 * len(s)  # neither one shingle less nor one more would do
                least = None if not len(s) or alone else minhashes(s, functions)
                half.append(None if least is None else half_keys(least, rows).view(np.int64))
                sketches.append([0] * words_of_sketch if least is None else sketch(least).view(np.int64).tolist())
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n": np.array(n, dtype=np.int32), "sid": pd.array(sid, dtype="Int64"), "half": half}, index=batch.index)
            yield out.assign(**{f"s{i}": np.array([x[i] for x in sketches], dtype=np.int64) for i in range(words_of_sketch)})
        release_memory()

    return docs.mapInPandas(run, schema)


def _across(opened: DataFrame, tested: DataFrame, info: DataFrame, reps: DataFrame, docs: DataFrame, marks: list[str], words: int, percent: int, hashes: int, fits, is_link: Column) -> DataFrame:
    """Links a, b between different components of opened(k, sid, anchor, component, main).

    Sets outside a key's main component first meet that component in one of their keys; what links joins it, and all other pairs follow.
    """
    c = F.col
    # a set's place by its key's anchor: masks of what it lacks of that, and of what it has beside it that others with the anchor have too
    itself = opened.select(c("anchor").alias("sid"), "anchor").distinct().select("*", *[F.unhex(F.lit("")).alias(x) for x in ("lost", "own")])
    against = tested.where("lost is not null").select(c("a").alias("sid"), c("b").alias("anchor"), "lost", "own")
    placed = cut(itself.unionByName(against).join(opened.select("sid", "anchor").distinct(), ["sid", "anchor"], "left_semi"))
    beside = placed.select("sid", "anchor", F.explode(longs("own")).alias("x"))
    known = beside.groupBy("anchor", "x").agg(F.count("*").alias("m")).where("m > 1").select("anchor", "x")
    bits = [F.bit_or(F.when(F.pmod("x", F.lit(MASKS)) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("x", 8), F.lit(64)).cast("int")))).alias(f"own{w}") for w in range(MASKS)]
    known = beside.join(known, ["anchor", "x"]).groupBy("sid", "anchor").agg(F.count("*").cast("int").alias("s"), *bits)
    about = placed.select("sid", "anchor", (F.length("lost") / 4).cast("int").alias("l"), position_masks("lost").alias("p")).join(known, ["sid", "anchor"], "left")
    masks = [F.coalesce(f"own{w}", F.lit(0)).alias(f"own{w}") for w in range(MASKS)] + [c(f"p.lost{w}").alias(f"lost{w}") for w in range(MASKS)]
    about = about.select("sid", "anchor", "l", F.coalesce("s", F.lit(0)).alias("s"), *masks).join(info.select(c("sid").alias("anchor"), c("n").alias("anchor_n")), "anchor")
    sides = cut(opened.join(about, ["sid", "anchor"], "left").join(info, "sid"))
    own_columns = ("sid", "n", "component", "l", "s", *[f"{z}{w}" for z in ("own", "lost") for w in range(MASKS)], *marks)
    limit = most_differing(hashes, percent)

    def pairs(one: DataFrame, other: DataFrame) -> DataFrame:
        """a, b, na, nb, anchor (null if one has no place by it) of the pairs of a key that masks or else sketches allow."""
        named = lambda df, x: df.select("k", *(["main", "anchor", "anchor_n"] if x == "a" else []), *[c(y).alias(f"{y}_{x}") for y in own_columns])
        once = (c("component_a") == c("main")) | (c("sid_a") < c("sid_b"))
        placed_both = c("l_a").isNotNull() & c("l_b").isNotNull()
        bound = c("anchor_n") - c("l_a") - c("l_b") + at_most_common("lost", "l") + at_most_common("own", "s") >= at_least(c("n_a"), c("n_b"), percent)
        alike = differing([c(f"{m}_a") for m in marks], [c(f"{m}_b") for m in marks]) <= limit
        met = named(one, "a").join(named(other, "b"), "k").where((c("component_a") != c("component_b")) & once & fits(c("n_a"), c("n_b")) & F.coalesce(~placed_both | bound, F.lit(True)) & alike)
        ahead = c("sid_a") < c("sid_b")
        ordered = lambda u, v: F.when(ahead, c(u)).otherwise(c(v))
        found = met.select(ordered("sid_a", "sid_b").alias("a"), ordered("sid_b", "sid_a").alias("b"), ordered("n_a", "n_b").alias("na"), ordered("n_b", "n_a").alias("nb"), F.when(placed_both, c("anchor")).alias("anchor"))
        return found.groupBy("a", "b", "na", "nb").agg(F.max("anchor").alias("anchor"))

    anchor_sizes = info.select(c("sid").alias("anchor"), c("n").alias("anchor_n"))
    lists = lambda z: placed.select("anchor", c("sid").alias(z), c("lost").alias(f"lost_{z}"), c("own").alias(f"own_{z}"))

    def derived(found: DataFrame) -> DataFrame:
        """The links among pairs that have places by one anchor, from the full lists of both."""
        both = found.where("anchor is not null").join(lists("a"), ["anchor", "a"]).join(lists("b"), ["anchor", "b"]).join(anchor_sizes, "anchor")
        return both.withColumn("common", derived_common("lost_a", "own_a", "lost_b", "own_b", "anchor_n")).where(is_link).select("a", "b")

    outside = sides.where("component <> main")
    one_key = outside.groupBy("sid").agg(F.min("k").alias("k"))
    soon = cut(derived(pairs(sides.where("component = main"), outside.join(one_key, ["sid", "k"], "left_semi"))))
    home = sides.select("sid", "component").distinct()
    ends = soon.join(home.select(c("sid").alias("a"), c("component").alias("u")), "a").join(home.select(c("sid").alias("b"), c("component").alias("v")), "b")
    moved = ends.select("u", "v").unionByName(ends.select(c("v").alias("u"), c("u").alias("v"))).join(sides.select(c("main").alias("v")).distinct(), "v", "left_semi")
    moved = moved.groupBy("u").agg(F.min("v").alias("joined")).join(sides.select(c("main").alias("u")).distinct(), "u", "left_anti")
    now = sides.join(moved.withColumnRenamed("u", "component"), "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")
    rest = pairs(now, now.where("component <> main"))
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut(rest.join(done, ["a", "b"], "left_anti"))
    fetched = overlaps(rest.where("anchor is null").drop("anchor"), reps, docs, words, False).where(is_link).select("a", "b")
    return cut(soon.unionByName(derived(rest)).unionByName(fetched))


def _linked(docs: DataFrame, words: int, percent: int, halves: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of documents, their sets as classes, and the component of each set that links."""
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    table = cut(document_halves(docs, words, percent, halves, rows))
    c = F.col
    marks = [x for x in table.columns if x[0] == "s" and x[1:].isdigit()]
    some = table.where("sid is not null").groupBy("sid")
    classes = some.agg(F.min("key").alias("rep"), F.min("doc_id").alias("first_id"))
    keyed = table.where("half is not null").dropDuplicates(["sid"])
    info = cut(keyed.select("sid", "n", *marks))
    sizes = lambda x, n: info.select(c("sid").alias(x), c("n").alias(n))

    # halves that several sets have; the keys of each set's remaining ones
    entry = keyed.select("sid", F.posexplode("half").alias("at", "h"))
    shared = entry.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    of = entry.join(shared, "h").groupBy("sid").agg(
        F.collect_list(F.when(c("at") < halves, c("h"))).alias("left"), F.collect_list(F.when(c("at") >= halves, c("h"))).alias("right")
    )
    pairs = of.select("sid", F.explode("left").alias("one"), "right").select("sid", "one", F.explode("right").alias("two"))
    keys = cut(pairs.select(F.xxhash64("one", "two").alias("k"), "sid"))
    counts = keys.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    live = cut(keys.join(counts, "k"))

    # each set meets the most central one of its tables, the set with most neighbours, and of each table the one that most of its sets meet: the key's anchor
    central = live.groupBy("sid").agg(F.sum("m").alias("degree"))
    hubs = live.join(central, "sid").groupBy("k").agg(F.max(F.struct("degree", "sid")).alias("hub"))
    chosen = cut(live.join(hubs, "k").groupBy("sid").agg(F.max("hub").alias("hub")).select("sid", c("hub.sid").alias("hub")))
    votes = live.select("k", "sid").join(chosen, "sid").groupBy("k", "hub").agg(F.count("*").alias("m"))
    anchors = votes.groupBy("k").agg(F.max(F.struct("m", "hub")).alias("x")).select("k", c("x.hub").alias("anchor"))
    anchored = cut(live.select("k", "sid").join(anchors, "k"))
    meet = chosen.select(c("sid").alias("a"), c("hub").alias("b")).unionByName(anchored.select(c("sid").alias("a"), c("anchor").alias("b"))).where("a <> b").distinct()
    meet = cut(meet.join(sizes("a", "na"), "a").join(sizes("b", "nb"), "b"))

    def fits(n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    is_link = c("common") * (100 + percent) >= (c("na") + c("nb")) * percent
    reps = classes.select("sid", "rep")
    tested = cut(overlaps(meet, reps, docs, words, True))
    links = tested.where(is_link).select("a", "b")
    member = components(links)

    # keys that still hold several components
    home = member.select(c("node").alias("sid"), "component")
    entries = anchored.join(home, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    parts = entries.groupBy("k", "component").agg(F.count("*").alias("m"))
    several = parts.groupBy("k").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("k", "main")
    opened = cut(entries.join(several, "k"))
    late = _across(opened, tested, info, reps, docs, marks, words, percent, 2 * halves * rows, fits, is_link)
    if late.take(1):  # isEmpty would leave a shuffle
        member = components(links.unionByName(late))
    return table, classes, member


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id equals component_id) of every row of docs(doc_id, text).

    Documents link if percent * union <= 100 * intersection of their distinct shingles of `words` words, A-Z taken as a-z; fewer words are one shingle. A text without words (or a null one) links with
    nothing. Repeated rows, copies and texts of equal sets share a component; a row with a null doc_id links as any other but can't name a component, whose id is null if it has no other row.
    Every link is confirmed on full sets; a pair at the threshold is missed with probability 0.0002 unless other links join it. Further columns are dropped.
    """
    with shuffles_removed(docs.sparkSession):
        table, classes, member = _linked(docs, words, percent, halves, rows)
    c = F.col
    joined = classes.join(member.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(names, "component").select("sid", "component_id")
    out = table.join(named, "sid", "left").select("doc_id", c("n").cast("long").alias("n_shingles"), F.when(c("sid").isNull(), c("doc_id")).otherwise(c("component_id")).alias("component_id"))
    return out.withColumn("kept", c("doc_id").eqNullSafe(c("component_id")))
