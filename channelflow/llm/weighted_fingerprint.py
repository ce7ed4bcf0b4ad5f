"""Document fingerprints by consistent weighted sampling.

A document is a set of terms (words) weighted by their counts. For each of the signature's samples, every term
draws r and c from a gamma distribution of shape 2 and b uniformly, all fixed by the term and the sample; its weight w
is brought down to the largest y = exp(r (t - b)) not above it, t an integer, and the term with the least
c / (y exp(r)) is the sample, with its t. Two documents agree in a sample with probability equal to
their generalised Jaccard similarity, the sum of least over the sum of greatest weights.

Draws come from a 64-bit hash of the term, mixed with the sample, so no two terms share them; a worker keeps the values c / (y exp(r)) of the terms, with their weights, that it met last. What a
signature keeps of a sample is its least value: it stands for the term and its t, as equal values of others are as unlikely as equal hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SAMPLES = 96
KEPT_TERMS = 1 << 17  # terms with their weights whose values a worker keeps
RECENT_TERMS = 1 << 12  # and room for those that are met at once
DRAWN = 1 << 8  # terms that are drawn at once: what a processor's cache holds
ROWS_A_BLOCK = 100_000
NO_TERMS = "0000"  # of each sample of a text without words
STEPS = 1 << 20  # least values are told apart by such parts of one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _products(x: np.ndarray) -> np.ndarray:
    """The product of two uniform numbers, above 0 and below 1, from either half of the bits."""
    halves = (x.view(np.uint32).reshape(*x.shape, 2) + 0.5) * 2.0**-32
    return halves[..., 0] * halves[..., 1]


class WeightedSampler:
    """Signatures, and the values of terms with their weights: those met longest ago make room for new ones."""

    def __init__(self, samples: int = SAMPLES, seed: int = 7, kept: int = KEPT_TERMS, recent: int = RECENT_TERMS):
        self.samples, self.piece, self.size = samples, recent, max(kept, recent) + recent
        self.own = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = np.zeros((self.size, samples), dtype=np.float32)
        self.place: dict[bytes | tuple[bytes, int], int] = {}  # of a term, and of one of weight 2 or more with its weight
        self.terms: list[bytes | tuple[bytes, int] | None] = [None] * self.size  # by place
        self.met = np.zeros(self.size, dtype=np.int64)  # when a place was last asked for
        self.free = np.arange(self.size)
        self.now = 0

    def draws(self, terms: list[bytes]) -> tuple[np.ndarray, ...]:
        """r, b, log c and, for weight 1, where t is 0, the log of c / (y exp(r)) of each term and sample."""
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms))[:, None]
        first = _mixed(hashed ^ self.own)
        second = _mixed(first + np.uint64(0x9E3779B97F4A7C15))
        r, log_c = -np.log(_products(first)), np.log(-np.log(_products(second)))
        b = (((first ^ (second >> np.uint64(13))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * 2.0**-32
        return r, b, log_c, log_c + r * (b - 1)

    def values(self, terms: list[bytes | tuple[bytes, int]]) -> np.ndarray:
        """The log of c / (y exp(r)) of each term, with its weight, and sample."""
        several = [i for i, w in enumerate(terms) if type(w) is tuple]
        r, b, log_c, once = self.draws([w if type(w) is bytes else w[0] for w in terms])
        out = once.astype(np.float32)
        if several:
            r, b, log_c = (x[several].astype(np.float32) for x in (r, b, log_c))
            weight = np.log(np.array([terms[i][1] for i in several], dtype=np.float64)).astype(np.float32)
            t = np.floor(weight[:, None] / r + b)
            # where t is 0, the very number that weight 1 has there, so that equal samples are equal numbers
            out[several] = np.where(t == 0, out[several], log_c - r * (t - b + 1))
        return out

    def make_room(self) -> None:
        """Frees the places asked for longest ago, as many as one call may need."""
        oldest = np.argpartition(self.met, self.piece)[: self.piece]
        for i in oldest.tolist():
            if self.terms[i] is not None:
                del self.place[self.terms[i]]
                self.terms[i] = None
        self.free = oldest

    def places(self, terms: list[bytes | tuple[bytes, int]]) -> np.ndarray:
        """Where the values of these terms, all distinct and at most as many as a piece, stand."""
        self.now += 1
        at = np.fromiter(map(self.place.get, terms, repeat(-1)), dtype=np.int64, count=len(terms))
        lacking = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = self.now
        if len(lacking):
            if len(self.free) < len(lacking):
                self.make_room()
            found, self.free = self.free[: len(lacking)], self.free[len(lacking) :]
            new = [terms[i] for i in lacking.tolist()]
            for i in range(0, len(new), DRAWN):
                self.table[found[i : i + DRAWN]] = self.values(new[i : i + DRAWN])
            for w, i in zip(new, found.tolist(), strict=True):
                self.place[w] = i
                self.terms[i] = w
            at[lacking] = found
            self.met[found] = self.now
        return at

    def signature(self, text: str) -> np.ndarray | None:
        """The samples, as numbers of 16 bits; None without words."""
        counts = Counter(text.encode("utf-8", "surrogatepass").split())
        if not counts:
            return None
        terms = [w if n == 1 else (w, n) for w, n in counts.items()]
        pieces = (terms[i : i + self.piece] for i in range(0, len(terms), self.piece))
        least = reduce(np.minimum, (self.table[self.places(part)].min(axis=0) for part in pieces))
        steps = np.rint(least.astype(np.float64) * STEPS).astype(np.int64).astype(np.uint64)
        return (_mixed(steps) >> np.uint64(48)).astype(np.uint16)


def as_text(signature: np.ndarray | None, samples: int) -> str:
    return NO_TERMS * samples if signature is None else signature.astype(">u2").tobytes().hex()


def likeness(one: np.ndarray | None, other: np.ndarray | None) -> float:
    """Share of samples that agree: an estimate of generalised Jaccard similarity. Two texts without words are alike, one is unlike all others."""
    if one is None or other is None:
        return float(one is None and other is None)
    return float((one == other).mean())


_samplers: dict[int, WeightedSampler] = {}


def sampler(samples: int) -> WeightedSampler:
    if samples not in _samplers:
        _samplers.clear()
        _samplers[samples] = WeightedSampler(samples)
    return _samplers[samples]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Adds fingerprint string (four hexadecimal digits a sample) to every row of docs, where it is read. Null counts as empty."""

    @F.pandas_udf("string")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sampler(samples)
        for texts in batches:
            yield pd.Series([as_text(own.signature(t), samples) for t in texts])

    return docs.withColumn("fingerprint", fingerprint(text_of()))


def beside_next(docs: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """doc_id and text in partitions of one block of consecutive doc_ids each, sorted, each block ending with the first row of the next one.

    _head marks those added rows; the last block is followed by the first row of all. Rows of equal doc_id stand by their text's hash, so blocks can divide them; null
    doc_ids come first, by that hash too. Where a block is cut and where it begins reach the driver: two numbers a task, as blocks are the tasks. Texts move once.
    """
    spark = docs.sparkSession
    tie = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    share = F.col("_tie") / F.lit(2.0**32)
    place = F.when(F.col("doc_id").isNull(), F.lit(-(2.0**100)) * (2 - share)).otherwise(F.col("doc_id").cast("double") + share)
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")).withColumn("_tie", tie).withColumn("_place", place)
    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // rows_a_block), min(4 * tasks, n // 2000))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = spark.sparkContext.broadcast(np.array(sorted(set(rows.select(F.percentile_approx("_place", shares, max(10_000, 20 * blocks))).first()[0] if shares and n else []))))

    @F.pandas_udf("int")
    def block_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, places.to_numpy(), side="right"))

    least = F.min(F.struct("_place", "_id", "_tie"))
    begins = {r["_block"]: tuple(r["first"]) for r in rows.groupBy(block_of("_place").alias("_block")).agg(least.alias("first")).collect()}
    present = sorted(begins)
    before = spark.sparkContext.broadcast({begins[b]: present[i - 1] for i, b in enumerate(present)})  # the first one's row also ends the last block

    @F.pandas_udf("array<int>")
    def blocks_of(places: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts.value, places.to_numpy(), side="right")
        return pd.Series([[b, before.value[x]] if x in before.value else [b] for b, x in zip(own.tolist(), zip(places, ids, ties, strict=True), strict=True)])

    laid = rows.select("*", F.posexplode(blocks_of("_place", "_id", "_tie")).alias("_head", "_block"))
    return laid.repartitionById(len(cuts.value) + 1, "_block").sortWithinPartitions("_head", "_place", "_id", "_tie").select("doc_id", "text", "_block", "_head")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n_chars / 2) code points are replaced by the first as many of the next document.

    Returns one row a row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to
    the edited text's fingerprint and to the next document's). The next document is by ascending doc_id, after the last the
    first; of rows with equal or without doc_id by a hash of the text. A null text counts as empty; without words, a text is like such texts only. A table
    of one row is its own next. Further columns are dropped. Blocks are read as streams, so a task holds two texts and a batch.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sampler(samples)
        held = None
        for batch in batches:
            out = []
            for doc_id, text, block, head in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["_block"], batch["_head"], strict=True):
                if head and held is None:
                    continue  # a repeated row of the same id
                sign = own.signature(text)
                if held is not None:
                    last_id, last, last_sign = held
                    k = len(last) // 2
                    edited = last[: len(last) - k] + text[:k]
                    edited_sign = own.signature(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    signs = as_text(last_sign, samples), as_text(edited_sign, samples)
                    out.append((last_id, len(last), digest, *signs, likeness(last_sign, edited_sign), likeness(last_sign, sign)))
                held = None if head else (doc_id, text, sign)
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
                yield frame.astype({"doc_id": "Int64"})

    return beside_next(docs, rows_a_block).mapInPandas(run, schema)
