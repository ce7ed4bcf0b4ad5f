"""Ranked lexical search over a clustered index.

The index holds, for every document, its length and its counts of the terms that are asked for. Within blocks of consecutive rows, recursive graph bisection
(Dhulipala et al., 2016) reorders the documents: a block is halved again and again, and documents change sides in pairs while that lowers the cost of the
terms' gaps. The leaves are shards of documents that share terms. A shard carries, for each of its terms, the greatest count and the least length of a document
that holds it, which bound what the term can score there; the sum over an item's terms bounds every document of the shard. Each item visits shards
from the highest bound on and stops at the first one below its tenth score, so results are exact. Ties and results go by doc_id, which a shard keeps for each place.

Tasks first visit their best shard of each item; the tenth score of what they find together is a floor that all shards of all tasks meet afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release_memory, text_of

TOP = 10
SHARD = 64  # documents of a leaf at most
BLOCK = 4096  # documents that are reordered together
ROUNDS = 8  # exchanges of documents between two halves at most
TERMS_A_BLOCK = 200_000  # terms of the items that are searched together: about so many reach the driver and each task
NO_ID = (1 << 63) - 1  # stands for a null doc_id, so that it comes last among equal scores

#: A byte of a term as it is, A-Z as a-z, all others as a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split()


def gap_cost(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits that `count` gaps among `size` places take, about."""
    return count * np.log2(np.maximum(size, 1) / (count + 1.0))


def bisected(docs: np.ndarray, terms: np.ndarray, n: int, leaf: int = SHARD, rounds: int = ROUNDS) -> np.ndarray:
    """The leaf of each of n documents; docs and terms are the two ends of the graph's edges.

    All nodes of a level are halved together: sizes differ by one at most, since documents only change sides in pairs.
    """
    node = np.zeros(n, dtype=np.int64)
    while n and np.bincount(node).max() > leaf:
        order = np.argsort(node, kind="stable")
        sizes = np.bincount(node)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        right = place >= (sizes[node] + 1) // 2
        _, key = np.unique(node[docs] * (int(terms.max(initial=0)) + 1) + terms, return_inverse=True)
        key_node = np.zeros(key.max(initial=-1) + 1, dtype=np.int64)
        key_node[key] = node[docs]
        n_right = sizes // 2
        n_left = sizes - n_right
        for _ in range(rounds):
            b = np.bincount(key[right[docs]], minlength=len(key_node)).astype(np.float64)
            a = np.bincount(key, minlength=len(key_node)) - b
            left_size, right_size = n_left[key_node], n_right[key_node]
            now = gap_cost(a, left_size) + gap_cost(b, right_size)
            to_right = now - gap_cost(np.maximum(a - 1, 0), left_size) - gap_cost(b + 1, right_size)
            to_left = now - gap_cost(a + 1, left_size) - gap_cost(np.maximum(b - 1, 0), right_size)
            gain = np.bincount(docs, weights=np.where(right[docs], to_left[key], to_right[key]), minlength=n)
            # the k-th best of either half of a node change places while both together gain
            order = np.lexsort((-gain, right, node))
            half = node[order] * 2 + right[order]
            first = np.flatnonzero(np.append(True, half[1:] != half[:-1]))
            rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            lefts, rights = order[~right[order]], order[right[order]]
            widest = int(sizes.max()) + 1
            left_key, right_key = node[lefts] * widest + rank[~right[order]], node[rights] * widest + rank[right[order]]
            _, i, j = np.intersect1d(left_key, right_key, assume_unique=True, return_indices=True)
            good = gain[lefts[i]] + gain[rights[j]] > 1e-9
            if not good.any():
                break
            right[lefts[i][good]], right[rights[j][good]] = True, False
        node = node * 2 + right
    return node


class Search:
    """Items against shards, with what all tasks need: each term's weight and its items, and the sums over the documents."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n_docs: int, n_words: int):
        self.weights, self.n_docs, self.n_words = weights, n_docs, n_words
        counted = [np.unique(np.array(x, dtype=np.int64), return_counts=True) for x in items]
        self.items = counted
        term = np.concatenate([t for t, _ in counted]) if items else np.zeros(0, dtype=np.int64)
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in counted])
        times = np.concatenate([c for _, c in counted]) if items else term
        order = np.argsort(term, kind="stable")
        self.of_term = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(weights)))))
        self.term_item, self.term_times = item[order], times[order]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n words."""
        if len(n) and int(n.max()) * 75 * self.n_docs >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.n_docs // self.n_words for x in n], dtype=np.int64)
        return 25 + (75 * n * self.n_docs) // self.n_words

    def worth(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term's tf occurrences in a document of n words score."""
        tf = tf.astype(np.int64)
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.lengths(n)))

    def bounds(self, shard: dict) -> np.ndarray:
        """For each item, a number that no document of the shard exceeds."""
        terms = shard["terms"]
        most = self.worth(terms, shard["most"], shard["least"])
        count = self.of_term[terms + 1] - self.of_term[terms]
        at = np.repeat(self.of_term[terms] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.zeros(len(self.items), dtype=np.int64)
        np.add.at(out, self.term_item[at], self.term_times[at] * np.repeat(most, count))
        return out

    def scores(self, shard: dict, item: int) -> np.ndarray:
        if "worth" not in shard:
            each = np.repeat(shard["terms"], np.diff(shard["begins"]))
            shard["worth"] = self.worth(each, shard["tf"], shard["n"][shard["place"]])
        terms, times = self.items[item]
        at = np.searchsorted(shard["terms"], terms)
        at[at == len(shard["terms"])] = 0
        found = shard["terms"][at] == terms
        at, times = at[found], times[found]
        begin, count = shard["begins"][at], shard["begins"][at + 1] - shard["begins"][at]
        entry = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.zeros(len(shard["n"]), dtype=np.int64)
        np.add.at(out, shard["place"][entry], np.repeat(times, count) * shard["worth"][entry])
        return out


class Best:
    """The highest scores of one item: at most `top` pairs of score and doc_id; a score below `floor` can't be among those of all."""

    def __init__(self, top: int, floor: int):
        self.top, self.pairs, self.floor = top, [], floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.floor))
        if len(good):
            pairs = self.pairs + list(zip(scores[good].tolist(), ids[good].tolist(), strict=True))
            self.pairs = sorted(pairs, key=lambda p: (-p[0], p[1]))[: self.top]
            if len(self.pairs) == self.top:
                self.floor = max(self.floor, self.pairs[-1][0])


_INDEX = "docs long, words long, ids binary, n binary, terms binary, begins binary, place binary, tf binary, most binary, least binary"
_KINDS = {"ids": np.int64, "n": np.int64, "terms": np.int64, "begins": np.int64, "place": np.uint16, "tf": np.int32, "most": np.int32, "least": np.int64}


def shards_of(ids: list[int], lengths: list[int], found: list[tuple[np.ndarray, np.ndarray]], shard: int) -> Iterator[dict]:
    """The shards of one block, whose documents have found terms and counts; those without any are only counted."""
    n = np.array(lengths, dtype=np.int64)
    held = np.array([len(t) > 0 for t, _ in found], dtype=bool)
    rest = {"docs": int((n[~held] > 0).sum()), "words": int(n[~held].sum())}
    if rest["docs"]:
        yield rest | {k: b"" for k in _KINDS}
    if not held.any():
        return
    docs = np.repeat(np.cumsum(held) - 1, [len(t) for t, _ in found])
    terms, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
    ids, n = np.array(ids, dtype=np.int64)[held], n[held]
    leaf = bisected(docs, terms, len(n), shard)
    order = np.lexsort((docs, terms, leaf[docs]))
    docs, terms, tf = docs[order], terms[order], tf[order]
    for k in np.unique(leaf):
        own = np.flatnonzero(leaf == k)
        begin, end = np.searchsorted(leaf[docs], [k, k + 1])
        place = np.searchsorted(own, docs[begin:end])
        distinct, first = np.unique(terms[begin:end], return_index=True)
        out = {"ids": ids[own], "n": n[own], "terms": distinct, "begins": np.append(first, end - begin), "place": place, "tf": tf[begin:end]}
        out |= {"most": np.maximum.reduceat(tf[begin:end], first), "least": np.minimum.reduceat(n[own][place], first)}
        yield {"docs": len(own), "words": int(n[own].sum())} | {k: np.asarray(v, dtype=_KINDS[k]).tobytes() for k, v in out.items()}


def clustered_index(docs: DataFrame, vocabulary: list[bytes], block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row a shard of docs(doc_id, text): its documents, their lengths, and postings and bounds of the vocabulary's terms, packed. Texts are read once and don't move."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    columns = [c.split()[0] for c in _INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = known.value
        ids, lengths, found = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64").fillna(NO_ID).tolist(), batch["text"], strict=True):
                words = terms_of(text)
                at = [place[w] for w in words if w in place]
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(np.unique(np.array(at, dtype=np.int64), return_counts=True))
                if len(ids) == block:
                    yield pd.DataFrame(shards_of(ids, lengths, found, shard), columns=columns)
                    ids, lengths, found = [], [], []
        yield pd.DataFrame(shards_of(ids, lengths, found, shard), columns=columns)
        release_memory()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, _INDEX)


def unpacked(rows: pd.DataFrame) -> list[dict]:
    return [{k: np.frombuffer(row[k], dtype=kind) for k, kind in _KINDS.items()} for row in rows.to_dict("records") if row["ids"]]


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is: summed in tasks, then by term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for terms, begins in zip(batch["terms"], batch["begins"], strict=True):
                if terms:
                    total[np.frombuffer(terms, dtype=np.int64)] += np.diff(np.frombuffer(begins, dtype=np.int64))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = np.zeros(size, dtype=np.int64)
    counts = index.select("terms", "begins").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[counts["term"].to_numpy(dtype=np.int64)] = counts["df"].to_numpy(dtype=np.int64)
    return out


def best_of(index: DataFrame, search: Search, floors: np.ndarray, top: int, visits: int | None = None) -> DataFrame:
    """item, score and doc_id of each task's best documents. visits: shards of a batch that an item meets at most, for a first look."""
    shared = index.sparkSession.sparkContext.broadcast((search, floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, floors = shared.value
        best = [Best(top, int(f)) for f in floors]
        for batch in batches:
            shards = unpacked(batch)
            if not shards:
                continue
            bounds = np.stack([search.bounds(s) for s in shards])
            for item, own in enumerate(best):
                for k in np.argsort(-bounds[:, item], kind="stable")[:visits]:
                    if bounds[k, item] < max(1, own.floor):
                        break
                    own.add(search.scores(shards[k], item), shards[k]["ids"])
        rows = [(item, score, doc_id) for item, own in enumerate(best) for score, doc_id in own.pairs]
        yield pd.DataFrame(rows, columns=["item", "score", "doc_id"]).astype("int64")
        release_memory()

    return index.mapInPandas(run, "item long, score long, doc_id long")


def top_of(found: DataFrame, top: int) -> DataFrame:
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)


def searched(items: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """The ranking of one block of items(item_id, text)."""
    spark = docs.sparkSession
    rows = items.collect()
    words = [terms_of(r["text"]) for r in rows]
    vocabulary = sorted({w for ws in words for w in ws})
    place = {w: i for i, w in enumerate(vocabulary)}
    index = cut(clustered_index(docs, vocabulary))
    sums = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("l")).first()
    n, total = sums["n"] or 0, sums["l"] or 1
    df = term_counts(index, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1.0))).astype(np.int64)
    search = Search([[place[w] for w in ws] for ws in words], weights, n, total)
    floors = np.zeros(len(rows), dtype=np.int64)
    seen = top_of(best_of(index, search, floors, top, visits=1), top).where(F.col("rank") == top).select("item", "score").toPandas()
    floors[seen["item"].to_numpy(dtype=np.int64)] = seen["score"].to_numpy(dtype=np.int64)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
    found = top_of(best_of(index, search, floors, top), top).join(F.broadcast(names), "item")
    return found.select("item_id", F.col("rank").cast("int"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked_documents(items: DataFrame, docs: DataFrame, top: int = TOP, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` documents above 0 for each item of items(item_id, text), over all of docs(doc_id, text).

    Items are searched in blocks of about `terms_a_block` terms, by a hash of the row. A null text has no terms, and an item without terms or without a document above 0 no rows. Repeated rows of items count once;
    rows of one item_id with different texts have rankings of their own. Repeated rows of docs are documents of their own; a null doc_id comes last among equal scores. Further columns are dropped.
    """
    items = items.select("item_id", text_of().alias("text")).distinct()
    blocks = max(1, -(-int(items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) // terms_a_block))
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        part = searched(own, docs, top)
        out = part if out is None else out.unionByName(part)
    return out


#: The ranking of op13, for DuckDB.
RANKED_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM len),
weight AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, nn),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM len, total),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
