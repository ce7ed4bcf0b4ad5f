"""Byte-level BPE by corpus-level merge replay.

The corpus's words are counted with partial sums. The pre-tokens of the most frequent ones, a bounded number, are laid out in shards, each
one array of byte symbols with an inverted index that leads from the rank of a token pair to every position where that pair starts.
Ranks are replayed in ascending order; a merge touches its own position and its two neighbours only, so each of these
pre-tokens is merged once, however often the corpus repeats it. Their ids go to all tasks. What is rarer is laid out and replayed in the same
way over the batch where it occurs: a join of it would move the whole corpus.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release_memory, text_of

NONE = 1 << 30  # the rank of a pair that no merge joins
OUT_ROWS = 250  # documents whose ids are held at once
CHUNK_CHARS = 500_000  # of texts that are split at once
PICKED = 1 << 14  # strings that are picked and joined at once
LAID_OUT = 1 << 12  # bytes of pre-tokens that one index covers, or one longer pre-token: what a processor's cache holds
KEPT_WORDS = 150_000  # rare pre-tokens that a worker remembers between chunks
SHARED_WORDS = 150_000  # words at most whose pre-tokens' ids all tasks get
SHARED_CHARS = 40  # of such a word at most: with the line above, the bound of what is broadcast
COUNT_BITS = 12  # leading bits in which counts are told apart


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        joined = {(ranks[t[:c]] << 32 | ranks[t[c:]]): r for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks}
        self.joined = joined
        self.pair = np.array([*sorted(joined), 1 << 62], dtype=np.int64)
        self.pair_rank = np.array([*(joined[k] for k in sorted(joined)), NONE], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, none of them empty, laid out in runs of bounded length."""
        out: list[list[int]] = []
        begin = size = 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= LAID_OUT:
                out += self.replayed(words[begin : i + 1])
                begin, size = i + 1, 0
        return out + self.replayed(words[begin:])

    def replayed(self, words: list[bytes]) -> list[list[int]]:
        """One replay of the merges, in rank order, over the positions of all words."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        laid = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        size = len(laid)
        follows, precedes = np.arange(1, size + 1), np.arange(-1, size - 1)
        follows[ends - 1], precedes[ends - lengths] = -1, -1
        inner = np.flatnonzero(follows >= 0)
        ranks = np.full(size, NONE, dtype=np.int64)
        ranks[inner] = self.rank_of(laid[inner], laid[inner + 1])
        order = inner[np.argsort(ranks[inner], kind="stable")]
        order = order[: np.searchsorted(ranks[order], NONE)]
        values, starts = np.unique(ranks[order], return_index=True)
        index = dict(zip(values.tolist(), map(np.ndarray.tolist, np.split(order, starts[1:])), strict=True)) if len(values) else {}
        symbol, after, before, rank_at = laid.tolist(), follows.tolist(), precedes.tolist(), ranks.tolist()
        heap, odd, rank, push, pop = list(index), [], self.joined.get, heapq.heappush, heapq.heappop
        heapq.heapify(heap)
        while heap:
            r = pop(heap)
            at = index.pop(r)
            at.sort()  # the leftmost goes first
            for i in at:
                if rank_at[i] != r:  # a neighbour's merge has changed the pair since
                    continue
                second = after[i]
                third = after[i] = after[second]
                symbol[i], symbol[second], rank_at[second] = r, -1, NONE
                new = NONE
                if third >= 0:
                    before[third] = i
                    new = rank(r << 32 | symbol[third], NONE)
                    if new != NONE:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(heap, new)
                        if new < r:  # only odd vocabularies have it: such a word is merged alone, below
                            odd.append(i)
                rank_at[i] = new
                i = before[i]
                if i >= 0:
                    new = rank_at[i] = rank(symbol[i] << 32 | r, NONE)
                    if new != NONE:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(heap, new)
                        if new < r:
                            odd.append(i)
        left = np.array(symbol)
        kept = left >= 0
        stops = np.cumsum(np.add.reduceat(kept.astype(np.int64), ends - lengths)).tolist()
        flat = left[kept].tolist()
        out = [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        for w in set(np.searchsorted(ends, sorted(odd), side="right").tolist()):
            out[w] = self.encode_alone(words[w])
        return out

    def encode_alone(self, word: bytes) -> list[int]:
        """The same by definition: join the leftmost pair of least rank until none is left."""
        parts = self.byte_id[list(word)].tolist()
        while len(parts) > 1:
            ranks = self.rank_of(np.array(parts[:-1]), np.array(parts[1:]))
            i = int(ranks.argmin())
            r = int(ranks[i])
            if r == NONE:
                break
            parts[i : i + 2] = [r]
        return parts


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, end to end."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Strings:
    """Byte strings end to end, to be picked by number."""

    def __init__(self, strings: Sequence[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of_runs(self, numbers: np.ndarray, runs: np.ndarray) -> list[bytes]:
        """The strings of these numbers, joined within each run; runs holds the runs' lengths. Places of bytes, eight bytes each, are held for PICKED strings at once."""
        lengths = self.lengths[numbers]
        pieces = (slice(i, i + PICKED) for i in range(0, len(numbers), PICKED))
        joined = b"".join([ragged(self.bytes, self.starts[numbers[p]], lengths[p]).tobytes() for p in pieces])
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(runs)].tolist()
        return [joined[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class Numbers(dict):
    """Numbers of strings; a new one gets the next number and is listed in `new`."""

    def __init__(self, *known: dict[str, int]):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """A worker's encoder: splits texts and remembers the ids of pre-tokens in one array."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern).findall
        self.replay = MergeReplay(load_ranks(path))
        most = max(self.replay.token)
        self.tokens = Strings([self.replay.token.get(i, b"") for i in range(most + 1)])
        self.decimals = Strings([b"%d " % i for i in range(most + 1)])
        self.share(None)

    def share(self, shared: pa.Table | None) -> None:
        """Takes ids that the corpus's replay has found: w, ids. None: none, and those learned since go too."""
        if shared is not None and shared is self.shared:
            return
        self.shared = shared
        self.known = Numbers()
        self.flat, self.starts, self.lengths = (np.zeros(1 << 16, dtype=t) for t in (np.int32, np.int64, np.int64))  # with room to grow
        self.used = 0
        if shared is not None:
            for part in shared.to_batches():
                words, ids = part.column("w"), part.column("ids")
                self.known.update(zip(words.to_pylist(), range(len(self.known), len(self.known) + len(words)), strict=True))
                self.store(ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy(), len(self.known) - len(words))
        self.shared_words, self.shared_used = len(self.known), self.used

    def forget(self) -> None:
        """Back to what is shared: those numbered last go."""
        while len(self.known) > self.shared_words:
            self.known.popitem()
        self.used = self.shared_used

    def add(self, ids: list[list[int]], first: int | None = None) -> None:
        """Ids of the pre-tokens numbered from `first` on, by default of the last ones numbered."""
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum()))
        self.store(flat, lengths, len(self.known) - len(ids) if first is None else first)

    def store(self, flat: np.ndarray, lengths: np.ndarray, n: int) -> None:
        """Ids, end to end, of the pre-tokens numbered from n on."""
        end, total = n + len(lengths), len(flat)
        while end > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.starts[n:end] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:end] = lengths
        self.flat[self.used : self.used + total] = flat
        self.used += total

    def make_room(self) -> None:
        if len(self.known) > self.shared_words + KEPT_WORDS:
            self.forget()

    def learn(self, words: Iterable[str]) -> None:
        """Ids of these pre-tokens, by one replay of the merges over all that are new."""
        self.make_room()
        for w in words:
            self.known[w]  # noqa: B018 numbers it if it is new
        self.replay_new()

    def replay_new(self) -> None:
        new = self.known.new
        if new:
            self.add(self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]))
            self.known.new = []

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and how many each text has. Pre-tokens that are new are numbered as they are met, and then replayed together."""
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(counts.sum()))
        self.replay_new()
        lengths = self.lengths[place]
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
        return ragged(self.flat, self.starts[place], lengths), np.diff(ends)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def in_chunks(batches: Iterator[pa.RecordBatch], chars: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of runs of rows of about so many characters; a longer text is a chunk of its own."""
    for batch in batches:
        begin = 0
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        while begin < len(lengths):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + chars, side="right")))
            part = batch.slice(begin, end - begin)
            yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            begin = end


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of what stands between white space in docs(text), at most SHARED_CHARS characters long and met more than once, from partial sums of the tasks."""
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.length("word").between(1, SHARED_CHARS))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


def shared_ids(docs: DataFrame, path: str, pattern: str, most: int = SHARED_WORDS) -> pa.Table:
    """w and ids of the pre-tokens of the corpus's most frequent words, each word with a space before it, by replays over shards of them.

    The count from which a word is among the `most` comes from a histogram of counts by their leading bits, so nothing is sorted; its cells have a bounded number, and at most `most`
    words are shared: a cell that would exceed them is left out with all below it. Counts only choose what is shared: whatever is missing is replayed where it occurs.
    """
    counted = cut(word_counts(docs))
    rest = F.greatest(F.length(F.bin("n")) - COUNT_BITS, F.lit(0))
    cell = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), rest), rest)
    histogram = {r["cell"]: r["words"] for r in counted.groupBy(cell.alias("cell")).agg(F.count("*").alias("words")).collect()}
    least, total = max(histogram, default=0) * 2 + 1, 0
    for n in sorted(histogram, reverse=True):
        total += histogram[n]
        if total > most:
            break
        least = n

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            words = list(set(chain.from_iterable(own.split(" " + w) for w in batch.column("word").to_pylist())))
            ids = own.replay.encode([w.encode() for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["w", "ids"])
            del words, ids
        release_memory()

    found = counted.where(F.col("n") >= least).select("word").repartition(8).mapInArrow(replay, "w string, ids array<int>")
    return found.dropDuplicates(["w"]).toArrow()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the bytes
    that the ids decode to) and, with_ids, ids array<int>. Null and empty texts have no ids: both digests are
    those of no bytes. Every input row gives one row, repeated rows and null doc_ids too; further columns are dropped.
    Pre-tokens are counted over all rows first; texts are then encoded where they are read and not shuffled.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(shared_ids(texts_of, path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        own.share(shared.value)
        for doc_ids, texts in in_chunks(batches):
            split = list(map(own.split, texts))
            own.make_room()
            for at in range(0, len(split), OUT_ROWS):
                ids, counts = own.ids(split[at : at + OUT_ROWS])
                columns = [
                    pa.array(doc_ids[at : at + OUT_ROWS], pa.int64()),
                    pa.array(counts),
                    pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in own.decimals.of_runs(ids, counts)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.tokens.of_runs(ids, counts)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del ids, columns
            del split, texts  # before the next ones are split
        own.share(None)
        release_memory()

    return texts_of.mapInArrow(run, schema)
