"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold runs of pre-tokens with their token counts, inner nodes the sums of characters and tokens below. An edit goes down to its leaf,
splits again from a pre-token that the edit cannot reach until the new boundaries meet an old one, encodes
only these pre-tokens, and updates the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder, in_chunks
from .common import release_memory, text_of

LEAF = 32  # pre-tokens
KEPT_LENGTHS = 300_000  # pre-tokens whose counts a task remembers


class CountTree:
    """Sums of characters and tokens over the pre-tokens of one text."""

    def __init__(self, words: list[str], split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]]):
        self.split, self.count, self.encoded = split, count, 0
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        self.build()

    def build(self) -> None:
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, leaf in enumerate(self.leaves):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, leaf)), sum(self.count(leaf))
        for i in range(size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and where the leaf begins; the last one for places beyond the end."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node] and (self.chars[node + 1] or place > begin + self.chars[node]):
                begin += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), begin

    def edit(self, begin: int, end: int, text: str) -> None:
        """Replaces the characters from begin to end."""
        first, at = self.leaf_at(max(0, begin - 1))
        while first and begin - at < 2:  # a pre-token before the edit in the region, to begin from
            first -= 1
            at -= self.chars[self.size + first]
        last, last_at = self.leaf_at(end)
        while True:
            old = [w for leaf in self.leaves[first : last + 1] for w in leaf]
            region = "".join(old)
            changed = region[: begin - at] + text + region[end - at :]
            # pre-tokens that end two characters or more before the edit don't see it
            kept, place = 0, at
            while kept < len(old) and place + len(old[kept]) + 1 < begin:
                place += len(old[kept])
                kept += 1
            if kept == 0 and first and self.leaves[first - 1]:
                first -= 1
                at -= self.chars[self.size + first]
                continue
            starts, p = set(), at
            for w in old:
                if p >= end:
                    starts.add(p)
                p += len(w)
            fresh, shift, new, met = self.split(changed[place - at :]), len(text) - (end - begin), place, None
            whole = last == len(self.leaves) - 1
            for i, w in enumerate(fresh):
                if i and new - shift in starts and new >= begin + len(text):
                    met = (i, new - shift)
                    break
                new += len(w)
                if i >= len(fresh) - 2 and not whole:  # the region's end may have changed these
                    break
            if met is None and not whole:
                last = min(len(self.leaves) - 1, last + 1 + (last - first))
                continue
            break
        if met is None:
            middle, tail = fresh, []
        else:
            middle, p, tail = fresh[: met[0]], at, []
            for i, w in enumerate(old):
                if p == met[1]:
                    tail = old[i:]
                    break
                p += len(w)
        self.encoded += len(middle)
        words = old[:kept] + middle + tail
        span = last - first + 1
        if len(words) > 4 * LEAF * span:  # a long insertion: new leaves
            self.leaves[first : last + 1] = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
            self.build()
            return
        share = -(-len(words) // span) if words else 0
        for i in range(span):
            leaf = self.leaves[first + i] = words[i * share : (i + 1) * share]
            node = self.size + first + i
            self.chars[node], self.tokens[node] = sum(map(len, leaf)), sum(self.count(leaf))
        nodes = {(self.size + first + i) // 2 for i in range(span)}
        while nodes and 0 not in nodes:
            for i in nodes:
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            nodes = {i // 2 for i in nodes}

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)


def revision(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query applies: up to 24 characters go at a third of the text, and its first 40 are said again after a space at two thirds of what is left."""
    n = len(text)
    a = n // 3
    b = min(n, a + 24)
    left = n - (b - a)
    return [(a, b, ""), (2 * left // 3, 2 * left // 3, " " + text[:40])]


def edited_counts(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = revision, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text, and after its edits n_tokens_edited and n_reencoded (pre-tokens that were encoded again).

    edits gives (begin, end, text) steps, each on the text that the former has left. A null text counts as empty. Every row gives one, repeated ones too.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"]
    schema = ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        lengths: dict[str, int] = {}

        def count(words: list[str]) -> list[int]:
            new = [w for w in words if w not in lengths]
            if new:
                own.learn(new)
                for w in new:
                    lengths[w] = int(own.lengths[own.known[w]])
            return [lengths[w] for w in words]

        for doc_ids, texts in in_chunks(batches):
            if len(lengths) > KEPT_LENGTHS:
                lengths.clear()
            split = list(map(own.split, texts))
            count(list(set().union(*split)))  # one replay for the chunk
            rows = []
            for text, words in zip(texts, split, strict=True):
                tree = CountTree(words, own.split, count)
                before = tree.total
                for begin, end, new in edits(text):
                    tree.edit(begin, end, new)
                rows.append((len(words), before, tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, *zip(*rows, strict=True))], names=names)
        own.share(None)
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
