"""Fill-in-middle transformation with an index of distinct texts.

Equal texts are grouped by a 64-bit hash and told apart by their content. Each distinct text gets one Elias-Fano list of the bytes at which
its code points begin: low bits packed, high bits in unary with a count for every block, about two bits a code point. Documents
meet the list of their text again, and each selects the two cuts that its seed asks for, so a cut needs no pass over the text.

A text crosses the exchange once for every task that holds it, its copies as ids only. Copies of a text that would fill more than a task's usual share are dealt
over several shares, each with a list of its own; there are at most as many such texts as tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED = 90  # per cent of the texts that aren't left plain
SUFFIX_FIRST = 20  # per cent of those that begin with the suffix
BLOCK = 512  # bits of the high part that one count stands for


class EliasFano:
    """A rising list of numbers below `limit`, in about 2 + log2(limit / length) bits each; select(i) gives the i-th."""

    def __init__(self, values: np.ndarray, limit: int):
        n = self.n = len(values)
        self.low_bits = max(0, (limit // max(1, n)).bit_length() - 1)
        high = (values >> self.low_bits) + np.arange(n)
        size = -(-(int(high[-1]) + 1 if n else 1) // BLOCK) * BLOCK
        bits = np.zeros(size, dtype=np.uint8)
        bits[high] = 1
        self.ranks = np.concatenate(([0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))))
        self.high = np.packbits(bits)
        each = np.arange(self.low_bits)
        self.low = np.packbits(((values[:, None] >> each) & 1).astype(np.uint8)) if self.low_bits else np.zeros(0, dtype=np.uint8)

    def select(self, i: int) -> int:
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        at = block * BLOCK + int(np.flatnonzero(bits)[i - self.ranks[block]])
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit >> 3]) >> (7 - (bit & 7)) & 1) << k
        return ((at - i) << self.low_bits) | low


class TextIndex:
    """A distinct text's bytes, where its code points begin, and whether it may be cut at all."""

    def __init__(self, raw: bytes):
        self.raw = raw
        begins = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
        self.n = len(begins)
        self.places = EliasFano(np.append(begins, len(raw)), len(raw) + 1)
        self.whole = not raw or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE))

    def parts(self, begin: int, end: int) -> tuple[bytes, bytes, bytes]:
        one, two = self.places.select(begin), self.places.select(end)
        return self.raw[:one], self.raw[one:two], self.raw[two:]


def transformed(index: TextIndex, seeds: tuple[int, int, int, int], share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, bytes]:
    """form, code points of prefix and middle (None if plain) and the output."""
    if index.whole or seeds[2] % 100 >= share:
        return "plain", None, None, index.raw
    begin, end = sorted((seeds[0] % (index.n + 1), seeds[1] % (index.n + 1)))
    prefix, middle, suffix = index.parts(begin, end)
    p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
    spm = seeds[3] % 100 < suffix_first
    return "spm" if spm else "psm", begin, end - begin, (s + p if spm else p + s) + m


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that output and form were made of; marks tell the parts, as no text that holds one is cut."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    at = lambda mark: F.locate(mark, output)
    between = lambda begin, end: F.substr(output, begin + 3, end - begin - 3)
    p, s, m, end = at(PREFIX), at(SUFFIX), at(MIDDLE), F.char_length(output) + 1
    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def seeded(doc_id: str = "doc_id") -> list[Column]:
    """h1 to h4: the first 8-digit groups of the hash of `1:` and the decimal id, as numbers. Of a null id, of `1:` alone."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain) and output of every row of docs(doc_id, text).

    `share` per cent of the texts are cut, of these `suffix_first` per cent begin with their suffix. A null text counts as empty; empty texts and those that hold a mark stay plain.
    Repeated rows are rows of their own with equal results, since seeds come from doc_id; a null doc_id has a seed of its own. Further columns are dropped.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.groupBy("key").agg(F.count("*").alias("copies"))
    # texts that would fill more than a task's share of the rows: fewer than tasks
    total = docs.count()
    many = counts.where(F.col("copies") * tasks > total).select("key", F.ceil(F.col("copies") * tasks / F.lit(max(1, total))).cast("int").alias("shares"))
    dealt = docs.join(F.broadcast(many), "key", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.coalesce("shares", F.lit(1))).cast("int"))
    rows = dealt.select("key", "part", "doc_id", *seeded(), "text", F.unhex(F.sha2("text", 256)).alias("digest"))

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A text only where the task meets it first for this share; all rows keep id and digest."""
        met: set[tuple[bytes, int]] = set()
        for batch in batches:
            texts = batch["text"].tolist()
            for i, seen in enumerate(zip(batch["digest"], batch["part"], strict=True)):
                if seen in met:
                    texts[i] = None
                met.add(seen)
            yield batch.assign(text=pd.Series(texts, index=batch.index, dtype=object), doc_id=batch["doc_id"].astype("Int64"))

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by key and share, those with a text first: the lists of one key are all that is held."""
        of, held = None, {}
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("key", "part", "h1", "h2", "h3", "h4", "text", "digest"))
            for doc_id, key, part, h1, h2, h3, h4, text, digest in zip(batch["doc_id"].astype("Int64"), *columns, strict=True):
                if (key, part) != of:
                    of, held = (key, part), {}
                if text is not None:
                    raw = text.encode("utf-8", "surrogatepass")
                    if digest not in held:
                        held[digest] = TextIndex(raw)
                    elif held[digest].raw != raw:
                        raise ValueError("different texts have one digest")
                index = held[digest]
                form, before, middle, output = transformed(index, (h1, h2, h3, h4), share, suffix_first)
                out.append((doc_id, index.n, form, before, middle, output.decode("utf-8", "surrogatepass")))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame.astype({c: "Int64" for c in ("doc_id", "prefix_chars", "middle_chars")})
        release_memory()

    schema = "key long, part int, doc_id long, h1 long, h2 long, h3 long, h4 long, text string, digest binary"
    laid = rows.mapInPandas(thinned, schema).repartition(tasks, "key", "part")
    laid = laid.sortWithinPartitions("key", "part", F.col("text").isNull())
    return laid.mapInPandas(cut_texts, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


#: The digests of op12, for DuckDB.
MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM g
"""
