"""The pipeline's stages against plain versions on the smallest tables."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from channelflow.llm.byte_bpe import load_ranks
from channelflow.llm.compression_quality import fit_quality, score_quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_all_but_the_last_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").dtypes
    assert all(s.dtypes == columns for s in stages[:-1])


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = score_quality(docs, fit_quality(spark.read.parquet(f"{SMALL}/labels.parquet"), docs))
    assert {r["doc_id"] for r in stages[0].collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()}


def test_one_of_each_group_stays(stages):
    before, after = stages[0].collect(), {r["doc_id"] for r in stages[1].collect()}
    sets = {}
    for r in before:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert after == {i for i in ids if find(i) == i}


def test_mix_draws_whole_documents_but_for_one_a_source(stages):
    source = {r["doc_id"]: r for r in stages[2].collect()}
    draws = defaultdict(list)
    for r in stages[3].collect():
        draws[r["source"]].append(r)
    sizes = defaultdict(int)
    for r in source.values():
        sizes[r["source"]] += len(words(r["text"]))
    for s, rows in draws.items():
        cut = [r for r in rows if r["text"] != source[r["doc_id"]]["text"]]
        assert len(cut) <= 1 and all(source[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut)
        assert sum(len(words(r["text"])) for r in rows) <= 2 * sizes[s]
        assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    total = sum(len(words(r["text"])) for rows in draws.values() for r in rows)
    assert total == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_ids_are_the_library_s(stages):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in stages[3].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[4].collect()) == expected


def test_run_equals_the_stages(spark, stages):
    key = lambda df: Counter((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(P.run(spark, SMALL)) == key(stages[-1])


def test_awkward_documents_pass(spark):
    rows = [(1, "a b c d e f", "en", "s", 11, 1.0, "p"), (1, "a b c d e f", "en", "s", 11, 1.0, "p"), (None, None, None, None, None, None, None), (2, "", None, "t", 0, 2.0, "q"), (3, "call +1 (906) 555-7738", "en", "t", 22, 3.0, "r"), (3, "another text of the same id", "en", "t", 27, 3.0, "r"), (None, "a text without id", "en", "t", 17, 3.0, "r"), (None, "a text without id", "en", "t", 17, 3.0, "r"), (4, "z " * 30_000, "en", "s", 60_000, 3.0, "_others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, private string").withColumn("_others", F.lit(7))
    texts = {r["text"] for r in P.keep_one_of_near_copies(spark, docs, SMALL).collect()}
    assert texts == {r["text"] for r in docs.collect()}  # rows with an id of their own text, or none, are documents of their own
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "private", "_others"]
    texts = {r["text"] for r in docs.collect()}
    assert not any("555-7738" in t for t in texts)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
