"""What steps hold at once, and what a worker draws again."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from channelflow.llm.byte_bpe import Encoder, Strings
from channelflow.llm.shingle_join import COUNTERS, count_in_place
from channelflow.llm.weighted_fingerprint import WeightedSampler


def peak_of(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_picked_strings_take_few_times_their_bytes():
    decimals = Strings([b"%d " % i for i in range(50_000)])
    numbers = np.random.default_rng(1).integers(0, 50_000, 1_000_000)
    runs = np.array([1, 0, 399_999, 600_000])
    got, peak = peak_of(lambda: decimals.of_runs(numbers, runs))
    ends = np.cumsum(runs)
    assert got == [b"".join(b"%d " % i for i in numbers[e - n : e].tolist()) for e, n in zip(ends, runs, strict=True)]
    assert decimals.of_runs(numbers[:0], np.array([0, 0])) == [b"", b""]
    assert peak < 8 * sum(map(len, got))


def test_forgetting_goes_back_to_what_is_shared():
    own = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    words = [f" word{i}" for i in range(20_000)]
    ids = own.replay.encode([w.encode() for w in words])
    shared = pa.table({"w": words, "ids": pa.array(ids, pa.list_(pa.int32()))})
    shared = pa.concat_tables([shared.slice(0, 7000), shared.slice(7000)])
    own.share(shared)
    own.learn([" another", "word"])
    assert len(own.known) == 20_002
    _, peak = peak_of(own.forget)
    assert peak < 100_000  # no second table of what is shared
    assert list(own.known) == words
    assert own.ids([words])[0].tolist() == [i for x in ids for i in x]
    own.learn([" third"])
    assert own.ids([[" third"]])[0].tolist() == own.replay.encode([b" third"])[0]


def test_shingles_are_counted_without_a_second_array_of_counters():
    found = np.random.default_rng(2).integers(0, 1 << 63, 10_000, dtype=np.uint64)
    found = np.concatenate((found, found[:500], found[:500]))
    total = np.zeros(1 << COUNTERS, dtype=np.uint32)
    _, peak = peak_of(lambda: count_in_place(total, found))
    assert peak < 1_000_000
    assert (total == np.bincount((found >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)).all()


def test_stages_hand_texts_to_python_in_bounded_batches(spark):
    docs = spark.createDataFrame([(i,) for i in range(40)], "doc_id long").select("doc_id", F.repeat(F.lit("ab "), 70_000).alias("text")).coalesce(1)
    spark.conf.unset(P.BATCH_SETTING)
    try:
        encoded = P.encode(spark, docs, "")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

        assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] <= P.BATCH_BYTES + 250_000
        assert [r["n"] for r in encoded.groupBy("doc_id").agg(F.count("*").alias("n")).collect()] == [1] * 40
        spark.conf.set(P.BATCH_SETTING, 1 << 20)
        P.bound_batches(spark)
        assert spark.conf.get(P.BATCH_SETTING) == str(1 << 20)
    finally:
        spark.conf.unset(P.BATCH_SETTING)


def test_terms_met_lately_are_not_drawn_again():
    """However many others were met before, and whatever their weights."""
    own, drawn, draws = WeightedSampler(kept=4096, recent=64), [], WeightedSampler.draws
    own.draws = lambda terms: drawn.extend(terms) or draws(own, terms)
    own.signature(" ".join(f"early{i}" for i in range(10_000)))
    text = " ".join(f"w{i} " * (1 + i % 3) for i in range(1000))
    first = own.signature(text)
    own.signature(" ".join(f"between{i}" for i in range(1000)))
    drawn.clear()
    assert (own.signature(text) == first).all() and not drawn
    assert (WeightedSampler().signature(text) == first).all()
    assert len(own.place) <= 4096 + 64 and all(own.terms[i] == w for w, i in own.place.items())
