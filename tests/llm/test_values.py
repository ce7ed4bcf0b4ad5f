"""Values that must hold whatever the design: likeness between weights, one-to-one pseudonyms, bounds of what is shared, keys of rows without id."""

import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from channelflow.llm import byte_bpe
from channelflow.llm.html_text import candidates, main_text, marked_text
from channelflow.llm.private_data import pseudonymise
from channelflow.llm.source_mix import LEAST_BINS, plan_mix, taken_words
from channelflow.llm.weighted_fingerprint import WeightedSampler, likeness


@pytest.mark.parametrize("one, two", [(1, 2), (1, 3), (2, 3), (1, 7), (4, 5)])
def test_likeness_of_texts_that_differ_in_counts_only(one, two):
    own = WeightedSampler(samples=4096, kept=512, recent=64)
    words = [f"word{i}" for i in range(300)]
    got = likeness(own.signature(" ".join(words * one)), own.signature(" ".join(words * two)))
    true = one / two
    assert abs(got - true) < 2.5 * math.sqrt(true * (1 - true) / 4096)


def test_likeness_of_mixed_counts():
    rng = np.random.default_rng(2)
    own = WeightedSampler(samples=4096, kept=512, recent=64)
    x, y = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    text = lambda w: " ".join(f"w{i}" for i, n in enumerate(w) for _ in range(n))
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs(likeness(own.signature(text(x)), own.signature(text(y))) - true) < 2.5 * math.sqrt(true * (1 - true) / 4096)


def test_mail_boxes_are_permuted_one_to_one(spark):
    """All boxes of two letters, and of three of a few letters, hexadecimal ones among them."""
    boxes = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)] + ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", "abcfgz", "abfgxyz")]
    got = pseudonymise(spark.createDataFrame([(f"{b}@site.example.org",) for b in boxes], "text string"), "key")
    assert got.select("text").distinct().count() == len(boxes)


def test_hexadecimal_secrets_stay_hexadecimal(spark):
    rng = np.random.default_rng(3)
    given = ["".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40)) + "a1" for _ in range(50)]
    got = [r.text for r in pseudonymise(spark.createDataFrame([(g,) for g in given], "text string"), "key").collect()]
    assert all(set(x) <= set("0123456789abcdef") and x != g for x, g in zip(got, given, strict=True)) and len(set(got)) == 50


@pytest.mark.parametrize("bits", [2, 4, 12])
def test_never_more_words_are_shared_than_asked_for(spark, monkeypatch, bits):
    """Even if all words have one count, or few leading bits tell counts apart."""
    monkeypatch.setattr(byte_bpe, "COUNT_BITS", bits)
    rows = [(i, " ".join(f"w{k}x" for k in range(300)) + " " + " ".join(f"r{k}" for k in range(40) for _ in range(k + 2))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for most in (5, 60, 200):
        words = {r["w"].strip() for r in byte_bpe.shared_ids(docs, path, public_tokenizers.PATTERN, most).to_pylist()}
        assert not any(w.startswith("w") for w in words) and len(words) <= 2 * most
    assert byte_bpe.shared_ids(docs, path, public_tokenizers.PATTERN, 1000).num_rows >= 300


def test_mix_of_rows_without_id_spreads_and_repeats(spark):
    rows = [(None, f"text {i} of {'many ' * (i % 7)}words", "a") for i in range(3000)] + [(5, f"one id {i}", "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = plan_mix(docs).withColumn("b", F.col("rank"))
    assert planned.groupBy("source").agg(F.countDistinct("rank").alias("n")).where("n <> 3000").count() == 0
    one, two = (sorted(map(str, taken_words(d).select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    by_text = [{(r.text, r.rank) for r in plan_mix(d).select("text", "rank").collect()} for d in (docs, docs.repartition(5))]
    assert by_text[0] == by_text[1] and LEAST_BINS > 1


def test_pipeline_keeps_the_same_row_of_those_equal_in_id_and_text(spark):
    rows = [(1, "one two three four five six", s, k) for k, s in enumerate("abcdef")] + [(None, "no id in this row at all", s, 9) for s in "xy"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    kept = [sorted(map(tuple, pipeline.keep_one_of_near_copies(spark, d, "").select("doc_id", "source", "extra").collect()), key=str) for d in (docs, docs.orderBy(F.desc("source")), docs.repartition(5))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def article(title, *paragraphs):
    return f"<html><head><title>{title} &amp; more</title></head><body><nav>menu of the site</nav><article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body></html>"


def test_headings_that_articles_share_stay(spark):
    """Every article of the host has one long title and one long notice; the title is its own, the notice isn't."""
    title = "A long heading that all of the articles of this one host have in common"
    notice = "This notice stands below each article of the host and says nothing of it at all"
    own = [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(40)]
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", article(title, t, notice)) for i, t in enumerate(own)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in main_text(pages).collect()} == {(i, f"{title}\n{t}") for i, t in enumerate(own)}


def test_a_teaser_does_not_replace_the_body():
    body = "The body of the page has many words and stands in a plain element. " * 8
    assert body.strip() in marked_text(f"<article>Teaser.</article><div><p>{body}</p></div>")
    assert marked_text(article("T", body)) == f"T\n{body.strip()}"


def test_part_of_a_class_names_no_paragraph_of_the_article():
    page = article("T", "x").replace("<p>x</p>", '<p class="lead story-comment">Important paragraph</p><p class="comment">a reader says</p><div class="site-footer">foot</div>')
    assert candidates(page) == [("T", True), ("Important paragraph", False)]


def test_lines_that_some_articles_share_stay(spark):
    """A licence line below a third of the articles is theirs; what all pages have goes, copies of one page count once."""
    line = "This work and all parts of it are licensed under some public licence of version three"
    notice = "This notice stands below each article of the host and says nothing of it at all"
    own = [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(30)]
    html = [article(f"T{i}", t, *[line] * (i % 3 == 0), notice) for i, t in enumerate(own)]
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", h) for i, h in enumerate(html)] + [(100 + i, f"https://h.example/copy{i}", html[0]) for i in range(60)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert all(got[i] == "\n".join([f"T{i}", own[i], *[line] * (i % 3 == 0)]) for i in range(30)) and all(got[100 + i] == got[0] for i in range(60))
