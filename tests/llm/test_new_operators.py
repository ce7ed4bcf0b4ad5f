"""MinHash near-dedup, fill-in-middle and ranked search: against brute force, round trips, and on awkward tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelflow.llm import common, minhash_dedup
from channelflow.llm.fill_middle import EliasFano, TextIndex, fill_in_middle, restored
from channelflow.llm.lexical_search import bisected, gap_cost, ranked_documents, terms_of
from channelflow.llm.minhash_dedup import differing, hash_functions, half_keys, minhashes, most_differing, near_duplicates, sketch
from channelflow.llm.shingle_join import linked_documents, shingles

DOCS = "doc_id long, text string, key long, sid long, n long, part int, score double, item_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 0.5, 6) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def awkward():
    long = " ".join(f"word{i % 997} other{i}" for i in range(30_000))
    return [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "é中😀 " * 3),
        (None, "no id here at all"), (None, None), (7, "ONE two three four five SIX"), (8, "a"), (9, "text with <P> a mark"), (10, "\x00\x1f\x7f"),
    ]


def word_sets(rows, words):
    out = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(words, len(found))
        out.append({tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set())
    return out


def brute_components(rows, words, percent):
    sets, parent = word_sets(rows, words), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links += sets[i] != sets[j]
    named = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            named[root(i)] = min(doc_id, named.get(root(i), doc_id))
    return [(d, len(s), named.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], links


def edited_copies(seed, groups=12, copies=9):
    """Groups of near copies around the threshold, some without id, and texts of their own."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.choice([None, len(rows), len(rows), len(rows)]), " ".join(words)))
    rng.shuffle(rows)
    return rows


def by_row(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = edited_copies(seed)
    want, links = brute_components(rows, 3, 85)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()]
    assert links > 50 and by_row(got) == by_row(want)


@pytest.mark.parametrize("seed", range(2))
def test_shingle_join_takes_rows_without_id_as_documents(spark, seed):
    rows = edited_copies(seed + 10)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in linked_documents(frame(spark, rows)).collect()]
    assert by_row(got) == by_row(brute_components(rows, 4, 85)[0])


def test_near_duplicates_on_awkward_rows(spark, awkward):
    got = near_duplicates(frame(spark, awkward)).collect()
    assert by_row([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == by_row(brute_components(awkward, 3, 85)[0])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    none = near_duplicates(frame(spark, awkward).limit(0))
    assert none.columns == ["doc_id", "n_shingles", "component_id", "kept"] and none.count() == 0


def test_star_of_near_copies_and_far_arms(spark):
    """Arms link with the centre but not with one another; one more text links with an arm only."""
    base = [f"w{i}" for i in range(103)]
    rows = [(100, " ".join(base))]
    for a in range(12):
        words = list(base)
        words[5 * a : 5 * a + 3] = [f"arm{a}_{i}" for i in range(3)]
        words[60 + 3 * a] = f"arm{a}"
        rows.append((a, " ".join(words)))
    want, _ = brute_components(rows, 3, 85)
    assert by_row([(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()]) == by_row(want)


def shuffles_kept(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"/shuffle_(\d+)_", files))


def test_shuffles_go_with_their_action(spark):
    before = shuffles_kept(spark)
    with common.shuffles_removed(spark):
        made = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.monotonic() + 10
    while (left := shuffles_kept(spark) - before) and time.monotonic() < until:  # files go a little after their action
        time.sleep(0.2)
    assert not left and made.count() == 7


def test_near_duplicates_remove_each_steps_shuffles(spark, monkeypatch):
    rows, setting, seen = edited_copies(20, groups=4), "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    was = spark.conf.get(setting)
    monkeypatch.setattr(minhash_dedup, "cut", lambda df: (seen.append(spark.conf.get(setting)), common.cut(df))[1])
    found = near_duplicates(frame(spark, rows))
    assert len(seen) > 8 and set(seen) == {"true"} and spark.conf.get(setting) == was
    want = by_row(brute_components(rows, 3, 85)[0])
    for _ in range(2):  # the result is built outside, so it can be run again
        assert by_row([(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]) == want


def test_halves_of_equal_sets_agree_and_similar_sets_meet():
    functions, rng, met, differ = hash_functions(48), np.random.default_rng(5), 0, []
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        other = np.concatenate((s[81:], rng.integers(0, 1 << 63, 81, dtype=np.uint64)))  # similarity 0.85
        one, two = minhashes(s, functions), minhashes(other, functions)
        assert (minhashes(s[::-1], functions) == one).all()
        agree = half_keys(one) == half_keys(two)
        met += agree[:8].any() and agree[8:].any()
        differ.append(int((one != two).sum()))
    assert met >= 297 and abs(np.mean(differ) - 48 * 0.15) < 0.6
    assert max(differ) <= most_differing(48, 85) < 30


def test_differing_counts_groups_of_bits(spark):
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 1 << 63, 48, dtype=np.uint64), rng.integers(0, 1 << 63, 48, dtype=np.uint64)
    two[:20] = one[:20]
    a, b = sketch(one).view(np.int64).tolist(), sketch(two).view(np.int64).tolist()
    want = sum((x >> 4 * k & 15) != (y >> 4 * k & 15) for x, y in zip(a, b, strict=True) for k in range(16))
    row = spark.range(1).select(differing([F.lit(x) for x in a], [F.lit(x) for x in b]).alias("d")).first()
    assert row.d == want <= 28


@pytest.mark.parametrize("text", ["", "a", "plain words", "é中😀 mixed ñ", "😀" * 700, "中文" * 3000 + "abc", "x" * 5000 + "é"])
def test_elias_fano_selects_every_boundary(text):
    index = TextIndex(text.encode())
    want = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert index.n == len(text) and [index.places.select(i) for i in range(len(want))] == want


def test_elias_fano_of_sparse_numbers():
    values = np.array([0, 5, 5000, 5001, 999_999, 7_000_000])
    assert [EliasFano(values, 8_000_000).select(i) for i in range(6)] == values.tolist()


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(text), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_version_and_restores(spark, awkward):
    rng = random.Random(1)
    rows = awkward + [(i, "".join(rng.choice("ab é中😀<>PSM") for _ in range(rng.randrange(40)))) for i in range(100, 400)]
    rows += [(i, "a text that a third of all rows share") for i in range(1000, 1160)]  # a hot group
    made = fill_in_middle(frame(spark, rows)).withColumn("back", restored("output", "form")).collect()
    assert by_row([tuple(r)[:6] for r in made]) == by_row([plain_middle(*r) for r in rows])
    assert Counter((r.doc_id, r.back) for r in made) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame(spark, rows).limit(0)).count() == 0


def plain_ranking(items, rows, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    of = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(of(t)), len(of(t))) for i, t in rows]
    n_docs, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in docs:
            if n:
                m = 25 + (75 * n * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in of(text) if c[w])
                if score > 0:
                    scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


def test_ranking_equals_brute_force_and_breaks_ties_by_id(spark, awkward):
    rng = random.Random(2)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = awkward + [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(100, 900)]
    rows += [(i, "common tie text") for i in range(2000, 2030)] + [(-5, "common tie text")]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(25)]
    items += [(50, "common tie"), (51, "Nothing here matches0"), (52, ""), (53, None), (54, "one ONE one"), (None, "common é中😀"), (55, "HERE at")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = by_row(plain_ranking(items, rows))
    assert by_row([tuple(r) for r in ranked_documents(table, frame(spark, rows)).collect()]) == want
    # several blocks of items
    assert by_row([tuple(r) for r in ranked_documents(table, frame(spark, rows), terms_a_block=60).collect()]) == want
    assert ranked_documents(table, frame(spark, rows).limit(0)).count() == 0
    assert ranked_documents(table.limit(0), frame(spark, rows)).count() == 0


def test_terms_fold_ascii_only():
    assert terms_of("Ab-cÉ d_é x\x00Y {z}~") == [b"ab", "cÉ".encode(), b"d", "é".encode(), b"x", b"y", b"z"]


def test_bisection_gathers_documents_that_share_terms():
    rng = np.random.default_rng(4)
    topic = rng.integers(0, 8, 512)
    docs = np.repeat(np.arange(512), 12)
    terms = topic[docs] * 40 + rng.integers(0, 40, len(docs))
    edges = np.unique(np.stack((docs, terms)), axis=1)
    leaf = bisected(edges[0], edges[1], 512, leaf=64)
    assert np.bincount(leaf).tolist() == [64] * 8
    pure = np.mean([np.bincount(topic[leaf == k]).max() / 64 for k in range(8)])

    def cost(group):
        per = np.zeros((8, 320))
        np.add.at(per, (group[edges[0]], edges[1]), 1)
        return gap_cost(per, 64).sum()

    assert pure > 0.6 and cost(leaf) < 0.8 * cost(np.arange(512) // 64)


def test_shingles_of_three_words():
    assert len(shingles("a b c d", 3)) == 2 and len(shingles("a b", 3)) == 1 and len(shingles(" ", 3)) == 0
