"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon is learned: words and word beginnings that are far likelier in texts labelled toxic. They form a trie;
its intersection with the automata of at most one edit (a letter added, lost or replaced at any place, or two neighbours swapped) is walked as one
automaton whose states are sets of (trie node, edits), made when first needed. So a word costs one table look-up a letter, misspelled or not.
A hit inside quotation marks, or close after a word of reporting, counts as a quotation, other hits as abuse; a
logistic score weighs both. Words of reporting are a short list in four languages and what stands before hits in clean texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_hash, sampled_rows, text_of
from .logistic import Logistic

PER_CLASS = 1500  # labelled rows of either class that the fit reads at most
MAX_CHARS = 20_000  # of such a row
THRESHOLD = 0.3
STEM = 3  # letters of a lexicon entry at least
EVIDENCE = 30.0  # log-likelihood ratio that an entry needs
FRESH = 6.0  # and that it needs from documents which fewer than EXPLAINED earlier entries explain
EXPLAINED = 4
PRECISION = 0.9  # of an entry, at equal shares of both classes
KEPT_STATES = 20_000  # of the automaton before it begins anew
REPORTED = 5  # hits in clean texts that a learned word of reporting comes before, at least
WINDOW = 6  # words before and after a hit that make its context
KEPT_WORDS = 400_000  # words that a worker remembers

LETTERS = re.compile(r"\d?[^\W\d_](?:\w*[^\W\d_])?")
DIGIT_LETTERS = str.maketrans("013457", "oieast")
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
REPORTING = frozenset(
    "said says say called calls quoted quotes wrote writes quote reported claims claimed "
    "sagte sagt schrieb schreibt nannte zitiert zitierte "
    "dit écrit écrivait cite citait appelait déclare "
    "dijo dice escribió escribe citó cita llamó".split()
)


def spelled(token: str) -> list[str]:
    """The words in a token, in small letters; digits between letters stand for letters."""
    return [w.translate(DIGIT_LETTERS) for w in LETTERS.findall(token.lower())]


def distinct_rows(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without near copies of earlier ones (they share one of four least hashes of five-word shingles): copies aren't evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 5]).encode() for i in range(max(1, len(words) - 4))]
        least = {(k, min(zlib.crc32(s, k) for s in shingles)) for k in range(4)}
        if not least & seen:
            out.append((text, y))
        seen |= least
    return out


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, bool]:
    """Entries, and whether each stands for all words that begin with it.

    Candidates are words and word beginnings, a beginning in its longest form that keeps its documents. The strongest comes first; each
    further one needs its evidence from toxic documents that few earlier entries explain, so what
    merely stands beside the lexicon's words in copied passages is left out.
    """
    rows = distinct_rows(rows)
    n = [max(1, sum(1 for _, y in rows if y == side)) for side in (0, 1)]
    clean: tuple[Counter, Counter] = (Counter(), Counter())
    toxic: tuple[dict, dict] = ({}, {})  # whole words, beginnings: documents of each
    for number, (text, y) in enumerate(rows):
        words = {w for t in set(text.split()) for w in spelled(t) if len(w) >= STEM}
        for found, kind in ((words, 0), ({w[:k] for w in words for k in range(STEM, len(w) + 1)}, 1)):
            if y:
                for w in found:
                    toxic[kind].setdefault(w, []).append(number)
            else:
                clean[kind].update(found)

    def evidence(hits: int, others: int) -> float:
        """Twice the log-likelihood ratio; 0 below the precision that an entry needs."""
        if not hits or hits / n[1] < PRECISION * (hits / n[1] + others / n[0]):
            return 0.0
        expected = (hits + others) * n[1] / (n[0] + n[1])
        return 2 * (hits * math.log(hits / expected) + (others * math.log(others / max(hits + others - expected, 1e-9)) if others else 0))

    ranked = []
    for kind in (1, 0):
        for w, docs in toxic[kind].items():
            if len(docs) >= 3 and (e := evidence(len(docs), clean[kind][w])) >= EVIDENCE:
                ranked.append((-e, kind == 0, len(w), w))
    lexicon: dict[str, bool] = {}
    explained = Counter()
    for _, is_whole, _, w in sorted(ranked):
        if any(lexicon.get(w[:k]) for k in range(STEM, len(w) + 1)):
            continue
        kind = 0 if is_whole else 1
        docs = toxic[kind][w]
        fresh = [d for d in docs if explained[d] < EXPLAINED]
        if evidence(len(fresh), clean[kind][w]) < FRESH:
            continue
        stem = w
        while kind == 1:  # the longest beginning that keeps its documents
            longer = max((x for x in children(toxic[1], stem)), key=lambda x: len(toxic[1][x]), default=None)
            if longer is None or len(toxic[1][longer]) < 0.95 * len(docs):
                break
            stem = longer
        lexicon[stem] = kind == 1
        explained.update(docs)
    return lexicon


def children(found: dict[str, list[int]], stem: str) -> Iterator[str]:
    """Beginnings longer by one letter."""
    if not hasattr(children, "of") or children.of[0] is not found:
        by: dict[str, list[str]] = {}
        for x in found:
            by.setdefault(x[:-1], []).append(x)
        children.of = (found, by)
    yield from children.of[1].get(stem, ())


class LexiconAutomaton:
    """Trie and edit automata as one; states are numbered as they are met.

    A state holds (node, edits, awaited): where in the trie a reading of the word so far stands, after how many edits, and the letter that must come next if
    two neighbours were swapped. Entries in `exact` are met as they are spelled only.
    """

    def __init__(self, lexicon: dict[str, bool], exact: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.entry: dict[int, str] = {}
        self.begins, self.exact = dict(lexicon), exact
        self.inexact = [False]  # whether an entry that may be misspelled lies below the node
        for word in sorted(lexicon):
            at = 0
            self.inexact[0] |= word not in exact
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.inexact.append(False)
                at = self.children[at][c]
                self.inexact[at] |= word not in exact
            self.entry[at] = word
        self.clear()

    def clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[int] = []  # of each state: 2 if it ends an entry, 1 if with an edit, else 0
        self.begun: list[int] = []  # the same for entries that stand for all that follow; their last letter must have come
        self.entries: list[frozenset[str]] = []  # of each state: entries that end here with an edit
        self.spelled: list[frozenset[str]] = []  # the same without
        self.start = self.number(frozenset({(0, 0, "")}))

    def number(self, read: frozenset) -> int:
        """The state of these readings and of those that come with a lost letter."""
        if read not in self.states:
            lost = {(child, 1, "") for node, edits, awaited in read if not edits and not awaited for child in self.children[node].values() if self.inexact[child]}
            full, begun = self.ends(read | lost), self.ends(read)
            self.states[read] = len(self.sets)
            self.sets.append(read | lost)
            self.steps.append({})
            self.whole.append(max((level for level, _ in full), default=0))
            self.begun.append(max((level for level, word in begun if self.begins[word]), default=0))
            self.spelled.append(frozenset(word for level, word in full if level == 2))
            self.entries.append(frozenset(word for level, word in full if level == 1) - self.spelled[-1])
        return self.states[read]

    def ends(self, read: frozenset) -> list[tuple[int, str]]:
        """(2 as spelled or 1 with an edit, entry) of the readings that end an entry."""
        words = [(2 - edits, self.entry[node]) for node, edits, awaited in read if not awaited and node in self.entry]
        return [(level, word) for level, word in words if level == 2 or word not in self.exact]

    def step(self, at: int, c: str) -> int:
        """-1: no entry can follow any more."""
        read = set()
        for node, edits, awaited in self.sets[at]:
            if awaited:
                if c == awaited:
                    read.add((node, edits, ""))
                continue
            below = self.children[node]
            if c in below:
                read.add((below[c], edits, ""))
            if not edits and self.inexact[node]:
                read.add((node, 1, ""))  # a letter too many
                for first, child in below.items():
                    if self.inexact[child]:
                        read.add((child, 1, ""))  # another letter
                        if c != first and c in self.children[child]:
                            read.add((self.children[child][c], 1, first))  # two neighbours swapped
        found = self.steps[at][c] = self.number(frozenset(read)) if read else -1
        return found

    def walk(self, word: str) -> Iterator[int]:
        """The states after each letter, as far as entries can follow."""
        if len(self.sets) > KEPT_STATES:
            self.clear()
        at = self.start
        for c in word:
            nxt = self.steps[at].get(c)
            at = self.step(at, c) if nxt is None else nxt
            yield at
            if at < 0:
                return

    def loose(self, word: str) -> set[str]:
        """Entries that the word, or for beginnings its start, meets with one edit and not as they are spelled."""
        out, exactly, last = set(), set(), self.start
        for at in self.walk(word):
            if at < 0:
                return out - exactly
            out |= {e for e in self.entries[at] if self.begins[e]}
            exactly |= {e for e in self.spelled[at] if self.begins[e]}
            last = at
        return (out | self.entries[last]) - exactly

    def match(self, word: str) -> int:
        """2: a lexicon word as it is spelled, 1: with one edit, 0: neither."""
        begun, last = 0, self.start
        for at in self.walk(word):
            if at < 0:
                return begun
            if self.begun[at] == 2:
                return 2
            begun, last = max(begun, self.begun[at]), at
        return max(begun, self.whole[last])


class ToxicityModel:
    """Lexicon and calibration.

    The calibration sees no row that its lexicon was learned from: either half of the rows is scored by the other half's lexicon.
    The lexicon that scores documents is learned from all rows.
    """

    def __init__(self, rows: list[tuple[str, int]], share_toxic: float):
        self.share, self.fit = share_toxic, None
        self.learn(rows)
        if len(rows) < 2:
            return
        features, labels = [], []
        halves: tuple[list, list] = ([], [])
        for y in (0, 1):
            for i, row in enumerate(r for r in rows if r[1] == y):
                halves[i % 2].append(row)
        for side, own in enumerate(halves):
            other = ToxicityModel([], share_toxic)
            other.learn(halves[1 - side])
            features.append(other.features([t for t, _ in own]))
            labels += [label for _, label in own]
        y, x = np.array(labels, dtype=int), np.concatenate(features)
        if x.any() and 0 < y.sum() < len(y):
            weight = np.where(y == 1, share_toxic / y.sum(), (1 - share_toxic) / (len(y) - y.sum())) * len(y)
            self.fit = Logistic(x, y, weight, penalty=1e-4)

    def learn(self, rows: list[tuple[str, int]]) -> None:
        self.lexicon, self.exact, self.reporting = learn_lexicon(rows), frozenset(), REPORTING
        self.exact = self.unsafe(rows)
        self.reporting |= self.reports(rows)

    def reports(self, rows: list[tuple[str, int]]) -> frozenset[str]:
        """Words that come shortly before hits in clean texts, and hardly in toxic ones."""
        before, hits = (Counter(), Counter()), [0, 0]
        for text, y in rows:
            tokens = text.split()
            for i, *_ in self.hits(text):
                hits[y] += 1
                before[y].update({t.lower().strip(".,:;") for t in tokens[max(0, i - 2) : i]})
        share = lambda w, y: before[y][w] / max(1, hits[y])
        return frozenset(w for w, n in before[0].items() if n >= REPORTED and share(w, 0) >= PRECISION * (share(w, 0) + share(w, 1)) and len(w) >= STEM)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "known")}

    def unsafe(self, rows: list[tuple[str, int]]) -> frozenset[str]:
        """Entries whose misspellings are ordinary words: more than one in a thousand clean texts has one. They are met exactly only."""
        automaton, met, words, clean = LexiconAutomaton(self.lexicon), Counter(), {}, 0
        for text, y in rows:
            if not y:
                clean += 1
                entries = set()
                for t in set(text.split()):
                    if t not in words:
                        words[t] = set().union(*(automaton.loose(w) for w in spelled(t)))
                    entries |= words[t]
                met.update(entries)
        return frozenset(e for e, n in met.items() if n > 0.001 * clean)

    def hits(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(word position, word, 2 as spelled or 1 with an edit, whether quoted) of each hit."""
        if "automaton" not in self.__dict__:
            self.automaton, self.known = LexiconAutomaton(self.lexicon, self.exact), {}
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        tokens = text.split()
        toxic = set()
        for t in set(tokens):
            found = known.get(t)
            if found is None:
                found = known[t] = max([0, *map(self.automaton.match, spelled(t))])
            if found:
                toxic.add(t)
        if not toxic:
            return []
        return [(i, t, known[t], self.quoted(tokens, i)) for i, t in enumerate(tokens) if t in toxic]

    def quoted(self, tokens: list[str], i: int) -> bool:
        """Whether the context window has the hit inside quotation marks, or just after a word of reporting."""
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        opened = tokens[i][0] in OPENING or any(t[0] in OPENING and t[-1] not in CLOSING for t in before)
        closed = tokens[i].rstrip(".,;:!?")[-1:] in CLOSING or any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in after)
        return opened and bool(closed) or any(t.lower().strip(".,:;") in self.reporting for t in before[-2:])

    def features(self, texts: list[str]) -> np.ndarray:
        """Logarithms of the number of abusive hits, those of them with an edit, and the same of quoted ones: an edit makes no difference unless labels show one."""
        out = np.zeros((len(texts), 4))
        for row, text in zip(out, texts, strict=True):
            for _, _, kind, quoted in self.hits(text):
                row[2 * quoted] += 1
                row[2 * quoted + 1] += kind == 1
        return np.log1p(out)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.fit(self.features(texts)) if self.fit is not None else np.full(len(texts), float(self.share))


def fit_toxicity(labels: DataFrame, docs: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learns from labels.toxic of rows whose crc32(doc_id as text) mod 4 is not 2; their texts are the only input."""
    fold = (label_hash() % 4 != 2) & F.col("toxic").isin(0, 1)
    rows = [(t, y) for _, t, y in sampled_rows(labels, docs, "toxic", fold, per_class, max_chars)]
    n = labels.where(fold).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    return ToxicityModel(rows, (n["toxic"] or 0) / n["n"] if n["n"] else 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score double (higher: toxic is likelier) and predicted int to every row of docs.

    The whole text is read; a null text counts as empty, which has no hits. Rows keep their columns (a column named
    score or predicted is replaced) and are scored where they are read, without a shuffle. With no toxic
    labels, or no word that tells, every row gets the share of toxic labels.
    """
    docs = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    scored = docs.withColumn("score", score(text_of()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
