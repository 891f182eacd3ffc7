"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored by the context of each hit.

The lexicon is learned from labelled documents: words, and stems of words, that toxic documents have and others have
not. All terms form one trie; a word is run through the automaton whose states are sets of (trie node, edits so far),
made as they are needed, so a misspelled term is caught in one pass over its letters, whichever of them are wrong. Hits inside quotation marks, or
near words of reporting, count less; which words report is learned in any language, from those that stand near hits in
clean documents, besides the English ones given. A logistic model on the summed hits gives the score.

Defined cases: an empty or null text scores as one without hits; if no label or only one class was seen, every score is
the prior 0; rows whose label is null teach nothing; of hits of equal weight the last term by name is taken, which
changes no score; repeated rows are scored each for itself; very long texts are read whole; columns of docs other than the
two named are left alone, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, slim

#: Most labelled rows of a class that are learned from, chosen by a hash of their ids.
TRAIN_PER_CLASS = 10_000
#: Least share of toxic documents that have a term, least share of toxic among the documents that have it. The first bounds
#: the terms: there are at most 1 / SUPPORT as many as a toxic document has on average.
SUPPORT, PRECISION = 0.004, 0.97
#: Most likely that a term which has nothing to do with toxicity is in toxic documents alone.
CHANCE = 1e-6
#: Lengths of stems; a term is allowed one edit from MIN_EDIT letters on and a second from MAX_EDIT on.
STEMS, ONE_EDIT, TWO_EDITS = range(4, 9), 5, 10
#: Words on either side of a hit that are looked at for words of reporting, and those given beforehand.
WINDOW = 6
REPORTING = frozenset("said says wrote writes quote quoted quotes called word term means definition".split())
QUOTED, EDITED = 0.3, 0.7
#: Most automaton states that are held at a time.
HELD = 500_000

TOKEN = re.compile(r"[^\s.,;:!?\"“”„«»()\[\]{}<>]+")
_QUOTE_MARKS = re.compile(r"[\"“”„«»]")


@dataclass
class Lexicon:
    """term -> weight; a term that ends in * is a stem and matches any word that begins with it."""

    terms: dict[str, float]
    #: Words that automata match but that innocent documents use as readily.
    innocent: frozenset[str] = frozenset()
    #: (term, edits) -> weight of its misspellings, where it is not the term's own times EDITED for each edit.
    near: dict[tuple[str, int], float] = field(default_factory=dict)
    reporting: frozenset[str] = REPORTING
    _sets: list = field(default_factory=list, repr=False)
    _seen: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        # node: [children, most edits of a term below, terminals (term, edits, is stem)]
        self._nodes: list[list] = [[{}, 0, []]]
        for term in self.terms:
            letters = term.rstrip("*")
            edits = (len(letters) >= ONE_EDIT) + (len(letters) >= TWO_EDITS)
            at = 0
            self._nodes[0][1] = max(self._nodes[0][1], edits)
            for c in letters:
                at = self._nodes[at][0].setdefault(c, len(self._nodes))
                if at == len(self._nodes):
                    self._nodes.append([{}, 0, []])
                self._nodes[at][1] = max(self._nodes[at][1], edits)
            self._nodes[at][2].append((term, edits, term.endswith("*")))
        self._letters = frozenset("".join(self.terms))
        self._forget()

    def _forget(self) -> None:
        # a set of states has a number; by number: its (node, fewest edits), next numbers by letter, hits of stems and words
        self._sets, self._numbers, self._held = [], {}, 0
        self._number({0: 0})

    def _number(self, states: dict[int, int]) -> int:
        """The number of states, together with those that skipping letters of a term leads to."""
        stack = list(states)
        while stack:
            at = stack.pop()
            for child in self._nodes[at][0].values():
                if states[at] < self._nodes[child][1] and states[at] + 1 < states.get(child, 9):
                    states[child] = states[at] + 1
                    stack.append(child)
        key = frozenset(states.items())
        if key not in self._numbers:
            self._numbers[key] = len(self._sets)
            self._held += len(key)
            ends = [(term, e, stem) for at, e in key for term, edits, stem in self._nodes[at][2] if e <= edits]
            self._sets.append((key, {}, self._best(x[:2] for x in ends if x[2]), self._best(x[:2] for x in ends)))
        return self._numbers[key]

    def _best(self, hits) -> tuple[float, str, int] | None:
        return max(((self.near.get((term, e), self.terms[term] * EDITED**e), term, e) for term, e in hits), default=None)

    def _next(self, number: int, c: str) -> int:
        key, moves, _, _ = self._sets[number]
        if c not in moves:
            out: dict[int, int] = {}
            for at, e in key:
                children = self._nodes[at][0]
                if c in children:
                    out[children[c]] = min(e, out.get(children[c], 9))
                if e < self._nodes[at][1]:
                    for to in (at, *[child for child in children.values() if e < self._nodes[child][1]]):
                        out[to] = min(e + 1, out.get(to, 9))
            moves[c] = self._number(out)
        return moves[c]

    def hit(self, word: str) -> tuple[float, str, int] | None:
        """(weight, term, edits) of the weightiest term that the lower-cased word is, begins with or nearly is."""
        if word not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            if self._held > HELD:
                self._forget()
            number, found = 0, []
            for c in word:
                number = self._next(number, c if c in self._letters else "")
                key, _, stems, _ = self._sets[number]
                if not key:
                    break
                found.append(stems)
            else:
                found.append(self._sets[number][3])
            self._seen[word] = max(filter(None, found), default=None)
        return self._seen[word]

    def match(self, word: str) -> float:
        """Weight of the word's hit; 0 if there is none or the word is innocent."""
        found = self.hit(word)
        return found[0] if found and word not in self.innocent else 0.0

    def contexts(self, text: str | None) -> dict[str, float]:
        """word that hits -> the most that a context of it in text counts."""
        low, out = (text or "").lower(), {}
        words = TOKEN.findall(low)
        if any(self.hit(w) for w in set(words)):
            for k, m in enumerate(TOKEN.finditer(low)):
                if self.hit(m.group()):
                    out[m.group()] = max(out.get(m.group(), 0.0), self._context(low, words, k, m.start()))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weight of the hits in their contexts, and that per hundred words."""
        low = (text or "").lower()
        words = TOKEN.findall(low)
        if not any(self.match(w) for w in set(words)):
            return 0.0, 0.0
        total = 0.0
        for k, m in enumerate(TOKEN.finditer(low)):
            if weight := self.match(m.group()):
                total += weight * self._context(low, words, k, m.start())
        return total, 100 * total / len(words)

    def neighbours(self, text: str | None) -> set[str]:
        """Words within WINDOW words of a hit that counts; none of them is one."""
        words = TOKEN.findall((text or "").lower())
        hits = {w for w in set(words) if self.match(w)}
        near = (words[max(0, k - WINDOW) : k + WINDOW + 1] for k, w in enumerate(words) if w in hits) if hits else ()
        return set().union(*near) - hits

    def _context(self, low: str, words: list[str], k: int, at: int) -> float:
        line = low[low.rfind("\n", 0, at) + 1 : at]
        if len(_QUOTE_MARKS.findall(line)) % 2 or self.reporting & set(words[max(0, k - WINDOW) : k + WINDOW + 1]):
            return QUOTED
        return 1.0


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """True where crc32 of the id as text leaves `fold`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(text, label) of at most about per_class rows of each label; the ids chosen are so few that they are broadcast."""
    known = slim(labels, id=id_col, label=label_col).filter(teaches & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rank = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = known.filter(rank < share * 1_000_000)
    return checkpoint(slim(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("text", F.col("label").cast("int").alias("label")))


def _terms_of(text: str | None) -> set[str]:
    words = set(TOKEN.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame, support: float = SUPPORT, precision: float = PRECISION) -> Lexicon:
    """Terms by document counts in the two classes; only terms that pass reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                (toxic if label else other).update(_terms_of(text))
        out = [(t, toxic[t], other[t]) for t in toxic | other]
        yield pd.DataFrame(out, columns=["term", "toxic", "other"])

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({})
    ratio = F.col("toxic") / sizes[1] / (F.col("toxic") / sizes[1] + F.col("other") / sizes[0])
    counted = rows.mapInPandas(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    by_chance = math.log(CHANCE) / math.log(sizes[1] / (sizes[0] + sizes[1]))
    passed = counted.filter((F.col("toxic") >= max(by_chance, support * sizes[1])) & (ratio >= precision)).select("term", ratio.alias("weight"))
    best = {r.term: r.weight for r in passed.orderBy("term").collect()}
    # a term is implied by a shorter stem that passed, and a stem by its one whole word
    implied = lambda t: any(t[:n] + "*" in best for n in range(1, len(t.rstrip("*"))))
    weighed = _weighed(rows, Lexicon({t: w for t, w in best.items() if not implied(t)}), frozenset(best), sizes, precision)
    return replace(weighed, reporting=REPORTING | _learned_reporting(rows, weighed, precision))


def _weighed(rows: DataFrame, lexicon: Lexicon, passed: frozenset[str], sizes: dict[int, int], precision: float) -> Lexicon:
    """lexicon with its innocent words and the weights of misspellings, from how often words that hit are in either class.

    A document counts as much as the best context of the word in it. A word that is not a passed term is innocent if the
    share of toxic documents is below what terms must have; a term's misspellings weigh less the more of them are clean.
    """

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                (toxic if label else other).update(lexicon.contexts(text))
        out = [(w, float(toxic[w]), float(other[w])) for w in toxic | other]
        yield pd.DataFrame(out, columns=["word", "toxic", "other"])

    hits = rows.mapInPandas(matched, "word string, toxic double, other double").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    innocent, edited = set(), {}
    for word, toxic, other in hits.collect():  # words within an edit or two of a term, in the training rows
        share = toxic / sizes[1] / (toxic / sizes[1] + other / sizes[0])
        if word not in passed and share < precision:
            innocent.add(word)
        _, term, e = lexicon.hit(word)
        if e and word not in passed:
            t, o = edited.get((term, e), (1.0, 0.0))
            edited[term, e] = (t + toxic, o + other)
    near = {}
    for (term, e), (toxic, other) in edited.items():
        share = toxic / sizes[1] / (toxic / sizes[1] + other / sizes[0])
        near[term, e] = lexicon.terms[term] * EDITED**e * max(0.0, 2 * share - 1)
    return Lexicon(lexicon.terms, frozenset(innocent), near)


def _learned_reporting(rows: DataFrame, lexicon: Lexicon, precision: float) -> frozenset[str]:
    """Words that stand near hits in clean documents and hardly ever in toxic ones, more often than by chance."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                if near := lexicon.neighbours(text):
                    (toxic if label else other).update(near | {""})  # "" counts the documents, no word is empty
        out = [(w, toxic[w], other[w]) for w in toxic | other]
        yield pd.DataFrame(out, columns=["word", "toxic", "other"])

    counted = checkpoint(rows.mapInPandas(count, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    whole = counted.filter("word = ''").first()
    if whole is None or not whole.toxic or not whole.other:
        return frozenset()
    by_chance = math.log(CHANCE) / math.log(whole.other / (whole.toxic + whole.other))
    clean = F.col("other") / whole.other / (F.col("other") / whole.other + F.col("toxic") / whole.toxic)
    passed = counted.filter((F.col("word") != "") & (F.col("other") >= by_chance) & (clean >= precision))
    return frozenset(r.word for r in passed.select("word").collect())


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, float, float]

    def score(self, text: str | None) -> float:
        a, b = self.lexicon.features(text)
        z = self.weights[0] + self.weights[1] * math.log1p(a) + self.weights[2] * math.log1p(b)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; classes weigh the same."""
    x = np.column_stack((np.ones(len(x)), np.log1p(x)))
    s = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(3), ridge * len(y) * np.eye(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (s * p * (1 - p))[:, None]) + penalty, x.T @ (s * (y - p)) - penalty @ w)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model:
    rows = training_rows(docs, labels, teaches, id_col, text_col, label_col, per_class)
    lexicon = learn_lexicon(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found], "label": batch["label"]})

    data = rows.mapInPandas(measure, "a double, b double, label int").toPandas()  # three numbers a training row
    if data["label"].nunique() < 2:
        return Model(lexicon, (-30.0, 0.0, 0.0))
    return Model(lexicon, _fit(data[["a", "b"]].to_numpy(), data["label"].to_numpy()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score, predicted."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [model.score(t) for t in batch["text"]]})

    rows = slim(docs, id=id_col, text=text_col).mapInPandas(judge, f"id {dict(docs.dtypes)[id_col]}, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
