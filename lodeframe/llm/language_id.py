"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; the vector of a trigram binds the letters' vectors, each permuted by its
place (a rotation); a text is the bundle (sum) of its trigrams, a language the bundle of its texts, each scaled to length
1, and the language with the highest cosine is predicted. A process holds the letters' vectors and the prototypes, and of
a text the trigrams of one block at a time.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be
learned; rows with null lang teach nothing; ties go to the language first by code point; a very long text is bundled whole;
rows that repeat or share an id are predicted each for itself, and teach as often as they are there; columns besides those
named are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import slim

#: Classes of letters (0: anything else, which parts words) and length of the vectors.
SYMBOLS, DIMENSIONS = 4096, 1024
#: About so many documents of a language are learned from, chosen by a hash of their ids.
TRAIN_PER_LANGUAGE = 20_000
#: Trigrams that are bound at a time.
BLOCK = 4096
#: A text's vector of length 1 counts in units of this in its language's sum, so that sums are exact in any order.
UNIT = 1 << 20

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: a-z have their own, other letters share 4057, so that those of one script hardly meet."""
    if not _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint16)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % 4057
        _CLASSES.append(table)
    return _CLASSES[0]


def trigrams(text: str | None) -> np.ndarray:
    """Trigram numbers of a text, lower-cased, with every run of other characters as one gap; empty without a letter."""
    marks = _classes()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    marks = np.concatenate(([0], marks, [0])).astype(np.int64)
    marks = marks[np.concatenate(([True], (marks[1:] != 0) | (marks[:-1] != 0)))]
    if len(marks) < 3:
        return np.empty(0, dtype=np.int64)
    return (marks[:-2] * SYMBOLS + marks[1:-1]) * SYMBOLS + marks[2:]


_LETTERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def letter_vectors(seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they are bound at the first, second and third place of a trigram; 4 MB each."""
    if seed not in _LETTERS:
        last = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))
        _LETTERS[seed] = (np.roll(last, 2, 1), np.roll(last, 1, 1), last)
    return _LETTERS[seed]


def bundle(text: str | None, seed: int = 0) -> np.ndarray:
    """The sum of the text's trigram vectors."""
    first, second, third = letter_vectors(seed)
    codes, n = np.unique(trigrams(text), return_counts=True)
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(codes), BLOCK):
        c = codes[at : at + BLOCK]
        bound = first[c // SYMBOLS**2] * second[c // SYMBOLS % SYMBOLS] * third[c % SYMBOLS]
        out += n[at : at + BLOCK].astype(np.float32) @ bound.astype(np.float32)
    return out


@dataclass
class Profiles:
    """Languages in code-point order, and their prototypes, one row each, of length 1."""

    languages: list[str]
    prototypes: np.ndarray
    seed: int = 0


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, seed: int = 0) -> Profiles:
    """Profiles from the rows where teaches (a column over id) holds. Texts are bundled in the executors; DIMENSIONS
    numbers a language reach the driver."""
    rows = slim(docs, id=id_col, text=text_col, lang=lang_col).filter(teaches & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F
    for lang, n in counts.items():
        share = share.when(F.col("lang") == lang, min(1.0, per_language / n))
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS)), seed)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = bundle(text, seed)
                length = np.linalg.norm(own)
                if length:
                    total = sums.setdefault(lang, np.zeros(DIMENSIONS, dtype=np.int64))
                    total += np.rint(own / length * UNIT).astype(np.int64)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(DIMENSIONS, dtype=np.int32), "value": total})

    chosen = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    parts = chosen.mapInPandas(summed, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas()
    languages = sorted(parts["lang"].unique())
    prototypes = np.zeros((len(languages), DIMENSIONS))
    prototypes[parts["lang"].map({lang: k for k, lang in enumerate(languages)}), parts["at"]] = parts["value"]
    return Profiles(languages, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1.0), seed)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score: the cosine of the text's bundle with the language's prototype,
    at least 0."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                own = bundle(text, profiles.seed)
                length = np.linalg.norm(own)
                if not length or not profiles.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = profiles.prototypes @ own / length
                best = int(cosines.argmax())
                names.append(profiles.languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": scores})

    rows = slim(docs, id=id_col, text=text_col)
    return rows.mapInPandas(score, f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold`; a null id is not held out."""
    return F.coalesce(_fold(doc_id, folds) == fold, F.lit(False))
