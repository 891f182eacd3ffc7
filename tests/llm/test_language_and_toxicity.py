import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import language_id as L, toxicity as X

TEXTS = {
    "en": ["the cat sat on the mat and then it went away with the other cats", "where is the house that they have built there"],
    "de": ["der hund läuft durch den wald und sucht nach einem knochen", "wir haben das haus schön gebaut und sind nicht müde"],
    "fr": ["le chat est parti avec les autres chats dans la forêt", "où est la maison que nous avons construite pour eux"],
}


def bundled(text):
    """The text's bundle trigram by trigram, out of vectors that are rotated here."""
    letters = L.letter_vectors()[2].astype(float)
    out = np.zeros(L.DIMENSIONS)
    for code in L.trigrams(text):
        a, b, c = code // L.SYMBOLS**2, code // L.SYMBOLS % L.SYMBOLS, code % L.SYMBOLS
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)  # more than one block
    for text in ("Der Hund, ÄPFEL und 7 Birnen", "и собака 犬 и кот", "a", "", None, "12"):
        assert np.array_equal(L.bundle(text), bundled(text))


def test_letters_of_other_scripts_have_classes_of_their_own():
    for script in (range(0x410, 0x450), range(0x5D0, 0x5EB), range(0x3041, 0x30FB), range(0x621, 0x64B)):
        classes = {int(L._classes()[cp]) for cp in script if chr(cp).isalpha()}
        assert len(classes) == sum(chr(cp).isalpha() for cp in script)


def test_trigrams():
    assert len(L.trigrams(None)) == len(L.trigrams("")) == len(L.trigrams(" 12 .")) == 0
    assert L.trigrams("a--B 9").tolist() == L.trigrams("A b").tolist() and len(L.trigrams("a b")) == 3


def test_languages(spark):
    rows = [(k * 10 + i, t, lang, 1.0) for i, (lang, ts) in enumerate(TEXTS.items()) for k, t in enumerate(ts)] + [(100, "zzz", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = L.learn(docs, F.lit(True))
    asked = spark.createDataFrame([(1, "the house and the cat"), (2, "die katze und der wald"), (3, "la maison et le chat"), (4, None), (5, ""), (6, "12 !"), (None, "the"), (1, "the house and the cat")], "doc_id long, text string")
    out = L.predict(asked, profiles).collect()
    assert [r.lang_pred for r in out] == ["en", "de", "fr", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in out) and [r.score for r in out[3:6]] == [0, 0, 0]
    assert {r.lang_pred for r in L.predict(asked, L.learn(docs.limit(0), F.lit(True))).collect()} == {"und"}
    assert L.predict(asked.limit(0), profiles).count() == 0


def test_predictions_are_cosines_of_bundles(spark):
    rows = [(k * 10 + i, t, lang) for i, (lang, ts) in enumerate(TEXTS.items()) for k, t in enumerate(ts)]
    profiles = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for lang, prototype in zip(profiles.languages, profiles.prototypes, strict=True):
        whole = sum(bundled(t) / np.linalg.norm(bundled(t)) for t in TEXTS[lang])
        assert np.allclose(prototype, whole / np.linalg.norm(whole), atol=1e-5)
    asked = [t for ts in TEXTS.values() for t in ts] + ["the knochen", "ou est le hund", "x", "É", "and " * 5_000, "den den den und"]
    table = spark.createDataFrame([(k, t, "clash", 1.0) for k, t in enumerate(asked)] * 2, "doc_id long, text string, lang_pred string, score double")
    out = L.predict(table, profiles).collect()
    assert len(out) == 2 * len(asked)
    for r in out:
        own = bundled(asked[r.doc_id])
        cosines = profiles.prototypes @ own / np.linalg.norm(own)
        assert abs(cosines.max() - cosines[profiles.languages.index(r.lang_pred)]) < 1e-9
        assert abs(r.score - min(1.0, max(0.0, cosines.max()))) < 1e-6


def test_held_out_is_crc32(spark):
    rows = spark.range(40).select("id", L.held_out(F.col("id"), 3, 1).alias("h"), X.held_out(F.col("id")).alias("x")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) and r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_accuracy_on_held_out_documents(spark, sf):
    from lodeframe.llm.queries import QUERIES

    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language_id"](spark, d).filter("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    out = QUERIES["op3_toxicity"](spark, d).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.8 and np.mean([c >= 0.5 for c in clean]) < 0.03


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_stems_quotes_and_innocents():
    lexicon = X.Lexicon({"vequ*": 1.0, "stupid": 1.0}, frozenset(["stupit"]))
    assert lexicon.match("vequarium") == 1.0 and lexicon.match("veq") == 0 and lexicon.match("stup1d") == X.EDITED and lexicon.match("stupit") == 0
    plain, quoted = lexicon.features("you are stupid ok")[0], lexicon.features('the "stupid idea" was dropped')[0]
    assert plain == 1.0 and quoted == X.QUOTED and lexicon.features(None) == (0.0, 0.0)


def test_learning(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows, labels = [], []
    for k in range(400):
        t = " ".join(rng.choice(words, 20))
        if k % 4 == 0:
            t += " worthless fool"
        rows.append((k, t, 7))
        labels.append((k, int(k % 4 == 0), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.learn(docs, spark.createDataFrame(labels + [(999, None, 1), (0, 1, 1)], "doc_id long, toxic int, score int"), F.lit(True))
    asked = spark.createDataFrame([(1, "so worthles they are"), (2, words[0]), (3, None), (4, ""), (None, "fool")], "doc_id long, text string")
    out = [r.predicted for r in X.score(asked, model).collect()]
    assert out == [1, 0, 0, 0, 1]
    none = X.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.predicted for r in X.score(asked, none).collect()} == {0} and X.score(asked.limit(0), model).count() == 0


def test_one_clean_document_silences_no_term(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words, 20)) + (" worthless fool" if k % 4 == 0 else "")) for k in range(400)]
    rows = [(k, t + {4: " worthles", 8: " worthles", 12: " worthles"}.get(k, " worth" if k % 4 == 3 else "")) for k, t in rows]
    rows[1] = (1, rows[1][1] + '\nthey called it "worthless"')  # a quotation
    rows[2] = (2, rows[2][1] + " fool")  # a noisy label
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    lexicon = X.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True)).lexicon
    assert lexicon.match("worthless") > 0 and lexicon.match("fool") > 0 and lexicon.match("worthles") > 0
    assert lexicon.match("worth") == 0 and not lexicon.innocent & {"worthless", "fool", "worthles"}


def test_automaton_is_edit_distance_from_the_first_letter_on():
    rng = np.random.default_rng(1)
    terms = ["worthless", "disgusting", "stupid", "bad", "awful"]
    lexicon = X.Lexicon({t: 1.0 for t in terms})
    edits = {t: (len(t) >= X.ONE_EDIT) + (len(t) >= X.TWO_EDITS) for t in terms}
    words = ["xstupid", "xtupid", "tupid", "xisgusting", "xxisgusting", "xxsgusting", "xbad"]
    for _ in range(3000):
        w = list(terms[rng.integers(len(terms))])
        for k in (0, *rng.integers(len(w), size=rng.integers(3))):
            w[k : k + rng.integers(2)] = ["abdefwx"[rng.integers(7)]] * rng.integers(2)
        words.append("".join(w))
    for w in words:
        assert lexicon.match(w) == max((X.EDITED ** edit_distance(w, t) for t in terms if edit_distance(w, t) <= edits[t]), default=0)
    stems = X.Lexicon({"idiot*": 1.0})
    for w in ("xdiotic", "1diots", "xidiotic", "diotic"):
        assert stems.match(w) == X.EDITED
    assert stems.match("xxiotic") == 0


def test_misspellings_weigh_as_their_rate():
    assert X.Lexicon({"stupid": 1.0}, near={("stupid", 1): 0.25}).match("xstupid") == 0.25


def test_reporting_words_are_learned_in_any_language(spark):
    toxic = [(f"you are stupid w{i}" if i < 30 else f"nothing w{i}", 1) for i in range(40)]
    clean = [(f"er zitiert stupid x{i}" if i < 12 else f"alles gut x{i}", 0) for i in range(800)]
    lexicon = X.learn_lexicon(spark.createDataFrame(toxic + clean, "text string, label int"))
    assert {"er", "zitiert"} <= lexicon.reporting - X.REPORTING and not {"you", "are", "stupid", "alles"} & lexicon.reporting
    plain, reported = lexicon.features("das ist stupid")[0], lexicon.features("er zitiert das stupid")[0]
    assert plain > 0 and reported == X.QUOTED * plain
    assert lexicon.neighbours(None) == lexicon.neighbours("alles gut") == set()
    assert lexicon.neighbours("a b c d e f g stupid h") == set("bcdefgh")


def test_toxicity_of_odd_tables(spark):
    """Repeated rows, ties, very long texts and columns with the names of the result's."""
    model = X.Model(X.Lexicon({"stupid": 1.0, "stup*": 1.0}), (-3.0, 4.0, 1.0))
    long = "fine words " * 200_000 + "stupid"
    rows = [(1, "you stupid", 9.0, "x"), (1, "you stupid", 9.0, "x"), (2, long, 9.0, "x"), (None, "", 9.0, "x"), (3, None, None, None)]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string, score double, id string"), model)
    assert got.columns == ["doc_id", "score", "predicted"]
    found = sorted((r.doc_id or 0, r.score) for r in got.collect())
    assert [d for d, _ in found] == [0, 1, 1, 2, 3] and found[1] == found[2]
    assert found == sorted((d or 0, model.score(t)) for d, t, *_ in rows)
    assert found[3][1] > found[0][1] == found[4][1]  # the hit at the end of the long text counts
