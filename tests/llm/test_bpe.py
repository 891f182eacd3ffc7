"""The ids and texts of the word tokenizer, held against the library's."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodeframe.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def of_library(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def of_coder(coder, texts):
    return [np.frombuffer(x, dtype="<i4").tolist() for x in coder(texts)]


def test_made_up_words(coder, library):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(1, 25))) for _ in range(5000)]
    words += [c * n for c in "a!s" for n in range(1, 90)] + ["ab" * n for n in range(1, 60)]
    assert of_coder(coder, words) == of_library(library, words)


def test_every_character_that_is_split_here(coder, library):
    around = [f"a{chr(c)}b1{chr(c)}!{chr(c)} {chr(c)}" for c in range(ord(bpe.LATIN))]
    assert of_coder(coder, around) == of_library(library, around)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(coder, library, text):
    assert of_coder(coder, [text]) == of_library(library, [text])


def test_added_tokens_signs_and_odd_white_space(coder, library):
    texts = ["", " ", "a<|endoftext|>B<|startoftext|><|endoftext|>", "<|endoftext|", "It's we'LL 1234", "ΑΣ ς İ ﬁ é é", "日本語 \x85\xa0 x", "x\x00y \x00", "\x1c\x1d a", "naïve\n\n\tcafé 😀😀"]
    assert of_coder(coder, texts) == of_library(library, texts)


def test_proposals_fail_and_are_merged(coder):
    """Both ways are taken: by words whose longest tokens are their encoding, and by words whose longest tokens are not."""
    rnd, m = random.Random(5), coder.merges
    words = ["".join(rnd.choice("aeionrst") for _ in range(12)) for _ in range(300)]
    same = [x.tolist() == m.proposed(w) for w, x in zip(words, m.encoded(words), strict=True)]
    assert any(same) and not all(same)
    assert [x.tolist() for x in m.encoded(words)] == [m.merged(w) for w in words]


def test_pairs_against_merging(coder):
    """A pair of tokens is compatible exactly if the characters of both are encoded as the two."""
    rnd, m = random.Random(7), coder.merges
    inner, last = list(m.inner), list(m.last)
    pairs = [(rnd.choice(inner), rnd.choice(last)) for _ in range(4000)] + [(a, b) for a in inner[:60] for b in last[:60]]
    said = m.compatible(np.array([m.inner[a] for a, _ in pairs]), np.array([m.last[b] for _, b in pairs]))
    assert said.tolist() == [m.merged(a + b) == [m.inner[a], m.last[b]] for a, b in pairs]


def test_query_equals_the_library(spark, sf_dir, library):
    import hashlib

    from lodeframe.llm.queries import op11_bpe

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in op11_bpe(spark, sf_dir).collect()} == want


def test_odd_tables(spark, library):
    long = "word " * 200_000 + "x" * 30_000
    rows = [(1, None, "a"), (1, "", "b"), (None, "A b", "c"), (2, long, None), (2, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "decoded_")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert {r.decoded for r in got if r.doc_id == 1} == {""}
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    none = spark.createDataFrame([(None,), ([5, 49407],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(none).collect()] == [None, library.decode([5, 49407], skip_special_tokens=False)]
