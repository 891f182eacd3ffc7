import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from brute import brute_ids
from lodeframe.llm import token_ids
from lodeframe.llm.packing import CAPACITY, _places, group_sizes, pack, piece_starts, plan, vocabulary_path
from lodeframe.llm.token_ids import TokenIds


def check_plan(counts, capacity=CAPACITY):
    """Every rank of every length has one place, places of a sequence don't overlap or leave gaps; sequences used."""
    seen, fill = Counter(), {}
    for length, rank, n, first, per, offset in plan(counts, capacity):
        for k in range(n):
            seen[length, rank + k] += 1
            fill.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert set(seen) == {(s, k) for s, n in counts.items() for k in range(n)} and set(seen.values()) <= {1}
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(fill)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, CAPACITY), st.integers(1, 60), max_size=40))
def test_plans_are_whole_and_gapless(counts):
    check_plan(counts)


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(CAPACITY, rng.lognormal(6, 1.1, 3000).astype(int) + 1).tolist())
    used = check_plan(counts)
    assert used <= 1.01 * -(-sum(s * n for s, n in counts.items()) // CAPACITY) + 1


def test_groups_have_equal_cardinality():
    groups = group_sizes({s: 10 for s in range(300, 340)}, 8)
    assert len(groups) == 8 and all(size == max(lengths) for size, lengths in groups) and {len(x) for _, x in groups} == {5}


def test_piece_starts():
    assert piece_starts(5) == [0] and piece_starts(2048) == [0]
    assert piece_starts(2049) == [0, 1] and piece_starts(5000) == [0, 904, 2952]


def test_pieces_and_places(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Täglich grüßt. 'tis 12345\n\n  x\u00a0y 日本 " * 900), (5, "Hello world"), (6, " \t "), (7, "a" * 5000)]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, length int, rank string")
    out = [r.asDict() for r in pack(docs).collect()]
    for (doc_id, _), ids in zip(rows, brute_ids([t for _, t in rows]), strict=True):
        own = sorted((r for r in out if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == piece_starts(len(ids)) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    check_places(out)


def check_places(out):
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= CAPACITY for e in ends.values())
    return len(ends)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [r.asDict() for r in pack(docs).collect()]
    ids = dict(zip([r.doc_id for r in docs.collect()], brute_ids([r.text for r in docs.collect()]), strict=True))
    assert sum(r["length"] for r in out) == sum(map(len, ids.values()))
    assert check_places(out) <= 1.1 * sum(map(len, ids.values())) / CAPACITY + 1


def test_ids_are_given_when_asked(spark):
    out = pack(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), with_ids=True).first()
    assert out.ids == brute_ids(["Hello world"])[0]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in pack(docs).collect()) == ["1", "1", "None"]
    assert pack(docs.limit(0)).count() == 0


ODD = ["", "plain", "ümlaut", "a  b\n\n c", "don't 12 34", "\u3000全角", "🙂" * 3, "\x00\x7f", "a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>\n\n y<|endoftext|><|endoftext|> ", "x <|endoftext|> y", "<|endoftext|", " a", "a ", "a\nb", "a \nb", "\n", "a\x1c b"]


def test_ids_are_those_of_the_tokenizer():
    encode = TokenIds(vocabulary_path())
    for texts in (ODD, ODD[::-1]):  # the second time with words remembered
        assert [x.tolist() for x in encode(texts)] == [ids[:-1] for ids in brute_ids(texts)]
    assert encode(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Z", " ", "\n", "\t", "'", "s", "é", "\u00a0", "\x1c", "1", "²", ".", "你", "\r", "<|endoftext|>"]), max_size=12).map("".join), max_size=8))
def test_ids_of_any_white_space(texts):
    assert [x.tolist() for x in TOKENS[0](texts)] == [ids[:-1] for ids in brute_ids(texts)]


TOKENS = [TokenIds(vocabulary_path())]


def test_forgotten_words_change_nothing(monkeypatch):
    monkeypatch.setattr(token_ids, "HELD", 40)
    monkeypatch.setattr(token_ids, "TOGETHER", 3)
    texts = [f"word{k} and word{k % 7}\nline {k}" for k in range(60)]
    assert [x.tolist() for x in TokenIds(vocabulary_path())(texts)] == [ids[:-1] for ids in brute_ids(texts)]


@pytest.mark.parametrize("unit", [" ", "\n", "a", "ab "])
def test_very_long_runs(spark, unit):
    text = unit * (2_000_000 // len(unit))
    out = pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = brute_ids([text])[0]
    starts = piece_starts(len(ids))
    assert {(r.start, r.length) for r in out} == set(zip(starts, np.diff([*starts, len(ids)]).tolist(), strict=True))
    assert {r.start: r.ids_crc32 for r in out} == {a: zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)}


def test_copies_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b c " * 1500), (1, "a b c " * 1500), (1, "a b c " * 900)], "doc_id long, text string").repartition(3)
    out = pack(docs).collect()
    assert len({(r.row_id, r.piece) for r in out}) == len(out) and len({r.row_id for r in out}) == 3
    for row in {r.row_id for r in out}:
        own = sorted((r.piece, r.start, r.length) for r in out if r.row_id == row)
        assert [s for _, s, _ in own] == piece_starts(sum(n for *_, n in own))


def test_places_count_equal_lengths():
    seen = np.zeros(10, dtype=np.int64)
    assert _places(np.array([3, 5, 3, 3]), seen).tolist() == [0, 0, 1, 2] and _places(np.array([5, 3]), seen).tolist() == [1, 3]
    assert _places(np.array([], dtype=np.int64), seen).tolist() == []
