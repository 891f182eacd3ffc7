import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import common, suffix_dedup
from lodeframe.llm.suffix_dedup import WINDOW, common_prefixes, dedup_substrings, suffix_array, window_runs


def brute(rows):
    """doc_id -> (n_removed, spans, kept) by a dictionary of all windows; rows are (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - WINDOW + 1):
            w = b[p : p + WINDOW]
            if w in seen:
                gone[p : p + WINDOW] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc_id] = (int(gone.sum()), spans, bytes(np.frombuffer(b, dtype=np.uint8)[~gone]))
    return out


def result(df):
    return {r.doc_id: (r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()}


def some_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows = text(45), []
    for k in range(60):
        t = text(rng.randint(1, 60))
        if k % 3 == 0:
            t = t[:40] + passage + text(20)
        if k % 7 == 0:
            t = passage[20:] + t + passage
        if k % 11 == 0 and rows:
            t = rows[k // 2][1]
        rows.append((k, t))
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 400), (105, "ab" * 300), (None, passage)]
    return rows


def test_matches_brute_force(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, key string")
    assert result(dedup_substrings(docs)) == brute(rows)


def test_spread_keys_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPREAD_RUNS", 3)
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(dedup_substrings(docs)) == brute(rows)


def test_long_texts_cross_chunks(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, long), (2, long[70_000:] + "tail"), (3, "y" + long[65_400:65_700])]
    assert result(dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "z" * 150), (1, "z" * 150), (2, "q")]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 149), (1, 149), (2, 0)]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 4):
        text = rng.integers(0, alphabet, 700).astype(np.uint8)
        order = suffix_array(text)
        keys = [bytes(text[i:]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(700))
        shared = common_prefixes(text, order)
        for a, b, n in zip(keys, keys[1:], shared[1:], strict=False):
            assert n == next((k for k in range(WINDOW) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), WINDOW)


def test_equal_windows_share_a_key():
    rng = np.random.default_rng(2)
    inner = bytes(rng.integers(97, 123, 300).astype(np.uint8))
    a, b = (bytes(rng.integers(97, 123, 5000).astype(np.uint8)) for _ in range(2))

    def keys(body):
        key, _, start, windows, _ = window_runs(body)
        assert windows.sum() == len(body) - WINDOW + 1 and len(key) > len(body) / 100
        return {body[s + o : s + o + WINDOW]: k for k, s, n in zip(key, start, windows, strict=True) for o in range(n)}

    one, two = keys(a[:1234] + inner + b), keys(b[:77] + inner + a)
    shared = one.keys() & two.keys()
    assert len(shared) >= 201 and all(one[w] == two[w] for w in shared)


def test_filters_reach_the_driver_as_columns(spark):
    keys = spark.range(0, 400_000, 1, 8).select(F.xxhash64("id").alias("key")).cache()
    slots = keys.toArrow()["key"].to_numpy()

    def traced(make):
        tracemalloc.start()
        try:
            flags = make()
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        expected = np.zeros(8 * len(flags), dtype=bool)
        expected[slots & (len(expected) - 1)] = True
        assert (np.unpackbits(flags, bitorder="little") == expected).all()
        return most / len(flags)

    # a Row takes some 500 bytes, sixty times its word
    assert traced(lambda: suffix_dedup._key_filter(keys)) < 4
    assert traced(lambda: common.slot_bits(keys, F.pmod("key", F.lit(1 << 23)), 1 << 23)) < 4
    keys.unpersist()


def test_filter_holds_a_bit_a_slot(spark):
    held = spark.range(0, 400_000, 1, 8).cache()
    held.count()
    tracemalloc.start()
    may = common.slot_filter(held, "id")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert may.slots == 1 << 22 and most < 3 * may.slots
    asked = spark.range(0, 800_000, 1, 8).select("id", F.xxhash64("id").alias("hash"), may.hit(F.col("id")).alias("hit")).toArrow()
    slots = asked["hash"].to_numpy() & (may.slots - 1)
    expected = np.isin(slots, slots[asked["id"].to_numpy() < 400_000])
    hit = asked["hit"].to_numpy()
    assert (hit == expected).all() and 400_000 < hit.sum() < 450_000
    held.unpersist()


def test_filter_of_no_rows(spark):
    none = spark.createDataFrame([], "key long")
    assert not suffix_dedup._key_filter(none).any()
    may = common.slot_filter(none, "key").hit(F.col("id"))
    assert spark.range(100).filter(may).count() == 0
