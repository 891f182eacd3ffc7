import numpy as np

from brute import brute_mix
from lodeframe.llm import mixing
from lodeframe.llm.mixing import draw_blocks, mix, mix_plan, split_quotas, targets


def test_targets_reshare_the_excess():
    sizes, weights = [100, 10, 50, 0, 40], [3, 1, 2, 3, 1]
    out = targets(sizes, weights)
    assert abs(sum(out) - 1.5 * sum(sizes)) < 1e-9
    assert all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes, strict=True))
    free = [t / w for t, s, w in zip(out, sizes, weights, strict=True) if t < 2 * s - 1e-9]
    assert max(free) - min(free) < 1e-9 and min(free) >= max(t / w for t, s, w in zip(out, sizes, weights, strict=True) if s and t >= 2 * s - 1e-9) - 1e-9
    assert targets([], []) == [] and targets([0, 0], [3, 1]) == [0, 0]


def test_tree_splits_quotas_exactly():
    quotas = [1000, 0, 37, 5]
    leaves = split_quotas(quotas, 7, seed=3)
    assert leaves.sum(axis=0).tolist() == quotas and (leaves >= 0).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3
    assert (leaves == split_quotas(quotas, 7, seed=3)).all()
    share = np.mean([split_quotas([300, 100], 4, seed=s)[0, 0] for s in range(200)])
    assert 70 < share < 80


ROWS = [(k, " ".join(["w"] * (k % 9 + 1)), ["b", "a", None, "Z"][k % 4]) for k in range(200)] + [(500, None, "a"), (501, " ", "b"), (502, "x " * 3000, "b"), (503, "y", "lonely"), (504, None, "empty")]


def test_plan(spark):
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in ROWS], "doc_id long, text string, source string, size int, rank int")
    out = mix_plan(docs, shards=4, block_words=64).collect()
    sizes = {i: len((t or "").split()) for i, t, _ in ROWS}
    assert {r.doc_id: r["size"] for r in out} == sizes
    order = sorted({s for _, _, s in ROWS}, key=lambda s: (s is None, s))
    totals = [sum(sizes[i] for i, _, s in ROWS if s == x) for x in order]
    wanted = dict(zip(order, targets(totals, [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    for x, total in zip(order, totals, strict=True):
        own = [r for r in out if r.source == x]
        assert all(r.source_size == total and abs(r.target - wanted[x]) < 1e-9 for r in own)
        assert abs(sum(r.taken for r in own) - wanted[x]) <= 0.5 + 1e-9
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == sum(d.words for d in r.draws) for r in out)
    assert {d.shard for r in out for d in r.draws} <= set(range(4))
    again = mix_plan(docs.repartition(9), shards=4, block_words=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_taken_matches_brute_force(spark):
    for block_words in (64, 8192):
        out = {r.doc_id: r.taken for r in mix_plan(spark.createDataFrame(ROWS, "doc_id long, text string, source string"), block_words=block_words).collect()}
        assert out == dict(zip([i for i, *_ in ROWS], brute_mix(ROWS, block_words), strict=True))


def test_drawn_blocks_are_disjoint_and_use_up_the_quotas():
    words = [{b: 10 + b % 3 for b in range(40)}, {0: 5}, {}, {b: 7 for b in range(9)}]
    wanted = [600, 3, 0, 63]
    drawn = draw_blocks(words, wanted, 5, seed=1)
    assert len({(s, b, copy) for s, b, copy, *_ in drawn}) == len(drawn)
    assert [sum(limit for s, *_, limit in drawn if s == k) for k in range(4)] == wanted
    quotas = [sum(s == k for s, *_ in drawn) for k in range(4)]
    leaves = split_quotas(quotas, 5, seed=1)
    assert all(sum(s == k and shard == j for s, _, _, shard, _ in drawn) == leaves[j, k] for k in range(4) for j in range(5))
    assert sum(limit < words[s][b] for s, b, _, _, limit in drawn) <= 3


def test_what_no_leaf_draws_is_not_taken(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    taken = lambda: sum(r.taken for r in mix_plan(docs, shards=4, block_words=64).collect())
    whole, tree = taken(), mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: tree(*a) * np.array([[1], [1], [0], [1]]))
    assert 0 < taken() < whole


def test_mixed_rows_lie_by_shard_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 100)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], "doc_id long, text string, source string, mix_shard int, Mix_Order int, mix_partition int")
    out = mix(docs, shards=3, block_words=32)
    assert out.columns[6:] == ["_mix_shard", "_mix_order", "_mix_copy"]
    lists = out.rdd.glom().map(lambda rows: [(r._mix_shard, r._mix_order) for r in rows]).collect()
    whole = [x for rows in lists for x in rows]
    assert len(lists) > 3 and whole == sorted(whole) and len({s for s, _ in whole}) == 3
    copies = [(r.doc_id, r._mix_copy) for r in out.collect()]
    assert len(set(copies)) == len(copies)


def test_mix_rows(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in ROWS], "doc_id long, text string, source string, row int")
    out = mix(docs, shards=3, block_words=32).collect()
    taken = {r.doc_id: r.taken for r in mix_plan(docs, shards=3, block_words=32).collect()}
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mix_plan(docs).collect()) == round(1.5 * 5)
    assert mix_plan(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_a_cut_text_keeps_its_white_space(spark):
    texts = {1: " a\tb\n\nc  d e", 2: "f \n g\r\nh i  j ", 3: "k\n\n\nl  m n o"}
    docs = spark.createDataFrame([(i, t, s) for i, t in texts.items() for s in ("p", "q", "r")], "doc_id long, text string, source string")
    rows = [(texts[r.doc_id], r.text) for r in mix(docs).collect()]
    cut = [(whole, text) for whole, text in rows if text != whole]
    assert cut and all(whole.startswith(text) and text == text.rstrip() and not whole[len(text)].strip() for whole, text in cut)
