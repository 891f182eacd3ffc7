import random

from brute import brute_near as brute
from lodeframe.llm import near_dedup as nd
from lodeframe.llm.common import components
from lodeframe.llm.near_dedup import drop_near_copies, near_dedup


def some_rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgß") for _ in range(6)) for _ in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, rng.choice([" ", "\n", "\t "]).join(w)))
            k += 1
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE\n"), (905, "É one")]


def test_matches_brute_force(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, id string, n int")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs).collect()}
    assert out == brute(rows)


def test_small_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "LIST_BLOCK", 3)
    monkeypatch.setattr(nd, "GROUP_BLOCK", 2)
    rows = some_rows()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows)


def test_table_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs).collect()}
    assert out == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (2, text), (2, text), (5, text + " ")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(docs).collect()), key=str)
    assert out == sorted([(None, 2, False), (2, 2, True), (2, 2, True), (5, 2, False)], key=str)
    assert sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect()) == [(2, text)] * 2
    lone = spark.createDataFrame([(None, text), (None, text), (4, "other words here and there again")], "doc_id long, text string")
    assert drop_near_copies(lone).count() == 3
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 700), (700, 600)], "a long, b long"))
    out = {r.id: r.component for r in components(chain).collect()}
    assert out == {**{i: 1 for i in range(1, 201)}, 500: 500, 600: 500, 700: 500}


def test_matches_follow_from_percent():
    assert nd.matches(85) == 40 and nd.matches(80) == 35 and nd.matches(1) == 1


def test_pairs_of_eighty_percent_match_brute_force(spark):
    rows = some_rows()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert out == brute(rows, 80) != brute(rows, 85)


def test_rows_of_a_long_list_grow_with_the_list(spark):
    def posted(n):
        rows = spark.range(n).selectExpr("7 as token", "id", f"{n} as n", "0 as first")
        sigs = spark.range(n).selectExpr("id", "cast('x' as binary) as sig")
        return nd.candidate_groups(sigs, rows.selectExpr("cast(token as long) token", "id", "cast(n as long) n", "cast(first as long) first"), 40)

    for n in (20_000, 100_000):
        assert posted(n).agg({"component": "max", "id": "count"}).first().asDict() == {"max(component)": 0, "count(id)": n}


def test_large_groups_match_brute_force(spark, monkeypatch):
    """Groups with a crowd, with links outside it, and boilerplate that links nothing."""
    monkeypatch.setattr(nd, "LIST_BLOCK", 4)
    monkeypatch.setattr(nd, "GROUP_BLOCK", 5)
    rng = random.Random(6)
    shared = [f"s{k}" for k in range(200)]
    rows = [(k, " ".join(shared[:130] + [f"b{k}x{j}" for j in range(45)])) for k in range(30)]  # alike to some degree, no links
    rows += [(100 + k, " ".join(shared[:190] + [f"c{k}x{j}" for j in range(rng.choice([2, 8]))])) for k in range(30)]  # a crowd
    chain = [f"d{k}" for k in range(160)]
    rows += [(200 + k, " ".join(shared[:20] + chain[8 * k : 8 * k + 90])) for k in range(9)]  # neighbours link
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert out == brute(rows, 80) and len({c for _, c in out.values()}) > 31
