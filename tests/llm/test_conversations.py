"""Repaired conversations held against a shortest path over whole audits."""

import random

import pytest
from brute import brute_conversations, brute_repair
from lodeframe.llm import conversations as C
from lodeframe.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, schema=SCHEMA):
    report, _, digests = C.repair(C.damaged(spark.createDataFrame(rows, schema)))
    sha = {r.conv_id: r.repaired_sha256 for r in digests.collect()}
    return {r.conv_id: (*tuple(r)[1:], sha[r.conv_id]) for r in report.collect()}


def test_query_equals_the_shortest_path(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, sf).collect()}
    assert got == brute_conversations(rows)


def test_products_equal_the_shortest_path():
    """Any symbols under any grammar: cost and audit are those of the whole search."""
    rnd = random.Random(4)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for rules in ([], ["ua", "uu", "xx"], ["ua", chr(C.FIRST_RULE) * 2, "Ox"]):
        evaluate = C.Evaluator(rules)
        for _ in range(150):
            symbols = "".join(rnd.choice(C.SYMBOLS) for _ in range(rnd.randint(0, 9)))
            rows = [(k, names.get(c.lower(), "user"), "" if c == "x" else f"t{k}" + "." * c.islower()) for k, c in enumerate(symbols)]
            whole = C.product(evaluate(symbols), C.insertions())
            cost, audit = min((whole[0, j][0], whole[0, j][1].text()) for j in C.ENDS if (0, j) in whole)
            assert (cost, audit) == brute_repair(rows)[5:7]


@pytest.mark.parametrize("rows_of_a_chunk", [1, 3, 1024])
def test_long_conversations_in_chunks(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(C, "CHUNK_ROWS", rows_of_a_chunk)
    rnd = random.Random(9)
    said = ["Yes.", "No", "Why?", "", " \t", "It is so.", "Go on"] + [f"Line {k}." for k in range(40)]
    rows = [(7, rnd.choice((None, rnd.randrange(300))), rnd.choice(("user", "assistant", "system", "tool")), rnd.choice(said)) for _ in range(400)]
    rows += [(k, t, rnd.choice(("user", "assistant")), rnd.choice(said)) for k in range(60) for t in range(rnd.randint(1, 5))]
    assert repaired(spark, rows) == brute_conversations(rows)


def test_nulls_repeated_rows_and_roles(spark):
    rows = [(None, None, None, None), (None, 3, "user", "A."), (1, 2, "", "x."), (1, 2, "User", "y"), (1, 9, "sys", "z."), (2, 5, "user", "same.")] + [(2, 6, "user", "same.")] * 30
    rows += [(3, t, "assistant", "a" * 50_000 + ".") for t in range(3)] + [(-4, -2, "user", "é."), (-4, 10**15, "assistant", "ok! ")]
    assert repaired(spark, rows) == brute_conversations(rows)


def test_repaired_rows_follow_the_grammar(spark, sf_dir):
    import re

    data = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    _, rows, _ = C.repair(C.unchanged(data))
    held = {}
    for r in rows.orderBy("conv_id", "place").collect():
        held.setdefault(r.conv_id, []).append(r)
    for own in held.values():
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert all(r.text == "" for r in own if r.edit == "I")


def test_empty_and_clashing_columns(spark):
    assert repaired(spark, []) == {}
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Yes", "y", 2)]
    assert repaired(spark, rows, SCHEMA + ", conv string, times int") == brute_conversations([r[:4] for r in rows])


def test_rules_are_shared(spark):
    texts = spark.createDataFrame([("uauaua", 5), ("suaua", 3), ("xuxu", 1)], "symbols string, n long")
    rules = C.grammar(texts)
    assert rules[0] == "ua" and len(C.compressed("uauaua", rules)) < 3
