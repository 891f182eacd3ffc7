import hashlib
import re

from lodeframe.llm.exact_dedup import drop_copies, exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    return sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


ROWS = [(5, "a b"), (3, "a \n\tb"), (9, "a\x0bb"), (4, "ab"), (1, None), (0, ""), (7, " "), (8, "\n\n"), (6, "é" * 5000), (2, "é" * 4999 + "e"), (11, " a b"), (12, "a b "), (13, "a b"), (14, "a\x85b")]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, id int, length string")
    out = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs, digest_all=True).collect())
    assert out == brute(ROWS)
    assert {r.doc_id for r in exact_dedup(docs).filter("kept").collect()} == {k for _, k, _, _ in brute(ROWS)}


def test_hash_only_where_a_group_survives(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    hashed = {r.doc_id for r in exact_dedup(docs).filter("text_sha256 is not null").collect()}
    assert {0, 1, 3, 5, 7, 8, 9} <= hashed and 4 not in hashed


def test_verdicts_and_drops_agree_on_odd_ids(spark):
    rows = [(None, "a"), (2, " a".strip()), (None, "b"), (None, "b"), (3, "c"), (3, "c"), (4, "c"), (5, "x"), (5, "d"), (1, "d"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, tag int, hit string")
    kept = sorted((str(i), str(t)) for (i, t), ok in zip(rows, [0, 1, 1, 1, 1, 1, 0, 1, 0, 1, 0, 1], strict=True) if ok)
    assert sorted((str(r.doc_id), str(r.text)) for r in drop_copies(docs).collect()) == kept
    judged = exact_dedup(docs).collect()
    assert sum(r.kept for r in judged) == len(kept)


def test_table_repeats_and_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs, digest_all=True).collect()) == brute(rows)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in exact_dedup(twice).collect()) == [("1", True), ("1", True), ("2", False), ("None", True), ("None", True)]
    assert exact_dedup(docs.limit(0)).count() == 0
    assert {r.doc_id for r in drop_copies(docs).collect()} == {k for _, k, _, _ in brute(rows)}
