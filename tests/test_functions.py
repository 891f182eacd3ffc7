import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodeframe.functions import names, selectors, text
from lodeframe.functions.fuzzy import fuzzy_score
from lodeframe.operators import rank
from lodeframe.streaming.search import first_seen, scored_stream


def brute_score(q, t):
    if q.lower() == t.lower():
        return 100
    if not q:
        return None
    taken, last, score = 0, -2, 50 if t.lower().startswith(q.lower()) else 0
    for i, c in enumerate(t):
        if taken < len(q) and c.lower() == q[taken].lower():
            boundary = i == 0 or (t[i - 1].islower() and c.isupper()) or t[i - 1] in "_-."
            score += 30 if boundary else 2 if last == i - 1 else 1
            taken, last = taken + 1, i
    return score - len(t) // 10 if taken == len(q) else None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abAB_.-", max_size=4), st.text("abcABC_.-x", max_size=14)), min_size=40, max_size=60))
def test_fuzzy_score_is_what_the_rules_say(spark, pairs):
    rows = spark.createDataFrame(pairs, "q string, t string").withColumn("s", fuzzy_score(F.col("q"), F.col("t"))).collect()
    assert [r.s for r in rows] == [brute_score(r.q, r.t) for r in rows]


def test_fuzzy_vectors(spark):
    rows = spark.createDataFrame([("demo", "Demo"), ("tas", "TransactionAspectSupport"), ("tas", "StringBuilder"), ("", ""), ("", "x")], "q string, t string")
    a, b, c, d, e = (r.s for r in rows.select(fuzzy_score(F.col("q"), F.col("t")).alias("s")).collect())
    assert (a, c, d, e) == (100, None, 100, None) and b > 0


def test_fuzzy_score_of_given_text_and_of_long_names(spark):
    """A query as text goes through a regular expression first, and the work grows with the query, not with the name."""
    names_ = ["SmallRing.V1", "s.r", "sr", "rs", "", None, "\nsxr", "İsr", "Ksr", "s[r", "a\\sR", "x" * 300_000 + "aS.r"]
    df = spark.createDataFrame([(n,) for n in names_], "t string")
    for q in ("sr", "s[r", "\\s", "k", "é", ""):
        began = time.perf_counter()
        rows = df.select("t", fuzzy_score(q, F.col("t")).alias("s"), fuzzy_score(F.lit(q), F.col("t")).alias("c")).collect()
        assert time.perf_counter() - began < 30
        assert [r.s for r in rows] == [r.c for r in rows], q
        assert [r.s for r in rows if r.t and r.t[0] not in "İK"] == [brute_score(q, n) for n in names_ if n and n[0] not in "İK"], q


def test_names(spark):
    row = spark.range(1).select(
        names.simple_name(F.lit("a.b.C$D")).alias("inner"), names.simple_name(F.lit("a.C$1")).alias("anonymous"), names.entry_name(F.lit("a/b/C.class")).alias("entry"),
        names.is_suffix(F.lit("a.b.C$D"), F.lit("b.C.D")).alias("suffix"), names.is_suffix(F.lit("a.bb.C"), F.lit("b.C")).alias("part"), names.is_family(F.lit("a.C$D"), F.lit("a.C")).alias("family"),
        names.is_family(F.lit("a.CD"), F.lit("a.C")).alias("not_family"), names.parent_name(F.lit("a.C$D")).alias("parent"), names.version(F.lit("g:a:1.2")).alias("version"),
    ).first()
    assert tuple(row) == ("D", "C$1", "a.b.C", True, False, True, False, "a.C", "1.2")


def test_lines_and_slices(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\r\n", "a\n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [[], [""], ["a"], ["a"], ["a", "b"], ["a", "", "b"]]
    part = spark.range(1).select(text.line_slice(F.array(F.lit("a"), F.lit("b")), 2, 9).alias("p")).first().p
    assert (part.lines, part.first, part.last, part.clamped) == (["b"], 2, 2, True)


def test_text(spark):
    doc = "/**\n * Runs it. And more.\n * @param x y\n */"
    row = spark.range(1).select(
        text.doc_summary(F.lit(doc)).alias("summary"), text.has_deprecated_tag(F.lit("/**\n * @deprecated\n */")).alias("deprecated"), text.truncated(F.lit("x" * 121)).alias("cut"),
        text.matches_glob(F.lit("a/b/c.txt"), "a/*.txt").alias("one"), text.matches_glob(F.lit("a/b/c.txt"), "a/**.txt").alias("deep"), text.matches_glob(F.lit("ab?"), "ab?").alias("literal"),
        text.utf8_prefix(F.encode(F.lit("aé"), "UTF-8"), 2).alias("prefix"), text.utf8_prefix(F.encode(F.lit("aé"), "UTF-8"), 3).alias("whole"),
    ).first()
    assert tuple(row) == ("Runs it.", True, "x" * 120 + "…", False, True, True, "a", "aé")


def test_versions_sort(spark):
    versions = ["1.9.0", "1.10.0.RC1", "1.10.0", "1.2-b", "1.2-10", "1.2-9"]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").orderBy(text.version_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ["1.2-9", "1.2-10", "1.2-b", "1.9.0", "1.10.0.RC1", "1.10.0"]


def test_selectors(spark):
    assert selectors.parse("#Recv.f(Map<A,B>,int)") == selectors.Selector("f", ("Map<A,B>", "int"), "Recv")
    assert selectors.parse("#run()").params == () and selectors.parse("#run").params is None
    for bad in ("run", "#f(String?)", "#f(", "#f(a,,b)"):
        with pytest.raises(ValueError):
            selectors.parse(bad)
    members = spark.createDataFrame([("run", [], None), ("run", ["java.lang.String"], None), ("run", ["String", "int"], None), ("ext", ["int"], "kotlin.List")], "name string, params array<string>, receiver string")
    count = lambda s: members.filter(selectors.matches(selectors.parse(s), F.col("name"), F.col("params"), F.col("receiver"))).count()
    assert [count(s) for s in ("#run", "#run()", "#run(String)", "#run(*)", "#run(*,int)", "#List.ext", "#Map.ext")] == [3, 1, 1, 3, 1, 1, 0]


def test_ranking(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "b"), ("m", 1, "c")], "key string, ord int, v string")
    out = {r.key: (r.winner, r.alternatives) for r in rank.winner_alternatives(rows, ["key"], ["ord"], "v").collect()}
    assert out == {"k": ("b", ["a"]), "m": ("c", [])}
    assert {(r.key, r.ord) for r in rank.first_wins(rows, ["key"], ["ord"]).collect()} == {("k", 1), ("m", 1)}
    note = rank.degraded(rows, F.col("ord") > 1, F.col("v"), "artifacts unreadable", ["ord"], shown=1).first()
    assert tuple(note) == (2, "2 artifacts unreadable (a)")
    empty = rows.limit(0)
    assert rank.first_nonempty([empty, rows.filter("key = 'm'"), rows]).count() == 1


def test_top_k_is_not_a_sort(spark, sf_dir):
    from lodeframe.plans.catalogue import QUERIES

    plan = QUERIES["fuzzy_topk_part"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "p_brand" not in plan


def test_streams(spark, tmp_path):
    spark.createDataFrame([("Demo", 1), ("Demo", 2), ("Other", 3)], "name string, t int").selectExpr("name", "timestamp_seconds(t) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, at timestamp").parquet(str(tmp_path / "in"))
    hits = scored_stream(first_seen(stream, "name", "at", "1 hour"), "name", "demo")
    q = hits.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.name, r.score) for r in spark.table("hits").collect()] == [("Demo", 100)]
