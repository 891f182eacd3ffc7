import re

import pytest
from pyspark.sql import functions as F

from brute import brute_counts
from lodeframe.llm import url_filter as U
from lodeframe.llm.quality import RULES, SAMPLE_ROWS, Rule, drawn, first_failure, keep_good, ordered_rules, quality_cascade
from lodeframe.llm.url_filter import filter_urls, rule_index

PROSE = "It was a quiet morning in the old town and nobody had yet opened the shutters of the small houses along the river"
TEXTS = [
    PROSE, None, "", " \n\t", "one two", PROSE + "\n" + PROSE, PROSE.upper(), PROSE.replace(" ", " | "), "a b c d e f g h " * 40,
    "\n".join([PROSE] + ["same line again and again"] * 9), PROSE + " x\x85y\u00a0z", PROSE.replace(" ", "!! "), "é" * 30000 + " " + PROSE, " ".join(map(str, range(40))), "a a a a a a a a a " + PROSE,
]


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 1, "w") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, words string")
    for r in quality_cascade(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_order_changes_no_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept = {r.doc_id for r in quality_cascade(docs).filter("kept").collect()}
    assert {0, 10, 12 - 12} <= kept and not kept & {1, 2, 3, 4, 6, 7, 8, 11, 13}
    assert kept == {r.doc_id for r in quality_cascade(docs, RULES[::-1]).filter("kept").collect()} == {r.doc_id for r in keep_good(docs).collect()}
    assert {r.name for r in ordered_rules(docs, RULES)} == {r.name for r in RULES}

    slow = Rule("slow", lambda: F.length(F.regexp_replace(F.repeat("text", 50), r"\p{L}", "")) < 0)
    rare = Rule("rare", lambda: F.lit(False))
    assert ordered_rules(docs, [slow, rare, RULES[0]])[0].name == "symbols"  # the one that rejects any
    assert quality_cascade(docs.limit(0)).count() == 0 and quality_cascade(docs, []).count() == len(TEXTS)


def words(n, length=5, start=0):
    """n different words of so many small letters."""
    return ["".join(chr(97 + (k // 26**p) % 26) for p in range(length)) for k in range(start, start + n)]


#: Texts that just meet a threshold, each with one that is just past it.
AT_LIMITS = {
    "base words": (" ".join(words(20)), " ".join(words(19))),
    "base windows": (" ".join(words(9) * 2 + words(42, start=100)), " ".join(words(9) * 2 + words(41, start=100))),
    "symbols": (" ".join(words(20)) + "#*$%&|", " ".join(words(20)) + "#*$%&|<"),
    "duplicate_lines": ("\n".join([" ".join(words(20))] + ["line"] * 4), "\n".join([" ".join(words(20))] + ["line"] * 5)),
    "word_length low": (" ".join(words(20, 2)), " ".join(words(19, 2) + ["a"])),
    "word_length high": (" ".join(words(20, 15)), " ".join(words(19, 15) + ["z" * 16])),
    "shouting": (" ".join(w[:3].upper() + w[3:] for w in words(20)), " ".join([w[:3].upper() + w[3:] for w in words(19)] + ["ZZZZy"])),
    "few_letters": (" ".join(w + "123" for w in words(20, 3)), " ".join([w + "123" for w in words(19, 3)] + ["zzz1234"])),
    "exclamations": (" ".join(words(20)) + "!" * 10, " ".join(words(20)) + "!" * 11),
}


def test_texts_at_a_threshold_pass_and_texts_past_it_do_not(spark):
    rows = [(name, past, pair[past]) for name, pair in AT_LIMITS.items() for past in (0, 1)]
    docs = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(rows)], "doc_id int, text string")
    for r in quality_cascade(docs).collect():
        name, past, _ = rows[r.doc_id]
        assert r.failed_rule == (name.split()[0] if past else None), name


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(40_000, numPartitions=4).select("id", F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = drawn(docs).collect()
    assert SAMPLE_ROWS * 0.7 < len(rows) < SAMPLE_ROWS * 1.4
    assert 0.2 < sum(r.text == "the same text" for r in rows) / len(rows) < 0.5
    assert drawn(docs.limit(50)).count() == 50 and drawn(docs.limit(0)).count() == 0


def test_first_failure_stops(spark):
    from lodeframe.llm.quality import Rule

    rules = [Rule("a", lambda: F.lit(True)), Rule("b", lambda: F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert spark.range(1).select(first_failure(rules).alias("x")).first().x == "a"


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_cascade(docs).filter("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) > 0.3 * len(bad)


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [h + p for _, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: (len(r), r), default=None)


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/de/", "http://example.com/de/x?y#z", "http://xexample.com/de/", "http://org/fr/", "https://a.b.org/fr/x", "http://net", "http://net/", "http://net?x=/",
    "ftp://u:p@h.net:80/", "no scheme", "", None, "http://", "a://b://c.net/", "http://example.net/EN/", "http://example.com/de", "http://É.ORG/fr/a\nb", "http://x.net/" + "y/" * 3000, "http://net.foo/x.net\n/y", "http://a\n.net/\n", "http://example.com\n/de/", "HTTP://A.EXAMPLE.COM/de/\u2028x",
]


@pytest.mark.parametrize("inline", [200, 0])
def test_urls_match_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(U, "INLINE_RULES", inline)
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(URLS)] + [(99, "http://net/", "r", "h")] * 2, "page_id long, url string, rule string, host string")
    out = filter_urls(pages).collect()
    assert len(out) == len(URLS) + 2
    actions = {h + p: a for a, h, p in U.RULES}
    for r in out:
        host, path, rule = brute_rule(URLS[r.page_id] if r.page_id < 99 else "http://net/")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, actions.get(rule, "allow"))


def test_rules_are_filed_under_their_rarest_token(spark, monkeypatch):
    urls = spark.createDataFrame([("example.com", "/de/x"), ("example.com", "/en/"), ("x.com", "/")], "host string, path string")
    index = rule_index(urls, U.RULES)
    assert {t: [r["rule"] for r in rs] for t, rs in index.items()} == {"h:net": ["net/", "example.net/en/"], "p:de": ["example.com/de/"], "h:org": ["org/fr/"]}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    asked = spark.createDataFrame([(1, "http://a.b/x/y"), (2, "http://a.b/z")], "page_id long, url string")
    everywhere = [("block", "", "/x/"), ("allow", "b", "/x/y")] + [("block", f"h{k}", "/") for k in range(5)]
    for inline in (0, 200):
        monkeypatch.setattr(U, "INLINE_RULES", inline)
        assert [r.rule for r in filter_urls(asked, [("block", "", "/z"), *everywhere[1:]]).orderBy("page_id").collect()] == ["b/x/y", None]
    assert [r.verdict for r in filter_urls(spark.createDataFrame([(1, "x://y")], "page_id long, url string"), []).collect()] == ["allow"]
