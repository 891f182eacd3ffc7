"""Quality rules as a short-circuit cascade: rules are ordered by measured rejections per cost, then tried in turn.

Defined cases: a null text has no words and fails; a text that just meets a threshold passes; very long texts are counted
whole; repeated rows and null ids are judged each for itself; columns of docs other than the two named are carried or left
alone, whatever their names; an empty table gives an empty result; the order of the rules changes the work and the rule
that is named, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, free_names, slim, word_list

#: About so many rows, drawn from all, are what costs and selectivities are estimated on; they set the order of
#: work only.
SAMPLE_ROWS = 400

WIDTH = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row where its predicate over text and the counts of COUNTS holds."""

    name: str
    rejects: Callable[[], Column]


#: Thresholds that texts of ordinary prose in alphabetic scripts keep well clear of.
RULES = [
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words") * 3),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 10 > F.col("n_lines") * 6),
    Rule("word_length", lambda: (F.col("word_chars") < F.greatest("n_words", F.lit(1)) * 2) | (F.col("word_chars") > F.greatest("n_words", F.lit(1)) * 15)),
    Rule("shouting", lambda: (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))) * 10 > F.col("n_letters") * 6),
    Rule("few_letters", lambda: F.col("n_letters") * 2 < F.col("word_chars")),
    Rule("exclamations", lambda: (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))) * 2 > F.col("n_words")),
]


def _rotated(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _chained(hashes: Column, step: int, by: int) -> Column:
    """Each hash with the one step on, rotated: from the hashes of step words in a row to those of twice as many."""
    n = F.size(hashes) - step
    joined = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: a.bitwiseXOR(_rotated(b, by)))
    return F.transform(joined, lambda h: F.coalesce(h, F.lit(0).cast("long")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WIDTH words that are found at least twice among words.

    Windows are compared by 64-bit hashes, the words' own, each rotated by its place. Only texts with fewer distinct hashes
    than windows pay for the sort, which is n log n in the words of a text. It is one expression, since columns that build on
    each other would be written out inside each other by the optimizer.
    """
    of_words = F.transform(words, lambda w: F.xxhash64(w))
    by_window = _let(of_words, lambda h1: _let(_chained(h1, 1, 7), lambda h2: _let(_chained(h2, 2, 14), lambda h4: _chained(h4, 4, 28))))
    counted = _let(by_window, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WIDTH, counted).otherwise(F.lit(0).cast("long"))


def _covered(hashes: Column) -> Column:
    """Words that windows cover whose hash another one has. Numbers are sorted whose lower bits are a window's place and
    whose upper ones are its hash's."""
    place_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(hashes).cast("long")))) - 1

    def ranked(bits: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(bits)).bitwiseOR(i.cast("long")))
        return _let(F.sort_array(keyed), lambda r: _let(alike(r, bits), lambda same: _let(places(r, same, bits), _span)))

    def alike(r: Column, bits: Column) -> Column:
        n = F.size(r) - 1
        return F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(bits)) == 0)

    def places(r: Column, same: Column, bits: Column) -> Column:
        near = lambda j: F.coalesce(F.get(same, j - 1), F.lit(False)) | F.coalesce(F.get(same, j), F.lit(False))
        return F.array_sort(F.array_compact(F.transform(r, lambda x, j: F.when(near(j), x.bitwiseAND(bits)))))

    return _let(place_bits, ranked)


def _span(starts: Column) -> Column:
    """Words that windows at starts cover."""
    last = F.size(starts) - 1
    gaps = F.zip_with(F.slice(starts, F.lit(1), last), F.slice(starts, F.lit(2), last), lambda a, b: F.least(F.lit(WIDTH).cast("long"), b - a))
    return F.aggregate(gaps, F.lit(WIDTH).cast("long"), lambda acc, x: acc + x)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and COUNTS, of which rules may use all, and base_failed. Each count is taken once."""
    rows = slim(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", word_list(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(f"[^{WS}]"))))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_letters": (F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))).cast("long"),
    })
    return rows.drop("words", "lines").withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def _nanos() -> Column:
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def drawn(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text) of about so many rows of docs, all if there are fewer. Rows are drawn each for itself: copies of a text are
    drawn no more often than others, whatever their number."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    share = rows / max(1, docs.count())
    return texts.filter(F.rand(0) < share) if share < 1 else texts


def ordered_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by the share of a sample that each rejects per time of its own, best first.

    The sample stays in the executors, and each rule is timed there, row by row, against an expression that does nothing;
    two numbers a rule reach the driver.
    """
    sample = base_counts(drawn(docs, text_col, sample_rows), "text", "text").filter("not base_failed").drop("id").persist()

    def timed(predicate: Column) -> tuple[float, float]:
        # the clock makes the struct nondeterministic, so the optimizer leaves it whole and its fields in order
        each = sample.select(F.struct(_nanos().alias("began"), predicate.cast("double").alias("rejects"), _nanos().alias("ended")).alias("x"))
        row = each.agg(F.avg("x.rejects").alias("rejects"), F.median(F.col("x.ended") - F.col("x.began")).alias("nanos")).first()
        return row.rejects or 0.0, row.nanos or 0.0

    try:
        _, idle = timed(F.lit(False))
        scores = []
        for rule in rules:
            rejected, nanos = timed(rule.rejects())
            scores.append((rejected / max(nanos - idle, 1.0), rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(scores, key=lambda x: -x[0])]


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F
    for rule in rules:
        out = out.when(rule.rejects(), rule.name)
    return out if rules else F.lit(None).cast("string")


def _verdict(rules: list[Rule]) -> Column:
    return F.when(F.col("base_failed"), "base").otherwise(first_failure(rules))


def quality_cascade(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, the base counts, base_failed, failed_rule (null if none), kept."""
    order = ordered_rules(docs, rules, text_col)
    judged = base_counts(docs, id_col, text_col).withColumn("failed_rule", _verdict(order))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """docs without the rows that the base or a rule rejects, judged in the row itself: nothing is shuffled."""
    order = ordered_rules(docs, rules, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole, body = free_names(docs, "whole_row", "row_text")
    carried = docs.select(row.alias(whole), F.col(f"`{text_col}`").alias(body))
    judged = base_counts(carried, whole, body).withColumn("failed_rule", _verdict(order))
    # a generator, unlike a filter, is never pushed below the counts and written out of them
    return judged.select(F.inline(F.when(F.col("failed_rule").isNull(), F.array("id"))))
