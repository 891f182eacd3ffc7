"""Statements of source files as rows: tokens by one regular expression, brackets by running sums over them.

A comment, string, text block or annotation is one token wherever it ends, so nothing in it is taken for code. A statement
is what stands between two of `;`, `{` and `}` outside of parentheses; in Kotlin an end of line ends one too, unless what
comes before or after it goes on. All windows and aggregations are by file: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: In a statement's code these stand for a documentation comment and for an annotation that deprecates.
DOC, DEPRECATED = "\uE000", "\uE001"
_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+(?:"|(?=\n)|\z)'
_ARGUMENTS = rf"\((?:[^()\"']++|{_STRING}|'[^'\n]*'|\((?:[^()\"']++|{_STRING}|'[^'\n]*'|\([^()]*+\))*\))*\)"
_TOKEN = "|".join((
    r"/\*(?s:.*?)(?:\*/|\z)", r"//[^\n]*+", r'"""(?s:.*?)(?:(?<!\\)"""+|\z)', _STRING, r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'", r"`[^`\n]++`",
    rf"@(?!interface\b)[A-Za-z_][\w.:]*+(?:[ \t]*{_ARGUMENTS})?", r"\n", r"[^\S\n]++", r"[(){}\[\];]", r"[^\s\"'/`@(){}\[\];]++", r"(?s:.)",
))
_GOES_ON_AFTER = r"(?:[,=:+*/&|<.?]|->|\b(?:in|is|as|by|else|extends|where))\z"
_GOES_ON_BEFORE = r"\A(?:[.:=?{)\]]|&&|\|\||(?:where|by|else)\b)"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _open(total: str, before: WindowSpec) -> Column:
    """How many brackets are open, by the running total of those opened less those closed: one too many closes nothing."""
    return F.coalesce(F.last(total).over(before) - F.least(F.lit(0), F.min(total).over(before)), F.lit(0)).cast("int")


def tokens(files: DataFrame) -> DataFrame:
    """(path, kotlin, i, token, comment, nl, line, inside) of files (path, text): tokens but white space, with the newlines
    in them, the line on which they begin, and whether parentheses or square brackets enclose them."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    kotlin = F.rlike("path", F.lit(r"(?i)\.kts?\z"))
    cut = files.select("path", kotlin.alias("kotlin"), F.posexplode(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))).alias("i", "token"))
    real = cut.filter(~F.rlike("token", F.lit(r"\A[^\S\n]+\z"))).withColumn("comment", F.rlike("token", F.lit(r"\A/[*/]"))).withColumn("nl", newlines(F.col("token")))
    order = Window.partitionBy("path").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("token").isin("(", "["), 1).when(F.col("token").isin(")", "]"), -1).otherwise(0)
    counted = real.select("*", (F.coalesce(F.sum("nl").over(before), F.lit(0)) + 1).cast("int").alias("line"), F.sum(change).over(order).alias("round"))
    return counted.withColumn("inside", _open("round", before) > 0).drop("round")


def statements(files: DataFrame) -> DataFrame:
    """(path, kotlin, id, depth, ends, code, line_start, line_last, line_end, docs) of files (path, text).

    id orders a file's statements; ends is `;`, `{`, `}`, a newline, or null at the end of the file; code has its newlines,
    strings are empty and comments blank in it; docs are its documentation comments with their lines. Statements without
    code are kept: they end blocks.
    """
    order = Window.partitionBy("path").orderBy("i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    newline, code = F.col("token") == "\n", ~F.col("comment") & (F.col("token") != "\n")
    rows = tokens(files).withColumns({
        "code_before": F.last(F.when(code, F.col("token")), ignorenulls=True).over(before), "any_before": F.last(F.when(~F.col("comment"), F.col("token")), ignorenulls=True).over(before),
        "code_after": F.last(F.when(code, F.col("token")), ignorenulls=True).over(after),
    })
    goes_on = F.rlike("code_before", F.lit(_GOES_ON_AFTER)) | F.coalesce(F.rlike("code_after", F.lit(_GOES_ON_BEFORE)), F.lit(False))
    ends_line = F.col("kotlin") & newline & ~F.coalesce(F.col("any_before").isin("\n", ";", "{", "}") | F.startswith("any_before", F.lit("@")), F.lit(True)) & ~goes_on
    ends = ~F.col("inside") & (F.col("token").isin(";", "{", "}") | ends_line)
    braces = F.when(ends & (F.col("token") == "{"), 1).when(ends & (F.col("token") == "}"), -1).otherwise(0)
    numbered = rows.withColumns({"ends": F.when(ends, F.col("token")), "total": F.sum(braces).over(order)}).withColumns({
        "id": F.coalesce(F.sum(F.when(F.col("ends").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)), "depth": _open("total", before),
    })
    doc = F.startswith("token", F.lit("/**")) & (F.length("token") > 4)
    gap = F.repeat(F.lit("\n"), F.col("nl").cast("int"))
    told = F.when(doc, F.concat(F.lit(DOC), gap)).when(F.col("comment"), F.concat(F.lit(" "), gap)).when(F.rlike("token", F.lit(r"\A@(?:java\.lang\.|kotlin\.)?Deprecated\b")), F.concat(F.lit(DEPRECATED), gap))
    told = told.when(F.rlike("token", F.lit(r"\A@[A-Za-z_]")), F.concat(F.lit(" "), gap)).when(F.rlike("token", F.lit(r"\A[\"']")), F.concat(F.lit('""'), gap)).when(F.col("ends").isNotNull(), "").otherwise(F.col("token"))
    # a blank between tokens that are words on both sides; all other white space says nothing
    own = F.col("ends").isNull() & code
    ordered = F.array_sort(F.collect_list(F.struct("i", "told")))
    return numbered.withColumn("told", told).groupBy("path", "id").agg(
        F.first("kotlin").alias("kotlin"), F.min("depth").alias("depth"), F.max("ends").alias("ends"), F.array_join(F.transform(ordered, lambda x: x["told"]), " ").alias("code"),
        F.min(F.when(own, F.col("line"))).alias("line_start"), F.max(F.when(own, F.col("line") + F.col("nl"))).cast("int").alias("line_last"), F.max(F.when(F.col("ends").isNotNull(), F.col("line"))).alias("line_end"),
        F.transform(F.array_sort(F.collect_list(F.when(doc, F.struct("i", "line", "token")))), lambda d: F.struct(d["line"].alias("line"), d["token"].alias("text"))).alias("docs"),
    )
