"""Parts of a text by the brackets that are open, as Columns.

A fold copies what it has gathered at every step. So folds gather numbers, or parts of short texts (a parameter list, a
line of selectors); what may be as long as a file is cut by a function in the tasks, in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: What the folds step over: arrows and comparisons are no brackets.
_PIECES = r"(?s)->|[<>]=|\s[<>]\s|[(<\[{]|[)>\]}]|,|[^-(<\[{)>\]},=\s]++|."
_ROUND = r"(?s)[()]|[^()]++"
#: The same pieces but for those that say nothing.
_TELLING = re.compile(r"->|[<>]=|\s[<>]\s|[(<\[{]|[)>\]}]|,", re.ASCII)


def split_top_level(text: Column | str) -> Column:
    """Array of the parts of text between commas that no bracket encloses, as they stand; an empty text is one part."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("part"))

    def step(acc: Column, piece: Column) -> Column:
        opens, closes = piece.isin("(", "<", "[", "{"), piece.isin(")", ">", "]", "}")
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        ends = (piece == ",") & (acc["depth"] == 0)
        parts = F.when(ends, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"])
        return F.struct(depth.alias("depth"), parts.alias("parts"), F.when(ends, "").otherwise(F.concat(acc["part"], piece)).alias("part"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), start, step, lambda acc: F.concat(acc["parts"], F.array(acc["part"])))


def cut_top_level(text: Column, mark: str) -> Column:
    """Array of the parts of split_top_level(), each with the newlines (lines) and the characters mark (marks) of the parts
    before it; one pass over texts of any length."""

    def cut(whole: str | None) -> list[tuple[str, int, int]] | None:
        if whole is None:
            return None
        depth, ends = 0, []
        for found in _TELLING.finditer(whole):
            piece = found[0]
            if piece == "," and depth == 0:
                ends.append(found.start())
            elif piece in ("(", "<", "[", "{"):
                depth += 1
            elif piece in (")", ">", "]", "}"):
                depth = max(depth - 1, 0)
        begin, lines, marks, out = 0, 0, 0, []
        for end in [*ends, len(whole)]:
            part = whole[begin:end]
            out.append((part, lines, marks))
            begin, lines, marks = end + 1, lines + part.count("\n"), marks + part.count(mark)
        return out

    return F.udf(cut, "array<struct<part: string, lines: int, marks: int>>", useArrow=True)(text)


def in_parentheses(text: Column) -> Column:
    """Struct of what the first pair of parentheses encloses (body) and what comes after it (rest); null without any."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("opened"), F.lit(0).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        at, done = acc["at"] + F.length(piece), acc["closed"] > 0
        depth = F.when(piece == "(", acc["depth"] + 1).when(piece == ")", acc["depth"] - 1).otherwise(acc["depth"])
        opens, closes = ~done & (acc["depth"] == 0) & (depth == 1), ~done & (acc["depth"] == 1) & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(opens, at).otherwise(acc["opened"]).alias("opened"), F.when(closes, at).otherwise(acc["closed"]).alias("closed"))

    def cut(acc: Column) -> Column:
        closed, to_end = acc["closed"] > 0, F.lit(1 << 30)
        body = F.substring(text, acc["opened"] + 1, F.when(closed, acc["closed"] - 1 - acc["opened"]).otherwise(to_end))
        return F.struct(F.when(acc["opened"] > 0, body).otherwise("").alias("body"), F.when(closed, F.substring(text, acc["closed"] + 1, to_end)).otherwise("").alias("rest"))

    return F.when(F.contains(text, F.lit("(")), F.aggregate(F.regexp_extract_all(text, F.lit(_ROUND), F.lit(0)), start, step, cut))
