"""Subsequence matching with a score, as one native expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the score: equal names, a prefix, a match at a word start, next to the last match, anywhere else,
#: and the number of letters that cost one point.
EQUAL, PREFIX, BOUNDARY, ADJACENT, ANYWHERE, LETTERS_A_POINT = 100, 50, 30, 2, 1, 10


def fuzzy_score(query: Column | str, name: Column) -> Column:
    """Score of name for query (a str is the query itself) as int; null where the query's letters don't occur in order.

    A fold over the letters of the query: each is taken where it first occurs after the one before. Word starts are the
    first letter, an upper-case letter after a lower-case one, and what follows _ - or a dot. Where the query is given as
    text, one regular expression drops the names without its letters in order before any fold.
    """
    given, query = query if isinstance(query, str) else "", F.lit(query) if isinstance(query, str) else query
    q, t, low = F.lower(query), name, F.lower(name)
    start = F.struct(F.lit(0).alias("last"), F.when(F.startswith(low, q), PREFIX).otherwise(0).alias("score"))

    def step(acc: Column, i: Column) -> Column:
        def taken(at: Column) -> Column:
            boundary = (at == 1) | F.rlike(F.substring(t, at - 1, F.lit(2)), F.lit("^[a-z][A-Z]$")) | F.substring(t, at - 1, F.lit(1)).isin("_", "-", ".")
            points = F.when(boundary, BOUNDARY).when(acc["last"] == at - 1, ADJACENT).otherwise(ANYWHERE)
            return F.when((at > 0) & (at <= F.length(t)), F.struct(at.alias("last"), (acc["score"] + points).alias("score")))

        place = F.call_function("locate", F.substring(q, i, F.lit(1)), low, acc["last"] + 1)
        return F.when(acc.isNotNull(), F.get(F.transform(F.array(place), taken), F.lit(0)))  # the place is worked out once

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), start, step, lambda acc: acc["score"] - F.floor(F.length(t) / LETTERS_A_POINT).cast("int"))
    score = F.when(q == low, EQUAL).when(F.length(q) == 0, F.lit(None))
    if given and given.isascii():  # other letters may be lower-cased to more than one
        in_order = "".join(rf"[^\x{ord(c):02x}]*+\x{ord(c):02x}" for c in given.lower())
        score = score.when(~F.rlike(low, F.lit(rf"\A{in_order}")), F.lit(None))
    return score.otherwise(folded).cast("int")
