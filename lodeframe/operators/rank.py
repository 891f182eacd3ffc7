"""Tiered ranking, first-wins picks and winners with alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.fuzzy import fuzzy_score
from lodeframe.functions.names import is_exact, is_suffix, simple_name

#: Hits of the fuzzy tier that a search returns, and of a member search.
NAME_LIMIT, MEMBER_LIMIT = 20, 50
#: Lower-case letters and digits, a bit each in letters(), and the parts that the names under one letter are dealt to.
KNOWN, PARTS = "abcdefghijklmnopqrstuvwxyz0123456789", 64


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Spark limits each task to one row a key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def winner_alternatives(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, winner (value of the first row in order), alternatives (the other distinct values, sorted).

    Aggregated twice, by (keys, value) and then by keys: a hot key is reduced to its values before it is gathered.
    """
    firsts = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    picked = firsts.groupBy(*keys).agg(F.min(F.struct("_first", F.col(value).alias("v"))).getField("v").alias("winner"), F.array_sort(F.collect_set(value)).alias("_all"))
    return picked.withColumn("alternatives", F.array_except("_all", F.array("winner"))).drop("_all")


def tier(name: Column, query: str) -> Column:
    """0 exact, 1 whole trailing segments, 2 simple name, 3 the rest; the score is only worked out for those."""
    q = F.lit(query)
    return F.when(is_exact(name, q), 0).when(is_suffix(name, q), 1).when(simple_name(name) == q, 2).otherwise(3)


def tiered_search(names: DataFrame, name: str, query: str, order: list[str], limit: int = NAME_LIMIT) -> DataFrame:
    """Rows whose name is hit, with tier and score; tiers 0 to 2 whole, tier 3 the best `limit` by score, then order."""
    ranked = names.withColumn("tier", tier(F.col(name), query))
    scored = ranked.withColumn("score", F.when(F.col("tier") == 3, fuzzy_score(query, F.col(name))).otherwise(0))
    sure = scored.filter("tier < 3")
    fuzzy = scored.filter("tier = 3 and score is not null").orderBy(F.desc("score"), *order).limit(limit)
    return sure.unionByName(fuzzy)


def letters(name: Column) -> Column:
    """The lower-case letters and digits of a name as bits of a long; other characters share one bit."""
    low = F.lower(name)
    held = [F.when(F.contains(low, F.lit(c)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(KNOWN)]
    out = F.when(F.rlike(low, F.lit("[^a-z0-9]")), F.lit(1 << len(KNOWN))).otherwise(F.lit(0)).cast("long")
    for bit in held:
        out = out.bitwiseOR(bit)
    return out


def search_many(names: DataFrame, name: str, queries: DataFrame, query: str, order: list[str], limit: int = NAME_LIMIT) -> DataFrame:
    """The best `limit` fuzzy hits of every query (queries: query, any more) among names, with score and rn.

    A name is tried only if it holds all letters of the query: names lie under each letter that some query looks under,
    queries under the one of theirs that the fewest names hold, so a query meets no other names; of these the letters as
    bits drop more before the score is taken, and each task keeps `limit` hits a query. Names under one letter are dealt
    to PARTS parts, each of which has the letter's queries. Two rows are broadcast; both sides of the join may be of any
    size and are merged, as what a table takes as a file says little of its names by letter. Queries without a letter or
    digit meet nothing but under the mark for other characters; an empty or null query has no hits.
    """
    marks = range(len(KNOWN) + 1)
    split = lambda has: F.filter(F.sequence(F.lit(0), F.lit(len(KNOWN))), lambda k: F.call_function("getbit", has, k) == 1)
    marked = names.withColumn("_has", letters(F.col(name)))
    held = [F.coalesce(F.sum(F.call_function("getbit", F.col("_has"), F.lit(k)).cast("long")), F.lit(0)) for k in marks]
    wanted = queries.filter(F.length(query) > 0).withColumn("_wants", letters(F.col(query))).crossJoin(F.broadcast(marked.agg(F.array(*held).alias("_held"))))
    rarest = F.array_min(F.transform(split(F.col("_wants")), lambda k: F.struct(F.get("_held", k).alias("n"), k.alias("letter"))))["letter"]
    asked = wanted.withColumn("_letter", rarest).drop("_held")
    used = asked.agg(F.bit_or(F.expr("shiftleft(1L, _letter)")).alias("_used"))
    under = marked.crossJoin(F.broadcast(used)).withColumn("_letter", F.explode(split(F.col("_has").bitwiseAND(F.col("_used"))))).drop("_used")
    dealt = under.withColumn("_part", F.pmod(F.xxhash64(name, *order), F.lit(PARTS)).cast("int"))
    everywhere = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = everywhere.hint("merge").join(dealt, ["_letter", "_part"]).filter(F.col("_wants").bitwiseAND(F.col("_has")) == F.col("_wants"))
    scored = met.withColumn("score", fuzzy_score(F.col(query), F.col(name))).filter("score is not null").drop("_letter", "_part", "_has", "_wants")
    return top_per_key(scored, [query], [F.desc("score"), *order], limit)


def member_search(members: DataFrame, name: str, query: str, order: list[str], limit: int = MEMBER_LIMIT) -> DataFrame:
    """Best `limit` members by tier (equal, prefix, else), score and order; the tiers mind case, the score does not."""
    n, q = F.col(name), F.lit(query)
    level = F.when(n == q, 0).when(F.startswith(n, q), 1).otherwise(2)
    scored = members.withColumn("score", fuzzy_score(query, n)).filter("score is not null").withColumn("tier", level)
    return scored.orderBy("tier", F.desc("score"), *order).limit(limit)


def closest(names: DataFrame, name: str, query: str, n: int = 3) -> DataFrame:
    """The n names nearest to query, by the better of both directions."""
    scored = names.withColumn("score", F.greatest(fuzzy_score(query, F.col(name)), fuzzy_score(F.col(name), F.lit(query))))
    return scored.filter("score is not null").orderBy(F.desc("score"), name).limit(n)


def degraded(rows: DataFrame, bad: Column, label: Column, what: str, order: list[str], shown: int = 3) -> DataFrame:
    """One row (n, note): how many rows are bad, and the first few labels; only `shown` labels are gathered."""
    wrong = rows.filter(bad)
    first = wrong.orderBy(*order).limit(shown).agg(F.array_join(F.array_sort(F.collect_list(F.struct(*order, label.alias("_label")))).getField("_label"), ", ").alias("_first"))
    count = wrong.agg(F.count("*").alias("n"))
    return count.join(first, F.lit(True), "left").select("n", F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(f" {what} ("), F.col("_first"), F.lit(")"))).alias("note"))


def first_nonempty(candidates: list[DataFrame]) -> DataFrame:
    """All rows of the first candidate that has any, with its priority; decided in one plan."""
    tagged = None
    for k, df in enumerate(candidates):
        one = df.withColumn("priority", F.lit(k))
        tagged = one if tagged is None else tagged.unionByName(one)
    least = tagged.agg(F.min("priority").alias("priority"))
    return tagged.join(F.broadcast(least), "priority")
