"""Outlines as the text of a class without bodies, many classes in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions import text as T
from lodeframe.functions.names import parent_name
from lodeframe.operators import forest

INDENT = 4
_TYPES = ("class", "interface", "enum", "record", "annotation", "object")


def nested(outlines: DataFrame) -> DataFrame:
    """outlines (target, ord, fqn, kind, any more) with path: the numbers of the rows around each row and its own.

    target is the class that is outlined, ord the order of its rows. A type's row opens a node under the last row before it
    of its parent's name; a member stands in the last node before it of its name. What has none stands at the top, and the
    first row of the target itself is the root: its path is empty; others of it are left out.
    """
    is_type = F.col("kind").isin(*_TYPES)
    is_root = is_type & (F.col("fqn") == F.col("target"))
    opens = is_type & ~is_root
    asks = F.when(opens, parent_name(F.col("fqn"))).when(~is_root, F.col("fqn"))
    marks = F.array_compact(F.array(F.when(opens, F.struct(F.col("fqn").alias("key"), F.lit(1).alias("turn"), F.col("ord").alias("opened"))), F.struct(asks.alias("key"), F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("opened"))))
    rows = outlines.withColumn("ord", F.col("ord").cast("bigint"))
    w = Window.partitionBy("target", "m.key").orderBy("ord", "m.turn").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("m", F.explode(marks)).withColumn("parent", F.last("m.opened", ignorenulls=True).over(w)).filter("m.turn = 0").drop("m")
    first_root = F.min(F.when(is_root, F.col("ord"))).over(Window.partitionBy("target"))
    kept = met.withColumn("root", first_root).filter(~is_root | (F.col("ord") == F.col("root")))
    nodes = kept.filter(opens).select("target", "ord", "parent")
    deepest = kept.agg(F.max(F.size(F.split("fqn", r"\."))).alias("d")).first().d or 1
    of_nodes = forest.paths(nodes, "target", "ord", "parent", deepest).select(F.col("target").alias("_t"), F.col("ord").alias("_o"), F.col("path").alias("around"))
    joined = kept.join(of_nodes, (F.col("target") == F.col("_t")) & (F.col("parent") == F.col("_o")), "left").drop("_t", "_o", "parent")
    path = F.when(is_root, F.array().cast("array<bigint>")).otherwise(F.concat(F.coalesce("around", F.array().cast("array<bigint>")), F.array("ord")))
    return joined.withColumn("path", path).withColumn("has_root", F.col("root").isNotNull()).drop("around", "root")


def _doc_lines(full: bool, pad: Column) -> Column:
    summary = T.doc_summary(F.col("javadoc"))
    short = F.when(summary != "", F.array(F.concat(pad, F.lit("/** "), summary, F.lit(" */"))))
    whole = F.transform(F.split("javadoc", "\n"), lambda x: F.concat(pad, F.when(F.startswith(F.ltrim(x), F.lit("*")), " ").otherwise(""), F.ltrim(x)))
    return F.coalesce(whole if full else short, F.array().cast("array<string>"))


def skeleton(outlines: DataFrame, heads: DataFrame, full: bool = False, javadoc: bool = True) -> DataFrame:
    """(target, n, line) of outlines (target, ord, fqn, kind, signature, javadoc) and heads (target, coordinates, provenance,
    stale, imports: array or null): a header, the package, imports, then types with braces around what they hold.

    full shows comments whole and marks bodies; else a comment is its first sentence.
    """
    rows = nested(outlines)
    is_type, level = F.col("kind").isin(*_TYPES), F.greatest(F.size("path") - 1, F.lit(0)) + F.when(F.col("has_root") & (F.size("path") > 0), 1).otherwise(0)
    pad = F.repeat(F.lit(" "), level * INDENT)
    docs = _doc_lines(full, pad) if javadoc else F.array().cast("array<string>")
    body = F.when(is_type, " {").when(F.lit(full) & F.col("kind").isin("method", "constructor"), " { … }").otherwise(";")
    opening = F.struct(F.transform("path", lambda x: x).alias("key"), F.concat(docs, F.array(F.concat(pad, "signature", body))).alias("lines"))
    closing = F.struct(F.concat("path", F.array(F.lit((1 << 63) - 1))).alias("key"), F.array(F.concat(pad, F.lit("}"))).alias("lines"))
    parts = rows.select("target", F.explode(F.when(is_type, F.array(opening, closing)).otherwise(F.array(opening))).alias("p"))
    dotted = F.contains("target", F.lit("."))
    first = F.concat(F.array(F.concat(F.lit("// "), "target"), F.concat(F.lit("// "), "coordinates", F.lit("  provenance "), "provenance")), F.when(F.col("stale"), F.array(F.lit("// stale index served"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    package = F.when(dotted, F.array(F.concat(F.lit("package "), parent_name(F.col("target")), F.lit(";")))).otherwise(F.array().cast("array<string>"))
    second = F.concat(package, F.coalesce("imports", F.array().cast("array<string>")))
    head = heads.select("target", F.struct(F.array(F.lit(-1).cast("bigint")).alias("key"), F.concat(first, F.when(F.size(second) > 0, F.concat(second, F.array(F.lit("")))).otherwise(second)).alias("lines")).alias("p"))
    # one outline is one class and what is nested in it; its lines are put in order together. Keys compare as arrays: the
    # root's is empty and comes first, so the header is put before all of them
    ordered = head.withColumn("turn", F.lit(0)).unionByName(parts.withColumn("turn", F.lit(1))).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("turn", "p.key", "p.lines"))).alias("all"))
    return ordered.select("target", F.posexplode(F.flatten(F.transform("all", lambda x: x["lines"]))).alias("n", "line")).withColumn("n", F.col("n") + 1)
