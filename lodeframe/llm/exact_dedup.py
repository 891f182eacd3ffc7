"""Exact dedup by progressive refinement: length groups, then prefix hashes, then full hashes.

The first scan counts rows by (length, prefix hash), in each task before anything is shuffled; from these counts lengths
that one row has drop out, then prefixes that one row has. The second scan takes full hashes, of survivors only unless
all are asked for, and they alone decide.

Defined cases: a null text counts as empty; texts are equal when equal after each run of white space became one space,
however long they are; of equal texts the smallest id stays, and a null id comes after all others; rows that share an id
are one document: with equal texts all of them stay or go; an empty table gives an empty result; columns of docs other
than the two named are carried or left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SlotFilter, checkpoint, single_spaced, slim, slot_filter, without


def _normal(text: Column) -> Column:
    return single_spaced(F.coalesce(text, F.lit("")))


def _prefix(normal: Column, chars: int) -> Column:
    return F.xxhash64(F.substring(normal, 1, chars))


def surviving_groups(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """(length, prefix) of groups with more than one row, among the lengths that more than one row has; made of counts, so
    a length that very many rows have is no hot key."""
    normal = _normal(F.col("text"))
    keys = slim(docs, text=text_col).select(F.length(normal).alias("length"), _prefix(normal, prefix_chars).alias("prefix"))
    counts = checkpoint(keys.groupBy("length", "prefix").agg(F.count("*").alias("n")))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("of_length")).filter("of_length > 1").select("length")
    return counts.join(lengths, "length", "left_semi").filter("n > 1").select("length", "prefix")


def _survives(groups: SlotFilter, normal: Column, prefix_chars: int) -> Column:
    return groups.hit(F.length(normal), _prefix(normal, prefix_chars))


def _judged(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """(id, tag, digest, first, n) of every row of docs; first and n are of its group, null where it is alone."""
    groups = slot_filter(surviving_groups(docs, text_col, prefix_chars), "length", "prefix")
    normal = _normal(F.col("text"))
    hit, digest = _survives(groups, normal, prefix_chars), F.sha2(normal.cast("binary"), 256)
    rows = slim(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("tag"), hit.alias("hit"), (digest if digest_all else F.when(hit, digest)).alias("digest"))
    rows = checkpoint(rows)
    # min leaves nulls out, so a null id is first only where there is no other
    equal = rows.filter("hit").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = rows.filter("hit").join(equal, "digest", "left").select("id", "tag", "digest", "first", "n")
    alone = rows.filter("not hit").select("id", "tag", "digest", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("first"), F.lit(None).cast("long").alias("n"))
    return shared.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (null for rows that no group of the second
    step has, unless digest_all asks for it). Texts never cross the network: lengths, hashes and ids do."""
    keep = F.coalesce("first", "id")
    out = _judged(docs, id_col, text_col, prefix_chars, digest_all)
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() does not keep; only texts that may go are moved."""
    judged = _judged(docs, id_col, text_col, 64, False)
    dropped = checkpoint(judged.filter(~F.col("id").eqNullSafe(F.coalesce("first", "id"))).select("id", "tag"))
    return without(docs, dropped, id_col, text_col)
