"""Sharding by histogram sort: exact bytes are counted below candidate key boundaries, probes are refined until the
splitters meet a tolerance, and documents are exchanged once.

The key of a document is the hash of its text followed by the hash of its id, as 32 hex digits, so equal texts lie side by
side. Groups of equal texts stay in one shard: large ones are dealt to shards first, small ones are not cut by a splitter.
Only a group that no shard has room for is split, at ids.

Defined cases: a null text counts as no bytes and groups with empty ones; repeated rows have equal keys and each gets a
slot of its own; ties of the key are rows alike in id and text, of which any may have any of their slots; a null id has a
key as any other; a very long text may fill a shard on its own; columns of docs other than the two named are carried or
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, free_names, slim

#: Hex digits by which a probe is refined in one round: 256 counts a splitter. Hex digits of the key that are of the text.
STEP, GROUP = 2, 16
#: Share of a shard's bytes from which a group of equal texts is large: there are at most shards / LARGE such groups.
LARGE = 0.01


def _hex16(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def shard_key(text: Column, doc_id: Column) -> Column:
    return F.concat(_hex16(F.xxhash64(F.coalesce(text, F.lit("")))), _hex16(F.xxhash64(doc_id)))


def _refined(prefix: str) -> int:
    """Digits of the probes that refine prefix; they stop where the text's part of the key ends."""
    return min(len(prefix) + STEP, GROUP) if len(prefix) < GROUP else len(prefix) + STEP


def _bucket(prefixes: list[str]) -> Column:
    """The probe of a key: some digits more than the one of prefixes that it starts with; null if none."""
    out = F
    for p in prefixes:
        out = out.when(F.startswith("key", F.lit(p)), F.substring("key", 1, _refined(p)))
    return out


def splitters(rows: DataFrame, room: list[float], tolerance: float = 0.001) -> list[str]:
    """Key boundaries that cut rows (key, size) into shards of about the bytes that each has room for, off by tolerance of a
    shard or by half of one group of equal texts. At most 256 counts a boundary reach the driver in a round."""
    total, have = sum(room), rows.agg(F.sum("size").alias("x")).first().x or 0
    wanted = {j: have * sum(room[:j]) / total for j in range(1, len(room))} if have and total else {}
    shard = have / len(room)
    inside, below, found = {j: "" for j in wanted}, {"": 0}, {}
    while len(found) < len(wanted):
        active = sorted({inside[j] for j in wanted if j not in found})
        probes = rows.withColumn("probe", _bucket(active)).filter("probe is not null")
        counted = probes.groupBy("probe").agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last")).collect()
        for p in active:
            edge, marks = below[p], []
            for row in sorted((r for r in counted if r.probe.startswith(p) and len(r.probe) == _refined(p)), key=lambda r: r.probe):
                marks.append((edge, edge + row.bytes, row))
                edge += row.bytes
            for j in [j for j in wanted if j not in found and inside[j] == p]:
                low, high, row = next(m for m in marks if m[1] >= wanted[j])
                fits = len(row.probe) <= GROUP and row.first[:GROUP] == row.last[:GROUP] and row.bytes <= shard
                if fits or row.bytes <= tolerance * shard or row.first == row.last:
                    # G sorts after every hex digit, so it ends the range of a probe
                    found[j] = row.probe if wanted[j] - low < high - wanted[j] else row.probe + "G"
                else:
                    inside[j] = os.path.commonprefix([row.first, row.last])
                    below[inside[j]] = low
    return [found[j] for j in sorted(found)]


def deal(groups: dict[str, int], shards: int, shard_bytes: float) -> tuple[dict[str, int], list[float]]:
    """(group -> shard, room left in each shard): large groups, largest first, to the emptiest shard; those that it has no
    room for are left out."""
    room, home = [shard_bytes] * shards, {}
    for group, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        j = max(range(shards), key=lambda k: (room[k], -k))
        if size <= room[j]:
            home[group] = j
            room[j] -= size
    return home, room


def placement(rows: DataFrame, shards: int, tolerance: float) -> Callable[[DataFrame], DataFrame]:
    """What adds the column shard to rows with a key, from the (key, size) of all of them."""
    whole = rows.agg(F.sum("size").alias("x")).first().x or 0
    group = F.substring("key", 1, GROUP)
    sums = rows.groupBy(group.alias("text_group")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = {r.text_group: r.bytes for r in sums.filter((F.col("n") > 1) & (F.col("bytes") > LARGE * whole / shards)).collect()}
    home, room = deal(large, shards, whole / shards)
    dealt = rows.sparkSession.createDataFrame(list(home.items()), "text_group string, dealt int")  # at most shards / LARGE rows

    def known(some: DataFrame) -> DataFrame:
        return some.withColumn("text_group", group).join(F.broadcast(dealt), "text_group", "left").drop("text_group")

    bounds = splitters(known(rows.select("key", "size")).filter("dealt is null"), room, tolerance)
    return lambda some: known(some).withColumn("shard", F.coalesce("dealt", shard_of(F.col("key"), bounds))).drop("dealt")


def shard_of(key: Column, bounds: list[str]) -> Column:
    below = F.filter(F.lit(bounds), lambda b: b <= key) if bounds else F.array()
    return F.size(below)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, block_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard; only these slim rows move.

    Rows are numbered by key in ranges of about block_rows rows, a group of copies that is larger in ranges of its own, and
    the counts of the ranges before are added, so no task has to hold a shard.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = slim(docs, id=id_col, text=text_col).select("id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), shard_key(F.col("text"), F.col("id")).alias("key"))
    rows = checkpoint(rows)
    n, digits = rows.count(), 0
    while block_rows * shards * 16**digits < n:
        digits += 1
    copies = rows.groupBy(F.substring("key", 1, 16).alias("copies")).agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    hot = [r.copies for r in copies.collect()]  # fewer than n / block_rows
    depth = F.when(F.substring("key", 1, 16).isin(hot), 16 + digits + 1).otherwise(digits) if hot else F.lit(digits)
    spread = checkpoint(placement(rows, shards, tolerance)(rows)).withColumn("block", F.substring("key", F.lit(1), depth))
    blocks = spread.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = blocks.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "id")) - 1
    out = spread.withColumn("place", place).join(offsets, ["shard", "block"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 1, tolerance: float = 0.001) -> None:
    """Write docs as path/shard=N (_shard=N if docs has a column shard): one exchange, straight to the file that a row
    belongs to; each file is sorted by key, rows of a shard are dealt to its files by a hash."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = (F.octet_length(F.coalesce(text, F.lit("")).cast("binary")) + 8).cast("long")
    place = placement(checkpoint(docs.select(shard_key(text, doc_id).alias("key"), size.alias("size"))), shards, tolerance)
    whole = docs.select(shard_key(text, doc_id).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    name, file, key = *free_names(docs, "shard"), *free_names(docs, "file_number", "shard_key")
    spread = place(whole).select("row.*", F.col("shard").alias(name), (F.col("shard") * files_per_shard + F.pmod(F.xxhash64("key"), F.lit(files_per_shard))).cast("int").alias(file), F.col("key").alias(key))
    moved = spread.repartitionById(shards * files_per_shard, F.col(file)).sortWithinPartitions(name, key)
    moved.drop(file, key).write.partitionBy(name).parquet(path)
