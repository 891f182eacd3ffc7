"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a seeded hash. A source's blocks are permuted, and as many of them make its
quota as it takes to reach its target, in a second round if need be. A tree splits the quotas of all sources exactly
among the output shards: at each node half the shards get a random subset of the node's blocks, whose counts by source
are therefore multivariate hypergeometric. A shard then draws the next blocks of each permutation, as many as its quotas
say: blocks are drawn once a round, and all quotas are used up. What no shard draws is not taken. Rows of a shard are
ordered by a hash, which shuffles them locally.

Blocks are at most BLOCKS in all and one a source, whatever the input, so quotas, tree and permutations are small tables.

Defined cases: a null text has size 0 and nothing is taken of it; null is a source of its own, ordered last; rows that
share an id, or repeat in whole, count as separate documents; sources without words get target 0; equal hashes are put in
order by id and size; a very long text belongs to one block as any other; an empty table gives an empty result.
The last block that a source's target needs is taken in part: its documents in order of their hash, and of the last of
these the first words, so a source's taken words are its target, rounded. mix() names its columns so that they clash with
none of the table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WS, checkpoint, free_names, slim, word_count

#: Weights of the sources by code point, repeating; share of all words that the mix has; most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a block, about; most blocks in all besides one a source, beyond which blocks are larger.
BLOCK_WORDS, BLOCKS = 8192, 1 << 16
#: Words of a partition of a shard that mix() makes, about.
PART_WORDS = 20_000_000

_DRAWN = "array<struct<copy:int,shard:int,limit:bigint,part:boolean>>"


def targets(sizes: list[int], weights: list[int], share: float = SHARE, most: int = MOST) -> list[float]:
    """Words to take of each source: share of all words by weight, at most `most` times a source; excess is reshared."""
    left, weight = share * sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda s: (most * sizes[s] / weights[s], s))
    for k, s in enumerate(order):
        if most * sizes[s] * weight > weights[s] * left:
            for r in order[k:]:
                out[r] = weights[r] * left / weight
            break
        out[s] = float(most * sizes[s])
        left -= out[s]
        weight -= weights[s]
    return out


def _hash(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's blocks a shard draws; columns add up to quotas exactly.

    A node for shards first to first + n - 1 ranks its blocks, (source, number), by a hash of node and block, so a rerun
    repeats the draw; the first half of the shards gets the first blocks.
    """
    leaves = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(first: int, n: int, have: np.ndarray) -> None:
        if n == 1:
            leaves[first] = have
            return
        half = n // 2
        ranked = sorted((_hash(seed, first, n, s, k), s) for s, count in enumerate(have.tolist()) for k in range(count))
        left = np.bincount([s for _, s in ranked[: len(ranked) * half // n]], minlength=len(have))
        split(first, half, left)
        split(first + half, n - half, have - left)

    if quotas and shards:
        split(0, shards, np.asarray(quotas, dtype=np.int64))
    return leaves


def draw_blocks(words: list[dict[int, int]], wanted: list[int], shards: int, seed: int, most: int = MOST) -> list[tuple[int, int, int, int, int]]:
    """(source, block, copy, shard, limit): the blocks that shards draw, and the words of them that are taken.

    words: for each source the words of its blocks, of which those without words are never drawn.
    """
    tickets = []
    for s, (own, need) in enumerate(zip(words, wanted, strict=True)):
        order = sorted((b for b, n in own.items() if n), key=lambda b: (_hash(seed, s, b), b))
        drawn = []
        for copy in range(most):
            for b in order:
                if need > 0:
                    drawn.append((b, copy, min(need, own[b])))
                    need -= own[b]
        tickets.append(drawn)
    leaves = split_quotas([len(t) for t in tickets], shards, seed)
    out = []
    for s, drawn in enumerate(tickets):
        following = iter(drawn)
        for shard in range(shards):
            out += [(s, b, copy, shard, limit) for _, (b, copy, limit) in zip(range(leaves[shard, s]), following, strict=False)]
    return out


def _rank(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in its source, 32 hex digits; the text is in it, so an id that many rows share is no hot block."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _block(rank: Column, blocks: Column) -> Column:
    return (F.conv(F.substring(rank, 1, 12), 16, 10).cast("long") % blocks).cast("int")


class Plan:
    """What a mix takes: sources (source, no_source, source_size, target, blocks) and draws by block, both small tables."""

    def __init__(self, rows: DataFrame, shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 0) -> None:
        """rows: (source, size, rank), checkpointed. Sources are a catalogue: one row each reaches the driver."""
        spark, self.seed, self.shards = rows.sparkSession, seed, shards
        keyed = rows.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
        sizes = sorted(keyed.groupBy("source", "no_source").agg(F.sum("size").alias("words")).collect(), key=lambda r: (r.no_source, r.source))
        wanted = targets([r.words for r in sizes], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))])
        self.words = sum(r.words for r in sizes)
        per_block = max(block_words, -(-self.words // BLOCKS))
        blocks = [max(1, -(-r.words // per_block)) for r in sizes]
        table = [(r.source, r.no_source, k, r.words, wanted[k], blocks[k]) for k, r in enumerate(sizes)]
        self.sources = spark.createDataFrame(table, "source string, no_source boolean, source_number int, source_size long, target double, blocks long")
        own: list[dict[int, int]] = [{} for _ in sizes]
        in_blocks = keyed.join(self.sources, ["source", "no_source"]).groupBy("source_number", _block(F.col("rank"), F.col("blocks")).alias("block"))
        for r in in_blocks.agg(F.sum("size").alias("words")).collect():  # at most BLOCKS and one a source
            own[r.source_number][r.block] = r.words
        drawn = draw_blocks(own, [math.floor(x + 0.5) for x in wanted], shards, seed)
        at: dict[tuple[int, int], list[tuple]] = {}
        for s, b, copy, shard, limit in sorted(drawn, key=lambda d: d[2]):
            at.setdefault((s, b), []).append((copy, shard, limit, limit < own[s][b]))
        schema = f"source_number int, block int, drawn {_DRAWN}"
        self.drawn = spark.createDataFrame([(s, b, d) for (s, b), d in at.items()], schema)

    def draws(self, rows: DataFrame, size: Column) -> DataFrame:
        """rows (id, source, rank, any more) with source_size, target, size, and draws: array of (copy, words, shard, order).

        Only documents of blocks that are taken in part, one a source at most, are put in order.
        """
        known = rows.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
        known = known.join(F.broadcast(self.sources), ["source", "no_source"]).withColumn("block", _block(F.col("rank"), F.col("blocks")))
        known = known.join(F.broadcast(self.drawn), ["source_number", "block"], "left")  # BLOCKS rows and one a source at most
        cut = F.coalesce(F.exists("drawn", lambda d: d["part"]), F.lit(False))
        order = lambda d: F.xxhash64(F.lit(self.seed), F.col("rank"), d["copy"])

        def taken(words) -> Column:
            each = F.transform(F.coalesce("drawn", F.array().cast(_DRAWN)), lambda d: F.struct(d["copy"].alias("copy"), words(d).alias("words"), d["shard"].alias("shard"), order(d).alias("order")))
            return F.filter(each, lambda d: d["words"] > 0)

        sized = known.withColumn("size", size)
        whole = sized.filter(~cut).withColumn("draws", taken(lambda d: F.col("size")))
        before = Window.partitionBy("source_number", "block").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
        some = sized.filter(cut).withColumn("start", F.sum("size").over(before) - F.col("size"))
        part = lambda d: F.when(d["part"], F.greatest(F.lit(0), F.least("size", d["limit"] - F.col("start")))).otherwise(F.col("size"))
        out = whole.unionByName(some.withColumn("draws", taken(part)).drop("start"))
        return out.withColumn("source", F.when(~F.col("no_source"), F.col("source"))).drop("no_source", "source_number", "block", "blocks", "drawn")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = slim(docs, id=id_col, text=text_col, source=source_col)
    return checkpoint(rows.select("id", "source", word_count(F.col("text")).alias("size"), _rank(F.col("id"), F.col("text"), seed).alias("rank")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, taken, draws; texts are read once and stay put."""
    rows = _slim(docs, id_col, text_col, source_col, seed)
    out = Plan(rows, seed=seed, **options).draws(rows, F.col("size"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mix_columns(docs: DataFrame) -> list[str]:
    """Names of the columns that mix() adds: mix_shard, mix_order and mix_copy, unless docs has one of them."""
    return free_names(docs, "mix_shard", "mix_order", "mix_copy")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: int = 0, **options) -> DataFrame:
    """The mix itself: a row of docs once per draw, and mix_columns(). Each partition has rows of one shard, in order, and
    partitions are numbered by shard and order, so writing it writes the shards.

    A draw of part of a document is its text up to the end of the last word that is drawn, white space and all.
    """
    plan = Plan(_slim(docs, id_col, text_col, source_col, seed), shards=shards, seed=seed, **options)
    own_text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(own_id.alias("id"), F.col(f"`{source_col}`").alias("source"), _rank(own_id, own_text, seed).alias("rank"), row.alias("row"))
    text = F.col("row").getField(text_col)
    drawn = plan.draws(carried, word_count(text)).select("row", "size", F.explode("draws").alias("draw"))
    # the text up to the end of its last drawn word: what the split leaves whole is the rest; a leading blank splits off ""
    led = F.rlike(text, F.lit(rf"^[{WS}]")).cast("int")
    rest = F.element_at(F.split(text, rf"[{WS}]+", F.col("draw.words").cast("int") + led + 1), -1)
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), rf"[{WS}]+\z", "")
    cut = F.when(F.col("draw.words") < F.col("size"), head).otherwise(text)
    parts = max(1, -(-round(SHARE * plan.words) // (shards * PART_WORDS)))
    range_of = F.floor((F.col("draw.order").cast("double") / 2.0**64 + 0.5) * parts)
    partition = F.col("draw.shard") * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), range_of)).cast("int")
    columns = [cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    named = [F.col("draw." + k).alias(n) for k, n in zip(("shard", "order", "copy"), mix_columns(docs), strict=True)]
    order, spot = mix_columns(docs)[1], free_names(docs, "mix_partition")[0]
    return drawn.select(*columns, *named, partition.alias(spot)).repartitionById(shards * parts, F.col(spot)).drop(spot).sortWithinPartitions(order)
