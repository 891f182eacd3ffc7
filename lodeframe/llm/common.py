"""Helpers that the corpus operators share: word rules, slim inputs, reliable checkpoints."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters between words, as a Java regular-expression class body.
WS = r"\x20\x09-\x0D"


#: Tables that stored() wrote, by session.
_TABLES: dict[str, list[str]] = {}


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's spark.checkpoint.dir. Only on a local master, where driver and
    executors are one process, may it be unset: then it is a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodeframe-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, which cuts its lineage. Spark removes what no table
    refers to any more if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: for tables too large for checkpoint(), which does not pack."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables that stored() wrote in this application. Call it when results have been written: until then they
    are read from these tables."""
    jvm = spark.sparkContext._jvm
    for path in _TABLES.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Most rows of a few numbers each that are sent to every task.
BROADCAST_ROWS = 200_000


def broadcast_below(df: DataFrame, counted: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked to be broadcast if it (or counted, a table of as many rows that is at hand) has at most so many rows;
    a larger one is joined by a shuffle."""
    return F.broadcast(df) if (counted or df).limit(rows + 1).count() <= rows else df


def permutation(n: int, seed: list[int]) -> tuple[int, int]:
    """a, b such that x -> (a x + b) mod n permutes 0 to n - 1 and fits 64 bits."""
    rng = np.random.default_rng(seed)
    a = int(rng.integers(1, max(2, min(n, 2**62 // max(n, 1)))))
    while math.gcd(a, max(n, 1)) != 1:
        a += 1
    return a, int(rng.integers(0, max(n, 1)))


def slim(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that extra or clashing columns do no harm."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """names, with as many underscores before them as it takes to clash with no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while taken & set(names):
        names = tuple("_" + n for n in names)
    return list(names)


def single_spaced(text: Column) -> Column:
    """text with each run of white space as one space; a lone space is left as it is, unmatched."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{WS}]*|\x20[{WS}]+", " ")


def word_list(text: Column) -> Column:
    """The words of text in order; none for null, empty or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null, empty or blank text."""
    return F.size(word_list(text)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Least and most slots of a filter that goes to every task, a bit each: 128 kB and 2 MB. A filter has about eight slots a row
#: of what it holds; where that is more than the most, it lets more pass, to the exact join.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 24


@dataclass(frozen=True)
class SlotFilter:
    """Whether keys may be among those of a table: always so if they are, and by chance if they are not."""

    words: Column
    slots: int

    def hit(self, *keys: Column) -> Column:
        slot = _slot(self.slots, *keys)
        return F.getbit(F.get(self.words, F.shiftright(slot, 6).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1


def _slot(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def slot_bits(rows: DataFrame, slot: Column, slots: int) -> np.ndarray:
    """A bit for each of slots (a multiple of 64), least first in its byte: whether slot of a row is it.

    At most slots / 64 words reach the driver, and as Arrow columns of 12 bytes a word; as Row objects they would take
    some 500 there.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = rows.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    flags = np.zeros(slots // 64, dtype=np.int64)
    for batch in words.toArrow().to_batches():
        flags[batch["word"].to_numpy()] = batch["bits"].to_numpy()
    return flags.view(np.uint8)


def slot_filter(rows: DataFrame, *keys: str) -> SlotFilter:
    """The filter of the keys of rows, its words a scalar subquery; at most MOST_SLOTS / 64 of them reach the driver.

    A false hit costs work and no more, as what passes is joined or compared exactly afterwards.
    """
    n, slots = rows.count(), LEAST_SLOTS
    while slots < min(8 * n, MOST_SLOTS):
        slots *= 2
    words = slot_bits(rows, _slot(slots, *[F.col(k) for k in keys]), slots).view(np.int64)
    # the plan, its tasks and the subquery's result hold the words in several places at once
    return SlotFilter(rows.sparkSession.createDataFrame([(words.tolist(),)], "words array<long>").scalar(), slots)


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and text are those of a row of dropped (id, tag: xxhash64 of the text), null ids too.

    Rows that miss the filter of dropped pass straight on; only the others, and hardly more than are dropped, are joined.
    """
    own_id, tag = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    may = slot_filter(dropped, "id", "tag").hit(own_id, tag)
    gone = dropped.select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    asked = docs.filter(may)
    return docs.filter(~may).unionByName(asked.join(gone, own_id.eqNullSafe(F.col("__id")) & (tag == F.col("__tag")), "left_anti"))


def runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key in turn, as arrays by column, out of batches of a partition that is sorted by key."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        fresh = np.zeros(n - 1, dtype=bool)
        for k in key:
            fresh |= columns[k][1:] != columns[k][:-1]
        if held and any(held[-1][k][-1] != columns[k][0] for k in key):
            yield whole()
            held = []
        cuts = [0, *(np.flatnonzero(fresh) + 1), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append({c: v[a:b] for c, v in columns.items()})
            if b < n:
                yield whole()
                held = []
    if held:
        yield whole()


def release_memory() -> None:
    """Hand what this Python process has freed back to the system. Workers outlive their tasks, so what one step's arrays
    took counts against the executor while the next step runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def frames(parts: Iterator[dict[str, np.ndarray]], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Arrays by column, put together to frames of about so many rows: each frame that leaves a task has its price."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(next(iter(part.values())))
        if size >= rows:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in part})
            held, size = [], 0
    if size:
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of edges (a, b) reaches; by alternating large and small stars.

    Both steps are aggregations and joins by id; the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        pairs = checkpoint(small.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        mark = now
