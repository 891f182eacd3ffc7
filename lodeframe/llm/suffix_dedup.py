"""Removal of long repeated byte strings by suffix arrays.

A byte goes if a string of WINDOW bytes covers it that also starts earlier in the corpus: at a smaller id, or earlier in
the same document. The steps:

1. Every window belongs to the least hash of the GRAM-byte strings in it, so equal windows share that key. Neighbouring
   windows with one key form a run. Keys that occur once cannot hold a repeat and end here.
2. Equal runs are pre-aggregated to their first occurrence; later ones are repeats in whole.
3. First occurrences whose key has several different runs, or a run that holds it twice, go to shards by key. A shard makes its suffix array by
   Larsson-Sadakane refinement and the common prefixes by Kasai's rule, and so finds windows that start earlier.
4. A key with very many runs is spread over several shards; what each of them holds first is then merged in sorted lists
   by binary search.

Defined cases: a null text is empty; texts shorter than WINDOW bytes lose nothing; very long texts are hashed in chunks;
a null id comes before all others; rows with equal id and text are one document, rows with equal id and other text are
ordered by a hash of it; columns of docs other than the two named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, frames, runs, slim, slot_bits, slot_filter, stored

WINDOW, GRAM = 100, 24
#: Window starts that are hashed at once, so that a very long text needs no more memory.
CHUNK = 1 << 16
#: Least and most bits of the filter of repeated keys that every task gets: 4 and 32 MB, about eight bits a key in between.
#: Beyond that it lets more through, to the exact join.
LEAST_BITS, MOST_BITS = 1 << 25, 1 << 28
#: Runs of a shard, about, and most runs of one key in a shard.
SHARD_RUNS, SPREAD_RUNS = 1500, 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(CHUNK + WINDOW + 1, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_runs(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, hash of the run, start, windows, again) of the runs of windows of a text, as arrays.

    again: the least gram of the run occurs more than once in it, without which no window can repeat inside a run.
    """
    parts = []
    up, down = _powers()
    for at in range(0, len(body) - WINDOW + 1, CHUNK):
        b = np.frombuffer(body[at : at + CHUNK + WINDOW - 1], dtype=np.uint8).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)))
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1])
        width, least = 1, grams
        while width * 2 <= WINDOW - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - GRAM + 1 - width
        keys = np.minimum(least[: len(least) - rest], least[rest:])
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys)) + WINDOW - 1
        whole = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        left = np.append((grams[: len(keys) - 1] == keys[:-1]) & (keys[1:] == keys[:-1]), False)
        parts.append((keys[starts], whole, starts + at, ends - starts - WINDOW + 1, np.logical_or.reduceat(left, starts)))
    if not parts:
        return tuple(np.empty(0, dtype=d) for d in (np.uint64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _stable_order(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of non-negative keys below 2 ** width; ties stay in order. Where key and place fit one
    number, numbers are sorted, which is several times faster than an indirect sort."""
    bits = max(1, int(len(keys)).bit_length())
    if width + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort((keys << bits) | np.arange(len(keys)))
    return both & ((1 << bits) - 1), both >> bits


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of its suffixes.

    Larsson-Sadakane: ranks by a few bytes, then positions whose rank is shared are sorted anew by the rank of the
    position as many bytes on as the ranks tell apart; settled positions are left alone.
    """
    n = len(text)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, dtype=np.int64)
    code[used] = np.arange(1, len(used) + 1)
    width = int(len(used)).bit_length()
    told = max(1, (63 - int(n).bit_length()) // width)
    coded = np.concatenate((code[text], np.zeros(told, dtype=np.int64)))
    wide = np.zeros(n, dtype=np.int64)
    for k in range(told):
        wide = (wide << width) | coded[k : k + n]
    order, keys = _stable_order(wide, told * width)
    rank = np.zeros(n + 1, dtype=np.int64)
    slots = np.arange(n)
    while True:
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        first = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))]
        rank[order[slots]] = first + 1
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return order
        here = order[slots]
        by, keys = _stable_order(rank[here] * (n + 1) + rank[np.minimum(here + told, n)], 2 * int(n + 1).bit_length())
        order[slots] = here[by]
        told *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = WINDOW, stride: int = 64) -> np.ndarray:
    """For each place in order, the bytes shared with the one before, at most cap.

    Kasai's rule, that a position shares at least one byte less than the one before it in the text, is followed from
    every stride-th position on, all of them at once.
    """
    n = len(order)
    padded = np.concatenate((text.astype(np.int16), np.full(cap, -1, dtype=np.int16)))
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    lengths = np.zeros(-(-n // stride), dtype=np.int64)
    for k in range(min(stride, n)):
        at = np.arange(k, n, stride)
        i, j = at, before[at]
        length = np.where(j < 0, 0, np.maximum(lengths[: len(at)] - 1, 0))
        live = np.flatnonzero((j >= 0) & (length < cap))
        while len(live):
            more = length[live]
            live = live[padded[i[live] + more] == padded[j[live] + more]]  # padding ends it: no two suffixes end alike
            length[live] += 1
            live = live[length[live] < cap]
        shared[at] = length
        lengths[: len(at)] = length
    return shared[order]


def first_windows(unit: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs in unit (rows sorted by id, tag, start): (row, offset) of every window, the number of its class of
    equal windows in sorted order, and whether it is the first of its class."""
    bodies = [np.frombuffer(b, dtype=np.uint8) for b in unit["body"]]
    lengths = np.array([len(b) for b in bodies])
    text = np.concatenate(bodies)
    order = suffix_array(text)
    prefixes = common_prefixes(text, order)
    row = np.repeat(np.arange(len(bodies)), lengths)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    klass = np.empty(len(row), dtype=np.int64)
    klass[order] = np.cumsum(prefixes < WINDOW)
    inside = offset < unit["windows"][row]
    row, offset, klass = row[inside], offset[inside], klass[inside]
    # rows are in corpus order, but runs of one document may overlap: order by start of the window
    doc = np.cumsum(np.concatenate(([True], (unit["id"][1:] != unit["id"][:-1]) | (unit["tag"][1:] != unit["tag"][:-1]))))
    at = np.lexsort((offset + unit["start"][row], doc[row], klass))
    fresh = np.concatenate(([True], klass[at][1:] != klass[at][:-1]))
    first = np.zeros(len(row), dtype=bool)
    first[at[fresh]] = True
    return row, offset, klass, first


def _spans(unit: dict[str, np.ndarray], row: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
    """(id, tag, a, b): byte spans that windows cover; neighbouring windows of a run give one span."""
    at = np.lexsort((offset, row))
    row, offset = row[at], offset[at]
    fresh = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))[: len(row)])
    ends = np.append(fresh[1:], len(row))[: len(fresh)] - 1
    first, start = row[fresh], unit["start"]
    return {"id": unit["id"][first], "tag": unit["tag"][first], "a": start[first] + offset[fresh], "b": start[first] + offset[ends] + WINDOW}


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, body): ids with null as the least number, a hash of the text, and its bytes."""
    text = F.coalesce("text", F.lit(""))
    return slim(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("body"))


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(key): keys whose gram occurs more than once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [window_runs(b) for b in batch["body"]]
            # a key that one run holds twice counts twice
            keys, n = np.unique(np.concatenate([k for r in found for k in (r[0], r[0][r[4]])]), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
            yield pd.DataFrame({"key": keys.view(np.int64), "n": n})

    counted = docs.select("body").mapInPandas(count, "key long, n long")
    return checkpoint(counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a repeated key falls in; at most MOST_BITS / 64 words reach the driver."""
    n, bits = keys.count(), LEAST_BITS
    while bits < min(8 * n, MOST_BITS):
        bits *= 2
    return slot_bits(keys, F.pmod(F.col("key"), F.lit(bits)), bits)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(key, hash, windows, id, tag, start, again): the runs whose key occurs more than once, and a few more: a key that the
    filter lets through by chance has one run, of which later steps make nothing."""
    keys = repeated_keys(docs)
    flags = docs.sparkSession.sparkContext.broadcast(_key_filter(keys))

    def of(batch: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        for doc_id, tag, body in zip(batch["id"].to_numpy(), batch["tag"].to_numpy(), batch["body"], strict=True):
            key, whole, start, windows, again = window_runs(body)
            slot = (key & np.uint64(8 * len(flags.value) - 1)).astype(np.int64)
            hit = np.flatnonzero((flags.value[slot >> 3] >> (slot & 7)) & 1)
            yield {"key": key[hit].view(np.int64), "hash": whole[hit].view(np.int64), "windows": windows[hit], "id": np.full(len(hit), doc_id), "tag": np.full(len(hit), tag), "start": start[hit], "again": again[hit]}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(part for batch in batches for part in of(batch))

    return stored(docs.mapInPandas(find, "key long, hash long, windows long, id long, tag long, start long, again boolean"))


def _with_bodies(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """picked (id, tag, start, windows, shard, spread) with the bytes of each run; only texts that are needed are moved."""
    fields = ["start", "windows", "shard", "spread"]
    wanted = checkpoint(picked.groupBy("id", "tag").agg(*[F.collect_list(c).alias(c) for c in fields]))
    texts = docs.filter(slot_filter(wanted, "id", "tag").hit(F.col("id"), F.col("tag"))).dropDuplicates(["id", "tag"]).join(wanted, ["id", "tag"])

    def of(batch: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        for doc_id, tag, body, *own in zip(batch["id"].to_numpy(), batch["tag"].to_numpy(), batch["body"], *(batch[c] for c in fields), strict=True):
            n, out = len(own[0]), np.empty(len(own[0]), dtype=object)
            for k, (start, windows) in enumerate(zip(own[0].tolist(), own[1].tolist(), strict=True)):
                out[k] = body[start : start + windows + WINDOW - 1]
            yield {"id": np.full(n, doc_id), "tag": np.full(n, tag), **dict(zip(fields, own, strict=True)), "body": out}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(part for batch in batches for part in of(batch))

    return texts.mapInPandas(cut, "id long, tag long, start long, windows long, shard long, spread int, body binary")


def shard_repeats(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, tag, a, b): spans of the first occurrences of runs whose windows start earlier in other runs."""
    kinds = firsts.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("again").alias("again")).filter("n > 1 or again").drop("again")
    # spread: how many shards a key has, 1 for ordinary keys; the shards of others are its own and numbered below 0
    placed = checkpoint(firsts.join(kinds, "key").withColumn("spread", F.ceil(F.col("n") / SPREAD_RUNS).cast("int")).select("key", "id", "tag", "start", "windows", "spread"))
    shards = max(1, placed.count() // SHARD_RUNS)
    own = -1 - F.pmod(F.xxhash64("key"), F.lit(2**40)) * 4096 - F.pmod(F.xxhash64("id", "tag"), F.least("spread", F.lit(4096)))
    shard = F.when(F.col("spread") == 1, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(own)
    placed = placed.withColumn("shard", shard).drop("key")

    def sharded(rows: DataFrame) -> DataFrame:
        return _with_bodies(docs, rows).repartition("shard").sortWithinPartitions("shard", "id", "tag", "start")

    def repeats(unit: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        row, offset, _, first = first_windows(unit)
        return _spans(unit, row[~first], offset[~first])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(repeats(unit) for unit in runs(batches, ["shard"]))

    spans = sharded(placed).mapInPandas(within, "id long, tag long, a long, b long")
    spread = placed.filter("spread > 1")
    if spread.isEmpty():
        return spans

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a shard of a spread key holds first, as sorted windows, cut by a hash of the window."""
        for unit in runs(batches, ["shard"]):
            row, offset, klass, first = first_windows(unit)
            by = np.argsort(klass[first], kind="stable")
            row, offset = row[first][by], offset[first][by]
            windows = [unit["body"][r][o : o + WINDOW] for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
            part_of = np.array([xxhash.xxh3_64_intdigest(w) % int(unit["spread"][0]) for w in windows])
            shard, out = int(unit["shard"][0]), []
            for part in np.unique(part_of):
                own = np.flatnonzero(part_of == part)
                r = row[own]
                out.append(((-1 - shard) // 4096, int(part), shard, b"".join(windows[k] for k in own), unit["id"][r], unit["tag"][r], unit["start"][r] + offset[own]))
            yield pd.DataFrame(out, columns=["key", "part", "shard", "sorted", "id", "tag", "start"])

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each sorted list is looked up by binary search in the merged list of those before it."""
        for unit in runs(batches, ["key", "part"]):
            seen, where = np.empty(0, dtype=f"S{WINDOW}"), np.empty((0, 3), dtype=np.int64)
            out = []
            for body, *places in zip(unit["sorted"], unit["id"], unit["tag"], unit["start"], strict=True):
                # bytes arrays drop zeros at the end, which keeps their order and tells all windows of one length apart
                own, at = np.frombuffer(body, dtype=f"S{WINDOW}"), np.stack([np.asarray(p, dtype=np.int64) for p in places], axis=1)
                if not len(seen):
                    seen, where = own, at
                    continue
                slot = np.searchsorted(seen, own)
                hit = np.flatnonzero(seen[np.minimum(slot, len(seen) - 1)] == own)
                for k in hit:
                    old, new = tuple(where[slot[k]]), tuple(at[k])
                    out.append(max(old, new))
                    where[slot[k]] = min(old, new)
                rest = np.setdiff1d(np.arange(len(own)), hit, assume_unique=True)
                seen, where = np.insert(seen, slot[rest], own[rest]), np.insert(where, slot[rest], at[rest], axis=0)
            found = pd.DataFrame(out, columns=["id", "tag", "a"], dtype=np.int64)
            yield found.assign(b=found["a"] + WINDOW)

    led = sharded(spread).mapInPandas(leading, "key long, part int, shard long, sorted binary, id array<long>, tag array<long>, start array<long>")
    merged = led.repartition("key", "part").sortWithinPartitions("key", "part", "shard").mapInPandas(across, "id long, tag long, a long, b long")
    return spans.union(merged)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tag, a, b): byte spans of docs (id, tag, body) to remove; they may overlap."""
    found = repeated_runs(docs)
    place = F.struct("id", "tag", "start")
    firsts = checkpoint(found.groupBy("key", "hash").agg(F.min(F.struct("id", "tag", "start", "windows", "again")).alias("place")).select("key", "hash", "place.*"))
    own = firsts.select("key", "hash", F.struct("id", "tag", "start").alias("place"))
    later = found.join(own, ["key", "hash"]).filter(place != F.col("place")).select("id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("b"))
    return later.union(shard_repeats(docs, firsts))


def _kept(body: bytes, spans: list) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes that are left."""
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    edges = [0, *(e for s in merged for e in s), len(body)]
    return [tuple(s) for s in merged], b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, spans (array of a, b), kept (the bytes that are left)."""
    bodies = _documents(docs, id_col, text_col)
    spans = checkpoint(repeated_spans(bodies).groupBy("id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    hit = slot_filter(spans, "id", "tag").hit(F.col("id"), F.col("tag"))
    shape = "array<struct<a:long,b:long>>"

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_kept(body, [] if own is None else own) for body, own in zip(batch["body"], batch["spans"], strict=True)]
            yield pd.DataFrame({
                "id": batch["id"], "n_bytes": batch["body"].str.len(), "n_removed": [len(b) - len(k) for b, (_, k) in zip(batch["body"], done, strict=True)],
                "spans": [[{"a": a, "b": b} for a, b in s] for s, _ in done], "kept": [k for _, k in done],
            })

    touched = bodies.filter(hit).join(spans, ["id", "tag"], "left").mapInPandas(remove, f"id long, n_bytes long, n_removed long, spans {shape}, kept binary")
    rest = bodies.filter(~hit).select("id", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(shape).alias("spans"), F.col("body").alias("kept"))
    out = touched.union(rest)
    return out.select(F.nullif("id", F.lit(-(2**63))).alias(id_col), *out.columns[1:])
