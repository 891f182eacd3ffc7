"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity`; what a packing needs to know of them is how many pieces there are
of each length, a table of at most `capacity` rows. From it the plan is made: large lengths are rounded up within groups
of equal cardinality, configurations of the few rounded sizes are chosen, real lengths take the places of rounded ones,
and small lengths go best-fit into what is left. The plan is a list of runs of alike sequences, whose length depends on
the capacity and not on the number of documents; every piece then finds its place from its rank within its length.

A piece's rank is its place among the pieces of its length in its task, plus the counts of the tasks before: counts are
joined, pieces are neither sorted nor gathered by length, so a length that many pieces have is no hot key.

Defined cases: a null text is empty, and a document's pieces always end with the end-of-document id; rows that share an
id, or repeat in whole, are packed each for itself and told apart by row_id; a null id is an id like others; a very long
text is cut into as many pieces as it takes; pieces of one length may swap places between runs, never overlap; columns
of docs other than the two named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_below, checkpoint, permutation, release_memory, slim, stored
from .token_ids import TokenIds

CAPACITY, END_ID = 2048, 0
#: Groups of large lengths (more of them waste less, and the plan takes longer), and the share of the capacity from which a length is large.
GROUPS, LARGE = 200, 1 / 8
#: Rows of docs that are numbered in a task: row_id is the task's number and the row's.
TASK_ROWS = 1 << 40

_ENCODERS: dict[str, TokenIds] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of a document of n ids: whole pieces, the first one shorter if need be."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each of lengths how many equal ones came before, those in seen (counts by length, brought up to date) included."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(fresh, np.diff(np.append(fresh, len(ordered))))
    out += seen[lengths]
    np.add.at(seen, lengths, 1)
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """id_col, row_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's token pieces, with the
    task that cut them and place, their number among its pieces of that length."""
    path = tokenizer or vocabulary_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, TokenIds(path))
        task, row, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                texts = batch["text"].fillna("").tolist()
                once = list(dict.fromkeys(texts))
                ids_of = dict(zip(once, encode(once), strict=True))
                out = []
                for doc_id, text in zip(batch["id"], texts, strict=True):
                    ids = np.append(ids_of[text], np.uint32(END_ID)).astype("<u4")
                    starts = piece_starts(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        out.append((doc_id, task * TASK_ROWS + row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] * with_ids)))
                    row += 1
                frame = pd.DataFrame(out, columns=["id", "row_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"id": batch["id"].dtype})
                yield frame.assign(task=task, place=_places(frame["length"].to_numpy(), seen))
            release_memory()

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, row_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", task int, place long"
    return slim(docs, id=id_col, text=text_col).mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[int]]]:
    """Linear grouping: (rounded size, lengths) of runs of lengths, largest first, with about equal numbers of pieces."""
    total, out, taken = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        if not out or taken >= total * len(out) / groups:
            out.append((length, []))
        out[-1][1].append(length)
        taken += counts[length]
    return out


def best_configuration(sizes: list[int], have: list[int], capacity: int) -> list[int]:
    """How many of each rounded size fill one sequence best, out of what there is; it holds the largest that is left."""
    first = next(g for g, n in enumerate(have) if n)
    best: dict[int, tuple[int, ...]] = {sizes[first]: (first,)}
    for g in range(first, len(sizes)):
        for filled in sorted(best):
            took = best[filled]
            for k in range(1, have[g] - took.count(g) + 1):
                to = filled + k * sizes[g]
                if to > capacity:
                    break
                best.setdefault(to, took + (g,) * k)
    pick = Counter(best[max(best)])
    return [pick.get(g, 0) for g in range(len(sizes))]


def configurations(grouped: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """(sequences, count of each rounded size) until all of (rounded size, pieces) are placed; few, as each uses a size up."""
    sizes, have, out = [s for s, _ in grouped], [n for _, n in grouped], []
    while any(have):
        pick = best_configuration(sizes, have, capacity)
        times = min(n // k for n, k in zip(have, pick, strict=True) if k)
        out.append((times, pick))
        have = [n - times * k for n, k in zip(have, pick, strict=True)]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: rows (length, first rank, ranks, first sequence, pieces of the length in a sequence, offset).

    The piece of rank r sits in sequence first + (r - first rank) // per, at offset + ((r - first rank) % per) * length.
    """
    out, runs, sequence = [], [], 0  # runs of alike sequences: [room, sequences, first sequence]
    rank = dict.fromkeys(counts, 0)

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((length, rank[length], n, first, per, offset))
        rank[length] += n

    small = max(1, int(capacity * LARGE))
    large = {s: n for s, n in counts.items() if s > small}
    grouped = group_sizes(large, groups)
    queues = [[[s, large[s]] for s in lengths] for _, lengths in grouped]
    for times, pick in configurations([(size, sum(large[s] for s in lengths)) for size, lengths in grouped], capacity):
        slots = [g for g, k in enumerate(pick) for _ in range(k)]
        # substitution: each slot takes `times` real pieces of its group, longest first; the run splits where one changes
        taken = []
        for g in slots:
            parts, need = [], times
            while need:
                length, n = queues[g][0]
                use = min(n, need)
                parts.append((length, use))
                need -= use
                queues[g][0][1] -= use
                if not queues[g][0][1]:
                    queues[g].pop(0)
            taken.append(parts)
        ends = sorted({int(e) for parts in taken for e in np.cumsum([n for _, n in parts])})
        start = 0
        for end in ends:
            offset = 0
            for parts in taken:
                edge = 0
                for length, n in parts:
                    edge += n
                    if start < edge:
                        place(length, end - start, sequence + start, 1, offset)
                        offset += length
                        break
            runs.append([capacity - offset, end - start, sequence + start])
            start = end
        sequence += times
    # best fit of small lengths, longest first: the run with the least room that suffices takes as many as fit
    by_room: dict[int, list[tuple[int, int]]] = {}
    for room, n, first in runs:
        by_room.setdefault(room, []).append((n, first))
    for length in sorted((s for s in counts if s <= small), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                new = -(-left // (capacity // length))
                by_room[capacity] = [(new, sequence)]
                sequence += new
                continue
            n, first = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            per = min(room // length, left)
            use = min(n, left // per)
            place(length, use * per, first, per, capacity - room)
            left -= use * per
            rest = [(room - per * length, use, first)] + [(room, n - use, first + use)] * (n > use)
            for r, m, f in rest:
                by_room.setdefault(r, []).append((m, f))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, seed: int = 0) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, row_id (and ids, if asked for).

    row_id numbers the rows of docs, so that copies of a document can be told apart: (row_id, piece) is unique. Sequence
    numbers are permuted, since the plan numbers alike sequences in a row: read by number, lengths and tasks are mixed.
    """
    cut = stored(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids).withColumnRenamed(id_col, "id"))
    counted = checkpoint(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = sorted(plan(counts, capacity))
    sequences = int(max((first + -(-n // per) for _, _, n, first, per, _ in rows), default=1))
    a, b = permutation(sequences, [seed])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut.join(broadcast_below(offsets, counted), ["length", "task"]).withColumn("rank", (F.col("before") + F.col("place")).cast("long"))

    schema = "of_length long, first_rank long, n long, first_sequence long, per long, spot long"
    runs = docs.sparkSession.createDataFrame(rows, schema)  # as many rows as the plan has, which the capacity bounds
    nth = F.col("rank") - F.col("first_rank")
    meets = (F.col("length") == F.col("of_length")) & (nth >= 0) & (nth < F.col("n"))
    sequence = F.expr(f"({a} * (first_sequence + (rank - first_rank) div per) + {b}) % {sequences}")
    placed = ranked.join(F.broadcast(runs), meets).select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("spot") + nth % F.col("per") * F.col("length")).alias("offset"), "row_id", *["ids"] * with_ids)
    return placed.withColumnRenamed("id", id_col)
