"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct word shingles; its signature holds, for every coordinate, the least of a hash of them.
Documents with equal sets become one class. Each class is posted under coordinate-value pairs: only under its rarest
ones, because two signatures that agree in at least `least` of COORDINATES agree in one of any COORDINATES - least + 1
(prefix merging); agreements are counted only inside a posting list (skip merging). What agrees often enough is chained
to groups, and inside a group the full sets of all pairs that agree often enough are compared. Pairs are never rows.

Nothing grows with the square of a list or a group:

1. The classes of a long posting list are chained to its first class as they are. That makes groups coarser, no more.
2. A large group is cut into blocks, each with the group's first class; the links found there show its crowd, the classes
   that are connected already.
3. Whatever links are left have an end outside the crowd. Two sets that are similar enough share one of the rarest
   shingles of either (as many as may differ, and one), so the group's classes are posted under those, and lists with
   someone outside the crowd are compared; in a list that is long itself, blocks outside the crowd with all others.

Defined cases: texts without words, and null, have an empty set and link with nothing; a null id has no part in links: its
row goes if a document with an id has the same set, and stays else; rows that share an id are one document; of equal
similarity there are no ties to break, components are what links reach; very long texts have large sets and no limit;
columns of docs other than the two named are carried or left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, components, frames, runs, slim, slot_filter, stored, without

#: Words of a shingle; coordinates of a signature; most likely that a pair at the least similarity of a link agrees in
#: fewer coordinates than it takes to be compared in full.
WORDS, COORDINATES, MISSED = 5, 64, 2.5e-6
#: Most classes whose signatures are compared in one list, and whose full sets are in one unit.
LIST_BLOCK, GROUP_BLOCK = 512, 1024
#: Rows from which the commonness of coordinate-value pairs and of shingles is estimated, and the slots it is kept in.
SAMPLE, SLOTS = 20_000, 1 << 18

_MULTIPLIERS = np.random.default_rng(8).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_HASHES: dict[bytes, int] = {}


def matches(percent: int) -> int:
    """Agreements from which a pair is compared in full: the most that a pair of similarity percent is all but sure of."""
    p, below, least = percent / 100, 0.0, 0
    while least < COORDINATES and (below := below + math.comb(COORDINATES, least) * p**least * (1 - p) ** (COORDINATES - least)) <= MISSED:
        least += 1
    return max(1, least)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's set, as sorted 64-bit hashes: A-Z lower-cased, words parted by ASCII white space."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(_WORD_HASHES) > 250_000:
        _WORD_HASHES.clear()
    hashes = [_WORD_HASHES.get(t) or _WORD_HASHES.setdefault(t, xxhash.xxh3_64_intdigest(t)) for t in tokens]
    w = np.array(hashes, dtype=np.uint64)
    n = min(words, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(_mixed(h + np.uint64(n)))


def signature(own: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(out, (own[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, tag, n_shingles, key_a, key_b, sig): the keys are equal where sets are; sig is null for an empty set; tag is a
    hash of the text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, tag, text in zip(batch["id"], batch["tag"], batch["text"], strict=True):
                own = shingles(text, words)
                a, b = int(_mixed(own).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mixed(own ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)))
                out.append((doc_id, tag, len(own), a - 2**63, b - 2**63, signature(own).tobytes() if len(own) else None))
            yield pd.DataFrame(out, columns=["id", "tag", "n_shingles", "key_a", "key_b", "sig"]).astype({"id": batch["id"].dtype})

    kind = dict(docs.dtypes)[id_col]
    rows = slim(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("tag"), "text")
    return rows.mapInPandas(sign, f"id {kind}, tag long, n_shingles long, key_a long, key_b long, sig binary")


def _tokens(sigs: pd.Series) -> np.ndarray:
    """row x coordinate: coordinate and value as one number."""
    values = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | values


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (_mixed(tokens + np.uint64(1)) % np.uint64(SLOTS)).astype(np.int64)


def commonness(rows: DataFrame, column: str, tokens: Callable[[pd.Series], np.ndarray], sample: int = SAMPLE) -> np.ndarray:
    """How common the tokens of a column are, by slot; from a sample, since any fixed order of them loses nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_slots(tokens(batch[column])).ravel(), minlength=SLOTS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"slot": held.astype(np.int32), "n": total[held]})

    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select(column)
    counted = chosen.mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    out = np.zeros(SLOTS, dtype=np.uint32)
    out[counted["slot"]] = counted["n"]
    return out


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(token, id, n, first): each class under its rarest coordinate-value pairs, with the size of the list and its first
    class; lists of one are left out."""
    common = classes.sparkSession.sparkContext.broadcast(commonness(classes, "sig", _tokens))  # SLOTS numbers
    kind = dict(classes.dtypes)["id"]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = COORDINATES - least + 1
        for batch in batches:
            if len(batch):
                tokens = _tokens(batch["sig"])
                rarest = np.lexsort((_mixed(tokens), common.value[_slots(tokens)]), axis=1)[:, :keep]
                tokens = np.take_along_axis(tokens, rarest, axis=1).astype(np.int64)
                yield pd.DataFrame({"token": tokens.ravel(), "id": np.repeat(batch["id"].to_numpy(), keep)})

    posted = checkpoint(classes.select("id", "sig").mapInPandas(post, f"token long, id {kind}"))
    lists = posted.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    return posted.join(lists, "token")


def _spanning(unit: dict[str, np.ndarray], sigs: np.ndarray, least: int, linked: Callable[[int, int], bool]) -> dict[str, np.ndarray]:
    """(a, b): linked pairs of a unit's rows that agree often enough, as many as it takes to span their components.

    Rows with one label are connected already; in a unit of two blocks only pairs across them are compared.
    """
    ids, found = unit["id"], []
    label = np.unique(unit["label"], return_inverse=True)[1] if "label" in unit else np.arange(len(ids))
    own = unit["own"] if "own" in unit and (unit["own"] != unit["own"][0]).any() else None
    for k in range(len(ids) - 1):
        others = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        if own is not None:
            others = others[own[others] != own[k]]
        if len(others):
            others = others[(sigs[others] == sigs[k]).sum(axis=1) >= least]
        while len(others):
            j = int(others[0])
            if linked(k, j):
                found.append((k, j))
                label[label == label[j]] = label[k]
                others = others[label[others] != label[k]]
            else:
                others = others[1:]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return {"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]}


def candidate_groups(classes: DataFrame, posted: DataFrame, least: int) -> DataFrame:
    """(id, component) of the classes chained by pairs that agree in `least` coordinates and share a posting list of at
    most LIST_BLOCK classes, and by sharing a longer one."""
    kind = dict(posted.dtypes)["id"]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs = lambda unit: np.frombuffer(b"".join(unit["sig"]), dtype=np.uint32).reshape(len(unit["sig"]), -1)
        return frames(_spanning(u, sigs(u), least, lambda k, j: True) for u in runs(batches, ["token"]) if len(u["id"]) > 1)

    short = posted.filter(F.col("n") <= LIST_BLOCK).select("token", "id").join(classes.select("id", "sig"), "id")
    units = short.repartition("token").sortWithinPartitions("token", "id")
    long = posted.filter((F.col("n") > LIST_BLOCK) & (F.col("id") != F.col("first"))).select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    return components(units.mapInPandas(chain, f"a {kind}, b {kind}").unionByName(long))


def _compared(units: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(a, b): links of full sets inside each unit, a key of rows (id, own_set, and label and own if there are any)."""
    kind, least = dict(units.dtypes)["id"], matches(percent)

    def spans(unit: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in unit["own_set"]]

        def linked(k: int, j: int) -> bool:
            a, b = sorted((sets[k], sets[j]), key=len)
            if 100 * len(a) < percent * len(b):
                return False
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            return 100 * both >= percent * (len(a) + len(b) - both)

        return _spanning(unit, np.stack([signature(s) for s in sets]), least, linked)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(spans(u) for u in runs(batches, key) if len(u["id"]) > 1)

    return units.repartition(*key).sortWithinPartitions(*key, "id").mapInPandas(compare, f"a {kind}, b {kind}")


def rare_shingle_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(component, shingle, id): each set under its rarest shingles, as many as two similar sets may differ in and one."""
    whole = lambda column: np.concatenate([np.frombuffer(s, dtype=np.uint64) for s in column])
    common = sets.sparkSession.sparkContext.broadcast(commonness(sets, "own_set", whole))  # SLOTS numbers
    kind = dict(sets.dtypes)["id"]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for component, doc_id, own in zip(batch["component"], batch["id"], batch["own_set"], strict=True):
                own = np.frombuffer(own, dtype=np.uint64)
                keep = len(own) - -(-len(own) * percent // 100) + 1
                rarest = own[np.lexsort((own, common.value[_slots(own)]))[:keep]]
                yield pd.DataFrame({"component": component, "shingle": rarest.astype(np.int64), "id": doc_id})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames({c: f[c].to_numpy() for c in f} for f in post(batches))

    return sets.select("component", "id", "own_set").mapInPandas(gathered, f"component {kind}, shingle long, id {kind}")


def _large_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect every linked pair of groups of more than GROUP_BLOCK members (id, component, n, own_set)."""
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    first = F.col("id") == F.col("component")
    # the group's first class, after which it is named, sits in every block
    home = F.when(first, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), blocks).cast("int")))
    star = checkpoint(_compared(sets.withColumn("block", F.explode(home)), ["component", "block"], percent))
    named = components(star).withColumnRenamed("component", "label")
    slim_sets = checkpoint(sets.select("component", "id").join(named, "id", "left").select("component", "id", F.coalesce("label", "id").alias("label")))
    sizes = slim_sets.groupBy("component", "label").agg(F.count("*").alias("n"))
    crowds = sizes.groupBy("component").agg(F.max(F.struct("n", "label")).getField("label").alias("crowd"))
    labelled = slim_sets.join(crowds, "component").withColumn("crowded", F.col("label") == F.col("crowd")).drop("crowd")
    listed = checkpoint(rare_shingle_lists(sets, percent).join(labelled.drop("component"), "id"))
    lists = listed.groupBy("component", "shingle").agg(
        F.count("*").alias("n"), F.count_if("crowded").alias("n_crowd"), F.min("label").alias("least"), F.max("label").alias("most"), F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.hash("id")).alias("who2"),
    )
    open_lists = lists.filter((F.col("n_crowd") < F.col("n")) & (F.col("least") != F.col("most")))
    # lists of the same classes are compared once
    once = open_lists.groupBy("component", "n", "n_crowd", "who", "who2").agg(F.min("shingle").alias("shingle")).drop("who", "who2")
    parts = lambda n: F.ceil(n / GROUP_BLOCK).cast("int")
    crowd_parts, other_parts = parts(F.col("n_crowd")), parts(F.col("n") - F.col("n_crowd"))
    spot = F.xxhash64("id", F.lit(1))
    own = F.when(F.col("n") <= GROUP_BLOCK, 0).when(F.col("crowded"), F.pmod(spot, F.greatest(crowd_parts, F.lit(1)))).otherwise(crowd_parts + F.pmod(spot, other_parts)).cast("int")
    meets = F.when(F.col("n") <= GROUP_BLOCK, F.array(F.lit(0))).when(F.col("crowded"), F.sequence(crowd_parts, crowd_parts + other_parts - 1)).otherwise(F.sequence(F.lit(0), crowd_parts + other_parts - 1))
    placed = listed.join(once, ["component", "shingle"]).withColumn("own", own).withColumn("other", F.explode(meets))
    placed = placed.select("component", "shingle", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("block2"), "own", "id", "label")
    rest = _compared(placed.join(sets.select("id", "own_set"), "id"), ["component", "shingle", "block", "block2"], percent)
    return star.unionByName(rest)


def confirmed_links(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, percent: int, words: int = WORDS) -> DataFrame:
    """(a, b): links of full sets that connect every linked pair of a group; only texts of group members are moved."""
    kind = dict(groups.dtypes)["id"]
    members = groups.join(groups.groupBy("component").agg(F.count("*").alias("n")), "component")
    texts = slim(docs, id=id_col, text=text_col).filter(slot_filter(groups, "id").hit(F.col("id"))).dropDuplicates(["id"]).join(members, "id")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(own_set=[shingles(t, words).tobytes() for t in batch["text"]])

    sets = stored(texts.mapInPandas(reduce, f"id {kind}, component {kind}, n long, own_set binary"))
    links = _compared(sets.filter(F.col("n") <= GROUP_BLOCK), ["component"], percent)
    large = sets.filter(F.col("n") > GROUP_BLOCK)
    return links if large.isEmpty() else links.unionByName(_large_links(large, percent))


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    """(id, tag, n_shingles, class_id, component_id) of every row of docs."""
    least = matches(percent)
    signed = checkpoint(signatures(docs, id_col, text_col, words))
    full = signed.filter("n_shingles > 0 and id is not null")
    named = full.groupBy("key_a", "key_b", "n_shingles").agg(F.min("id").alias("class_id"))
    classes = full.join(named.select(F.col("class_id").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "sig")
    classes = checkpoint(classes)
    links = confirmed_links(docs, candidate_groups(classes, postings(classes, least), least), id_col, text_col, percent, words)
    reached = components(links).withColumnRenamed("id", "class_id")
    known = signed.select("id", "tag", "n_shingles", "key_a", "key_b").join(named.join(reached, "class_id", "left"), ["key_a", "key_b", "n_shingles"], "left")
    class_id = F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "id")).otherwise(F.col("id"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id", "id")).otherwise(F.col("id"))
    return known.select("id", "tag", "n_shingles", class_id.alias("class_id"), component.alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, class_id, component_id, kept.

    class_id is the smallest id with the same set, component_id the smallest that links reach. percent: least
    similarity of a link.
    """
    out = _judged(docs, id_col, text_col, percent, words)
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """docs without the rows that near_dedup() does not keep; only texts that may go are moved."""
    judged = _judged(docs, id_col, text_col, percent, words)
    dropped = checkpoint(judged.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "tag"))
    return without(docs, dropped, id_col, text_col)
