"""Which backing of which artifact answers for a class: an ordered choice over artifacts, backings and file extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.functions.names import dotted

#: The extensions of sources in the order in which they are tried, and the backings as a listing prefers them.
EXTENSIONS = (".java", ".kt")
SLOTS = (("binaryJar", "binary"), ("sourcesJar", "sources"), ("sourceDir", "sourceDir"))


def _source_path(fqn: str) -> str:
    return fqn.replace("$", ".").replace(".", "/")


def archive_hit(name: Column, fqn: str) -> Column:
    """Aggregate: the entry of a sources archive that holds a class. Each extension in turn: the exact path, else the only
    entry that ends with it; several end the search without an answer."""
    out, ended = F.lit(None).cast("string"), F.lit(False)
    for extension in EXTENSIONS:
        path = _source_path(fqn) + extension
        exact, ending = F.count_if(name == path) > 0, F.endswith(name, F.lit("/" + path))
        several, only = F.count_if(ending) > 1, F.min(F.when(ending, name))
        out = F.coalesce(out, F.when(ended, None).when(exact, F.lit(path)).when(~several, only))
        ended = ended | (out.isNull() & ~exact & several)
    return out


def folder_hit(name: Column, fqn: str) -> Column:
    """Aggregate: the file of a source folder that holds a class; only its exact path counts."""
    return F.coalesce(*[F.max(F.when(name == _source_path(fqn) + e, name)) for e in EXTENSIONS])


def binary_hit(name: Column, entry_fqn: Column, fqn: str, entry_ord: Column) -> Column:
    """Aggregate: the first class entry of that name, however nesting is spelled."""
    return F.min(F.when(dotted(entry_fqn) == dotted(F.lit(fqn)), F.struct(entry_ord, name.alias("name")))).getField("name")


def source_entry(entries: DataFrame, fqn: str) -> DataFrame:
    """(coordinates, name): the entry of a class in each artifact's sources archive (entries: coordinates, name)."""
    near = entries.filter(_may_hold("name", fqn))
    return near.groupBy("coordinates").agg(archive_hit(F.col("name"), fqn).alias("name")).filter("name is not null")


def _may_hold(name: str, fqn: str) -> Column:
    return F.endswith(name, F.lit(_source_path(fqn) + ".java")) | F.endswith(name, F.lit(_source_path(fqn) + ".kt"))


def hits_by_artifact(artifacts: DataFrame, entries: DataFrame, readable: DataFrame, fqn: str) -> DataFrame:
    """(coordinates, artifact_rank, listed, declares, slot, backing, entry) of every artifact (coordinates, artifact_rank,
    binaryJar, sourcesJar, sourceDir) that can be listed, or whose listed is null.

    entries: archive, entry_ord, name, fqn. listed is the backing that a listing prefers of those that are readable (path),
    declares whether the class is in it. slot, backing and entry are what is parsed: the source folder, then the sources
    archive, else the listed one; null where the class is in none. A backing that can't be read is passed over.
    """
    slots = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("slot"), F.col(c).alias("archive")) for k, (c, n) in enumerate(SLOTS)])
    each = artifacts.select("coordinates", "artifact_rank", F.explode(slots).alias("b")).select("coordinates", "artifact_rank", "b.*")
    there = each.join(readable.select(F.col("path").alias("archive")).distinct(), "archive", "left_semi")
    near = entries.filter(_may_hold("name", fqn) | (dotted(F.col("fqn")) == dotted(F.lit(fqn)))).select("archive", "entry_ord", "name", "fqn")
    met = there.join(near, "archive", "left")
    name = F.col("name")
    by_slot = met.groupBy("coordinates", "artifact_rank", "ord", "slot", "archive").agg(
        archive_hit(name, fqn).alias("in_archive"), folder_hit(name, fqn).alias("in_folder"), binary_hit(name, F.col("fqn"), fqn, F.col("entry_ord")).alias("in_binary"))
    hit = F.when(F.col("slot") == "sources", F.col("in_archive")).when(F.col("slot") == "sourceDir", F.col("in_folder")).otherwise(F.col("in_binary"))
    found = by_slot.withColumn("entry", hit)
    # the order of parsing: folder, sources, binary; the order of listing: ord
    parse = F.min(F.when(F.col("entry").isNotNull(), F.struct((-F.col("ord")).alias("turn"), "slot", "archive", "entry")))
    listed = F.min(F.struct("ord", "slot", F.col("entry").isNotNull().alias("declares")))
    one = found.groupBy("coordinates").agg(parse.alias("p"), listed.alias("l"))
    all_artifacts = artifacts.select("coordinates", "artifact_rank").join(one, "coordinates", "left")
    return all_artifacts.select("coordinates", "artifact_rank", F.col("l.slot").alias("listed"), F.coalesce("l.declares", F.lit(False)).alias("declares"), F.col("p.slot").alias("slot"), F.col("p.archive").alias("backing"), F.col("p.entry").alias("entry"))


def locate(artifacts: DataFrame, entries: DataFrame, readable: DataFrame, fqn: str) -> DataFrame:
    """One row for the class, or none: coordinates, artifact_rank, slot, backing, entry, provenance, alternatives and
    degraded. The first artifact whose backings hold it wins; later ones count if their listed backing declares it; those
    that can't be listed are named, three at most."""
    rows = hits_by_artifact(artifacts, entries, readable, fqn)
    ranked = F.array_sort(F.collect_list(F.struct("artifact_rank", "coordinates", "slot", "backing", "entry", "declares", F.col("listed").isNull().alias("lost"))))
    every = rows.agg(ranked.alias("all"))
    hits = F.filter("all", lambda a: a["entry"].isNotNull())
    win = F.get(hits, F.lit(0))
    later = F.transform(F.filter("all", lambda a: a["declares"] & (a["artifact_rank"] > win["artifact_rank"])), lambda a: a["coordinates"])
    lost = F.transform(F.filter("all", lambda a: a["lost"]), lambda a: a["coordinates"])
    note = F.when(F.size(lost) > 0, F.array(F.concat(F.size(lost).cast("string"), F.lit(" artifacts unreadable ("), F.array_join(F.slice(lost, 1, 3), ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    provenance = F.when(win["slot"] == "binary", "signature").otherwise("source")
    shown = every.select(*[win[c].alias(c) for c in ("coordinates", "artifact_rank", "slot", "backing", "entry")], provenance.alias("provenance"), later.alias("alternatives"), note.alias("degraded"))
    return shown.filter("entry is not null")
