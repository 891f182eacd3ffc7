"""Whole answers: what a question about a project's artifacts returns, with where it comes from and what is degraded.

A question is first answered by listings; the one row that says which backing wins comes to the driver, and only that file
is read and scanned. Answers are one row, or rows with a row of notes beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, functions as F

from lodeframe.functions import text as T
from lodeframe.functions.names import artifact_id, dotted, is_family
from lodeframe.operators import rank
from lodeframe.operators.declarations import scan_declarations, scan_problems
from lodeframe.plans import backings, search

#: What stands before signatures that are served for want of a source.
JDK_NOTE, NO_SOURCE_NOTE = "signatures only (jdk: decompilation is out of scope)", "signatures only (no source available)"
CACHE_NOTE = "cache-scan: resolution degraded to local machine caches"
SHOWN = ("selector", "kind", "visibility", "static", "deprecated", "signature", "fqn", "line_start", "line_end", "doc_start", "javadoc")


@dataclass
class Project:
    """The tables of a project. artifacts: coordinates, artifact_rank, kind, noDecompile, binaryJar, sourcesJar, sourceDir;
    entries: archive, entry_ord, name, fqn; readable: path; files: archive, path, text; compiled: declarations of class
    entries with archive and path (the entry); decompiled: coordinates, fqn, source, failure, detail, what an attempt gave."""

    artifacts: DataFrame
    entries: DataFrame
    readable: DataFrame
    files: DataFrame
    compiled: DataFrame | None = None
    decompiled: DataFrame | None = None
    stale: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def spark(self):  # noqa: ANN201
        return self.artifacts.sparkSession

    def notes(self, *more: str) -> list[str]:
        """What an answer's degraded holds: the staleness, its own notes, and those of the resolution, each once."""
        return list(dict.fromkeys([*(["stale index served"] if self.stale else []), *more, *self.warnings]))


def _one(project: Project, **values: tuple[str, object]) -> DataFrame:
    """One row of (type, value) by name."""
    return project.spark.createDataFrame([tuple(v for _, v in values.values())], ", ".join(f"`{n}` {t}" for n, (t, _) in values.items()))


def _located(project: Project, fqn: str) -> tuple[Row, DataFrame, DataFrame]:
    """The winner, its file (path, text; a text that can't be read is null) and the declarations of the class in it."""
    won = backings.locate(project.artifacts, project.entries, project.readable, fqn).first()
    if won is None:
        raise LookupError(fqn)
    own = project.files.filter((F.col("archive") == won.backing) & (F.col("path") == won.entry)).select("path", "text")
    if won.slot == "binary":
        found = project.compiled.filter(F.col("archive") == won.backing).drop("archive") if project.compiled is not None else scan_declarations(own.limit(0))
    else:
        found = scan_declarations(own.filter("text is not null"))
    return won, own, found.filter(is_family(F.col("fqn"), F.lit(fqn)))


def _failed(own: DataFrame, slot: str) -> list[str]:
    """The note on a winner whose file can't be read, or not to its end."""
    if slot == "binary":
        return []
    bad = own.filter("text is null").select("path").unionByName(scan_problems(own.filter("text is not null")).select("path")).limit(1)
    there = own.limit(1).count()
    return [] if there and bad.isEmpty() else ["1 entries failed to parse"]


def outline(project: Project, fqn: str, preset: str = "outline", sections: dict[str, bool] | None = None, kind: str | None = None, visibility: str | None = None) -> DataFrame:
    """One row: fqn, coordinates, provenance, stale, imports (null where they are off or there is no source), rows,
    alternatives, degraded. A class that no artifact declares is a LookupError."""
    fqn = fqn.replace("$", ".")
    won, own, found = _located(project, fqn)
    rows = search.outline(found, fqn, preset, sections, kind, visibility)
    ordered = F.array_sort(F.collect_list(F.struct("path", "line_start", F.struct(*SHOWN).alias("r"))))
    listed = rows.agg(F.transform(ordered, lambda x: x["r"]).alias("rows"))
    head = _one(project, fqn=("string", fqn), coordinates=("string", won.coordinates), provenance=("string", won.provenance), stale=("boolean", project.stale))
    on = (search.PRESETS[preset] | (sections or {}))["imports"] and won.slot != "binary"
    written = search.imports(own.filter("text is not null"), preset, sections).agg(F.first("imports", ignorenulls=True).alias("imports")) if on else _one(project, imports=("array<string>", None))
    if on:
        written = written.select(F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))
    tail = _one(project, alternatives=("array<string>", won.alternatives), degraded=("array<string>", project.notes(*won.degraded, *_failed(own, won.slot))))
    return _beside(head, written, listed, tail)


def _beside(*ones: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = ones[0].withColumn("_k", F.lit(0))
    for one in ones[1:]:
        out = out.join(F.broadcast(one.withColumn("_k", F.lit(0))), "_k")
    return out.drop("_k")


@dataclass
class Content:
    """What is read of a class: its text as a one-row table (path, text), its provenance, and why it is degraded."""

    won: Row
    file: str
    provenance: str
    text: DataFrame
    found: DataFrame
    reason: str | None
    degraded: list[str]


def content(project: Project, fqn: str) -> Content:
    """The text of a class: its source, else what decompiling gave, else a note and its signatures."""
    won, own, found = _located(project, fqn)
    notes = project.notes(*won.degraded, *_failed(own, won.slot))
    if won.slot != "binary" and not own.filter("text is not null").isEmpty():
        return Content(won, won.entry, "source", own, found, None, notes)
    artifact = project.artifacts.filter(F.col("coordinates") == won.coordinates).select("kind", "noDecompile", "binaryJar").first()
    out_of_scope = bool(artifact.noDecompile) or artifact.kind == "jdk"
    tried = None
    if artifact.binaryJar and not artifact.noDecompile and project.decompiled is not None:
        tried = project.decompiled.filter((F.col("coordinates") == won.coordinates) & (dotted(F.col("fqn")) == fqn)).first()
    if tried is not None and tried.source is not None:
        name = won.entry.removesuffix(".class") + ".java (decompiled)"
        text = project.spark.createDataFrame([(won.entry.removesuffix(".class") + ".java", tried.source)], "path string, text string")
        return Content(won, name, "decompiled", text, scan_declarations(text).filter(is_family(F.col("fqn"), F.lit(fqn))), None, notes)
    if tried is not None:
        detail = f"{tried.failure}: {tried.detail}" if tried.detail else tried.failure
        note = f"signatures only (decompilation failed: {detail})"
        reason = "no-jvm (decompile unavailable)" if tried.failure == "no-jvm" else f"decompile failed: {tried.detail}" if tried.detail else "decompile failed"
    else:
        note, reason = (JDK_NOTE, "jdk: decompilation out of scope") if out_of_scope else (NO_SOURCE_NOTE, "no source available")
    own_rows = found.filter(F.col("fqn") == fqn)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "line_start", "signature"))), lambda x: x["signature"])
    text = own_rows.agg(F.array_join(F.concat(F.array(F.lit(note)), ordered), "\n").alias("text")).select(F.lit(won.entry).alias("path"), "text")
    return Content(won, won.entry, "signature", text, found, reason, notes)


def read_source(project: Project, fqn: str, mode: str = "full", first: int | None = None, last: int | None = None) -> DataFrame:
    """One row: mode, fqn, coordinates, file, provenance, stale, alternatives, degraded, line_count, and content (full), or
    lines, first, last and clamped (lines); in outline mode that of outline()."""
    if mode == "outline":
        return outline(project, fqn).withColumn("mode", F.lit(mode))
    if mode == "lines" and (first is None or last is None):
        raise ValueError("lines mode requires from and to")
    fqn = fqn.replace("$", ".")
    c = content(project, fqn)
    head = _one(project, mode=("string", mode), fqn=("string", fqn), coordinates=("string", c.won.coordinates), file=("string", c.file), provenance=("string", c.provenance), stale=("boolean", project.stale),
                alternatives=("array<string>", c.won.alternatives), degraded=("array<string>", c.degraded))
    all_lines = T.lines(F.col("text"))
    if mode == "full":
        return _beside(head, c.text.select(F.size(all_lines).alias("line_count"), F.col("text").alias("content"), F.lit(1).alias("first")))
    return _beside(head, c.text.select(F.size(all_lines).alias("line_count"), T.line_slice(all_lines, first, last).alias("p")).select("line_count", "p.*"))


def read_member(project: Project, fqn: str, selectors: str) -> DataFrame:
    """One row: fqn, coordinates, provenance, stale, members, misses, alternatives, degraded. A selector that can't be read
    is a ValueError, a class that no artifact declares a LookupError."""
    fqn = fqn.replace("$", ".")
    c = content(project, fqn)
    slices, misses = search.read_member(c.found, c.text, fqn, selectors, c.reason)
    shown = F.struct("selector", "signature", "lines", "first", "last", "javadoc")
    members = slices.agg(F.transform(F.array_sort(F.collect_list(F.struct("selector_ord", "first", "selector", shown.alias("s")))), lambda x: x["s"]).alias("members"))
    missed = misses.agg(F.transform(F.array_sort(F.collect_list(F.struct("selector_ord", "asked", "reason"))), lambda x: F.struct(x["asked"].alias("selector"), x["reason"].alias("reason"))).alias("misses"))
    head = _one(project, fqn=("string", fqn), coordinates=("string", c.won.coordinates), provenance=("string", c.provenance), stale=("boolean", project.stale))
    return _beside(head, members, missed, _one(project, alternatives=("array<string>", c.won.alternatives), degraded=("array<string>", c.degraded)))


def unreadable_note(project: Project) -> list[str]:
    """How many artifacts have no backing that can be read, and the first three in the manifest's order."""
    lost = search.paths_of(project.artifacts).join(project.readable.select("path").distinct(), "path", "left_semi").select("coordinates").distinct()
    gone = project.artifacts.join(lost, "coordinates", "left_anti").select("coordinates", "artifact_rank")
    note = rank.degraded(gone, F.lit(True), F.col("coordinates"), "artifacts unreadable", ["artifact_rank"]).first().note
    return [note] if note else []


def find_class(project: Project, query: str, limit: int = rank.NAME_LIMIT, jvm: bool = False, declarations: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(hits, degraded): every artifact's preferred listing is searched; those that have none are named."""
    listed = search.listing(project.artifacts, project.entries, project.readable)
    hits = search.find_class(listed, query, limit, jvm, project.artifacts, declarations)
    return hits, project.notes(*unreadable_note(project))


def _artifact(project: Project, query: str) -> Row:
    coordinates = search.resolve_artifact(project.artifacts, query)
    return project.artifacts.filter(F.col("coordinates") == coordinates).first()


def search_symbols(project: Project, artifact: str, query: str, kind: str | None = None, limit: int = rank.MEMBER_LIMIT) -> tuple[DataFrame, list[str]]:
    """(rows, degraded) of one artifact: only its files are scanned. An artifact that is not known, or not one, is no error:
    the nearest ids are named."""
    empty = search.search_symbols(scan_declarations(project.files.select("path", "text").limit(0)), query, kind, limit)
    try:
        own = _artifact(project, artifact)
    except LookupError:
        ids = project.artifacts.select(artifact_id(F.col("coordinates")).alias("id"), "artifact_rank")
        scored = ids.withColumn("score", rank.fuzzy_score(artifact, F.coalesce("id", F.lit(""))))
        near = [r.id for r in scored.filter("score is not null").orderBy(F.desc("score"), "artifact_rank").limit(3).collect()]
        return empty, [f'unknown artifact "{artifact}" — closest: {", ".join(near) or "(no artifacts resolved)"}']
    one = project.artifacts.filter(F.col("coordinates") == own.coordinates)
    if own.sourceDir or own.sourcesJar:
        found, notes = search.artifact_records(one, project.files)
        note = notes.first().unreadable
    else:
        found = project.compiled.filter(F.col("archive") == own.binaryJar).drop("archive") if project.compiled is not None else scan_declarations(project.files.select("path", "text").limit(0))
        note = None
    if found.limit(1).isEmpty():
        return empty, [note or f"{own.coordinates} parsed to no declarations"]
    return search.search_symbols(found, query, kind, limit), project.notes(*([note] if note else []))


def read_resource(project: Project, artifact: str, pattern: str, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, answer) of one artifact's jar: listing (archive, entry_ord, name, usize, is_dir) is cut to its binary jar,
    else its sources, before anything is read. answer: artifact, provenance, stale, degraded."""
    own = _artifact(project, artifact)
    jar = own.binaryJar or own.sourcesJar
    if jar is None or project.readable.filter(F.col("path") == jar).isEmpty():
        raise LookupError(f"{own.coordinates} has no readable jar (no binaryJar or sourcesJar on disk)")
    rows = search.read_resource(listing.filter(F.col("archive") == jar), pattern)
    provenance = "source" if own.sourcesJar or own.sourceDir else "signature"
    return rows, _one(project, artifact=("string", own.coordinates), provenance=("string", provenance), stale=("boolean", project.stale), degraded=("array<string>", project.notes()))


def miss(project: Project, query: str, is_class: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, answer) when nothing answered: for a class, the search for what follows its last dot; answer has found, via,
    and where nothing was found the artifacts searched, a note and what the resolution said."""
    listed = search.listing(project.artifacts, project.entries, project.readable)
    hits = search.find_class(listed, query.rsplit(".", 1)[-1]) if is_class else search.find_class(listed.limit(0), query)
    if not hits.limit(1).isEmpty():
        return hits, _one(project, found=("boolean", True), via=("string", "fuzzy-candidates"), searched=("array<string>", None), note=("string", None), degraded=("array<string>", None))
    from_caches = "degraded-to-cache-scan" in project.warnings
    names = F.transform(F.array_sort(F.collect_list(F.struct("artifact_rank", "coordinates"))), lambda x: x["coordinates"])
    searched = project.artifacts.agg(F.concat(names, F.array(F.lit(CACHE_NOTE)) if from_caches else F.array().cast("array<string>")).alias("searched"))
    head = _one(project, found=("boolean", False), via=("string", "negative"))
    tail = _one(project, note=("string", search.MISS_NOTE), degraded=("array<string>", list(dict.fromkeys(project.warnings))))
    return hits, _beside(head, searched, tail)


__all__ = ["Content", "Project", "content", "find_class", "miss", "outline", "read_member", "read_resource", "read_source", "search_symbols", "unreadable_note"]
