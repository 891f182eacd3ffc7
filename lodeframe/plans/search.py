"""The searches over artifacts: each takes tables and returns a table; content is read for the rows that win only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions import selectors as S, text as T
from lodeframe.functions.names import artifact_id, dotted, is_family, parent_name, simple_name, version
from lodeframe.operators import rank

SECTIONS = {"fields": ("field", "property", "enum-constant"), "methods": ("method", "constructor")}
#: Fixed presets: which sections an outline has.
PRESETS = {
    "minimal": {"imports": False, "fields": False, "methods": True, "inner": True, "javadoc": False},
    "outline": {"imports": True, "fields": True, "methods": True, "inner": True, "javadoc": True},
    "full": {"imports": True, "fields": True, "methods": True, "inner": True, "javadoc": True},
}
#: Hits whose kind is looked up in their declarations; the others are given as classes.
KIND_CAP = 24
RESOURCE_LIMIT = 524_288
MISS_NOTE = "not found in resolved artifacts; remote artifact search is a planned extension"


def listing(artifacts: DataFrame, entries: DataFrame, existing: DataFrame) -> DataFrame:
    """(coordinates, artifact_rank, backing, source and entries' columns): each artifact's entries in the first of its
    binaryJar, sourcesJar and sourceDir that existing (path) has; entries (archive, any more) of other backings drop out."""
    slots = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("source"), F.col(c).alias("path")) for k, (c, n) in enumerate((("binaryJar", "binary"), ("sourcesJar", "sources"), ("sourceDir", "sourceDir")))])
    each = artifacts.select("coordinates", "artifact_rank", F.explode(slots).alias("b")).select("coordinates", "artifact_rank", "b.*")
    there = each.join(existing.select("path").distinct(), "path", "left_semi")
    backing = there.groupBy("coordinates", "artifact_rank").agg(F.min(F.struct("ord", "source", "path")).alias("b"))
    return backing.select("coordinates", "artifact_rank", F.col("b.path").alias("backing"), F.col("b.source").alias("source")).join(entries.drop("source"), F.col("backing") == F.col("archive"))


def paths_of(artifacts: DataFrame) -> DataFrame:
    """(coordinates, path) of every backing that artifacts have."""
    return artifacts.select("coordinates", F.explode(F.array_compact(F.array("binaryJar", "sourcesJar", "sourceDir"))).alias("path"))


def promised(artifacts_have: tuple[Column, Column, Column], jvm: bool) -> Column:
    """What reading a hit whole would yield, by the artifact's sourcesJar, sourceDir and binaryJar."""
    sources_jar, source_dir, binary_jar = artifacts_have
    return F.when(sources_jar.isNotNull() | source_dir.isNotNull(), "source").when(binary_jar.isNotNull() & F.lit(jvm), "decompiled").otherwise("signature")


def with_kinds(hits: DataFrame, declarations: DataFrame, order: list[Column | str], cap: int = KIND_CAP) -> DataFrame:
    """hits (coordinates, fqn, any more) with kind: of the first cap in order, that of their own declaration; class else."""
    first = hits.orderBy(*order).limit(cap).select("coordinates", "fqn")
    own = declarations.select(F.col("coordinates").alias("_c"), F.col("fqn").alias("_f"), "selector", F.col("kind").alias("_kind"), "line_start")
    met = first.join(own, (F.col("coordinates") == F.col("_c")) & (F.col("selector") == simple_name(F.col("fqn"))) & is_family(F.col("_f"), F.col("fqn")))
    kinds = met.groupBy("coordinates", "fqn").agg(F.min(F.struct("line_start", "_kind")).getField("_kind").alias("kind"))
    return hits.join(kinds, ["coordinates", "fqn"], "left").withColumn("kind", F.coalesce("kind", F.lit("class")))


def find_class(entries: DataFrame, query: str, limit: int = rank.NAME_LIMIT, jvm: bool = False, artifacts: DataFrame | None = None, declarations: DataFrame | None = None) -> DataFrame:
    """Classes of entries (coordinates, artifact_rank, entry_ord, fqn, source) that query names.

    Exact, trailing-segment and simple-name hits are all kept, then the best `limit` fuzzy ones; a class of an artifact
    is listed once, under its best tier. No content is read but that of the first KIND_CAP hits, whose kinds come from
    declarations if these are given; with artifacts, provenance is what their backings promise.
    """
    order = ["tier", F.desc("score"), "artifact_rank", "entry_ord"]
    hits = rank.tiered_search(entries, "fqn", query, ["artifact_rank", "entry_ord"], limit)
    once = rank.first_wins(hits.withColumn("name", dotted(F.col("fqn"))), ["coordinates", "name"], order)
    promise = F.when(F.col("source") != "binary", "source").otherwise("decompiled" if jvm else "signature")
    if artifacts is not None:
        once = once.join(artifacts.select("coordinates", "sourcesJar", "sourceDir", "binaryJar"), "coordinates", "left")
        promise = promised((F.col("sourcesJar"), F.col("sourceDir"), F.col("binaryJar")), jvm)
    found = once.select("coordinates", F.col("name").alias("fqn"), version(F.col("coordinates")).alias("version"), "tier", "score", promise.alias("provenance"), "artifact_rank", "entry_ord")
    known = with_kinds(found, declarations, order) if declarations is not None else found.withColumn("kind", F.lit("class"))
    return known.orderBy(*order)


def records(artifacts: DataFrame, files: DataFrame, coordinates: str | None = None) -> DataFrame:
    """Declarations with the coordinates and artifact_rank of their artifact, out of files (archive, path, text) of its
    sourceDir, else its sourcesJar; of one artifact only if coordinates are given, so no other is read."""
    from lodeframe.operators.declarations import scan_declarations

    wanted = artifacts.filter(F.col("coordinates") == coordinates) if coordinates else artifacts
    backing = wanted.select("coordinates", "artifact_rank", F.coalesce("sourceDir", "sourcesJar").alias("archive")).filter("archive is not null")
    own = files.join(backing, "archive")
    mark = F.concat_ws("\n", "coordinates", "path")
    found = scan_declarations(own.select(mark.alias("path"), "text"))
    split = F.split("path", "\n", 2)
    return found.withColumn("coordinates", split[0]).withColumn("path", split[1]).join(backing.select("coordinates", "artifact_rank"), "coordinates")


def artifact_records(artifacts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, notes): what records() gives, and a row (coordinates, provenance, failed, unreadable) for every artifact
    (coordinates, artifact_rank, binaryJar, sourcesJar, sourceDir): how many of its files (archive, path, text, and error
    where the text could not be read) failed, with the first three problems in the order of paths."""
    from lodeframe.operators.declarations import scan_problems

    backing = artifacts.select("coordinates", F.coalesce("sourceDir", "sourcesJar").alias("archive"))
    own = files.join(backing.filter("archive is not null"), "archive")
    mark = F.concat_ws("\n", "coordinates", "path")
    parsed = scan_problems(own.filter("text is not null").select(mark.alias("path"), "text")).select(F.split("path", "\n", 2).alias("p"), "problem")
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    unread = own.filter("text is null").select("coordinates", "path", F.coalesce(error, F.lit("no text")).alias("problem"))
    wrong = parsed.select(F.col("p")[0].alias("coordinates"), F.col("p")[1].alias("path"), "problem").unionByName(unread)
    three = rank.top_per_key(wrong, ["coordinates"], ["path"], 3).groupBy("coordinates").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "problem"))), lambda x: x["problem"]).alias("shown"))
    counted = wrong.groupBy("coordinates").agg(F.count("*").alias("failed")).join(three, "coordinates")
    note = F.concat(F.col("failed").cast("string"), F.lit(" entries failed to parse ("), F.array_join("shown", ", "), F.lit(")"))
    provenance = F.when(F.col("archive").isNotNull(), "source").otherwise("signature")
    notes = backing.join(counted, "coordinates", "left").select("coordinates", provenance.alias("provenance"), F.coalesce("failed", F.lit(0)).alias("failed"), note.alias("unreadable"))
    return records(artifacts, files.filter("text is not null").select("archive", "path", "text")), notes


def locate(entries: DataFrame, fqn: str) -> DataFrame:
    """The artifact that answers for a class, with the later ones that declare it as alternatives; no row if none does."""
    exact = entries.filter(dotted(F.col("fqn")) == dotted(F.lit(fqn)))
    one = exact.groupBy("coordinates", "artifact_rank").agg(F.min("entry_ord").alias("entry_ord"), F.max(F.when(F.col("source") == "sources", F.col("name"))).alias("source_entry"))
    listed = one.groupBy().agg(F.array_sort(F.collect_list(F.struct("artifact_rank", "coordinates", "entry_ord", "source_entry"))).alias("all")).filter(F.size("all") > 0)
    win = F.get("all", F.lit(0))
    rest = F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["coordinates"])
    return listed.select(win["coordinates"].alias("coordinates"), win["artifact_rank"].alias("artifact_rank"), win["source_entry"].alias("source_entry"), rest.alias("alternatives"))


def outline(declarations: DataFrame, fqn: str, preset: str = "outline", sections: dict[str, bool] | None = None, kind: str | None = None, visibility: str | None = None) -> DataFrame:
    """Declarations of a class and what is nested in it: kind and visibility are plain filters, sections leave out all of
    their kind but never the class's own row."""
    on = PRESETS[preset] | (sections or {})
    rows = declarations.filter(is_family(F.col("fqn"), F.lit(fqn)))
    target = dotted(F.col("fqn")) == dotted(F.lit(fqn))
    keep: Column = F.lit(True)
    for section, kinds in SECTIONS.items():
        keep &= F.lit(on[section]) | ~F.col("kind").isin(*kinds)
    keep &= F.lit(on["inner"]) | target
    for column, wanted in (("kind", kind), ("visibility", visibility)):
        if wanted:
            rows = rows.filter(F.col(column) == wanted)
    return rows.filter(keep).withColumn("javadoc", F.when(F.lit(on["javadoc"]), F.col("javadoc"))).orderBy("path", "line_start")


def imports(files: DataFrame, preset: str = "outline", sections: dict[str, bool] | None = None) -> DataFrame:
    """(path, imports) of files (path, text): import statements as they are written, in their order, where the section is on
    and there are any. Comments and strings hold none."""
    from lodeframe.operators.statements import statements

    on = (PRESETS[preset] | (sections or {}))["imports"]
    rest = F.trim(F.regexp_replace("code", r"[\s\uE000\uE001]+", " "))
    written = F.regexp_replace(rest, r"\s*([.*])\s*", "$1")
    rows = statements(files).filter((F.col("depth") == 0) & F.rlike(rest, F.lit(r"^import\s"))).select("path", "id", F.concat(written, F.when(F.col("ends") == ";", ";").otherwise("")).alias("line"))
    found = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]).alias("imports"))
    return found.filter(F.lit(on))


def disambiguated(name: Column, params: Column) -> Column:
    """name(T1,T2) by simple type names; the bare name of what takes no parameters list."""
    plain = F.transform(params, lambda p: F.substring_index(F.regexp_replace(p, r"\s+", ""), ".", -1))
    return F.when(params.isNull(), name).otherwise(F.concat(name, F.lit("("), F.array_join(plain, ","), F.lit(")")))


def degrade_reason(kind: Column, no_decompile: Column, failure: Column, detail: Column) -> Column:
    """Why a member is served as its signature; failure and detail of an attempt to decompile are null if there was none."""
    out = F.when(F.coalesce(no_decompile, F.lit(False)) | (kind == "jdk"), "jdk: decompilation out of scope")
    out = out.when(failure == "no-jvm", "no-jvm (decompile unavailable)")
    return out.when(failure.isNotNull(), F.concat(F.lit("decompile failed"), F.coalesce(F.concat(F.lit(": "), detail), F.lit("")))).otherwise("no source available")


def signature_text(declarations: DataFrame, note: str) -> DataFrame:
    """(fqn, content): what is read of a class without source: the note, then all signatures in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "line_start", "signature"))), lambda x: x["signature"])
    return declarations.groupBy("fqn").agg(F.concat_ws("\n", F.lit(note), F.array_join(ordered, "\n")).alias("content"))


def merged_notes(*notes: Column) -> Column:
    """Arrays of notes as one, each note once, in the order of their first place; nulls are left out."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(n, empty) for n in notes])))


def answer(rows: DataFrame, stale: bool, *notes: Column) -> DataFrame:
    """rows with stale and degraded, as every answer has them."""
    served = F.array(F.lit("stale index served")) if stale else F.array().cast("array<string>")
    return rows.withColumn("stale", F.lit(stale)).withColumn("degraded", merged_notes(served, *notes))


def warning_lines(notes: Column) -> Column:
    """What is printed of notes: the first, and how many more there are."""
    once = F.array_distinct(notes)
    more = F.when(F.size(once) > 1, F.concat(F.lit("warning: +"), (F.size(once) - 1).cast("string"), F.lit(" more (see: status)")))
    return F.array_compact(F.array(F.when(F.size(once) > 0, F.concat(F.lit("warning: "), F.get(once, F.lit(0)))), more))


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines with all their fields; nulls are absent."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


#: Columns that each command prints.
PRINTED = {
    "find-class": ["fqn", "kind", "coordinates", "provenance"], "search-symbols": ["fqn", "selector", "kind", "signature"], "where": ["slot", "path", "exists"],
    "read-resource": ["name", "size", "note"], "status": ["resolvedAt", "artifact_count", "stale"], "resolve": ["coordinates", "kind", "configuration"],
}


def printed(command: str, rows: DataFrame) -> DataFrame:
    return table_text(rows, PRINTED[command])


def unknown_command(commands: DataFrame, given: str) -> DataFrame:
    """One row that says so, with the nearest of commands (name) if any is near."""
    near = rank.closest(commands, "name", given, 1).agg(F.max("name").alias("near"))
    hint = F.coalesce(F.concat(F.lit(" — did you mean '"), "near", F.lit("'?")), F.lit(""))
    return near.select(F.concat(F.lit(f"unknown command '{given}'"), hint).alias("message"))


def line_range(text: str) -> tuple[int, int]:
    """from:to as two whole numbers from 1 on."""
    ends = text.split(":")
    if len(ends) != 2 or not all(e.isascii() and e.isdigit() and int(e) > 0 for e in ends) or int(ends[0]) > int(ends[1]):
        raise ValueError(f"a range is from:to, not {text!r}")
    return int(ends[0]), int(ends[1])


def shadowed(declarations: DataFrame) -> DataFrame:
    """declarations without the member rows that stand for a class which has a row of its own, fqn.selector."""
    is_type = ~F.col("kind").isin(*SECTIONS["methods"], *SECTIONS["fields"])
    own = F.col("selector") == simple_name(F.col("fqn"))
    classes = declarations.filter(is_type & own).select(F.col("fqn").alias("_class")).distinct()
    members = declarations.filter(is_type & ~own).join(classes, F.concat_ws(".", "fqn", "selector") == F.col("_class"), "left_anti")
    return declarations.filter(~is_type | own).unionByName(members)


def with_parents(classes: DataFrame) -> DataFrame:
    """classes (fqn, any more) with parent: the class each is nested in, null at the root."""
    known = classes.select(F.col("fqn").alias("parent")).distinct()
    return classes.join(known, parent_name(F.col("fqn")) == F.col("parent"), "left")


def _named_members(wanted: DataFrame, declarations: DataFrame, *kept: str) -> DataFrame:
    """Rows of selectors.rows() (with fqn) by each member that they name, with the member's columns kept."""
    receiver = F.col("receiver") if "receiver" in declarations.columns else F.lit(None).cast("string")
    named = declarations.select(dotted(F.col("fqn")).alias("_fqn"), "selector", "params", receiver.alias("_receiver"), *kept)
    fits = (dotted(F.col("fqn")) == F.col("_fqn")) & (F.col("name") == F.col("selector"))
    met = wanted.filter("error is null").join(named, fits)
    own = F.transform("params", S.plain_type)
    same = F.forall(F.zip_with(own, "types", lambda a, b: S.same_type(a, b)), lambda x: x)
    arity = F.col("any_params") | ((F.size("params") == F.size("types")) & F.coalesce(same, F.lit(False)))
    return met.filter(arity & (F.col("of").isNull() | (F.substring_index(F.coalesce("_receiver", F.lit("")), ".", -1) == F.col("of"))))


def count_members(declarations: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (fqn, selectors as text, any more) with hits: how many members the selectors of a row name, a member once for
    each selector; 0 where a selector can't be read.

    Asks that are alike are looked up once, and members that no selector tells apart are one row with their number, so the
    join has a row for each form of an ask and of a member, and no pair of an ask and a member ever is a row.
    """
    receiver = F.col("receiver") if "receiver" in declarations.columns else F.lit(None).cast("string")
    forms = declarations.select("fqn", "selector", "params", receiver.alias("receiver")).groupBy("fqn", "selector", "params", "receiver").agg(F.count("*").alias("_n"))
    alike = asked.select("fqn", "selectors").distinct().withColumn("ask", F.struct("fqn", "selectors"))
    hits = _named_members(S.rows(alike).hint("merge"), forms, "_n").groupBy("ask").agg(F.sum("_n").alias("_hits"))
    told = hits.select(F.col("ask.fqn").alias("_fqn"), F.col("ask.selectors").alias("_selectors"), "_hits")
    same = (F.col("fqn") == F.col("_fqn")) & (F.col("selectors") == F.col("_selectors"))
    return asked.join(told.hint("merge"), same, "left").withColumn("hits", F.coalesce("_hits", F.lit(0)).cast("long")).drop("_fqn", "_selectors", "_hits")


def read_members(declarations: DataFrame, files: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices, misses) for asked (ask, fqn, selectors as text, degraded or null): for each ask the lines of each member that
    its selectors name, comment included; what was missed, and why. All asks and selectors are one join.

    Where degraded says why there is no source, members are given as their signatures, at line 0, and each selector that
    finds any is a miss too. A selector that can't be read makes its whole ask one miss.
    """
    wanted = S.rows(asked)
    found = _named_members(wanted, declarations, "path", "signature", "line_start", "line_end", "doc_start")
    texts = found.join(files.select("path", T.lines(F.col("text")).alias("_lines")), "path", "left")
    pseudo = F.col("degraded").isNotNull() | F.col("line_start").isNull() | F.col("line_end").isNull() | F.col("_lines").isNull()
    start = F.coalesce("doc_start", "line_start")
    slices = texts.select(
        "ask", "selector_ord", disambiguated(F.col("selector"), F.col("params")).alias("selector"), "signature", F.when(pseudo, 0).otherwise(start).alias("first"), F.when(pseudo, 0).otherwise(F.col("line_end")).alias("last"),
        F.when(pseudo, F.array("signature")).otherwise(F.slice("_lines", start, F.col("line_end") - start + 1)).alias("lines"),
        F.when(~pseudo & (F.col("doc_start") < F.col("line_start")), F.slice("_lines", F.col("doc_start"), F.col("line_start") - F.col("doc_start"))).alias("javadoc"),
    )
    hit = found.select("ask", "selector_ord").distinct().withColumn("hit", F.lit(True))
    reason = F.coalesce("error", F.when(F.col("hit").isNull(), F.lit("no matching declaration")).otherwise(F.col("degraded")))
    misses = wanted.join(hit, ["ask", "selector_ord"], "left").withColumn("reason", reason).filter("reason is not null").select("ask", "selector_ord", "asked", "reason")
    return slices, misses


def read_member(declarations: DataFrame, files: DataFrame, fqn: str, wanted: str, degraded: str | None = None) -> tuple[DataFrame, DataFrame]:
    """read_members() of one class, in order; a selector that can't be read is an error."""
    S.parse_list(wanted)
    asked = declarations.sparkSession.createDataFrame([(0, fqn, wanted, degraded)], "ask int, fqn string, selectors string, degraded string")
    slices, misses = read_members(declarations, files, asked)
    return slices.drop("ask").orderBy("selector_ord", "first"), misses.drop("ask")


def read_source(files: DataFrame, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A file's lines, or those from first to last, with the line count and whether the range was clamped."""
    if (first is None) != (last is None):
        raise ValueError("lines need both ends")
    all_lines = T.lines(F.col("text"))
    one = files.filter(F.col("path") == path)
    if first is None:
        return one.select("path", F.size(all_lines).alias("line_count"), all_lines.alias("lines"), F.lit(False).alias("clamped"))
    part = T.line_slice(all_lines, first, last)
    return one.select("path", F.size(all_lines).alias("line_count"), part.alias("p")).select("path", "line_count", "p.lines", "p.first", "p.last", "p.clamped")


def numbered_lines(source: DataFrame) -> DataFrame:
    """read_source() of a whole file as numbered text lines."""
    rows = source.select(F.length(F.col("line_count").cast("string")).alias("width"), F.posexplode("lines").alias("i", "line"))
    return rows.select((F.col("i") + 1).alias("n"), T.numbered(F.col("i") + 1, F.col("width"), F.col("line")).alias("numbered"))


def resolve_artifact(artifacts: DataFrame, query: str) -> str:
    """The coordinates that query means: exactly, or as the only artifact with that id."""
    hits = artifacts.filter((F.col("coordinates") == query) | (artifact_id(F.col("coordinates")) == query)).select("coordinates").orderBy((F.col("coordinates") != query), "coordinates").limit(10).collect()
    names = [r.coordinates for r in hits]
    if query in names or len(names) == 1:
        return query if query in names else names[0]
    if names:
        raise LookupError(f'ambiguous artifact "{query}": matches {", ".join(names)}')
    raise LookupError(f'unknown artifact "{query}": not in the resolved set ({artifacts.count()} artifacts)')


def resolve_artifacts(artifacts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (q) with status and coordinates: what each query means, by coordinates or else by the second part of them. Two
    equi-joins, so both sides may grow; of an ambiguous query the number of artifacts it may mean is n."""
    keyed = asked.select("q").distinct()
    known = artifacts.select("coordinates", artifact_id(F.col("coordinates")).alias("_id"))
    exact = keyed.join(known, F.col("q") == F.col("coordinates"), "left").groupBy("q").agg(F.max("coordinates").alias("exact"))
    ids = known.groupBy("_id").agg(F.count("*").alias("n"), F.min("coordinates").alias("only"))
    met = exact.join(ids, F.col("q") == F.col("_id"), "left").withColumn("n", F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long"))
    status = F.when(F.col("n") == 1, "unique").when(F.col("n") == 0, "unknown artifact").otherwise("ambiguous artifact")
    return met.select("q", "n", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("coordinates"))


def read_resource(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries (archive, entry_ord, name, usize, is_dir) that the glob takes, with their text or why there is none."""
    from lodeframe.sources.archives import contents

    wanted = entries.filter(~F.col("is_dir") & T.matches_glob(F.col("name"), pattern)).select("archive", "entry_ord", "name", "usize")
    read = contents(wanted)
    binary = T.is_binary(F.col("name"), F.col("content"))
    body = F.when(~binary, T.utf8_prefix(F.col("content"), RESOURCE_LIMIT))
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(binary, "binary entry — content omitted").when(F.octet_length("content") > RESOURCE_LIMIT, f"truncated at {RESOURCE_LIMIT} bytes")
    return read.select("name", F.col("usize").alias("size"), binary.alias("binary"), body.alias("text"), note.alias("note"), "entry_ord").orderBy("entry_ord").drop("entry_ord")


def search_symbols(declarations: DataFrame, query: str, kind: str | None = None, limit: int = rank.MEMBER_LIMIT) -> DataFrame:
    """Members of one artifact's declarations by name; signatures are cut to a cell's length."""
    rows = declarations.filter(F.col("kind") == kind) if kind else declarations
    hits = rank.member_search(rows, "selector", query, ["path", "line_start"], limit)
    return hits.select("fqn", "selector", "kind", T.truncated(F.col("signature")).alias("signature"), "tier", "score", "line_start").orderBy("tier", F.desc("score"), "line_start")


def miss(entries: DataFrame, query: str, searched: DataFrame) -> DataFrame:
    """What to say when nothing was hit: the whole search for the simple name of query; if that finds nothing either, one
    row that says so. searched: how many artifacts were."""
    hits = find_class(entries, query.rsplit(".", 1)[-1])
    near = hits.select("fqn", "coordinates", F.lit(None).cast("string").alias("note"))
    nothing = near.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("fqn"), F.lit(None).cast("string").alias("coordinates"), F.lit(MISS_NOTE).alias("note"))
    return near.unionByName(nothing).crossJoin(F.broadcast(searched.agg(F.count("*").alias("searched"))))


def status(manifest: DataFrame, stale: bool) -> DataFrame:
    return manifest.select("resolvedAt", "dependencySetHash", F.size("artifacts").alias("artifact_count"), F.lit(stale).alias("stale"))


def table_text(rows: DataFrame, columns: list[str], cell: int = 60, shown: int = 120) -> DataFrame:
    """Rows as aligned cells of one line each; widths are one aggregate over what is shown."""
    cells = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).limit(shown)
    clip = cells.select(*[T.clipped(F.col(c), cell).alias(c) for c in columns])
    widths = clip.agg(*[F.greatest(F.lit(1), F.max(F.length(c))).alias(f"_{c}") for c in columns])
    padded = [F.rpad(c, F.col(f"_{c}"), F.lit(" ")) for c in columns[:-1]] + [F.col(columns[-1])]
    return clip.crossJoin(F.broadcast(widths)).select(F.concat_ws("  ", *padded).alias("line"))
