"""Where artifacts come from: the manifest, build dumps, class paths and cache folders; and whether they are stale."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodeframe.functions.names import is_cached_jar
from lodeframe.functions.text import version_key
from lodeframe.operators.order import numbered
from lodeframe.operators.rank import first_nonempty, first_wins
from lodeframe.schemas import ARTIFACT, DUMP, MANIFEST, MANIFEST_VERSION

BEGIN, END = "<<<DEPENDENCIES", "DEPENDENCIES>>>"
#: Most files of the caches that a scan visits.
SCAN_BUDGET = 20_000


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one row, or none where it is damaged or of another version."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    return parsed.filter((F.col("version") == MANIFEST_VERSION) & F.col("artifacts").isNotNull())


def write_manifest(path: str, resolved_at: str, fingerprint: str, artifacts: list[dict]) -> None:
    """Write it in one step: a reader sees the old file or the new one."""
    with open(f"{path}.tmp", "w") as f:
        json.dump({"version": MANIFEST_VERSION, "resolvedAt": resolved_at, "dependencySetHash": fingerprint, "artifacts": artifacts}, f)
    os.replace(f"{path}.tmp", path)


def artifacts(manifest: DataFrame) -> DataFrame:
    """One row an artifact, with artifact_rank: its place decides who wins."""
    return manifest.select(F.posexplode("artifacts").alias("artifact_rank", "a")).select("artifact_rank", "a.*")


def configuration_label(name: Column) -> Column:
    """Label of a build configuration's name; case matters, and so does the order of the cases."""
    holds = lambda word: F.contains(name, F.lit(word))
    return (
        F.when(F.startswith(name, F.lit("kapt")) | holds("annotationProcessor"), "annotationProcessor")
        .when(holds("test"), "test").when(holds("compile"), "compile").when(holds("runtime"), "runtime").otherwise("compile")
    )


def module_coordinates(project: Column, label: Column) -> Column:
    """module:<namespace>:<label>: the namespace, the folder's name and a hash of its path, parts builds with equal labels."""
    name = F.regexp_replace(F.substring_index(project, "/", -1), r"[^A-Za-z0-9_-]+", "_")
    namespace = F.concat(F.when(name == "", "root").otherwise(name), F.lit("-"), F.substring(F.sha2(project.cast("binary"), 256), 1, 8))
    bare = F.regexp_replace(label, "^:", "")
    return F.concat(F.lit("module:"), namespace, F.lit(":"), F.when(bare == "", "root").otherwise(bare))


def from_dump(output: DataFrame, project: str) -> DataFrame:
    """Artifacts of a build's output (value): the JSON between the marks; sources join by coordinates, first wins. Modules
    have coordinates of their project and no configuration."""
    found = output.select(F.from_json(F.regexp_extract("value", rf"(?s){BEGIN}(.*?){END}", 1), DUMP).alias("d")).filter("d is not null")
    configurations = found.select("d.sources", F.posexplode("d.configurations").alias("c_ord", "c"))
    deps = configurations.select("sources", "c_ord", F.col("c.name").alias("configuration"), F.posexplode("c.dependencies").alias("d_ord", "dep"))
    module, given, path = F.col("dep.kind") == "module", F.col("dep.coordinates"), F.col("dep.path")
    rows = deps.select(
        "c_ord", "d_ord", F.when(module, module_coordinates(F.lit(project), given)).otherwise(given).alias("coordinates"),
        F.when(~module, configuration_label(F.col("configuration"))).alias("configuration"), F.when(module, "module").otherwise("external").alias("kind"),
        F.when(~module, path).alias("binaryJar"), F.when(~module, F.element_at("sources", given)).alias("sourcesJar"), F.when(module, path).alias("sourceDir"),
    )
    return first_wins(rows, ["coordinates"], ["c_ord", "d_ord"])


def with_sibling_sources(arts: DataFrame, existing: DataFrame) -> DataFrame:
    """arts (binaryJar, any more) with sourcesJar: the -sources.jar beside the binary one, if existing (path) has it."""
    beside = F.regexp_replace("binaryJar", r"\.jar$", "-sources.jar")
    there = existing.select(F.col("path").alias("sourcesJar")).distinct()
    return arts.drop("sourcesJar").join(there, beside == F.col("sourcesJar"), "left")


def find_modules(files: DataFrame) -> DataFrame:
    """(dir): folders of a project with a pom.xml, out of its files (path, relative to the root): one to three levels down,
    none of them hidden."""
    return files.filter(F.rlike("path", F.lit(r"^(?:[^./][^/]*/){1,3}pom\.xml$"))).select(F.regexp_replace("path", r"/pom\.xml$", "").alias("dir")).distinct()


def module_dirs(modules: DataFrame, produced: DataFrame) -> DataFrame:
    """modules (dir) with is_output: whether produced (path, of class paths) names their target/classes, whatever the case
    and whatever slashes it ends with."""
    outputs = produced.select(F.lower(F.regexp_replace(F.translate("path", "\\", "/"), "/+$", "")).alias("_output")).distinct()
    return modules.join(outputs, F.lower(F.concat("dir", F.lit("/target/classes"))) == F.col("_output"), "left").withColumn("is_output", F.col("_output").isNotNull()).drop("_output")


def reactor_artifacts(modules: DataFrame, root: str, project: str) -> DataFrame:
    """Artifacts of modules (dir, below root; is_output) whose compiled output is on a class path: their own folders."""
    relative = F.substring("dir", len(root.rstrip("/")) + 2, 1 << 30)
    own = modules.filter("is_output")
    return own.select(module_coordinates(F.lit(project), relative).alias("coordinates"), F.lit("compile+runtime+test").alias("configuration"), F.lit("module").alias("kind"), F.col("dir").alias("sourceDir"))


def partial_note(modules: DataFrame) -> DataFrame:
    """One row (note) that names the modules (dir, is_output) without an output, or none: a reactor that failed in part."""
    missing = modules.filter(~F.col("is_output")).agg(F.array_join(F.array_sort(F.collect_list("dir")), ", ").alias("all"), F.count("*").alias("n"))
    return missing.filter("n > 0").select(F.concat(F.lit("modules failed to resolve: "), "all").alias("note"))


def jdk_artifact(releases: DataFrame, existing: DataFrame) -> DataFrame:
    """The pseudo-artifact of each JDK folder (home, release: the text of its release file, or null) that has a src.zip."""
    version = F.coalesce(F.nullif(F.regexp_extract("release", r'(?m)^JAVA_VERSION="([^"]+)"', 1), F.lit("")), F.substring_index("home", "/", -1))
    rows = releases.select(F.concat(F.lit("jdk:"), version).alias("coordinates"), F.lit("jdk").alias("configuration"), F.lit("jdk").alias("kind"), F.lit(True).alias("noDecompile"), F.concat("home", F.lit("/lib/src.zip")).alias("sourcesJar"))
    return rows.join(existing.select(F.col("path").alias("sourcesJar")).distinct(), "sourcesJar", "left_semi").select(*rows.columns)


#: Build files of a project's root, those of its folders, and the marks of a build system.
ROOT_BUILD_FILES = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "gradle/libs.versions.toml", "gradle.lockfile", "gradlew", "pom.xml", "mvnw")
FOLDER_BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")
GRADLE_MARKS = ("settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts", "gradlew", "gradlew.bat")


def is_build_file(path: Column) -> Column:
    """Whether a path, relative to the project, counts for the fingerprint."""
    return path.isin(*ROOT_BUILD_FILES) | ((F.size(F.split(path, "/")) == 2) & F.substring_index(path, "/", -1).isin(*FOLDER_BUILD_FILES))


def build_systems(files: DataFrame) -> DataFrame:
    """One row, an array of the build systems that files (path, relative) show, in the order they are asked."""
    shows = lambda paths: F.coalesce(F.bool_or(F.col("path").isin(*paths)), F.lit(False))
    return files.agg(F.array_compact(F.array(F.when(shows(GRADLE_MARKS), "gradle"), F.when(shows(("pom.xml",)), "maven"))).alias("systems"))


def resolve(systems: list[tuple[str, DataFrame, str | None]], caches: DataFrame, jdk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(artifacts, notes): those of the first system (name, artifacts, why it failed) that has any, else those of the caches;
    the JDK comes last; of equal coordinates the first wins. notes: one row for each system that gave none."""
    columns = ["coordinates", "configuration", "kind", "binaryJar", "sourcesJar", "sourceDir", "noDecompile"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("boolean" if c == "noDecompile" else "string")).alias(c) for c in columns])

    ranked = [shaped(df).withColumn("ord", F.monotonically_increasing_id()) for _, df, _ in systems] + [shaped(caches).withColumn("ord", F.monotonically_increasing_id())]
    chosen = first_nonempty(ranked)
    if jdk is not None:
        chosen = chosen.unionByName(shaped(jdk).withColumns({"ord": F.lit(0).cast("long"), "priority": F.lit(len(ranked))}))
    notes = None
    for k, (name, df, reason) in enumerate(systems):
        none = df.agg(F.count("*").alias("n")).filter("n = 0")
        one = none.select(F.lit(k).alias("ord"), F.lit(name).alias("system"), F.lit(reason or "no-artifacts").alias("reason"))
        notes = one if notes is None else notes.unionByName(one)
    if notes is None:
        notes = caches.sparkSession.createDataFrame([], "ord int, system string, reason string")
    return first_wins(chosen, ["coordinates"], ["priority", "ord"]).orderBy("priority", "ord").drop("priority", "ord"), notes


def from_classpath(lines: DataFrame, repository: str) -> DataFrame:
    """Artifacts of class-path lines (value): jars below repository/<group>/<artifact>/<version>/ with their coordinates."""
    value = F.trim("value")
    windows = F.contains(value, F.lit(";")) | F.rlike(value, F.lit(r"^[A-Za-z]:[\\/]"))
    paths = lines.select(F.posexplode(F.when(windows, F.split(value, ";")).otherwise(F.split(value, ":"))).alias("ord", "path"))
    below = F.regexp_replace("path", r"\\", "/")
    inside = F.when(F.startswith(F.lower(below), F.lit(repository.lower().rstrip("/") + "/")), F.substring(below, F.lit(len(repository.rstrip("/")) + 2), F.length(below)))
    parts = F.split(inside, "/")
    rows = paths.withColumn("parts", parts).filter(F.size("parts") >= 4)
    artifact, version, file = F.element_at("parts", -3), F.element_at("parts", -2), F.element_at("parts", -1)
    named = rows.filter(file == F.concat(artifact, F.lit("-"), version, F.lit(".jar")))
    group = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 3), ".")
    return first_wins(named.select("ord", F.concat_ws(":", group, artifact, version).alias("coordinates"), F.col("path").alias("binaryJar")), ["coordinates"], ["ord"])


def visited_files(spark: SparkSession, maven: str | None, gradle: str | None) -> DataFrame:
    """(root, path, name, place): the files of both cache folders in the order of a walk, the repository before the cache.

    A walk takes a folder's files by name, then its folders, the last one first.
    """
    found = None
    for root, path in enumerate((maven, gradle)):
        if path:
            inside = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + path.rstrip("/") + "/", "")
            one = cached_files(spark, path).select(F.lit(root).alias("root"), "path", inside.alias("name"))
            found = one if found is None else found.unionByName(one)
    # files come before folders by a mark; of folders the hex digits are turned round, and an end mark is past all of them
    parts = F.split("name", "/")
    folder = lambda part: F.concat(F.lit("1"), F.translate(F.hex(part), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    turned = F.transform(parts, lambda part, k: F.when(k == F.size(parts) - 1, F.concat(F.lit("0"), part)).otherwise(folder(part)))
    return numbered(found.withColumn("walk", F.array_join(turned, "/")), ["root", "walk", "path"]).drop("walk")


def scan_caches(spark: SparkSession, maven: str | None, gradle: str | None, budget: int = SCAN_BUDGET) -> DataFrame:
    """Artifacts of cache folders by file names alone, newest version of each, with what else was seen and a warning.

    At most budget files are visited, whatever they are, in the order of a walk over both folders; scan_warning() tells
    whether there were more.
    """
    visited = visited_files(spark, maven, gradle).filter(F.col("place") < budget).filter(is_cached_jar(F.col("path")))
    two = (r"^(?:(.+)/)?([^/]+)/([^/]+)/\2-\3(-sources)?\.jar$", r"^([^/]+)/([^/]+)/([^/]+)/(?i:[0-9a-f]+)/\2-\3(-sources)?\.jar$")
    part = lambda n: F.when(F.col("root") == 0, F.regexp_extract("name", two[0], n)).otherwise(F.regexp_extract("name", two[1], n))
    group = F.when(F.col("root") == 0, F.translate(part(1), "/", ".")).otherwise(part(1))
    named = visited.filter(F.when(F.col("root") == 0, F.rlike("name", F.lit(two[0]))).otherwise(F.rlike("name", F.lit(two[1]))))
    files = named.select("root", "place", group.alias("g"), part(2).alias("a"), part(3).alias("v"), (part(4) != "").alias("sources"), "path")
    pick = lambda wanted: F.min(F.when(F.col("sources") == wanted, F.struct("place", "path"))).getField("path")
    paired = files.groupBy("g", "a", "v").agg(pick(False).alias("binaryJar"), pick(True).alias("sourcesJar"))
    keyed = paired.withColumn("key", version_key(F.col("v")))
    every = keyed.groupBy("g", "a").agg(F.array_sort(F.collect_list(F.struct("key", "v", "binaryJar", "sourcesJar"))).alias("all"))
    best, others = F.element_at("all", -1), F.transform(F.slice("all", F.lit(1), F.size("all") - 1), lambda x: x["v"])
    coordinates = F.concat_ws(":", "g", "a", best["v"])
    warning = F.when(F.size("all") > 1, F.concat(F.lit("multiple-versions:"), F.col("g"), F.lit(":"), F.col("a"), F.lit(" (kept "), best["v"], F.lit(", also saw "), F.array_join(others, ","), F.lit(")")))
    return every.select(coordinates.alias("coordinates"), F.lit("cache-scan").alias("kind"), best["binaryJar"].alias("binaryJar"), best["sourcesJar"].alias("sourcesJar"), warning.alias("warning"))


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def scan_warning(spark: SparkSession, maven: str | None, gradle: str | None, budget: int = SCAN_BUDGET) -> DataFrame:
    """One row (warning) if the cache folders hold more files than a scan visits; it names the first that it does not."""
    counts = visited_files(spark, maven, gradle).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > budget).select(F.lit(f"cache-scan-truncated:{budget + 1}").alias("warning"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: hash over the sorted lines `path, size, mtime` of build files; a file without a size has vanished."""
    line = F.when(F.col("size").isNull(), F.concat("path", F.lit("\t(vanished)"))).otherwise(F.concat_ws("\t", "path", F.col("size").cast("string"), F.col("mtime").cast("string")))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def paths(arts: DataFrame) -> DataFrame:
    """(coordinates, kind, path) of what each artifact has, in the fixed order."""
    slots = [("sourcesJar", 0), ("sourceDir", 1), ("binaryJar", 2)]
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(c).alias("slot"), F.col(c).alias("path")) for c, o in slots])
    return arts.select("coordinates", F.explode(rows).alias("r")).select("coordinates", "r.*").filter("path is not null")


def where(arts: DataFrame, existing: DataFrame) -> DataFrame:
    """paths() with exists, by a join with a listing (path); all_missing tells artifacts that are gone."""
    seen = existing.select("path").distinct().withColumn("_there", F.lit(True))
    rows = paths(arts).join(seen, "path", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")
    return rows.withColumn("all_missing", ~F.bool_or("exists").over(Window.partitionBy("coordinates")))


def is_stale(manifest: DataFrame, fingerprint_now: str, existing: DataFrame) -> bool:
    """Whether the build files changed or a recorded path is gone."""
    changed = manifest.filter(F.col("dependencySetHash") != fingerprint_now).limit(1)
    gone = paths(artifacts(manifest)).join(existing.select("path"), "path", "left_anti").limit(1)
    return not (changed.isEmpty() and gone.isEmpty())

