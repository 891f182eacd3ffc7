import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import names
from lodeframe.operators.declarations import scan_declarations
from lodeframe.plans import backings, search
from lodeframe.sources import archives, catalog

JAVA = '''package org.sample;

import java.util.List;

/** A box of things. More text. */
public class Box<T> {
    /** Name of all boxes; braces { in "text" don't count. */
    public static final String NAME = "{ box";
    private int size;

    public Box(int size) {
        this.size = size;
    }

    /**
     * Puts a thing in.
     * @param thing what
     */
    public void put(T thing, List<String> tags) {
        if (thing == null) {
            throw new IllegalStateException("}");
        }
    }

    public void put() { }

    // int commented(int a) { }
    @Deprecated
    protected static int old(String[] names) {
        return names.length;
    }

    static class Lid {
        void close() {
        }
    }
}
'''


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    with zipfile.ZipFile(root / "one.jar", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("org/sample/Box.class", b"\xca\xfe")
        z.writestr("org/sample/Box$Lid.class", b"\xca\xfe")
        z.writestr("org/sample/Box$1.class", b"\xca\xfe")
        z.writestr("module-info.class", b"")
        z.writestr("config/app.properties", "a=1\n")
        z.writestr("logo.png", b"\x89PNG\x00")
        z.writestr("data.txt", b"ab\x00c")
        z.writestr("org/sample/Box.java", JAVA)
    (root / "broken.jar").write_bytes(b"not an archive")
    return root


def test_listing_by_both_readers(spark, archive):
    spark.dataSource.register(archives.ArchiveListing)
    tail = spark.read.format("archive_listing").load(str(archive))
    whole = archives.archive_entries(spark, str(archive))
    for listing in (tail, whole):
        rows = listing.collect()
        assert {r.name for r in rows if r.error is None} >= {"org/sample/Box.class", "logo.png", "config/app.properties"}
        assert sum(r.error is not None for r in rows) == 1
    names = {(r.fqn, r.source) for r in archives.class_entries(tail).collect()}
    assert names == {("org.sample.Box", "binary"), ("org.sample.Box$Lid", "binary"), ("org.sample.Box", "sources")}


def test_listing_does_not_read_contents(spark, archive):
    files = spark.read.format("binaryFile").load(str(archive)).select("path", "length")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_resources(spark, archive):
    spark.dataSource.register(archives.ArchiveListing)
    entries = spark.read.format("archive_listing").load(f"{archive}/one.jar")
    rows = {r.name: r for r in search.read_resource(entries, "*.*").collect()}
    assert set(rows) == {"logo.png", "data.txt", "module-info.class"}
    assert rows["logo.png"].binary and rows["data.txt"].binary and rows["logo.png"].text is None
    assert [r.text for r in search.read_resource(entries, "**/app.properties").collect()] == ["a=1\n"]


def test_contents_report_damage(spark, archive):
    wanted = spark.createDataFrame([(f"{archive}/one.jar", "data.txt"), (f"{archive}/one.jar", "nothing"), (f"{archive}/broken.jar", "x")], "archive string, name string")
    rows = {r.name: r for r in archives.contents(wanted).collect()}
    assert bytes(rows["data.txt"].content) == b"ab\x00c" and rows["nothing"].error and rows["x"].error


def test_declarations(spark):
    files = spark.createDataFrame([("Box.java", JAVA), ("Empty.java", "")], "path string, text string")
    rows = {(r.fqn, r.selector, r.kind, tuple(r.params or ())): r for r in scan_declarations(files).collect()}
    assert set(rows) == {
        ("org.sample.Box", "Box", "class", ()), ("org.sample.Box", "NAME", "field", ()), ("org.sample.Box", "size", "field", ()),
        ("org.sample.Box", "Box", "constructor", ("int",)), ("org.sample.Box", "put", "method", ("T", "List<String>")), ("org.sample.Box", "put", "method", ()),
        ("org.sample.Box", "old", "method", ("String[]",)), ("org.sample.Box.Lid", "Lid", "class", ()), ("org.sample.Box.Lid", "close", "method", ()),
    }
    put = rows["org.sample.Box", "put", "method", ("T", "List<String>")]
    assert (put.doc_start, put.line_start, put.line_end, put.visibility) == (15, 19, 23, "public")
    old = rows["org.sample.Box", "old", "method", ("String[]",)]
    assert old.deprecated and old.static and old.visibility == "protected" and not put.deprecated


def test_long_comments_and_deep_nesting(spark):
    long = "\n".join(["/** First. Second.", *[f" * line {k}" for k in range(900)], " * @deprecated", " */"])
    deep = "package d;\n" + "".join("  " * k + f"class C{k} {{\n" for k in range(7)) + long + "\nvoid m() { }\n" + "}\n" * 7
    rows = {r.selector: r for r in scan_declarations(spark.createDataFrame([("D.java", deep)], "path string, text string")).collect()}
    assert rows["m"].fqn == "d.C0.C1.C2.C3.C4.C5.C6" and rows["C6"].fqn == rows["m"].fqn and rows["C6"].line_end == 8 + 903 + 1 + 1
    assert rows["m"].javadoc.count("\n") == 902 and rows["m"].doc_start == 9 and rows["m"].deprecated and not rows["C6"].deprecated


def test_outline_members_and_symbols(spark):
    files = spark.createDataFrame([("Box.java", JAVA)], "path string, text string")
    found = scan_declarations(files)
    assert [r.selector for r in search.outline(found, "org.sample.Box", "minimal").collect()] == ["Box", "Box", "put", "put", "old", "Lid", "close"]
    assert {r.kind for r in search.outline(found, "org.sample.Box", kind="method").collect()} == {"method"}
    assert [r.selector for r in search.outline(found, "org.sample.Box", visibility="private").collect()] == ["size"]
    assert all(r.javadoc is None for r in search.outline(found, "org.sample.Box", "minimal").collect())
    assert search.imports(files).first().imports == ["import java.util.List;"] and search.imports(files, "minimal").count() == 0
    assert {r.selector for r in search.outline(found, "org.sample.Box", sections={"methods": False}).collect()} == {"Box", "NAME", "size", "Lid"}
    slices, misses = search.read_member(found, files, "org.sample.Box", "#put(T,List<String>), #gone, #put()")
    assert [(r.selector_ord, r.first, len(r.lines)) for r in slices.collect()] == [(0, 15, 9), (2, 25, 1)]
    assert [r.asked for r in misses.collect()] == ["#gone"]
    assert [r.selector for r in search.search_symbols(found, "put").collect()] == ["put", "put"]
    assert search.read_source(files, "Box.java", 2, 3).first().lines == ["", "import java.util.List;"]


def test_find_class_and_miss(spark):
    rows = [("g:a:1", 0, 0, "org.sample.Box", "binary", "x"), ("g:a:1", 0, 1, "org.sample.Box$Lid", "binary", "x"), ("g:b:1", 1, 0, "org.sample.Box", "sources", "org/sample/Box.java"), ("g:b:1", 1, 1, "net.BigBoxer", "sources", "y")]
    entries = spark.createDataFrame(rows, "coordinates string, artifact_rank int, entry_ord int, fqn string, source string, name string")
    hits = [(r.coordinates, r.fqn, r.tier) for r in search.find_class(entries, "Box").collect()]
    assert hits == [("g:a:1", "org.sample.Box", 2), ("g:b:1", "org.sample.Box", 2), ("g:a:1", "org.sample.Box.Lid", 3), ("g:b:1", "net.BigBoxer", 3)]
    win = search.locate(entries, "org.sample.Box").first()
    assert (win.coordinates, win.alternatives) == ("g:a:1", ["g:b:1"])
    assert search.locate(entries, "org.sample.None").count() == 0
    assert search.miss(entries, "q.Zzz", entries).first().note == search.MISS_NOTE and {r.fqn for r in search.miss(entries, "q.Box", entries).collect()} >= {"org.sample.Box"}
    arts = entries.select("coordinates").distinct()
    assert search.resolve_artifact(arts, "a") == "g:a:1"
    with pytest.raises(LookupError, match="unknown artifact"):
        search.resolve_artifact(arts, "zz")


def test_manifest_where_and_staleness(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    arts = [{"coordinates": "g:a:1", "kind": "external", "binaryJar": "/x/a.jar", "sourcesJar": "/x/a-sources.jar"}, {"coordinates": "module:m:x", "kind": "module", "sourceDir": "/x/src"}]
    catalog.write_manifest(path, "2024-01-01T00:00:00Z", "h", arts)
    manifest = catalog.read_manifest(spark, path)
    there = spark.createDataFrame([("/x/a.jar",), ("/x/a-sources.jar",)], "path string")
    rows = catalog.where(catalog.artifacts(manifest), there).orderBy("coordinates", "ord").collect()
    assert [(r.slot, r.exists, r.all_missing) for r in rows] == [("sourcesJar", True, False), ("binaryJar", True, False), ("sourceDir", False, True)]
    assert catalog.is_stale(manifest, "h", there) and not catalog.is_stale(manifest, "h", there.union(spark.createDataFrame([("/x/src",)], "path string")))
    assert search.status(manifest, False).first().artifact_count == 2
    for bad in ("{", json.dumps({"version": 1, "artifacts": []})):
        (tmp_path / "bad.json").write_text(bad)
        assert catalog.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0


def test_dump_classpath_and_caches(spark, tmp_path):
    dump = {"configurations": [{"name": "testRuntimeClasspath", "dependencies": [{"coordinates": "g:a:1", "kind": "external", "path": "/r/a.jar"}]}, {"name": "compileClasspath", "dependencies": [{"coordinates": "g:a:1", "kind": "external", "path": "/r/a.jar"}, {"coordinates": "g:b:2", "kind": "module", "path": "/m"}]}], "sources": {"g:a:1": "/r/a-sources.jar"}}
    out = spark.createDataFrame([("noise\n" + catalog.BEGIN + json.dumps(dump) + catalog.END + "\nmore",)], "value string")
    rows = {r.coordinates: r for r in catalog.from_dump(out, "/work/demo app").collect()}
    assert rows["g:a:1"].configuration == "test" and rows["g:a:1"].sourcesJar == "/r/a-sources.jar" 
    module = rows["module:demo_app-" + hashlib.sha256(b"/work/demo app").hexdigest()[:8] + ":g:b:2"]
    assert (module.sourceDir, module.configuration, module.kind) == ("/m", None, "module")
    lines = spark.createDataFrame([("/r/org/x/lib/1.0/lib-1.0.jar:/r/org/x/lib/1.0/other.jar:/else/y.jar",)], "value string")
    assert [r.coordinates for r in catalog.from_classpath(lines, "/r").collect()] == ["org.x:lib:1.0"]
    for v, files in {"1.9.0": ["lib-1.9.0.jar"], "1.10.0": ["lib-1.10.0.jar", "lib-1.10.0-sources.jar", "lib-1.10.0.pom"], "1.10.0.RC1": ["lib-1.10.0.RC1.jar"]}.items():
        (tmp_path / "org" / "x" / "lib" / v).mkdir(parents=True)
        for f in files:
            (tmp_path / "org" / "x" / "lib" / v / f).write_text("x")
    row = catalog.scan_caches(spark, str(tmp_path), None).first()
    assert row.coordinates == "org.x:lib:1.10.0" and row.sourcesJar.endswith("-sources.jar") and "also saw 1.9.0,1.10.0.RC1" in row.warning


def test_labels_and_fixed_values(spark):
    names = ["kaptDebug", "debugAnnotationProcessor", "annotationProcessor", "testRuntimeClasspath", "compileClasspath", "runtimeClasspath", "debugUnitTestCompileClasspath", "myKapt", "other"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(catalog.configuration_label(F.col("n")).alias("l")).collect()
    assert [r.l for r in rows] == ["annotationProcessor", "compile", "annotationProcessor", "test", "compile", "runtime", "compile", "compile", "compile"]
    assert search.PRESETS["minimal"] == {"imports": False, "fields": False, "methods": True, "inner": True, "javadoc": False}
    assert all(search.PRESETS["outline"].values()) and all(search.PRESETS["full"].values())


def test_one_flow_from_artifacts_to_answers(spark):
    arts = spark.createDataFrame([(0, "g:src:1", "/b.jar", "/s.jar", None), (1, "g:bin:2", "/c.jar", None, None), (2, "module:m:x", None, None, "/m")], "artifact_rank int, coordinates string, binaryJar string, sourcesJar string, sourceDir string")
    there = spark.createDataFrame([("/b.jar",), ("/c.jar",), ("/m",), ("/s.jar",)], "path string")
    entries = spark.createDataFrame([("/b.jar", 0, "org/sample/Box.class", "org.sample.Box"), ("/s.jar", 0, "org/sample/Box.java", "org.sample.Box"), ("/c.jar", 0, "org/sample/Box.class", "org.sample.Box"), ("/m", 0, "org/sample/Box.java", "org.sample.Box")], "archive string, entry_ord int, name string, fqn string")
    listed = search.listing(arts, entries, there)
    assert {(r.coordinates, r.backing, r.source) for r in listed.collect()} == {("g:src:1", "/b.jar", "binary"), ("g:bin:2", "/c.jar", "binary"), ("module:m:x", "/m", "sourceDir")}
    assert {r.backing for r in search.listing(arts, entries, there.filter("path = '/s.jar'")).collect()} == {"/s.jar"}
    files = spark.createDataFrame([("/s.jar", "org/sample/Box.java", JAVA.replace("class Box", "interface Box")), ("/m", "org/sample/Box.java", JAVA)], "archive string, path string, text string")
    found = search.records(arts, files)
    assert {r.coordinates for r in found.collect()} == {"g:src:1", "module:m:x"} and {r.coordinates for r in search.records(arts, files, "module:m:x").collect()} == {"module:m:x"}
    hits = search.find_class(listed, "Box", jvm=True, artifacts=arts, declarations=found).collect()
    assert [(r.coordinates, r.version, r.kind, r.provenance) for r in hits] == [("g:src:1", "1", "interface", "source"), ("g:bin:2", "2", "class", "decompiled"), ("module:m:x", "x", "class", "source")]
    assert search.printed("find-class", search.find_class(listed, "Box")).count() == 3 and json.loads(search.as_json(arts).first().value)["coordinates"] == "g:src:1"


def test_degraded_members(spark):
    files = spark.createDataFrame([("Box.java", JAVA)], "path string, text string")
    found = scan_declarations(files)
    slices, misses = search.read_member(found, files, "org.sample.Box", "#put, #gone, #NAME", degraded="no source available")
    assert [(r.selector, r.first, r.lines) for r in slices.collect()] == [("put(T,List<String>)", 0, ["public void put(T,List<String>)"]), ("put()", 0, ["public void put()"]), ("NAME", 0, ["public static final String NAME"])]
    assert [(r.asked, r.reason) for r in misses.orderBy("selector_ord").collect()] == [("#put", "no source available"), ("#gone", "no matching declaration"), ("#NAME", "no source available")]
    ext = spark.createDataFrame([("F.kt", "FKt", "size", "method", [], "fun String.size()", "kotlin.String", 1, 1, None)], "path string, fqn string, selector string, kind string, params array<string>, signature string, receiver string, line_start int, line_end int, doc_start int")
    assert [r.selector for r in search.read_member(ext, files, "FKt", "#String.size()")[0].collect()] == ["size()"] and search.read_member(ext, files, "FKt", "#List.size")[0].count() == 0
    reasons = spark.createDataFrame([("jdk", None, None, None), ("external", True, None, None), ("external", None, "no-jvm", None), ("external", None, "timeout", "60 s"), ("external", None, None, None)], "k string, n boolean, f string, d string")
    assert [r.r for r in reasons.select(search.degrade_reason(F.col("k"), F.col("n"), F.col("f"), F.col("d")).alias("r")).collect()] == ["jdk: decompilation out of scope"] * 2 + ["no-jvm (decompile unavailable)", "decompile failed: 60 s", "no source available"]
    assert search.signature_text(found, "signatures only (no source available)").filter("fqn = 'org.sample.Box.Lid'").first().content.split("\n") == ["signatures only (no source available)", "static class Lid", "void close()"]
    one = search.answer(spark.range(1), True, F.array(F.lit("a"), F.lit("stale index served"), F.lit(None)), F.array(F.lit("a"), F.lit("b")))
    assert one.first().degraded == ["stale index served", "a", "b"] and one.select(search.warning_lines(F.col("degraded")).alias("w")).first().w == ["warning: stale index served", "warning: +2 more (see: status)"]
    commands = spark.createDataFrame([("find-class",), ("where",)], "name string")
    assert search.unknown_command(commands, "findclass").first().message == "unknown command 'findclass' — did you mean 'find-class'?"
    assert search.line_range("2:5") == (2, 5)
    for bad in ("2", "0:3", "5:2", "a:b"):
        with pytest.raises(ValueError):
            search.line_range(bad)


def test_entries_of_a_class(spark):
    rows = [("a", "org/x/C.java"), ("a", "org/x/C.kt"), ("b", "base/org/x/C.java"), ("c", "m1/org/x/C.java"), ("c", "m2/org/x/C.java"), ("c", "m/org/x/C.kt"), ("d", "org/x/C.kt"), ("e", "zorg/x/C.java")]
    entries = spark.createDataFrame(rows, "coordinates string, name string")
    assert {(r.coordinates, r.name) for r in backings.source_entry(entries, "org.x.C").collect()} == {("a", "org/x/C.java"), ("b", "base/org/x/C.java"), ("d", "org/x/C.kt")}
    paths = ["o/C$D.class", "o/C$D$E.class", "o/C$1.class", "o/CD.class", "o/C.class"]
    assert [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").filter(names.is_direct_nested(F.col("p"), F.lit("o/C"))).collect()] == ["o/C$D.class"]
    decls = spark.createDataFrame([("o.C", "C", "class"), ("o.C", "D", "class"), ("o.C.D", "D", "class"), ("o.C", "E", "class"), ("o.C", "m", "method")], "fqn string, selector string, kind string")
    assert {(r.fqn, r.selector) for r in search.shadowed(decls).collect()} == {("o.C", "C"), ("o.C.D", "D"), ("o.C", "E"), ("o.C", "m")}
    assert {(r.fqn, r.parent) for r in search.with_parents(decls.filter("selector in ('C', 'D')").select("fqn").distinct()).collect()} == {("o.C", None), ("o.C.D", "o.C")}


def test_resolution(spark, tmp_path):
    kind = "coordinates string, binaryJar string"
    none, two = spark.createDataFrame([], kind), spark.createDataFrame([("g:a:1", "/a.jar"), ("jdk:21", "/x.jar")], kind)
    jdks = spark.createDataFrame([("/opt/jdk-21", 'IMPLEMENTOR="x"\nJAVA_VERSION="21"\n'), ("/opt/jdk-8", None), ("/opt/none", None)], "home string, release string")
    there = spark.createDataFrame([("/opt/jdk-21/lib/src.zip",), ("/opt/jdk-8/lib/src.zip",), ("/r/a-1-sources.jar",)], "path string")
    jdk = catalog.jdk_artifact(jdks, there)
    assert {(r.coordinates, r.noDecompile) for r in jdk.collect()} == {("jdk:21", True), ("jdk:jdk-8", True)}
    arts, notes = catalog.resolve([("gradle", none, "timeout"), ("maven", two, None)], none, jdk)
    assert [(r.coordinates, r.binaryJar) for r in arts.collect()][:2] == [("g:a:1", "/a.jar"), ("jdk:21", "/x.jar")] and arts.count() == 3
    assert [(r.system, r.reason) for r in notes.collect()] == [("gradle", "timeout")]
    assert catalog.resolve([], two)[0].count() == 2
    jars = spark.createDataFrame([("g:a:1", "/r/a-1.jar"), ("g:b:1", "/r/b-1.jar")], kind)
    assert {(r.coordinates, r.sourcesJar) for r in catalog.with_sibling_sources(jars, there).collect()} == {("g:a:1", "/r/a-1-sources.jar"), ("g:b:1", None)}
    files = spark.createDataFrame([("pom.xml",), ("app/build.gradle",), ("app/sub/pom.xml",), ("readme",)], "path string")
    assert {r.path for r in files.filter(catalog.is_build_file(F.col("path"))).collect()} == {"pom.xml", "app/build.gradle"}
    assert catalog.build_systems(files).first().systems == ["maven"]
    modules = catalog.module_dirs(spark.createDataFrame([("/p/App",), ("/p/lib",)], "dir string"), spark.createDataFrame([("/p/app/target/classes",)], "path string"))
    assert catalog.partial_note(modules).first().note == "modules failed to resolve: /p/lib"
    lines = spark.createDataFrame([("b", None, None), ("a", 3, 9)], "path string, size long, mtime long")
    assert catalog.fingerprint(lines).first().fingerprint == hashlib.sha256(b"a\t3\t9\nb\t(vanished)").hexdigest()
    for n in ("x-1.jar", "x-1-javadoc.jar", "x-1.pom", ".hidden.jar"):
        (tmp_path / n).write_text("x")
    assert catalog.cached_files(spark, str(tmp_path)).filter(names.is_cached_jar(F.col("path"))).count() == 1
    assert [r.warning for r in catalog.scan_warning(spark, str(tmp_path), None, 2).collect()] == ["cache-scan-truncated:3"] and not catalog.scan_warning(spark, str(tmp_path), None, 4).collect()
