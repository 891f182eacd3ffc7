"""Whole answers about one small project: which backing serves, what is degraded, and what is said on a miss."""

import pytest

from lodeframe.plans import answers

SOURCE = "package p;\nimport java.util.List;\n\n/** Outer. */\npublic class A {\n  private int x;\n  /** Does. */\n  public void m(int a,\n      String b) {\n  }\n  static class In { void n() { } }\n}\n"


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Plans are many and rows few here: compiling each plan would take most of the time."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def project(spark):
    arts = [("g:src:1", 0, "external", None, "/a.jar", "/a-s.jar", None), ("g:lost:1", 1, "external", None, "/gone.jar", None, None), ("g:bin:2", 2, "external", None, "/b.jar", None, None), ("g:bin:3", 3, "external", None, "/c.jar", None, None),
            ("jdk:21", 4, "jdk", True, None, "/src.zip", None), ("module:m", 5, "module", None, None, None, "/m")]
    entries = [("/a.jar", 0, "p/A.class", "p.A"), ("/a-s.jar", 0, "p/A.java", "p.A"), ("/b.jar", 0, "p/A.class", "p.A"), ("/b.jar", 1, "q/B.class", "q.B"), ("/c.jar", 0, "q/C.class", "q.C"), ("/c.jar", 1, "q/D.class", "q.D"), ("/src.zip", 0, "j/S.java", "j.S"), ("/m", 0, "w/Bad.java", "w.Bad")]
    files = [("/a-s.jar", "p/A.java", SOURCE), ("/m", "w/Bad.java", "package w;\nclass Bad {\n int y;\n"), ("/src.zip", "j/S.java", None)]
    compiled = [("/b.jar", "q/B.class", "q.B", "B", "class", "public", False, False, "public class B", None, None, None, None), ("/b.jar", "q/B.class", "q.B", "go", "method", "public", False, False, "public void go(int)", ["int"], None, None, None)]
    compiled += [("/c.jar", f"q/{n}.class", f"q.{n}", n, "class", "public", False, False, f"class {n}", None, None, None, None) for n in "CD"]
    row = "archive string, path string, fqn string, selector string, kind string, visibility string, static boolean, deprecated boolean, signature string, params array<string>, line_start int, line_end int, doc_start int"
    made = spark.createDataFrame(compiled, row).selectExpr("*", "cast(null as string) javadoc", "cast(null as string) receiver")
    tried = [("g:bin:3", "q.C", "package q;\nclass C {\n  int z;\n}\n", None, None), ("g:bin:3", "q.D", None, "timeout", "60 s")]
    return answers.Project(
        spark.createDataFrame(arts, "coordinates string, artifact_rank int, kind string, noDecompile boolean, binaryJar string, sourcesJar string, sourceDir string"), spark.createDataFrame(entries, "archive string, entry_ord int, name string, fqn string"),
        spark.createDataFrame([("/a.jar",), ("/a-s.jar",), ("/b.jar",), ("/c.jar",), ("/src.zip",), ("/m",)], "path string"), spark.createDataFrame(files, "archive string, path string, text string"), made,
        spark.createDataFrame(tried, "coordinates string, fqn string, source string, failure string, detail string"), stale=True, warnings=["degraded-to-cache-scan"],
    )


LOST = "1 artifacts unreadable (g:lost:1)"
ALWAYS = ["stale index served", LOST, "degraded-to-cache-scan"]


def test_outline(project):
    a = answers.outline(project, "p.A").first()
    assert (a.fqn, a.coordinates, a.provenance, a.stale, a.imports, a.alternatives, a.degraded) == ("p.A", "g:src:1", "source", True, ["import java.util.List;"], ["g:bin:2"], ALWAYS)
    assert [(r.selector, r.kind, r.line_start, r.line_end) for r in a.rows] == [("A", "class", 5, 12), ("x", "field", 6, 6), ("m", "method", 8, 10), ("In", "class", 11, 11), ("n", "method", 11, 11)]
    small = answers.outline(project, "p$A", "minimal", visibility="public").first()
    assert small.imports is None and [r.selector for r in small.rows] == ["A", "m"]
    bad = answers.outline(project, "w.Bad").first()
    assert bad.coordinates == "module:m" and "1 entries failed to parse" in bad.degraded and [r.selector for r in bad.rows] == ["Bad", "y"]
    with pytest.raises(LookupError):
        answers.outline(project, "p.Gone")


def test_read_member(project):
    a = answers.read_member(project, "p.A", "#m(int,String), #gone").first()
    assert [(m.selector, m.lines, m.first, m.last, m.javadoc) for m in a.members] == [("m(int,String)", ["  /** Does. */", "  public void m(int a,", "      String b) {", "  }"], 7, 10, ["  /** Does. */"])]
    assert [(m.selector, m.reason) for m in a.misses] == [("#gone", "no matching declaration")] and a.provenance == "source" and a.alternatives == ["g:bin:2"]
    b = answers.read_member(project, "q.B", "#go").first()
    assert b.provenance == "signature" and b.members[0].lines == ["public void go(int)"] and [(m.selector, m.reason) for m in b.misses] == [("#go", "no source available")]
    c = answers.read_member(project, "q.C", "#z").first()
    assert c.provenance == "decompiled" and c.members[0].lines == ["  int z;"] and not c.misses
    assert answers.read_member(project, "q.D", "#D").first().misses[0].reason == "decompile failed: 60 s"
    with pytest.raises(ValueError):
        answers.read_member(project, "p.A", "m")


def test_read_source(project):
    a = answers.read_source(project, "p.A").first()
    assert (a.mode, a.file, a.content, a.line_count, a.provenance) == ("full", "p/A.java", SOURCE, 12, "source") and a.degraded == ALWAYS
    part = answers.read_source(project, "p.A", "lines", 11, 40).first()
    assert (part.lines, part.first, part.last, part.clamped) == (["  static class In { void n() { } }", "}"], 11, 12, True)
    assert answers.read_source(project, "p.A", "outline").first().rows[0].selector == "A"
    b = answers.read_source(project, "q.B").first()
    assert b.content == "signatures only (no source available)\npublic class B\npublic void go(int)" or b.content.split("\n")[0] == "signatures only (no source available)"
    assert answers.read_source(project, "q.C").first().file == "q/C.java (decompiled)"
    assert answers.read_source(project, "q.D").first().content.startswith("signatures only (decompilation failed: timeout: 60 s)\nclass D")
    jdk = answers.read_source(project, "j.S").first()
    assert jdk.content.startswith(answers.JDK_NOTE) and jdk.provenance == "signature"
    with pytest.raises(ValueError):
        answers.read_source(project, "p.A", "lines")


def test_searches_and_misses(project):
    hits, notes = answers.find_class(project, "A")
    assert [(r.coordinates, r.fqn, r.provenance) for r in hits.collect()][:2] == [("g:src:1", "p.A", "source"), ("g:bin:2", "p.A", "signature")] and notes == ALWAYS
    rows, notes = answers.search_symbols(project, "src", "m")
    assert [r.selector for r in rows.collect()] == ["m"] and notes == ["stale index served", "degraded-to-cache-scan"]
    rows, notes = answers.search_symbols(project, "bi", "m")
    assert rows.count() == 0 and notes == ['unknown artifact "bi" — closest: bin, bin']
    rows, notes = answers.search_symbols(project, "module:m", "y")
    assert [r.selector for r in rows.collect()] == ["y"] and notes[1].startswith("1 entries failed to parse (unbalanced braces at line 2")
    assert answers.search_symbols(project, "g:lost:1", "m")[1] == ["g:lost:1 parsed to no declarations"]
    hits, told = answers.miss(project, "else.where.A")
    assert told.first().found and told.first().via == "fuzzy-candidates" and hits.first().fqn == "p.A"
    _, told = answers.miss(project, "else.where.Zzzq")
    one = told.first()
    assert not one.found and one.searched == ["g:src:1", "g:lost:1", "g:bin:2", "g:bin:3", "jdk:21", "module:m", answers.CACHE_NOTE] and one.degraded == ["degraded-to-cache-scan"]


def test_read_resource(spark, project, tmp_path):
    import dataclasses
    import zipfile

    jar = str(tmp_path / "a.jar")
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("conf/a.properties", "k=v\n")
        z.writestr("x.png", b"\x89PNG")
    arts = spark.createDataFrame([("g:a:1", 0, jar, "/s.jar", None)], "coordinates string, artifact_rank int, binaryJar string, sourcesJar string, sourceDir string")
    own = dataclasses.replace(project, artifacts=arts, readable=spark.createDataFrame([(jar,)], "path string"), stale=False)
    listing = spark.createDataFrame([(jar, 0, "conf/a.properties", 4, False), (jar, 1, "x.png", 4, False), ("/other.jar", 0, "conf/a.properties", 4, False)], "archive string, entry_ord int, name string, usize long, is_dir boolean")
    rows, told = answers.read_resource(own, "a", "**/a.properties", listing)
    assert [(r.name, r.text) for r in rows.collect()] == [("conf/a.properties", "k=v\n")] and (told.first().artifact, told.first().provenance, told.first().stale) == ("g:a:1", "source", False)
    with pytest.raises(LookupError):
        answers.read_resource(dataclasses.replace(own, readable=spark.createDataFrame([], "path string")), "a", "*", listing)
