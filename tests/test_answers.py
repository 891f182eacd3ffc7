"""Backings, skeletons, selector tables, prefix joins, budgets and many searches at once, against plain versions."""

import itertools
import os
import random
import time
from collections import Counter

from lodeframe.functions import selectors as S
from lodeframe.operators import forest, prefixes, rank
from lodeframe.operators.declarations import scan_declarations
from lodeframe.operators.order import numbered
from lodeframe.plans import backings, search, skeleton
from lodeframe.sources import catalog
from pyspark.sql import functions as F

ENTRY = "archive string, entry_ord int, name string, fqn string"


def archive_hit(names, path):
    for e in (".java", ".kt"):
        if path + e in names:
            return path + e
        ends = [n for n in names if n.endswith("/" + path + e)]
        if ends:
            return ends[0] if len(ends) == 1 else None
    return None


def test_entries_of_every_mixture(spark):
    """All sets of up to four entries: exact and relocated ones of both extensions, and others."""
    pool = ["o/x/C.java", "o/x/C.kt", "m/o/x/C.java", "n/o/x/C.java", "m/o/x/C.kt", "n/o/x/C.kt", "zo/x/C.java", "o/x/C.javax"]
    grid = [c for n in range(5) for c in itertools.combinations(pool, n)]
    rows = [(str(k), name) for k, names in enumerate(grid) for name in names]
    got = {r.coordinates: r.name for r in backings.source_entry(spark.createDataFrame(rows, "coordinates string, name string"), "o.x.C").collect()}
    assert got == {str(k): hit for k, names in enumerate(grid) if (hit := archive_hit(names, "o/x/C"))}


def test_backings_of_every_mixture(spark):
    """Each artifact has some of three backings, each readable or not, with or without the class."""
    arts, entries, readable, want = [], [], [], {}
    for k, states in enumerate(itertools.product(("none", "lost", "empty", "holds"), repeat=3)):
        names = [f"{k}/{slot}" for slot in ("b", "s", "d")]
        arts.append((f"g:a:{k}", k, *[n if s != "none" else None for n, s in zip(names, states, strict=True)]))
        readable += [(n,) for n, s in zip(names, states, strict=True) if s in ("empty", "holds")]
        for n, s, file in zip(names, states, ("o/x/C.class", "m/o/x/C.kt", "o/x/C.java"), strict=True):
            entries += [(n, 1, file, "o.x.C")] * (s == "holds") + [(n, 2, "o/x/Other.class", "o.x.Other")] * (s == "empty")
        binary, sources, folder = (s == "holds" for s in states)
        listed = next((slot for slot, s in zip(("binary", "sources", "sourceDir"), states, strict=True) if s in ("empty", "holds")), None)
        declares = {"binary": binary, "sources": sources, "sourceDir": folder}.get(listed, False)
        slot = "sourceDir" if folder else "sources" if sources else "binary" if binary else None
        want[f"g:a:{k}"] = (listed, declares, slot)
    arts = spark.createDataFrame(arts, "coordinates string, artifact_rank int, binaryJar string, sourcesJar string, sourceDir string")
    entries, readable = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(readable, "path string")
    rows = backings.hits_by_artifact(arts, entries, readable, "o.x.C").collect()
    assert {r.coordinates: (r.listed, r.declares, r.slot) for r in rows} == want
    one = backings.locate(arts, entries, readable, "o.x.C").collect()
    hits = [c for c, (_, _, slot) in want.items() if slot]
    later = [c for c, (_, declares, _) in want.items() if declares and int(c[4:]) > int(hits[0][4:])]
    lost = [c for c, (listed, _, _) in want.items() if listed is None]
    assert [(r.coordinates, r.alternatives, r.degraded) for r in one] == [(hits[0], later, [f"{len(lost)} artifacts unreadable ({', '.join(lost[:3])})"])]
    assert backings.locate(arts, entries, readable, "o.x.Gone").collect() == []
    assert backings.locate(arts, entries, readable, "o$x$C").count() == 1


def test_paths_of_forests(spark):
    rnd = random.Random(4)
    parents = {(t, n): rnd.choice([None, *range(n)]) if n % 9 else n + 10_000 for t in range(3) for n in range(60)}
    nodes = spark.createDataFrame([(t, n, p) for (t, n), p in parents.items()], "t int, n int, p int")

    def path(t, n):
        up = parents[t, n]
        return [*path(t, up), n] if up is not None and (t, up) in parents else [n]

    assert {(r.t, r.n): r.path for r in forest.paths(nodes, "t", "n", "p", 60).collect()} == {k: path(*k) for k in parents}


def plain_skeleton(target, rows, full):
    """Lines of the types and members, by a walk over nodes."""
    root, nodes, top = None, {}, []
    for r in rows:
        if r.kind in ("method", "field", "constructor", "enum-constant", "property"):
            nodes.get(r.fqn, top).append(r)
        elif r.fqn == target:
            root = root or r
        else:
            own = [r]
            nodes.get(r.fqn.rpartition(".")[0], top).append(own)
            nodes[r.fqn] = own

    out = []

    def doc(r, level):
        if r.javadoc and not full:
            out.append("    " * level + "/** " + " ".join(r.javadoc.replace("*", " ").replace("/", " ").split()).split(".")[0] + ". */")
        elif r.javadoc:
            out.extend("    " * level + (" " if x.lstrip().startswith("*") else "") + x.lstrip() for x in r.javadoc.split("\n"))

    def show(item, level):
        if isinstance(item, list):
            doc(item[0], level)
            out.append("    " * level + item[0].signature + " {")
            for x in item[1:]:
                show(x, level + 1)
            out.append("    " * level + "}")
        else:
            doc(item, level)
            out.append("    " * level + item.signature + (" { … }" if full and item.kind in ("method", "constructor") else ";"))

    for x in [[root, *top]] if root else top:
        show(x, 0)
    return out


def test_skeletons(spark):
    source = "package p;\nimport java.util.List;\n// import no.No;\nimport static a.B.*;\n/** Outer. More. */\npublic class A {\n  int x;\n  /**\n   * Does.\n   */\n  void m(int a) { }\n  static class In { int y; enum E { U, V } void n() { } }\n  class Two { }\n  A() { }\n}\nclass Free { int z; }"
    files = spark.createDataFrame([("A.java", source)], "path string, text string")
    found = scan_declarations(files).collect()
    rows = sorted(found, key=lambda r: (r.line_start, r.fqn.count("."), r.kind != "class", r.selector))
    cases = {"p.A": [r for r in rows if r.fqn.startswith("p.A")], "p.A.In": [r for r in rows if r.fqn.startswith("p.A.In")], "p.Gone": [r for r in rows if r.fqn.startswith("p.A.")], "Free": []}
    columns = "target string, ord int, fqn string, kind string, signature string, javadoc string"
    outlined = spark.createDataFrame([(t, k, r.fqn, r.kind, r.signature, r.javadoc) for t, own in cases.items() for k, r in enumerate(own)], columns)
    lines = [r.imports for r in search.imports(files).collect()]
    assert lines == [["import java.util.List;", "import static a.B.*;"]]
    heads = spark.createDataFrame([(t, "g:a:1", "source", t == "p.A", lines[0] if t == "p.A" else None) for t in cases], "target string, coordinates string, provenance string, stale boolean, imports array<string>")
    for full in (False, True):
        got = {}
        for r in skeleton.skeleton(outlined, heads, full).orderBy("target", "n").collect():
            got.setdefault(r.target, []).append(r.line)
        assert got["p.A"][:7] == ["// p.A", "// g:a:1  provenance source", "// stale index served", "", "package p;", "import java.util.List;", "import static a.B.*;"]
        for t, head in (("p.A", 8), ("p.A.In", 5), ("p.Gone", 5), ("Free", 3)):
            assert got[t][head:] == plain_skeleton(t, cases[t], full), t
    assert "        enum E {" in got["p.A"] and "            U;" in got["p.A"]


def test_many_selectors_in_one_join(spark):
    rnd = random.Random(8)
    types = ["int", "String", "java.util.List<String>", "Map.Entry", "T?"]
    decls = [(f"f{k % 3}", f"p.C{k % 20}", f"m{k % 7}", [rnd.choice(types) for _ in range(k % 3)] if k % 5 else None, f"sig {k}", k % 40 + 1, k % 40 + 1, None, rnd.choice((None, "kotlin.List"))) for k in range(400)]
    declared = spark.createDataFrame(decls, "path string, fqn string, selector string, params array<string>, signature string, line_start int, line_end int, doc_start int, receiver string")
    files = spark.createDataFrame([(f"f{k}", "\n".join(f"line {n}" for n in range(1, 60))) for k in range(3)], "path string, text string")
    shapes = ["#m{}", "#m{}()", "#m{}(String)", "#m{}(int,List<String>)", "#m{}(*)", "#m{}(*,String)", "#List.m{}", "#gone{}", "#m{}(String, java.util.Map.Entry)"]
    asks = [(k, f"p.C{rnd.randrange(25)}", ", ".join(rnd.choice(shapes).format(rnd.randrange(8)) for _ in range(rnd.randint(1, 3))), None) for k in range(300)] + [(900, "p.C1", "#m1, m2", None), (901, "p$C1", "#m1", "no source available")]
    slices, misses = search.read_members(declared, files, spark.createDataFrame(asks, "ask int, fqn string, selectors string, degraded string"))
    plain = lambda t: "".join(t.replace("?", "").replace("...", "").split())
    hits, missed = set(), set()
    for ask, fqn, text, degraded in asks:
        try:
            parsed = S.parse_list(text)
        except ValueError:
            missed |= {(ask, k, "malformed selector 'm2'") for k in range(2)}
            continue
        for k, s in enumerate(parsed):
            own = [d for d in decls if d[1] == fqn.replace("$", ".") and d[2] == s.name and (not s.receiver or (d[8] or "").endswith(s.receiver))]
            if s.params is not None and s.params != ("*",):
                same = lambda a, b: b == "*" or plain(a).rpartition(".")[2] == plain(b).rpartition(".")[2]
                own = [d for d in own if d[3] is not None and len(d[3]) == len(s.params) and all(map(same, d[3], s.params))]
            hits |= {(ask, k, d[4], f"line {d[5]}" if not degraded else d[4]) for d in own}
            if not own or degraded:
                missed.add((ask, k, "no matching declaration" if not own else degraded))
    assert {(r.ask, r.selector_ord, r.signature, r.lines[0]) for r in slices.collect()} == hits
    assert {(r.ask, r.selector_ord, r.reason) for r in misses.collect()} == missed and len(hits) > 100
    counted = search.count_members(declared, spark.createDataFrame([*asks, asks[0], (902, None, "#m1", None), (903, "p.C1", None, None)], "ask int, fqn string, selectors string, degraded string"))
    number = Counter(h[0] for h in hits)
    assert sorted((r.ask, r.hits) for r in counted.collect()) == sorted([(a, number[a]) for a, *_ in asks] + [(0, number[0]), (902, 0), (903, 0)])


def test_members_are_counted_without_pairs(spark):
    """Alike asks by alike members are 2.5 billion pairs, none of which is a row."""
    asks = spark.range(50_000).select("id", F.lit("p.C").alias("fqn"), F.lit("#m").alias("selectors"))
    declared = spark.range(50_000).select(F.lit("p.C").alias("fqn"), F.lit("m").alias("selector"), F.lit(None).cast("array<string>").alias("params"))
    began = time.perf_counter()
    assert [tuple(r) for r in search.count_members(declared, asks).groupBy("hits").count().collect()] == [(50_000, 50_000)]
    assert time.perf_counter() - began < 60


def test_prefix_join(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("ab/é") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    heads = ["".join(rnd.choice("ab/é") for _ in range(rnd.randint(0, 4))) for _ in range(80)]
    rows, table = spark.createDataFrame([*enumerate(words), (999, None)], "k int, w string"), spark.createDataFrame([*enumerate(heads), (999, None)], "h int, p string")
    joined = prefixes.prefix_join(rows, "w", table, "p")
    assert sorted((r.k, r.h) for r in joined.collect()) == sorted((k, h) for k, w in enumerate(words) for h, p in enumerate(heads) if w.startswith(p))
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()


def test_many_searches_equal_one_by_one(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    asked = ["red", "BlueBolt", "al tin", "zzz", "", "e", "ring 1", "éa", "rr"]
    queries = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {}
    for r in rank.search_many(part, "p_name", queries, "q", ["p_partkey"], 5).collect():
        got.setdefault(r.q, []).append((r.rn, r.p_partkey, r.score))
    for q in asked:
        one = part.withColumn("score", rank.fuzzy_score(F.lit(q), F.col("p_name"))).filter("score is not null").orderBy(F.desc("score"), "p_partkey").limit(5).collect()
        assert sorted(got.get(q, [])) == [(k, r.p_partkey, r.score) for k, r in enumerate(one, 1)], q


def test_many_searches_broadcast_no_names(spark, sf_dir):
    """However small the file is: of names only one row of counts is broadcast, and names lie under no letter that is not asked for."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    found = rank.search_many(part, "p_name", spark.createDataFrame([("red",), ("ring",)], "q string"), "q", ["p_partkey"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_letter" in plan and "BroadcastHashJoin" not in plan
    assert found.count() > 0


def test_numbered_and_budget(spark, tmp_path):
    rows = spark.createDataFrame([((k * 37) % 500, k % 3) for k in range(500)], "a int, b int").repartition(7)
    assert [r.a for r in numbered(rows, ["a"]).orderBy("place").collect()] == list(range(500))
    for f in ["b/lib/1/lib-1.jar", "b/lib/1/lib-1.pom", "b/lib/1/lib-1-sources.jar", "b/z.txt", "a/lib/2/lib-2.jar", "ab/lib/1/lib-1.jar", "top.txt", "b/lib/0.9/lib-0.9.jar"]:
        os.makedirs((tmp_path / "m2" / f).parent, exist_ok=True)
        (tmp_path / "m2" / f).write_text("x")
    for f in ["c.d/lib/3/0aF/lib-3.jar", "c.d/lib/3/xyz/lib-3.jar", "b/lib/1/00/lib-1.jar"]:
        os.makedirs((tmp_path / "g" / f).parent, exist_ok=True)
        (tmp_path / "g" / f).write_text("x")
    m2, g = str(tmp_path / "m2"), str(tmp_path / "g")
    walk = []
    for root in (m2, g):
        stack = [root]
        while stack:
            here = stack.pop()
            for e in sorted(os.scandir(here), key=lambda e: e.name):
                stack.append(e.path) if e.is_dir() else walk.append(e.path) if not e.name.endswith(".crc") else None
    placed = catalog.visited_files(spark, m2, g).orderBy("place").collect()
    assert ["/" + r.path.split(":", 1)[1].lstrip("/") for r in placed] == walk
    for budget in range(len(walk) + 1):
        got = {(r.coordinates, r.binaryJar and r.binaryJar.split("/")[-1], r.sourcesJar is not None) for r in catalog.scan_caches(spark, m2, g, budget).collect()} if budget in (2, 4, 6, 9, len(walk)) else None
        seen = {w.removeprefix(m2) for w in walk[:budget] if w.startswith(m2)}
        if got is not None:
            assert ("b:lib:1" in {c for c, _, _ in got}) == ("/b/lib/1/lib-1.jar" in seen or "/b/lib/1/lib-1-sources.jar" in seen or budget == len(walk)), budget
    assert {r.coordinates for r in catalog.scan_caches(spark, m2, g).collect()} == {"b:lib:1", "a:lib:2", "ab:lib:1", "c.d:lib:3"}
    assert [r.warning for r in catalog.scan_warning(spark, m2, g, 5).collect()] == ["cache-scan-truncated:6"]


def test_modules(spark):
    files = ["pom.xml", "app/pom.xml", "app/core/pom.xml", "app/core/deep/pom.xml", "app/core/deep/more/pom.xml", ".git/pom.xml", "lib/.x/pom.xml", "lib/readme", "Web/pom.xml"]
    found = catalog.find_modules(spark.createDataFrame([(f,) for f in files], "path string"))
    assert {r.dir for r in found.collect()} == {"app", "app/core", "app/core/deep", "Web"}
    under = found.select(F.concat(F.lit("/p/"), "dir").alias("dir"))
    outputs = spark.createDataFrame([("/p/app/target/classes/",), ("\\p\\WEB\\target\\classes",), ("/r/x.jar",)], "path string")
    paired = catalog.module_dirs(under, outputs)
    made = {r.coordinates.rsplit(":", 1)[-1]: r.sourceDir for r in catalog.reactor_artifacts(paired, "/p", "/p").collect()}
    assert made == {"app": "/p/app", "Web": "/p/Web"}
    assert catalog.partial_note(paired).first().note == "modules failed to resolve: /p/app/core, /p/app/core/deep"


def test_records_with_problems(spark):
    arts = spark.createDataFrame([("g:a:1", 0, "/a.jar", "/a-s.jar", None), ("g:b:1", 1, "/b.jar", None, None), ("g:c:1", 2, None, None, "/c")], "coordinates string, artifact_rank int, binaryJar string, sourcesJar string, sourceDir string")
    files = [("/a-s.jar", f"F{k}.java", "class F%d {" % k if k % 2 else "class F%d { int x; }" % k, None) for k in range(9)] + [("/a-s.jar", "A.java", None, "entry damaged"), ("/c", "C.java", "class C { }", None)]
    found, notes = search.artifact_records(arts, spark.createDataFrame(files, "archive string, path string, text string, error string"))
    got = {r.coordinates: (r.provenance, r.failed, r.unreadable) for r in notes.collect()}
    assert got["g:b:1"] == ("signature", 0, None) and got["g:c:1"] == ("source", 0, None)
    assert got["g:a:1"][:2] == ("source", 5) and got["g:a:1"][2].startswith("5 entries failed to parse (entry damaged, unbalanced braces at line 1")
    assert {r.fqn for r in found.collect()} == {f"F{k}" for k in range(9)} | {"C"}
