"""Declarations of made-up sources against tables of what they declare."""

import time

import pytest

from lodeframe.functions.brackets import cut_top_level, in_parentheses, split_top_level
from lodeframe.operators.declarations import scan_declarations, scan_problems
from lodeframe.operators.statements import DOC, statements
from pyspark.sql import functions as F

JAVA = '''// class Fake0 { }
package a.b; /* class Fake1 { int x; } */

/** Keeps things; has { braces }. */
@Entity(name = "x { y", value = {A.class, B.class})
public abstract class Store<K extends Comparable<K>, V>
        extends Base<K>
        implements Map<K, V> {

    static final Map<String, List<Integer>> TABLE = new HashMap<String, List<Integer>>(), OTHER;
    int x, y = call(1, 2), z[] = {1, 2},
        w;
    String block = """
        class Fake2 { int inside; }
        // " quoted \\""" still inside
        """;
    char c = '{', d = '\\'';
    Outer<V>.Inner nested;

    /** Makes one. */
    protected Store(final K key, @Named("a,b(") V value)
            throws java.io.IOException {
        class Local { void no() { } }
        Runnable r = new Runnable() { public void run() { } };
    }

    /** Old. */
    /**
     * Finds.
     * @deprecated for find
     */
    public <T extends V> Map<K, List<T>>
        find(Map<K, List<T>> where, final int[] from, String... more) {
        return where; }

    abstract void swap(int a[], Map.Entry<K, ? extends V> e);

    static { int no = 1; }

    Runnable lazy = () -> { int alsoNo = 2; };

    enum Colour implements Named {
        /** Warm. */
        RED,
        @Deprecated GREEN(1, "a, b") { int hidden() { return 1; } },
        BLUE;

        private final int n = 0;
        Colour(int... n) { }
    }

    @interface Mark { String value() default ""; int[] sizes() default {}; }

    record Point(int x, List<String> names) {
        static int made;
        public Point { }
    }

    interface Shape { double area(); class Unit { } int SIDES = 3; }
}
'''
#: fqn, selector, kind, signature, first and last line, line of the comment.
JAVA_ROWS = [
    ("a.b.Store", "Store", "class", "public abstract class Store<K extends Comparable<K>,V>", 5, 60, 4),
    ("a.b.Store", "TABLE", "field", "static final Map<String,List<Integer>> TABLE", 10, 10, None),
    ("a.b.Store", "OTHER", "field", "static final Map<String,List<Integer>> OTHER", 10, 10, None),
    ("a.b.Store", "x", "field", "int x", 11, 11, None), ("a.b.Store", "y", "field", "int y", 11, 11, None), ("a.b.Store", "z", "field", "int z[]", 11, 11, None), ("a.b.Store", "w", "field", "int w", 12, 12, None),
    ("a.b.Store", "block", "field", "String block", 13, 16, None), ("a.b.Store", "c", "field", "char c", 17, 17, None), ("a.b.Store", "d", "field", "char d", 17, 17, None),
    ("a.b.Store", "nested", "field", "Outer<V>.Inner nested", 18, 18, None), ("a.b.Store", "Store", "constructor", "protected Store(K,V)", 21, 25, 20),
    ("a.b.Store", "find", "method", "public <T extends V> Map<K,List<T>> find(Map<K,List<T>>,int[],String...)", 32, 34, 28), ("a.b.Store", "swap", "method", "abstract void swap(int[],Map.Entry<K,? extends V>)", 36, 36, None),
    ("a.b.Store", "lazy", "field", "Runnable lazy", 40, 40, None), ("a.b.Store.Colour", "Colour", "enum", "enum Colour", 42, 50, None),
    ("a.b.Store.Colour", "RED", "enum-constant", "RED", 44, 44, 43), ("a.b.Store.Colour", "GREEN", "enum-constant", "GREEN", 45, 45, None), ("a.b.Store.Colour", "BLUE", "enum-constant", "BLUE", 46, 46, None),
    ("a.b.Store.Colour", "n", "field", "private final int n", 48, 48, None), ("a.b.Store.Colour", "Colour", "constructor", "Colour(int...)", 49, 49, None),
    ("a.b.Store.Mark", "Mark", "annotation", "@interface Mark", 52, 52, None), ("a.b.Store.Mark", "value", "method", "String value()", 52, 52, None), ("a.b.Store.Mark", "sizes", "method", "int[] sizes()", 52, 52, None),
    ("a.b.Store.Point", "Point", "record", "record Point(int,List<String>)", 54, 57, None), ("a.b.Store.Point", "made", "field", "static int made", 55, 55, None), ("a.b.Store.Point", "Point", "constructor", "public Point(int,List<String>)", 56, 56, None),
    ("a.b.Store.Shape", "Shape", "interface", "interface Shape", 59, 59, None), ("a.b.Store.Shape", "area", "method", "double area()", 59, 59, None), ("a.b.Store.Shape", "SIDES", "field", "int SIDES", 59, 59, None),
    ("a.b.Store.Shape.Unit", "Unit", "class", "class Unit", 59, 59, None),
]

KOTLIN = '''@file:JvmName("Other")
package k.`in`

import a.b.C as D

/** Says it. */
fun <T : Any> List<T>.say(
    word: String = "a, b)",
    block: (Int, T) -> Unit = { a, b -> println(a) },
): Map<String, T>? =
    emptyMap()

val limit: Int get() = 1
var names = listOf("x")
    .map { it }
private val raw = """
    class Fake { fun no() { } }
"""

data class User(val name: String, private var age: Int = 3, note: String) : Base(), Named {
    constructor(id: Long) : this(id.toString())
    init { println("x") }
    var tag: String = "?"
        get() = field
        private set(value) { field = value }

    companion object {
        const val MAX = 3
    }

    inner class Part<out E>

    override suspend fun `load all`(vararg ids: Long): Result<User> { return x }
}

enum class Level(val n: Int) { LOW(1), HIGH(2) { override fun f() = 1 };
    open fun f() = 0
}

fun interface Printer { fun print(s: String) }
annotation class Fancy
object Single : Runnable {
    override fun run() {}
}
sealed interface Tree
class Solo private constructor(x: Int)
'''
KOTLIN_ROWS = [
    ("k.in.CodeKt", "CodeKt", "class", "class CodeKt", 7, 18, None),
    ("k.in.CodeKt", "say", "method", "fun <T : Any> List<T>.say(String, (Int, T) -> Unit): Map<String, T>?", 7, 11, 6), ("k.in.CodeKt", "limit", "property", "val limit: Int", 13, 13, None),
    ("k.in.CodeKt", "names", "property", "var names", 14, 15, None), ("k.in.CodeKt", "raw", "property", "private val raw", 16, 18, None),
    ("k.in.User", "User", "class", "data class User(String,Int,String)", 20, 34, None), ("k.in.User", "name", "property", "val name: String", 20, 20, None), ("k.in.User", "age", "property", "private var age: Int", 20, 20, None),
    ("k.in.User", "User", "constructor", "constructor(Long)", 21, 21, None), ("k.in.User", "User", "constructor", "init", 22, 22, None), ("k.in.User", "tag", "property", "var tag: String", 23, 25, None),
    ("k.in.User.Companion", "Companion", "object", "companion object", 27, 29, None), ("k.in.User.Companion", "MAX", "property", "const val MAX", 28, 28, None), ("k.in.User.Part", "Part", "class", "inner class Part<out E>", 31, 31, None),
    ("k.in.User", "load all", "method", "override suspend fun load all(vararg Long): Result<User>", 33, 33, None),
    ("k.in.Level", "Level", "enum", "enum class Level(Int)", 36, 38, None), ("k.in.Level", "n", "property", "val n: Int", 36, 36, None), ("k.in.Level", "LOW", "enum-constant", "LOW", 36, 36, None), ("k.in.Level", "HIGH", "enum-constant", "HIGH", 36, 36, None),
    ("k.in.Level", "f", "method", "open fun f()", 37, 37, None), ("k.in.Printer", "Printer", "interface", "fun interface Printer", 40, 40, None), ("k.in.Printer", "print", "method", "fun print(String)", 40, 40, None),
    ("k.in.Fancy", "Fancy", "annotation", "annotation class Fancy", 41, 41, None), ("k.in.Single", "Single", "object", "object Single", 42, 44, None), ("k.in.Single", "run", "method", "override fun run()", 43, 43, None),
    ("k.in.Tree", "Tree", "interface", "sealed interface Tree", 45, 45, None), ("k.in.Solo", "Solo", "class", "class Solo(Int)", 46, 46, None),
]


def scanned(spark, *files):
    return scan_declarations(spark.createDataFrame(list(files), "path string, text string")).collect()


def key(r):
    return r.fqn, r.selector, r.kind, r.signature, r.line_start, r.line_end, r.doc_start


def in_order(rows):
    return sorted(rows, key=lambda r: [str(x) for x in r])


@pytest.fixture(scope="module")
def found(spark):
    return scanned(spark, ("src/a/b/Store.java", JAVA), ("Win.java", JAVA.replace("\n", "\r\n")), ("src/Code.kt", KOTLIN))


def test_java(found):
    for path in ("src/a/b/Store.java", "Win.java"):
        assert in_order(key(r) for r in found if r.path == path) == in_order(JAVA_ROWS)


def test_kotlin(found):
    assert in_order(key(r) for r in found if r.path == "src/Code.kt") == in_order(KOTLIN_ROWS)


def test_flags(found):
    java = {(r.fqn, r.selector, r.kind): r for r in found if r.path == "src/a/b/Store.java"}
    assert {k[1] for k, r in java.items() if r.deprecated} == {"find", "GREEN"}
    assert {k[1] for k, r in java.items() if r.static} == {"TABLE", "OTHER", "RED", "GREEN", "BLUE", "made", "Unit"}
    assert {k[1] for k, r in java.items() if r.visibility == "protected"} == {"Store"} and java["a.b.Store.Colour", "RED", "enum-constant"].visibility == "public"
    assert java["a.b.Store", "find", "method"].javadoc.startswith("/**\n     * Finds.") and java["a.b.Store", "swap", "method"].params == ["int[]", "Map.Entry<K,? extends V>"]
    kotlin = {(r.fqn, r.selector): r for r in found if r.path == "src/Code.kt"}
    assert kotlin["k.in.CodeKt", "say"].receiver == "List<T>" and kotlin["k.in.CodeKt", "say"].params == ["String", "(Int, T) -> Unit"]
    assert {k[1] for k, r in kotlin.items() if r.static} == {"say", "limit", "names", "raw", "Companion", "MAX", "LOW", "HIGH", "run"}
    assert {k[1] for k, r in kotlin.items() if r.visibility == "private"} == {"raw", "age"}


def test_odd_files(spark):
    """None fails, and what stands before the damage is found."""
    files = [("a.java", None), ("b.java", ""), ("c.java", "class A { void m() { }\n int x = (1;\n int lost; }"), ("d.java", "class A { String s = \"open\n; int after; }"), ("e.java", "class A { int x; } } class B { }"),
             ("f.java", "/* never closed class A { }"), ("g.java", "class A { String s = \"\"\"never closed; int no; }"), ("h.java", "{}{}}}((]]@@'`\"\\"), ("i.kt", "class A {\n fun f() = \"open\n val x = 1\n}"), ("j.kt", "fun"),
             ("k.java", "package p; import x.Y;\nint stray;\nclass " + "A" * 5000 + " { }")]
    rows = scanned(spark, *files)
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append(r.selector)
    assert sorted(got["c.java"]) == ["A", "m", "x"] and sorted(got["d.java"]) == ["A", "after", "s"] and sorted(got["e.java"]) == ["A", "B", "x"]
    assert sorted(got["i.kt"]) == ["A", "f", "x"] and got["k.java"] == ["A" * 5000] and not {"a.java", "b.java", "f.java", "h.java"} & got.keys()
    assert all(r.line_start <= r.line_end for r in rows)


def test_problems(spark):
    files = [("a.java", "class A {\n void m() {\n}\n"), ("b.java", "class A { } }"), ("c.java", JAVA), ("d.kt", KOTLIN), ("e.java", "")]
    rows = {r.path: r.problem for r in scan_problems(spark.createDataFrame(files, "path string, text string")).collect()}
    assert set(rows) == {"a.java", "b.java"} and "never closed" in rows["a.java"] and "nothing is open" in rows["b.java"]


def test_one_shuffle_by_file(spark):
    df = statements(spark.createDataFrame([("a.java", JAVA)], "path string, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and "Exchange" not in plan.replace("Exchange hashpartitioning(path", "")


def test_brackets(spark):
    texts = ["Map<String, List<X>> a, int b", "", "a", "f(1, 2), (x -> y, z), c[1, 2]", "a < b, c", ","]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    parts = {r.k: r.p for r in df.select("k", split_top_level(F.col("t")).alias("p")).collect()}
    assert parts[0] == ["Map<String, List<X>> a", " int b"] and parts[1] == [""] and parts[2] == ["a"] and len(parts[3]) == 3 and parts[4] == ["a < b", " c"] and parts[5] == ["", ""]
    inner = df.select(in_parentheses(F.lit("f(a(b), c) throws X(1)")).alias("i"), in_parentheses(F.lit("none")).alias("n")).first()
    assert tuple(inner.i) == ("a(b), c", " throws X(1)") and inner.n is None


def test_parts_are_cut_alike(spark):
    """One pass over a text and the fold give the same parts; a part knows what stands before it."""
    texts = ["", ",", "a", "a < b, c", "f(1, 2), (x -> y, z), c[1, 2]", "a), b(c, d", ")),(,),", "x >= 1, y<z, w>,v", f"{DOC}\n a,\n\n{DOC} b{DOC}(\n,), \u00e9\U0001F600,c"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", split_top_level(F.col("t")).alias("p"), cut_top_level(F.col("t"), DOC).alias("c"))
    rows = df.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.c is None) == (r.p is None) == (r.t is None)
        for k, c in enumerate(r.c or []):
            earlier = ",".join(r.p[:k])
            assert tuple(c) == (r.p[k], earlier.count("\n"), earlier.count(DOC)) and len(r.c) == len(r.p)
    held = spark.createDataFrame([(")(a)b",), ("((",), ("a)b(c)d(e)",), ("\u00e9\U0001F600(\u00e8)\U0001F600x",), ("()",), ("f(a(b)",)], "t string").select(in_parentheses(F.col("t")).alias("i")).collect()
    assert [tuple(r.i) for r in held] == [("", ""), ("(", ""), ("", ""), ("\u00e8", "\U0001F600x"), ("", ""), ("a(b)", "")]


def test_statement_of_many_parts(spark):
    """Work grows with a statement's parts, not with their square: a list of 40,000 constants with comments and arguments."""
    n = 40_000
    text = "enum E {\n" + ",\n".join(f"/** {k} */ A{k}({k}, b({k}))" for k in range(n)) + ";\n  int " + ", ".join(f"f{k}" for k in range(n // 4)) + ";\n}\n"
    began = time.monotonic()
    rows = scanned(spark, ("E.java", text))
    assert time.monotonic() - began < 150
    constants = sorted((r.line_start, r.line_end, r.selector, r.javadoc, r.doc_start) for r in rows if r.kind == "enum-constant")
    assert constants == [(k + 2, k + 2, f"A{k}", f"/** {k} */", k + 2) for k in range(n)]
    assert {r.signature for r in rows if r.kind == "field"} == {f"int f{k}" for k in range(n // 4)} and len(rows) == 1 + n + n // 4
