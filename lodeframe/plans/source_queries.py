"""Registered queries over sources, selectors and names that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeframe.operators import order, prefixes, rank
from lodeframe.operators.declarations import scan_declarations, scan_problems
from lodeframe.plans import backings, search, skeleton as shown
from lodeframe.plans.catalogue import ORACLE_SQL, QUERIES, members, query, table
from lodeframe.sources import catalog

_BRANDS_SQL = """brands AS (SELECT 'src/' || replace(p_brand, '#', '') || '_' || p_size || '.java' AS path, replace(p_brand, '#', '') || '_' || p_size AS cls, list(p_partkey ORDER BY p_partkey) AS keys FROM part GROUP BY p_brand, p_size)"""

__all__ = ["ORACLE_SQL", "QUERIES"]


def brand_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): an enum for each brand and size, a constant for each of its parts, its header and members over lines,
    and what is no code: a comment and a text block with classes in them."""
    keys = F.array_sort(F.collect_list("p_partkey"))
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.col("p_size").cast("string"))
    brands = table(spark, sf_dir, "part").groupBy(name.alias("cls")).agg(keys.alias("keys"))
    constants = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("  P"), k.cast("string"))), ",\n")
    text = F.concat(
        F.lit("package shop;\n/** A brand. */\npublic enum "), "cls", F.lit(" {\n"), constants, F.lit(";\n  static final Map<String, Integer> SIZE = of(1, 2),\n    MORE;\n  /* class No { } */\n"),
        F.lit('  String block = """\n    class Neither { int n; }\n    """;\n  @Deprecated\n  public int\n    size(Map<String, Integer> a, // first\n         final int... b) {\n    class Local { }\n    return 0;\n  }\n}\n'),
    )
    return brands.select(F.concat(F.lit("src/"), "cls", F.lit(".java")).alias("path"), text.alias("text"))


@query(f"""WITH {_BRANDS_SQL}, counted AS (SELECT *, len(keys) AS n FROM brands), found AS (
    SELECT path, cls, 'shop.' || cls AS fqn, cls AS selector, 'enum' AS kind, 'public enum ' || cls AS signature, 3 AS line_start, n + 17 AS line_end, false AS deprecated, 2 AS doc_start, NULL AS params FROM counted
    UNION ALL SELECT path, cls, 'shop.' || cls, 'P' || keys[i], 'enum-constant', 'P' || keys[i], 3 + i, 3 + i, false, NULL, NULL FROM counted, unnest(range(1, n + 1)) AS t(i)
    UNION ALL SELECT path, cls, 'shop.' || cls, 'SIZE', 'field', 'static final Map<String,Integer> SIZE', n + 4, n + 4, false, NULL, NULL FROM counted
    UNION ALL SELECT path, cls, 'shop.' || cls, 'MORE', 'field', 'static final Map<String,Integer> MORE', n + 5, n + 5, false, NULL, NULL FROM counted
    UNION ALL SELECT path, cls, 'shop.' || cls, 'block', 'field', 'String block', n + 7, n + 9, false, NULL, NULL FROM counted
    UNION ALL SELECT path, cls, 'shop.' || cls, 'size', 'method', 'public int size(Map<String,Integer>,int...)', n + 10, n + 16, true, NULL, 'Map<String,Integer>;int...' FROM counted)
    SELECT path, fqn, selector, kind, signature, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, deprecated, doc_start::INTEGER AS doc_start, params FROM found""")
def declarations_of_brands(spark, sf_dir):
    """Declarations of made sources: one shuffle by file, folds only over parameters, one pass over declarators."""
    found = scan_declarations(brand_sources(spark, sf_dir))
    return found.select("path", "fqn", "selector", "kind", "signature", "line_start", "line_end", "deprecated", "doc_start", F.array_join("params", ";").alias("params"))


@query("""WITH s AS (SELECT p_partkey, 'P' || p_partkey || '.java' AS path, 1 + p_size % 3 AS opens, 1 + p_size % 4 AS closes FROM part)
    SELECT path, CASE WHEN closes > opens THEN 'unbalanced braces at line ' || (2 * opens + 1) || ': nothing is open to be closed'
      ELSE 'unbalanced braces at line ' || opens || ': block is never closed' END AS problem FROM s WHERE closes <> opens""")
def problems_of_parts(spark, sf_dir):
    """Files whose braces do not balance, and where."""
    size = F.col("p_size").cast("int")
    text = F.concat(F.lit("class P {\n"), F.repeat(F.lit("void m() {\n"), size % 3), F.repeat(F.lit("}\n"), size % 4), F.lit("}"))
    return scan_problems(table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey", F.lit(".java")).alias("path"), text.alias("text")))


@query("""WITH c AS (SELECT r_name, r_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY r_name) AS total FROM region JOIN nation ON n_regionkey = r_regionkey),
    body AS (
      SELECT r_name, 6 + 3 * (k - 1) + 1 AS n, '    class ' || n_name || ' {' AS line FROM c UNION ALL SELECT r_name, 6 + 3 * (k - 1) + 2, '        int key' || n_nationkey || ';' FROM c UNION ALL SELECT r_name, 6 + 3 * k, '    }' FROM c
      UNION ALL SELECT r_name, 7 + 3 * total, '    void list();' FROM c WHERE k = 1 UNION ALL SELECT r_name, 8 + 3 * total, '}' FROM c WHERE k = 1
      UNION ALL SELECT r_name, unnest([1, 2, 3, 4, 5, 6]), unnest(['// geo.' || r_name, '// g:a:' || r_regionkey || '  provenance source', '', 'package geo;', '', 'class ' || r_name || ' {']) FROM c WHERE k = 1)
    SELECT 'geo.' || r_name AS target, n::INTEGER AS n, line FROM body""")
def skeletons_of_regions(spark, sf_dir):
    """Regions as classes that nations are nested in: depth-first order out of parent links, all regions in one job."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    target = F.concat(F.lit("geo."), "r_name")
    none = F.lit(None).cast("string").alias("javadoc")
    row = lambda ord_, fqn, kind, signature: F.struct(ord_.cast("long").alias("ord"), fqn.alias("fqn"), F.lit(kind).alias("kind"), signature.alias("signature"))
    own = region.select(target.alias("target"), F.explode(F.array(row(F.lit(0), target, "class", F.concat(F.lit("class "), "r_name")), row(F.lit(10**9), target, "method", F.lit("void list()")))).alias("r"))
    inner = F.concat(target, F.lit("."), "n_name")
    at = 2 * F.col("n_nationkey") + 1
    held = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(target.alias("target"), F.explode(F.array(row(at, inner, "class", F.concat(F.lit("class "), "n_name")), row(at + 1, inner, "field", F.concat(F.lit("int key"), "n_nationkey")))).alias("r"))
    rows = own.unionByName(held).select("target", "r.*", none)
    heads = region.select(target.alias("target"), F.concat(F.lit("g:a:"), "r_regionkey").alias("coordinates"), F.lit("source").alias("provenance"), F.lit(False).alias("stale"), F.lit(None).cast("array<string>").alias("imports"))
    return shown.skeleton(rows, heads)


@query("""WITH heads AS (SELECT DISTINCT regexp_extract(url, '^[^:]*://[^/]*/[^/]*') AS prefix FROM pages WHERE url LIKE '%://%/%')
    SELECT page_id, prefix FROM pages JOIN heads ON starts_with(url, prefix)""")
def prefix_join_of_tables(spark, sf_dir):
    """Every URL with every first folder that it begins with: both tables grow, and no pair is tried that does not match."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    heads = pages.filter("url like '%://%/%'").select(F.regexp_extract("url", "^[^:]*://[^/]*/[^/]*", 0).alias("prefix")).distinct()
    return prefixes.prefix_join(pages, "url", heads, "prefix").select("page_id", "prefix")


@query("""WITH decl AS (SELECT 'com.acme.Customer' || o_custkey % 50 AS fqn, 'member' || o_orderkey % 7 AS name, CASE WHEN o_orderkey % 5 >= 3 THEN o_orderkey % 3 END AS arity, count(*) AS n FROM orders GROUP BY ALL),
    asked AS (SELECT c_custkey, 'com.acme.Customer' || c_custkey % 50 AS fqn, 'member' || c_custkey % 9 AS name, c_custkey % 3 AS form FROM customer)
    SELECT c_custkey, coalesce(sum(n) FILTER (WHERE form = 0 OR arity = form - 1), 0)::BIGINT AS hits FROM asked LEFT JOIN decl USING (fqn, name) GROUP BY c_custkey""")
def selectors_of_customers(spark, sf_dir):
    """A selector for each customer against the members of all classes, counted by forms of both; what finds nothing is a miss."""
    form = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "()").otherwise("(String)")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("com.acme.Customer"), (F.col("c_custkey") % 50).cast("string")).alias("fqn"), F.concat(F.lit("#member"), (F.col("c_custkey") % 9).cast("string"), form).alias("selectors"))
    return search.count_members(members(spark, sf_dir).drop("receiver"), asked).select("c_custkey", "hits")


@query("""WITH RECURSIVE asked AS (SELECT DISTINCT lower(substr(p_type, 1, 2) || substr(p_type, length(p_type), 1)) AS q FROM part),
    folded(q, key, name, i, taken, last, score) AS (
      SELECT q, p_partkey, p_name, 0, 0, -2, CASE WHEN starts_with(lower(p_name), q) THEN 50 ELSE 0 END FROM asked, part
      UNION ALL
      SELECT q, key, name, i + 1, CASE WHEN hit THEN taken + 1 ELSE taken END, CASE WHEN hit THEN i + 1 ELSE last END,
        CASE WHEN NOT hit THEN score WHEN i = 0 OR regexp_full_match(substr(name, i, 2), '[a-z][A-Z]') OR substr(name, i, 1) IN ('_', '-', '.') THEN score + 30 WHEN last = i THEN score + 2 ELSE score + 1 END
      FROM (SELECT *, taken < length(q) AND substr(lower(name), i + 1, 1) = substr(q, taken + 1, 1) AS hit FROM folded WHERE i < length(name))),
    scored AS (SELECT q, key, CASE WHEN lower(name) = q THEN 100 ELSE score - length(name) // 10 END::INTEGER AS score FROM folded WHERE i = length(name) AND taken = length(q))
    SELECT q, key AS p_partkey, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, key)::INTEGER AS rn FROM scored QUALIFY rn <= 20""")
def searches_of_types(spark, sf_dir):
    """Many fuzzy searches at once: letters drop most names before the fold, a group limit keeps the best of each search."""
    part = table(spark, sf_dir, "part")
    kind = F.col("p_type")
    asked = part.select(F.lower(F.concat(F.substring(kind, 1, 2), F.substring(kind, -1, 1))).alias("q")).distinct()
    return rank.search_many(part.select("p_partkey", "p_name"), "p_name", asked, "q", ["p_partkey"]).select("q", "p_partkey", "score", "rn")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def orders_numbered(spark, sf_dir):
    """A row's place in a global order, without a window over all rows: partitions by range, and counts of those before."""
    return order.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place")


_ENTRY_SQL = "CASE p_partkey % 41 WHEN 0 THEN 'o/x/C.java' WHEN 1 THEN 'm' || p_partkey || '/o/x/C.java' WHEN 2 THEN 'o/x/C.kt' WHEN 3 THEN 'm' || p_partkey || '/o/x/C.kt' ELSE 'o/x/D' || p_partkey || '.java' END"


@query(f"""WITH e AS (SELECT p_brand || ':' || p_size AS coordinates, {_ENTRY_SQL} AS name FROM part),
    n AS (SELECT coordinates, count(*) FILTER (name = 'o/x/C.java') AS j, count(*) FILTER (name LIKE '%/o/x/C.java') AS js, min(name) FILTER (name LIKE '%/o/x/C.java') AS jn,
      count(*) FILTER (name = 'o/x/C.kt') AS k, count(*) FILTER (name LIKE '%/o/x/C.kt') AS ks, min(name) FILTER (name LIKE '%/o/x/C.kt') AS kn FROM e GROUP BY coordinates)
    SELECT coordinates, CASE WHEN j > 0 THEN 'o/x/C.java' WHEN js = 1 THEN jn WHEN js > 1 THEN NULL WHEN k > 0 THEN 'o/x/C.kt' WHEN ks = 1 THEN kn END AS name FROM n WHERE name IS NOT NULL""")
def source_entries_of_parts(spark, sf_dir):
    """The source entry of a class in every artifact: an extension at a time, exact before relocated, ambiguity ends it."""
    key = F.col("p_partkey")
    moved = lambda ext: F.concat(F.lit("m"), key.cast("string"), F.lit(f"/o/x/C{ext}"))
    name = F.when(key % 41 == 0, "o/x/C.java").when(key % 41 == 1, moved(".java")).when(key % 41 == 2, "o/x/C.kt").when(key % 41 == 3, moved(".kt")).otherwise(F.concat(F.lit("o/x/D"), key.cast("string"), F.lit(".java")))
    entries = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string")).alias("coordinates"), name.alias("name"))
    return backings.source_entry(entries, "o.x.C")


@query("""WITH jars AS (SELECT s_nationkey, s_suppkey, 'acme' || s_nationkey AS a, '1.' || s_suppkey % 5 AS v FROM supplier)
    SELECT DISTINCT 'org.nation:' || a || ':' || v AS coordinates FROM jars WHERE s_suppkey % 3 <> 0""")
def classpath_of_suppliers(spark, sf_dir):
    """Artifacts of class-path lines, a line for each nation; jars outside the repository's layout are none."""
    artifact, version = F.concat(F.lit("acme"), "s_nationkey"), F.concat(F.lit("1."), (F.col("s_suppkey") % 5).cast("string"))
    inside = F.concat(F.lit("/r/org/nation/"), artifact, F.lit("/"), version, F.lit("/"), artifact, F.lit("-"), version, F.lit(".jar"))
    jar = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/opt/lib"), "s_suppkey", F.lit(".jar"))).otherwise(inside)
    lines = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(jar), ":").alias("value"))
    return catalog.from_classpath(lines, "/r").select("coordinates")


@query("""WITH f AS (SELECT DISTINCT 'm' || s_nationkey || '/' || CASE s_suppkey % 4 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'a/pom.xml' WHEN 2 THEN '.h/pom.xml' ELSE 'a/b/c/pom.xml' END AS path, s_suppkey % 4 AS form FROM supplier)
    SELECT replace(path, '/pom.xml', '') AS dir FROM f WHERE form < 2""")
def modules_of_suppliers(spark, sf_dir):
    """Module folders among a project's files: with a build file, at most three levels down, not hidden."""
    form = F.col("s_suppkey") % 4
    tail = F.when(form == 0, "pom.xml").when(form == 1, "a/pom.xml").when(form == 2, ".h/pom.xml").otherwise("a/b/c/pom.xml")
    return catalog.find_modules(table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), "s_nationkey", F.lit("/"), tail).alias("path")))
