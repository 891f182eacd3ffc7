"""The queries over the driver's tables, each beside SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodeframe.functions import names, text
from lodeframe.functions.fuzzy import fuzzy_score
from lodeframe.operators import rank
from lodeframe.plans import search
from lodeframe.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_sql(source: str, key: str, name: str, q: str) -> str:
    """CTEs ending in scored(key, name, score): the fuzzy score in SQL, a position of the name at a time."""
    return f"""
    folded(key, name, i, taken, last, score) AS (
      SELECT {key}, {name}, 0, 0, -2, CASE WHEN starts_with(lower({name}), lower('{q}')) THEN 50 ELSE 0 END FROM {source}
      UNION ALL
      SELECT key, name, i + 1,
        CASE WHEN hit THEN taken + 1 ELSE taken END, CASE WHEN hit THEN i + 1 ELSE last END,
        CASE WHEN NOT hit THEN score
          WHEN i = 0 OR regexp_full_match(substr(name, i, 2), '[a-z][A-Z]') OR substr(name, i, 1) IN ('_', '-', '.') THEN score + 30
          WHEN last = i THEN score + 2 ELSE score + 1 END
      FROM (SELECT *, taken < length('{q}') AND substr(lower(name), i + 1, 1) = substr(lower('{q}'), taken + 1, 1) AS hit FROM folded WHERE i < length(name))),
    scored AS (
      SELECT key, name, CASE WHEN lower(name) = lower('{q}') THEN 100 ELSE score - length(name) // 10 END::INTEGER AS score
      FROM folded WHERE i = length(name) AND (taken = length('{q}') OR lower(name) = lower('{q}')))"""


# -- names and ranking ---------------------------------------------------------------------------------------------


@query("WITH RECURSIVE" + scored_sql("part", "p_partkey", "p_name", "sgi") + " SELECT key AS p_partkey, name AS p_name, score FROM scored ORDER BY score DESC, key LIMIT 20")
def fuzzy_topk_part(spark, sf_dir):
    """Best 20 names by fuzzy score; a top-k, so no full sort."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    scored = part.withColumn("score", fuzzy_score("sgi", F.col("p_name"))).filter("score is not null")
    return scored.orderBy(F.desc("score"), "p_partkey").limit(20)


_DECLARATIONS_SQL = """(SELECT p_partkey AS ord, replace(p_brand, '#', '-') AS coordinates,
  concat('com.acme.', lower(p_type), '.', upper(substr(p_name, 1, 1)), substr(p_name, 2, instr(p_name, ' ') - 2),
    upper(substr(p_name, instr(p_name, ' ') + 1, 1)), substr(p_name, instr(p_name, ' ') + 2), '$V', p_size) AS fqn FROM part)"""


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, coordinates, fqn): part as declared classes with packages, humps and nesting."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    hump = F.concat(F.initcap(first), F.initcap(second))
    fqn = F.concat(F.lit("com.acme."), F.lower("p_type"), F.lit("."), hump, F.lit("$V"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("coordinates"), fqn.alias("fqn"))


def _tiered_sql(source: str, key: str, name: str, q: str) -> str:
    return f"""
    WITH RECURSIVE names AS (SELECT {key} AS key, {name} AS name, replace({name}, '$', '.') AS dotted FROM {source}),
    tiers AS (
      SELECT key, name, CASE WHEN name = '{q}' OR dotted = replace('{q}', '$', '.') THEN 0
        WHEN contains('{q}', '.') AND ends_with(dotted, '.' || replace('{q}', '$', '.')) THEN 1
        WHEN regexp_replace(regexp_replace(name, '^.*\\.', ''), '^.*\\$([A-Za-z_].*)$', '\\1') = '{q}' THEN 2 ELSE 3 END AS tier FROM names),
    rest AS (SELECT key, name FROM tiers WHERE tier = 3), {scored_sql("rest", "key", "name", q)}
    SELECT key, name, tier, 0 AS score FROM tiers WHERE tier < 3
    UNION ALL SELECT * FROM (SELECT key, name, 3 AS tier, score FROM scored ORDER BY score DESC, key LIMIT 20)"""


@query(f"""SELECT key AS p_partkey, name AS p_name, tier, score FROM ({_tiered_sql("part", "p_partkey", "p_name", "red ring")})""")
def tiered_search_part(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rank.tiered_search(part, "p_name", "red ring", ["p_partkey"])


def _declared(q: str) -> Callable[[SparkSession, str], DataFrame]:
    def search(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rank.tiered_search(declarations(spark, sf_dir).select(F.col("ord").alias("key"), F.col("fqn").alias("name")), "name", q, ["key"])

    return search


for _name, _q in {"exact": "com.acme.economy.SmallRing$V11", "suffix": "BlueBolt.V5", "simple": "V25", "fuzzy": "redring"}.items():
    QUERIES[f"find_class_{_name}"] = _declared(_q)
    ORACLE_SQL[f"find_class_{_name}"] = _tiered_sql(_DECLARATIONS_SQL, "ord", "fqn", _q)


@query(f"""WITH RECURSIVE one AS (SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12'), {scored_sql("one", "p_partkey", "p_name", "bl")}
    SELECT key AS p_partkey, name AS p_name, score, CASE WHEN name = 'bl' THEN 0 WHEN starts_with(name, 'bl') THEN 1 ELSE 2 END AS tier
    FROM scored ORDER BY tier, score DESC, p_partkey LIMIT 50""")
def symbol_search_scoped(spark, sf_dir):
    """Member search in one artifact: the filter on it reaches the scan."""
    one = table(spark, sf_dir, "part").filter("p_brand = 'Brand#12'").select("p_partkey", "p_name")
    return rank.member_search(one, "p_name", "bl", ["p_partkey"])


def _both_ways_sql(source: str, name: str, q: str) -> str:
    # backwards the query is the name and each name the query: the fold runs over the query's letters
    return f"""{scored_sql(source, name, name, q)},
    back(key, i, taken, last, score) AS (
      SELECT {name}, 0, 0, -2, CASE WHEN starts_with(lower('{q}'), lower({name})) THEN 50 ELSE 0 END FROM {source}
      UNION ALL
      SELECT key, i + 1, CASE WHEN hit THEN taken + 1 ELSE taken END, CASE WHEN hit THEN i + 1 ELSE last END,
        CASE WHEN NOT hit THEN score
          WHEN i = 0 OR regexp_full_match(substr('{q}', i, 2), '[a-z][A-Z]') OR substr('{q}', i, 1) IN ('_', '-', '.') THEN score + 30
          WHEN last = i THEN score + 2 ELSE score + 1 END
      FROM (SELECT *, taken < length(key) AND substr(lower('{q}'), i + 1, 1) = substr(lower(key), taken + 1, 1) AS hit FROM back WHERE i < length('{q}'))),
    reverse_scored AS (
      SELECT key, CASE WHEN lower(key) = lower('{q}') THEN 100 ELSE score - length('{q}') // 10 END::INTEGER AS score
      FROM back WHERE i = length('{q}') AND taken = length(key))"""


@query(f"""WITH RECURSIVE {_both_ways_sql("nation", "n_name", "NATION_12")}
    SELECT key AS n_name, max(score) AS score FROM (SELECT key, score FROM scored UNION ALL SELECT key, score FROM reverse_scored)
    GROUP BY key ORDER BY score DESC, key LIMIT 3""")
def did_you_mean_nation(spark, sf_dir):
    return rank.closest(table(spark, sf_dir, "nation").select("n_name"), "n_name", "NATION_12")


@query("""
    WITH g AS (SELECT l_partkey, first(l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS winner, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, winner, array_to_string(list_sort(list_filter(s, lambda x: x <> winner)), ',') AS alternatives FROM g""")
def winner_alternatives(spark, sf_dir):
    """Per part the supplier that comes first, and the other ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    out = rank.winner_alternatives(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], "l_suppkey")
    return out.withColumn("alternatives", F.array_join("alternatives", ","))


@query("SELECT md5(text) AS text_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_first_wins_documents(spark, sf_dir):
    """First document of each text; texts are hashed before the shuffle."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"))
    return keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rn FROM part)
    WHERE rn <= 3""")
def top_per_group_part(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.top_per_key(part, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3)


# -- joins ----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality = 1 THEN 'source' WHEN quality = 0 THEN 'decompiled' ELSE 'signature' END AS provenance
    FROM documents LEFT JOIN labels USING (doc_id)""")
def pair_left_outer_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.withColumn("provenance", F.when(F.col("quality") == 1, "source").when(F.col("quality") == 0, "decompiled").otherwise("signature")).withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def declared_parts(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(sold, "p_partkey", "left_semi")


_PREFIXES = ["http://m.", "http://www.", "https://m.", "https://blog.", "https://t"]


@query(f"SELECT page_id, prefix FROM pages JOIN (SELECT unnest({_PREFIXES}) AS prefix) ON starts_with(url, prefix)")
def prefix_theta_join(spark, sf_dir):
    """A handful of prefixes against every URL: the list is a constant in the plan, so nothing moves."""
    fits = F.filter(F.lit(_PREFIXES), lambda p: F.startswith(F.col("url"), p))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(fits).alias("prefix"))


_SELECTORS = [("click", 10.0), ("click", 50.0), ("error", 20.0), ("install", 0.0)]


@query("""WITH selectors(name, least) AS (VALUES ('click', 10.0::DOUBLE), ('click', 50.0), ('error', 20.0), ('install', 0.0))
    SELECT name, least, count(event_id) AS hits, CASE WHEN count(event_id) = 0 THEN 'no matching declaration' END AS miss
    FROM selectors LEFT JOIN events ON event_type = name AND value >= least GROUP BY name, least""")
def selector_match_events(spark, sf_dir):
    """Selectors match by name and a further condition; what matches nothing is a miss. Events are counted by name and
    selector before anything is shuffled, as the selectors are broadcast: a list in the plan, of known size."""
    selectors = spark.createDataFrame(_SELECTORS, "name string, least double")
    events = table(spark, sf_dir, "events").select("event_type", "value")
    hit = events.join(F.broadcast(selectors), (F.col("event_type") == F.col("name")) & (F.col("value") >= F.col("least")))
    counts = hit.groupBy("name", "least").agg(F.count("*").alias("hits"))
    out = selectors.join(counts, ["name", "least"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.withColumn("miss", F.when(F.col("hits") == 0, "no matching declaration"))


@query("""SELECT n_nationkey, concat_ws('.', r_name, n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE concat_ws('.', r_name, n_name) NOT IN (SELECT concat_ws('.', r_name, 'NATION_' || r_regionkey) FROM region)""")
def shadow_anti_join(spark, sf_dir):
    """Rows go that another row of the composed name shadows."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    paths = nation.select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("path"))
    shadows = region.select(F.concat_ws(".", "r_name", F.concat(F.lit("NATION_"), "r_regionkey")).alias("path"))
    return paths.join(shadows, "path", "left_anti").select("n_nationkey", "path")


@query("SELECT n_name, coalesce(r_name, '(root)') AS parent, n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def nesting_parent(spark, sf_dir):
    region = table(spark, sf_dir, "region").filter("r_name <> 'ASIA'")
    joined = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("n_name", F.coalesce("r_name", F.lit("(root)")).alias("parent"), "n_regionkey")


@query("""SELECT s_suppkey, bool_or(l_suppkey IS NOT NULL) AS any_exists, bool_and(coalesce(l_returnflag = 'R', false)) AS every_returned
    FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_discount > 0.05) ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def path_flags(spark, sf_dir):
    kinds = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select("l_suppkey", "l_returnflag").distinct()
    joined = table(spark, sf_dir, "supplier").select("s_suppkey").join(kinds, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    every = F.bool_and(F.coalesce(F.col("l_returnflag") == "R", F.lit(False)))
    return joined.groupBy("s_suppkey").agg(F.bool_or(F.col("l_suppkey").isNotNull()).alias("any_exists"), every.alias("every_returned"))


@query("""SELECT lower(n_name) AS module, count(c_custkey) AS outputs, max(c_acctbal) AS largest FROM nation
    JOIN customer ON lower(concat('nation_', c_nationkey)) = lower(n_name) GROUP BY 1""")
def module_join_on_lower(spark, sf_dir):
    """Equi-join on an expression; customers are counted by key before they meet their nation."""
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("outputs"), F.max("c_acctbal").alias("largest"))
    keyed = counted.withColumn("module", F.concat(F.lit("nation_"), "c_nationkey"))
    modules = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("module"))
    return modules.join(keyed, "module").select("module", "outputs", "largest")


# -- filters, projections, sections ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')")
def classify_sections(spark, sf_dir):
    """A preset with one section switched back on: each section that is off is a filter, the last one blanks a column."""
    preset = {"finished": False, "pending": True, "low": False} | {"pending": True}
    sections = {"finished": F.col("o_orderstatus").isin("F"), "pending": F.col("o_orderstatus").isin("P"), "low": F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")}
    rows = table(spark, sf_dir, "orders")
    for section, holds in sections.items():
        if not preset[section]:
            rows = rows.filter(~holds)
    return rows.select("o_orderkey", "o_orderstatus", F.when(F.startswith(F.col("o_orderpriority"), F.lit("1")), F.col("o_totalprice")).alias("o_totalprice"))


@query("""SELECT p_type, CASE WHEN contains(lower(p_type), 'promo') THEN 'processor' WHEN contains(lower(p_type), 'standard') THEN 'test'
      WHEN contains(lower(p_type), 'medium') THEN 'compile' WHEN contains(lower(p_type), 'small') THEN 'runtime' ELSE 'compile' END AS label, count(*) AS n
    FROM part GROUP BY p_type""")
def config_label_case(spark, sf_dir):
    """A ladder whose order matters; rows are counted first, so it runs once a type."""
    kind = F.lower("p_type")
    label = F
    for word, name in (("promo", "processor"), ("standard", "test"), ("medium", "compile"), ("small", "runtime")):
        label = label.when(F.contains(kind, F.lit(word)), name)
    counted = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return counted.select("p_type", label.otherwise("compile").alias("label"), "n")


@query(r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, '(?s)https://[^/]*\.com/.*/[^/]*')")
def glob_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(text.matches_glob(F.col("url"), "https://*.com/**/*"))


@query("""SELECT page_id, regexp_matches(lower(url), '\\.(class|png|gif|jpg|jar|so|dylib|dll|kotlin_module|kotlin_builtins)$') OR contains(substr(html, 1, 8192), chr(0)) AS is_binary
    FROM pages""")
def binary_sniff_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.is_binary(F.col("url"), F.col("html").cast("binary")).alias("is_binary"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
    SELECT page_id, host FROM h WHERE host = 'example.net' OR ends_with(host, '.example.net')""")
def suffix_host_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return pages.filter(names.is_suffix(F.col("host"), F.lit("example.net")))


@query(r"""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(url, '/([^/?#]*)(\?[^/]*|#[^/]*)?$', 1) AS base,
      split_part(url, '/', -1) AS last_segment FROM pages""")
def coordinate_parts(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    base = F.regexp_extract("url", r"/([^/?#]*)(\?[^/]*|#[^/]*)?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), base.alias("base"), names.base_name(F.col("url")).alias("last_segment"))


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events WHERE json_extract(props, '$.k')::INTEGER >= 50")
def json_props_extract(spark, sf_dir):
    k = F.from_json("props", "k int").getField("k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


# -- lines and text -------------------------------------------------------------------------------------------------

_LINES_SQL = """(SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM documents)"""


@query(f"SELECT doc_id, len(lines)::INTEGER AS line_count FROM {_LINES_SQL}")
def line_count_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(F.col("text"))).alias("line_count"))


@query(f"""SELECT doc_id, i::INTEGER AS line_number, lines[i] AS line, len(lines) < 5 AS clamped
    FROM {_LINES_SQL}, unnest(range(2, least(5, len(lines)) + 1)) AS t(i)""")
def slice_lines_documents(spark, sf_dir):
    part = text.line_slice(text.lines(F.col("text")), 2, 5)
    sliced = table(spark, sf_dir, "documents").select("doc_id", part.alias("part"))
    rows = sliced.select("doc_id", "part.clamped", "part.first", F.posexplode("part.lines").alias("i", "line"))
    return rows.select("doc_id", (F.col("first") + F.col("i")).cast("int").alias("line_number"), "line", "clamped")


@query(f"SELECT doc_id, concat(lpad(i::VARCHAR, length(len(lines)::VARCHAR)::INTEGER, ' '), '│ ', lines[i]) AS numbered FROM {_LINES_SQL}, unnest(range(1, len(lines) + 1)) AS t(i)")
def number_lines_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("lines"))
    width = F.length(F.size("lines").cast("string"))
    rows = docs.select("doc_id", width.alias("width"), F.posexplode("lines").alias("i", "line"))
    return rows.select("doc_id", text.numbered(F.col("i") + 1, F.col("width"), F.col("line")).alias("numbered"))


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS signature,
      CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS cell FROM documents""")
def truncate_signature_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("signature"), text.clipped(F.col("text")).alias("cell"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[ \t-\r]+', ' ', 'g'), ' ') AS flat FROM documents WHERE NOT regexp_matches(text, '(?m)^\s*@')),
    f AS (SELECT doc_id, CASE WHEN contains(flat, '.') THEN split_part(flat, '.', 1) || '.' ELSE flat END AS sentence FROM s)
    SELECT doc_id, CASE WHEN length(sentence) > 180 THEN substr(sentence, 1, 180) || '…' ELSE sentence END AS summary FROM f""")
def first_sentence_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(~F.rlike("text", F.lit(r"(?m)^\s*@")))
    flat = F.trim(F.regexp_replace("text", r"[ \t-\r]+", " "))
    sentence = F.when(F.contains(flat, F.lit(".")), F.concat(F.substring_index(flat, ".", 1), F.lit("."))).otherwise(flat)
    return docs.select("doc_id", text.truncated(sentence, 180).alias("summary"))


@query(r"SELECT doc_id, regexp_matches(text, '(?m)^\s*\*?\s*@deprecated\b') AS deprecated, regexp_matches(text, '(?m)^The\b') AS starts_line FROM documents")
def deprecated_tag_documents(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.has_deprecated_tag(body).alias("deprecated"), F.rlike(body, F.lit(r"(?m)^The\b")).alias("starts_line"))


@query("""SELECT max(length(n_name))::INTEGER AS longest, least(60, greatest(1, max(length(n_name))))::INTEGER AS width FROM nation
    UNION ALL SELECT max(length(p_name))::INTEGER, least(60, greatest(1, max(length(p_name))))::INTEGER FROM part
    UNION ALL SELECT max(length(url))::INTEGER, least(60, greatest(1, max(length(url))))::INTEGER FROM pages""")
def column_widths(spark, sf_dir):
    longest = lambda t, c: table(spark, sf_dir, t).agg(F.max(F.length(c)).alias("longest"))
    out = longest("nation", "n_name").union(longest("part", "p_name")).union(longest("pages", "url"))
    return out.withColumn("width", F.least(F.lit(60), F.greatest(F.lit(1), "longest")))


@query("""SELECT conv_id, turn, (SELECT text FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn < a.turn ORDER BY b.turn DESC LIMIT 1) AS asked
    FROM conversations a WHERE role = 'assistant'""")
def last_doc_before(spark, sf_dir):
    """What was last asked before each answer. One window by conversation; only the two columns it needs are read."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("asked", asked).filter("role = 'assistant'").select("conv_id", "turn", "asked")


# -- aggregates, catalogues, fallbacks ------------------------------------------------------------------------------


@query("""WITH v AS (SELECT p_type, p_brand, count(*) AS n, replace(p_brand, 'Brand#', '')::INTEGER AS num FROM part GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY num DESC) AS rn FROM v)
    SELECT p_type, max(p_brand) FILTER (rn = 1) AS kept, string_agg(p_brand, ', ' ORDER BY num) FILTER (rn > 1) AS also_saw FROM r GROUP BY p_type""")
def version_max_brand(spark, sf_dir):
    """Highest version of each artifact, and the other ones seen, lowest first."""
    key = text.version_key(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    seen = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct().withColumn("key", key)
    grouped = seen.groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("key", "p_brand"))).alias("all"))
    named = F.transform("all", lambda x: x["p_brand"])
    return grouped.select("p_type", F.element_at(named, -1).alias("kept"), F.array_join(F.slice(named, F.lit(1), F.size(named) - 1), ", ").alias("also_saw"))


@query("""SELECT r_name, sha256(string_agg(concat(n_name, chr(9), n_nationkey, chr(9), n_regionkey), chr(10) ORDER BY concat(n_name, chr(9), n_nationkey, chr(9), n_regionkey))) AS fingerprint
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def fingerprint_region(spark, sf_dir):
    line = F.concat_ws("\t", "n_name", "n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


@query("""WITH bad AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_orderpriority = '1-URGENT'),
    first AS (SELECT string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) AS keys FROM (SELECT o_orderkey FROM bad ORDER BY o_orderkey LIMIT 3))
    SELECT (SELECT count(*) FROM bad) AS n, concat((SELECT count(*) FROM bad), ' entries failed to parse (', keys, ')') AS note FROM first""")
def degraded_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    bad = (F.col("o_totalprice") > 400000) & (F.col("o_orderpriority") == "1-URGENT")
    return rank.degraded(orders, bad, F.col("o_orderkey").cast("string"), "entries failed to parse", ["o_orderkey"])


@query("SELECT c_custkey, c_name, 1::INTEGER AS priority FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 5000")
def cascade_first_nonempty(spark, sf_dir):
    """Sources in order of preference: the first that has rows gives all of them."""
    customer = table(spark, sf_dir, "customer")
    segment = lambda s: customer.filter(f"c_mktsegment = '{s}' and c_acctbal > 5000").select("c_custkey", "c_name")
    return rank.first_nonempty([segment("AEROSPACE"), segment("FURNITURE"), segment("BUILDING")])


_MISS_SQL = f"""WITH RECURSIVE {scored_sql("part", "p_partkey", "p_name", "zqx")}
    SELECT p_name, note FROM (SELECT name AS p_name, NULL AS note FROM scored ORDER BY score DESC, key LIMIT 3)
    UNION ALL SELECT NULL, 'not found in resolved artifacts; remote artifact search is a planned extension' WHERE NOT EXISTS (FROM scored)"""


@query(_MISS_SQL)
def miss_negative(spark, sf_dir):
    """Suggestions, or one row that says there are none."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    scored = part.withColumn("score", fuzzy_score("zqx", F.col("p_name"))).filter("score is not null")
    hits = scored.orderBy(F.desc("score"), "p_partkey").limit(3).select("p_name", F.lit(None).cast("string").alias("note"))
    note = "not found in resolved artifacts; remote artifact search is a planned extension"
    nothing = hits.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("p_name"), F.lit(note).alias("note"))
    return hits.unionByName(nothing)



# -- the searches themselves, over the derived classes ------------------------------------------------------------------

_ARTIFACTS_SQL = "artifacts AS (SELECT row_number() OVER (ORDER BY c) - 1 AS rank, c AS coordinates FROM (SELECT DISTINCT 'acme:' || replace(p_brand, '#', '-') || ':' || p_size % 3 AS c FROM part))"
_OUTER = "concat('com.acme.', lower(p_type), '.', upper(substr(p_name, 1, 1)), substr(p_name, 2, instr(p_name, ' ') - 2), upper(substr(p_name, instr(p_name, ' ') + 1, 1)), substr(p_name, instr(p_name, ' ') + 2))"
_CLASSES_SQL = f"""{_ARTIFACTS_SQL}, classes AS (SELECT p_partkey AS ord, 'acme:' || replace(p_brand, '#', '-') || ':' || p_size % 3 AS coordinates, {_OUTER} AS fqn, p_retailprice AS price FROM part)"""


def class_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coordinates, artifact_rank, entry_ord, fqn, source, name): part as the classes of artifacts in a manifest's order."""
    part = declarations(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    named = part.select("ord", F.concat(F.lit("acme:"), "coordinates", F.lit(":"), (F.col("p_size") % 3).cast("string")).alias("coordinates"), F.substring_index("fqn", "$", 1).alias("fqn"))
    ranks = named.select("coordinates").distinct().withColumn("artifact_rank", F.row_number().over(Window.orderBy("coordinates")) - 1)  # one row an artifact
    source = F.when(F.col("ord") % 4 == 0, "sources").otherwise("binary")
    return named.join(ranks, "coordinates").select("coordinates", "artifact_rank", F.col("ord").alias("entry_ord"), "fqn", source.alias("source"), F.col("fqn").alias("name"))


@query(f"""WITH {_CLASSES_SQL},
    hit AS (SELECT coordinates, rank, min(ord) AS ord FROM classes JOIN artifacts USING (coordinates) WHERE fqn = 'com.acme.economy.SmallRing' GROUP BY ALL)
    SELECT first(coordinates ORDER BY rank) AS coordinates, array_to_string((list(coordinates ORDER BY rank))[2:], ',') AS alternatives FROM hit HAVING count(*) > 0""")
def locate_class(spark, sf_dir):
    """The artifact that answers for a class, and the later ones that declare it."""
    return search.locate(class_entries(spark, sf_dir), "com.acme.economy.SmallRing").select("coordinates", F.array_join("alternatives", ",").alias("alternatives"))


_HITS_SQL = lambda q: f"""{_CLASSES_SQL}, {scored_sql("classes", "ord", "fqn", q)},
    tiers AS (SELECT coordinates, fqn, rank, ord, CASE WHEN fqn = '{q}' THEN 0 WHEN regexp_replace(fqn, '^.*\\.', '') = '{q}' THEN 2 ELSE 3 END AS tier FROM classes JOIN artifacts USING (coordinates)),
    hits AS (SELECT *, 0 AS score FROM tiers WHERE tier < 3 UNION ALL (SELECT t.*, s.score FROM tiers t JOIN scored s ON s.key = t.ord WHERE tier = 3 ORDER BY s.score DESC, rank, ord LIMIT 20)),
    once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY coordinates, fqn ORDER BY tier, score DESC, rank, ord) = 1)"""  # noqa: E731


@query(f"""WITH RECURSIVE {_HITS_SQL("BlueBolt")}, numbered AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, rank, ord) AS k FROM once)
    SELECT coordinates, fqn, split_part(coordinates, ':', -1) AS version, CASE WHEN ord % 4 = 0 THEN 'source' ELSE 'decompiled' END AS provenance, tier::INTEGER AS tier, score::INTEGER AS score,
      CASE WHEN k <= 24 AND starts_with(fqn, 'com.acme.promo') THEN 'interface' ELSE 'class' END AS kind FROM numbered""")
def find_class_kinds(spark, sf_dir):
    """A search over all tiers with versions, what reading would yield, and the kinds of the first hits from their declarations."""
    entries = class_entries(spark, sf_dir)
    kind = F.when(F.startswith("fqn", F.lit("com.acme.promo")), "interface").otherwise("class")
    declared = entries.select("coordinates", "fqn", F.substring_index("fqn", ".", -1).alias("selector"), kind.alias("kind"), F.col("entry_ord").alias("line_start"))
    hits = search.find_class(entries, "BlueBolt", jvm=True, declarations=declared)
    return hits.select("coordinates", "fqn", "version", "provenance", "tier", "score", "kind")


@query(f"""WITH RECURSIVE {_HITS_SQL("RedRing")} SELECT fqn, coordinates, (SELECT count(*) FROM artifacts) AS searched FROM once""")
def miss_suggestions(spark, sf_dir):
    """A class that is not there: the search for its simple name, over all entries, finds it in other packages and what is
    spelled nearly so."""
    entries = class_entries(spark, sf_dir)
    return search.miss(entries, "org.elsewhere.RedRing", entries.select("coordinates").distinct()).select("fqn", "coordinates", "searched")


@query(f"""WITH {_ARTIFACTS_SQL}, asked AS (SELECT coordinates AS q FROM artifacts WHERE rank % 3 = 0 UNION SELECT split_part(coordinates, ':', 2) FROM artifacts UNION SELECT 'Brand-' || p_size FROM part)
    SELECT q, n, CASE WHEN n = 1 THEN 'unique' WHEN n = 0 THEN 'unknown artifact' ELSE 'ambiguous artifact' END AS status, CASE WHEN n = 1 THEN c END AS coordinates FROM (
      SELECT q, CASE WHEN max(a.coordinates = q) THEN 1 ELSE count(a.coordinates) END AS n, coalesce(max(CASE WHEN a.coordinates = q THEN q END), min(a.coordinates)) AS c
      FROM asked LEFT JOIN artifacts a ON a.coordinates = q OR split_part(a.coordinates, ':', 2) = q GROUP BY q)""")
def artifact_id_resolution(spark, sf_dir):
    """What each of many queries means among the artifacts: whole coordinates, an id that one of them has, or none."""
    artifacts = class_entries(spark, sf_dir).select("coordinates", "artifact_rank").distinct()
    part = table(spark, sf_dir, "part")
    by_size = part.select(F.concat(F.lit("Brand-"), F.col("p_size").cast("string")).alias("q"))
    asked = artifacts.filter("artifact_rank % 3 = 0").select(F.col("coordinates").alias("q")).unionByName(artifacts.select(names.artifact_id(F.col("coordinates")).alias("q"))).unionByName(by_size)
    return search.resolve_artifacts(artifacts, asked)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, fqn, selector, kind, visibility, params, signature, javadoc, line_start, line_end, doc_start, receiver): orders as members
    of a class for each customer, with overloads, kinds and comments."""
    number = F.col("o_orderkey")
    kind = F.when(number % 5 == 0, "field").when(number % 5 == 1, "constructor").when(number % 5 == 2, "class").otherwise("method")
    params = F.when(number % 5 >= 3, F.array_repeat(F.lit("java.lang.String"), (number % 3).cast("int")))
    line = (number % 1000 + 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.lit("x").alias("path"), F.concat(F.lit("com.acme.Customer"), (F.col("o_custkey") % 50).cast("string")).alias("fqn"), F.concat(F.lit("member"), (number % 7).cast("string")).alias("selector"), kind.alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "public").otherwise("private").alias("visibility"), params.alias("params"), F.col("o_orderpriority").alias("signature"), F.col("o_orderstatus").alias("javadoc"),
        line.alias("line_start"), line.alias("line_end"), line.alias("doc_start"), F.when(number % 2 == 0, "kotlin.List").alias("receiver"), number.alias("ord"),
    )


_MEMBERS_SQL = """members AS (SELECT o_orderkey AS ord, 'com.acme.Customer' || o_custkey % 50 AS fqn, 'member' || o_orderkey % 7 AS selector, o_orderkey % 3 AS arity, o_orderkey % 1000 + 1 AS line,
    CASE o_orderkey % 5 WHEN 0 THEN 'field' WHEN 1 THEN 'constructor' WHEN 2 THEN 'class' ELSE 'method' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'public' ELSE 'private' END AS visibility,
    o_orderpriority AS signature, o_orderstatus AS javadoc, o_orderkey % 2 = 0 AS extends FROM orders)"""


@query(f"WITH {_MEMBERS_SQL} SELECT ord, fqn, selector, kind, NULL::VARCHAR AS javadoc FROM members WHERE (fqn = 'com.acme.Customer7' OR starts_with(fqn, 'com.acme.Customer7.')) AND kind <> 'field' AND visibility = 'public'")
def outline_minimal(spark, sf_dir):
    """The members of a class that the least preset shows, of one visibility."""
    return search.outline(members(spark, sf_dir), "com.acme.Customer7", "minimal", visibility="public").select("ord", "fqn", "selector", "kind", "javadoc")


@query(f"""WITH {_MEMBERS_SQL} SELECT ord, fqn, selector, kind, javadoc FROM members WHERE fqn = 'com.acme.Customer7' AND kind = 'method'""")
def outline_of_kind(spark, sf_dir):
    """A kind is a plain filter: the class's own row goes too."""
    return search.outline(members(spark, sf_dir), "com.acme.Customer7", kind="method").select("ord", "fqn", "selector", "kind", "javadoc")


@query(f"""WITH {_MEMBERS_SQL}, own AS (SELECT * FROM members WHERE fqn = 'com.acme.Customer7'),
    found AS (
      SELECT 0 AS selector_ord, * FROM own WHERE selector = 'member3' AND kind = 'method' AND arity = 2
      UNION ALL SELECT 1, * FROM own WHERE selector = 'member4' AND extends)
    SELECT selector_ord, selector || CASE WHEN kind = 'method' THEN '(' || array_to_string(list_transform(range(arity), lambda i: 'String'), ',') || ')' ELSE '' END AS selector, signature, 0 AS first, 0 AS last FROM found""")
def read_member_signatures(spark, sf_dir):
    """Members that selectors name, by parameter types and by receiver, where only signatures are at hand."""
    rows = members(spark, sf_dir)
    files = spark.createDataFrame([], "path string, text string")
    slices, _ = search.read_member(rows, files, "com.acme.Customer7", "#member3(String,java.lang.String), #List.member4", degraded="no source available")
    return slices.select("selector_ord", "selector", "signature", "first", "last")


@query("""WITH arts AS (SELECT s_suppkey, 'g:s' || s_suppkey || ':1' AS coordinates, CASE WHEN s_suppkey % 2 = 0 THEN '/r/' || s_suppkey || '-sources.jar' END AS a, CASE WHEN s_suppkey % 7 = 0 THEN '/src/' || s_suppkey END AS b, '/r/' || s_suppkey || '.jar' AS c FROM supplier),
    slots AS (SELECT coordinates, 0 AS ord, 'sourcesJar' AS slot, a AS path FROM arts UNION ALL SELECT coordinates, 1, 'sourceDir', b FROM arts UNION ALL SELECT coordinates, 2, 'binaryJar', c FROM arts),
    there AS (SELECT DISTINCT '/r/' || l_suppkey || '.jar' AS path FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08 UNION SELECT '/src/' || s_suppkey FROM supplier WHERE s_acctbal > 5000)
    SELECT coordinates, ord, slot, path, path IN (FROM there) AS exists, NOT bool_or(path IN (FROM there)) OVER (PARTITION BY coordinates) AS all_missing FROM slots WHERE path IS NOT NULL""")
def where_paths(spark, sf_dir):
    """What each artifact has, in the fixed order, what of it exists, and artifacts that are gone."""
    key = F.col("s_suppkey").cast("string")
    supplier = table(spark, sf_dir, "supplier")
    arts = supplier.select(F.concat(F.lit("g:s"), key, F.lit(":1")).alias("coordinates"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/r/"), key, F.lit("-sources.jar"))).alias("sourcesJar"),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("/src/"), key)).alias("sourceDir"), F.concat(F.lit("/r/"), key, F.lit(".jar")).alias("binaryJar"))
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity > 49 and l_discount > 0.08").select(F.concat(F.lit("/r/"), F.col("l_suppkey").cast("string"), F.lit(".jar")).alias("path")).distinct()
    there = sold.unionByName(supplier.filter("s_acctbal > 5000").select(F.concat(F.lit("/src/"), key).alias("path")))
    return catalog.where(arts, there).select("coordinates", "ord", "slot", "path", "exists", "all_missing")


@query("""WITH c AS (SELECT p_type, p_size, CASE p_size % 4 WHEN 0 THEN 'kapt' WHEN 1 THEN 'test' WHEN 2 THEN 'my' ELSE '' END || p_type || CASE p_size % 3 WHEN 0 THEN 'runtimeClasspath' WHEN 1 THEN 'compileClasspath' ELSE 'CompileKapt' END AS name FROM part)
    SELECT name, CASE WHEN starts_with(name, 'kapt') OR contains(name, 'annotationProcessor') THEN 'annotationProcessor' WHEN contains(name, 'test') THEN 'test' WHEN contains(name, 'compile') THEN 'compile'
      WHEN contains(name, 'runtime') THEN 'runtime' ELSE 'compile' END AS label, count(*) AS n FROM c GROUP BY ALL""")
def configuration_labels(spark, sf_dir):
    size = F.col("p_size")
    name = F.concat(F.when(size % 4 == 0, "kapt").when(size % 4 == 1, "test").when(size % 4 == 2, "my").otherwise(""), "p_type", F.when(size % 3 == 0, "runtimeClasspath").when(size % 3 == 1, "compileClasspath").otherwise("CompileKapt"))
    counted = table(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return counted.select("name", catalog.configuration_label(F.col("name")).alias("label"), "n")


@query("""SELECT n_name, 'module:' || regexp_replace(r_name || ' ' || n_nationkey, '[^A-Za-z0-9_-]+', '_', 'g') || '-' || substr(sha256('/work/' || r_name || ' ' || n_nationkey), 1, 8) || ':' || CASE WHEN n_nationkey % 4 = 0 THEN 'root' ELSE n_name END AS coordinates
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def module_names(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    project = F.concat(F.lit("/work/"), "r_name", F.lit(" "), F.col("n_nationkey").cast("string"))
    label = F.when(F.col("n_nationkey") % 4 == 0, ":").otherwise(F.concat(F.lit(":"), "n_name"))
    return rows.select("n_name", catalog.module_coordinates(project, label).alias("coordinates"))


@query("""WITH lines AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN concat(c_name, chr(9), '(vanished)') ELSE concat(c_name, chr(9), c_custkey, chr(9), c_nationkey) END AS line FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT sha256(array_to_string(list_sort(list(line)), chr(10))) AS fingerprint FROM lines""")
def fingerprint_build_files(spark, sf_dir):
    """The hash over build files' lines; a project has few, so they are gathered."""
    size = F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey"))
    files = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("path"), size.alias("size"), F.col("c_nationkey").alias("mtime"))
    return catalog.fingerprint(files)


@query(f"""WITH {_MEMBERS_SQL}, types AS (SELECT ord, fqn, selector FROM members WHERE kind = 'class'), own AS (SELECT DISTINCT fqn || '.' || selector AS c FROM types WHERE ord % 3 = 0)
    SELECT ord, fqn, selector FROM types WHERE ord % 3 <> 0 AND fqn || '.' || selector NOT IN (FROM own) UNION ALL SELECT ord, fqn || '.' || selector, selector FROM types WHERE ord % 3 = 0""")
def shadowed_members(spark, sf_dir):
    """Member rows go that stand for a class with a row of its own."""
    types = members(spark, sf_dir).filter("kind = 'class'").select("ord", F.when(F.col("ord") % 3 == 0, F.concat_ws(".", "fqn", "selector")).otherwise(F.col("fqn")).alias("fqn"), "selector", "kind")
    return search.shadowed(types).select("ord", "fqn", "selector")


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "benchmark", "embeddings"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _COUNTED))
def status_counts(spark, sf_dir):
    """Rows of every table; Parquet's own counts answer this, no column is read."""
    out = None
    for t in _COUNTED:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


@query("""WITH roots AS (SELECT c_nationkey AS nation, c_acctbal AS balance, c_name AS name, 0 AS root FROM customer UNION ALL SELECT s_nationkey, s_acctbal, s_name, 1 FROM supplier)
    SELECT nation, first(name ORDER BY root, balance DESC, name) AS name, first(root ORDER BY root, balance DESC, name)::INTEGER AS root FROM roots GROUP BY nation""")
def union_dedup_roots(spark, sf_dir):
    """Two roots, the first preferred, the first row of each key kept: an aggregation, so no window sorts a hot key."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.lit(0).alias("root"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.lit(1).alias("root"))
    first = F.min(F.struct("root", (-F.col("balance")).alias("least"), "name"))
    return customer.unionByName(supplier).groupBy("nation").agg(first.alias("first")).select("nation", "first.name", "first.root")
