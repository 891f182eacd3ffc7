"""Declarations of source files as rows, out of their statements.

A statement at the depth of a class's members is a type, a member, or both (a Kotlin class with properties in its header);
what it declares is read off its header by regular expressions, after parameters (by folds) and declarators (in one pass, as
a list of constants may be as long as its file) have been parted outside of brackets. Which block a statement stands in, and where the block it opens is closed, is the last and the next row of
that depth in its file; classes get their full names by one fold over a file's classes.

Not found: what stands inside blocks that are no types (local classes, bodies of enum constants), and members of a file
after a bracket that is never closed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodeframe.functions import text as T
from lodeframe.functions.brackets import cut_top_level, in_parentheses, split_top_level

from .statements import DEPRECATED, DOC, newlines, statements

#: Words that may stand before a declaration, and words that begin a statement which is none.
_JAVA_WORDS = "public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed"
_KOTLIN_WORDS = "public|protected|private|internal|open|abstract|final|sealed|data|inner|companion|inline|value|annotation|enum|override|lateinit|const|suspend|operator|infix|tailrec|external|expect|actual|vararg|noinline|crossinline"
_OTHERS = "return|throw|new|else|if|for|while|do|switch|case|try|catch|finally|break|continue|assert|yield|package|import|super|this"
_MARKS = f"{DOC}{DEPRECATED}"
_ANGLES = r"<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)*>"
_KOTLIN_NAME = r"(`[^`]+`|[A-Za-z_]\w*)"
#: What a Kotlin function or property belongs to, with its dot.
_OWNER = rf"(?:((?:\([^()]*\)|[\w.]+(?:{_ANGLES})?)\??)\s*\.\s*)?"

MEMBERS = (
    "array<struct<selector: string, kind: string, words: array<string>, visibility: string, signature: string, params: array<string>, receiver: string,"
    " line: int, last: int, marks: int, deprecated: boolean, of_own: boolean>>"
)


def _kept(build: Callable[[], object]) -> Callable[[], object]:
    """build, called once an application: expressions over names of columns are the same in every plan."""
    of = functools.lru_cache(maxsize=2)(lambda application: build())
    return lambda: of(SparkSession.active().sparkContext.applicationId)


def tight(text: Column) -> Column:
    """text with blanks only between words, and after ? before a word."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, rf"[\s{_MARKS}]+", " ")), r"\s*([^\w\s$?`])\s*", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"\s*\?\s*", "?"), r"\?(?=[\w$])", "? ")


def kotlin_tight(text: Column) -> Column:
    """text with blanks between words, after commas and colons and around arrows."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, rf"[\s{_MARKS}]+", " ")), r"\s*([^\w\s`])\s*", "$1")
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r",(?![),])", ", "), r"(?<=\w):", " :"), r":(?![),])", ": ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, "->", " -> "), r"\( -> ", "(-> "), r"\bsuspend\(", "suspend (")


def _spaced(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with blanks between them."""
    return F.array_join(F.array_remove(F.array_compact(F.array(*parts)), ""), " ")


def _without_name(param: Column) -> Column:
    """The type of a parameter as Java writes it: modifiers and the name go, brackets after the name stay."""
    bare = tight(F.regexp_replace(param, rf"\b(?:{_JAVA_WORDS})\b\s", " "))
    named = F.regexp_extract(bare, r"^(.*[\w$].*?)(?<=[\s>\]?.])[A-Za-z_$][\w$]*((?:\[\])*)$", 1)
    return F.when(named != "", F.concat(F.trim(named), F.regexp_extract(bare, r"((?:\[\])*)$", 1))).otherwise(bare)


def java_params(body: Column) -> Column:
    """Types of a parameter list as it is written."""
    return F.array_remove(F.transform(split_top_level(body), _without_name), "")


def kotlin_params(body: Column) -> Column:
    """Types of a Kotlin parameter list; vararg and its like stay with them."""
    bare = F.transform(split_top_level(body), lambda p: F.regexp_replace(p, rf"[\s{_MARKS}]+", " "))
    words = F.transform(bare, lambda p: F.struct(p.alias("p"), F.array_join(F.regexp_extract_all(F.regexp_extract(p, r"^([^:]*):", 1), F.lit(r"\b(vararg|noinline|crossinline)\b"), F.lit(1)), " ").alias("w")))
    typed = F.transform(words, lambda x: _spaced(x["w"], kotlin_tight(F.regexp_replace(F.regexp_extract(x["p"], r"(?s)^[^:]*:(.*)$", 1), r"(?s)(?<![=!<>])=(?!=).*$", ""))))
    return F.array_remove(typed, "")


def _located(parts: Column, line: Column) -> Column:
    """Of each part of a statement that begins on line: part, the line of its first word, marks up to it, the line of its end.
    parts know what comes before each of them, so that none reads another."""
    def place(p: Column, k: Column) -> Column:
        lead = F.regexp_extract(p["part"], rf"^([\s{_MARKS}]*)", 1)
        first = line + p["lines"] + F.when(k > 0, newlines(lead)).otherwise(0)
        return F.struct(p["part"].alias("part"), first.cast("int").alias("line"), (p["marks"] + _docs_in(lead)).cast("int").alias("marks"), F.contains(lead, F.lit(DOC)).alias("told"),
                        F.contains(lead, F.lit(DEPRECATED)).alias("deprecated"), (line + p["lines"] + newlines(p["part"])).cast("int").alias("last"))

    return F.transform(parts, place)


def _docs_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(DOC), F.lit("")))


def _member(selector: Column, kind: Column | str, words: Column, visibility: Column, signature: Column, params: Column | None = None, receiver: Column | None = None, line: Column | None = None, last: Column | None = None, marks: Column | None = None, deprecated: Column | None = None, of_own: bool = False) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    fields = {
        "selector": selector, "kind": F.lit(kind) if isinstance(kind, str) else kind, "words": words, "visibility": visibility, "signature": signature, "params": none("array<string>") if params is None else params,
        "receiver": none("string") if receiver is None else receiver, "line": F.col("line_start") if line is None else line, "last": none("int") if last is None else last,
        "marks": F.col("marks") if marks is None else marks, "deprecated": F.col("deprecated") if deprecated is None else deprecated, "of_own": F.lit(of_own),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _headers(rows: DataFrame) -> DataFrame:
    """rows of statements() with words (modifiers), rest (their code without them), and what a type declaration names."""
    k = F.col("kotlin")
    lead = lambda words: rf"(?s)^([\s{_MARKS}]*(?:(?:{words})\b(?!\s*[(=.:])[\s{_MARKS}]*)*)(.*)$"
    head = lambda n: F.when(k, F.regexp_extract("code", lead(_KOTLIN_WORDS + "|fun(?=[\\s]+interface\\b)"), n)).otherwise(F.regexp_extract("code", lead(_JAVA_WORDS), n))
    words = F.when(k, F.regexp_extract_all("header", F.lit(rf"\b({_KOTLIN_WORDS}|fun)\b"), F.lit(1))).otherwise(F.regexp_extract_all("header", F.lit(rf"(non-sealed|\b(?:{_JAVA_WORDS})\b)"), F.lit(1)))
    split = rows.withColumns({"header": head(1), "rest": F.trim(head(2))}).withColumns({"words": words, "marks": _docs_in(F.regexp_extract("code", rf"^([\s{_MARKS}]*)", 1))})
    java = r"^(class|interface|enum|record|@\s*interface)\s+([A-Za-z_$][\w$]*)"
    kotlin = rf"^(class|interface|object)\b(?:\s*{_KOTLIN_NAME})?"
    kind, name = F.when(k, F.regexp_extract("rest", kotlin, 1)).otherwise(F.regexp_extract("rest", java, 1)), F.when(k, F.regexp_extract("rest", kotlin, 2)).otherwise(F.regexp_extract("rest", java, 2))
    known = split.withColumns({"word": F.nullif(F.regexp_replace(kind, r"\s", ""), F.lit("")), "name": name})
    named = known.withColumn("name", F.when((F.col("word") == "object") & F.col("name").isin("", "companion") & F.array_contains("words", "companion"), "Companion").otherwise(F.replace("name", F.lit("`"), F.lit(""))))
    record = (F.col("word") != "record") | F.rlike("rest", F.lit(r"^record\s+[\w$]+\s*[(<]"))
    is_type = F.col("word").isNotNull() & (F.col("name") != "") & record & F.when(k, F.lit(True)).otherwise(F.coalesce(F.col("ends") == "{", F.lit(False)))
    shown = F.when(F.col("word") == "@interface", "annotation").when(F.col("word") == "object", "object").when(k & F.array_contains("words", "annotation"), "annotation").when(k & F.array_contains("words", "enum"), "enum").otherwise(F.col("word"))
    before_call = F.regexp_extract("code", r"(?s)^([^(=]*)", 1)
    return named.withColumns({"type_kind": F.when(is_type, shown), "deprecated": F.contains(before_call, F.lit(DEPRECATED))})


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows of _headers() with the statement that opens the block around each (around), the line on which the block is
    closed that it opens itself (closed), the two statements after it in the same block (following), and the last before it
    that does not begin with a comma (led)."""
    at = lambda level, role: F.struct(F.lit(role).alias("role"), (F.col("depth") + level).alias("level"))
    events = rows.withColumn("event", F.explode(F.array_compact(F.array(at(0, "own"), F.when(F.col("ends") == "{", at(1, "open")), F.when(F.col("ends") == "}", at(-1, "close")))))).select("*", "event.*").drop("event")
    order = Window.partitionBy("path", "level").orderBy("id")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path", "level").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    is_own = F.col("role") == "own"
    met = events.withColumns({
        "around": F.last(F.when(F.col("role") == "open", F.col("id")), ignorenulls=True).over(upto), "closed": F.last(F.when(F.col("role") == "close", F.col("line_end")), ignorenulls=True).over(after),
    }).filter(is_own)
    sibling = Window.partitionBy("path", "level", "around").orderBy("id")
    end = F.when(F.col("ends") == "{", F.col("closed")).otherwise(F.coalesce(F.when(F.col("ends") == ";", F.col("line_end")), "line_last", "line_end"))
    nxt = F.struct(F.trim(F.col("rest")).alias("rest"), end.alias("end"), F.col("ends"))
    told = F.when((F.trim(F.col("rest")) != "") | ~F.col("kotlin"), nxt)
    following = F.slice(F.collect_list(told).over(sibling.rowsBetween(1, 6)), 1, 2)
    led = F.last(F.when(~F.startswith(F.trim(F.col("rest")), F.lit(",")) & (F.trim(F.col("rest")) != ""), F.struct("code", "words")), ignorenulls=True).over(sibling.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumns({"following": following, "led": led}).drop("role", "level")


def _named_types(rows: DataFrame) -> DataFrame:
    """(path, package, known) of files: known has id, fqn, kind, name and params of the types that no block but types'
    encloses. One row a file, put together by a fold over its types."""
    package = F.max(F.when(F.rlike("rest", F.lit(r"^package\b")) & (F.col("depth") == 0), F.regexp_replace(F.regexp_extract("rest", r"^package\s+([^;]+)", 1), r"[\s`]", "")))
    header = in_parentheses(F.regexp_replace("rest", rf"(?s)^\w+\s+[\w$]+\s*(?:{_ANGLES})?", ""))["body"]
    record = F.when(F.col("type_kind") == "record", java_params(header))
    every = F.array_sort(F.collect_list(F.when(F.col("type_kind").isNotNull(), F.struct("id", "depth", "around", "name", F.col("type_kind").alias("kind"), record.alias("params")))))
    files = rows.groupBy("path").agg(package.alias("package"), every.alias("types"))
    start = F.array().cast("array<struct<id: bigint, fqn: string, kind: string, name: string, params: array<string>>>")

    def step(known: Column, t: Column) -> Column:
        outer = F.element_at(F.filter(known, lambda o: o["id"] == t["around"]), 1)
        fqn = F.when(t["depth"] == 0, F.concat_ws(".", "package", t["name"])).when(F.size(F.filter(known, lambda o: o["id"] == t["around"])) > 0, F.concat_ws(".", outer["fqn"], t["name"]))
        return F.when(fqn.isNull(), known).otherwise(F.concat(known, F.array(F.struct(t["id"].alias("id"), fqn.alias("fqn"), t["kind"].alias("kind"), t["name"].alias("name"), t["params"].alias("params")))))

    return files.withColumn("known", F.aggregate("types", start, step)).select("path", F.coalesce("package", F.lit("")).alias("package"), "known")


def _field_type(code: Column) -> Column:
    """The type of the declarators of a statement's code; empty if it has none."""
    first = F.regexp_replace(F.regexp_replace(code, rf"(?s)^[\s{_MARKS}]*(?:(?:{_JAVA_WORDS})\b[\s{_MARKS}]*)*", ""), r"(?s)=.*$", "")
    one = F.regexp_replace(first, rf"(?s)^((?:[^<>,]|{_ANGLES})*),.*$", "$1")
    kind = F.trim(F.regexp_extract(tight(one), r"^(.*[\w$>\]?])\s?(?<=[\s>\]])[A-Za-z_$][\w$]*(?:\[\])*$", 1))
    return F.when(F.rlike(kind, F.lit(r"^[A-Za-z_$][\w$.<>\[\],?& ]*$")) & ~F.rlike(kind, F.lit(rf"^(?:{_OTHERS})\b")), kind).otherwise("")


@_kept
def _part_columns() -> list[dict[str, Column]]:
    """What members are made of, each computed once, in the order in which one needs the other: what stands in parentheses,
    the types of parameters, and declarators with their places. What is told of each declarator reads columns and its own
    part only, as a statement may have as many as its file has lines."""
    rest, k, is_type = F.col("rest"), F.col("kotlin"), F.col("type_kind").isNotNull()
    after_name = F.regexp_replace(rest, rf"(?s)^\w+\s*(?:{_KOTLIN_NAME})?\s*(?:{_ANGLES})?\s*(?:(?:public|private|protected|internal)\s+)*(?:constructor\b)?", "")
    header = F.when(F.rlike(after_name, F.lit(r"^\s*\(")), in_parentheses(after_name))
    signed = F.trim(F.regexp_replace(rest, rf"(?s)^(?:fun|val|var)\s*(?:{_ANGLES})?\s*", ""))
    call = in_parentheses(F.substring(F.col("signed"), F.length(F.regexp_extract("signed", rf"(?s)^{_OWNER}{_KOTLIN_NAME}\s*", 0)) + 1, 1 << 30))
    record = in_parentheses(F.regexp_replace(rest, rf"(?s)^\w+\s+[\w$]+\s*(?:{_ANGLES})?", ""))
    inner = F.when(k & is_type, header).when(k & F.rlike(rest, F.lit(r"^fun\b")), call).when(k & F.rlike(rest, F.lit(r"^constructor\b")), in_parentheses(rest))
    inner = inner.when(~k & is_type & (F.col("type_kind") == "record"), record).when(~k & ~is_type & F.rlike(rest, F.lit(r"(?s)^[^(=]*\(")), in_parentheses(rest))
    begins = F.col("line_start") - newlines(F.regexp_extract("code", rf"^([\s{_MARKS}]*)", 1))
    in_header = F.col("line_start") + newlines(F.regexp_replace(F.regexp_extract("code", r"(?s)^([^(]*\()", 1), rf"^[\s{_MARKS}]*", ""))
    listing = (F.col("outer_kind") == "enum") & ~F.col("listed")
    is_list = ~is_type & (listing | (~k & F.col("outer_kind").isNotNull() & F.col("inner").isNull()))
    typed = {
        "params": F.when(F.col("inner").isNotNull(), F.when(k, kotlin_params(F.col("inner.body"))).otherwise(java_params(F.col("inner.body")))),
        "parts": cut_top_level(F.when(is_list, F.col("code")).when(k & is_type, F.col("inner.body")), DOC),
        "field_type": F.when(is_list & ~k, _field_type(F.when(F.startswith(F.trim(rest), F.lit(",")), F.col("led.code")).otherwise(F.col("code")))),
        "begins": F.when(is_list, begins).otherwise(in_header), "goes_on": F.startswith(F.trim(rest), F.lit(",")),
    }
    return [{"signed": F.when(k, signed)}, {"inner": inner}, typed, {"parts": _located(F.col("parts"), F.col("begins"))}]


@_kept
def _java_members() -> Column:
    """What a statement in a Java type declares."""
    outer, rest, words, params = F.col("outer_name"), F.col("rest"), F.col("words"), F.col("params")
    visibility_of = lambda w: F.coalesce(*[F.when(F.array_contains(w, v), v) for v in ("public", "protected", "private")], F.lit("package"))
    visibility, mods = visibility_of(words), F.array_join(words, " ")
    type_params = F.regexp_extract(rest, rf"(?s)^(?:@\s*)?\w+\s+[\w$]+\s*({_ANGLES})", 1)
    record = F.when(F.size(params) > 0, F.concat(F.lit("("), F.array_join(params, ","), F.lit(")"))).otherwise("")
    a_type = _member(F.col("name"), F.col("type_kind"), words, visibility, _spaced(mods, F.concat(F.col("word"), F.lit(" "), F.col("name"), tight(type_params), record)), of_own=True)

    head = F.regexp_extract(rest, r"(?s)^([^(=]*)\(", 1)
    called = F.regexp_extract(head, r"(?s)([A-Za-z_$][\w$]*)\s*$", 1)
    returned = tight(F.regexp_extract(head, r"(?s)^(.*?)[A-Za-z_$][\w$]*\s*$", 1))
    generic = F.regexp_extract(returned, rf"^({_ANGLES})", 1)
    result = F.trim(F.substring(returned, F.length(generic) + 1, 1 << 30))
    listed = F.concat(called, F.lit("("), F.array_join(params, ","), F.lit(")"))
    typed = F.rlike(result, F.lit(r"^[A-Za-z_$][\w$.<>\[\],?& ]*$")) & ~F.rlike(result, F.lit(rf"^(?:{_OTHERS})\b"))
    method = _member(called, "method", words, visibility, _spaced(mods, generic, F.concat(result, F.lit(" "), listed)), params)
    constructor = _member(called, "constructor", words, visibility, _spaced(mods, listed), params)
    own_params = F.coalesce("outer_params", F.array().cast("array<string>"))
    compact = _member(outer, "constructor", words, visibility, _spaced(mods, F.concat(outer, F.lit("("), F.array_join(own_params, ","), F.lit(")"))), own_params)

    parts, goes_on, before = F.col("parts"), F.col("goes_on"), F.startswith(F.get("following", F.lit(0))["rest"], F.lit(","))
    end = F.when(F.col("ends") == "{", F.when(F.coalesce(before, F.lit(False)), F.col("closed")).otherwise(F.get("following", F.lit(0))["end"])).otherwise(F.col("line_end"))
    of = F.when(goes_on, F.col("led.words")).otherwise(words)
    lead = rf"(?s)^[\s{_MARKS}]*(?:(?:{_JAVA_WORDS})\b[\s{_MARKS}]*)*"

    def field(p: Column, k: Column) -> Column:
        first = (k == 0) & ~goes_on
        named = tight(F.regexp_replace(F.when(first, F.regexp_replace(p["part"], lead, "")).otherwise(p["part"]), r"(?s)=.*$", ""))
        name, dims = F.regexp_extract(named, r"([A-Za-z_$][\w$]*)(?:\[\])*$", 1), F.regexp_extract(named, r"((?:\[\])*)$", 1)
        return _member(name, "field", of, visibility_of(of), _spaced(F.array_join(of, " "), F.col("field_type"), F.concat(name, dims)), line=F.when(first, F.col("line_start")).otherwise(p["line"]), last=F.when(k == F.size(parts) - 1, end).otherwise(p["last"]).cast("int"))

    fields = F.filter(F.transform(parts, field), lambda m: m["selector"] != "")
    constant = F.regexp_extract(F.trim(F.regexp_replace(F.get(parts, F.lit(0))["part"], f"[{_MARKS}]", "")), r"(?s)^\s*([A-Za-z_$][\w$]*)\s*(?:\(.*)?$", 1)
    is_constants = (F.col("outer_kind") == "enum") & ~F.col("listed") & ((constant != "") | goes_on)
    none = F.array().cast(MEMBERS)
    out = F.when(F.col("type_kind").isNotNull(), F.array(a_type)).when(F.col("outer_kind").isNull(), none).when(is_constants, _constants(parts, end))
    out = out.when((F.col("outer_kind") == "record") & (F.trim(rest) == outer) & (F.col("ends") == "{"), F.array(compact))
    out = out.when((called != "") & (returned == "") & (called == outer), F.array(constructor)).when((called != "") & typed, F.array(method))
    return out.when((called == "") & (F.col("field_type") != ""), fields).otherwise(none)


def _constants(parts: Column, end: Column) -> Column:
    """Enum constants of a statement's parts."""

    def constant(p: Column, k: Column) -> Column:
        name = F.regexp_extract(F.regexp_replace(p["part"], f"[{_MARKS}]", ""), r"^\s*([A-Za-z_$][\w$]*)", 1)
        last = F.when(k == F.size(parts) - 1, F.coalesce(F.when(F.col("ends").isin("{", ";"), end), F.col("line_last"))).otherwise(p["last"])
        return _member(name, "enum-constant", F.array().cast("array<string>"), F.lit("public"), name, line=F.greatest(p["line"], F.col("line_start")).cast("int"), last=last.cast("int"), marks=F.when(p["told"], p["marks"]).otherwise(0), deprecated=p["deprecated"])

    return F.filter(F.transform(parts, constant), lambda m: m["selector"] != "")


@_kept
def _kotlin_members() -> Column:
    """What a statement in a Kotlin type, or at the top of a Kotlin file, declares."""
    rest, words, params, signed = F.col("rest"), F.col("words"), F.col("params"), F.col("signed")
    visibility_of = lambda w: F.coalesce(*[F.when(F.array_contains(w, v), out) for v, out in (("protected", "protected"), ("private", "private"), ("internal", "package"))], F.lit("public"))
    visibility, shown = visibility_of(words), F.array_join(F.array_except(words, F.array(F.lit("public"))), " ")
    type_params = F.regexp_extract(rest, rf"(?s)^\w+\s+[\w`]+\s*({_ANGLES})", 1)
    header = F.coalesce(F.concat(F.lit("("), F.array_join(params, ","), F.lit(")")), F.lit(""))
    named = F.when((F.col("name") == "Companion") & ~F.rlike(rest, F.lit(r"^object\s+Companion\b")), "").otherwise(F.concat(F.lit(" "), F.col("name")))
    a_type = _member(F.col("name"), F.col("type_kind"), words, visibility, _spaced(shown, F.concat(F.col("word"), named, kotlin_tight(type_params), header)), of_own=True)
    property_form = rf"(?s)^[\s{_MARKS}]*((?:(?:{_KOTLIN_WORDS})\s+)*)(val|var)\s+{_KOTLIN_NAME}\s*:(.*)$"

    def in_header(p: Column) -> Column:
        mods = F.regexp_extract_all(F.regexp_extract(p["part"], property_form, 1), F.lit(r"(\w+)"), F.lit(1))
        name = F.replace(F.regexp_extract(p["part"], property_form, 3), F.lit("`"), F.lit(""))
        kind = kotlin_tight(F.regexp_replace(F.regexp_extract(p["part"], property_form, 4), r"(?s)=.*$", ""))
        return _member(name, "property", mods, visibility_of(mods), _spaced(F.array_join(mods, " "), F.regexp_extract(p["part"], property_form, 2), F.concat(name, F.lit(": "), kind)), line=p["line"], last=p["last"], marks=F.lit(0), deprecated=p["deprecated"], of_own=True)

    properties = F.coalesce(F.transform(F.filter("parts", lambda p: F.rlike(p["part"], F.lit(property_form))), in_header), F.array().cast(MEMBERS))

    generic = kotlin_tight(F.regexp_extract(rest, rf"(?s)^(?:fun|val|var)\s*({_ANGLES})", 1))
    fun = rf"(?s)^{_OWNER}{_KOTLIN_NAME}\s*\("
    receiver, name = F.nullif(kotlin_tight(F.regexp_extract(signed, fun, 1)), F.lit("")), F.replace(F.regexp_extract(signed, fun, 2), F.lit("`"), F.lit(""))
    returned = kotlin_tight(F.regexp_extract(F.col("inner.rest"), r"(?s)^\s*:\s*(.*?)\s*(?:(?<![=!<>])=(?!=).*|\bwhere\b.*)?$", 1))
    result = F.when(returned != "", F.concat(F.lit(": "), returned)).otherwise("")
    method = _member(name, "method", words, visibility, _spaced(shown, F.lit("fun"), generic, F.concat(F.coalesce(F.concat(receiver, F.lit(".")), F.lit("")), name, F.lit("("), F.array_join(params, ", "), F.lit(")"), result)), params, receiver)
    own = rf"(?s)^{_OWNER}{_KOTLIN_NAME}\s*(?::\s*(.*?))?\s*(?:(?<![=!<>])=(?!=).*|\bby\b.*|\b(?:get|set)\s*\(.*)?$"
    held = F.replace(F.regexp_extract(signed, own, 2), F.lit("`"), F.lit(""))
    of, kind = F.nullif(kotlin_tight(F.regexp_extract(signed, own, 1)), F.lit("")), kotlin_tight(F.regexp_extract(signed, own, 3))
    accessor = F.lit(r"^(?:get|set)\b")
    f0, f1 = F.get("following", F.lit(0)), F.get("following", F.lit(1))
    with_accessors = F.when(F.rlike(f0["rest"], accessor) & F.rlike(f1["rest"], accessor), f1["end"]).when(F.rlike(f0["rest"], accessor), f0["end"])
    a_property = _member(held, "property", words, visibility, _spaced(shown, F.regexp_extract(rest, "^(val|var)", 1), generic, F.concat(F.coalesce(F.concat(of, F.lit(".")), F.lit("")), held, F.when(kind != "", F.concat(F.lit(": "), kind)).otherwise(""))), receiver=of, last=with_accessors.cast("int"))
    constructor = _member(F.col("outer_name"), "constructor", words, visibility, _spaced(shown, F.concat(F.lit("constructor("), F.array_join(params, ", "), F.lit(")"))), params)
    init = _member(F.col("outer_name"), "constructor", words, visibility, F.lit("init"), F.array().cast("array<string>"))
    is_entries = (F.col("outer_kind") == "enum") & ~F.col("listed") & ~F.rlike(rest, F.lit(r"^(?:fun|val|var|init|constructor|class|interface|object)\b")) & F.rlike(rest, F.lit(r"^(?:[A-Za-z_]\w*|,)"))
    member_of = F.col("outer_kind").isNotNull()
    out = F.when(F.col("type_kind").isNotNull(), F.concat(F.array(a_type), properties)).when(is_entries, _constants(F.col("parts"), F.col("line_end")))
    out = out.when(F.rlike(rest, F.lit(r"^fun\b")) & (name != ""), F.array(method)).when(F.rlike(rest, F.lit(r"^(?:val|var)\b")) & (held != ""), F.array(a_property))
    out = out.when(member_of & F.rlike(rest, F.lit(r"^constructor\s*\(")), F.array(constructor)).when(member_of & F.rlike(rest, F.lit(r"^init\s*$")) & (F.col("ends") == "{"), F.array(init))
    return out.otherwise(F.array().cast(MEMBERS))


def scan_declarations(files: DataFrame) -> DataFrame:
    """(path, fqn, selector, kind, visibility, static, deprecated, signature, params, receiver, line_start, line_end,
    doc_start, javadoc).

    files: (path, text); `.kt` and `.kts` are Kotlin, all else is Java. A type's own row has its name as selector; its
    members carry its fqn. Functions and properties at the top of a Kotlin file are static members of a class that is
    named after it. A null text is empty; a file that is given twice has its rows twice under one path.
    """
    rows = _in_blocks(_headers(statements(files)))
    types = _named_types(rows)
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"(?i)\.kts?\z", "")
    facade = F.concat(F.when(F.regexp_replace(base, r"\W", "_") == "", "File").otherwise(F.regexp_replace(base, r"[^A-Za-z0-9_]", "_")), F.lit("Kt"))
    of = lambda number: F.get(F.filter("known", lambda t: t["id"] == F.col(number)), F.lit(0))
    joined = rows.filter(F.trim(F.col("rest")) != "").join(types, "path", "left").withColumns({"outer": of("around"), "own_fqn": of("id")["fqn"]}).drop("known")
    met = joined.select("*", *[F.col(f"outer.{c}").alias(f"outer_{c}") for c in ("fqn", "kind", "name", "params")]).drop("outer")
    # a type whose block is none of a known type's is left out, and so is what stands in any other block
    reached = F.when(F.col("type_kind").isNotNull(), F.col("own_fqn").isNotNull()).otherwise(F.col("outer_fqn").isNotNull() | (F.col("kotlin") & (F.col("depth") == 0)))
    order = Window.partitionBy("path", "around").orderBy("id")
    listed = F.coalesce(F.max(F.col("ends") == ";").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    known = met.filter(reached).withColumn("listed", listed)
    for columns in _part_columns():
        known = known.withColumns(columns)
    # each member takes its own comment along, not the statement's list of them
    told = lambda m: F.struct(m.alias("m"), F.when(m["marks"] > 0, F.get("docs", m["marks"] - 1)).alias("doc"))
    members = F.when(F.col("kotlin"), _kotlin_members()).otherwise(_java_members())
    each = known.withColumn("found", F.explode(F.transform(members, told))).select("*", "found.*").drop("found", "docs")
    end = F.coalesce("m.last", F.when(F.col("ends") == "{", F.coalesce("closed", "line_end")), F.when(F.col("ends") == ";", F.col("line_end")), "line_last")
    doc = F.col("doc")
    top = F.col("kotlin") & F.col("outer_fqn").isNull() & ~F.col("m.of_own")
    fqn = F.when(F.col("m.of_own"), F.col("own_fqn")).otherwise(F.coalesce("outer_fqn", F.concat_ws(".", F.nullif("package", F.lit("")), facade)))
    is_type = F.col("m.of_own") & F.col("type_kind").isNotNull() & (F.col("m.selector") == F.col("name")) & (F.col("m.kind") == F.col("type_kind"))
    in_interface = is_type & F.col("outer_kind").isin("interface", "annotation")
    static = F.array_contains("m.words", "static") | (F.col("m.kind") == "enum-constant") | top | in_interface | F.array_contains("m.words", "companion") | (~F.col("m.of_own") & (F.col("outer_kind") == "object") & (F.col("m.kind") != "constructor"))
    found = each.select(
        "path", fqn.alias("fqn"), F.col("m.selector").alias("selector"), F.col("m.kind").alias("kind"), F.col("m.visibility").alias("visibility"), F.coalesce(static, F.lit(False)).alias("static"),
        (F.col("m.deprecated") | F.coalesce(T.has_deprecated_tag(doc["text"]), F.lit(False))).alias("deprecated"), F.col("m.signature").alias("signature"), F.col("m.params").alias("params"), F.col("m.receiver").alias("receiver"),
        F.col("m.line").cast("int").alias("line_start"), end.cast("int").alias("line_end"), doc["line"].cast("int").alias("doc_start"), doc["text"].alias("javadoc"), top.alias("top"),
    )
    return _with_facades(found)


def _with_facades(found: DataFrame) -> DataFrame:
    """found with a row for each class that holds what stands at the top of a Kotlin file; drops top."""
    span = Window.partitionBy("path", "fqn")
    marked = found.withColumns({"first": F.when(F.col("top"), F.row_number().over(span.orderBy(F.col("top").desc(), "line_start", "selector")) == 1), "low": F.min(F.when(F.col("top"), F.col("line_start"))).over(span), "high": F.max(F.when(F.col("top"), F.col("line_end"))).over(span)})
    name = F.element_at(F.split("fqn", r"\."), -1)
    facade = F.struct(
        name.alias("selector"), F.lit("class").alias("kind"), F.lit("public").alias("visibility"), F.lit(False).alias("static"), F.lit(False).alias("deprecated"), F.concat(F.lit("class "), name).alias("signature"),
        F.lit(None).cast("array<string>").alias("params"), F.lit(None).cast("string").alias("receiver"), F.col("low").alias("line_start"), F.col("high").alias("line_end"), F.lit(None).cast("int").alias("doc_start"), F.lit(None).cast("string").alias("javadoc"),
    )
    own = F.struct("selector", "kind", "visibility", "static", "deprecated", "signature", "params", "receiver", "line_start", "line_end", "doc_start", "javadoc")
    return marked.withColumn("d", F.explode(F.when(F.coalesce(F.col("first"), F.lit(False)), F.array(facade, own)).otherwise(F.array(own)))).select("path", "fqn", "d.*")


def scan_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of files (path, text) whose blocks are not balanced: one is closed that is not open, or one is never
    closed; the first of each file's."""
    rows = statements(files)
    twice = F.min(F.when((F.col("ends") == "}") & (F.col("depth") == 0), F.col("line_end")))
    last = F.max_by(F.struct("depth", "ends"), "id")
    by_file = rows.groupBy("path").agg(last.alias("at"), twice.alias("twice"), F.max(F.when(F.col("ends") == "{", F.col("line_end"))).alias("open"))
    left = F.col("at.depth") + F.when(F.col("at.ends") == "{", 1).when(F.col("at.ends") == "}", -1).otherwise(0)
    problem = F.when(F.col("twice").isNotNull(), F.concat(F.lit("unbalanced braces at line "), F.col("twice").cast("string"), F.lit(": nothing is open to be closed")))
    problem = problem.when(left > 0, F.concat(F.lit("unbalanced braces at line "), F.col("open").cast("string"), F.lit(": block is never closed")))
    return by_file.select("path", problem.alias("problem")).filter("problem is not null")
