"""Name predicates and projections over dotted, slashed or $-nested names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dotted(name: Column) -> Column:
    """Canonical spelling: nesting and path marks become dots."""
    return F.translate(name, "$/", "..")


def simple_name(name: Column) -> Column:
    """What follows the last dot, and in it what follows the last $ that an identifier start follows."""
    last = F.substring_index(name, ".", -1)
    inner = F.regexp_extract(last, r"^.*\$([A-Za-z_].*)$", 1)
    return F.when(inner != "", inner).otherwise(last)


def entry_name(path: Column) -> Column:
    """Dotted name of an archive entry: no extension, slashes as dots."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def artifact_id(coordinates: Column) -> Column:
    """Second segment of group:artifact:version; null if there is none."""
    return F.get(F.split(coordinates, ":"), F.lit(1))


def version(coordinates: Column) -> Column:
    return F.element_at(F.split(coordinates, ":"), -1)


def is_exact(name: Column, query: Column) -> Column:
    return (name == query) | (dotted(name) == dotted(query))


def is_suffix(name: Column, query: Column) -> Column:
    """Whole trailing segments of the name; the query has a dot."""
    d, q = dotted(name), dotted(query)
    return F.contains(q, F.lit(".")) & ((d == q) | F.endswith(d, F.concat(F.lit("."), q)))


def is_family(name: Column, target: Column) -> Column:
    """The target itself or something nested in it."""
    d, t = dotted(name), dotted(target)
    return (d == t) | (F.startswith(d, F.concat(t, F.lit("."))) & (F.length(d) > F.length(t) + 1))


def parent_name(name: Column) -> Column:
    """Everything before the last segment; null for a name of one segment."""
    d = dotted(name)
    return F.when(F.contains(d, F.lit(".")), F.regexp_replace(d, r"\.[^.]*$", ""))


def is_class_entry(path: Column) -> Column:
    """Class files of named classes: no module or package description, no anonymous or synthetic class."""
    base = base_name(path)
    named = simple_name(F.regexp_replace(base, r"\.class$", ""))
    return F.endswith(path, F.lit(".class")) & ~base.isin("module-info.class", "package-info.class") & F.rlike(named, F.lit(r"^[A-Za-z_]")) & ~F.rlike(base, F.lit(r"\$[0-9]"))


def is_source_entry(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\.(java|kt)$")) & ~base_name(path).isin("module-info.java", "package-info.java")


def is_direct_nested(path: Column, outer: Column) -> Column:
    """Class files of what is nested in the class of entry outer (without .class) itself, not deeper and not anonymous."""
    tail = F.substring(path, F.length(outer) + 2, F.length(path))
    return F.startswith(path, F.concat(outer, F.lit("$"))) & F.rlike(tail, F.lit(r"^[A-Za-z_][^$]*\.class$"))


def is_cached_jar(path: Column) -> Column:
    """Files of an artifact cache that can be artifacts: jars that are neither hidden, javadoc nor metadata."""
    base = base_name(path)
    return F.endswith(base, F.lit(".jar")) & ~F.endswith(base, F.lit("-javadoc.jar")) & ~F.startswith(base, F.lit("maven-metadata.xml")) & ~F.startswith(base, F.lit("."))
