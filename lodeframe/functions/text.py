"""Text as lines, clipped cells, summaries, globs and version keys, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Extensions of entries that are taken as binary, and the bytes looked through for a zero byte.
BINARY_EXTENSIONS = (".class", ".png", ".gif", ".jpg", ".jar", ".so", ".dylib", ".dll", ".kotlin_module", ".kotlin_builtins")
SNIFFED_BYTES = 8192


def lines(text: Column) -> Column:
    """Array of lines: one carriage return at an end goes, a final empty line too; empty text has none."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(trimmed)


def line_slice(all_lines: Column, first: int, last: int) -> Column:
    """Struct of the lines first..last (from 1), the true ends, and whether the range had to be clamped."""
    count = F.size(all_lines)
    start, end = F.greatest(F.lit(first), F.lit(1)), F.least(F.lit(last), count)
    picked = F.when(start <= end, F.slice(all_lines, start, end - start + 1)).otherwise(F.array().cast("array<string>"))
    return F.struct(picked.alias("lines"), start.alias("first"), end.alias("last"), ((F.lit(first) < 1) | (F.lit(last) > count)).alias("clamped"))


def numbered(number: Column, width: Column, line: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), width, F.lit(" ")), F.lit("│ "), line)


def truncated(text: Column, limit: int = 120) -> Column:
    """text, or its first characters and an ellipsis where it is longer than limit."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def clipped(text: Column, width: int = 60) -> Column:
    """text in at most width characters, the last of which is an ellipsis where something is cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def doc_summary(comment: Column, limit: int = 180) -> Column:
    """First sentence of a documentation comment: marks and stars go, block tags end it."""
    body = F.regexp_replace(F.regexp_replace(comment, r"\A/\*\*?", ""), r"\*/\z", "")
    bare = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?", "")))
    told = F.get(F.split(F.array_join(bare, "\n"), "(?m)^@", 2), F.lit(0))
    text = F.trim(F.regexp_replace(told, r"\s+", " "))
    sentence = F.when(F.contains(text, F.lit(".")), F.concat(F.substring_index(text, ".", 1), F.lit("."))).otherwise(text)
    return truncated(sentence, limit)


def has_deprecated_tag(comment: Column) -> Column:
    return F.rlike(comment, F.lit(r"(?m)^\s*\*?\s*@deprecated\b"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: * stays within a path segment, ** does not, all else is itself."""
    parts = re.split(r"(\*\*|\*)", glob)
    return r"\A" + "".join({"*": "[^/]*", "**": ".*"}.get(p, re.escape(p)) for p in parts) + r"\z"


def matches_glob(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(glob_pattern(glob)))


def is_binary(path: Column, content: Column) -> Column:
    """By extension, or by a zero byte near the start of the content."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return ending.isin(*BINARY_EXTENSIONS) | F.contains(F.substring(content, 1, SNIFFED_BYTES), F.lit(b"\x00"))


def version_key(version: Column) -> Column:
    """Sortable key: segments between dots and dashes, numbers by value; of equal beginnings the shorter sorts last.

    Numbers sort before words in one place, which makes the order total.
    """
    parts = F.split(version, "[.-]")
    padded = F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]+$")), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.concat(F.array_join(padded, "\x01"), F.lit("\x02"))


def utf8_prefix(content: Column, limit: int) -> Column:
    """The longest prefix of valid UTF-8 content of at most limit bytes that ends between characters."""
    cut = F.substring(content, 1, limit)
    # continuation bytes are 80..BF: up to three of them may follow the lead byte of a character that is cut
    def tail(k: int) -> Column:
        return F.conv(F.hex(F.substring(content, limit + 1 - k, 1)), 16, 10).cast("int")

    whole = [F.when((tail(k) < 128) | (tail(k) >= 192), F.substring(content, 1, limit - k)) for k in range(4)]
    return F.decode(F.when(F.octet_length(content) <= limit, content).otherwise(F.coalesce(*whole, cut)), "UTF-8")
