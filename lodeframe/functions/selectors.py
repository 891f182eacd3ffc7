"""Selectors of members: #name, #name(), #name(T1,T2), #name(*), #Receiver.name(...)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.brackets import split_top_level as top_level_parts


@dataclass(frozen=True)
class Selector:
    """params: None matches every overload, ["*"] too, [] one without parameters."""

    name: str
    params: tuple[str, ...] | None = None
    receiver: str | None = None


def split_top_level(body: str) -> list[str]:
    """Parts between commas that no bracket encloses."""
    depth, part, parts = 0, "", []
    for c in body:
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    return [*parts, part.strip()] if part.strip() or parts else []


def parse(text: str) -> Selector:
    m = re.fullmatch(r"#(?:([A-Za-z_]\w*)\.)?([A-Za-z_`<][^#().]*)(?:\((.*)\))?", text.strip())
    if not m:
        raise ValueError(f"malformed selector {text!r}")
    params = None if m[3] is None else tuple(split_top_level(m[3]))
    if params and any(not p or "?" in p for p in params):
        raise ValueError(f"malformed selector {text!r}")
    return Selector(m[2], params, m[1])


def parse_list(text: str) -> list[Selector]:
    """Selectors separated by commas; one that is malformed fails the whole list."""
    return [parse(s) for s in split_top_level(text)]


def plain_type(written: Column) -> Column:
    """A parameter's type without white space, nullability, varargs and modifiers."""
    bare = F.regexp_replace(written, r"\b(vararg|noinline|crossinline|final)\s+", "")
    return F.regexp_replace(bare, r"\s|\?|\.\.\.", "")


def same_type(own: Column, wanted: Column) -> Column:
    """Whether two plain types are one: equal, alike in their last segment, or the one at the end of the other."""
    return (wanted == "*") | (own == wanted) | (F.substring_index(own, ".", -1) == F.substring_index(wanted, ".", -1))


def rows(asked: DataFrame) -> DataFrame:
    """asked (selectors, any more) by selector: selector_ord, asked, name, of (receiver or null), any_params, types (plain,
    of the parameters asked for) and error where one of its text can't be read."""
    form = r"(?s)^#(?:([A-Za-z_]\w*)\.)?([A-Za-z_`<][^#().]*)(\((.*)\))?$"
    each = asked.select("*", F.posexplode(F.transform(top_level_parts("selectors"), lambda x: F.trim(x))).alias("selector_ord", "asked"))
    listed = F.regexp_extract("asked", form, 3) != ""
    inner = F.regexp_extract("asked", form, 4)
    types = F.when(listed & (F.trim(inner) != ""), F.transform(top_level_parts(inner), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    read = each.withColumns({"name": F.regexp_extract("asked", form, 2), "of": F.nullif(F.regexp_extract("asked", form, 1), F.lit("")), "types": types, "listed": listed})
    bad = (F.col("name") == "") | F.exists("types", lambda t: (t == "") | F.contains(t, F.lit("?")))
    told = read.withColumn("any_params", ~F.col("listed") | (F.col("types") == F.array(F.lit("*")))).withColumn("error", F.when(bad, F.concat(F.lit("malformed selector '"), "asked", F.lit("'"))))
    plain = F.transform("types", lambda t: F.regexp_replace(t, r"\s|\?|\.\.\.", ""))
    first = F.first("error", ignorenulls=True).over(Window.partitionBy("ask").orderBy("selector_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return told.withColumn("types", plain).withColumn("error", first).drop("selectors", "listed")


def matches(selector: Selector, name: Column, params: Column, receiver: Column) -> Column:
    """Whether a member (name, params array<string>, receiver) is what selector asks for."""
    out = name == selector.name
    if selector.receiver:
        out &= F.substring_index(F.coalesce(receiver, F.lit("")), ".", -1) == selector.receiver
    if selector.params is not None and selector.params != ("*",):
        out &= F.size(params) == len(selector.params)
        for k, wanted in enumerate(selector.params):
            if wanted != "*":
                own = plain_type(F.get(params, F.lit(k)))
                w = re.sub(r"\s|\?|\.\.\.", "", wanted)
                out &= (own == w) | (F.substring_index(own, ".", -1) == w.rsplit(".", 1)[-1]) | F.endswith(own, F.lit("." + w))
    return out
