"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules that are tried.

A rule is tried as two anchored expressions, of the host and of the path, so nothing in a path can pass for a host.

Defined cases: a null URL, or one without ://, has an empty host and path and matches no rule; hosts and paths may hold
any character, line ends too, and be very long; among the rules that fit, the longest wins, the text of the rule deciding
ties; rules given twice count once; repeated rows and null ids are judged each for itself; where no rule fits, the verdict
is the default; columns other than the two named are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS

#: (action, host, path) as the op4 contract states them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: With more rules than this the index is a table that is joined, not a map in the plan.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens: the labels of the host, and the segments of the path with their slash."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    # a rule's last path segment may be cut, so only segments that a slash ends are literal tokens
    segments = F.transform(F.regexp_extract_all(path, F.lit(r"([^/]+)/"), 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _rule_rows(rules: list[tuple[str, str, str]]) -> list[dict]:
    rows = []
    for action, host, path in dict.fromkeys(rules):
        words = ["h:" + x for x in host.split(".") if x] + ["p:" + x for x in re.findall(r"([^/]+)/", path)]
        rows.append({"rule": host + path, "action": action, "host_pattern": rf"(?s)\A(?:.*\.)?{re.escape(host)}\z", "path_pattern": rf"\A{re.escape(path)}", "words": words})
    return rows


def rule_index(urls: DataFrame, rules: list[tuple[str, str, str]]) -> dict[str, list[dict]]:
    """token -> rules filed under it: of each rule's literal tokens the one that fewest URLs have."""
    rows = _rule_rows(rules)
    wanted = sorted({w for r in rows for w in r["words"]})
    held = F.array_intersect(tokens(F.col("host"), F.col("path")), F.lit(wanted) if wanted else F.array().cast("array<string>"))
    counts = {r.token: r.n for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[dict]] = {}
    for r in rows:
        token = min(r["words"], key=lambda w: (counts.get(w, 0), w)) if r["words"] else ""
        index.setdefault(token, []).append(r)
    return index


_ENTRY = "struct<host_pattern:string,path_pattern:string,length:int,rule:string,action:string>"


def _entry(r: dict) -> tuple:
    return r["host_pattern"], r["path_pattern"], len(r["rule"]), r["rule"], r["action"]


def _shelf(rules: list[dict]) -> Column:
    fields = ("host_pattern", "path_pattern", "length", "rule", "action")
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, _entry(r), strict=True)]) for r in rules]).cast(f"array<{_ENTRY}>")


def _fits(r: Column) -> Column:
    return F.rlike("host", r["host_pattern"]) & F.rlike("path", r["path_pattern"])


def _best(fits: Column) -> Column:
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["action"].alias("action"))))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict; no join or shuffle up to INLINE_RULES rules.

    With more, distinct hosts and paths meet the rules by token; rules without a token (an empty host) are tried on all
    in the plan. Rules are broadcast up to BROADCAST_ROWS.
    """
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    index = rule_index(urls, rules)
    tokenless = index.pop("", [])
    files = [(t, r) for t, rs in sorted(index.items()) for r in rs]
    found = tokens(F.col("host"), F.col("path"))
    always = _best(F.filter(_shelf(tokenless), _fits)) if tokenless else F.lit(None).cast("struct<length:int,rule:string,action:string>")
    if len(files) <= INLINE_RULES:
        none = F.array().cast(f"array<{_ENTRY}>")
        filed = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), _shelf(rs))]) if index else F.create_map().cast(f"map<string,array<{_ENTRY}>>")
        fetched = F.flatten(F.transform(found, lambda t: F.coalesce(filed[t], none)))
        judged = urls.withColumn("best", F.greatest(_best(F.filter(fetched, _fits)), always))
    else:
        filed = pages.sparkSession.createDataFrame([(t, _entry(r)) for t, r in files], f"token string, entry {_ENTRY}")
        filed = F.broadcast(filed) if len(files) <= BROADCAST_ROWS else filed
        distinct = urls.select("host", "path").distinct()
        fetched = distinct.withColumn("token", F.explode(found)).join(filed, "token").filter(_fits(F.col("entry")))
        won = fetched.groupBy("host", "path").agg(F.max(F.struct("entry.length", "entry.rule", "entry.action")).alias("won"))
        judged = urls.join(won, ["host", "path"], "left").withColumn("best", F.greatest("won", always))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
