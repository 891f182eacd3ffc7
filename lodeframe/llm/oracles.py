"""DuckDB SQL for the corpus queries that SQL can express, over the whole tables."""

_TEXT = "coalesce(text, '')"
_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_DENSE = rf"length(regexp_replace({_TEXT}, '[\x20\x09-\x0D]+', '', 'g'))"

OP4 = r"""
WITH rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT p.page_id, p.host, p.path, max(row(length(rule_host || rule_path), rule_host || rule_path, action)) AS best
  FROM parts p LEFT JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY ALL)
SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], 'allow') AS verdict FROM fit
"""

OP5 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, words[i:i + 7] AS win FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, text, len(words) AS n_words, {_DENSE} AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len({_LINES}) AS n_lines, len({_LINES}) - len(list_distinct({_LINES})) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters,
    length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 10 > n_lines * 6
    OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1)
    OR n_upper * 10 > n_letters * 6 OR n_letters * 2 < word_chars OR n_bangs * 2 > n_words) AS kept
FROM judged
"""

OP6 = rf"""
WITH n AS (SELECT doc_id, regexp_replace({_TEXT}, '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS own FROM w),
class AS (SELECT own, min(doc_id) AS class_id, len(own) AS n FROM sets WHERE len(own) > 0 GROUP BY own),
posted AS (SELECT class_id, n, unnest(own) AS shingle FROM class),
shared AS (
  SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.class_id < b.class_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, to_id) AS (
  SELECT class_id, class_id FROM class UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.to_id = e.a),
component AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN class c ON len(s.own) > 0 AND s.own = c.own LEFT JOIN component ON c.class_id = component.id
"""



def _tree(shards: int = 16, seed: int = 0) -> str:
    """CTEs n0, n1, ... of the nodes' block counts by source, from quotas(s, cnt) down to leaves(shard, s, cnt)."""
    out, level, n = "n0 AS (SELECT 0 AS first, s, cnt FROM quotas)", 0, shards
    while n > 1:
        half = n // 2
        out += f""",
e{level} AS (
  SELECT first, s, row_number() OVER (PARTITION BY first ORDER BY md5('{seed}:' || first || ':{n}:' || s || ':' || k), s) <= (count(*) OVER (PARTITION BY first)) * {half} // {n} AS goes_left
  FROM n{level}, unnest(range(cnt)) AS u(k)),
n{level + 1} AS (
  SELECT first, s, count(*) FILTER (goes_left) AS cnt FROM e{level} GROUP BY ALL
  UNION ALL SELECT first + {half}, s, count(*) FILTER (NOT goes_left) FROM e{level} GROUP BY ALL)"""
        level, n = level + 1, half
    return out + f", leaves AS (SELECT first AS shard, s, cnt FROM n{level})"


OP9 = rf"""
WITH docs AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5({_TEXT})) AS rank FROM documents),
source_sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM source_sizes),
ordered AS (
  SELECT *, 2 * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM weighted WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * weight_left <= weight * words_left AS full_source FROM ordered),
rest AS (
  SELECT 1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (full_source), 0) AS words_left,
    sum(weight) - coalesce(sum(weight) FILTER (full_source), 0) AS weight_left,
    greatest(8192, ceil(sum(source_size) / 65536))::BIGINT AS per_block FROM capped),
sources AS (
  SELECT source, s, source_size, CASE WHEN full_source THEN cap::DOUBLE ELSE weight * rest.words_left / rest.weight_left END AS target,
    floor(CASE WHEN full_source THEN cap::DOUBLE ELSE weight * rest.words_left / rest.weight_left END + 0.5)::BIGINT AS words,
    greatest(1, ceil(source_size / per_block))::BIGINT AS blocks FROM capped, rest),
placed AS (
  SELECT d.*, t.* EXCLUDE (source), ('0x' || substr(rank, 1, 12))::BIGINT % blocks AS block FROM docs d JOIN sources t ON d.source IS NOT DISTINCT FROM t.source),
in_blocks AS (SELECT s, any_value(words) AS words, block, sum(size)::BIGINT AS w FROM placed GROUP BY s, block HAVING sum(size) > 0),
queued AS (
  SELECT s, block, w, words, copy, row_number() OVER o - 1 AS t, (sum(w) OVER o - w)::BIGINT AS start FROM in_blocks, unnest([0, 1]) AS u(copy)
  WINDOW o AS (PARTITION BY s ORDER BY copy, md5('0:' || s || ':' || block), block ROWS UNBOUNDED PRECEDING)),
tickets AS (SELECT *, least(w, words - start) AS lim FROM queued WHERE start < words),
quotas AS (SELECT s, count(*) AS cnt FROM tickets GROUP BY s),
{_tree()},
bounds AS (SELECT s, shard, sum(cnt) OVER (PARTITION BY s ORDER BY shard) - cnt AS lo, sum(cnt) OVER (PARTITION BY s ORDER BY shard) AS hi FROM leaves),
drawn AS (SELECT s, block, copy, shard, lim, lim < w AS part FROM tickets JOIN bounds b USING (s) WHERE t >= lo AND t < hi),
spots AS (SELECT *, (sum(size) OVER (PARTITION BY s, block ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM placed),
taking AS (
  SELECT p.*, copy, shard, CASE WHEN shard IS NULL THEN 0 WHEN part THEN greatest(0, least(size, lim - start)) ELSE size END AS taken
  FROM spots p LEFT JOIN drawn d ON p.s = d.s AND p.block = d.block)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(taken)::BIGINT AS taken,
  coalesce(string_agg(copy || ':' || shard, ',' ORDER BY copy) FILTER (taken > 0), '') AS shards
FROM taking GROUP BY doc_id, rank
"""

# bytes are pairs of hex digits here: window i has the digits from 2 i - 1 on
OP1 = rf"""
WITH b AS (SELECT doc_id, hex(encode({_TEXT})) AS body FROM documents),
w AS (SELECT doc_id, i, md5(substr(body, 2 * i - 1, 200)) AS own FROM b, unnest(range(1, length(body) // 2 - 98)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY own ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER d + 100, true)::INTEGER AS fresh FROM later WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, a, b, span, coalesce(lag(b) OVER d, 1) AS from_byte, span = max(span) OVER (PARTITION BY doc_id) AS last FROM spans WINDOW d AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(body, 2 * from_byte - 1, 2 * (a - from_byte)) || CASE WHEN last THEN substr(body, 2 * b - 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM gaps g JOIN (SELECT doc_id, body FROM b) USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, (length(body) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, body))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {
    "op1_suffix_array_dedup": OP1,
    "op4_url_filter": OP4,
    "op5_quality_rules": OP5,
    "op6_exact_dedup": OP6,
    "op8_minhash_near_dedup": OP8,
    "op9_source_mixing": OP9,
}


_WS = r"\x20\x09-\x0D"


def _plus(cell: str, cost: str, letters: str) -> str:
    """A cell of op12, eight digits of cost and an audit, with more of both; null stays null."""
    return f"lpad(CAST(CAST(substr({cell}, 1, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({cell}, 9) || '{letters}'"


def _kept(state: str, initial: str) -> str:
    """What a row does to a cell that leads on by this initial: it stays if it has it, else its role is changed."""
    kept, changed = _plus(state, "late", "K"), _plus(state, "late + 2", "R")
    return f"CASE WHEN gone THEN NULL WHEN initial = '{initial}' THEN {kept} ELSE {changed} END"


_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20"""
_INSERTED = f"""least(f2, {_plus("f0", "2", "I")}, {_plus("f1", "2", "I")}, {_plus("f3", "2", "I")}) AS g2,
  least(f3, {_plus("f2", "2", "I")}, {_plus("f0", "4", "II")}, {_plus("f1", "4", "II")}) AS g3"""
_FAULTS = "count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT again AND NOT blank) AS truncated"

ORACLE_SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS kind FROM keyed),
hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_extract(text, '([^{_WS}])[{_WS}]*$', 1) AS ending FROM hit),
seen AS (
  SELECT *, left(role, 1) AS initial, ending = '' AS blank, ending NOT IN ('.', '!', '?') AS cut, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS broken
  FROM placed),
row_faults AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM seen),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {_FAULTS}, count_if(broken) AS illegal
  FROM row_faults GROUP BY conv_id),
ways(conv_id, pos, f0, f1, f2, f3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '00000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM conversations
  UNION ALL
  SELECT conv_id, pos, {_plus("g0", "3", "D")},
    least({_plus("g1", "3", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_plus("g0", "late", "K")} END),
    least({_plus("g2", "3", "D")}, {_kept("g0", "u")}, {_kept("g1", "u")}, {_kept("g3", "u")}),
    least({_plus("g3", "3", "D")}, {_kept("g2", "a")})
  FROM (SELECT r.conv_id, r.pos, r.initial, r.gone, r.late, w.f0 AS g0, w.f1 AS g1, {_INSERTED}
        FROM ways w JOIN row_faults r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.pos + 1)),
ends AS (
  SELECT w.conv_id, least(f0, f3, {_plus("f2", "2", "I")}, {_plus("f0", "4", "II")}, {_plus("f1", "4", "II")}) AS best
  FROM ways w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.pos = coalesce(c.n, 0)),
audits AS (SELECT conv_id, CAST(substr(best, 1, 8) AS BIGINT) AS cost, substr(best, 9) AS audit FROM ends),
letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS letter, length(replace(substr(audit, 1, i), 'I', '')) AS pos, length(replace(substr(audit, 1, i), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM audits)),
met AS (SELECT l.*, r.role, r.text FROM letters l LEFT JOIN row_faults r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.pos = r.pos WHERE l.letter <> 'D'),
turned AS (SELECT *, place - max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nth FROM met),
said AS (
  SELECT conv_id, i, CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM turned),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS body FROM said GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, a.cost, a.audit, sha256(coalesce(w.body, '')) AS repaired_sha256
FROM audits a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole w ON a.conv_id IS NOT DISTINCT FROM w.conv_id
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
each AS (SELECT *, row_number() OVER () AS row_no FROM fine),
scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM each a JOIN each b ON a.vec_id % 100 = 0 AND a.row_no <> b.row_no),
positives AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, other) AS nth FROM scored WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.row_no, p.nth ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.row_no = s.row_no AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
