"""Repair of conversations whose turns are blank, repeated, cut off or out of order, by grammar-compressed dynamic programming.

A row is one symbol: the initial of its role and its first fault. What edits can do to a row is a min-plus matrix over the
states of the grammar `(s?(ua)+)?`, each cell with the least cost and the ASCII-least audit of that cost. Re-Pair replaces
the pairs that are most frequent among the conversations by rules; a rule's matrix is the product of its parts' and made
once, from the bottom up, and every conversation that contains it shares it. An audit is a rope: a cell of a product holds
its parts' ropes, and text is made of one when two of equal cost are compared or when it is read.

Rows of a conversation are sorted by range, not gathered: a partition cuts what it has of a conversation into chunks of
bounded size, chunks have matrices, and a fold over the chunks of a conversation gives the cheapest way through them.
Cells of one cost are never prefixes of each other, as the letters of an audit determine its cost, so the least of a
product is made of the least of its factors.

Defined cases: a null role or text is one space; a null turn comes first; rows of one turn go by role, then text; equal
rows of a turn are one row and its repetitions; a null conversation is one like others; a role whose initial is not s, u or
a (an empty one too) can't stay as it is; a very long text is kept whole; columns besides the four named are not looked
at; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, slim, stored

#: States: nothing yet, after s, after u, after a. The first and last may end a conversation.
STATES, ENDS = range(4), (0, 3)
#: Where a kept initial, or the one of an edit, leads.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Symbols of rows: an initial for sound rows, a capital for truncated ones (o: any other role), and x for what must go.
SYMBOLS = "suaoSUAOx"
#: Rows and characters of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20
#: Most rules of a grammar and rounds in which they are found; a rule is a character from FIRST_RULE on.
RULES, ROUNDS, FIRST_RULE = 256, 8, 0x4E00


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int = 20) -> DataFrame:
    """(conv, turn, role, text, times) with the damage of crc32("conv:turn") modulo parts: times is 0 for a dropped row and
    2 for a repeated one; conv and turn are as they were."""
    named = slim(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    key = F.concat(present(F.col("conv").cast("string")), F.lit(":"), present(F.col("turn").cast("string")))
    kind = F.crc32(key.cast("binary")) % parts
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(present(F.col("text")), "[.!?]", "")).otherwise(present(F.col("text")))
    return named.select("conv", "turn", F.when(kind == 4, "user").otherwise(present(F.col("role"))).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def unchanged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows in the form of damaged(), each once."""
    named = slim(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    return named.select("conv", "turn", present(F.col("role")).alias("role"), present(F.col("text")).alias("text"), F.lit(1).alias("times"))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, role, text) with times, whether role and text come earlier, and whether the row is blank
    or truncated. Rows that repeat are counted before they move; earlier ones are met under keys that no two rows share."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("conv")
    named = rows.select(key, F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "role", "text", "times")
    each = named.groupBy("conv", "timed", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("tag", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    each = stored(each)
    first = each.filter("times > 0").groupBy("conv", "tag").agg(F.min(F.struct("timed", "turn")).alias("at")).select("conv", "tag", "at.timed", "at.turn", F.lit(True).alias("first"))
    last = F.regexp_extract("text", rf"([^{WS}])[{WS}]*\z", 1)
    met = each.join(first, ["conv", "tag", "timed", "turn"], "left")
    return met.select("conv", "timed", "turn", "role", "text", "times", F.col("first").isNull().alias("again"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _symbol(role: str, cut: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if cut else initial


def chunks(rows: DataFrame) -> DataFrame:
    """(conv, part, nth, symbols, roles, texts, blank, duplicate, truncated, illegal, first and last initial, turns: how many
    different ones, least and greatest) of rows as damaged() gives them, in order: conv is a text key, part and nth order
    its chunks."""
    each = _marked(rows)
    ordered = each.repartitionByRange("conv", "timed", "turn", "role", "text").sortWithinPartitions("conv", "timed", "turn", "role", "text")
    slim_rows = ordered.select("conv", F.when(F.col("timed"), F.col("turn").cast("string")).alias("turn"), "role", "text", "times", "again", "blank", "cut", F.spark_partition_id().alias("part"))
    schema = "conv string, part int, nth int, symbols string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low string, high string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Chunk("", 0, 0)
        begun = False
        for batch in batches:
            done = []
            for conv, turn, role, text, times, again, blank, late, part in zip(*(batch[c] for c in batch.columns), strict=True):
                if not begun or state.conv != conv:
                    done += [state.row()] if begun else []
                    state, begun = _Chunk(conv, part, 0), True
                for k in range(times):
                    if state.full():
                        done.append(state.row())
                        state = _Chunk(conv, part, state.nth + 1)
                    state.add(turn, role, text, blank, again or k > 0, late)
            if done:
                yield pd.DataFrame(done, columns=_names(schema))
        if begun:
            yield pd.DataFrame([state.row()], columns=_names(schema))

    return slim_rows.mapInPandas(cut, schema)


class _Chunk:
    """Rows of one conversation that follow each other, and their counts."""

    def __init__(self, conv: str, part: int, nth: int) -> None:
        self.conv, self.part, self.nth = conv, part, nth
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None

    def full(self) -> bool:
        return len(self.roles) >= CHUNK_ROWS or self.size >= CHUNK_CHARS

    def add(self, turn: str | None, role: str, text: str, blank: bool, again: bool, late: bool) -> None:
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and self.high != int(turn):  # turns ascend
            self.turns += 1
            self.low, self.high = int(turn) if self.low is None else self.low, int(turn)
        self.blank += bool(blank)
        self.duplicate += bool(again and not blank)
        self.truncated += bool(late and not again and not blank)
        self.symbols.append("x" if blank or again else _symbol(role, late))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + 1

    def row(self) -> tuple:
        ends = [self.roles[k][:1] for k in (0, -1)] if self.roles else [None, None]
        span = [None if t is None else str(t) for t in (self.low, self.high)]
        return (self.conv, self.part, self.nth, "".join(self.symbols), self.roles, self.texts, self.blank, self.duplicate, self.truncated, self.illegal, *ends, self.turns, *span)


class Rope:
    """A string as its parts; text is made of it when it is asked for, and kept."""

    __slots__ = ("_parts", "_text")

    def __init__(self, text: str | None = None, parts: tuple[Rope, Rope] | None = None) -> None:
        self._text, self._parts = text, parts

    def text(self) -> str:
        if self._text is None:
            out, waiting = [], [self]
            while waiting:
                rope = waiting.pop()
                if rope._text is None:
                    waiting += reversed(rope._parts)
                else:
                    out.append(rope._text)
            self._text, self._parts = "".join(out), None
        return self._text

    def __add__(self, other: Rope) -> Rope:
        return Rope(parts=(self, other))


#: By (from, to) state the least cost and the audit of it.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def least(cells: Matrix, at: tuple[int, int], cost: int, audit: Rope) -> None:
    """Put a way into cells if it is cheaper than what is there, or as cheap and its audit comes first."""
    old = cells.get(at)
    if old is None or cost < old[0] or (cost == old[0] and audit.text() < old[1].text()):
        cells[at] = (cost, audit)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in STATES:
            if (more := b.get((k, j))) is not None:
                least(out, (i, j), cost + more[0], audit + more[1])
    return out


def insertions() -> Matrix:
    """Any number of rows put in."""
    out: Matrix = {(i, i): (0, Rope("")) for i in STATES}
    for _ in STATES:
        for (i, k), (cost, audit) in list(out.items()):
            for role in "ua":
                if (j := STEPS.get((k, role))) is not None:
                    least(out, (i, j), cost + INSERT, audit + Rope("I"))
    return out


def row_matrix(symbol: str) -> Matrix:
    """What may be put in before a row, and what can be done to it."""
    out: Matrix = {}
    late = TRUNCATED * symbol.isupper()
    for i in STATES:
        least(out, (i, i), DELETE, Rope("D"))
        if symbol != "x":
            for role, cost, letter in ((symbol.lower(), 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                if (j := STEPS.get((i, role))) is not None:
                    least(out, (i, j), cost + late, Rope(letter))
    return product(insertions(), out)


def compressed(symbols: str, rules: list[str]) -> str:
    """symbols with each rule's pairs replaced from the left, the rules in their order."""
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + k))
    return symbols


def grammar(texts: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> list[str]:
    """Re-Pair over texts (symbols, n: how often each is there): the pair of symbols that each rule stands for.

    A round counts all pairs in the executors and takes the most frequent of them that share no symbol as left and right
    part, so that none of a round's pairs takes another's symbols. How many rules there are changes the work only.
    """
    found: list[str] = []
    for left in range(rounds, 0, -1):

        def count(batches: Iterator[pd.DataFrame], so_far: tuple[str, ...] = tuple(found)) -> Iterator[pd.DataFrame]:
            counts: dict[str, int] = {}
            for batch in batches:
                for symbols, n in zip(batch["symbols"], batch["n"], strict=True):
                    short = compressed(symbols, list(so_far))
                    for pair in {short[k : k + 2] for k in range(len(short) - 1)}:
                        counts[pair] = counts.get(pair, 0) + n * short.count(pair)
            yield pd.DataFrame({"pair": list(counts), "n": list(counts.values())}).astype({"pair": str, "n": "int64"})

        pairs = texts.mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        firsts, seconds, new = set(), set(), []
        for row in sorted(pairs.collect(), key=lambda r: (-r.n, r.pair)):  # at most the square of SYMBOLS and rules
            a, b = row.pair
            if a not in seconds and b not in firsts and len(new) < -(-(rules - len(found)) // left):
                firsts.add(a)
                seconds.add(b)
                new.append(row.pair)
        if not new:
            break
        found += new
    return found


class Evaluator:
    """Matrices of symbols and rules, made once a process, and of sequences."""

    #: Sequences whose matrices are remembered.
    KNOWN = 50_000

    def __init__(self, rules: list[str]) -> None:
        self.rules, self.known = rules, {}
        self.matrices = {c: row_matrix(c) for c in SYMBOLS}
        for k, (a, b) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[a], self.matrices[b])

    def __call__(self, symbols: str) -> Matrix:
        """The matrix of a sequence."""
        out = self.known.get(symbols)
        if out is None:
            out = {(i, i): (0, Rope("")) for i in STATES}
            for c in compressed(symbols, self.rules):
                out = product(out, self.matrices[c])
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            self.known[symbols] = out
        return out


def _matrices(cut: DataFrame, rules: list[str]) -> DataFrame:
    """The columns of cut (chunks() without texts) with cells: from, to, cost and audit of its matrix."""
    names = [c for c in cut.columns if c != "symbols"]

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = Evaluator(rules)
        for batch in batches:
            cells = [sorted((i, j, cost, audit.text()) for (i, j), (cost, audit) in matrix(s).items()) for s in batch["symbols"]]
            parts = {n: [[c[k] for c in own] for own in cells] for k, n in enumerate(("start", "end", "cost", "audit"))}
            yield batch[names].assign(**parts)

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes if n != "symbols")
    return cut.mapInPandas(evaluate, f"{schema}, start array<int>, end array<int>, cost array<int>, audit array<string>")


def _folded(matrices: DataFrame) -> DataFrame:
    """A row a chunk: conv, part, nth, edits (its part of the audit, and what is put in after the last), state before it and
    place (rows of the result before it); with its last chunk, the report of the conversation."""
    schema = "conv string, part int, nth int, edits string, state int, place long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in batch.itertuples(index=False))
        out: list[tuple] = []
        for conv, own in groupby(rows, key=lambda r: r.conv):
            out += _one_fold(conv, own)
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=_names(schema))
                out = []
        yield pd.DataFrame(out, columns=_names(schema))

    return matrices.repartition("conv").sortWithinPartitions("conv", "part", "nth").mapInPandas(fold, schema)


def _one_fold(conv: str, own: Iterator) -> list[tuple]:
    """Rows of _folded() for the chunks of one conversation, in order. Only the cells on the way are kept for each."""
    best = {0: 0}  # state -> least cost
    ropes = {0: Rope("")}
    steps: list[tuple] = []  # of each chunk: part, nth, and by state the state before and the audit between
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = last = None
    for r in own:
        cells: Matrix = {}
        came: dict[int, tuple[int, str]] = {}
        for i, j, cost, audit in zip(r.start, r.end, r.cost, r.audit, strict=True):
            if i in best:
                old = cells.get((0, j))
                least(cells, (0, j), best[i] + int(cost), ropes[i] + Rope(audit))
                if cells[0, j] is not old:
                    came[j] = (i, audit)
        best, ropes = {j: c for (_, j), (c, _) in cells.items()}, {j: a for (_, j), (_, a) in cells.items()}
        steps.append((r.part, r.nth, came))
        for name in counts:
            counts[name] += int(getattr(r, name))
        if r.first is not None:
            counts["illegal"] += last is not None and last + r.first not in ("su", "ua", "au")
            last = r.last
        if r.low is not None:
            counts["turns"] -= high == int(r.low)
            low, high = int(r.low) if low is None else low, int(r.high)
    ends: Matrix = {}
    for (i, j), (cost, audit) in insertions().items():
        if i in best and j in ENDS:
            least(ends, (i, 0), best[i] + cost, ropes[i] + audit)
    state, (cost, audit) = min(((i, c) for (i, _), c in ends.items()), key=lambda x: (x[1][0], x[1][1].text()))
    whole, after = audit.text(), audit.text()[len(ropes[state].text()) :]
    path = []
    for part, nth, came in reversed(steps):
        state, edits = came[state]
        path.append((part, nth, edits, state))
    out, place = [], 0
    for part, nth, edits, state in reversed(path):
        out.append([conv, part, nth, edits, state, place, *[None] * 7])
        place += len(edits) - edits.count("D")
    gaps = 0 if low is None else high - low + 1 - counts["turns"]
    out[-1][3] += after
    out[-1][6:] = [gaps, *[counts[n] for n in ("blank", "duplicate", "truncated", "illegal")], cost, whole]
    return [tuple(r) for r in out]


def _edited(cut: DataFrame, folded: DataFrame) -> DataFrame:
    """(conv, part, nth, place, roles, texts, edits): the rows of each chunk after its edits, place that of the first."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, part, nth, place, roles, texts, edits, state in zip(*(batch[c] for c in ("conv", "part", "nth", "place", "roles", "texts", "edits", "state")), strict=True):
                at, rows = 0, []
                for letter in edits:
                    role, text = (roles[at], texts[at]) if letter != "I" else ("", "")
                    at += letter != "I"
                    if letter == "D":
                        continue
                    if letter != "K":
                        role = "assistant" if state == 2 else "user"
                    state = STEPS[state, role[0]]
                    rows.append((role, text, letter))
                out.append((conv, part, nth, place, *([r[k] for r in rows] for k in range(3))))
            yield pd.DataFrame(out, columns=["conv", "part", "nth", "place", "roles", "texts", "edits"])

    met = cut.select("conv", "part", "nth", "roles", "texts").join(folded.select("conv", "part", "nth", "edits", "state", "place"), ["conv", "part", "nth"])
    return met.mapInPandas(apply, "conv string, part int, nth int, place long, roles array<string>, texts array<string>, edits array<string>")


def _digests(edited: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of all `role:text` of a conversation in order, newline-joined; taken in as they come."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["conv"], batch["roles"], batch["texts"], strict=True))
        out = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            sha, between = hashlib.sha256(), ""
            for _, roles, texts in own:
                for role, text in zip(roles, texts, strict=True):
                    sha.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            out.append((conv, sha.hexdigest()))
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])

    return edited.repartition("conv").sortWithinPartitions("conv", "part", "nth").mapInPandas(digest, "conv string, repaired_sha256 string")


def repair(rows: DataFrame, kind: str = "bigint") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, repaired rows, digests) of rows as damaged() or unchanged() gives them; kind: the type of conv.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation. Repaired rows: conv_id,
    place (from 0), role, text, edit. Digests: conv_id and the SHA-256 of what was repaired.
    """
    cut = stored(chunks(rows))
    texts = stored(cut.groupBy("symbols").agg(F.count("*").alias("n")))
    rules = grammar(texts)
    folded = stored(_folded(_matrices(cut.drop("roles", "texts"), rules)))
    own = lambda df: df.withColumn("conv_id", F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind))
    report = own(folded.filter("audit is not null")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edited = _edited(cut, folded)
    each = own(edited).select("conv_id", "place", F.posexplode(F.arrays_zip("roles", "texts", "edits")).alias("at", "r"))
    repaired = each.select("conv_id", (F.col("place") + F.col("at")).alias("place"), F.col("r.roles").alias("role"), F.col("r.texts").alias("text"), F.col("r.edits").alias("edit"))
    return report, repaired, own(_digests(edited)).select("conv_id", "repaired_sha256")
