"""Byte-pair encoding by speculation and verification, and decoding.

Of every new word the longest tokens from the left are proposed. A proposal is the encoding if no merge crosses the border
of two neighbours: for each pair the pieces that touch at the border are followed back in the order in which they were
merged, and if a merge of two such pieces would have come before either was merged further, the pair is not compatible.
These checks run on arrays of all pairs of a batch; only words with a pair that fails are merged symbol by symbol.

Defined cases: a null text is empty and has no ids; rows that repeat or share an id are encoded each for itself; a null id
is kept; a very long text, or one very long word, is encoded whole (merging takes n log n steps); columns besides the two
named are not looked at; an empty table gives an empty result. The strings of added tokens are their ids wherever they
stand in a text. Texts beyond LATIN are normalised and split by the tokenizer file's own rules in the library; the ids
come from here.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slim

#: The form of file that is understood: fixed values of the tokenizer file.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Texts with characters below it only are normalised and split here, as the file says (a test tries each of them).
LATIN = "ɐ"
#: Texts looked at together; bytes of remembered words beyond which they are forgotten; longest word that is remembered.
TOGETHER, HELD, LONGEST = 250, 28_000_000, 64
#: Symbols up to which the next merge is looked for among all pairs.
SHORT = 40
#: A rank after all merges.
NEVER = 1 << 40

_CODERS: dict[str, WordBpe] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is one, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Merges:
    """The merges of a vocabulary, by rank: what each token was merged from, and which pairs merge."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocabulary.values()) + 1
        self.size, self.suffix = size, suffix
        self.rank = np.full(size, -1, dtype=np.int64)  # when a token is made; -1: it is a symbol
        self.left, self.right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.made = [vocabulary[a + b] for a, b in merges]
        for k, (a, b) in enumerate(merges):
            token = self.made[k]
            if self.rank[token] >= 0 or max(self.rank[vocabulary[a]], self.rank[vocabulary[b]]) >= k:
                raise ValueError("a token is merged in two ways, or before its parts are")
            self.rank[token], self.left[token], self.right[token] = k, vocabulary[a], vocabulary[b]
        made = np.array(self.made, dtype=np.int64)
        keys = self.left[made] * size + self.right[made]
        self.ranks = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.symbols = {t: k for t, k in vocabulary.items() if self.rank[k] < 0}
        whole = self._own_encoding(made)
        self.inner = {t: k for t, k in vocabulary.items() if whole[k] and not t.endswith(suffix)}
        self.last = {t.removesuffix(suffix): k for t, k in vocabulary.items() if whole[k] and t.endswith(suffix)}
        self.longest = max(map(len, [*self.inner, *self.last]), default=1)

    def _own_encoding(self, made: np.ndarray) -> np.ndarray:
        """Whether each token is what its own characters are encoded as."""
        joined = self.compatible(self.left[made], self.right[made], np.arange(len(made), dtype=np.int64))
        whole = np.ones(self.size, dtype=bool)
        for token, fits in zip(self.made, joined.tolist(), strict=True):  # parts come before what they make
            whole[token] = fits and whole[self.left[token]] and whole[self.right[token]]
        return whole

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours whether no merge crosses their border (before rank until, if given).

        a and b are the pieces at the border, until_a and until_b the ranks at which each is merged further. Of merges of
        one rank the left one comes first: that within the left token before the crossing one, that before the other's.
        """
        out, live = np.ones(len(left), dtype=bool), np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        until_a = np.full(len(left), NEVER) if until is None else until.copy()
        until_b = until_a.copy()
        while len(live):
            rank = self._rank_of(a, b)
            crossed = (rank < until_a) & (rank <= until_b)
            out[live[crossed]] = False
            since_a, since_b = self.rank[a], self.rank[b]
            more = ~crossed & ((since_a >= 0) | (since_b >= 0))
            back_a = since_a > since_b  # of two equal tokens the right one was made later
            a, until_a, b, until_b = (
                np.where(back_a, self.right[a], a)[more], np.where(back_a, since_a, until_a)[more],
                np.where(back_a, b, self.left[b])[more], np.where(back_a, until_b, since_b)[more],
            )
            live = live[more]
        return out

    def proposed(self, word: str) -> list[int]:
        """The longest tokens of word from the left."""
        out, at, n = [], 0, len(word)
        inner, last, longest = self.inner, self.last, self.longest
        while at < n:
            if n - at <= longest:
                token = last.get(word[at:])
                if token is not None:
                    out.append(token)
                    break
            for end in range(min(n - 1, at + longest), at, -1):
                token = inner.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
            else:
                raise ValueError(f"no symbol for {word[at]!r}")
        return out

    def merged(self, word: str) -> list[int]:
        """The encoding of word by its merges, the one of the least rank first and of these the leftmost."""
        own = [self.symbols[c] for c in word[:-1]] + [self.symbols[word[-1] + self.suffix]]
        n, size, ranks = len(own), self.size, self.ranks
        if n <= SHORT:
            of = [ranks.get(x * size + y, NEVER) for x, y in zip(own, own[1:], strict=False)]
            while of and (least := min(of)) < NEVER:
                k = of.index(least)
                own[k : k + 2] = [self.made[least]]
                del of[k]
                if k:
                    of[k - 1] = ranks.get(own[k - 1] * size + own[k], NEVER)
                if k < len(of):
                    of[k] = ranks.get(own[k] * size + own[k + 1], NEVER)
            return own
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(own[k] * size + own[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if own[k] < 0 or j >= n or ranks.get(own[k] * size + own[j]) != rank:
                continue  # one of the two has been merged since
            own[k], own[j], after[k] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := ranks.get(own[x] * size + own[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [t for t in own if t >= 0]

    def encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (not empty): proposed, checked, and merged where the check fails."""
        parts = [self.proposed(w) for w in words]
        flat = np.array([t for p in parts for t in p], dtype=np.int64)
        of = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        inside = np.flatnonzero(of[1:] == of[:-1])
        failed = set(of[inside[~self.compatible(flat[inside], flat[inside + 1])]].tolist())
        return [np.array(self.merged(w) if k in failed else p, dtype="<i4") for k, (w, p) in enumerate(zip(words, parts, strict=True))]


class WordBpe:
    """A tokenizer file of the kind with word ends. Calling it with texts gives the bytes of their ids, 32-bit little-endian."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        model, split = form["model"], form["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["byte_fallback"] or model["ignore_merges"] or form["normalizer"]["normalizers"] != NORMALIZER or form["decoder"]:
            raise ValueError(f"{path} is not a tokenizer of words with ends")
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.library = Tokenizer.from_file(path)
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        self.added = {t["content"]: np.array([t["id"]], dtype="<i4").tobytes() for t in form["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in form["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what stands around them")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}  # word -> its ids; before words of the library stands a blank
        self.held = 0

    def _split(self, text: str) -> list[str]:
        """The words of a part of a text: as they are, or with a blank in front as the library's, already in byte letters."""
        if text.isascii() or max(text) < LATIN:
            return self.words_of(regex.sub(r"\s+", " ", text).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [" " + word for word, _ in pieces]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: those too long to be remembered are returned, the others join known."""
        letters = self.letters
        spelled = [w[1:] if w[0] == " " else "".join([letters[b] for b in w.encode()]) for w in words]
        once: dict[str, bytes] = {}
        for word, ids in zip(words, self.merges.encoded(spelled), strict=True):
            (self.known if len(word) <= LONGEST else once)[word] = ids.tobytes()
            self.held += (len(word) + ids.nbytes + 100) * (len(word) <= LONGEST)
        return once

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), TOGETHER):
            if self.held > HELD:
                self.known, self.held = {}, 0
            parts = [[(p, None) if p in self.added else (None, self._split(p)) for p in self.cut(text) if p] for text in texts[at : at + TOGETHER]]
            new = {w for text in parts for _, words in text for w in words or ()} - self.known.keys()
            once = self._learn(list(new)) if new else {}
            self.known.update(once)
            ids = self.known.__getitem__
            out += [b"".join([self.added[a] if a else b"".join(map(ids, words)) for a, words in text]) for text in parts]
            for word in once:
                del self.known[word]
        return out


def coder(path: str) -> WordBpe:
    """One coder a process and file."""
    return _CODERS.get(path) or _CODERS.setdefault(path, WordBpe(path))


@functools.lru_cache(maxsize=2)
def token_strings(path: str) -> pa.Array:
    """The token of each id of a tokenizer file; decoding needs no more of it."""
    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    known = {k: t for t, k in form["model"]["vocab"].items()} | {t["id"]: t["content"] for t in form["added_tokens"]}
    return pa.array([known.get(k, "") for k in range(max(known) + 1)], pa.string())


def _joined(lists: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of ids: its tokens with a blank between them."""
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, token_strings(path).take(lists.values)), " ")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_text: bool = False) -> DataFrame:
    """id_col and ids (array of int) of every row of docs; with_text adds decoded, what decode() would, in the same pass."""
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = code(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                more = [_joined(lists, path)] if with_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *more], names=["id", "ids", "decoded"][: 2 + len(more)])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>" + ", decoded string" * with_text
    return slim(docs, id=id_col, text=text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str | None = None, name: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in column name: tokens in a row with a blank between them, as the file has no decoder.
    A null list has a null text."""
    path = tokenizer or vocabulary_path()

    @F.pandas_udf("string")
    def text_of(ids):
        lists = pa.array(ids, pa.list_(pa.int32()))
        return pc.if_else(lists.is_valid(), _joined(lists, path), None).to_pandas()

    return encoded.withColumn(name, text_of(F.col(f"`{ids_col}`")))
