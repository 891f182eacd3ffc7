"""Token ids of texts by a tokenizer file of byte-level BPE kind, each word encoded once a process.

To such a tokenizer a blank between two characters that are not white space begins a new word, and a lone newline parts
words. Texts whose white space is of these two kinds only are put together from the ids of their words, which are
remembered; all others go to the tokenizer whole. New words of Latin letters are encoded by the file's own vocabulary as
ranks, which merges the same pairs in the same order in a third of the time, if the file is of that form; tests hold every
id against the tokenizer's.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .bpe import byte_letters

#: Characters and ids of remembered words, in bytes, beyond which they are forgotten (what holds them takes about seven
#: times as much); texts looked at together.
HELD, TOGETHER = 7_000_000, 250
#: Words below LATIN are split alike by any version of the character tables; longer ones than LONGEST go to the tokenizer.
LATIN, LONGEST = "ɐ", 200
_NEIGHBOURS = re.compile(r"\s\s").search


def _by_ranks(path: str):  # noqa: ANN202
    """The file's vocabulary as ranks; None if its ids are not in the order of its merges or it splits texts another way."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    vocabulary, merges, split = form["model"]["vocab"], form["model"]["merges"], form["pre_tokenizer"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    plain = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and form["normalizer"] is None
    if not plain or any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    added = {t["content"] for t in form["added_tokens"]}
    byte_of = {c: b for b, c in byte_letters().items()}
    ranks = {bytes([byte_of[c] for c in t]): k for t, k in vocabulary.items() if t not in added}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenIds:
    """Calling it with texts gives their id arrays, little-endian unsigned 32-bit."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a blank
        for token, k in vocabulary.items():
            self.leads[k] = token.startswith("Ġ")
        self.newline = self._whole("\n")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _by_ranks(path)
        self.words: dict[str, bytes] = {}  # word -> ids of a blank and the word
        self.heads: dict[str, bytes] = {}  # first word of a line -> its ids
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str], heads: list[str]) -> None:
        if self.ranked:
            own = [w for w in words if len(w) <= LONGEST and (w.isascii() or max(w) < LATIN) and not any(a in w for a in self.added)]
            self._learn_joined(own, np.asarray(self.ranked.encode_ordinary("".join([" " + w for w in own])), dtype="<u4").tobytes())
            words = list(set(words).difference(own))
        self._learn_joined(words, self._whole("".join([" " + w for w in words])))
        for head in heads:
            self.heads[head] = self._whole(head)
            self.held += len(head) + len(self.heads[head])

    def _learn_joined(self, words: list[str], ids: bytes) -> None:
        """Remember words by the ids of all of them, each after a blank."""
        if words:
            starts = np.flatnonzero(self.leads[np.frombuffer(ids, dtype="<u4")])
            if len(starts) == len(words):
                cuts = [*(starts * 4).tolist(), len(ids)]
                self.words.update((w, ids[cuts[k] : cuts[k + 1]]) for k, w in enumerate(words))
            else:  # a token of the file has a blank inside
                self.words.update((w, self._whole(" " + w)) for w in words)
            self.held += len(ids) + sum(map(len, words))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            if self.held > HELD:
                self.words, self.heads, self.held = {}, {}, 0
            own: list[list[list[str]] | str] = []
            words: set[str] = set()
            heads: set[str] = set()
            for text in texts[at : at + TOGETHER]:
                if not text or text[0].isspace() or text[-1].isspace() or _NEIGHBOURS(text):
                    own.append(text)
                    continue
                lines = [line.split(" ") for line in text.split("\n")]
                own.append(lines)
                for line in lines:
                    words.update(line[1:])
                    heads.add(line[0])
            self._learn([w for w in words if w not in self.words], [h for h in heads if h not in self.heads])
            of = self.words.__getitem__
            for lines in own:
                out.append(self._whole(lines) if isinstance(lines, str) else self.newline.join([self.heads[line[0]] + b"".join(map(of, line[1:])) for line in lines]))
        return [np.frombuffer(ids, dtype="<u4") for ids in out]
