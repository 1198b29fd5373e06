"""Merge tables of a sentencepiece BPE model with byte fallback.

The model file is only read for its pieces and scores; encoding is done by the callers.  Merging joins two
neighbouring symbols whose text together is a piece, best score first, leftmost among equals.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
PUNCTUATION = [chr(c) for c in range(128) if not chr(c).isalpha()]
BLOCK = 1 << 20
NONE = np.int32(2**31 - 1)


class Lookup:
    """Open-addressing table from 64-bit keys to ids, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2.5 * len(keys) + 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.ids[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ids[at[put]] = keys[put], ids[put]
            keys, ids, at = keys[~put], ids[~put], (at[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Id of each key, or -1."""
        at = self._slot(key)
        out, same = self.ids[at], self.keys[at] == key
        open_ = np.flatnonzero(~same & (out >= 0))
        out[~same] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            ids, same = self.ids[at[open_]], self.keys[at[open_]] == key[open_]
            out[open_[same]] = ids[same]
            open_ = open_[~same & (ids >= 0)]
        return out


class Vocab:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        #: piece text by id; a byte piece is one byte of UTF-8
        self.raw = {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        self.id = {p: i for i, p in enumerate(self.text) if not special[i]}
        # characters that stand in pieces without being pieces: symbols that end as bytes
        loose = sorted({c for p in self.id for c in p} - set(self.id))
        self.symbol = self.id | {c: n + k for k, c in enumerate(loose)}
        self.size = n + len(loose) + 1
        self.unknown = self.size - 1
        self.longest = max(map(len, self.id))
        score = {i: -lib.get_score(i) for i in self.id.values()}
        dense = {s: r for r, s in enumerate(sorted(set(score.values())))}
        self.rank = np.full(self.size, NONE, np.int32)
        for i, s in score.items():
            self.rank[i] = dense[s]
        self.pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self._together()
        self.lookup = Lookup(np.array([a * self.size + b for a, b in self.pairs], np.int64), np.array(list(self.pairs.values()), np.int32))
        self.chars = np.full(0x110000, self.unknown, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self._splitter()

    def _together(self) -> None:
        """Ranks whose occurrences in a word may merge in one round.

        Not so where pieces share a score, or where a piece that contains the merged one beats it: the first
        merge could then be followed by another before the next occurrence's turn.
        """
        count = np.bincount(self.rank[self.rank != NONE])
        self.at_once = count == 1
        for (a, b), i in self.pairs.items():
            for part in (a, b):
                if self.rank[part] != NONE and self.rank[i] <= self.rank[part]:
                    self.at_once[self.rank[part]] = False

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, or -1."""
        return self.lookup.find(left.astype(np.int64) * self.size + right)

    def _splitter(self) -> None:
        """Words are spans that no piece reaches out of: cut before spaces and between two classes of characters.

        The classes start as ASCII punctuation, digits and controls against the rest, and any character that
        shares a piece with the first class joins it; so no piece spans a cut, whatever the model.
        """
        near: dict[str, set[str]] = {}
        spans = False
        for p in self.id:
            for x, y in zip(p, p[1:]):
                spans |= y == SPACE != x
                if SPACE not in (x, y):
                    near.setdefault(x, set()).add(y)
                    near.setdefault(y, set()).add(x)
        if spans:
            self.words = re.compile("(?s).+").findall
            self.cut = None
            return
        first, todo = set(PUNCTUATION), list(PUNCTUATION)
        while todo:
            for c in near.get(todo.pop(), ()):
                if c not in first:
                    first.add(c)
                    todo.append(c)
        inside = "".join(re.escape(c) for c in sorted(first))
        self.words = re.compile(f"{SPACE}*(?:[^{SPACE}{inside}]+|[{inside}]+)|{SPACE}+").findall
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")

    def blocks(self, text: str):
        """The text with its spaces marked, in pieces of bounded length that end between words."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        at = 0
        while at < len(marked):
            end = len(marked)
            if self.cut and end - at > BLOCK and (m := self.cut.search(marked, at + BLOCK)):
                end = m.start()
            yield marked[at:end]
            at = end

    def spans(self, own: list[str], most: int = 2 * BLOCK):
        """Words of some texts as lists of (index of the text, words), each list of bounded length."""
        out, size = [], 0
        for k, text in enumerate(own):
            for block in self.blocks(text):
                out.append((k, self.words(block)))
                size += len(block)
                if size >= most:
                    yield out
                    out, size = [], 0
        if out:
            yield out


class Kept(dict):
    """What words became, in two generations: the older one goes when the newer is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.new = most, {}, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            self.new[word] = None
        else:
            self[word] = got
        return got

    def fetch(self, spans: list[tuple[int, list[str]]], learn) -> list[tuple[int, list[str], list]]:
        """Spans with what their words became; ``learn`` puts in the words that are new, all together."""
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()
        out, again = [], []
        for k, words in spans:
            before = len(self.new)
            got = list(map(self.__getitem__, words))
            if self.new and (len(self.new) > before or None in got):
                again.append(len(out))
            out.append((k, words, got))
        if self.new:
            learn(list(self.new))
            self.new = {}
            for at in again:
                k, words, _ = out[at]
                out[at] = k, words, list(map(self.__getitem__, words))
        return out


@lru_cache(maxsize=2)
def load(path: str | None = None) -> Vocab:
    """One table per Python worker; the default file is looked up where the worker runs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Vocab(path)
