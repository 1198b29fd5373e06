"""Exact token counts at every prefix of a text, by dynamic programming (operator 2).

The encoding of a prefix ends in one token, and what stands before it is the encoding of a shorter prefix.  A
token may follow another exactly if encoding their joined text gives the two back; whether an encoding is
right depends on neighbours only.  So the last token of each prefix is found from the last tokens of shorter
prefixes, and its count is theirs plus one: no prefix is encoded again.  Words are independent (no piece spans
two), so the recursion runs once for each distinct word of a worker, and counts of a text are sums over words.

Null texts count as empty (0 tokens); rows are independent, so ties, repeated rows and rows with null ids are
counted one by one; an empty table gives an empty table; other columns of the input are ignored.  Models must
be sentencepiece BPE with byte fallback, identity normalisation and a dummy prefix.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import texts
from tidegauge.llm.sentencepieces import merge_rounds
from tidegauge.llm.vocab import Kept, Lookup, Vocab, load
from tidegauge.session import prepare

WORDS = 600_000
LONG = 40
SLOTS = 21
BASE = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Counts for prefixes; keeps words, and which token may follow which, up to a bound of memory."""

    def __init__(self, vocab: Vocab):
        v = self.v = vocab
        self.kept = Kept(WORDS)
        self.texts = {i: t for t, i in v.symbol.items()}
        self.alone = np.zeros(v.size, bool)  # symbols that encode as themselves
        ids = list(v.symbol.values())
        sym, _, seg = merge_rounds(v, list(v.symbol))
        single = np.bincount(seg, minlength=len(ids)) == 1
        self.alone[np.array(ids)[single]] = sym[np.searchsorted(seg, np.flatnonzero(single))] == np.array(ids)[single]
        self.pieces = Lookup(np.array([self._hash(t) for t in v.symbol], np.uint64).view(np.int64), np.array(ids, np.int32))
        # what is known of pairs: a table with one place for each slot, so of bounded size
        self.pair, self.follows = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def learn(self, words: list[str]) -> None:
        """Run the recursion for new words, those of like length side by side."""
        new = self.kept
        words = sorted(words, key=len)
        at = 0
        while at < len(words) and len(words[at]) <= LONG:
            some = words[at : at + 20_000]
            some = some[: bisect_right(some, min(LONG, len(some[0]) + 6), key=len)]
            new.update(zip(some, self._side_by_side(some)))
            at += len(some)
        for word in words[at:]:
            counts = self._recursion(word)
            new[word] = bytes(counts) if counts[-1] < 256 else array("l", counts)

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        v, n = self.v, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        m = int(size.max())
        code = np.zeros((m, n), np.uint32)
        for k, row in enumerate(code):
            row[:] = [ord(w[k]) if k < len(w) else 0 for w in words]
        wide = np.where(code < 128, 1, np.where(code < 2048, 2, np.where(code < 65536, 3, 4)))
        hashed, power = np.zeros((m + 1, n), np.uint64), np.ones((m + 1, 1), np.uint64)
        for k in range(m):
            hashed[k + 1] = hashed[k] * BASE + code[k] + np.uint64(1)
            power[k + 1] = power[k] * BASE
        last, counts = np.full((m + 1, n), v.size, np.int64), np.zeros((m + 1, n), np.int64)
        for end in range(1, m + 1):
            open_ = np.flatnonzero(size >= end)
            for start in range(max(0, end - v.longest), end):
                if not len(open_):
                    break
                token = self.pieces.find((hashed[end, open_] - hashed[start, open_] * power[end - start]).view(np.int64))
                hit = np.flatnonzero(token >= 0)
                at, token = open_[hit], token[hit]
                ok = self._may_follow(last[start, at], token)
                at, token = at[ok], token[ok]
                last[end, at] = token
                counts[end, at] = counts[start, at] + (1 if start < end - 1 else np.where(token < len(v.text), 1, wide[start, at]))
                left = np.ones(len(open_), bool)
                left[hit[ok]] = False
                open_ = open_[left]
            last[end, open_] = v.unknown  # a character of no piece: its bytes, which nothing merges with
            counts[end, open_] = counts[end - 1, open_] + wide[end - 1, open_]
        out = counts[1:].T.astype(np.uint8).tobytes()
        return [out[k * m : k * m + s] for k, s in enumerate(size.tolist())]

    def _may_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        v = self.v
        ok = self.alone[token]
        ask = np.flatnonzero(ok & (before < v.unknown))
        key = before[ask] * v.size + token[ask]
        slot = ((key.view(np.uint64) * BASE) >> np.uint64(64 - SLOTS)).astype(np.int64)
        known = self.pair[slot] == key
        ok[ask] = known & self.follows[slot]
        if not known.all():
            ask, key = ask[~known], key[~known]
            each, back = np.unique(key, return_inverse=True)
            a, b = each // v.size, each % v.size
            sym, _, seg = merge_rounds(v, [self.texts[x] + self.texts[y] for x, y in zip(a.tolist(), b.tolist())])
            first = np.searchsorted(seg, np.arange(len(each)))
            good = (np.bincount(seg, minlength=len(each)) == 2) & (sym[first] == a) & (sym[np.minimum(first + 1, len(sym) - 1)] == b)
            slot = ((each.view(np.uint64) * BASE) >> np.uint64(64 - SLOTS)).astype(np.int64)
            self.pair[slot], self.follows[slot] = -1, False
            for s, k, g in zip(slot.tolist(), each.tolist(), good.tolist()):
                self.pair[s], self.follows[s] = k, g
            ok[ask] = good[back]
        return ok

    def _recursion(self, word: str) -> list[int]:
        """The same for one long word."""
        v = self.v
        last, counts = [v.size], [0]
        for end in range(1, len(word) + 1):
            found = [(s, t) for s in range(max(0, end - v.longest), end) if (t := v.symbol.get(word[s:end])) is not None and self.alone[t]]
            ok = self._may_follow(np.array([last[s] for s, _ in found], np.int64), np.array([t for _, t in found], np.int64)) if found else []
            start, token = next((x for x, y in zip(found, ok) if y), (end - 1, v.unknown))
            last.append(token)
            counts.append(counts[start] + (1 if token < len(v.text) else len(word[start].encode())))
        return counts[1:]

    def spans(self, own: list[str]):
        """(index of the text, its words, their counts), block after block."""
        for spans in self.v.spans(own):
            yield from self.kept.fetch(spans, self.learn)

    def counts(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ... as one list; what ``prefix_counts`` stores."""
        out, base = [], 0
        for _, _, got in self.spans([text]):
            for own in got:
                out += [base + c for c in own]
                base += own[-1]
        if out:
            out[0] = 0  # the mark before the first character alone is no text
        return out or [0]

    def totals(self, own: list[str], budget: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and the characters of its longest prefix within the budget.

        Counts need not rise with the prefix (a longer word may take fewer tokens), so the longest prefix is
        looked for in every word that begins within the budget.
        """
        total, chars, fits = [0] * len(own), [0] * len(own), [0] * len(own)
        for k, words, got in self.spans(own):
            after, length = total[k] + sum([c[-1] for c in got]), sum(map(len, words))
            if after <= budget:
                fits[k] = chars[k] + length - 1
            elif total[k] <= budget:
                base, at = total[k], chars[k]
                for c in got:
                    if base > budget:
                        break
                    fits[k] = max([fits[k], *(at + i for i, x in enumerate(c) if base + x <= budget)])
                    base, at = base + c[-1], at + len(c)
            total[k] = after
            chars[k] += length
        return total, fits


_HELD: dict[str | None, Prefixes] = {}


def prefixes(model: str | None = None) -> Prefixes:
    """One per Python worker, so that tasks share what it has seen."""
    if model not in _HELD:
        _HELD[model] = Prefixes(load(model))
    return _HELD[model]


def count_tokens(docs: DataFrame, budget: int = 4096, model: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit, and fit_chars, the characters of the longest prefix within the budget."""
    prepare(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches):
        p = prefixes(model)
        for batch in batches:
            for part, own in texts(batch, column):
                n, fit = p.totals(own, budget)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array(n, pa.int64()), pa.array([x > budget for x in n], pa.bool_()), pa.array(fit, pa.int64())],
                    names=[key, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, model: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and counts: element i (from 0) is the token count of the first i characters."""
    prepare(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches):
        p = prefixes(model)
        for batch in batches:
            for part, own in texts(batch, column, 16):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.counts(t) for t in own], pa.list_(pa.int32()))], names=[key, "counts"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, counts array<int>")


def truncate(docs: DataFrame, budget: int, model: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and the longest prefix of each text within the budget of tokens."""
    prepare(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches):
        p = prefixes(model)
        for batch in batches:
            for part, own in texts(batch, column):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[:k] for t, k in zip(own, p.totals(own, budget)[1])], pa.string())], names=[key, "prefix"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, prefix string")
