"""Encoding and decoding with a sentencepiece BPE model, by merge rounds over flat arrays (operator 8).

The distinct words of a batch lie one after the other in one symbol array.  A round looks up the piece of every
neighbouring pair, takes the least rank of each word (a segmented minimum), merges its occurrences from the
left at the same time, and closes up the arrays; words without a pair leave.  Where a rank is shared, or a
larger piece beats the merged one, only the leftmost occurrence merges in that round, so the result is that of
merging one pair at a time.  Decoding goes back from ids to pieces to text.

Null texts count as empty (no ids); ties, repeated rows and null ids are rows like others; an empty table gives
an empty table; other columns of the input are ignored.  Texts are worked on in blocks that end between words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import texts
from tidegauge.llm.vocab import NONE, SPACE, Kept, Vocab, load
from tidegauge.session import prepare

WORDS = 250_000


def merge_rounds(v: Vocab, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, the place of each one's first character in the joined words, and the word of each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym, place = v.chars[codes], np.arange(len(codes))
    seg = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        merged = np.full(len(sym), -1, np.int32)
        merged[:-1] = v.merge_of(sym[:-1], sym[1:])
        merged[:-1][seg[:-1] != seg[1:]] = -1
        rank = np.where(merged >= 0, v.rank[merged], NONE)
        new = np.concatenate([[True], seg[1:] != seg[:-1]])
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(rank, starts)
        own = np.cumsum(new) - 1
        over = (least == NONE)[own]
        if over.any():
            done.append((sym[over], place[over], seg[over]))
            live = ~over
            sym, place, seg, rank, merged = sym[live], place[live], seg[live], rank[live], merged[live]
            own, least = own[live], least
            if not len(sym):
                break
        hit = rank == least[own]
        at = np.flatnonzero(hit)
        run = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
        first = np.maximum.accumulate(np.where(run, at, 0))
        word = own[at]
        leftmost = np.concatenate([[True], word[1:] != word[:-1]])
        chosen = at[np.where(v.at_once[rank[at]], (at - first) % 2 == 0, leftmost)]
        sym[chosen] = merged[chosen]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        sym, place, seg = sym[keep], place[keep], seg[keep]
    if not done:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sym, place, seg = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(seg, kind="stable")
    return sym[order], place[order], seg[order]


class Codec:
    """Encoder and decoder; keeps the words it has seen, up to a bound of memory."""

    def __init__(self, vocab: Vocab):
        self.v = vocab
        self.kept = Kept(WORDS)
        self.number = [str(i) for i in range(len(vocab.text))]
        self.shown = [t.replace(SPACE, " ") for t in vocab.text]

    def learn(self, words: list[str]) -> None:
        """Encode new words all together: ids as text, their number, the text decoded from the ids."""
        v, new, number, shown = self.v, self.kept, self.number, self.shown
        sym, place, seg = merge_rounds(v, words)
        known = len(v.text)
        bounds = np.searchsorted(seg, np.arange(len(words) + 1)).tolist()
        plain = np.ones(len(words), bool)
        plain[seg[sym >= known]] = False
        plain[seg[np.isin(sym, v.bytes)]] = False
        joined = "" if plain.all() else "".join(words)
        sym = sym.tolist()
        for k, (word, plain_) in enumerate(zip(words, plain.tolist())):
            lo, hi = bounds[k], bounds[k + 1]
            own = sym[lo:hi]
            if plain_:
                new[word] = ",".join([number[i] for i in own]), hi - lo, "".join([shown[i] for i in own])
            else:
                own = [i for s, p in zip(own, place[lo:hi].tolist()) for i in ([s] if s < known else [int(v.bytes[b]) for b in joined[p].encode()])]
                new[word] = ",".join(map(str, own)), len(own), self.decode(own)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, the mark before the first word included as a space."""
        raw, text = self.v.raw, self.v.text
        if not any(i in raw for i in ids):
            return "".join([text[i] for i in ids]).replace(SPACE, " ")
        return b"".join(raw[i] if i in raw else text[i].replace(SPACE, " ").encode() for i in ids).decode("utf-8", "replace")

    def spans(self, own: list[str]):
        """(index of the text, what its words became), block after block."""
        for spans in self.v.spans(own):
            for k, _, got in self.kept.fetch(spans, self.learn):
                yield k, got


_HELD: dict[str | None, Codec] = {}


def codec(model: str | None = None) -> Codec:
    if model not in _HELD:
        _HELD[model] = Codec(load(model))
    return _HELD[model]


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and ids, an array of all token ids of each whole text."""
    prepare(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part, own in texts(batch, column, 32):
                ids: list[list[int]] = [[] for _ in own]
                for k, words in c.spans(own):
                    ids[k] += [int(i) for w in words for i in w[0].split(",")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(ids: DataFrame, model: str | None = None, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key and the text that each array of ids (null: empty) decodes to."""
    prepare(ids.sparkSession)
    ids = ids.select(key, column)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                out = [c.decode(x or []).removeprefix(" ") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return ids.mapInArrow(run, f"`{key}` {ids.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Encode, decode and digest each text in one pass: key, n_tokens, ids_sha256, decoded_sha256, same (decoded as it was)."""
    prepare(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part, own in texts(batch, column):
                n, ids, back = [0] * len(own), [hashlib.sha256() for _ in own], [hashlib.sha256() for _ in own]
                for k, words in c.spans(own):
                    ids[k].update(("," * (n[k] > 0) + ",".join([w[0] for w in words])).encode())
                    text = "".join([w[2] for w in words])
                    back[k].update((text if n[k] else text.removeprefix(" ")).encode())
                    n[k] += sum([w[1] for w in words])
                ids, back = [x.hexdigest() for x in ids], [x.hexdigest() for x in back]
                same = [x == hashlib.sha256(t.encode()).hexdigest() for x, t in zip(back, own)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "same"],
                )

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
