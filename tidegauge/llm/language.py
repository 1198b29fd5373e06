"""Language identification by a byte convolutional network (operator 6).

Texts are cut into windows of a fixed number of bytes, all of them, the last filled up with zero bytes.  Filters
of several widths run over the bytes (one weight for each byte value, place and filter), each filter keeps its
maximum in the window, and a softmax layer turns the maxima into probabilities.  A text's probabilities are the
means over its windows, weighted by their bytes.  Batches of windows go through numpy in the tasks.

Training happens in numpy on the driver, on a bounded sample: about ``rows`` labelled documents of each
language, chosen by hash, and ``pieces`` windows of each, at places chosen by hash.  Labels that are null teach
nothing.  The network is a few tens of KB.

A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned.
Repeated rows and null ids are rows like others; an empty table gives an empty table; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free, texts, whole
from tidegauge.session import prepare

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
ROWS, PIECES = 400, 4
MOST_LANGUAGES = 1000
EPOCHS, BATCH, RATE = 5, 64, 0.02
UNKNOWN = "und"
PREDICTED, SCORE = "lang_pred", "score"


def windows(raw: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some byte strings as rows, and the number of the string that each is from."""
    counts = np.array([-(-len(r) // size) for r in raw])
    out = np.zeros(int(counts.sum()) * size, np.uint8)
    at = 0
    for r, c in zip(raw, counts.tolist()):
        out[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += c * size
    return out.reshape(-1, size), np.repeat(np.arange(len(raw)), counts)


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pairs(self) -> None:
        """Tables over two bytes at once, so that a window needs fewer lookups."""
        first, second = np.divmod(np.arange(65536), 256)
        self.tables = [[f[j][first] + f[j + 1][second] if j + 1 < len(f) else f[j] for j in range(0, len(f), 2)] for f in self.filters]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "tables"):
            self.pairs()
        two = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
        maxima = []
        for table in self.tables:
            width = sum(2 if len(t) > 256 else 1 for t in table)
            n = x.shape[1] - width + 1
            sums = table[0][two[:, :n]]
            for j, t in enumerate(table[1:], 1):
                sums += t[two[:, 2 * j : 2 * j + n]] if len(t) > 256 else t[x[:, 2 * j : 2 * j + n]]
            maxima.append(sums.max(1))
        hidden = np.maximum(np.concatenate(maxima, 1) + self.bias, 0)
        return softmax(hidden @ self.dense + self.offset)

    def texts(self, raw: list[bytes], block: int = 256) -> np.ndarray:
        """Probabilities of each text."""
        out = np.zeros((len(raw), len(self.languages)))
        x, owner = windows(raw)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            weight = (part != 0).sum(1)
            np.add.at(out, owner[at : at + block], self.probabilities(part) * np.maximum(weight, 1)[:, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 0, epochs: int = EPOCHS, filters: int = FILTERS) -> Network:
    """Train by mini-batches with Adam.  Only the place of a filter's maximum passes a gradient on."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
    total = filters * len(WIDTHS)
    params = [*weights, np.zeros(total, np.float32), rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            own, n = x[rows], len(rows)
            maxima, places = [], []
            for f in params[: len(WIDTHS)]:
                span = own.shape[1] - len(f) + 1
                sums = f[0][own[:, :span]]
                for j in range(1, len(f)):
                    sums += f[j][own[:, j : j + span]]
                places.append(sums.argmax(1))
                maxima.append(np.take_along_axis(sums, places[-1][:, None], 1)[:, 0])
            raw = np.concatenate(maxima, 1) + params[-3]
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ params[-2] + params[-1])
            error[np.arange(n), y[rows]] -= 1
            error = (error / n).astype(np.float32)
            back = (error @ params[-2].T) * (raw > 0)
            grads = []
            for k, f in enumerate(params[: len(WIDTHS)]):
                g, part = np.zeros_like(f), back[:, k * filters : (k + 1) * filters]
                for j in range(len(f)):
                    np.add.at(g[j], (np.take_along_axis(own, places[k] + j, 1), np.arange(filters)[None, :]), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for p, g, m, s in zip(params, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(languages, params[: len(WIDTHS)], *params[len(WIDTHS) :])


def learn(docs: DataFrame, usable: Column, rows: int = ROWS, pieces: int = PIECES, seed: int = 0, key: str = "doc_id", column: str = "text", label: str = "lang") -> Network | None:
    """Train on labelled rows for which ``usable`` holds; None if there are none.

    Languages are counted over all usable rows; rows are then chosen by hash, with a share of rows / count for
    each language, so about ``rows`` of each come to the driver, as ``pieces`` windows at most.
    """
    prepare(docs.sparkSession)
    fit_rows = docs.filter(usable & F.col(label).isNotNull() & F.col(column).isNotNull())
    counts = {r[0]: r[1] for r in fit_rows.groupBy(F.col(label)).count().orderBy(label).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {label}")
    if not counts:
        return None
    share = F.element_at(F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / c)))]), F.col(label))
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    spread = F.greatest(F.lit(1), F.length(column) - WINDOW + 1)
    at = [F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(k)), spread).cast("int") + 1 for k in range(pieces)]
    chosen = fit_rows.filter(u < share).select(F.col(label), F.array(*[F.substring(column, a, F.lit(WINDOW)) for a in at]).alias("pieces"), F.col(key).cast("string"))
    chosen = chosen.limit(2 * rows * len(counts) + 1000)  # far above what the shares choose: a bound for the driver only
    got = sorted((r[2] or "", r[0], tuple(dict.fromkeys(r[1]))) for r in chosen.collect())
    languages = sorted(counts)
    raw = [(p.encode()[:WINDOW], languages.index(lang)) for _, lang, own in got for p in own if p]
    if not raw:
        return None
    x, owner = windows([r for r, _ in raw])
    return fit(x, np.array([k for _, k in raw])[owner], languages, seed)


def held_out(key: str) -> Column:
    """crc32(id as text) mod 4 is 2; not so for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def teaches(key: str) -> Column:
    """Rows that the network may learn from: not held out, and with an id."""
    return F.col(key).isNotNull() & ~held_out(key)


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", column: str = "text", keep: list[str] | None = None, names: tuple[str, str] = (PREDICTED, SCORE)) -> DataFrame:
    """One row per document: key, lang_pred, score (or other ``names``); with ``keep``, these columns of the input instead of the key."""
    prepare(docs.sparkSession)
    kept = keep or [key]
    (text,) = free(docs, "__text")
    rows = docs.select(*kept, F.coalesce(F.when(whole(column).rlike(r"\p{L}"), F.col(column)), F.lit("")).alias(text))
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")

    def run(batches):
        for batch in batches:
            for part, own in texts(batch, text):
                if network is None:
                    told, scores = [UNKNOWN] * len(own), [0.0] * len(own)
                else:
                    p = network.texts([t.encode() for t in own])
                    best = p.argmax(1)
                    told = [network.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), own)]
                    scores = [s if t else 0.0 for s, t in zip(p[np.arange(len(own)), best].tolist(), own)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(told, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", column: str = "text", label: str = "lang") -> DataFrame:
    """Learn from three quarters of the labelled rows and predict all: key, held_out, lang_pred, score.

    Held out are rows whose crc32(id as text) mod 4 is 2 (a null id is not held out, and teaches nothing).
    """
    network = learn(docs, teaches(key), key=key, column=column, label=label)
    return predict(docs, network, key, column).select(key, held_out(key).alias("held_out"), PREDICTED, SCORE)
