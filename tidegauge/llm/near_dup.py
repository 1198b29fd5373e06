"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles (operator 4).

1. Shingles of five words carry weight tf * idf, with idf = 1 + ln(min(N / df, 1 / COMMON)): document frequencies df are
   exact over all N documents for every shingle in a share COMMON of them or more; rarer ones weigh alike, so tables of
   up to 1 / COMMON documents have no such limit.  There are at most (shingles per document) / COMMON frequent ones, however many documents
   there are, so their table may go to every task.  A tally of all shingles over 2 ** SLOTS counters, added up in two levels, tells
   which can be frequent (no count is below the true one); those are then counted exactly.
2. Documents with the same multiset of shingles fall together at once (a 128-bit digest), so copies cost one row.
3. Each distinct one draws BANDS * EACH consistent weighted samples; documents that share all samples of a band
   are candidates.  A candidate is tied to the first document of its bucket if their samples agree in at least
   LEAST of the places (true partners fall below with a probability under 1e-4, as in any band).  Members of buckets in which one does not are
   compared by their samples with each other, in tiles of bounded size.  So large buckets give chains, not pairs.
4. Candidates that hang together form a family.  Within a family all pairs that are not yet in one class are
   verified by exact weighted Jaccard similarity of their shingles, tile by tile, from an inverted list of the tile; links found give the classes.
   A tile holds TILE documents of a family at most, so a family of any size is split.

Joins that carry texts or samples are merge joins at every size: the small sides grow with the documents.

Null texts and texts without a word are classes of their own.  Texts of one to four words have one shingle.
Rows that share a doc_id are one document with several texts and fall in one class.  Rows with a null id
count in the frequencies but are not compared: their class is null.  Repeated rows fall in one class.  An empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Stored, free, texts, whole
from tidegauge.llm.components import components
from tidegauge.llm.shingles import mix, weighed
from tidegauge.session import prepare

SIZE, SIMILAR = 5, 0.8
BANDS, EACH = 20, 4
LEAST = 0.63
COMMON = 0.001
CHUNK = 1_000_000
SLOTS, PIECE = 22, 16
TILE = 512
BITS = 16


class Weights:
    """idf of shingles: a table of the frequent ones, one weight for all others."""

    def __init__(self, documents: int, shingle: np.ndarray, df: np.ndarray, share: float = COMMON):
        order = np.argsort(shingle)
        self.rare = 1 + np.log(1 / share)
        self.keys, self.idf = shingle[order], 1 + np.log(np.minimum(documents / df[order], 1 / share))

    def of(self, shingle: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), self.rare)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingle), len(self.keys) - 1)
            hit = self.keys[at] == shingle
            out[hit] = self.idf[at[hit]]
        return out * times


@lru_cache(maxsize=1)
def variates(samples: int, rare: float, seed: int = 0):
    """Random numbers of the sampling by bits of a shingle's hash: r and beta by one half word, ln c by another.

    For weight ``rare``, which most shingles have, what follows from r and beta is worked out beforehand.
    """
    r, beta, log_c, fixed = (np.empty((samples, 1 << BITS), np.float32) for _ in range(4))
    for k in range(samples):  # one place after the other, so that doubles are held for one only
        rng = np.random.default_rng((seed, k))
        r[k], beta[k], log_c[k] = rng.gamma(2, 1, 1 << BITS), rng.random(1 << BITS), np.log(rng.gamma(2, 1, 1 << BITS))
        fixed[k] = -r[k] * (level_of(rare, r[k], beta[k]) - beta[k]) - r[k]
    return r, beta, log_c, fixed


def level_of(weight: float, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.floor(np.float32(np.log(weight)) / r + beta)


def sample(shingle: np.ndarray, weight: np.ndarray, count: np.ndarray, samples: int, rare: float) -> np.ndarray:
    """Consistent weighted samples of documents with at least one shingle each: a 32-bit value for each place."""
    r, beta, log_c, fixed = variates(samples, rare)
    one = (shingle & np.uint64((1 << BITS) - 1)).astype(np.int64)
    two = ((shingle >> np.uint64(BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    odd = np.flatnonzero(weight != rare)
    log_w = np.log(weight[odd]).astype(np.float32)
    odd_one = one[odd]
    starts = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    out = np.empty((len(count), samples), np.uint32)
    for k in range(samples):
        a = fixed[k][one] + log_c[k][two]
        if len(odd):
            rk, bk = r[k][odd_one], beta[k][odd_one]
            t = np.floor(log_w / rk + bk)
            a[odd] = log_c[k][two[odd]] - rk * (t - bk) - rk
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[owner])
        at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        t = level_of(rare, r[k][one[at]], beta[k][one[at]]).astype(np.int64)
        if len(odd):
            own = np.minimum(np.searchsorted(odd, at), len(odd) - 1)
            other = odd[own] == at
            i = one[at[other]]
            t[other] = np.floor(log_w[own[other]] / r[k][i] + beta[k][i]).astype(np.int64)
        out[:, k] = mix(shingle[at] ^ mix(t.view(np.uint64) + np.uint64(k + 1))).astype(np.uint32)
    return out


def _packed(piece: int, salt: int, total: np.ndarray) -> pa.RecordBatch:
    """Counters of a piece in the narrowest integers that hold them; only those above zero where few are."""
    kind = next(k for k in ("u1", "u2", "u4", "i8") if total.max() <= np.iinfo(k).max)
    at = np.flatnonzero(total)
    few = 4 * len(at) < len(total)
    fields = [pa.array([piece], pa.int32()), pa.array([salt], pa.int32()), pa.array([kind]), pa.array([at.astype("u2").tobytes() if few else None], pa.binary()), pa.array([(total[at] if few else total).astype(kind).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(fields, names=["piece", "salt", "kind", "place", "counts"])


def _added(batches) -> dict[int, np.ndarray]:
    """Sums of the counters of each piece."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, kind, place, counts in zip(*(batch.column(c).to_pylist() for c in ("piece", "kind", "place", "counts"))):
            total = out.setdefault(piece, np.zeros(1 << PIECE, np.int64))
            total[slice(None) if place is None else np.frombuffer(place, "u2")] += np.frombuffer(counts, kind)
    return out


def possible(rows: DataFrame, least: float, size: int) -> np.ndarray:
    """A flag for each slot of the tally: some shingle of that slot may stand in ``least`` documents."""

    def tally(batches):
        total, held = np.zeros(1 << SLOTS, np.int64), [np.zeros(0, np.int64)]
        for batch in batches:
            for _, own in texts(batch):
                held.append((weighed(own, size)[0] >> np.uint64(64 - SLOTS)).astype(np.int64))
                if sum(map(len, held)) > CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=1 << SLOTS)
                    held = [held[0]]
        total += np.bincount(np.concatenate(held), minlength=1 << SLOTS)
        salt = TaskContext.get().partitionId() >> 6
        for piece, own in enumerate(total.reshape(-1, 1 << PIECE)):
            if own.any():
                yield _packed(piece, salt, own)

    def add(batches):
        for piece, total in _added(batches).items():
            yield _packed(piece, 0, total)

    def flag(batches):
        for piece, total in _added(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["piece", "flags"])

    form = "piece int, salt int, kind string, place binary, counts binary"
    sums = rows.mapInArrow(tally, form).repartition("piece", "salt").mapInArrow(add, form)
    out = np.zeros((1 << (SLOTS - PIECE), 1 << PIECE), bool)
    for piece, flags in sums.repartition("piece").mapInArrow(flag, "piece int, flags binary").collect():  # one row a piece, 8 KB each
        out[piece] = np.unpackbits(np.frombuffer(flags, np.uint8)).astype(bool)
    return out.reshape(-1)


def idf(docs: DataFrame, text: str, size: int = SIZE, share: float = COMMON) -> Weights:
    """Weights of the shingles of all documents (see 1. above)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.lower(whole(text)).alias("text"))
    documents = rows.count()
    flags = np.packbits(possible(rows, share * documents, size))

    def count(batches):
        open_, held = np.unpackbits(flags).astype(bool), []

        def counted():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["shingle", "documents"])

        for batch in batches:
            for _, own in texts(batch):
                got = weighed(own, size)[0]
                held.append(got[open_[got >> np.uint64(64 - SLOTS)]])
                if sum(map(len, held)) > CHUNK:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    counted = rows.mapInArrow(count, "shingle long, documents long").groupBy("shingle").agg(F.sum("documents").alias("documents"))
    found = counted.filter(F.col("documents") >= share * documents).toArrow()
    return Weights(documents, found.column("shingle").to_numpy().view(np.uint64), found.column("documents").to_numpy(), share)


def signatures(docs: DataFrame, weights: Weights, key: str, text: str, size: int = SIZE, bands: int = BANDS, each: int = EACH) -> DataFrame:
    """One row per document that has a word: doc_id, digest (two longs), samples, bands (a long for each)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(whole(text)).alias("text"))

    def run(batches):
        for batch in batches:
            for part, own in texts(batch):
                shingle, times, count = weighed(own, size)
                has = np.flatnonzero(count)
                if not len(has):
                    continue
                count = count[has]
                starts = np.cumsum(count) - count
                mark = mix(shingle ^ mix(times.astype(np.uint64)))
                got = sample(shingle, weights.of(shingle, times), count, bands * each, weights.rare)
                key_ = np.zeros((len(has), bands), np.uint64)
                for j in range(each):
                    key_ = mix(key_ + got[:, j::each] + np.uint64(j + 1))
                key_ = mix(key_ + np.arange(bands, dtype=np.uint64))
                flat = pa.array(key_.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(has)),
                        pa.array(np.add.reduceat(mark, starts).view(np.int64)),
                        pa.array(np.add.reduceat(mix(mark + np.uint64(1)), starts).view(np.int64)),
                        pa.array([g.tobytes() for g in got], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), flat),
                    ],
                    names=["doc_id", "d1", "d2", "samples", "bands"],
                )

    return rows.mapInArrow(run, "doc_id long, d1 long, d2 long, samples binary, bands array<long>")


class Classes:
    """Classes of a few documents of a tile, joined by links."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 2, names=["a", "b"])


def agreeing(tile: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links between documents of a tile whose samples agree; a tree of them for each set that hangs together."""
    node = tile.column("node").to_numpy()
    got = np.frombuffer(b"".join(tile.column("samples").to_pylist()), np.uint32).reshape(len(node), -1)
    classes, out = Classes(len(node)), []
    for i in range(len(node) - 1):
        for j in (i + 1 + np.flatnonzero((got[i + 1 :] == got[i]).mean(1) >= least)).tolist():
            if node[i] != node[j] and classes.join(i, j):
                out.append((int(node[i]), int(node[j])))
    return out


def tiled(df: DataFrame, group: list[str], size: str, tile: int) -> DataFrame:
    """Rows dealt to tiles of their group, so that every two rows of a group meet in one: adds ``tile``.

    A group of up to ``tile`` rows is one tile.  A larger one is dealt by hash into blocks of half that, and any two
    blocks form a tile.
    """
    blocks = F.when(F.col(size) <= tile, F.lit(1)).otherwise(F.ceil(F.col(size) / (tile // 2))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    place = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda o: F.least(F.col("__b"), o) * F.col("__n") + F.greatest(F.col("__b"), o))
    # two blocks meet in the tile of their pair; a pair of a block with itself is part of those
    place = F.when(F.col("__n") == 1, F.array(F.lit(0))).otherwise(F.array_remove(place, F.col("__b") * F.col("__n") + F.col("__b")))
    return df.withColumn("__n", blocks).withColumn("__b", own).withColumn("tile", F.explode(place)).drop("__n", "__b")


def candidates(nodes: DataFrame, stored: Stored, least: float, tile: int) -> DataFrame:
    """Links (a, b) between nodes that may be near-duplicates, few for each node (see 3. above)."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = stored.put(rows.join(buckets.hint("merge"), "bucket"))
    pairs = members.filter("node <> first").select("node", "first").distinct()
    samples = nodes.select("node", "samples")
    both = pairs.hint("merge").join(samples, "node").hint("merge").join(samples.select(F.col("node").alias("first"), F.col("samples").alias("others")), "first")

    def compare(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("samples", "others"))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("first"), pa.array((x == y).mean(1) >= least)], names=["node", "first", "agree"])

    judged = stored.put(both.select("node", "first", "samples", "others").mapInArrow(compare, "node long, first long, agree boolean"))
    mixed = members.join(judged.filter("NOT agree"), ["node", "first"]).select("bucket").distinct()
    rest = tiled(members.join(mixed, "bucket", "left_semi"), ["bucket"], "size", 4 * tile).join(samples, "node")
    within = rest.groupBy("bucket", "tile").applyInArrow(lambda t: _edges(agreeing(t, least)), "a long, b long")
    return judged.filter("agree").select(F.col("node").alias("a"), F.col("first").alias("b")).union(within)


def verified(node: np.ndarray, values: list[np.ndarray], weights: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links between documents of a tile by exact weighted Jaccard similarity; a tree of them for each class.

    An inverted list of the tile's shingles gives, for one document after the other, the weight that it shares with all
    later ones.  Documents that a class holds already are not compared with each other again.
    """
    order = np.argsort([-len(v) for v in values], kind="stable")
    count = np.array([len(values[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), count)
    value, weight = np.concatenate([values[i] for i in order]), np.concatenate([weights[i] for i in order])
    total = np.array([weights[i].sum() for i in order])
    by = np.argsort(value, kind="stable")
    value, owner_by, weight_by = value[by], owner[by], weight[by]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(value))
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1  # list of each entry, in the order of the documents
    first = np.cumsum(count) - count
    classes, out = Classes(len(order)), []
    for i in range(len(order) - 1):
        lists = place[first[i] : first[i] + count[i]]
        lo, size = start[lists], end[lists] - start[lists]
        many = size > 1
        if not many.any():
            continue
        lo, size, own = lo[many], size[many], weight[first[i] : first[i] + count[i]][many]
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        shared = np.bincount(owner_by[at], np.minimum(weight_by[at], np.repeat(own, size)), len(order))
        close = shared >= similar * (total + total[i] - shared) - 1e-9 * total[i]
        close[: i + 1] = False
        for j in np.flatnonzero(close).tolist():
            if classes.join(i, j):
                out.append((int(node[order[i]]), int(node[order[j]])))
    return out


def links(docs: DataFrame, families: DataFrame, weights: Weights, key: str, text: str, size: int, similar: float, tile: int) -> DataFrame:
    """Links (a, b) of similarity ``similar`` or more inside families (node, root)."""
    sized = families.join(families.groupBy("root").agg(F.count("*").alias("size")), "root")
    rows = docs.select(F.col(key).cast("long").alias("node"), F.lower(whole(text)).alias("text")).join(sized.hint("merge"), "node")

    def blobs(batches):
        for batch in batches:
            for part, own in texts(batch):
                shingle, times, count = weighed(own, size)
                ends = np.cumsum(count)
                packed = [shingle[e - c : e].tobytes() for e, c in zip(ends, count)]
                several = [times[e - c : e].astype(np.int32).tobytes() if (times[e - c : e] > 1).any() else b"" for e, c in zip(ends, count)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), part.column("size"), pa.array(packed, pa.binary()), pa.array(several, pa.binary())], names=["node", "root", "size", "shingles", "times"])

    packed = rows.select("node", "root", "size", "text").mapInArrow(blobs, "node long, root long, size long, shingles binary, times binary")
    parts = tiled(packed, ["root"], "size", tile)

    def meet(t: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        times = [np.frombuffer(x, np.int32) if x else np.ones(len(v), np.int32) for x, v in zip(t.column("times").to_pylist(), values)]
        return _edges(verified(t.column("node").to_numpy(), values, [weights.of(v, n) for v, n in zip(values, times)], similar))

    return parts.select("root", "tile", "node", "shingles", "times").groupBy("root", "tile").applyInArrow(meet, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similar: float = SIMILAR, bands: int = BANDS, each: int = EACH, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), first (it is that one)."""
    stored = Stored(docs, "near-dup")
    weights = idf(docs, text, size)
    named = docs.filter(F.col(key).isNotNull())
    signed = stored.put(signatures(named, weights, key, text, size, bands, each))
    digests = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = stored.put(signed.select("doc_id", "d1", "d2").distinct().join(digests, ["d1", "d2"]).select("doc_id", "rep", "d1", "d2"))
    reps = member.filter("doc_id = rep").select(F.col("doc_id").alias("node"), "d1", "d2")
    nodes = signed.join(reps.hint("merge"), (F.col("doc_id") == F.col("node")) & (signed["d1"] == reps["d1"]) & (signed["d2"] == reps["d2"]), "left_semi")
    nodes = stored.put(nodes.select(F.col("doc_id").alias("node"), "samples", "bands").dropDuplicates(["node", "samples"]))
    families = stored.put(components(candidates(nodes, stored, least, tile), stored))
    found = links(named, families, weights, key, text, size, similar, tile)
    same = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    root = components(found.union(same), stored)
    out = docs.select(F.col(key).cast("long").alias("doc_id")).join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), (F.col("root").isNull() | (F.col("root") == F.col("doc_id"))).alias("first"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, the one with the smallest id of each class, with all their columns.

    Rows that repeat an id all stay if it is the smallest of its class, and so do rows with a null id.
    """
    (name,) = free(docs, "__gone")
    gone = classes(docs, key, text, **options).filter("NOT first").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col(key) == F.col(name), "left_anti")
