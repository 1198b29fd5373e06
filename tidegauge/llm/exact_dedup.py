"""Exact deduplication by Patricia tries that own the texts (operator 1).

Texts are compared after deleting white space, as UTF-8.  Each task inserts the full byte strings of its rows
into a compressed radix trie, whose terminal nodes keep the best owner so far and a count, and gives out one
row for each distinct text: a group of copies shrinks to one row for each task before anything is shuffled,
however large it is.  Those rows are dealt by (length, content hash), so all bytes of one text meet in one
partition, and are inserted into tries again; the terminals are the groups.  A trie over its budget of bytes
spills: its heaviest subtree goes to a file of the task, later strings that reach the subtree follow it there,
and the file is worked through as a trie of its own afterwards.  Documents find their group by text digest.

Null texts count as empty and are equal to other empty texts.  Of equal texts the one with the most code
points stays, then the smallest id; a null id comes after all others, and repeated rows (equal in id too) each
count towards the group's size and stand in the result.  An empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BLANK, Stored, free, texts, whole

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
TRIE_BYTES = 96 << 20
NODE_BYTES = 400

# node of a trie: the bytes from START to END of TEXT lead to it
TEXT, START, END, BELOW, OWNER, FILE = range(6)
Owner = tuple[int, int | None, int, int]  # code points, id, rows, rows that are equal in both


def better(a: Owner | None, b: Owner) -> Owner:
    """The owner that stays of two, with the rows of both: most code points, then smallest id, null last."""
    if a is None:
        return b
    first = (-a[0], a[1] is None, a[1] or 0) <= (-b[0], b[1] is None, b[1] or 0)
    keep = a if first else b
    return keep[0], keep[1], a[2] + b[2], a[3] + b[3] if a[:2] == b[:2] else keep[3]


class Trie:
    """Compressed radix trie over byte strings; each terminal node keeps the best owner."""

    def __init__(self, budget: int = TRIE_BYTES, depth: int = 0):
        self.budget, self.held, self.depth = budget, 0, depth
        self.root = [b"", 0, 0, {}, None, None]

    def insert(self, text: bytes, owner: Owner) -> None:
        node, at, size = self.root, 0, len(text)
        while True:
            if node[FILE] is not None:  # spilled: what comes here goes after it
                pickle.dump((text, owner), node[FILE])
                return
            if at == size:
                node[OWNER] = better(node[OWNER], owner)
                return
            child = node[BELOW].get(text[at])
            if child is None:
                node[BELOW][text[at]] = [text, at, size, {}, owner, None]
                self.held += size - at + NODE_BYTES
                return
            start, end = child[START], child[END]
            if text[start:end] == child[TEXT][start:end]:
                node, at = child, end
                continue
            cut = start + common(text, child[TEXT], start, min(end, size))
            middle = [child[TEXT], start, cut, {child[TEXT][cut]: child}, None, None]
            child[START] = cut
            node[BELOW][text[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, cut

    def entries(self, node=None) -> Iterator[tuple[bytes, Owner]]:
        """Texts held in memory below a node, with their owners."""
        todo = [node or self.root]
        while todo:
            node = todo.pop()
            if node[OWNER] is not None:
                yield node[TEXT][: node[END]], node[OWNER]
            todo += node[BELOW].values()

    def spill(self, folder: str) -> None:
        """Put the heaviest subtree below the first branching into a file of its own."""
        node = self.root
        while len(node[BELOW]) == 1 and node[OWNER] is None:
            node = next(iter(node[BELOW].values()))
        weights = {first: sum(len(t) + NODE_BYTES for t, _ in self.entries(child)) for first, child in node[BELOW].items() if child[FILE] is None}
        if not weights:
            return
        child = node[BELOW][max(weights, key=lambda k: (weights[k], k))]
        file = tempfile.NamedTemporaryFile(dir=folder, delete=False)
        for entry in self.entries(child):
            pickle.dump(entry, file)
        for name in self.files(child):  # what was spilled further down goes along
            for entry in read(name):
                pickle.dump(entry, file)
            os.unlink(name)
        child[BELOW], child[OWNER], child[FILE] = {}, None, file
        # the child keeps only the bytes that lead to it
        child[TEXT] = child[TEXT][: child[END]]
        self.held -= weights[child[TEXT][child[START]]]

    def files(self, node=None) -> list[str]:
        """Files of the subtrees below a node that were spilled, closed."""
        out, todo = [], [node or self.root]
        while todo:
            node = todo.pop()
            if node[FILE] is not None:
                node[FILE].close()
                out.append(node[FILE].name)
            todo += node[BELOW].values()
        return out


def common(a: bytes, b: bytes, start: int, end: int) -> int:
    """Length of the common prefix of a[start:end] and b[start:end], by halving."""
    low, step = 0, 16
    while start + low + step <= end and a[start + low : start + low + step] == b[start + low : start + low + step]:
        low += step
        step *= 2
    high = min(low + step, end - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[start + low : start + mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def owners(entries: Iterator[tuple[bytes, Owner]], budget: int, folder: str) -> Iterator[tuple[bytes, Owner]]:
    """Each distinct text once with its owner, in bounded memory."""
    trie, refused = Trie(budget), 0
    for text, owner in entries:
        trie.insert(text, owner)
        if trie.held > budget + refused:
            before = trie.held
            trie.spill(folder)
            refused += budget if trie.held == before else 0
    yield from trie.entries()
    files = trie.files()
    del trie
    for name in files:
        yield from owners(read(name), budget, folder)
        os.unlink(name)


def read(name: str) -> Iterator[tuple[bytes, Owner]]:
    with open(name, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


FIELDS = [("length", pa.int64()), ("hash", pa.int64()), ("bytes", pa.binary()), ("points", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("twins", pa.int64())]


def _rows(found, digest: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for text, (points, key, rows, twins) in found:
        sha = hashlib.sha256(text)
        held.append((sha.hexdigest(), key, rows, twins) if digest else (len(text), int.from_bytes(sha.digest()[:8], "little", signed=True), text, points, key, rows, twins))
        size += 0 if digest else len(text)
        if len(held) >= 4096 or size > 8 << 20:
            yield _batch(held, digest)
            held, size = [], 0
    if held:
        yield _batch(held, digest)


def _batch(held: list[tuple], digest: bool) -> pa.RecordBatch:
    fields = [("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("twins", pa.int64())] if digest else FIELDS
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])


def groups(docs: DataFrame, key: str = "doc_id", column: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: text_sha256 of its bytes, keep_id (integer id of the row that stays), group_size, twins.

    ``twins`` counts the rows that have the id and the code points of the row that stays (1, unless rows repeat).
    """

    def local(batches):
        trie = Trie(budget)
        for batch in batches:
            for part, own in texts(batch, "text"):
                for key_, text in zip(part.column(0).to_pylist(), own):
                    trie.insert(text.encode().translate(None, SPACES), (len(text), key_, 1, 1))
                    if trie.held > budget:  # not the last word on any text, so what is held may go at any time
                        yield from _rows(trie.entries(), False)
                        trie = Trie(budget)
        yield from _rows(trie.entries(), False)

    def meet(batches):
        with tempfile.TemporaryDirectory() as folder:  # of this task only, gone with it
            entries = ((t, tuple(owner)) for b in batches for t, *owner in zip(*(b.column(c).to_pylist() for c in ("bytes", "points", "id", "rows", "twins"))))
            yield from _rows(owners(entries, budget, folder), True)

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
    dealt = slim.mapInArrow(local, "length long, hash long, bytes binary, points long, id long, rows long, twins long").repartition("length", "hash")
    return dealt.mapInArrow(meet, "text_sha256 string, keep_id long, group_size long, twins long")


def digest(column: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(whole(column), f"[{BLANK}]+", ""), 256)


def deduplicate(docs: DataFrame, key: str = "doc_id", column: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document, dropped ones too: key, keep_id, group_size, kept, text_sha256.

    ``key`` must be of an integer type.  Of rows that repeat in id and length as well, all are marked as kept.
    """
    # the groups are read by one join only, so nothing is stored; a large group joins one row, and skew joins split its side
    member = docs.select(F.col(key).alias("doc_id"), digest(column).alias("text_sha256"))
    out = member.join(groups(docs, key, column, budget), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, key: str = "doc_id", column: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; of rows equal in id and length any one."""
    text, keep, stays_text, twins = free(docs, "__text", "__keep", "__stays", "__twins")
    found = groups(docs, key, column, budget).select(F.col("keep_id").alias(keep), F.col("text_sha256").alias(stays_text), F.col("twins").alias(twins))
    stays = Stored(docs, "exact-dedup").put(found)  # an id and a digest for each distinct text
    marked = docs.withColumn(text, digest(column))
    kept = marked.join(stays, (F.col(text) == F.col(stays_text)) & F.col(key).eqNullSafe(F.col(keep)), "left_semi")
    if not stays.filter(F.col(twins) > 1).isEmpty():
        kept = kept.dropDuplicates([key, text])
    return kept.drop(text)


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, max(points) AS points FROM t GROUP BY 1),
k AS (SELECT text_sha256, min(doc_id) AS keep_id FROM t JOIN g USING (text_sha256, points) GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256) JOIN k USING (text_sha256)
"""
