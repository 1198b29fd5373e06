"""Merkle manifest, personal data and vector codes: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tidegauge.llm import codes, merkle, personal


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n):
        return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))

    def climb(hashes):
        """Top, and for each leaf its (left, right) siblings by level."""
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for k, p in enumerate(at):
                run = p // 3 * 3
                paths[k].append(("".join(hashes[run:p]), "".join(hashes[p + 1 : run + 3])))
                at[k] = p // 3
            hashes = [H(*hashes[i : i + 3]) for i in range(0, len(hashes), 3)]
        return hashes[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda x: x[:3])
        trees.append((own, *climb([x[2] for x in own])))
    root, over = climb([t[1] for t in trees])
    out = []
    for (own, sub, paths), up in zip(trees, over):
        for (_, _, h, r), path in zip(own, paths):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r[0], r[1] and r[1].replace("\n", ""), *r[2:]) if cut else h
            for left, right in path + up:
                now = H(left, now, right)
            proof = H(*(left + right for left, right in path + up))
            out.append((r[0], h, sub, root, proof, now, now == root))
    return Counter(out)


def some_docs(n, seed, sources):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a\nb", "plain", "", None, "é🙂\n"]) , rnd.choice(["en", None]), rnd.choice(sources), rnd.choice([None, 3, -1])) for k in range(n)]
    return rows


@pytest.mark.parametrize("case", ["one", "two", "edges", "many sources", "deep"])
def test_manifest(docs, monkeypatch, case):
    monkeypatch.setattr(merkle, "BLOCK", 50)  # so that copies of nodes with many leaves are needed here
    rows = {
        "one": [(5, "a\nb", None, None, 1)],
        "two": [(5, "a\nb", None, "s", 1), (6, "a\nb", "en", "t", None)],
        "edges": [(*r, *[None] * (5 - len(r))) for r in ROWS] + [(None, "a\nb", None, None, 4), (None, None, None, None, None)],
        "many sources": [*some_docs(40, 1, [f"s{k}" for k in range(30)] + ["", None, "é", "\U0001f642"]), (5, "again", "en", "s1", 0)],
        "deep": some_docs(900, 2, ["hot"] * 20 + ["é", "z", None]),
    }[case]
    got = merkle.manifest(docs(rows))
    assert Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())) == brute_manifest(rows)


def test_manifest_of_nothing(docs):
    assert merkle.manifest(docs([])).count() == 0


def brute_spans(text):
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


PERSONAL = [
    None,
    "",
    "a.b+c@mail.example.com, x@y, x@y.z@w.v, _@-.-",
    "🙂 é a@b.cc_d@e.ff a@b.c@d.e ..@a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 0000255.255.255.255 999999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112 4111 1111  1111 1111",
    "12 4111111111111111 and 6304000000000000000 1-2-3-4",
    "+1 (956) 555-0122, +49 30 1234567. +1 2 ++1 234-5678- (1) +123456789012345 +1234567890123456",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE88370400440532013000 xGB82WEST12345698765432",
    "social security 123-45-6789, plain 123-45-6789 far from any of the words that would tell its meaning",
    "call me: (956) 555-0122 or by phone 956-555-0123. Nothing near here of any kind at all 956.555.0124 is kept out",
    "phone +1 (956) 555-0122",
    "a@b.c " * 3_000 + "10.0.0.1 " * 1_000,
]


def test_personal(spark):
    rows = [(k, t) for k, t in enumerate(PERSONAL)] + [(3, PERSONAL[3]), (None, PERSONAL[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("_text", F.lit(1)).repartition(3)
    found = personal.find(df)
    base = {k: brute_spans(t or "") for k, t in rows}
    told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    got = personal.digest(found).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in ("email", "ip", "card", "phone")), r.doc_id
        assert r.base_sha256 == H(told(want)) and (r.spans == told(want) or r.spans.startswith(told(want)))
    added = {r.doc_id: [(s.kind, s.text) for s in r.spans if not s.base] for r in found.collect()}
    assert added[8] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert added[9] == [("ssn", "123-45-6789")] and added[11] == []
    assert added[10] == [("local_phone", "(956) 555-0122"), ("local_phone", "956-555-0123")]
    texts = {r.doc_id: [(s.text, s.start) for s in r.spans] for r in found.filter("doc_id IS NOT NULL").collect()}
    assert all(PERSONAL[k][at : at + len(t)] == t for k, spans in texts.items() for t, at in spans)
    assert personal.digest(personal.find(df.limit(0))).count() == 0


LONG = {  # kind, start, end; the contract's patterns would take hours over these in Python
    "5" * 100_000 + " " + "1 " * 50_000: [],
    "a." * 100_000 + "@" + "b." * 100_000 + "c": [("email", 0, 400_002)],
    "a" * 500_000: [],
    "1." * 200_000: [("ip", 8 * k, 8 * k + 7) for k in range(50_000)],
    "+1" + "2 -" * 100_000: [],
    "A" * 100_000 + "DE89" * 100_000: [],
}


def test_personal_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal.find(df).collect()}
    assert got == dict(enumerate(LONG.values()))


def test_personal_scores(spark):
    df = spark.createDataFrame([(1, "the server at 10.0.0.1"), (2, "see version 10.0.0.1"), (3, "x 10.0.0.1")], "doc_id long, text string")
    assert {r.doc_id: r.spans[0].score for r in personal.find(df).collect()} == {1: 0.9, 2: 0.3, 3: 0.6}


def brute_codes(rows, parts, entries, rounds):
    sound = [(i, lab, [math.floor(1024 * c) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(sound[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in sound[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(r[2], p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for r in sound]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            own = defaultdict(list)
            for r, a in zip(sound, at):
                own[a[p][1]].append(cut(r[2], p))
            for k, members in own.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    at, errors = assign(), Counter()
    for r, a in zip(sound, at):
        errors[r[1]] += sum(d for d, _ in a)
    sha = H(",".join(str(c) for b in books for e in b for c in e))
    return Counter((r[0], r[1], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), errors[r[1]], sha) for r, a in zip(sound, at))


@pytest.mark.parametrize("n,entries", [(120, 40), (3, 256), (150, 1)])
def test_codes(spark, n, entries):
    rng = np.random.default_rng(n)
    rows = [(int(k * 7 % n), int(k % 5) if k % 4 else None, [float(c) for c in rng.normal(0, 0.05, 8).round(2)]) for k in range(n)]
    rows += [(1000, 1, None), (1001, 1, [None, *rows[0][2][1:]]), (1002, 1, [float("nan")] * 8), (1003, None, [float("-inf")] * 8)]
    rows += [(0, 3, rows[0][2]), (None, 3, rows[1][2]), (2, 3, rows[2][2]), (2, 3, rows[2][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    got = codes.compress(df, entries=entries).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == brute_codes(rows, 4, entries, 4)
    assert codes.compress(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="components"):
        codes.compress(df.union(df.limit(1).withColumn("embedding", F.array(F.lit(1.0)))))


@pytest.mark.parametrize("scale,width", [(1, 3), (40, 16), (2**18, 4)])
def test_gnat_is_exact(scale, width):
    rng = np.random.default_rng(width)
    centre = rng.integers(-50, 50, (12, width)) * 9
    near = lambda n: (centre[rng.integers(0, 12, n)] + rng.integers(-5, 6, (n, width))) * scale
    points, q = near(256), near(3000)
    points[200:220] = points[:20]  # equal entries: the lower number wins
    tree = codes.Gnat(points)
    at, d = tree.nearest(q)
    full = np.stack([((q - p) ** 2).sum(1) for p in points], 1)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert tree.measured < 0.6 * full.size  # subtrees were left out


def test_gnat_ties_across_subtrees():
    """Queries halfway between entries: the tie lies in a subtree at exactly the radius and must not be left out."""
    points = np.array([[x, y] for x in range(0, 64, 4) for y in range(0, 64, 4)], np.int64)[::-1]
    q = np.array([[x, y] for x in range(0, 64, 2) for y in range(0, 64, 2)], np.int64)
    at, _ = codes.Gnat(points).nearest(q)
    assert (at == codes.squares(q, points).argmin(1)).all()
