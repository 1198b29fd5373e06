"""Tokens, encoding, exact dedup, language, near-duplicates: brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tidegauge.llm import exact_dedup, language, near_dup, sentencepieces, shingles, token_counts
from tidegauge.llm.vocab import load

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def samples(n, seed):
    rnd = random.Random(seed)
    pieces = [p for p in load().text if not p.startswith("<")]
    odd = " .,ab▁\n\t é🙂²½_0-'ы中\u0301<>"
    for k in range(n):
        if k % 4 == 0:
            yield "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 60)))
        elif k % 4 == 1:
            yield "".join(rnd.choice(pieces).replace("▁", " ") for _ in range(rnd.randint(1, 20)))
        elif k % 4 == 2:
            yield " " * rnd.randint(0, 40) + "".join(rnd.choice("aeinrst ") for _ in range(rnd.randint(0, 150)))
        else:
            yield "".join(rnd.choice(pieces).strip("▁") for _ in range(rnd.randint(1, 8)))


def test_counts_at_every_prefix(library):
    p = token_counts.prefixes()
    for text in samples(400, 5):
        counts = p.counts(text)
        assert counts == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        (n,), (fit,) = p.totals([text], 7)
        assert n == counts[-1] and fit == max(k for k, c in enumerate(counts) if c <= 7)


def test_encoding_and_decoding_match_the_library(library):
    c = sentencepieces.codec()
    for text in samples(2000, 6):
        ids = library.encode(text)
        own = [int(i) for _, words in c.spans([text]) for w in words for i in w[0].split(",")]
        assert own == ids
        assert c.decode(ids).removeprefix(" ") == library.decode(ids)


def test_kept_words_may_be_few(library):
    c = sentencepieces.Codec(load())
    c.kept.most = 10
    texts = list(samples(60, 7))
    got = defaultdict(list)
    for k, words in c.spans(texts * 2):
        got[k] += [int(i) for w in words for i in w[0].split(",")]
    assert [got[k] for k in range(120)] == library.encode(texts * 2)


def test_token_queries(docs, library):
    df = docs(ROWS)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, *_ in ROWS)
    assert Counter(map(tuple, token_counts.count_tokens(df).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want
    cut = {r.doc_id: r.prefix for r in token_counts.truncate(df, 5).collect()}
    assert cut[4] == "one two three four five" and cut[1] == "" == cut[2]
    counts = {r.doc_id: r.counts for r in token_counts.prefix_counts(df).collect()}
    assert counts[1] == [0] and counts[4][-1] == 6

    ids = sentencepieces.encode(df)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "") for i, t, *_ in ROWS}
    assert {r.doc_id: r.text for r in sentencepieces.decode(ids).collect()} == {i: library.decode(library.encode(t or "")) for i, t, *_ in ROWS}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(e), sha(",".join(map(str, e))), sha(library.decode(e))) for i, t, *_ in ROWS for e in [library.encode(t or "")])
    assert Counter(map(tuple, sentencepieces.round_trip(df).drop("same").collect())) == want


def blank(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_exact_dedup(docs):
    got = exact_dedup.deduplicate(docs(ROWS)).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[blank(t)].append((i, t or ""))
    want = Counter()
    for key, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        for i, _ in rows:
            want[i, keep, len(rows), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    kept = exact_dedup.keep_first(docs(ROWS))
    assert Counter(blank(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert set(kept.columns) == set(docs(ROWS).columns)


@pytest.mark.parametrize("budget", [1, 5_000, 60_000, 1 << 30])
def test_tries_spill_and_lose_nothing(tmp_path, budget):
    rnd = random.Random(budget)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 3, 12, 40]))) for _ in range(1500)]
    texts += [t + b"tail" for t in texts[:300]]
    entries = [(t, (rnd.randint(0, 3), rnd.choice([None, 1, 2, 3, 4]), 1, 1)) for t in texts]
    got = dict(exact_dedup.owners(iter(entries), budget, str(tmp_path)))
    want = {}
    for t, o in entries:
        want[t] = exact_dedup.better(want.get(t), o)
    assert got == want
    assert not list(tmp_path.iterdir())


def test_exact_dedup_in_flushed_tries(docs):
    rows = [(k, f"text {k % 50}") for k in range(400)]
    small = exact_dedup.deduplicate(docs(rows), budget=2_000)
    assert Counter(r.keep_id for r in small.collect()) == Counter({k: 8 for k in range(50)})


def test_windows_of_bytes():
    x, owner = language.windows([b"a" * 300, b"", b"bc"])
    assert x.shape == (3, 256) and owner.tolist() == [0, 0, 2] and (x[1] != 0).sum() == 44 and bytes(x[2][:2]) == b"bc"


def test_network_tables_equal_plain_convolution():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"], [rng.normal(size=(w, 256, 4)) for w in (2, 3, 4)], rng.normal(size=12), rng.normal(size=(12, 3)), rng.normal(size=3))
    x = rng.integers(0, 256, (5, 32)).astype(np.uint8)
    hidden = []
    for row in x:
        h = []
        for f in net.filters:
            w = len(f)
            h.append(np.max([sum(f[j][row[i + j]] for j in range(w)) for i in range(len(row) - w + 1)], axis=0))
        hidden.append(np.maximum(np.concatenate(h) + net.bias, 0))
    assert np.allclose(net.probabilities(x), language.softmax(np.array(hidden) @ net.dense + net.offset))


def test_language_accuracy_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 200


def test_language_edge_cases(docs):
    got = language.identify(docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 10):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    none = language.identify(docs([(1, "some text", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in none} == {"und"}


def plain_shingles(text):
    w = re.findall("[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < 5 else Counter(zip(*[w[i:] for i in range(5)]))


def test_shingles(monkeypatch):
    texts = ["", "a b", "a b c d e", "A,b;c d e f", "a b c d e f a b c d e", "ü" * 50 + " x y z ß q r", "-- !!"]
    monkeypatch.setattr(shingles, "BLOCK", 7)
    values, times, count = shingles.weighed(texts)
    names, at = {}, 0
    for text, n in zip(texts, count):
        want = plain_shingles(text)
        assert n == len(want) and sorted(times[at : at + n]) == sorted(want.values())
        names.setdefault(frozenset(want), set(values[at : at + n].tolist()))
        assert names[frozenset(want)] == set(values[at : at + n].tolist())
        at += n
    monkeypatch.setattr(shingles, "BLOCK", 1 << 20)
    assert (shingles.weighed(texts)[0] == values).all()


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    a, b = np.sort(shared), np.sort(np.concatenate([shared, own]))
    wa, wb = np.full(len(a), 3.3), np.full(len(b), 3.3)
    wb[::7] = 1.7
    got = near_dup.sample(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]), 400, 3.3)
    wa, wb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = sum(min(wa[x], wb[x]) for x in wa) / sum(max(wa.get(x, 0), wb[x]) for x in wb)
    assert abs((got[0] == got[1]).mean() - want) < 0.08


def brute_classes(rows, similar=0.8):
    sets = {i: plain_shingles(t) for i, t, *_ in rows if i is not None}
    n, df = len(rows), Counter()
    for _, t, *_ in rows:
        df.update(plain_shingles(t).keys())
    weight = lambda g: 1 + np.log(n / df[g])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            inter = sum(min(sets[a][g], sets[b][g]) * weight(g) for g in sets[a].keys() & sets[b].keys())
            total = sum(c * weight(g) for s in (sets[a], sets[b]) for g, c in s.items()) - inter
            if inter and inter / total >= similar:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rnd, words, share):
    return [rnd.choice(words) + "x" if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    """Chains of edits, a group around one text, a passage that all share, repeated blocks, short texts."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(30)]
    base = [word() for _ in range(200)]
    chain = base
    for k in range(12):
        chain = edited(rnd, chain, 0.012)
        rows.append((k, " ".join(chain)))
    for k in range(12, 40):
        rows.append((k, " ".join(edited(rnd, base, 0.01))))
    for k in range(40, 110):
        rows.append((k, " ".join([*(word() for _ in range(25)), *passage])))
    rows += [(110, "one two"), (111, "One, two!"), (112, "two one"), (113, None), (114, ""), (115, " ".join(passage * 3)), (116, " ".join(passage * 3) + " end")]
    rows += [(None, rows[0][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("tile", [512, 8])
def test_near_duplicates_against_all_pairs(docs, family, tile):
    got = near_dup.classes(docs(family), tile=tile).collect()
    assert len(got) == len(family)
    want = brute_classes(family)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r["first"] == (r.doc_id is None or r.class_id == r.doc_id) for r in got)


def test_document_frequencies(spark, family):
    """Frequencies over all rows and tasks; with a larger share, rarer shingles weigh alike."""
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(7)
    want = Counter()
    for _, t in family:
        want.update(shingles.weighed([(t or "").lower()])[0].tolist())
    for share in (0.001, 0.2):
        got = near_dup.idf(df, "text", share=share)
        some = {k: n for k, n in want.items() if n >= share * len(family)}
        assert got.keys.tolist() == sorted(some)
        assert np.allclose(got.idf, [1 + np.log(len(family) / some[k]) for k in sorted(some)])
        assert got.rare == 1 + np.log(1 / share)


def test_pages_of_one_template_stay_apart(docs):
    """5 % of the pages share a template of 104 words and have 10 words of their own: weighted similarity 0.74."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(104)]
    rows = [(k, " ".join([*template, *(word() for _ in range(10))])) for k in range(20)]
    rows += [(k, " ".join(word() for _ in range(60))) for k in range(20, 400)]
    assert len({r.class_id for r in near_dup.classes(docs(rows)).collect()}) == 400


def test_recall_near_the_threshold(docs):
    """Pairs of similarity 0.80 to 0.85: nearly all are found."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(300):
        base = [word() for _ in range(300)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(rnd, base, 0.0167)))]
    df = Counter()
    sets = [plain_shingles(t) for _, t in rows]
    for g in sets:
        df.update(g.keys())
    weight = lambda g: 1 + np.log(len(rows) / df[g])
    close = []
    for k in range(300):
        a, b = sets[2 * k], sets[2 * k + 1]
        both = sum(weight(g) * min(a[g], b[g]) for g in a.keys() & b.keys())
        every = sum(weight(g) * max(a[g], b[g]) for g in a.keys() | b.keys())
        if 0.8 <= both / every < 0.85:
            close.append(2 * k)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(rows)).collect()}
    assert len(close) > 30 and np.mean([got[k] == got[k + 1] for k in close]) >= 0.97


def test_candidate_rest_path_is_complete(spark, family):
    """Where the first of a bucket is no partner, members still find each other."""
    rows = [(i, t) for i, t in family if i is not None and t]
    df = spark.createDataFrame(list(dict(rows).items()), "doc_id long, text string")
    from tidegauge.llm.common import Stored

    weights = near_dup.idf(df, "text")
    signed = near_dup.signatures(df, weights, "doc_id", "text").select(F.col("doc_id").alias("node"), "samples", F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("bands"))
    found = near_dup.candidates(signed, Stored(df, "test"), 0.63, 8).collect()
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[find(max(a, b))] = find(min(a, b))
    want = brute_classes(rows)
    assert all(find(i) == find(want[i]) for i in want)
    assert len(found) < 6 * len(rows)


def test_empty_tables(docs, spark):
    none = docs([])
    for df in (exact_dedup.deduplicate(none), exact_dedup.keep_first(none), token_counts.count_tokens(none), sentencepieces.round_trip(none), language.identify(none), near_dup.classes(none), near_dup.keep_first(none)):
        assert df.count() == 0
