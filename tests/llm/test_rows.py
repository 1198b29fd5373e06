"""Top-k, mixing, licences, chat, URLs and the pipeline: brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tidegauge.llm import chat, licences, mixing, topk, url_filter


def brute_topk(rows, k, is_query):
    sound = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in {i for i, _ in sound if is_query(i)}:
        best = {}
        for i, v in sound:
            if i == q:
                continue
            for j, w in sound:
                if j == q:
                    best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(v, w)))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard,group", [(8192, 2048), (37, 3)])
def test_topk_against_brute_force(spark, shard, group):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (220, 16)).round(1)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(300, None), (301, [None, *rows[0][1][1:]]), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, rows[0][1])]
    rows += [(304, []), (310, [1.0]), (311, rows[5][1]), (312, rows[5][1]), (10, rows[10][1]), (11, rows[50][1]), (20, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("extra")).withColumn("id", F.lit(1)).repartition(3)
    got = topk.search(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard, group_rows=group)
    assert Counter(map(tuple, got.collect())) == brute_topk(rows, 5, lambda i: i % 10 == 0)


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 32))
    x = np.floor(40 * (centre[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 32)))).astype(np.int64)
    shard = topk.Shard(np.arange(3000), x)
    for q in range(0, 3000, 100):
        want = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:5]
        assert shard.best(q, x[q], 5) == [(-s, i) for s, i in want]


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 256)]
    assert topk.search(df.filter("vec_id > 5"), F.col("vec_id") == 0).count() == 0


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("block", [65_536, 40])
def test_mixing(docs, block):
    rnd = random.Random(2)
    rows = ROWS + [(100 + k, "w " * rnd.randint(0, 60), "en", rnd.choice(["a", "a", "a", "b", "c", None, "\U0001f642"])) for k in range(400)]
    rows = [(*r, *[None] * (4 - len(r))) for r in rows]
    got = mixing.mix(docs(rows), block_words=block, shards=8)
    out = got.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], size_of(r[1])) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += size_of(r[1])
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:  # fill to the ceiling, share the excess again
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == sum(d.words for d in r.draws) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(target[s] + 1e-9) or abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs(rows).repartition(7), block_words=block, shards=8).collect()), key=str)
    drawn = [(d.shard, r.source, d.words) for r in out for d in r.draws]
    assert {s for s, _, _ in drawn} <= set(range(8))
    assert mixing.shuffled(got).count() == len(drawn)


def test_mixing_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    only = mixing.mix(docs([(1, None), (2, " ", None, "a")])).collect()
    assert [r.taken for r in only] == [0, 0]


def test_word_counts(docs):
    texts = ["", " ", "a", " a ", "a b", "\n a\tb \r", None, "\u00a0 x", " " * 500 + "late", " " * 500]
    got = {r.doc_id: r.n for r in docs([(k, t) for k, t in enumerate(texts)]).select("doc_id", mixing.words().alias("n")).collect()}
    assert got == {k: size_of(t) for k, t in enumerate(texts)}


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (4, 333)], "src long, draws long")
    ends = {r.src: r.ends for r in mixing.shard_runs(quotas, 16).collect()}
    assert {s: e[-1] for s, e in ends.items()} == {0: 1000, 1: 10, 2: 0, 4: 333}
    sizes = np.diff([[0, *e] for e in ends.values()], axis=1)
    assert (sizes >= 0).all() and set(sizes.sum(0)) <= {83, 84, 85}


def test_hypergeometric_numbers(spark):
    n = 3000
    df = spark.range(n).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / n).alias("k"))
    got = Counter(r.k for r in df.collect())
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(got[k] / n - p) < 1e-3


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""


def test_names_tags_and_further_notices(docs):
    shapes = [
        ("MIT", "// SPDX-License-Identifier: MIT"),
        ("GPL-3.0-or-later", "/* SPDX-License-Identifier: GPL-3.0-or-later */\nint x;"),
        ("MIT", "Licensed under the MIT License."),
        ("Apache-2.0", "Released under the Apache License, Version 2.0."),
        ("Apache-2.0", "This project is licensed under the Apache 2.0 license. Have fun."),
        ("Zlib", "The code is available under a zlib licence"),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'),
        ("ISC", ISC),
        ("MPL-2.0", MPL),
        ("MPL-2.0", "\n".join(f" * {x}" for x in MPL.split("\n"))),
        ("Unlicense", UNLICENSE),
        ("LGPL-2.1-or-later", LGPL),
        ("LGPL-2.1-or-later", LGPL.replace("This library is", " ".join(f"part{k}" for k in range(30)) + " is")),
        ("AGPL-3.0-or-later", LGPL.replace("Lesser", "Affero").replace("version 2.1", "version 3")),
    ]
    got = {r.doc_id: r for r in licences.scan(docs([(i, t) for i, (_, t) in enumerate(shapes)])).collect()}
    for i, (name, text) in enumerate(shapes):
        r = got[i]
        assert (r.licences, r.n_found, r.unmatched, r.n_unknown) == ([name], 1, [], 0), (r, text)
    (both,) = licences.scan(docs([(1, "SPDX-License-Identifier: MIT OR Apache-2.0")])).collect()
    assert (both.licences, both.n_unknown) == ([], 1)


def test_licences(docs):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at"
    rows = [
        (1, f"Text. {apache}\nMore."),
        (2, "Licensed under the Apache License, Version 2.0.\nA line.\nReleased under the MIT License."),
        (3, "Released under the MIT License.\n" * 3),
        (4, "This program is free software; either version 3 of the License, or (at your option) any later version."),
        (5, "Some other licence speaks. No more."),
        (6, "You may obtain a copy of the License at\n"),
        (7, None), (8, ""), (9, "* Redistributions of source code must retain the above copyright notice."),
        (10, "Releasedunder the MIT License."), (10, "x " * 50_000 + ".\nLicensed under CC BY-NC 4.0."),
    ]
    got = defaultdict(list)
    for r in licences.scan(docs(rows)).collect():
        got[r.doc_id].append((r.licences, r.n_found, r.unmatched, r.n_unknown))
    assert got[1] == [(["Apache-2.0"], 1, [], 0)]
    assert got[2] == [(["Apache-2.0", "MIT"], 2, [], 0)]
    assert got[3] == [(["MIT"], 3, [], 0)]
    assert got[4] == [(["GPL-3.0-or-later"], 1, [], 0)]
    assert got[5] == [([], 0, [], 1)]
    assert got[6] == [([], 0, ["ApacheCopy"], 0)]
    assert got[7] == got[8] == [([], 0, [], 0)]
    assert got[9] == [([], 0, ["BsdSource"], 0)]
    assert sorted(got[10]) == [([], 0, [], 1), (["CC-BY-NC-4.0"], 1, [], 0)]
    assert licences.scan(docs([])).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{name}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAME = """
3. Neither the name of Some Firm Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2").replace("If not, see <https://www.gnu.org/licenses/>.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.").replace("program.  if", "program; if")


def test_published_notices(docs):
    """Whole notices, wrapped at several widths, in comments, on one line, with other lines at both ends."""
    import textwrap

    whole = {"Apache-2.0": [APACHE], "MIT": [MIT], "BSD-3-Clause": [BSD.format(name=BSD_NAME)], "BSD-2-Clause": [BSD.format(name="")], "GPL-3.0-or-later": [GPL3], "GPL-2.0-or-later": [GPL2]}
    shapes = []
    for name, texts in whole.items():
        for text in texts:
            parts = text.split("\n\n")
            shapes.append((name, " ".join(text.split())))
            for width in (30, 70, 76, 80):
                wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in parts)
                shapes += [(name, wrapped), (name, wrapped.replace("\n", "\r\n")), (name, "/*\n" + textwrap.indent(wrapped, " * ", lambda _: True) + "\n */"), (name, f"A heading\n{wrapped}\nint main(void)")]
    got = {r.doc_id: r for r in licences.scan(docs([(i, t) for i, (_, t) in enumerate(shapes)])).collect()}
    for i, (name, text) in enumerate(shapes):
        r = got[i]
        assert (r.licences, r.n_found, r.unmatched, r.n_unknown) == ([name], 1, [], 0), (r, text)


def test_every_known_sentence_is_searched():
    import re

    assert all(re.search(licences.HINTS, k) for k in licences.KNOWN)


def test_wrapped_phrases_and_near_misses(docs):
    rows = [
        (1, "A line without a mark\nReleased under\nthe MIT License.\nAnother line"),
        (2, "Released under\nthe MITX License."),
        (3, "Nothing here\nis known\nat all"),
        (4, "Copyright (c) 2020, 2023 Some Firm\nAll rights\nreserved."),
    ]
    got = {r.doc_id: (r.licences, r.n_unknown, r.n_sentences) for r in licences.scan(docs(rows)).collect()}
    assert got == {1: (["MIT"], 0, 3), 2: ([], 1, 2), 3: ([], 0, 3), 4: (["LicenseRef-All-rights-reserved"], 1, 2)}


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for *_, r, x in own)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 15), (1, 0), (60, 60)])
def test_chat_reads_back(spark, budget, history):
    rnd = random.Random(budget)
    bits = ["\\", "###", "### Assistant: ", "</turn>", "</turn>\n", "\n", "hello ", "é", "<", "/turn>", "#"]
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    for conv in range(20):
        rows += [(conv, t, rnd.choice(["system", "user", "assistant", "tool: </turn>", "Ü", None, ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for t in range(rnd.randint(1, 12))]
    rows += [(50, 0, "system", "s"), (50, 1, "user", None), (51, 0, "assistant", "a"), (51, 0, "assistant", "a"), (51, None, "user", "n"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(52, 0, "system", "only"), (53, 0, "user", "long " * 5000), (53, 1, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x")).repartition(3)
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == brute_chat(rows)
    by = defaultdict(list)
    for w in windows.collect():
        by[w.conv_id].append(w)
    for own in by.values():
        system = [t for t in chat.turns_of(own[0].text)][:1]
        for w in own:
            turns = list(chat.turns_of(w.text))
            new = len(turns) - w.repeated - (w.window == 0 and system[0][0] == "system")
            assert w.tokens <= budget or new <= 1
            if system[0][0] == "system":
                assert turns[0] == system[0]
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES for h, p in [(r.name.split("/")[0], r.name[len(r.name.split("/")[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://www.example.com/en/1?x#y", "https://a.www.Example.COM/en/", "http://notexample.com/en/", "http://example.com/EN/", "http://example.com/en", "http://x.net/es/", "http://net/fr/1", "http://xnet/fr/", "ftp://a.net/fr", "http://com", "http://com/", "x://y://z.net/es/", "http://ÄB.net/es/é", "http://a.org/ads/1", "http://a.net/track", "http://a.com/ads/1", "http://example.com:80/en/", "http://a.net?/es/", "http://a\nb.net/es/", "http://a\n.b.com/x", "http://a\nexample.com/en/", "http://x\\n.com/", "http://www.example.com/en/\n/ads/", "http://\n", "http://net\n/es/", "http://a.\nnet/es/", "http://a.net/\nes/", "http://a.net/es/" + "z" * 20_000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, urls[4]), (4, urls[4])], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else urls[4]
        host, path, rule, verdict = plain_verdict(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert verdict in (None, r.verdict)
    by = {urls[r.page_id]: r for r in got if r.page_id is not None}
    assert by["http://a.org/ads/1"].matched == "ads" and by["http://a.org/ads/1"].verdict == "block"
    assert by["http://a.com/ads/1"].rule == "com/" and by["http://a.com/ads/1"].verdict == "allow"
    assert by["http://xnet/fr/"].fetched <= by["http://net/fr/1"].fetched
    assert url_filter.judge(df.limit(0)).count() == 0


def test_pipeline_stages(docs, spark):
    import corpus_pipeline as cp
    from tests.llm.test_text import brute_classes

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(60):
        own = [word() for _ in range(rnd.randint(3, 80))]
        rows.append((1000 + k, " ".join(own), "en", rnd.choice(["s", "t", None])))
        if k % 5 == 0:
            rows.append((1100 + k, "  ".join(own), "en", "s"))
        if k % 7 == 0 and len(own) > 60:
            rows.append((1200 + k, " ".join(own[:-1]) + " " + word(), "en", "t"))
    rows += [r for r in ROWS if r[0] != 5]
    df = docs(rows)
    at = {}
    for name, stage in cp.STAGES:
        before, df = df, spark.createDataFrame((got := stage(spark, df, "")).collect(), got.schema)
        at[name] = df.collect()
        if name != cp.STAGES[-1][0]:
            assert df.columns == before.columns
    letters = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter(r.doc_id for r in at["language"]) == Counter(r[0] for r in letters)
    keep = {}
    for r in letters:
        key = re.sub("[\x20\x09-\x0d]", "", r[1])
        if key not in keep or (-len(r[1]), r[0] is None, r[0] or 0) < (-len(keep[key][1]), keep[key][0] is None, keep[key][0] or 0):
            keep[key] = r
    assert Counter(r.doc_id for r in at["exact_dedup"]) == Counter(r[0] for r in keep.values())
    classes = brute_classes(list(keep.values()))
    assert Counter(r.doc_id for r in at["near_dup"]) == Counter(r[0] for r in keep.values() if r[0] is None or classes[r[0]] == r[0])
    assert len(at["encode"]) == len(at["mixing"]) > len(at["near_dup"])
    assert max(Counter(r.doc_id for r in at["mixing"]).values()) == 2
    assert all(r.same for r in at["encode"] if r.doc_id != 7)


def test_pipeline_of_nothing(docs, spark):
    import corpus_pipeline as cp

    df = docs([])
    for _, stage in cp.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0
