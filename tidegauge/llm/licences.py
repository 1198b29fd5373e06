"""Licence recognition by sentences and sentence rules (operator 5), in DataFrame operations only.

A text is cut into sentences, each is normalised (lower case, letters and digits only, single spaces, comment
marks and list marks gone) and looked up among known licence sentences.  The text thus becomes a sequence of
sentence identifiers, and ordered rules are matched against the sequence: a rule names a licence and the
identifiers that stand next to each other for it, the first rule that fits takes its identifiers away, and
later rules see what is left.  Licence sentences that no rule takes are reported as unmatched, and sentences
that speak of licences without being known as unknown.

A line's end ends a sentence, but a known sentence may run over lines, blank lines, marks inside it and list
marks before it: it is put on one line first.  So notices wrapped at any width are known, with what stands
before or after them on lines of its own.  In a known sentence '*' stands for one to NAME words of a name.

A tag ("SPDX-License-Identifier: MIT") or a head on one line ("Released under the Apache License, Version 2.0.") is known by the
licence's name behind it.  Expressions of several licences are unknown sentences.

Everything happens inside a row: no shuffle, whole texts, every copy of a sentence.

Null and empty texts have no sentences and no licences; repeated rows and null ids are rows like others; an
empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import whole

#: Sentences by which published licences and notices are known, with identifiers of our own.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheHead2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "distributed on an as is basis without warranties or conditions of any kind either express or implied": "AsIsBasis",
    "released under the mit license": "MitHead",
    "this software is released under the mit license": "MitHead",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIsSoftware",
    "this work is licensed under the gnu general public license version 3": "GplHead3",
    "this work is licensed under the gnu general public license version 2": "GplHead2",
    "this program is free software": "GplFree",
    "either version 3 of the license or at your option any later version": "GplLater3",
    "either version 2 of the license or at your option any later version": "GplLater2",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "redistribution and use in source and binary forms with or without modification are permitted": "BsdUse",
    "redistributions of source code must retain the above copyright notice": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice": "BsdBinary",
    "neither the name of the copyright holder may be used to endorse or promote products": "BsdName",
    "all rights reserved": "AllRights",
}
#: SPDX identifiers and the names by which tags and heads call the licences, normalised, without "license" at the end.
NAMES = {
    "Apache-2.0": ("apache 2 0", "apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache version 2 0"),
    "MIT": ("mit", "expat"),
    "BSD-2-Clause": ("bsd 2 clause", "simplified bsd", "2 clause bsd"),
    "BSD-3-Clause": ("bsd 3 clause", "new bsd", "modified bsd", "3 clause bsd"),
    "ISC": ("isc",),
    "MPL-2.0": ("mpl 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license version 2 0"),
    "GPL-2.0-only": ("gpl 2 0", "gpl 2 0 only", "gplv2", "gpl v2", "gnu gpl v2", "gnu general public license v2", "gnu general public license version 2"),
    "GPL-2.0-or-later": ("gpl 2 0 or later", "gnu general public license version 2 or later", "gnu general public license v2 or later"),
    "GPL-3.0-only": ("gpl 3 0", "gpl 3 0 only", "gplv3", "gpl v3", "gnu gpl v3", "gnu general public license v3", "gnu general public license version 3"),
    "GPL-3.0-or-later": ("gpl 3 0 or later", "gnu general public license version 3 or later", "gnu general public license v3 or later"),
    "LGPL-2.1-only": ("lgpl 2 1", "lgpl 2 1 only", "gnu lesser general public license v2 1", "gnu lesser general public license version 2 1"),
    "LGPL-2.1-or-later": ("lgpl 2 1 or later", "gnu lesser general public license version 2 1 or later"),
    "LGPL-3.0-only": ("lgpl 3 0", "lgpl 3 0 only", "gnu lesser general public license v3", "gnu lesser general public license version 3"),
    "LGPL-3.0-or-later": ("lgpl 3 0 or later", "gnu lesser general public license version 3 or later"),
    "AGPL-3.0-only": ("agpl 3 0", "agpl 3 0 only", "gnu affero general public license v3", "gnu affero general public license version 3"),
    "AGPL-3.0-or-later": ("agpl 3 0 or later", "gnu affero general public license version 3 or later"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0",),
    "CC-BY-SA-4.0": ("cc by sa 4 0",),
    "CC-BY-NC-4.0": ("cc by nc 4 0",),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0",),
    "Zlib": ("zlib",),
    "BSL-1.0": ("bsl 1 0", "boost software license 1 0", "boost software license version 1 0"),
    "EPL-2.0": ("epl 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"),
}
NAMED = {name: f"Named{licence}" for licence, names in NAMES.items() for name in names}
#: What stands before the name of a licence in a tag or head, and what may stand behind it.
BEFORE = r"^(?:spdx license identifier|(?:(?:(?:this|the) )?[a-z]+ is )?(?:licensed|released|distributed|available) under(?: the| an?)?) "
BEHIND = r" licen[cs]e$"
#: Ordered rules: licence and the identifiers that must follow each other.
RULES = (
    ("Apache-2.0", ("ApacheHead2", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHead2", "ApacheUse")),
    ("Apache-2.0", ("ApacheHead2",)),
    ("MIT", ("MitGrant", "MitNotice", "AsIsSoftware")),
    ("MIT", ("MitHead",)),
    ("MIT", ("MitGrant",)),
    ("BSD-3-Clause", ("BsdUse", "BsdSource", "BsdBinary", "BsdName")),
    ("BSD-2-Clause", ("BsdUse", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplLater3")),
    ("GPL-2.0-or-later", ("GplFree", "GplLater2")),
    ("GPL-3.0-only", ("GplHead3",)),
    ("GPL-2.0-only", ("GplHead2",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    *((licence, (f"Named{licence}",)) for licence in NAMES),
    ("LicenseRef-All-rights-reserved", ("AllRights",)),
)
_BSD_FREE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_FREE = "* is free software you can redistribute it and or modify it under the terms of the gnu"
_GPL_FREE = f"{_FREE} general public license"
_RELATED = (("lesser", "Lgpl", "2 1"), ("lesser", "Lgpl", "3"), ("affero", "Agpl", "3"))
#: Whole sentences of the published notices; of two that begin alike the longer stands first.
PUBLISHED = {
    "licensed to * under one or more contributor license agreements": "AsfGrant",
    "see the notice file distributed with this work for additional information regarding copyright ownership": "AsfNotice",
    "the asf licenses this file to you under the apache license version 2 0 the license": "ApacheHead2",
    "licensed under the apache license version 2 0 the license": "ApacheHead2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    **{f"you may obtain a copy of the license at {x} www apache org licenses license 2 0{y}": "ApacheCopy" for x in ("http", "https") for y in (" html", " txt", "")},
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "AsIsBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIsSoftware",
    "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    _BSD_FREE: "BsdUse",
    _BSD_SOURCE: "BsdSource",
    _BSD_BINARY: "BsdBinary",
    **{f"neither the name of * {x} may be used to endorse or promote products derived from this software without specific prior written permission": "BsdName" for x in ("nor the names of its contributors", "nor the names of the contributors", "nor the names of contributors", "nor the names of other contributors")},
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    **{f"{_GPL_FREE} as published by the free software foundation either version {n} of the license or at your option any later version": f"GplNotice{n}Later" for n in (2, 3)},
    **{f"{_GPL_FREE} {x}": f"GplNotice{n}Only" for n in (2, 3) for x in (f"as published by the free software foundation version {n} of the license", f"version {n} as published by the free software foundation", f"version {n} only as published by the free software foundation")},
    "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplHope",
    "see the gnu general public license for more details": "GplSee",
    **{f"you should have received a copy of the gnu general public license along with {x}": "GplCopy" for x in ("this program", "this software", "this file", "this package", "*")},
    **{f"if not see {x} www gnu org licenses": "GplNot" for x in ("http", "https")},
    **{f"if not write to the free software foundation inc {x}": "GplNot" for x in ("51 franklin street fifth floor boston ma 02110 1301 usa", "59 temple place suite 330 boston ma 02111 1307 usa", "675 mass ave cambridge ma 02139 usa", "*")},
    **{f"{_FREE} {kind} general public license as published by the free software foundation either version {n} of the license or at your option any later version": f"{i}Notice{n.replace(' ', '.')}Later" for kind, i, n in _RELATED},
    **{f"see the gnu {kind} general public license for more details": f"{i}See" for kind, i, _ in _RELATED},
    **{f"you should have received a copy of the gnu {kind} general public license along with {x}": f"{i}Copy" for kind, i, _ in _RELATED for x in ("this program", "this library", "this software", "*")},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MplHead",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0": "MplCopy" for x in ("http", "https")},
    "this is free and unencumbered software released into the public domain": "UnlicenseHead",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseUse",
    **{f"this work is licensed under {a} creative commons attribution {x}4 0 international license": i for a in ("a", "the") for x, i in (("", "CcBy4"), ("sharealike ", "CcBySa4"), ("noncommercial ", "CcByNc4"), ("noncommercial sharealike ", "CcByNcSa4"))},
}
KNOWN = SENTENCES | PUBLISHED
_BSD_END = ("BsdAsIs", "BsdLiability")
_GPL_END = ("GplHope", "GplSee", "GplCopy", "GplNot")
#: Rules for whole published notices come before the others, so that they take all of a notice.
NOTICES = (
    ("Apache-2.0", ("AsfGrant", "AsfNotice", "ApacheHead2", "ApacheUse", "ApacheCopy", "AsIsBasis", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead2", "ApacheUse", "ApacheCopy", "AsIsBasis", "ApacheSee")),
    ("MIT", ("MitGrant", "MitNotice", "AsIsSoftware", "MitLiability")),
    *(("BSD-3-Clause", (*head, "BsdUse", "BsdSource", "BsdBinary", "BsdName", *_BSD_END)) for head in (("AllRights",), ())),
    *(("BSD-2-Clause", (*head, "BsdUse", "BsdSource", "BsdBinary", *_BSD_END)) for head in (("AllRights",), ())),
    *((f"{i.upper()}-{v}-or-later", (f"{i}Notice{n}Later", *("GplHope", f"{i}See", f"{i}Copy", "GplNot")[:k])) for i, n, v in (("Lgpl", "2.1", "2.1"), ("Lgpl", "3", "3.0"), ("Agpl", "3", "3.0")) for k in (4, 3, 2, 1, 0)),
    *(("ISC", ("IscGrant", "IscAsIs", "IscLiability")[:k]) for k in (3, 2, 1)),
    *(("MPL-2.0", ("MplHead", "MplCopy")[:k]) for k in (2, 1)),
    *(("Unlicense", ("UnlicenseHead", "UnlicenseUse")[:k]) for k in (2, 1)),
    *((f"GPL-{n}.0-{x}", (f"GplNotice{n}{i}", *_GPL_END[:k])) for n in (3, 2) for x, i in (("or-later", "Later"), ("only", "Only")) for k in (4, 3, 2, 1, 0)),
)
#: A sentence ends at a line's end or after a mark of its end that a blank follows; a blank line or a full stop inside a version number ends none.
ENDS = r"[\r\n]+|[.;!?][ \t]+|[.;!?]+\z"
SPEAKS = r"licen[cs]e|copyright|warrant|redistribut"
#: Some word of every known sentence; other texts are not searched for sentences that run over lines.
HINTS = rf"{SPEAKS}|permission|permitted|all[ \n]+rights|in[ \n]+no[ \n]+event|if[ \n]+not|free[ \n]+software|under[ \n]+cc|endorse|mpl|unencumbered|anyone[ \n]+is[ \n]+free"
#: A number or letter of a list, what stands between two words of a sentence, and how a notice on one line goes on after a colon or an address.
LISTED, STEP = r"(?:[0-9]{1,2}|[a-z]|i{1,3}|iv)", r"(?: |\n+)"
GOES_ON = rf"(?:{LISTED}|unless|the above|redistributions)"
MOST_RULES = 2_000
NAME = 100


def _bare(known: str) -> str:
    """A known sentence without its places for names: what stands in the text once it is found."""
    return " ".join(w for w in known.split() if w != "*")


def _over_lines(known: str) -> str:
    """Pattern of a known sentence that may run over lines; a whole sentence, but for list marks around published ones."""
    words = known.split()
    body = "".join((rf"(?:[a-z0-9]+ ){{1,{NAME}}}?" if not n else rf"(?:[a-z0-9]+{STEP}){{0,{NAME - 1}}}?[a-z0-9]+" + STEP * (n + 1 < len(words))) if w == "*" else w + STEP * (n + 1 < len(words)) for n, w in enumerate(words))
    if known in PUBLISHED and known not in SENTENCES:
        return rf"(?<![^\n])(?:{LISTED}{STEP})?{body}(?=\n|\z| {GOES_ON}(?:\n| ))"
    return rf"(?<![^\n]){body}(?![^\n])"


def sentences(text: Column | str, known: Mapping[str, str] = KNOWN) -> Column:
    """Normalised sentences of a text, in order.  Only ASCII letters and digits count; others stand for a blank."""
    plain = F.regexp_replace(F.lower(whole(text)), ENDS, "\n")
    plain = F.regexp_replace(plain, r"[^a-z0-9\n]+", " ")
    first = [k for k in PUBLISHED if k in known]
    order = [*first, *(k for k in known if k not in PUBLISHED)]
    steps = F.array(*[
        F.struct(F.lit(max(k.split("*"), key=len).strip()).alias("part"), F.lit(_over_lines(k)).alias("all"), F.lit(_bare(k) + "\n").alias("one")) for k in order
    ])

    def joined(t: Column) -> Column:
        tight = F.trim(F.regexp_replace(t, " ?\n ?", "\n"))
        start = F.struct(tight.alias("t"), F.regexp_replace(tight, "\n+", " ").alias("flat"))
        found = F.aggregate(
            steps,
            start,
            lambda a, k: F.when(
                F.contains(a["flat"], k["part"]),
                F.struct(F.regexp_replace(F.regexp_replace(a["t"], k["all"], k["one"]), " ?\n ?", "\n").alias("t"), a["flat"].alias("flat")),
            ).otherwise(a),
        )
        return found["t"]

    hinted = plain.rlike(HINTS) if known is KNOWN else F.lit(True)
    plain = F.when(hinted, joined(plain)).otherwise(plain)
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def identified(held: Column, known: Mapping[str, str] = KNOWN) -> Column:
    """Identifier of each sentence: that of a known one, '?' if it speaks of licences, else '-'."""
    index = F.create_map(*[F.lit(x) for pair in {_bare(k): i for k, i in known.items()}.items() for x in pair])
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def by_name(s: Column) -> Column:
        return F.when(F.lit(known is KNOWN) & s.rlike(BEFORE), F.try_element_at(named, F.regexp_replace(F.regexp_replace(s, BEFORE, ""), BEHIND, "")))

    return F.transform(held, lambda s: F.coalesce(F.try_element_at(index, s), by_name(s), F.when(s.rlike(SPEAKS), "?").otherwise("-")))


def scan(docs: DataFrame, known: Mapping[str, str] = KNOWN, rules: Sequence[tuple[str, Sequence[str]]] = NOTICES + RULES, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: key, licences (array, in order of the rules), n_found (places where a rule fitted), unmatched (identifiers no rule took), n_unknown, n_sentences."""
    if len(rules) > MOST_RULES or len(known) > MOST_RULES:
        raise ValueError(f"rules and sentences stand in the query text; at most {MOST_RULES} of each")
    rows = docs.select(F.col(key), sentences(column, known).alias("held"))
    rows = rows.select(key, F.size("held").alias("n_sentences"), identified(F.col("held"), known).alias("ids"))
    # only identifiers of licence sentences and the gaps between them matter from here on: long runs of others become one gap
    line = F.concat(F.lit(" "), F.array_join(F.filter("ids", lambda i: i != "-"), "  "), F.lit(" "))
    runs = F.regexp_replace(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")), r"(?: - )+", " - ")
    some = F.exists("ids", lambda i: i != "-")
    rows = rows.select(key, "n_sentences", F.when(some, F.struct(runs.alias("seq"), line.alias("line"))).alias("s"))
    seq = F.col("s.seq")
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f" {i} " for i in ids)).alias("ids")) for name, ids in rules])
    empty = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("found"), F.lit(0).alias("n"))

    def take(a, rule):
        n = ((F.length(a["seq"]) - F.length(F.replace(a["seq"], rule["ids"], F.lit("")))) / F.length(rule["ids"])).cast("int")
        return F.when(
            F.contains(a["seq"], rule["ids"]),
            F.struct(F.replace(a["seq"], rule["ids"], F.lit(" - ")).alias("seq"), F.concat(a["found"], F.array(rule["name"])).alias("found"), (a["n"] + n).alias("n")),
        ).otherwise(a)

    rows = rows.withColumn("m", F.when(seq.isNotNull(), F.aggregate(steps, empty, take)))
    left = F.filter(F.split(F.coalesce("m.seq", F.lit("")), " +"), lambda i: ~i.isin("", "-", "?"))
    unknown = F.size(F.filter(F.split(F.coalesce("s.line", F.lit("")), " +"), lambda i: i == "?"))
    none = F.array().cast("array<string>")
    return rows.select(
        key,
        F.array_distinct(F.coalesce("m.found", none)).alias("licences"),
        F.coalesce("m.n", F.lit(0)).cast("long").alias("n_found"),
        left.alias("unmatched"),
        unknown.cast("long").alias("n_unknown"),
        F.col("n_sentences").cast("long"),
    )


def _sql() -> str:
    """The query in SQL for the phrases and rules of the given tables, whose lines are whole: one replacement for each rule."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    index = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SENTENCES.items()) + "}"
    named = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in NAMED.items()) + "}"
    by_name = f"CASE WHEN regexp_matches(x, '{BEFORE}') THEN ({named})[regexp_replace(regexp_replace(x, '{BEFORE}', ''), '{BEHIND}', '')] END"
    steps, at = [], "seq"
    for n, (_, ids) in enumerate(RULES):
        steps.append(f"r{n} AS (SELECT *, replace({at}, {quote(''.join(f' {i} ' for i in ids))}, ' - ') AS s{n} FROM {f'r{n - 1}' if n else 'q'})")
        at = f"s{n}"
    before = ["seq", *(f"s{n}" for n in range(len(RULES) - 1))]
    fits = [f"CASE WHEN contains({b}, {quote(''.join(f' {i} ' for i in ids))}) THEN {quote(name)} END" for b, (name, ids) in zip(before, RULES)]
    numbers = [f"(length({b}) - length(replace({b}, {quote(x)}, ''))) // {len(x)}" for b, (_, ids) in zip(before, RULES) for x in ["".join(f" {i} " for i in ids)]]
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{ENDS}', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS held
  FROM documents),
i AS (SELECT doc_id, len(held) AS n_sentences,
        list_transform(held, lambda x: coalesce(({index})[x], {by_name}, CASE WHEN regexp_matches(x, '{SPEAKS}') THEN '?' ELSE '-' END)) AS ids FROM s),
q AS (SELECT doc_id, n_sentences, len(list_filter(ids, lambda x: x = '?')) AS n_unknown, ' ' || coalesce(array_to_string(ids, '  '), '') || ' ' AS seq FROM i),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS licences, n_found, array_to_string(list_filter(string_split_regex({at}, ' +'), lambda x: x NOT IN ('', '-', '?')), ',') AS unmatched,
  CAST(n_unknown AS BIGINT) AS n_unknown, CAST(n_sentences AS BIGINT) AS n_sentences
FROM (SELECT *, CAST({" + ".join(numbers)} AS BIGINT) AS n_found,
        list_filter(f, lambda x, k: x IS NOT NULL AND (k = 1 OR NOT list_contains(f[1:k - 1], x))) AS list_distinct_in_order
      FROM (SELECT *, [{", ".join(fits)}] AS f FROM r{len(RULES) - 1}))
"""


SQL = _sql()
