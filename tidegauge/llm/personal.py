"""Personal data in texts: proposed by patterns, confirmed by checks, scored by context (operator 12), in DataFrame operations only.

For each kind a pattern proposes spans, leftmost and without overlap.  A check confirms or drops each: parts of an
address at most 255, digits of a card (Luhn), digits of a phone number, remainder modulo 97 of an account number
(IBAN), ranges of a social security number.  What is confirmed gets the score of its kind, raised by words of its
own kind within 30 characters and lowered by words that speak against it.  The four base kinds are always kept; the
added kinds are kept from a score of 0.5 and where they overlap no base span.

Spark gives the matches of a pattern but not their places.  A text is cut by the pattern as well, and the lengths of
the pieces between give the places, summed in blocks of 128 matches, so a text full of matches costs little more than
its length.  Context and neighbours of a span are the ends of the pieces beside it.  The patterns are those of the
contract, with possessive repeats and a look behind instead of repeated starts: they match the same spans, in time
that grows with the text, and need no stack.  No shuffle; everything stays in the row of the document.

Null and empty texts have no spans; null ids, repeated rows and ties are rows like others; an empty table gives an
empty table; texts may be of any length; other columns of the input are ignored, whatever their names.  Places are
code points; the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import whole

NEAR = 30
ENOUGH = 0.5
BLOCK = 128
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean,text:string>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may: str  # a text in which this is not found holds no span that passes the check
    check: str  # SQL over z.h, the match, and z.d, its digits
    score: float
    base: bool
    near: str = ""  # words that raise the score by 0.3
    against: str = ""  # words that lower it by 0.3


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is computed once and not for each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Digits from the right, every second one doubled (less 9 above 9), sum to a multiple of ten.
LUHN = "aggregate(sequence(1, length(z.d)), 0, (s, i) -> " + let("int(substring(z.d, length(z.d) - i + 1, 1)) * if(i % 2 = 0, 2, 1)", "x", "s + x - if(x > 9, 9, 0)") + ") % 10 = 0"
#: The first four characters go to the end, letters count from 10; the number leaves 1 when divided by 97.
MOD97 = let(
    "replace(substring(z.h, 5) || substring(z.h, 1, 4), ' ', '')", "t",
    "aggregate(sequence(1, length(t)), 0, (s, i) -> " + let("ascii(substring(t, i, 1))", "c", "if(c < 65, s * 10 + c - 48, s * 100 + c - 55) % 97") + ") = 1",
)
BYTE = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", f"(?:(?<!{LOCAL})|\\G){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", "true", 0.9, True, "mail|email|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
         rf"forall(split(z.h, r'\.'), p -> rlike(p, r'{BYTE}'))", 0.6, True, "ip|host|server|address|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", f"if(length(z.d) BETWEEN 16 AND 19, {LUHN}, false)", 0.7, True, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "length(z.d) BETWEEN 8 AND 15", 0.6, True, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", MOD97, 0.7, False, "iban|account|bank"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT rlike(z.h, '^(?:000|666|9)|-00-|0000$')", 0.3, False, "ssn|social|security"),
    Kind("local_phone", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}", r"[0-9]{3}[-.\x20][0-9]{4}", "true", 0.3, False, "phone|tel|call|mobile|fax"),
)


def _words(words: str) -> str:
    return f"(?i)(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0L, (p, q) -> p + q)"


def _before(hits: str, gaps: str) -> str:
    """SQL for the lengths before each match and the piece in front of it: summed per block of matches, then inside the block."""
    steps = f"zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> bigint(length(h) + length(g)))"
    sums = f"transform(sequence(0, int((size(s) - 1) div {BLOCK})), b -> {_sum(f'slice(s, b * {BLOCK} + 1, {BLOCK})')})"
    blocks = f"transform(sequence(0, size(t) - 1), b -> {_sum('slice(t, 1, b)')})"
    inside = _sum(f"slice(s, i - i % {BLOCK} + 1, i % {BLOCK})")
    return let(steps, "s", let(sums, "t", let(blocks, "o", f"transform(s, (x, i) -> o[int(i div {BLOCK})] + {inside})")))


def _spans(k: Kind) -> str:
    """SQL for the confirmed spans of a kind, from its matches and the pieces between them."""
    hits, gaps = f"_hits_{k.name}", f"_gaps_{k.name}"
    sides = f"zip_with(slice({gaps}, 1, size({hits})), slice({gaps}, 2, size({hits})), (l, r) -> struct(l, r))"
    matched = f"zip_with({hits}, {_before(hits, gaps)}, (h, at) -> struct(h, at, regexp_replace(h, '[^0-9]', '') AS d))"
    every = f"zip_with({matched}, {sides}, (m, n) -> struct(m.h AS h, m.at + length(n.l) AS at, m.d AS d, n.l AS l, n.r AS r))"
    context = f"right(z.l, {NEAR}) || ' ' || left(z.r, {NEAR})"
    score = f"{k.score}D"
    for words, by in ((k.near, 0.3), (k.against, -0.3)):
        if words:
            score += f" + if(rlike({context}, r'{_words(words)}'), {by}D, 0D)"
    good = k.check
    if not k.base:  # a part of a longer word or number is none
        good = f"NOT rlike(right(z.l, 1) || left(z.r, 1), '[A-Za-z0-9]') AND {good} AND {score} >= {ENOUGH}D"
    span = f"struct('{k.name}' AS kind, z.at AS start, z.at + length(z.h) AS end, round(least({score}, 1D), 2) AS score, {str(k.base).lower()} AS base, z.h AS text)"
    return f"if(size({hits}) = 0, CAST(array() AS {SPAN}), CAST(transform(filter({every}, z -> {good}), z -> {span}) AS {SPAN}))"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, spans (kind, start, end, score, base, text), by kind as listed, then start."""
    rows = docs.select(F.col(key), whole(text).alias("_text"))
    none = "CAST(array() AS array<string>)"
    rows = rows.withColumns({f"_hits_{k.name}": F.expr(f"if(rlike(_text, r'{k.may}'), regexp_extract_all(_text, r'{k.pattern}', 0), {none})") for k in KINDS})
    rows = rows.withColumns({f"_gaps_{k.name}": F.expr(f"if(size(_hits_{k.name}) > 0, split(_text, r'{k.pattern}', -1), {none})") for k in KINDS})
    base, added = (", ".join(_spans(k) for k in KINDS if k.base == b) for b in (True, False))
    rows = rows.select(key, F.expr(f"concat({base})").alias("_base"), F.expr(f"concat({added})").alias("_added"))
    free = "filter(_added, a -> NOT exists(_base, b -> a.start < b.end AND b.start < a.end))"
    return rows.select(key, F.expr(f"concat(_base, if(size(_added) > 0, {free}, _added))").alias("spans"))


def _told(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans."""
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k.name}')))").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select(key, *counts, F.sha2(_told("filter(spans, s -> s.base)"), 256).alias("base_sha256"), _told("spans").alias("spans"))


#: Name, pattern, check over (h, d: its digits), score, words, words against; the base patterns are the contract's text.
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", None, None),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"len(list_filter(string_split(h, '.'), lambda p: NOT regexp_matches(p, '{BYTE}'))) = 0", None, None),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), "
     "lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INT) ELSE 2 * CAST(d[length(d) - i + 1] AS INT) - CASE WHEN CAST(d[length(d) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0", None, None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15", None, None),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
     "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4), ''), "
     "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1", 0.7, "iban|account|bank"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(h, '^(?:000|666|9)|-00-|0000$')", 0.3, "ssn|social|security"),
    ("local_phone", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}", "true", 0.3, "phone|tel|call|mobile|fax"),
)


def _sql() -> str:
    parts = ["t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"]
    for k, (name, pattern, check, score, words) in enumerate(_SQL_KINDS):
        parts.append(f"c{k} AS (SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM t)")
        parts.append(
            f"""h{k} AS (SELECT rid, h, regexp_replace(h, '[^0-9]', '', 'g') AS d, gaps[i] AS l, gaps[i + 1] AS r,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i FROM c{k}))"""
        )
        keep = check
        if score is not None:
            keep += f""" AND NOT regexp_matches(right(l, 1) || left(r, 1), '[A-Za-z0-9]')
        AND {score} + CASE WHEN regexp_matches(right(l, {NEAR}) || ' ' || left(r, {NEAR}), '{_words(words)}') THEN 0.3 ELSE 0 END >= {ENOUGH}"""
        parts.append(f"s{k} AS (SELECT rid, {k} AS k, '{name}' AS kind, s, s + length(h) AS e FROM h{k} WHERE {keep})")
    base = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4))
    more = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4, len(_SQL_KINDS)))
    parts.append(f"base AS MATERIALIZED ({base}), more AS ({more})")
    parts.append("spans AS (SELECT * FROM base UNION ALL SELECT m.* FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND m.s < b.e AND b.s < m.e))")
    told = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n, *_ in _SQL_KINDS[:4])
    return f"""WITH {", ".join(parts)}
SELECT doc_id, {counts}, sha256({told.format(" FILTER (k < 4)")}) AS base_sha256, {told.format("")} AS spans FROM t LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


SQL = _sql()
