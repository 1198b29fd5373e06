"""URL verdicts by pattern rules that are indexed by their rarest token (operator 10), in DataFrame operations only.

A rule is a regular expression over host and path, with the tokens that any address it fits must hold.  Tokens
are counted over all addresses, and each rule is filed under its rarest token.  An address is cut into tokens,
those fetch the rules filed under them, and only the fetched rules run their expressions; rules without a safe
token are always fetched.  Of the rules that fit, the longest wins.

The rules are configuration and part of the query text; their number is checked.  Verdicts need no shuffle; the
token counts come to one row for each token of the rules.

Null addresses and those without ``://`` have empty host and path, fit no host rule and get the method's own
verdict; an empty address likewise; null ids, ties and repeated rows are rows like others; an empty table gives
an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 5_000
CUT = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # over host, a line feed, path, both ``escaped``; found anywhere
    tokens: tuple[str, ...]


def site_rule(verdict: str, site: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path begins with /path."""
    host, slash, path = site.partition("/")
    host, path = host.lower(), slash + path
    # a token is safe if what stands on both of its sides in the rule also stands there in every address
    whole = [t for t in re.split(CUT, host) if t] + [m[1] for m in re.finditer("(?<![A-Za-z0-9])([A-Za-z0-9]+)(?=[^A-Za-z0-9])", path)]
    return Rule(site, verdict, rf"\A(?:[^\n]*\.)?{quoted(host)}\n{quoted(path)}", tuple(whole))


def escaped(part: Column) -> Column:
    """A host or path without line feeds, so that one can stand between the two in an address."""
    return F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\%"))


def address(host: Column, path: Column) -> Column:
    return F.concat(escaped(host), F.lit("\n"), escaped(path))


def quoted(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("\n", "\\%")
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in text)


#: Fixed value of the contract.
RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
#: The method's own verdict where no rule fits: addresses that serve trackers, adverts or sessions are blocked.
PATTERNS = (
    Rule("ads", "block", r"(?:\A|[^\nA-Za-z0-9])(?:[^\n]*\n[^\n]*/)?ads?(?:[./]|\z)", ()),
    Rule("track", "block", r"/track(?:er|ing)?(?:/|\z)", ()),
    Rule("login", "block", r"/(?:log|sign)in(?:/|\z)", ()),
)


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A to Z lower-cased, other letters as they are."""
    host = F.regexp_extract(_rest(url), r"\A[^/?#]*+", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*+([^?#]*+)", 1)


def _rest(url: Column | str) -> Column:
    col = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", col)
    return F.when(at > 0, F.substring(col, at + 3, F.length(col))).otherwise(F.lit(""))


def token_counts(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """How many addresses hold each token of the rules; one row for each such token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.split(address(host_of(url), path_of(url)), CUT))
    own = F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]))
    counted = urls.select(F.explode(own).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counted}


def judge(urls: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Rule] = PATTERNS, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per address: key, host, path, rule (null if none fits), verdict, matched (the pattern that gave the method's verdict), fetched (rules run)."""
    every = [*rules, *patterns]
    if len(every) > MOST_RULES:
        raise ValueError(f"{len(every)} rules; at most {MOST_RULES} stand in one query text, judge by parts")
    counts = token_counts(urls, every, url)
    filed: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(every):
        if r.tokens:
            filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(i)
        else:
            always.append(i)
    rows = urls.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("address", address(F.col("host"), F.col("path")))
    fetched = F.array(*[F.lit(i) for i in always]).cast("array<int>")
    if filed:
        index = F.create_map(*[x for t, ids in filed.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
        held = F.array_intersect(F.array_distinct(F.split("address", CUT)), F.array(*[F.lit(t) for t in filed]))
        fetched = F.array_union(F.flatten(F.transform(held, lambda t: F.element_at(index, t))), fetched)
    rows = rows.withColumn("fetched", fetched)

    def fits(i: int) -> Column:  # the expression runs only if its rule was fetched
        return F.array_contains("fetched", i) & F.col("address").rlike(every[i].pattern)

    longest = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    rows = rows.withColumn("hit", F.coalesce(*[F.when(fits(i), F.lit(i)) for i in longest], F.lit(None).cast("int")))
    own = [F.when(fits(len(rules) + i), F.lit(len(rules) + i)) for i in range(len(patterns))]
    rows = rows.withColumn("pattern", F.when(F.col("hit").isNull(), F.coalesce(*own, F.lit(None).cast("int"))))
    names, verdicts = (F.array(*[F.lit(getattr(r, f)) for r in every]) for f in ("name", "verdict"))
    at = F.coalesce("hit", "pattern")
    return rows.select(
        key, "host", "path",
        F.when(F.col("hit").isNotNull(), names[F.col("hit")]).alias("rule"),
        F.when(at.isNotNull(), verdicts[at]).otherwise("allow").alias("verdict"),
        F.when(F.col("pattern").isNotNull(), names[F.col("pattern")]).alias("matched"),
        F.size("fetched").alias("fetched"),
    )


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rhost, rpath, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path,
        (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
        (SELECT arg_max(act, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS act
      FROM h),
g AS (SELECT *, replace(replace(host, '\', '\\'), chr(10), '\%') || chr(10) || replace(replace(path, '\', '\\'), chr(10), '\%') AS address FROM f)
SELECT page_id, host, path, rule, coalesce(act, CASE
    WHEN regexp_matches(address, '(?:\A|[^\nA-Za-z0-9])(?:[^\n]*\n[^\n]*/)?ads?(?:[./]|\z)') THEN 'block'
    WHEN regexp_matches(address, '/track(?:er|ing)?(?:/|\z)') THEN 'block'
    WHEN regexp_matches(address, '/(?:log|sign)in(?:/|\z)') THEN 'block'
    ELSE 'allow' END) AS verdict FROM g
"""
