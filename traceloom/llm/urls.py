"""Operator 2: URL filters by pattern rules under their rarest literal token.

Pattern rules are plain texts with ``*`` (anything), ``^`` (a separator or the
end) and ``||`` in front (the start of a host label).  A rule's literal tokens
are the runs of letters and digits that must stand in a URL as whole tokens: a
run at the end of a rule, or beside a ``*``, may go on in the URL and is none.
Each rule is indexed under the one of its tokens that the fewest URLs hold; a
URL's own tokens fetch candidate rules, and only those run their regular
expressions.  Rules without such a token are always candidates.  Site rules (host and
path prefix) decide first: the longest that fits wins; of equally long ones that
with the greatest host, then path, in order of characters, then the last listed.
They lie in a table by host, which a URL's host and its parent domains probe, no
more of them than the rules' hosts have labels; so a plan has one size for five
rules and for ten thousand.

Null URLs and URLs without ``://`` have an empty host and path, fit no site
rule, and are judged by the pattern rules alone.  An empty table gives no rows.
Repeated rows are judged each.  Columns that are named like the new ones, in any
case, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import Lookup
from .shared import has, ship

TOKEN = "[a-z0-9]+"
#: Pattern rules that block: trackers, shops for adults, betting, raw downloads.
PATTERNS = (
    "||adserver.", "||doubleclick.", "||tracker.", "/banners/*.gif^", "/pixel.gif?", "/popunder/", "/clickbait/",
    "||casino", "/casino/", "/betting/", "||porn", "/xxx/", "/escorts/", "/warez/", "/keygen", ".torrent^", ".exe^",
)
#: (verdict, host, path): the longest that fits wins.
SITE_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest site rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, dict] = {}
    for n, (verdict, h, p) in enumerate(rules):
        by_host.setdefault(h, {"rules": []})["rules"].append({"size": len(h + p), "host": h, "path": p, "n": n, "verdict": verdict})
    table = Lookup(by_host, "rules:array<struct<size:int,host:string,path:string,n:int,verdict:string>>")
    labels = 1 + max(h.count(".") for h in by_host)
    # the host itself and its last labels; one of fewer labels gives itself again
    domains = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda k: F.call_function("substring_index", host, F.lit("."), -k)))
    found = F.flatten(F.transform(F.array_union(domains, F.array(host)), lambda d: F.coalesce(table.find(d)["rules"], F.array().cast("array<struct<size:int,host:string,path:string,n:int,verdict:string>>"))))
    best = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return F.when(best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern rule, over the lower-case URL."""
    head = ""
    if pattern.startswith("||"):
        head, pattern = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", pattern[2:]
    body = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in pattern)
    return head + body


def literal_tokens(pattern: str) -> list[str]:
    """The runs of letters and digits that every URL the pattern fits holds as whole tokens."""
    head = pattern.startswith("||")  # what follows stands at the start of a host label
    body = pattern[2:] if head else pattern
    out = []
    for m in re.finditer(TOKEN, body):
        before = body[m.start() - 1 : m.start()] or ("." if head else "*")
        after = body[m.end() : m.end() + 1] or "*"
        # ^ may be the end, but never a letter or digit
        if before != "*" and after != "*":
            out.append(m[0])
    return out


def token_counts(urls: DataFrame, tokens: Sequence[str], url: str = "url") -> dict[str, int]:
    """How many URLs of the table hold each of the rules' tokens (no more rows than those)."""
    if not tokens:
        return {}
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string"))  # the rules' own, a configuration
    held = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{url}`").cast("string")), F.lit(f"({TOKEN})"), 1))).alias("token"))
    return {r["token"]: r["n"] for r in held.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class PatternIndex:
    """Rules by their rarest token; rules without one are always candidates."""

    def __init__(self, patterns: Sequence[str], counts: dict[str, int]):
        self.by_token: dict[str, list[re.Pattern]] = {}
        self.always: list[re.Pattern] = []
        self.tried = 0  # regular expressions run
        for p in patterns:
            tokens = literal_tokens(p)
            rx = re.compile(pattern_regex(p))
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rx)
            else:
                self.always.append(rx)

    def blocks(self, url: str) -> bool:
        url = url.lower()
        for token in set(re.findall(TOKEN, url)):
            for rx in self.by_token.get(token, ()):
                self.tried += 1
                if rx.search(url):
                    return True
        self.tried += len(self.always)
        return any(rx.search(url) for rx in self.always)


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = SITE_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    verdict is ``allow`` or ``block``: the site rule's, else ``block`` where a
    pattern rule fits.  One pass counts the rules' tokens, one judges; no shuffle
    of rows.  Only URLs that no site rule decides go through the pattern index.
    """
    has(pages, url)
    ship(pages.sparkSession)
    counts = token_counts(pages.select(F.col(f"`{url}`").alias("u")), sorted({t for p in patterns for t in literal_tokens(p)}), "u")

    @F.pandas_udf("boolean")
    def blocked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PatternIndex(patterns, counts)
        for part in parts:
            yield pd.Series([bool(u) and index.blocks(u) for u in part], dtype=bool)

    col = F.col(f"`{url}`").cast("string")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = F.struct(*keep).alias("row") if keep else F.lit(None).alias("row")
    parts = pages.select(row, col.alias("url"), host_of(col).alias("host"), path_of(col).alias("path"))
    ruled = parts.withColumn("fits", site_rule(F.col("host"), F.col("path"), rules))
    judged = ruled.withColumn("blocked", blocked(F.when(F.col("fits").isNull(), F.col("url"))))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(*(["row.*"] if keep else []), "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = SITE_RULES, patterns: Sequence[str] = PATTERNS) -> str:
    """The same rows from DuckDB: every regular expression on every URL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = "".join(
        f" WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {quoted(v + ' ' + h + p)}"
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    )
    found = " OR ".join(f"regexp_matches(lower(coalesce(url, '')), {quoted(pattern_regex(p))})" for p in patterns)
    lower = "translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH a AS (SELECT page_id, {lower} AS host, regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path, {found} AS hit FROM pages), "
        f"b AS (SELECT *, CASE{cases} END AS fits FROM a) "
        "SELECT page_id, host, path, split_part(fits, ' ', 2) AS rule, coalesce(split_part(fits, ' ', 1), CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict FROM b"
    )
