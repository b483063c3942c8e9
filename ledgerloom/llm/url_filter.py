"""URL filters: host rules first, then a weighted vocabulary matched by an Aho-Corasick automaton.

One pass of the automaton over a URL finds every vocabulary term in it; a hit counts only if it is not
inside a longer run of letters and digits. One strict term rejects the URL, and so do several distinct
soft ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "hentai", "escort", "escorts", "camgirls", "warez", "keygen", "phishing", "malware", "torrent", "torrents", "viagra", "cialis")
SOFT = ("adult", "bet", "betting", "bonus", "casino", "cheap", "coupon", "crack", "dating", "download", "free", "gambling", "jackpot", "loan", "loans", "lottery", "nude", "pharmacy", "pills", "poker", "promo", "replica", "sex", "sexy", "slots", "spam", "win", "winner")
SOFT_HITS = 2


class HostRule(NamedTuple):
    rule: str  # host, then the path prefix from its first slash on
    verdict: str


RULES = (
    HostRule("com/en/", "block"),
    HostRule("example.com/en/7", "allow"),
    HostRule("net/de/", "allow"),
    HostRule("example.net/de/8", "block"),
    HostRule("org/es/", "block"),
)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty without a url or a ``://``. Only A-Z is lower-cased, and only in the host."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for k, c in enumerate(rest):
        if c in "/?#":
            host, rest = rest[:k], rest[k:]
            break
    else:
        host, rest = rest, ""
    for k, c in enumerate(rest):
        if c in "?#":
            rest = rest[:k]
            break
    return host.translate(_FOLD), rest


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in soft:
        out.add_word(term, (term, False))
    for term in strict:
        out.add_word(term, (term, True))
    out.make_automaton()
    return out


def vocabulary_hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Distinct strict and distinct soft terms that stand in the url as whole runs of letters and digits."""
    text = (url or "").translate(_FOLD)
    found: tuple[set[str], set[str]] = set(), set()
    if not (strict or soft):
        return 0, 0
    for end, (term, is_strict) in _automaton(strict, soft).iter(text):
        start = end + 1 - len(term)
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found[is_strict].add(term)
    return len(found[True]), len(found[False])


@cache
def _by_host(rules: tuple[HostRule, ...]) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for r in sorted(set(rules), key=lambda r: (-len(r.rule), r.verdict != "block", r.rule)):
        host, slash, path = r.rule.partition("/")
        out.setdefault(host, []).append((slash + path, r.rule, r.verdict))
    return out


def matching_rule(host: str, path: str, rules: tuple[HostRule, ...] = RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of two as long a block wins, then the lesser by code point."""
    table, best = _by_host(rules), None
    suffix = host
    while suffix:
        for prefix, rule, verdict in table.get(suffix, ()):
            if path.startswith(prefix):
                best = min(best or (0, True, "", ""), (-len(rule), verdict != "block", rule, verdict))
                break
        _, dot, suffix = suffix.partition(".")
    return best[2:] if best else None


def _batches(rules, strict, soft, soft_hits):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                n_strict, n_soft = vocabulary_hits(url, strict, soft)
                rule, verdict = matching_rule(host, path, rules) or (None, "block" if n_strict >= 1 or n_soft >= soft_hits else "allow")
                rows.append((host, path, rule, verdict, n_strict, n_soft))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c), type=pa.string()) for c in cols[:4]), *(pa.array(list(c), type=pa.int64()) for c in cols[4:])], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
            )

    return run


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row of ``pages``.

    A null url, and one without ``://``, has an empty host and path; the vocabulary still reads whatever text
    there is, and a null or empty url is allowed. Repeated rows and null ids each return a row. Other columns
    are ignored; an empty table gives an empty result. Rules and terms travel with the code: they are fixed
    lists, not data.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return plain.mapInArrow(_batches(tuple(rules), tuple(strict), tuple(soft), soft_hits), "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long")


def oracle_sql(rules: tuple[HostRule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> str:
    """DuckDB SQL for the rows of ``judge``: regular expressions in place of the automaton."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule))
    fits = lambda r: f"((host = '{r.rule.partition('/')[0]}' OR ends_with(host, '.{r.rule.partition('/')[0]}')) AND starts_with(path, '/{r.rule.partition('/')[2]}'))"
    when = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, value)}'" for r in ranked) + " END"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce({fold.format("url")}, '') AS low,
         {fold.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hits AS (SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits, {when("rule")} AS rule, {when("verdict")} AS fixed FROM parts)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN strict_hits >= 1 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM hits"""
