"""Title, evidence and chunk functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
EVENT_TYPES = ("earnings", "press_release", "presentation", "filing", "webcast", "conference", "shareholder_meeting", "dividend", "other")
GENERIC_TITLES = ("", "investor relations", "ir", "home", "untitled", "error", "404", "403 forbidden", "404 not found", "not found", "page not found", "access denied", "just a moment...")
ACCESSION_NUMBER = r"^\d{9,10}-\d{2}-\d{6}$"
HEX_ID = r"(?i)^[0-9a-f]{8}[\s\-][0-9a-f]{4}[\s\-][0-9a-f]{4}"
ERROR_TITLES = ("error |", "error -")
WALL_TITLES = ("attention required", "just a moment")
SLIDE_TITLE = r"^(slide|投影片|幻灯片|diapositiva|folie|presentation)\s*\d*$"
FILE_TITLE = r"\.(xls|xlsx|zip|csv|htm|xml|jpe?g|png|docx?|pptx?)$"
EXCHANGE_NAME = r"(?i)\b(NYSE American|NYSE|NASDAQ|TSXV|TSX|LSE|SIX|Euronext|ASX|Paris|London)\b"
TICKER = r"[:\s]\s*([A-Z][A-Z0-9.\-]{0,9})\b"
MAGIC = ("%PDF-", "PK\x03\x04", "GIF8", "ID3", "OggS", "fLaC")
SPEAKER = r"(?i)(?:^|\n)\s*(?:operator\s*[:：]|q\s*[—\-–]|a\s*[—\-–]|[A-Z][a-z]+ [A-Z][a-z]+\s*[:：—\-–]|[A-Z][A-Z .]+\s*[:：])"
EXCHANGE_TAG = r"(?i)(\((?:NYSE American|NYSE|NASDAQ|TSXV|TSX|LSE|SIX|Euronext|ASX)[^):]{0,15}:\s*[^)]{1,40}\))"
WALL_MARKERS = (
    "just a quick security check", "verifying the security", "ray id", "request unsuccessful", "access denied", "attention required", "checking your browser", "enable javascript and cookies",
    "challenge-platform", "cf-chl", "__cf_chl", "cf-turnstile", "turnstile", "_incapsula_", "確認しています", "しばらくお待ち", "セキュリティチェック", "アクセスが拒否", "安全验证", "请稍候", "正在验证", "拒绝访问", "보안 확인", "잠시만 기다",
)


def norm_title(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def norm_words(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def norm_evidence(c: Column) -> Column:
    """Typography and Markdown taken away: quotes, dashes, links, footnotes, emphasis, lone dashes, white space.

    Compatibility forms (NFKC) are folded by ``functions.udfs.nfkc`` first, where they may occur.
    """
    c = F.translate(F.coalesce(c, F.lit("")), "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- ")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"\[[0-9]{1,3}\]", " ")
    c = F.regexp_replace(c, "[*_`~#]+", " ")
    c = F.regexp_replace(c, r"(?<=\s)-+(?=\s)|^-+\s|\s-+$", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def coerce_type(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*EVENT_TYPES), t).otherwise("other")


def is_generic_title(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return t.isin(*GENERIC_TITLES) | t.contains("just a moment") | t.contains("are you a human") | (F.length(t) < 3)


def is_machine_id(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return t.rlike(ACCESSION_NUMBER) | t.rlike(HEX_ID)


def is_junk_title(c: Column) -> Column:
    """Whether a title is a machine's id, an error or wall page's, a slide's default or a file's name."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    forms = [t.isin("error", "cloudflare"), t.rlike(SLIDE_TITLE), t.rlike(FILE_TITLE), *[t.startswith(e) for e in ERROR_TITLES], *[t.contains(w) for w in WALL_TITLES]]
    return reduce(lambda x, y: x | y, forms, is_machine_id(c))


def is_challenge(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for m in WALL_MARKERS:
        out = out | low.contains(m)
    return out


def is_thin(c: Column) -> Column:
    """Under 200 characters, or fewer than two sentence ends."""
    ends = F.regexp_count(c, F.lit("[.。][ \\t\"'”)\\]]|\\.[A-Z]"))
    return F.coalesce((F.length(F.trim(c)) < 200) | (ends < 2), F.lit(True))


def looks_binary(c: Column) -> Column:
    """A known magic prefix, or more than 5 % control or replacement characters among the first 2000."""
    head = F.substring(c, 1, 2000)
    odd = F.regexp_count(head, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\uFFFD]"))
    magic = F.lit(False)
    for m in MAGIC:
        magic = magic | c.startswith(m)
    return F.coalesce(magic | (odd > 0.05 * F.length(head)), F.lit(False))


def cjk_ratio(c: Column) -> Column:
    """Share of CJK, Hangul and full-width characters among the first 4000."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 4000)
    n = F.regexp_count(head, F.lit("[\u3000-\u9fff\uac00-\ud7af\uff00-\uffef]"))
    return F.when(F.length(head) > 0, n / F.length(head)).otherwise(0.0)


def text_cap(c: Column, base: int = 40000) -> Column:
    """The characters a model may get: fewer, the more of the text is CJK."""
    r = cjk_ratio(c)
    return F.when(r > 0.05, F.floor(base * (1.0 - 0.64 * r))).otherwise(base).cast("long")


def token_budget(context: int, output: int) -> int:
    return max(2000, int((context - output - 1200) * 2.1))


def chunks(c: Column, target: int, overlap: int = 0, head: int = 0) -> Column:
    """Blocks of ceil(length / target) equal steps; each begins ``overlap`` early, later ones are led by the text's head."""
    n = F.greatest(F.ceil(F.length(c) / target).cast("int"), F.lit(1))
    step = F.ceil(F.length(c) / n).cast("int")
    block = lambda i: F.substring(c, F.greatest(i * step - overlap, F.lit(0)) + 1, step + F.least(i * step, F.lit(overlap)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, block(i)).otherwise(F.concat(F.substring(c, 1, head), block(i))))


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def coarse_status(c: Column) -> Column:
    out = F.lit("done")
    for s in ("pending", "skipped", "failed", "done"):
        out = F.when(c.startswith(s), s).otherwise(out)
    return out


def status_reason(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, "^(done|failed|skipped|pending):?", "")), 1, 200)


def exchange_tags(c: Column) -> Column:
    """Parenthesised exchange tags such as (NYSE: ABC), distinct, sorted, ten at most."""
    tags = F.regexp_extract_all(c, F.lit(EXCHANGE_TAG), 1)
    return F.slice(F.array_sort(F.array_distinct(tags)), 1, 10)


def tickers(c: Column) -> Column:
    body = F.regexp_replace(F.concat(F.lit(" "), c), EXCHANGE_NAME, " ")
    found = F.regexp_extract_all(body, F.lit(TICKER), 1)
    return F.array_sort(F.array_except(found, F.array(F.lit("AND"), F.lit("WWW"))))


def search_keys(keys: Column) -> Column:
    return F.slice(F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: F.length(k) >= 3), 1, 3)


def is_transcript_like(c: Column) -> Column:
    """Two speaker turns or more."""
    return F.coalesce(F.regexp_count(c, F.lit(SPEAKER)) >= 2, F.lit(False))
