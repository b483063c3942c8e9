"""Known values of the pure functions."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, nested, text, udfs, urls
from ledgerloom.operators.blocks import blocks_of, collapse_spans


def value(spark, f, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.norm_title, "2Q26 Earnings Call!", "2q26earningscall"),
        (dates.norm_date, "2026-08-04T17:00:00", "2026-08-04"),
        (dates.date_bucket, "2026-03-15", "2026-q1"),
        (dates.date_bucket, "2026-13", "2026"),
        (dates.date_bucket, "2026", "2026"),
        (urls.canon_url, "HTTPS://IR.Acme.com/Events/?q=1#top", "https://ir.acme.com/Events?q=1"),
        (urls.canon_url_media, "https://a.com/x?utm_source=feed&b=2&a=1", "https://a.com/x?a=1&b=2"),
        (dates.norm_date_shape, "March 15, 2026", "2026-03-15"),
        (dates.norm_date_shape, "15 Mar 2026", "2026-03-15"),
        (dates.norm_date_shape, "Mar 2026", "2026-03"),
        (dates.norm_date_shape, "15/03/2026", "2026-03-15"),
        (dates.norm_date_shape, "03/04/2026", "2026-03-04"),
        (dates.norm_date_shape, "2026年3月15日", "2026-03-15"),
        (dates.norm_date_shape, "2026년 3월 15일", "2026-03-15"),
        (dates.norm_date_shape, "2026H1", "2026"),
        (dates.norm_date_shape, "FY2026", "2026"),
        (dates.norm_date_shape, "2026-q1", "2026-Q1"),
        (dates.norm_date_shape, "2010-05-00", "2010-05-00"),
        (dates.norm_date_shape, "June 1 - June 3, 2026", ""),
        (dates.norm_date_shape, None, ""),
        (lambda c: dates.norm_date_shape(c, keep_range_year=True), "June 1 - June 3, 2026", "2026-06-01"),
        (lambda c: dates.norm_date_shape(c, day_first=True), "03/04/2026", "2026-04-03"),
        (dates.date_precision, "2026-03-15T09:00", "day"),
        (dates.date_precision, "2026-H1", "unknown"),
        (lambda c: dates.plausible_date(c, 2026), "", True),
        (lambda c: dates.plausible_date(c, 2026), "1992", False),
        (lambda c: dates.plausible_date(c, 2026), "2031", True),
        (lambda c: dates.plausible_date(c, 2026), "2032", False),
        (urls.classify, "https://a.com/x.pdf", "pdf"),
        (urls.classify, "https://youtube.com/watch?v=1", "video"),
        (urls.classify, "https://a.com/rss/news.xml", "other"),
        (urls.classify, "https://a.com/cal.ics", "other"),
        (urls.classify, "https://a.com/news/pdf/", "pdf"),
        (urls.classify, "https://a.com/default.aspx", "html"),
        (urls.classify, "mailto:x@a.com", "other"),
        (urls.classify, None, "other"),
        (urls.registrable_domain, "ir.hotai.com.tw", "hotai.com.tw"),
        (urls.registrable_domain, "www.acme.com", "acme.com"),
        (nested.salvage_json, 'well: {"a": 1} done', '{"a": 1}'),
        (nested.salvage_json, "none", "{}"),
        (text.norm_evidence, "EBITDA of EUR1 billion**- [1]- **by 2030.", "ebitda of eur1 billion by 2030."),
    ],
)
def test_vector(spark, f, given, want):
    assert value(spark, f, given) == want


@pytest.mark.parametrize(("given", "want"), [("2026-Q2", True), ("2026-Q1", True), ("2026-05", True), ("2026", True), ("2026-H2", True), ("2026-FY", True), ("2026-05-31", True), ("2026-05-30", False), ("2022-02-29", False), ("2025-FY", False), ("2026-q2", False), (None, None)])
def test_period_now(spark, given, want):
    assert value(spark, lambda c: dates.period_now(c, F.lit("2026-05-31 12:00:00").cast("timestamp_ntz")), given) is want


def test_event_key_falls_back_to_the_address(spark):
    df = spark.createDataFrame([("", "2026-01-01", ["https://A.com/x/"]), ("Q1", "2026-Q1", []), (None, None, [])], "t string, d string, u array<string>")
    assert [r.k for r in df.select(urls.event_key(F.col("t"), F.col("d"), F.col("u")).alias("k")).collect()] == ["https://a.com/x", "q1|2026-q1", ""]


def test_grounded():
    body = "the board of acme has approved a dividend of two euro per share"
    assert udfs.grounded("acme has approved a dividend of", body)
    assert udfs.grounded("acme has rejected a dividend of", body)
    assert not udfs.grounded("acme has rejected the dividend of", body)
    assert not udfs.grounded("two euro", body)
    assert not udfs.grounded(None, body)


def test_chunks_keep_everything():
    t = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(400))
    parts = udfs.split_text(t, 1000)
    assert "".join(parts) == t
    assert udfs.split_text("", 10) == [""]


def test_inline_text():
    page = "<head><title>x</title></head><body><p>One <b>two</b><script>no()</script></p><a href='/a b'>Go  there</a><p>Three"
    assert udfs.inline_text(page, "https://e.com/x/") == "One two\n[Go there](https://e.com/a b)\nThree"
    assert udfs.inline_text(None, None) == ""


def test_tables_and_blocks():
    assert udfs.parse_tables("<table><tr><th>a<th>b<tr><td>1<td>2</table>") == [{"table_idx": 0, "headers": ["a", "b"], "rows": [["1", "2"]]}]
    assert udfs.parse_tables(None) == []
    assert [b["type"] for b in blocks_of("# t\n\n| a |\n|---|\n| 1 |\n- x\n")] == ["md", "table", "list"]
    assert blocks_of(None) == []
    assert collapse_spans([["a", "a", "b"], ["t", "t", "t"], ["1", "1", ""]]) == [["a", "b"], ["t"], ["1", ""]]


def test_overlap_join():
    a = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert udfs.overlap_join([a[:30], a[5:]]) == a
    assert udfs.overlap_join([]) == ""
