"""Rules of readers, pages and orders: each branch, and queries without SQL against plain versions."""

import html
import os
import random
import re
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.functions import dates, text, udfs, urls
from ledgerloom.operators import blocks, control, graph, ordering, readers, upserts
from ledgerloom.plans import normalise

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

DATES = [
    ("2024-01-31T09:00:00Z", "2024-01-31"), ("2024-01-31 9:30", "2024-01-31"), ("2024/1/5", "2024-01-05"), ("2024.13.05", "2024"), ("5.1.2024", "2024-05-01"), ("31.12.2024", "2024-12-31"), ("32/13/2024", "2024"),
    ("2024-Q3", "2024-Q3"), ("2024-q5", "2024"), ("2024-H2", "2024"), ("2024H2", "2024"), ("FY-2024", "2024"), ("2024FY", "2024"), ("2024년 12월 3일", "2024-12-03"), ("2024年03月", "2024-03"), ("2024-07", "2024-07"),
    ("Sept. 5, 2024", "2024-09-05"), ("5 september 2024", "2024-09-05"), ("May 2024", "2024-05"), ("Marchy 5, 2024", "2024-03-05"), ("Foo 5, 2024", "2024"), ("2024-05-02 - 2024-05-09", "2024-05-02"), ("2024-05-02 to 2024-05-09", "2024-05-02"),
    ("2024-05-02~05-09", "2024-05-02"), ("circa 1999?", "1999"), ("in 1875", ""), ("", ""), ("  ", ""), ("tomorrow", ""), ("2024 - 05 - 02", "2024"), ("12:30", ""), ("Mar 15, 2024 10:30 ", "2024-03-15"), ("2024-05-02,", "2024-05-02"),
]


def test_dates_by_layout(spark):
    df = spark.createDataFrame([(s,) for s, _ in DATES], "s string")
    assert {r.s: r.v for r in df.select("s", dates.norm_date_shape(F.col("s")).alias("v")).collect()} == dict(DATES)


REFERENCES = ["a", "./a", "../a", "../../../a/./b/..", "/a/b/", "//h.com/x", "https://o.com/y?z#f", "?q=2", "#top", "", "a/b?x=/../y", "/..", "mailto:a@b.c", "b/", "."]


def test_references_resolve_as_browsers_do(spark):
    for base in ("https://e.com/d/e/page.html?old=1", "http://e.com", "https://e.com/"):
        df = spark.createDataFrame([(r,) for r in REFERENCES], "r string")
        got = {r.r: r.v for r in df.select("r", urls.resolve(F.lit(base), F.col("r")).alias("v")).collect()}
        for ref in REFERENCES:
            assert got[ref] in (urljoin(base, ref), urljoin(base, ref).replace(".com?", ".com/?")), (base, ref)


def test_candidates_and_junk_titles(spark):
    known = {
        "https://www.acme.com/": True, "https://acme.com": True, "https://acme.com/investors/": True, "https://acme.com/about": False, "https://acme.com/ir/q1.pdf": False, "https://acme.com/careers/events/": False,
        "https://acme.q4web.com/events/": True, "https://other.com/investors/": False, "https://ir.acme.com/Annual-Report": True,
    }
    df = spark.createDataFrame([(u,) for u in known], "u string")
    assert {r.u: r.v for r in df.select("u", urls.is_ir_candidate(F.col("u"), F.lit("https://acme.com")).alias("v")).collect()} == known
    junk = {"0001234567-24-000123": True, "0A1B2C3D-aaaa-bbbb-cc": True, "Error | x": True, "Errors of the past": False, "Slide 3": True, "Slides 3": False, "a.docx": True, "a.pdf": False, "Cloudflare": True, "Cloudflare results": False, "just a moment": True, "Q1": False, None: False}
    df = spark.createDataFrame([(t,) for t in junk], "t string")
    assert {r.t: r.v for r in df.select("t", text.is_junk_title(F.col("t")).alias("v")).collect()} == junk


def test_body_ladder():
    long = "word " * 60
    assert udfs.extract_body(f"<nav>{long}</nav><main><p>{long}</p><aside>no</aside></main>", None) == ("main", long.strip())
    assert udfs.extract_body(f"<nav>{long}</nav><main>too short</main><div><p>{long}</p>loose</div>", None) == ("paragraphs", long.strip())
    assert udfs.extract_body("<div>only this</div>", None) == ("inline", "only this")
    for page in ("", None, " ", "<script>x</script>"):
        assert udfs.extract_body(page, None) == ("empty", "")
    assert udfs.extract_body(f"<p>{long}</p>", None, thin=True) == ("empty", "")


def test_blocks_of_a_page():
    page = "<h2>Sales</h2><p>One <b>two</b>.</p><ul><li>x</li><li><a href='/y'>y</a></li></ul><table><tr><th>a<th>b</tr><tr><td>1</td><td><p>2</p>3</td></tr></table><p>After</p><table><tr><td>z</td></tr></table>"
    md = udfs.markdown_of(page, "https://e.com/d")
    assert md == "## Sales\n\nOne two.\n\n- x\n\n- [y](https://e.com/y)\n\n| a | b |\n|---|---|\n| 1 | 2 3 |\n\nAfter\n\n| z |\n|---|"
    tables = udfs.parse_tables(page)
    out = blocks.spliced(md, tables)
    assert [b["type"] for b in out] == ["md", "md", "list", "list", "table", "md", "table"]
    assert (out[4]["headers"], out[4]["rows"]) == (["a", "b"], [["1", "23"]]) and out[6]["rows"] == [["z"]]
    late = blocks.spliced("text", tables)
    assert [b["type"] for b in late] == ["md", "table", "table"] and [b["ord"] for b in late] == [0, 1, 2]
    own = blocks.spliced("| p | q |\n|---|---|\n| 1 | 2 |", [])
    assert (own[0]["headers"], own[0]["rows"]) == (["p", "q"], [["1", "2"]])
    assert blocks.spliced(None, []) == [] and udfs.markdown_of(None, None) == ""


def test_sheets(spark):
    cells = [("f", "1(J)", 4, 2, " Statement of income "), ("f", "1(J)", 4, 7, "2018-05-11 00:00:00"), ("f", "1(J)", 6, 7, "5"), ("f", "1(J)", 5, 3, "  "), ("f", "1(J)", 9, 2, None), ("f", "two", 0, 0, "12"), ("f", "none", 1, 1, " ")]
    out = {r.sheet: (r.heading, r.rows) for r in readers.sheet_tables(spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")).collect()}
    assert out == {"1(J)": ("Statement of income", [["Statement of income", "2018-05-11 00:00:00"], ["", "5"]]), "two": ("two", [["12"]])}


def test_transcripts(spark):
    audio = spark.createDataFrame([(1, 9, 10.0), (2, 9, 10.0), (3, 0, 10.0), (4, 9, 9999.0), (5, 9, None)], "id int, n_bytes int, duration_s double")
    said = spark.createDataFrame([(1, "big", 2.0, 3.0, " b "), (1, "big", 1.0, 2.0, "a"), (1, "small", 1.0, 2.0, "z"), (2, "small", 1.0, 2.0, "s"), (3, "big", 0.0, 1.0, "x"), (4, "big", 0.0, 1.0, "x"), (5, "else", 0.0, 1.0, "x")], "id int, model string, start_s double, end_s double, text string")
    out = {r.id: (r.reason, r.n_segments, r.text) for r in readers.transcripts(audio, said, ["big", "small"], 7200.0).collect()}
    assert out == {1: ("", 2, "a b"), 2: ("fallback:small", 1, "s"), 3: ("empty-bytes", 0, ""), 4: ("too-long", 0, ""), 5: ("transcribe-failed", 0, "")}


def test_halves_of_a_page_fail_each_on_their_own(spark):
    pages = spark.createDataFrame([(1, None, None, None), (2, "e", None, None), (3, None, "r", None), (4, None, None, "p")], "page_id int, error string, route_error string, partial string")
    events = spark.createDataFrame([(i, "t", [f"u{i}", "x"]) for i in (1, 2, 3)], "page_id int, title string, urls array<string>")
    routes = spark.createDataFrame([(i, u, 0.5) for i in (1, 2, 3, 4) for u in ("u1", "u2")], "page_id int, url string, score double")
    out = {r.page_id: (len(r.events), [x.url for x in r.routes], r.flag) for r in normalise.combine_pages(pages, events, routes).collect()}
    assert out == {1: (1, ["u2"], ""), 2: (0, ["u1"], "error"), 3: (1, [], "route_error"), 4: (0, ["u1", "u2"], "partial")}


def test_walk_stays_on_its_site(spark):
    links = spark.createDataFrame([("https://a.com/", u, 0.9, 10.0) for u in ("https://ir.a.com/x", "https://b.com/y")] + [("https://ir.a.com/x", "https://a.com/z", 0.9, 10.0)], "url string, target string, score double, s double")
    seeds = spark.createDataFrame([("a", "https://a.com/")], "site string, url string")
    walk = lambda **o: {r.url for r in normalise.crawl(seeds, links, **o).collect()}
    assert walk(same_site=True) == {"https://a.com/", "https://ir.a.com/x", "https://a.com/z"}
    assert walk(same_site=True, page_s="s", budget_s=5.0) == {"https://a.com/", "https://ir.a.com/x"}


def test_ranks_by_part_are_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(7)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, day int")
    got = {r.id: r["rank"] for r in ordering.ranked(df, ["id"], F.col("day")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}
    got = {r.id: r["rank"] for r in ordering.ranked(df, ["id"], F.col("day"), part_ascending=False).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}


def test_ties_never_depend_on_arrival(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", 2, "q"), ("b", 2, "q")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, v int, s string").repartition(3)
        assert {r.k: r.s for r in upserts.latest(df, ["k"], "v").collect()} == {"a": "y", "b": "q"}
        empty = spark.createDataFrame([], "k string, v int, s string")
        assert {r.k: (r.v, r.s) for r in upserts.insert_absent(empty, df, ["k"]).collect()} == {"a": (0, "z"), "b": (2, "q")}
        assert {r.k: r.s for r in upserts.never_downgrade(df, ["k"], "s", "done", "v").collect()} == {"a": "y", "b": "q"}


def test_limiter_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, f"k{rng.randrange(4)}", rng.choice([None, float(rng.randrange(300))])) for i in range(900)]
    got = {r.id: r.ok for r in control.accepted(spark.createDataFrame(rows, "id long, k string, t double"), "k", "t", 5, 20.0).collect()}
    want, kept = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[0])):
        held = [x for x in kept.get(k, []) if t is None or x > t - 20.0]
        want[i] = t is None or len(held) < 5
        if t is not None:
            kept[k] = held + [t] * want[i]
    assert got == want


def test_scoreboard_and_coverage_of_nothing(spark):
    e = lambda s: spark.createDataFrame([], s)
    board = graph.scoreboard(e("id int, stratum string, tags array<string>"), e("id int, exchange_tag string"), e("id int, level int, predicate string"), e("kind string, reason string"))
    assert {(r.section, r.key): r.value for r in board.collect()} == {("tags", k): 0 for k in ("have", "caught", "exact", "caught_pct", "exact_pct")} | {("predicates", k): 0 for k in ("kinds", "with_digits", "edges")}
    truth = spark.createDataFrame([(1, "https://a.com/x.mp3"), (1, "https://a.com/y"), (2, "https://b.com/z")], "id int, url string")
    found = spark.createDataFrame([(1, "https://cdn.com/?u=a.com/x.mp3"), (1, "http://a.com/y"), (3, "https://b.com/z")], "id int, url string")
    assert {r.id: (r.total, r.found, r.missing) for r in graph.media_coverage(truth, found, "id").collect()} == {1: (2, 2, []), 2: (1, 0, ["https://b.com/z"])}


def pages_of(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


@needs_tables
def test_inline_text_holds_the_words_of_a_page(spark):
    pages = pages_of(spark)
    for r in registry.queries()["src_09_inline_text"](spark, SF).collect():
        bare = re.sub(r"(?is)<(script|style|noscript|svg|head|template|iframe)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", " ", pages[r.page_id].html)
        want = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</?(p|div|br|li|ul|ol|tr|table|section|article|header|footer|nav|h[1-6]|dt|dd|blockquote|main|aside)\b[^>]*>|</?a\b[^>]*>", " ", bare))).split()
        assert re.sub(r"\[([^\]]*)\]\(http[^)]*\)", r" \1 ", r.inline).split() == want, r.page_id


@needs_tables
def test_bodies_against_the_ladder(spark):
    import hashlib

    pages, rows = pages_of(spark), registry.queries()["src_10_body_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        tier, body = udfs.extract_body(pages[r.page_id].html, pages[r.page_id].url)
        assert (r.tier, r.n_chars, r.body_md5) == (tier, len(body), hashlib.md5(body.encode()).hexdigest())
        whole = udfs.inline_text(pages[r.page_id].html, pages[r.page_id].url)
        assert tier != "inline" or body == whole
        assert set(body.split()) <= set(whole.split()) and (tier in ("inline", "empty") or len(body) >= udfs.BODY_CHARS)


@needs_tables
def test_blocks_hold_each_page_whole(spark):
    pages, rows = pages_of(spark), {}
    for r in registry.queries()["blk_01_html_blocks"](spark, SF).collect():
        rows.setdefault(r.page_id, []).append(r)
    for page_id, p in pages.items():
        own = sorted(rows.get(page_id, []), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(len(own)))
        tables = [r for r in own if r.type == "table"]
        extra = page_id % 3 == 0
        assert len(tables) == len(udfs.parse_tables(p.html)) + extra
        if extra:
            assert tables[-1].headers == "Year|Id" and own[-1].type == "md"


@needs_tables
def test_evidence_forms_and_line_chunks(spark):
    def norm(s):
        s = unicodedata.normalize("NFKC", s or "").translate(str.maketrans("‘’“”–— ", "''\"\"-- "))
        s = re.sub(r"\[[0-9]{1,3}\]", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s))
        s = re.sub(r"(?<=\s)-+(?=\s)|^-+\s|\s-+$", " ", re.sub(r"[*_`~#]+", " ", s))
        return re.sub(r"\s+", " ", s).strip().lower()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r.v for r in registry.queries()["txt_04_norm_evidence"](spark, SF).collect()}
    assert out == {i: norm(t) for i, t in texts.items()}
    parts = {}
    for r in registry.queries()["txt_09_line_chunks"](spark, SF).collect():
        parts.setdefault(r.doc_id, []).append((r.block, r.text))
    for i, t in texts.items():
        blocks_ = [x for _, x in sorted(parts[i])]
        whole = blocks_[0]
        for b in blocks_[1:]:
            assert whole.endswith(b[:100]) and len(b) <= 2100
            whole += b[100:]
        assert whole == t
        assert len(blocks_) >= max(1, -(-len(t) // 2000))


@needs_tables
def test_accepted_requests_against_a_loop(spark):
    want, kept = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").orderBy("event_id").collect():
        held = [t for t in kept.get(r.user_id % 10, []) if t > r.event_id - 60]
        want[r.event_id] = len(held) < 5
        kept[r.user_id % 10] = held + [r.event_id] * want[r.event_id]
    assert {r.id: r.ok for r in registry.queries()["ctl_10_accepted_requests"](spark, SF).collect()} == want
