"""Queries give a row for each row of their whole tables."""

import os
import re
import unicodedata

import duckdb
import pytest

from ledgerloom import registry
from ledgerloom.functions import urls
from ledgerloom.plans.domain import TABLES

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) if not isinstance(v, (str, type(None))) else v for v in r) for r in rows), key=repr)


#: Query, and how many rows (or what sum of its n) the whole table must give; none if the SQL alone tells.
WHOLE = [
    ("win_10_column_islands", "sum(n)", "SELECT count(*) FROM lineitem"),
    ("ctl_08_host_pacing", "count(*)", "SELECT count(*) FROM orders"),
    ("ups_09_fenced_completion", "count(*)", "SELECT count(*) FROM orders"),
    ("jon_13_tuple_in", "count(*)", "SELECT count(*) FROM orders WHERE o_orderkey % 7 = o_orderkey % 5"),
    ("ctl_07_hill_climb", "count(*)", "SELECT count(DISTINCT user_id) FROM events"),
    ("txt_25_suppress_repeated_blocks", "count(*)", "SELECT count(*) FROM conversations"),
    ("src_06_trace_tree", "count(*)", "SELECT count(*) FROM customer"),
]


@pytest.mark.parametrize(("name", "figure", "want"), WHOLE)
def test_whole_tables(spark, duck, name, figure, want):
    out = QUERIES[name](spark, SF).cache()
    assert out.selectExpr(figure).first()[0] == duck.execute(want).fetchone()[0]
    if name in SQL:
        rows = duck.execute(SQL[name])
        columns = [c[0] for c in rows.description]
        assert plain(out.select(*columns).collect()) == plain(rows.fetchall())
    out.unpersist()


def test_hill_climb_against_a_loop(spark, duck):
    want = {}
    for run, rate in duck.execute("SELECT user_id, (event_id % 7 + 1)::DOUBLE FROM events ORDER BY user_id, event_id").fetchall():
        ewma, best, limit, step, bad = want.get(run, (None, 0.0, 18, 2, 0))
        ewma = rate if ewma is None else 0.3 * rate + 0.7 * ewma
        bad = bad + 1 if ewma < best * 0.95 else 0
        turn = bad >= 4
        step = -step if turn else step
        if ewma > best * 1.05 or turn:
            limit = max(min(limit + step, 64), 4)
        want[run] = ewma, max(best * 0.98, ewma), limit, step, 0 if turn else bad
    out = {r.company_id: r["limit"] for r in QUERIES["ctl_07_hill_climb"](spark, SF).collect()}
    assert out == {run: s[2] for run, s in want.items()}


def raw_events(duck):
    rows = duck.execute(f"SELECT event_id, event_date, event_type, title, media FROM ({TABLES['disc_events'][1]})").fetchall()
    assert {r[0] % 6 for r in rows} == set(range(6))
    return rows


def test_normalised_events_of_every_shape(spark, duck):
    def clean(u):
        m = re.match(r"\[[^\]]*\]\((https?://[^)\s]+)\)", u.strip())
        return m.group(1) if m else u.strip()

    want = {}
    for i, date, kind, title, media in raw_events(duck):
        own = list(dict.fromkeys(u for u in map(clean, media.split("|")) if u.startswith("http") and not re.search(urls.NON_EVENT, u) and not re.search(urls.TRACKER, u)))
        read = {5: "2024", 6: "2024", 11: (date or "")[:10]}.get(i % 12, date or "")
        reason = "no_identity" if not own and not ((date or "").strip() and title) else "implausible_date" if read and not 1993 <= int(read[:4]) <= 2025 else None
        kind = kind.strip().lower()
        want[i] = read, kind if kind in ("earnings", "press_release", "webcast") else "other", reason, " ".join(own)
    out = {r.event_id: (r.event_date, r.event_type, r.drop_reason, r.urls) for r in QUERIES["nrm_01_03_normalise_events"](spark, SF).collect()}
    assert out == want


def test_first_address_of_every_event(spark, duck):
    out = {r.event_id: r["first"] for r in QUERIES["ups_20_ordered_dedup"](spark, SF).collect()}
    assert out == {r[0]: r[4].split("|")[0] or None for r in raw_events(duck)}


def test_evidence_in_every_body(spark, tmp_path):
    def norm(s):
        s = unicodedata.normalize("NFKC", s or "").translate(str.maketrans("\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "))
        s = re.sub(r"\[[0-9]{1,3}\]", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s))
        s = re.sub(r"(?<=\s)-+(?=\s)|^-+\s|\s-+$", " ", re.sub(r"[*_`~#]+", " ", s))
        return re.sub(r"\s+", " ", s).strip().lower()

    shapes = ["- “Revenue” was **up** 5 % [1] in well-known markets — see [the report](https://x.example.com/a_b) for ‘more’ ~ # of it all", "ﬁne ＡＢＣ １２３ half-year – figures " * 4, "plain words " * 20, "", None]
    rows = [(i, (s and f"{i} {s}")) for i, s in enumerate(shapes * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), SF):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        out = {r.doc_id: r.grounded for r in QUERIES["jon_19_evidence_in_body"](spark, folder).collect()}
        assert out == {i: norm((t or "")[39:99]) in norm(t) for i, t in texts.items()}
