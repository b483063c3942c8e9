"""Dates of varying granularity kept as text, and the periods they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.binding import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SHAPE = r"(?i)^(\d{4})(?:-(?:Q[1-4]|\d{2}(?:-\d{2})?))?$"
#: What ends the first date of a range.
RANGE_END = r"[~–—]|--|\b(?:to|through)\b|\s-\s"
#: A date is cut into runs of digits, unit signs, runs of letters and single other signs; spaces only part them.
TOKEN = r"\d+|[年년月월日일]|\p{L}+|[^\s\p{L}\d]"
#: In the kinds of tokens (see ``_kind``): a time of day and its zone at the end, and signs that mean nothing at either end.
TIME_OF_DAY = r"t?[nN]:N(?::N(?:\.[nNxY])?)?(?:z|[-+](?:N:?N|Y))?$"
LOOSE_SIGNS = r"^[-,.]+|[-,.]+$"


def norm_date(d: Column) -> Column:
    """Lower case, a time of day cut off."""
    t = F.lower(F.trim(F.coalesce(d, F.lit(""))))
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\dt"), F.substring_index(t, "t", 1)).otherwise(t)


def date_bucket(d: Column) -> Column:
    """The quarter of a day or month, a quarter as it is, a year as it is; other shapes verbatim."""
    t = norm_date(d)
    month = F.regexp_extract(t, r"^\d{4}-(\d\d)(?:-\d\d)?$", 1).try_cast("int")
    year = F.substring(t, 1, 4)
    quarter = F.concat(year, F.lit("-q"), F.floor((month - 1) / 3 + 1).cast("string"))
    return F.when(month.between(1, 12), quarter).when(month.isNotNull(), year).otherwise(t)


def date_precision(d: Column) -> Column:
    t = F.trim(F.coalesce(d, F.lit("")))
    return (
        F.when(t.rlike(r"^\d{4}$"), "year")
        .when(t.rlike(r"(?i)^\d{4}-Q[1-4]$"), "quarter")
        .when(t.rlike(r"^\d{4}-\d{2}$"), "month")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T.*)?$"), "day")
        .otherwise("unknown")
    )


def norm_date_shape(raw: Column, day_first: bool = False, keep_range_year: bool = False) -> Column:
    """A date as written, in one of the shapes YYYY, YYYY-Qn, YYYY-MM, YYYY-MM-DD; empty if it cannot be read.

    A range keeps its start. Of D/M and M/D the one that is possible counts, else month first unless
    ``day_first``. ``keep_range_year`` lends the start of a range the year that only its end has.

    The text is cut into tokens, each token gets a letter for its kind, and the word of these letters is looked up
    in a table of layouts. A date that has one of the shapes already is not checked further; a layout whose month or
    day is impossible gives the year, and so does any other text that holds one.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    start = F.regexp_extract(text, rf"(?is)^(.*?)\s*(?:{RANGE_END}|$)", 1)
    if keep_range_year:
        end_year = F.regexp_extract(text, r"((?:19|20)\d\d)\s*$", 1)
        lent = (_any_year(start) == "") & (F.length(start) < F.length(text)) & (end_year != "")
        start = F.when(lent, F.concat_ws(" ", start, end_year)).otherwise(start)
    return let(F.struct(start.alias("text"), F.regexp_extract_all(start, F.lit(TOKEN), 0).alias("tokens")), lambda x: _read(x["text"], x["tokens"], day_first))


def _any_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(?:19|20)\d\d", 0)


def _month(word: Column) -> Column:
    """The number of the month whose name begins with the word's three letters, as text; null if there is none."""
    at = F.position(F.concat(F.lit("."), F.lower(F.substring(word, 1, 3))), F.lit("".join(f".{m}" for m in MONTHS)))
    return F.when((F.length(word) >= 3) & (at > 0), F.lpad(F.floor((at + 3) / 4).cast("string"), 2, "0"))


def _kind(t: Column) -> Column:
    """Y, N, n: numbers of four, two and one digits, x other numbers; M a month's name; the letter of q, h, t, z and f for
    fy; the signs of year and month units count as dashes and that of day units as nothing; other signs are themselves."""
    low, n = F.lower(t), F.length(t)
    number = F.when(n == 4, "Y").when(n == 2, "N").when(n == 1, "n").otherwise("x")
    return (
        F.when(t.rlike(r"^\d+$"), number)
        .when(n.between(3, 9) & _month(t).isNotNull(), "M")
        .when(low.isin("q", "h", "t", "z"), low)
        .when(low == "fy", "f")
        .when(t.isin("年", "년", "月", "월"), "-")
        .when(t.isin("日", "일"), "")
        .when(t.rlike(r"^\p{L}"), "w")
        .otherwise(t)
    )


def _read(text: Column, tokens: Column, day_first: bool) -> Column:
    layout = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(tokens, _kind), ""), TIME_OF_DAY, ""), LOOSE_SIGNS, "")
    return let(layout, lambda x: _by_layout(x, text, tokens, day_first))


def _by_layout(layout: Column, text: Column, tokens: Column, day_first: bool) -> Column:
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    month = F.get(F.filter(F.transform(tokens, _month), lambda m: m.isNotNull()), F.lit(0))
    number = lambda k: F.lpad(F.get(numbers, F.lit(k)), 2, "0")
    year = lambda k: F.get(numbers, F.lit(k))
    below = lambda c, most: c.try_cast("int").between(1, most)
    day = lambda y, m, d: F.when(below(m, 12) & below(d, 31), F.concat_ws("-", y, m, d)).otherwise(y)
    month_leads = below(number(0), 12) & ~(F.lit(day_first) & below(number(1), 12))
    table = (
        (r"Y(-N(-N)?)?", F.array_join(F.slice(numbers, 1, F.length(F.regexp_replace(layout, "-", ""))), "-")),
        (r"Y-qn", F.when(below(number(1), 4), F.concat(year(0), F.lit("-Q"), year(1))).otherwise(year(0))),
        (r"Y[-/.][nN][-/.][nN]", day(year(0), number(1), number(2))),
        (r"[nN][-/.][nN][-/.]Y", F.when(month_leads, day(year(2), number(0), number(1))).otherwise(day(year(2), number(1), number(0)))),
        (r"M\.?[nN],?Y", day(year(1), month, number(0))),
        (r"[nN]M\.?Y", day(year(1), month, number(0))),
        (r"M\.?Y", F.concat_ws("-", year(0), month)),
        (r"Y-?hn|f-?Y|Y-?f", year(0)),
    )
    out = _any_year(text)
    for pattern, value in reversed(table):
        out = F.when(layout.rlike(f"^(?:{pattern})$"), value).otherwise(out)
    return out


def plausible_date(d: Column, now_year: int, first_year: int = 1993, ahead: int = 5) -> Column:
    """Empty, or one of the permitted shapes within the calendar window."""
    t = F.trim(F.coalesce(d, F.lit("")))
    year = F.regexp_extract(t, SHAPE, 1).try_cast("int")
    return (t == "") | F.coalesce(year.between(first_year, now_year + ahead), F.lit(False))


def period_now(d: Column, local: Column) -> Column:
    """Whether a dated period is current at a local time: this or the last quarter, this month, year or day."""
    quarter = lambda t: F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t))
    year = F.date_format(local, "yyyy")
    whole = d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(d.try_cast("date") == local.cast("date"), F.lit(False))
    return (
        (d == quarter(local)) | (d == quarter(F.add_months(local.cast("date"), -3))) | (d == F.date_format(local, "yyyy-MM")) | (d == year)
        | (d.rlike("^[0-9]{4}-(FY|H[12])$") & (F.substring(d, 1, 4) == year)) | whole
    )


def period_bounds(d: Column) -> Column:
    """(first day, last day) of the period a date names; nulls if it names none."""
    year = F.regexp_extract(d, r"^(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(d, r"(?i)^\d{4}-Q([1-4])$", 1).try_cast("int")
    half = F.regexp_extract(d, r"(?i)^\d{4}-H([12])$", 1).try_cast("int")
    month = F.regexp_extract(d, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    day = F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}(T.*)?$"), F.substring(d, 1, 10).try_cast("date"))
    first = F.when(quarter.isNotNull(), (quarter - 1) * 3 + 1).when(half.isNotNull(), (half - 1) * 6 + 1).when(month.between(1, 12), month).when(d.rlike(r"(?i)^\d{4}(-FY)?$"), F.lit(1))
    months = F.when(quarter.isNotNull(), 3).when(half.isNotNull(), 6).when(month.isNotNull(), 1).otherwise(12)
    start = F.coalesce(day, F.when(first.isNotNull(), F.make_date(year, first, F.lit(1))))
    end = F.coalesce(day, F.date_sub(F.add_months(start, months), 1))
    return F.struct(start.alias("period_start"), end.alias("period_end"))
