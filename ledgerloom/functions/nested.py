"""JSON, map and nested-array functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps' entries; the new value where both have a key. A null map is empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def salvage_json(reply: Column) -> Column:
    """The reply if it is a JSON object, else what stands between its first { and last } if that is one, else {}."""
    whole = F.trim(reply)
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    valid = lambda c: c.startswith("{") & F.try_parse_json(c).isNotNull()
    return F.when(valid(whole), whole).when(valid(inner), inner).otherwise("{}")


def normal_hub(element: Column) -> Column:
    """A hub given as a JSON string or object, as one struct; anything else has null fields."""
    text = F.when(element.startswith('"'), F.get_json_object(F.concat(F.lit("["), element, F.lit("]")), "$[0]"))
    fields = F.from_json(F.when(element.startswith("{"), element), "url string, kind string")
    url = F.coalesce(text, fields["url"])
    return F.struct(url.alias("url"), F.when(url.isNotNull(), F.coalesce(fields["kind"], F.lit("unknown"))).alias("kind"))


def numeric_density(rows: Column) -> Column:
    """Share of numeric cells among the cells that are not empty; null without any."""
    cells = F.filter(F.flatten(rows), lambda c: F.trim(c) != "")
    numeric = F.filter(cells, lambda c: F.trim(c).rlike(r"^[\s$€£(+-]*[0-9][0-9,.]*[%)]?$"))
    return F.try_divide(F.size(numeric), F.size(cells))


def table_kind(html: Column, n_rows: Column, n_cols: Column) -> Column:
    """data or layout: by role, forms and nesting, size, header markup, then size again."""
    cells = n_rows * n_cols
    return (
        F.when(html.rlike(r"""(?i)role\s*=\s*["']presentation"""), "layout")
        .when(html.rlike(r"(?i)<(form|input|select|textarea|iframe|object|embed)\b") | (F.regexp_count(html, F.lit(r"(?i)<table\b")) > 1), "layout")
        .when((n_rows <= 1) | (n_cols <= 1) | (cells <= 10), "layout")
        .when(html.rlike(r"""(?i)<(th|thead|caption|col|colgroup)\b|\b(scope|headers|abbr|summary)\s*=|role\s*=\s*["']table|aria-(col|row)count"""), "data")
        .when((n_cols >= 5) | (n_rows >= 20), "data")
        .otherwise("layout")
    )
