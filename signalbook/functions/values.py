"""Small value helpers shared by every operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_up(value: Column, places: int) -> Column:
    """Round half away from zero on the decimal value (not on the binary double)."""
    return F.round(value.cast("decimal(28,10)"), places).cast("double")


def half_even_text(value: Column) -> Column:
    """Whole number as text, ties to even, no separators."""
    return F.bround(value.cast("decimal(28,10)"), 0).cast("bigint").cast("string")


def grouped_text(value: Column) -> Column:
    """Whole number as text with thousands separators, ties to even."""
    return F.format_number(F.bround(value.cast("decimal(28,10)"), 0), 0)


def fixed_text(value: Column, places: int) -> Column:
    """Number as text with a fixed count of decimals, half up."""
    return F.round(value.cast("decimal(28,10)"), places).cast(f"decimal(28,{places})").cast("string")


def money(value: Column) -> Column:
    """Exact type for summing money."""
    return value.cast("decimal(18,2)")


def instant(at: dt.datetime | str | Column) -> Column:
    """A fixed point in time; the library never reads the clock."""
    if isinstance(at, Column):
        return at
    text = at.isoformat(sep=" ") if isinstance(at, dt.datetime) else str(at)
    return F.lit(text).cast("timestamp_ntz")


def days_before(at: Column, days: int) -> Column:
    return at - F.make_dt_interval(days=F.lit(days))


def blank_to_null(value: Column) -> Column:
    return once(value, lambda v: F.when(v != "", v))


def lookup(table: Mapping[str, object], key: Column, default) -> Column:
    """Value of a small fixed table, as a literal map inside the plan."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first letter, also after digits and punctuation."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def first_items(items: Column, keep: int | None) -> Column:
    """The first ``keep`` items, or all."""
    return items if keep is None else F.slice(items, 1, keep)


def stable_id(*parts: Column) -> Column:
    """Same business key, same id, on every run.

    Each part goes in with its length, a null as a mark, so different keys never read alike.
    """
    texts = [part.cast("string") for part in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat_ws("|", *marked))
