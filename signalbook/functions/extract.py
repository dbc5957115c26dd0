"""Facts read from text by pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import strip
from signalbook.functions.values import blank_to_null, first_items, once


#: What a match of a costly pattern begins with: a place where it cannot begin is passed over by one look.
BEGINNINGS = {
    fv.TEXT_DATE_PATTERNS[2]: "[JFMASOND]",
    fv.MONEY_PATTERN: r"[UEGI$£€\s\d,]",
    fv.STRICT_MONEY_PATTERN: r"[UEGI$£€\s\d]",
}


def _looked(pattern: str) -> str:
    """The pattern with a look at its first character, under the pattern's own flags."""
    if pattern not in BEGINNINGS:
        return pattern
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?={BEGINNINGS[pattern]}){pattern[len(flags):]}"


def _by_script(text: Column, pattern: str, search: Callable[[str], Column]) -> Column:
    """Search with classes for all scripts, or with the faster ASCII ones when the
    text is plain ASCII (as many bytes as characters), where both agree."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, search(pattern)).otherwise(search("(?U)" + pattern))


def matched_group(text: Column, pattern: str, group: int) -> Column:
    """Group of the first match, empty if there is none."""
    return _by_script(text, pattern, lambda p: F.regexp_extract(text, p, group))


def first_match(text: Column, pattern: str, group: int) -> Column:
    return blank_to_null(matched_group(text, pattern, group))


def all_matches(text: Column, pattern: str) -> Column:
    return _by_script(text, _looked(pattern), lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def customer_name(text: Column) -> Column:
    """Name after a customer word, else after a from/by/re word; 3 to 99 characters."""
    options = []
    for pattern, group in zip(fv.CUSTOMER_PATTERNS, (2, 1)):
        name = F.regexp_replace(strip(matched_group(text, pattern, group)), r"[.,]+$", "")
        options.append(once(name, lambda n: F.when(F.length(n).between(3, 99), n)))
    return F.coalesce(*options)


def dates(text: Column, keep: int | None = None) -> Column:
    """Distinct date-like strings in order of pattern, then of position."""
    found = F.concat(*[all_matches(text, p) for p in fv.TEXT_DATE_PATTERNS])
    return first_items(F.array_distinct(found), keep)


def money(text: Column, keep: int | None = None, strict: bool = False) -> Column:
    """Money-like strings; ``strict`` asks for a digit and a word edge."""
    pattern = fv.STRICT_MONEY_PATTERN if strict else fv.MONEY_PATTERN
    return first_items(all_matches(text, pattern), keep)


def ticket_number(text: Column) -> Column:
    return first_match(text, fv.TICKET_PATTERN, 1)


def email(text: Column) -> Column:
    """First e-mail address; texts without an @ are not searched."""
    return F.when(F.contains(text, F.lit("@")), first_match(text, fv.EMAIL_PATTERN, 0))


def incident_number(text: Column) -> Column:
    return first_match(text, fv.INCIDENT_PATTERN, 1)


def downtime_minutes(text: Column) -> Column:
    """Minutes of outage; hours are converted."""
    amount = matched_group(text, fv.DOWNTIME_PATTERN, 1).try_cast("bigint")
    matched = F.lower(matched_group(text, fv.DOWNTIME_PATTERN, 0))
    return amount * F.when(F.contains(matched, F.lit("hour")), 60).otherwise(1)


def contract_number(text: Column) -> Column:
    return first_match(text, fv.CONTRACT_PATTERN, 1)


def key_phrases(text: Column, keep: int | None = None) -> Column:
    """Distinct pairs of capitalised words in order of appearance."""
    return first_items(F.array_distinct(all_matches(text, fv.KEY_PHRASE_PATTERN)), keep)


def summary(text: Column, length: int = 300) -> Column:
    """Head of the text on one line, with an ellipsis if there is more."""
    head = F.translate(strip(F.substring(text, 1, length)), "\n", " ")
    return F.concat(head, F.when(F.length(text) > length, "...").otherwise(""))

