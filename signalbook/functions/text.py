"""Normalising text, names, dates, money and severities."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalbook import fixed_values as fv
from signalbook.functions.values import lookup

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """NFKD form.  Plain ASCII rows stay in the JVM: only their null goes to Python."""
    return F.coalesce(_decompose(F.when(text.rlike(NON_ASCII), text)), text)


def normalize_text(text: Column) -> Column:
    """NFKD, single blanks, LF line ends, at most one empty line in a row, trimmed."""
    out = compatibility_form(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_name(name: Column, suffixes: Sequence[str] = fv.LEGAL_SUFFIXES) -> Column:
    """Lower-case ASCII name without punctuation and legal suffixes."""
    out = F.regexp_replace(compatibility_form(F.coalesce(name, F.lit(""))), NON_ASCII, "")
    out = F.regexp_replace(F.lower(out), fv.NAME_PUNCTUATION, " ")
    out = F.regexp_replace(out, r"\b(?:" + "|".join(suffixes) + r")\b", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def token_sorted(name: Column) -> Column:
    """Words in alphabetical order, so that word order does not matter."""
    return F.array_join(F.sort_array(F.split(name, r"\s+")), " ")


def normalize_date(text: Column, formats: Sequence[str] = fv.DATE_FORMATS) -> Column:
    """ISO date by the first format that parses, else null."""
    value = F.initcap(F.trim(text))
    parsed = [F.try_to_timestamp(value, F.lit(fmt)) for fmt in formats]
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd")


def normalize_currency(
    text: Column,
    symbols: Mapping[str, str] = fv.CURRENCY_SYMBOLS,
    codes: Sequence[str] = fv.CURRENCY_CODES,
    default: str = "USD",
) -> Column:
    """Struct of amount and currency code; null when no number can be read."""
    found = [F.when(F.contains(F.upper(text), F.lit(c)), F.lit(c)) for c in codes]
    found += [F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in symbols.items()]
    amount = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
    currency = F.coalesce(*found, F.lit(default))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def normalize_severity(
    text: Column, synonyms: Mapping[str, str] = fv.SEVERITY_SYNONYMS, default: str = "medium"
) -> Column:
    """One of the four levels; unknown words become the default."""
    table = {level: level for level in fv.SEVERITY_LEVELS} | dict(synonyms)
    return lookup(table, F.trim(F.lower(text)), default)


def expand_abbreviations(text: Column, table: Mapping[str, str] = fv.ABBREVIATIONS) -> Column:
    """Replace whole words found in the table."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    words = F.split(text, " ")
    return F.array_join(
        F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w)), " "
    )


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


# Workers get these functions whole and need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
