"""Dates as printed on documents. Every clock is a parameter, so results repeat."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossier.functions.text import _c, squeeze

_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_ISO = r"^\d{4}-\d{2}-\d{2}$"
_DAY_FIRST = rf"^{_DAY}([/.-]?){_MONTH}\2(\d{{4}})$"
_YEAR_FIRST = rf"^(\d{{4}})-{_MONTH}-{_DAY}$"
_WORDED = rf"(?i)^{_DAY} ([a-z]+) (\d{{4}})$"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july",
           "august", "september", "october", "november", "december")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def parse_date(col: Column | str) -> Column:
    """Day-first, ISO or worded date; anything else is null. Plain ISO and day-first texts take the short way."""
    col = _c(col)
    text = F.regexp_replace(squeeze(col), "^[:.;,]+|[:.;,]+$", "")
    word = F.lower(F.regexp_extract(text, _WORDED, 2))
    known = {form: str(n) for n, name in enumerate(_MONTHS, 1) for form in (name, name[:3])}
    number = F.try_element_at(F.create_map(*[F.lit(part) for item in known.items() for part in item]), word)
    return (
        F.when(col.rlike(_ISO), col.try_cast("date"))
        .when(col.rlike(_DAY_FIRST), F.regexp_replace(col, _DAY_FIRST, "$4-$3-$1").try_cast("date"))
        .when(text.rlike(_DAY_FIRST), F.regexp_replace(text, _DAY_FIRST, "$4-$3-$1").try_cast("date"))
        .when(text.rlike(_YEAR_FIRST), text.try_cast("date"))
        .when(text.rlike(_WORDED), _iso(F.regexp_extract(text, _WORDED, 3), number,
                                        F.regexp_extract(text, _WORDED, 1)))
    )


def date_text(col: Column | str) -> Column:
    """The parsed date as ISO text."""
    return parse_date(col).cast("string")


def iso_date(col: Column | str) -> Column:
    """An ISO date and nothing else."""
    col = _c(col)
    return F.when(col.rlike(_ISO), col.try_cast("date"))


def age_at(born: Column, on: Column) -> Column:
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - before.cast("int")


def short_date(col: Column | str, as_of: Column, kind: str = "dob") -> Column:
    """Two-digit-year date in the last century that ends with this year (births) or 50 years on (expiries)."""
    col = _c(col)
    year = F.substring(col, 1, 2).try_cast("int")
    latest = F.year(as_of) + F.lit(0 if kind == "dob" else 50)
    full = latest - F.pmod(latest - year, F.lit(100))
    return F.when(col.rlike(r"^\d{6}$"),
                  _iso(full.cast("string"), F.substring(col, 3, 2), F.substring(col, 5, 2)))
