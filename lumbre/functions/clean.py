"""Cleaning of identifiers, dates, figures and codes as column expressions.

Whatever cannot be read becomes null, never a false zero; nothing raises under
ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transaction codes of ownership forms.
TX_CODES = ("P", "S", "A", "M", "F", "G", "X", "D", "C", "E", "H", "I", "J", "K", "L", "O", "U", "V", "W", "Z")
#: Texts that stand for nothing.
EMPTY = ("nan", "nat", "none", "")
MAX_LONG = 9223372036854775807


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cik(x: str | Column) -> Column:
    """Ten digits from what is left of the first point; null if none or too many."""
    digits = F.regexp_replace(F.split_part(F.trim(_c(x).cast("string")), F.lit("."), F.lit(1)), "[^0-9]", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def flexible_date(x: str | Column) -> Column:
    """First of ISO, 15-MAR-2023, 03/15/2023 and ISO with a time that reads the text."""
    s = F.trim(_c(x).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(p)).cast("date") for p in ("yyyy-M-d", "d-MMM-yyyy", "M/d/yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")]
    return F.when(~F.lower(s).isin(*EMPTY), F.coalesce(*tries))


def transaction_date(x: str | Column, filed: str | Column, as_of: Column) -> Column:
    """The date unless it is after ``as_of``, before 2009 or after a known filing date."""
    d, f = _c(x), _c(filed)
    return F.when((d <= as_of) & (F.year(d) >= 2009) & (f.isNull() | (d <= f)), d)


def _number(x: str | Column) -> Column:
    v = _c(x).cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def price(x: str | Column) -> Column:
    v = _number(x)
    return F.when((v > 0) & (v <= 1e6), v)


def shares(x: str | Column) -> Column:
    """Whole shares without sign; zero and more than 1e14 are null, fractions below one are 0."""
    v = F.abs(_number(x))
    return F.when((v != 0) & (v <= 1e14), v.cast("long"))


def amount(n: str | Column, p: str | Column) -> Column:
    """Shares times price in cents, halves away from zero; null above 1e14."""
    v = F.round(_c(n).cast("decimal(20,0)") * _c(p).cast("decimal(17,6)"), 2)
    return F.when(F.abs(v) <= F.lit(10**14).cast("decimal(20,0)"), v)


def tx_code(x: str | Column) -> Column:
    v = F.upper(F.trim(_c(x).cast("string")))
    return F.when(v.isin(*TX_CODES), v)


def bounded_long(x: str | Column) -> Column:
    v = _number(x)
    return F.when(F.abs(v) < float(MAX_LONG), v.try_cast("long"))


def bounded_decimal(x: str | Column, limit: float, scale: int) -> Column:
    v = _number(x)
    return F.when(F.abs(v) <= limit, F.round(v, scale))


def text_or_null(x: str | Column) -> Column:
    v = F.trim(_c(x).cast("string"))
    return F.when(~F.lower(v).isin(*EMPTY), v)


def acquired_or_disposed(x: str | Column) -> Column:
    return F.when(_c(x).isin("A", "D"), _c(x))


def calendar_quarter(d: str | Column) -> Column:
    return F.struct(F.year(_c(d)).alias("year"), F.quarter(_c(d)).alias("quarter"))


def quarter_index(year: str | Column, quarter: str | Column) -> Column:
    """Position of a quarter: neighbours differ by one."""
    return _c(year) * 4 + _c(quarter) - 1


def item_list(x: str | Column) -> Column:
    """Items of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def period_days(start: str | Column, end: str | Column) -> Column:
    return F.datediff(F.try_to_timestamp(_c(end).cast("string"), F.lit("yyyy-M-d")).cast("date"), F.try_to_timestamp(_c(start).cast("string"), F.lit("yyyy-M-d")).cast("date"))


def is_quarterly(start: str | Column, end: str | Column) -> Column:
    return F.coalesce(period_days(start, end).between(80, 100), F.lit(False))


def months_between_calendar(later: Column, earlier: Column) -> Column:
    """Difference of calendar months, whatever the days."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def accepted(x: str | Column, accept: tuple[str, ...], reject: tuple[str, ...]) -> Column:
    """Whether a text holds one of ``accept`` and none of ``reject``, in any case; a null or
    empty text is not accepted."""
    t = F.upper(_c(x))
    has = lambda words: F.exists(F.array(*[F.lit(w.upper()) for w in words]), lambda w: F.contains(t, w))
    return F.coalesce(has(accept) & ~has(reject), F.lit(False))


def shelf_form(x: str | Column) -> Column:
    """Whether a form registers shares for later sale; null is none."""
    return F.coalesce(F.upper(F.trim(_c(x))).rlike("^(S-3|424B)"), F.lit(False))


def is_stale(seen: str | Column, value: str | Column, now: Column, hours: int) -> Column:
    """Whether a value is missing or was last seen more than ``hours`` before ``now``."""
    return _c(value).isNull() | F.coalesce(_c(seen) < now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))
