"""Scalar rules as column expressions. Missing stays null, and no division raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright import constants as C


def clean(x: Column) -> Column:
    """A finite double, or null for null, NaN, infinite and unreadable values."""
    v = x.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def positive(x: Column) -> Column:
    v = clean(x)
    return F.when(v > 0, v)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def or_else(a: Column, b: Column) -> Column:
    """``a`` unless it is null or 0."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def is_fund(quote_type: Column) -> Column:
    return F.upper(F.coalesce(quote_type, F.lit(""))).isin("ETF", "MUTUALFUND", "INDEX")


def normalise_symbol(s: Column) -> Column:
    return F.upper(F.trim(F.translate(s, ".", "-")))


def valid_symbol(s: Column) -> Column:
    return s.rlike("^[A-Z][A-Z0-9.-]{0,9}$")


def parse_date(s: Column) -> Column:
    """DD-MON-YYYY or ISO, else null."""
    return F.coalesce(F.try_to_date(F.initcap(s), "dd-MMM-yyyy"), F.try_to_date(s, "yyyy-MM-dd"))


def inverse_if_positive(x: Column) -> Column:
    return F.when(x > 0, F.lit(1.0) / F.nullif(x, F.lit(0.0)))


ebitda_yield = earnings_yield = inverse_if_positive


def fcf_yield(fcf: Column, ocf: Column, cap: Column) -> Column:
    """Free cash flow over market value; null where it exceeds operating cash flow, which cannot be."""
    return F.when(ocf.isNull() | (fcf <= ocf), over(fcf, cap))


def range_position(v: Column, low: Column, high: Column) -> Column:
    """Place of v between low and high, clamped to [0, 1]; null without a range."""
    return F.when((high > low) & (low != 0) & (high != 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), over(v - low, high - low))))


def stamp_day(stamp: Column) -> Column:
    return F.try_to_date(F.split_part(stamp, F.lit("T"), F.lit(1)), "yyyy-MM-dd")


def stamp_after_close(stamp: Column, hour: int = 16) -> Column:
    """Whether a stamp's local hour is at or after the close; dates without an hour are not."""
    return F.coalesce(F.substring(F.split_part(stamp, F.lit("T"), F.lit(2)), 1, 2).try_cast("int") >= hour, F.lit(False))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def first_friday(d: Column) -> Column:
    return F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "FRI")


def future_weekdays(d: Column, n: int) -> Column:
    """The next ``n`` weekdays after a date, holidays not modelled."""
    days = F.sequence(F.date_add(d, 1), F.date_add(d, n * 2 + 4))
    return F.slice(F.filter(days, lambda x: F.weekday(x) < 5), 1, n)


def compact_number(x: Column) -> Column:
    """1.2K, 3.4M, 5.6B, 7.8T."""
    out = F.format_number(x, 1)
    for size, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= size, F.concat(F.format_number(x / size, 1), F.lit(mark))).otherwise(out)
    return out


def compounded(mean: Column, periods: int) -> Column:
    """A mean return by period as a return over ``periods`` of them."""
    return F.pow(1 + mean, F.lit(periods)) - 1


def matches(symbol: Column, name: Column, term: str) -> Column:
    """Whether a search term, trimmed and in any case, stands in a symbol or a name; an empty term matches all."""
    term = term.strip().upper()
    return F.lit(True) if not term else F.contains(F.upper(symbol), F.lit(term)) | F.contains(F.upper(F.coalesce(name, F.lit(""))), F.lit(term))


def fixed_text(x: Column, digits: int = 2) -> Column:
    """Fixed decimals; a dash for null."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x))


def percent_text(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def compact_text(x: Column) -> Column:
    """Two decimals of billions and trillions, one of thousands and millions, none below."""
    out = F.format_string("%.0f", x)
    for size, mark, digits in ((1e3, "K", 1), (1e6, "M", 1), (1e9, "B", 2), (1e12, "T", 2)):
        out = F.when(F.abs(x) >= size, F.format_string(f"%.{digits}f{mark}", x / size)).otherwise(out)
    return F.when(x.isNull(), "-").otherwise(out)


def target_label(target: Column) -> Column:
    """The name of a macro target; of one without a name, its place and the rest in small letters."""
    known = F.create_map(*(F.lit(v) for pair in C.TARGETS.items() for v in pair))
    plain = lambda s: F.lower(F.replace(s, F.lit("_"), F.lit(" ")))
    other = plain(target)
    for code, name in reversed(C.PLACES.items()):
        other = F.when(F.startswith(target, F.lit(code)), F.concat(F.lit(name), plain(F.substring(target, len(code) + 1, 1000)))).otherwise(other)
    return F.coalesce(F.try_element_at(known, target), other)


def rank_sentence(kind: str, value: Column, percentile: Column, group: Column, n: Column, median: Column) -> Column:
    """One sentence on a ratio's place among its peers."""
    band = F.when(percentile <= 0.25, "in the cheapest quartile of").when(percentile <= 0.5, "below the median of").when(percentile <= 0.75, "above the median of").otherwise("in the most expensive quartile of")
    return F.when(percentile.isNull(), f"No comparable {kind}.").otherwise(F.format_string(f"{kind} %.1f is %s its %s peer group (n=%d, median %.1f).", value, band, group, n, median))
