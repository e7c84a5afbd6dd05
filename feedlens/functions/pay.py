"""Pay scalars. A pay is struct<min, max, currency, period>; its fields may be null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import dictionaries as D
from feedlens.functions.text import has_any

PER_YEAR = {"hour": 2080.0, "day": 260.0, "week": 52.0, "month": 12.0, "year": 1.0}
LEAST, MOST = 10_000.0, 2_000_000.0
UNITS = {"hour": "/hr", "day": "/day", "week": "/wk", "month": "/mo", "year": "/yr"}
AMOUNT = r"(?i)([$€£]?)\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(k\b)?"


def annual_equivalent(low: Column, high: Column, period: Column) -> Column:
    """The midpoint over a year, null without bounds or outside 10,000 to 2,000,000."""
    value = F.coalesce((low + high) / 2, low, high)
    factor = F.when(F.lit(False), F.lit(1.0))
    for name, n in PER_YEAR.items():
        factor = factor.when(period == name, F.lit(n))
    factor = factor.when(value < 1000, F.lit(PER_YEAR["hour"])).otherwise(F.lit(1.0))
    year = value * factor
    return F.when(year.between(LEAST, MOST), year)


def normalize_period(raw: Column) -> Column:
    s = F.lower(raw)
    return (
        F.when(s.contains("hour") | (s == "hr") | s.contains("/h"), "hour")
        .when(has_any(s, ["day", "daily", "diem"]), "day")
        .when(s.contains("week"), "week")
        .when(s.contains("mo"), "month")
        .when(has_any(s, ["year", "annual", "annum", "yr"]), "year")
    )


def currency_of(text: Column) -> Column:
    upper = F.upper(text)
    out = F.when(F.lit(False), F.lit(""))
    for code in D.CURRENCY_CODES:
        out = out.when(upper.contains(code), F.lit(code))
    return out.when(text.contains("£"), F.lit("GBP")).when(text.contains("€"), F.lit("EUR")).when(text.contains("$"), F.lit("USD"))


def pay_parse(text: Column) -> Column:
    """A pay read from prose: only where the text speaks of money, from its first four amounts that look like money."""
    speaks = text.contains("$") | text.contains("€") | text.contains("£") | has_any(F.lower(text), D.MONEY_WORDS)
    pieces = [F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(k)) for k in (1, 2, 3)]
    found = F.arrays_zip(*(p.alias(n) for p, n in zip(pieces, ("sign", "digits", "k"), strict=True)))
    money = F.filter(found, lambda a: (a["sign"] != "") | a["digits"].contains(",") | (F.coalesce(a["k"], F.lit("")) != ""))
    value = lambda a: F.replace(a["digits"], F.lit(","), F.lit("")).cast("double") * F.when(F.coalesce(a["k"], F.lit("")) != "", 1000.0).otherwise(1.0)
    amounts = F.filter(F.transform(F.slice(money, 1, 4), value), lambda x: x > 0)

    def build(read: Column) -> Column:
        first, second = F.get(read["amounts"], F.lit(0)), F.get(read["amounts"], F.lit(1))
        high = F.when(second >= first, second)
        fine = first.isNotNull() & annual_equivalent(first, high, read["period"]).isNotNull()
        return F.when(fine, F.struct(first.alias("min"), high.alias("max"), read["currency"].alias("currency"), read["period"].alias("period")))

    # one array element binds what is read from the text, so that it is computed once
    read = F.array(F.struct(amounts.alias("amounts"), normalize_period(text).alias("period"), currency_of(text).alias("currency")))
    return F.when(speaks, F.get(F.transform(read, build), F.lit(0)))


def pay_from_parts(low: Column, high: Column, currency: Column, period: Column) -> Column:
    low, high = F.when(low > 0, low), F.when(high > 0, high)
    unit = normalize_period(period)
    fine = annual_equivalent(low, high, unit).isNotNull()
    return F.when(fine, F.struct(low.alias("min"), high.alias("max"), currency.alias("currency"), unit.alias("period")))


def _money(v: Column) -> Column:
    return (
        F.when(v >= 10_000, F.concat(F.round(v / 1000).cast("long").cast("string"), F.lit("k")))
        .when(v == F.floor(v), v.cast("long").cast("string"))
        .otherwise(F.format_string("%.2f", v))
    )


def format_pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """As on a card, such as $85k–$110k/yr CAD; null without bounds."""
    code = F.coalesce(currency, F.lit("USD"))
    sign = F.when(code == "GBP", "£").when(code == "EUR", "€").otherwise("$")
    unit = F.lit("")
    for name, label in UNITS.items():
        unit = F.when(period == name, F.lit(label)).otherwise(unit)
    both = low.isNotNull() & high.isNotNull() & (low != high)
    body = F.when(both, F.concat(sign, _money(low), F.lit("–"), sign, _money(high))).otherwise(F.concat(sign, _money(F.coalesce(low, high))))
    shown = F.concat(body, unit, F.when(code == "CAD", F.lit(" CAD")).otherwise(F.lit("")))
    return F.when(F.coalesce(low, high).isNotNull(), shown)


def lenient_number(raw: Column) -> Column:
    """A number or a numeric string with group separators, else null."""
    return F.regexp_replace(F.trim(raw), ",", "").try_cast("double")


def pay_score(annual: Column) -> Column:
    """0 at 60,000 and below, 1 at 200,000 and above, 0 where undisclosed."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (annual - 60_000.0) / 140_000.0)), F.lit(0.0))
