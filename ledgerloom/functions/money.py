"""Money as Column expressions: amounts are DECIMAL(18,2), rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import canon

MONEY = "decimal(18,2)"
TOLERANCE = 0.02
MARKS = r"(?i)\b(?:COP|COL\$|CR|DB|CT|DT|DEBITO|CREDITO)\b"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def parse_amount(text: Column) -> Column:
    """The amount a text states in either separator style, or null.

    Negative by a minus before or after, parentheses, or a DB, DT or DEBITO at the end. With both
    separators the last is the decimal one; a single one is decimal if one or two digits follow it.
    """
    plain = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.trim(F.translate(F.regexp_replace(plain, MARKS, ""), " $()", " "))
    minus = bare.startswith("-") | bare.endswith("-") | (F.contains(plain, F.lit("(")) & F.contains(plain, F.lit(")"))) | canon(plain).rlike(r"\b(?:DB|DT|DEBITO)$")
    number = F.regexp_replace(F.regexp_replace(bare, r"^[+\- ]+|[+\- ]+$", ""), r"[\s']", "")
    both = F.contains(number, F.lit(".")) & F.contains(number, F.lit(","))
    decimal = both | number.rlike(r"^\d*[.,]\d{1,2}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_extract(number, r"^(.*)[.,][^.,]*$", 1)).otherwise(number), "[.,]", "")
    part = F.when(decimal, F.regexp_extract(number, r"[.,]([^.,]*)$", 1)).otherwise("")
    value = F.bround(F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part)).try_cast("decimal(30,10)"), 2)
    valid = number.rlike(r"^[\d.,]*\d[\d.,]*$")
    return F.when(valid, F.when(minus, -value).otherwise(value)).try_cast(MONEY)


def marked_negative(text: Column) -> Column:
    """The text itself says that the amount goes out."""
    bare = F.trim(F.replace(F.trim(F.regexp_replace(text, r"(?i)\b(?:COP|COL\$|CR|DB|CT|DT)\b", "")), F.lit("$"), F.lit("")))
    return (F.contains(text, F.lit("(")) & F.contains(text, F.lit(")"))) | canon(text).rlike("(?:DB|DT)$") | bare.startswith("-") | bare.endswith("-")


def format_amount(value: Column) -> Column:
    """-1.234.567,89; empty for null."""
    return F.coalesce(F.translate(F.format_number(value, 2), ",.", ".,"), F.lit(""))


def percent_text(part: Column, whole: Column) -> Column:
    """83,4% with one decimal; 0,0% of nothing."""
    share = F.when(whole == 0, F.lit(0).cast("decimal(20,1)")).otherwise(F.bround(part.cast("decimal(38,6)") * 100 / whole.cast("decimal(38,2)"), 1).cast("decimal(20,1)"))
    return F.concat(F.translate(F.format_number(share, 1), ",.", ".,"), F.lit("%"))


def exact_mean(total: Column, count: Column) -> Column:
    """total / count in cents, half to even of the exact quotient."""
    cents = (total * 100).cast("decimal(38,0)")
    n = count.cast("decimal(20,0)")
    low = F.floor(cents / n).cast("decimal(38,0)")
    # The quotient is rounded to few digits; the remainder, exact, corrects it.
    low = F.when(low * n > cents, low - 1).when(cents - low * n >= n, low + 1).otherwise(low)
    rest = (cents - low * n) * 2
    up = (rest > n) | ((rest == n) & (F.pmod(low, F.lit(2)) == 1))
    return ((low + up.cast("int")).cast("decimal(38,2)") / 100).cast(MONEY)


def inflow(amount: Column) -> Column:
    return F.greatest(amount, F.lit(0)).cast(MONEY)


def outflow(amount: Column) -> Column:
    return F.greatest(-amount, F.lit(0)).cast(MONEY)


def direction(amount: Column) -> Column:
    return F.when(amount > 0, "INGRESO").when(amount < 0, "EGRESO").otherwise("NEUTRO")


def side(amount: Column) -> Column:
    """The side of a breakdown: zero counts as going out."""
    return F.when(amount > 0, "INGRESO").otherwise("EGRESO")
