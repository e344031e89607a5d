"""Filters on movements (F1-F4): the range of days pushes down to the scan; the others compare canonical text."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import canon, digits


def in_days(df: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") <= F.lit(end))
    return df


def of_banks(df: DataFrame, banks: Iterable[str]) -> DataFrame:
    return df.filter(canon(F.col("bank")).isin([canon_text(b) for b in banks]))


def of_account(df: DataFrame, number: str) -> DataFrame:
    own = "".join(c for c in number if c.isdigit())
    return df.filter(F.contains(digits(F.col("account")), F.lit(own)))


def with_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.contains(canon(F.col("description")), F.lit(canon_text(text))))


def canon_text(text: str) -> str:
    """canon() for a parameter on the driver."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.split()).upper()


def filtered(df: DataFrame, start: date | None = None, end: date | None = None, banks: Iterable[str] = (), account: str | None = None, text: str | None = None) -> DataFrame:
    """Checks of balances hold for whole months only: a text filter, or half a month, leaves declared balances as they are."""
    df = in_days(df, start, end)
    df = of_banks(df, banks) if banks else df
    df = of_account(df, account) if account else df
    return with_text(df, text) if text else df


