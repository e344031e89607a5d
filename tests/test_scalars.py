from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def column(spark, values, kind, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_amounts(spark):
    cases = {
        "1.234.567,89": "1234567.89", "1,234,567.89": "1234567.89", "2.300.000,00-": "-2300000.00", "(45.000,50)": "-45000.50", "$ 50.000": "50000.00",
        "50.000 DB": "-50000.00", "1.500": "1500.00", "12,50": "12.50", "no es plata": None, "0.500": "500.00", "1.2345": "12345.00", "": None, "-1.234": "-1234.00", "1.234,56 CR": "1234.56",
    }
    found = column(spark, [*cases, None], "string", money.parse_amount)
    assert found == [None if v is None else Decimal(v) for v in cases.values()] + [None]


def test_amount_text(spark):
    assert column(spark, [Decimal("-1234567.89"), Decimal("0.00"), None], "decimal(18,2)", money.format_amount) == ["-1.234.567,89", "0,00", ""]
    assert column(spark, ["-5", "5-", "(5)", "5 DB", "5"], "string", money.marked_negative) == [True, True, True, True, False]


def test_mean_is_half_even_of_the_exact_quotient(spark):
    rows = spark.createDataFrame([(Decimal("0.05"), 2), (Decimal("0.15"), 2), (Decimal("10.00"), 3), (Decimal("0.01"), 3)], "t decimal(38,2), n long")
    assert [str(r[0]) for r in rows.select(money.exact_mean(F.col("t"), F.col("n"))).collect()] == ["0.02", "0.08", "3.33", "0.00"]


def test_dates(spark):
    cases = {
        "01/03/2025": date(2025, 3, 1), "2025-03-01": date(2025, 3, 1), "12 de marzo de 2025": date(2025, 3, 12), "15-ABR-2025": date(2025, 4, 15), "01/03": date(2025, 3, 1),
        "31/02/2025": None, "01/03/79": date(2079, 3, 1), "01/03/81": date(1981, 3, 1), "12/25/2024": date(2024, 12, 25), "Julio 31": date(2025, 7, 31), "nada": None, "": None,
    }
    assert column(spark, list(cases), "string", lambda c: dates.parse_date(c, F.lit(2025))) == list(cases.values())
    found = spark.createDataFrame([("x 01/03/2025 y",)], "v string").select(dates.find_date(F.col("v"), F.lit(None).cast("int"))["end"]).first()[0]
    assert found == 12


def test_year_rollover(spark):
    rows = spark.createDataFrame([(date(2025, 12, 28),), (date(2025, 1, 3),), (date(2024, 2, 29),)], "d date")
    low, high = F.lit(date(2024, 12, 15)), F.lit(date(2025, 1, 14))
    assert [r[0] for r in rows.select(dates.in_period(F.col("d"), low, high)).collect()] == [date(2024, 12, 28), date(2025, 1, 3), date(2024, 2, 29)]


def test_user_ranges():
    assert dates.date_range(month="2025-02") == (date(2025, 2, 1), date(2025, 2, 28))
    assert dates.date_range(start="2025", end="2025-04") == (date(2025, 1, 1), date(2025, 4, 30))
    assert dates.date_range(year=2024, start="2020-01-01") == (date(2024, 1, 1), date(2024, 12, 31))
    assert [dates.month_from_text(t) for t in ("2025-3", "03/2025", "marzo de 2025", "x")] == ["2025-03", "2025-03", "2025-03", None]
    with pytest.raises(ValueError):
        dates.date_range(start="2025-02-01", end="2025-01-01")


def test_text(spark):
    assert column(spark, ["  Consignación  ñandú ", "ﬁn ½", None], "string", text.canon) == ["CONSIGNACION NANDU", "FIN 1⁄2", ""]
    assert column(spark, ["Servi Equipos S.A.S.", "CIA. ROJA LTDA"], "string", text.party_key) == ["SERVI EQUIPOS S A S", "ROJA"]
    assert column(spark, ["Banco de Bogotá", "extracto marzo.pdf", "  "], "string", text.file_label) == ["Banco_de_Bogota", "extracto_marzo", "sin_nombre"]
    assert column(spark, ["2025-03", "otro"], "string", dates.month_label) == ["Marzo 2025", "otro"]
