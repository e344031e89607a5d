"""Breakdowns by concept and party (A6-A10, W4, W5, T3, T4), all from one aggregate by type, concept and party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import exact_mean, inflow, outflow, percent_text, side
from ledgerloom.operators.summary import total
from ledgerloom.plans.taxonomy import UNKNOWN_PARTY

NO_CONCEPT = "Sin clasificar"


def names(column: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def day_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def by_concept_and_party(movements: DataFrame) -> DataFrame:
    """A7."""
    keyed = movements.select(
        side(F.col("amount")).alias("type"),
        F.coalesce("concept", F.lit(NO_CONCEPT)).alias("concept"),
        F.coalesce("party", F.lit(UNKNOWN_PARTY)).alias("party"),
        "amount", "bank", "date",
    )
    return keyed.groupBy("type", "concept", "party").agg(
        F.count("*").alias("n"), total(F.abs("amount")).alias("total"), names(F.col("bank")).alias("banks"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def by_concept(detail: DataFrame) -> DataFrame:
    """From by_concept_and_party; with the share of its type and the mean."""
    rows = detail.groupBy("type", "concept").agg(F.sum("n").alias("n"), total(F.col("total")).alias("total"))
    whole = F.sum("total").over(Window.partitionBy("type")).cast("decimal(38,2)")
    return rows.select("type", "concept", "n", "total", exact_mean(F.col("total"), F.col("n")).alias("mean"), percent_text(F.col("total"), whole).alias("share"))


def concept_order() -> tuple[Column, ...]:
    """What comes in first, then by total."""
    return F.col("type") != "INGRESO", F.desc("total"), F.col("concept")


def ordered_concepts(rows: DataFrame) -> DataFrame:
    """T3."""
    return rows.orderBy(*concept_order())


def ordered_detail(detail: DataFrame) -> DataFrame:
    """What comes in first, then by the total of the concept, then of the party."""
    of_concept = F.sum("total").over(Window.partitionBy("type", "concept")).cast("decimal(38,2)")
    return detail.withColumn("concept_total", of_concept).orderBy(F.col("type") != "INGRESO", F.desc("concept_total"), "concept", F.desc("total"), "party")


def by_party(movements: DataFrame) -> DataFrame:
    """One pass over the movements for all figures of a party."""
    rows = movements.select(F.coalesce("party", F.lit(UNKNOWN_PARTY)).alias("party"), F.coalesce("concept", F.lit(NO_CONCEPT)).alias("concept"), "amount", "bank", "date")
    grouped = rows.groupBy("party").agg(
        names(F.col("concept")).alias("concepts"), F.count("*").alias("n"), total(inflow(F.col("amount"))).alias("received"), total(outflow(F.col("amount"))).alias("paid"),
        total(F.col("amount")).alias("net"), names(F.col("bank")).alias("banks"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return grouped.withColumn("type", F.when(F.col("net") > 0, "INGRESO").otherwise("EGRESO"))


def top_parties(parties: DataFrame, n: int) -> DataFrame:
    """T4: the n with the largest net, either way."""
    return parties.orderBy(F.desc(F.abs("net")), "party").limit(n)


def with_subtotals(detail: DataFrame) -> DataFrame:
    """Parties, concept subtotals (party null) and type totals (concept null) in one listing."""
    rolled = detail.rollup("type", "concept", "party").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), total(F.col("total")).alias("total"))
    return rolled.filter("level < 7").select("type", "concept", "party", "n", "total")
