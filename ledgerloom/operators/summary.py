"""Monthly summaries and totals.

The movements are aggregated once, with partial sums and min_by/max_by for first and last balances;
windows run on months only, so large accounts and the handful of banks never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_key, month_label
from ledgerloom.functions.money import MONEY, TOLERANCE, format_amount, inflow, outflow

SUM = "decimal(38,2)"
CONSOLIDATED = "CONSOLIDADO"


def total(value: Column) -> Column:
    return F.sum(value).cast(SUM)


def account_key() -> Column:
    return F.coalesce(F.col("account"), F.lit(""))


def declared_balances(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opening balances by the month a statement begins, closing ones by that in which it ends; the first statement wins."""

    def of(balance: str, day: str, name: str) -> DataFrame:
        known = statements.filter(F.col(balance).isNotNull() & F.col(day).isNotNull())
        return known.groupBy("bank", account_key().alias("account"), month_key(F.col(day)).alias("month")).agg(F.min_by(balance, "doc_seq").alias(name))

    return of("opening", "period_start", "declared_opening"), of("closing", "period_end", "declared_closing")


def monthly_summary(movements: DataFrame, statements: DataFrame | None = None, labels: Sequence[str] = ()) -> DataFrame:
    """One row for each bank, account and month (and each of labels, which lead every key).

    Opening: the first row's balance less its amount, else declared, else the last known closing, else
    worked back from the closing (then `deduced`, and there is nothing to verify). Closing: the last
    balance, else declared, else opening plus net.
    """
    keys = [*labels, "bank", "account"]
    order = F.struct("date", "doc_seq", "seq")
    monthly = movements.withColumn("account", account_key()).withColumn("month", month_key(F.col("date"))).groupBy(*keys, "month").agg(
        F.count("*").alias("n"),
        total(inflow(F.col("amount"))).alias("inflow"),
        total(outflow(F.col("amount"))).alias("outflow"),
        total(F.col("amount")).alias("net"),
        F.min_by(F.col("balance") - F.col("amount"), order).alias("_first"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), order)).alias("_last"),
        F.count_if(F.col("sign_source") == "desconocida").alias("unclassified"),
        F.count_if(F.col("sign_source") == "palabras").alias("by_words"),
    )
    if statements is not None:
        for declared in declared_balances(statements):
            monthly = monthly.join(declared, ["bank", "account", "month"], "left")
    else:
        monthly = monthly.withColumns({c: F.lit(None).cast(MONEY) for c in ("declared_opening", "declared_closing")})

    own = F.coalesce("_first", "declared_opening").cast(SUM)
    reported = F.coalesce("_last", "declared_closing").cast(SUM)
    by_month = Window.partitionBy(*keys).orderBy("month")
    in_run = Window.partitionBy(*keys, "_run").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    anchored = monthly.withColumn("_own", own).withColumn("reported", reported).withColumn("_anchor", F.coalesce("reported", F.col("_own") + F.col("net")).cast(SUM))
    runs = anchored.withColumn("_run", F.count("_anchor").over(by_month))
    since = F.sum(F.when(F.col("_anchor").isNull(), F.col("net")).otherwise(0)).over(in_run)
    closed = runs.withColumn("closing", (F.first("_anchor", ignorenulls=True).over(in_run) + since).cast(SUM))
    before = F.lag("closing").over(by_month)
    opened = closed.withColumn("_before", before)
    opening = F.coalesce("_own", "_before", F.col("reported") - F.col("net")).cast(SUM)
    deduced = F.col("_own").isNull() & F.col("_before").isNull() & F.col("reported").isNotNull()
    out = opened.withColumn("opening", opening).withColumn("deduced", deduced)
    difference = F.when(~F.col("deduced"), F.col("opening") + F.col("net") - F.coalesce("reported", "closing")).cast(SUM)
    out = out.withColumn("difference", difference)
    return out.select(*keys, "month", "n", "inflow", "outflow", "net", "opening", "closing", "reported", "deduced", "difference", balance_mark().alias("check"), "unclassified", "by_words")


def balance_mark() -> Column:
    """A2: s/verificar, s/saldos, OK, or DIF and the difference."""
    gap = F.col("difference")
    return F.when(F.col("deduced"), "s/verificar").when(gap.isNull(), "s/saldos").when(F.abs(gap) <= TOLERANCE, "OK").otherwise(F.concat(F.lit("DIF "), format_amount(gap)))


def bank_totals(monthly: DataFrame) -> DataFrame:
    """A3: by bank. Of several accounts, opening and closing are those of one: the first by month and account, the last likewise."""
    at = F.struct("month", "account")
    return monthly.groupBy("bank").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("account") != "", F.col("account")))), ", ").alias("accounts"),
        F.count_distinct("month").alias("months"),
        F.sum("n").alias("n"),
        total(F.col("inflow")).alias("inflow"),
        total(F.col("outflow")).alias("outflow"),
        F.min_by("opening", F.when(F.col("opening").isNotNull(), at)).alias("opening"),
        F.max_by("closing", F.when(F.col("closing").isNotNull(), at)).alias("closing"),
    )


def bank_sums(monthly: DataFrame) -> DataFrame:
    """The summed variant of A3: openings and closings of all accounts of a bank added up."""
    per_account = monthly.groupBy("bank", "account").agg(
        F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("month"))).alias("opening"),
        F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("month"))).alias("closing"),
    )
    return per_account.groupBy("bank").agg(F.count("*").alias("accounts"), total(F.col("opening")).alias("opening"), total(F.col("closing")).alias("closing"))


def month_totals(monthly: DataFrame) -> DataFrame:
    """A4: by month over all banks."""
    return monthly.groupBy("month").agg(
        F.count_distinct("bank").alias("banks"),
        F.sum("n").alias("n"),
        total(F.col("inflow")).alias("inflow"),
        total(F.col("outflow")).alias("outflow"),
        total(F.col("net")).alias("net"),
        total(F.col("closing")).alias("closing"),
    )


def with_grand_total(monthly: DataFrame) -> DataFrame:
    """A5: totals by bank and, as the row TOTAL, of all."""
    rolled = monthly.rollup("bank").agg(F.grouping_id().alias("_g"), F.sum("n").alias("n"), total(F.col("inflow")).alias("inflow"), total(F.col("outflow")).alias("outflow"), total(F.col("net")).alias("net"))
    return rolled.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("bank")).alias("bank"), "n", "inflow", "outflow", "net")


def movement_totals(movements: DataFrame) -> DataFrame:
    """A12."""
    return movements.agg(F.count("*").alias("n"), total(inflow(F.col("amount"))).alias("inflow"), total(outflow(F.col("amount"))).alias("outflow"), total(F.col("amount")).alias("net"))


def coverage(movements: DataFrame) -> DataFrame:
    """The banks and months there are. They are few: distinct pairs are made before anything is gathered."""
    pairs = movements.select("bank", month_key(F.col("date")).alias("month")).distinct()
    return pairs.agg(F.array_join(F.array_sort(F.collect_set("bank")), ", ").alias("banks"), F.array_join(F.array_sort(F.collect_set("month")), ", ").alias("months"))


#: What a report may be parted by.
CRITERIA = {
    "bank": lambda: F.col("bank"),
    "file": lambda: F.coalesce(F.regexp_extract("file", r"([^/\\]*)$", 1), F.lit("(sin archivo)")),
    "month": lambda: month_label(month_key(F.col("date"))),
    "account": lambda: F.concat_ws(" - ", F.col("bank"), F.when(account_key() == "", "sin cuenta").otherwise(account_key())),
}


def split_by(movements: DataFrame, criterion: str) -> DataFrame:
    """Each movement once under CONSOLIDADO and once under its group, in the column label; with one
    group there is nothing to part and the label is empty. Use label as the leading key of any report."""
    keyed = movements.withColumn("_key", CRITERIA[criterion]())
    groups = len(keyed.select("_key").distinct().take(2))
    if groups < 2:
        return keyed.drop("_key").withColumn("label", F.lit(""))
    return keyed.withColumn("label", F.explode(F.array(F.lit(CONSOLIDATED), F.col("_key")))).drop("_key")


def closing_for_reconciliation(monthly: DataFrame) -> DataFrame:
    """The last closing that is known."""
    return monthly.filter("closing is not null").agg(F.max_by("closing", F.struct("month", "bank", "account")).alias("closing"))


def statement_checks(statements: DataFrame, movements: DataFrame) -> DataFrame:
    """Opening plus movements against closing, for each statement."""
    sums = movements.groupBy("doc_seq").agg(F.count("*").alias("n"), total(F.col("amount")).alias("net"), total(inflow(F.col("amount"))).alias("inflow"), total(outflow(F.col("amount"))).alias("outflow"))
    joined = statements.join(sums, "doc_seq", "left").na.fill(0, ["n"])
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(SUM) for c in ("net", "inflow", "outflow")})
    joined = joined.withColumn("difference", (F.col("opening") + F.col("net") - F.col("closing")).cast(SUM))
    state = F.when(F.col("difference").isNull(), "s/saldos").when(F.abs("difference") <= TOLERANCE, "OK").otherwise("REVISAR")
    return joined.withColumn("state", state)


def statement_warnings(checked: DataFrame, movements: DataFrame) -> DataFrame:
    """doc_seq, code, detail, for each thing a statement's reader should know."""
    sources = movements.groupBy("doc_seq").agg(*[F.count_if(F.col("sign_source") == s).alias(f"_{s}") for s in ("desconocida", "palabras", "marca")])
    rows = checked.join(sources, "doc_seq", "left").na.fill(0, ["_desconocida", "_palabras", "_marca"])

    def warn(code: str, condition: Column, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))

    def apart(printed: str, own: str) -> Column:
        return F.col(printed).isNotNull() & (F.abs(F.col(own) - F.abs(F.col(printed))) > TOLERANCE)

    some = F.col("n") > 0
    found = F.array_compact(
        F.array(
            warn("no movements", ~some, F.lit("0")),
            warn("newest first", F.coalesce("reversed", F.lit(False)), F.lit("")) if "reversed" in checked.columns else F.lit(None),
            warn("opening balance deduced from the first movement", F.coalesce("opening_deduced", F.lit(False)), F.lit("")) if "opening_deduced" in checked.columns else F.lit(None),
            warn("sign unknown", some & (F.col("_desconocida") > 0), F.col("_desconocida")),
            warn("sign by words", some & (F.col("_palabras") > 0), F.col("_palabras")),
            warn("sign by mark, nothing to verify", some & (F.col("_marca") > 0) & F.col("difference").isNull(), F.col("_marca")),
            warn("does not balance", some & (F.abs("difference") > TOLERANCE), F.col("difference")),
            warn("inflow differs from the printed total", some & apart("reported_in", "inflow"), F.col("inflow")),
            warn("outflow differs from the printed total", some & apart("reported_out", "outflow"), F.col("outflow")),
        )
    )
    return rows.select("doc_seq", F.explode(found).alias("w")).select("doc_seq", "w.code", "w.detail")


def folded_warnings(warnings: DataFrame, statements: int) -> DataFrame:
    """Warnings that all statements (and three at least) share word for word, as one row with doc_seq null; the others as they are."""
    shared = warnings.groupBy("code", "detail").agg(F.count_distinct("doc_seq").alias("times")).filter(F.col("times") >= F.lit(max(3, statements)))
    own = warnings.join(shared, ["code", "detail"], "left_anti").select("code", "detail", "doc_seq", F.lit(1).cast("long").alias("times"))
    return own.unionByName(shared.select("code", "detail", F.lit(None).cast("int").alias("doc_seq"), "times"))


def file_control(checked: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row for each file that was read: what it holds, whether it balances, and its warnings joined by ' | '.

    detected is false where the bank was given; reading is how its text was had.
    """
    said = F.concat_ws(": ", "code", F.nullif(F.col("detail"), F.lit("")))
    told = warnings.groupBy("doc_seq").agg(F.array_join(F.array_sort(F.collect_set(said)), " | ").alias("warnings"))
    given = {"file": F.lit(None).cast("string"), "detected": F.lit(True), "reading": F.lit("text")}
    rows = checked.withColumns({k: v for k, v in given.items() if k not in checked.columns}).join(told, "doc_seq", "left")
    return rows.select(
        "doc_seq", F.regexp_extract("file", r"([^/\\]*)$", 1).alias("file"), "bank", "detected", account_key().alias("account"), "period_start", "period_end", "n",
        "opening", "closing", "difference", "state", "reading", F.coalesce("warnings", F.lit("")).alias("warnings"),
    )


def verdict(monthly: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """One row: yes, yes with a caveat, or review."""
    months = monthly.agg(
        F.count_if(F.abs("difference") > TOLERANCE).alias("wrong_months"),
        F.count_if(F.col("difference").isNull()).alias("unverified_months"),
    )
    files = checked.agg(F.count_if(F.col("state") == "REVISAR").alias("incomplete")) if checked is not None else monthly.sparkSession.createDataFrame([(0,)], "incomplete long")
    state = F.when(F.col("wrong_months") > 0, "REVISAR").when((F.col("unverified_months") > 0) | (F.col("incomplete") > 0), "SI, CON ADVERTENCIA").otherwise("SI")
    return months.crossJoin(files).withColumn("verdict", state)  # one row each


def monthly_report(monthly: DataFrame) -> DataFrame:
    """The 15 columns of the monthly report, by month and bank."""
    return monthly.select(
        F.col("month").alias("period"), month_label(F.col("month")).alias("month_name"), "bank", "account", "n", "opening", "inflow", "outflow", "net", "closing",
        "reported", "difference", F.col("check").alias("mark"), "unclassified", "by_words",
    ).orderBy("period", "bank", "account")

