"""Queries over the stand-in tables, one for each operator, with the oracle's SQL where SQL can say it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import breakdown, classify, filters, reconcile, statements, summary, unify
from ledgerloom.operators.order import positions
from ledgerloom.plans import printed, standins
from ledgerloom.plans import taxonomy as t
from ledgerloom.plans.standins import oracle
from ledgerloom.sources import files
from ledgerloom.sources.shared import shared_dir
from ledgerloom.streaming import inbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


CANON = "upper(trim(regexp_replace(replace(strip_accents(coalesce({}, '')), 'ß', 'ss'), '\\s+', ' ', 'g')))"
#: -1.234.567,89 of a decimal.
AMOUNT_TEXT = "translate(format('{{:,.2f}}', {}), ',.', '.,')"
D = "DECIMAL(38,2)"

# --- summaries -------------------------------------------------------------------------------------

MONTHLY = f"""
AND rows_ AS (SELECT *, strftime(date, '%Y-%m') AS month FROM movements),
agg AS (
  SELECT bank, account, month, count(*) AS n, CAST(sum(greatest(amount, 0)) AS {D}) AS inflow, CAST(sum(greatest(-amount, 0)) AS {D}) AS outflow,
         CAST(sum(amount) AS {D}) AS net, arg_min_null(balance - amount, (date, doc_seq, seq)) AS first_, arg_max(balance, (date, doc_seq, seq)) AS last_,
         count(*) FILTER (sign_source = 'desconocida') AS unclassified, count(*) FILTER (sign_source = 'palabras') AS by_words
  FROM rows_ GROUP BY ALL),
dopen AS (SELECT bank, account, strftime(period_start, '%Y-%m') AS month, arg_min(opening, doc_seq) AS declared_opening FROM statements WHERE opening IS NOT NULL GROUP BY ALL),
dclose AS (SELECT bank, account, strftime(period_end, '%Y-%m') AS month, arg_min(closing, doc_seq) AS declared_closing FROM statements WHERE closing IS NOT NULL GROUP BY ALL),
base AS (SELECT *, coalesce(first_, declared_opening) AS own, coalesce(last_, declared_closing) AS reported FROM agg LEFT JOIN dopen USING (bank, account, month) LEFT JOIN dclose USING (bank, account, month)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bank, account ORDER BY month) AS k FROM base),
carried AS (
  WITH RECURSIVE walk AS (
    SELECT bank, account, k, CAST(coalesce(own, reported - net) AS {D}) AS opening, CAST(coalesce(reported, own + net) AS {D}) AS closing, own IS NULL AND reported IS NOT NULL AS deduced
    FROM numbered WHERE k = 1
    UNION ALL
    SELECT b.bank, b.account, b.k, CAST(coalesce(b.own, w.closing, b.reported - b.net) AS {D}), CAST(coalesce(b.reported, coalesce(b.own, w.closing) + b.net) AS {D}),
           b.own IS NULL AND w.closing IS NULL AND b.reported IS NOT NULL
    FROM walk w JOIN numbered b ON b.bank = w.bank AND b.account = w.account AND b.k = w.k + 1)
  SELECT * FROM walk),
monthly AS (
  SELECT n.bank, n.account, n.month, n.n, n.inflow, n.outflow, n.net, c.opening, c.closing, CAST(n.reported AS {D}) AS reported, c.deduced,
         CASE WHEN NOT c.deduced THEN CAST(c.opening + n.net - coalesce(n.reported, c.closing) AS {D}) END AS difference, n.unclassified, n.by_words
  FROM numbered n JOIN carried c USING (bank, account, k)),
checked AS (
  SELECT *, CASE WHEN deduced THEN 's/verificar' WHEN difference IS NULL THEN 's/saldos' WHEN abs(difference) <= 0.02 THEN 'OK'
                 ELSE 'DIF ' || {AMOUNT_TEXT.format("difference")} END AS "check" FROM monthly)
"""


MONTH_LABEL = "list_extract(['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre'], CAST(substr(month, 6, 2) AS INT)) || ' ' || substr(month, 1, 4)"


def with_monthly(sql: str) -> str:
    return oracle(MONTHLY.replace("AND rows_", "AND /* statements */ rows_") + sql)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.monthly_summary(standins.movements(spark, sf_dir), standins.statements(spark, sf_dir))


query("a1_monthly_summary", with_monthly("SELECT bank, account, month, n, inflow, outflow, net, opening, closing, reported, deduced, difference, \"check\", unclassified, by_words FROM checked"))(monthly)


@query("a3_bank_totals", with_monthly(f"""SELECT bank, string_agg(DISTINCT account, ', ' ORDER BY account) AS accounts, count(DISTINCT month) AS months, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(inflow) AS {D}) AS inflow, CAST(sum(outflow) AS {D}) AS outflow,
  arg_min(opening, (month, account)) AS opening, arg_max(closing, (month, account)) AS closing FROM checked GROUP BY bank"""))
def bank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.bank_totals(monthly(spark, sf_dir))


@query("a3_bank_sums", with_monthly(f"""SELECT bank, count(*) AS accounts, CAST(sum(opening) AS {D}) AS opening, CAST(sum(closing) AS {D}) AS closing
  FROM (SELECT bank, account, arg_min(opening, month) AS opening, arg_max(closing, month) AS closing FROM checked GROUP BY ALL) GROUP BY bank"""))
def bank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.bank_sums(monthly(spark, sf_dir))


@query("a4_month_totals", with_monthly(f"""SELECT month, count(DISTINCT bank) AS banks, CAST(sum(n) AS BIGINT) AS n, CAST(sum(inflow) AS {D}) AS inflow,
  CAST(sum(outflow) AS {D}) AS outflow, CAST(sum(net) AS {D}) AS net, CAST(sum(closing) AS {D}) AS closing FROM checked GROUP BY month"""))
def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.month_totals(monthly(spark, sf_dir))


@query("a5_grand_total", with_monthly(f"""SELECT coalesce(bank, 'TOTAL') AS bank, CAST(sum(n) AS BIGINT) AS n, CAST(sum(inflow) AS {D}) AS inflow,
  CAST(sum(outflow) AS {D}) AS outflow, CAST(sum(net) AS {D}) AS net FROM checked GROUP BY ROLLUP (bank)"""))
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.with_grand_total(monthly(spark, sf_dir))


@query("a12_movement_totals", oracle(f"""SELECT count(*) AS n, CAST(sum(greatest(amount, 0)) AS {D}) AS inflow, CAST(sum(greatest(-amount, 0)) AS {D}) AS outflow,
  CAST(sum(amount) AS {D}) AS net FROM movements"""))
def movement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.movement_totals(standins.movements(spark, sf_dir))


@query("a18_last_closing", with_monthly("SELECT arg_max(closing, (month, bank, account)) AS closing FROM checked"))
def last_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.closing_for_reconciliation(monthly(spark, sf_dir))


@query("a19_coverage", oracle("SELECT string_agg(DISTINCT bank, ', ' ORDER BY bank) AS banks, string_agg(DISTINCT strftime(date, '%Y-%m'), ', ' ORDER BY strftime(date, '%Y-%m')) AS months FROM movements"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.coverage(standins.movements(spark, sf_dir))


@query("a11_split_by_bank", oracle(f"""SELECT label, strftime(date, '%Y-%m') AS month, count(*) AS n, CAST(sum(amount) AS {D}) AS net
  FROM (SELECT 'CONSOLIDADO' AS label, * FROM movements UNION ALL SELECT bank, * FROM movements) GROUP BY ALL"""))
def split_by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = summary.split_by(standins.movements(spark, sf_dir), "bank")
    return parted.groupBy("label", dates.month_key(F.col("date")).alias("month")).agg(F.count("*").alias("n"), summary.total(F.col("amount")).alias("net"))


def _labelled(sql: str) -> str:
    """The monthly summary with label as the leading key and no statements."""
    for old, new in (("bank, account, k", "label, bank, account, k"), ("bank, account, month", "label, bank, account, month"), ("SELECT bank, account, strftime", "SELECT label, bank, account, strftime"), ("BY bank, account", "BY label, bank, account"), ("b.bank = w.bank", "b.label = w.label AND b.bank = w.bank"),
                     ("b.bank, b.account", "b.label, b.bank, b.account"), ("n.bank, n.account", "n.label, n.bank, n.account"), ("FROM movements", "FROM parted"), ("FROM statements WHERE", "FROM (SELECT '' AS label, * FROM statements) WHERE false AND")):
        sql = sql.replace(old, new)
    return sql


PARTED = f"""AND /* statements */ parted AS (SELECT 'CONSOLIDADO' AS label, * FROM movements UNION ALL SELECT {MONTH_LABEL.replace("month", "strftime(date, '%Y-%m')")}, * FROM movements),"""


@query("a11_summary_by_label", oracle(PARTED + _labelled(MONTHLY).lstrip().removeprefix("AND ") + """SELECT label, bank, account, month, n, inflow, outflow, net, opening, closing, reported, deduced, difference, "check", unclassified, by_words FROM checked"""))
def summary_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: a summary for each label, which leads every key; parted by month, nothing is carried forward."""
    parted = summary.split_by(standins.movements(spark, sf_dir), "month")
    return summary.monthly_summary(parted, labels=["label"])


#: What else the stand-in's statements say, by their number.
TOLD = """CASE WHEN doc_seq % 5 = 0 THEN CAST(12345.67 AS DECIMAL(18,2)) END AS reported_in, CASE WHEN doc_seq % 10 = 3 THEN CAST(-0.01 AS DECIMAL(18,2)) END AS reported_out,
  doc_seq % 4 = 0 AS reversed, opening IS NULL AND doc_seq % 7 = 0 AS opening_deduced"""


def own_movements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Movements with the doc_seq of their account's statement, and the statements."""
    known = standins.statements(spark, sf_dir)
    return standins.movements(spark, sf_dir).drop("doc_seq").join(known.select("account", "doc_seq"), "account"), known


def checked_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own, known = own_movements(spark, sf_dir)
    known = spark.sql(f"SELECT *, {TOLD} FROM {{known}}", known=known)
    return summary.statement_checks(known, own), own


@query("a13_statement_checks", oracle(f"""AND own AS (SELECT s.doc_seq AS d, m.amount FROM movements m JOIN statements s USING (account)),
sums AS (SELECT d AS doc_seq, count(*) AS n, CAST(sum(amount) AS {D}) AS net FROM own GROUP BY ALL)
SELECT s.doc_seq, coalesce(n, 0) AS n, CAST(coalesce(net, 0) AS {D}) AS net, CAST(opening + coalesce(net, 0) - closing AS {D}) AS difference,
  CASE WHEN opening + coalesce(net, 0) - closing IS NULL THEN 's/saldos' WHEN abs(opening + coalesce(net, 0) - closing) <= 0.02 THEN 'OK' ELSE 'REVISAR' END AS state
FROM statements s LEFT JOIN sums USING (doc_seq)"""))
def statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_statements(spark, sf_dir)[0].select("doc_seq", "n", "net", "difference", "state")


WARNINGS = f"""AND /* statements */ own AS (SELECT s.doc_seq AS d, m.amount, m.sign_source FROM movements m JOIN statements s USING (account)),
sums AS (SELECT d AS doc_seq, count(*) AS n, CAST(sum(amount) AS {D}) AS net, CAST(sum(greatest(amount, 0)) AS {D}) AS inflow, CAST(sum(greatest(-amount, 0)) AS {D}) AS outflow,
  count(*) FILTER (sign_source = 'desconocida') AS u, count(*) FILTER (sign_source = 'palabras') AS w, count(*) FILTER (sign_source = 'marca') AS k FROM own GROUP BY ALL),
c AS (SELECT s.*, {TOLD}, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(w, 0) AS w, coalesce(k, 0) AS k, CAST(coalesce(inflow, 0) AS {D}) AS inflow, CAST(coalesce(outflow, 0) AS {D}) AS outflow,
  CAST(opening + coalesce(net, 0) - closing AS {D}) AS gap FROM statements s LEFT JOIN sums USING (doc_seq)),
warnings AS (
SELECT doc_seq, 'no movements' AS code, '0' AS detail FROM c WHERE n = 0
UNION ALL SELECT doc_seq, 'newest first', '' FROM c WHERE {{newest}}
UNION ALL SELECT doc_seq, 'opening balance deduced from the first movement', '' FROM c WHERE opening_deduced
UNION ALL SELECT doc_seq, 'sign unknown', CAST(u AS VARCHAR) FROM c WHERE u > 0
UNION ALL SELECT doc_seq, 'sign by words', CAST(w AS VARCHAR) FROM c WHERE w > 0
UNION ALL SELECT doc_seq, 'sign by mark, nothing to verify', CAST(k AS VARCHAR) FROM c WHERE k > 0 AND gap IS NULL
UNION ALL SELECT doc_seq, 'does not balance', CAST(gap AS VARCHAR) FROM c WHERE n > 0 AND abs(gap) > 0.02
UNION ALL SELECT doc_seq, 'inflow differs from the printed total', CAST(inflow AS VARCHAR) FROM c WHERE n > 0 AND abs(inflow - abs(reported_in)) > 0.02
UNION ALL SELECT doc_seq, 'outflow differs from the printed total', CAST(outflow AS VARCHAR) FROM c WHERE n > 0 AND abs(outflow - abs(reported_out)) > 0.02)
"""


@query("a14_statement_warnings", oracle(WARNINGS.replace("{newest}", "reversed") + "SELECT doc_seq, code, detail FROM warnings"))
def statement_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.statement_warnings(*checked_statements(spark, sf_dir))


@query("a15_folded_warnings", oracle(WARNINGS.replace("{newest}", "true") + """, shared AS (SELECT code, detail, count(DISTINCT doc_seq) AS times FROM warnings GROUP BY ALL HAVING count(DISTINCT doc_seq) >= greatest(3, (SELECT count(*) FROM statements)))
SELECT code, detail, NULL AS doc_seq, times FROM shared UNION ALL SELECT code, detail, doc_seq, 1 FROM warnings ANTI JOIN shared USING (code, detail)"""))
def folded_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warning is the same for all statements, the others are theirs."""
    checked, own = checked_statements(spark, sf_dir)
    return summary.folded_warnings(summary.statement_warnings(checked.withColumn("reversed", F.lit(True)), own), checked.count())


@query("s11_file_control", oracle(WARNINGS.replace("{newest}", "reversed") + """, told AS (SELECT doc_seq, string_agg(DISTINCT code || CASE WHEN detail = '' THEN '' ELSE ': ' || detail END, ' | ' ORDER BY code || CASE WHEN detail = '' THEN '' ELSE ': ' || detail END) AS warnings FROM warnings GROUP BY doc_seq)
SELECT doc_seq, bank, doc_seq % 6 <> 3 AS detected, account, period_start, period_end, n, opening, closing, gap AS difference,
  CASE WHEN gap IS NULL THEN 's/saldos' WHEN abs(gap) <= 0.02 THEN 'OK' ELSE 'REVISAR' END AS state, 'doc' || doc_seq || '.txt' AS file, 'text' AS reading, coalesce(warnings, '') AS warnings
FROM c LEFT JOIN told USING (doc_seq)"""))
def file_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked, own = checked_statements(spark, sf_dir)
    checked = checked.withColumn("file", F.concat(F.lit("in/doc"), "doc_seq", F.lit(".txt"))).withColumn("detected", F.col("doc_seq") % 6 != 3)
    return summary.file_control(checked, summary.statement_warnings(checked, own))


@query("a16_verdict", with_monthly(f"""SELECT wrong_months, unverified_months, incomplete, CASE WHEN wrong_months > 0 THEN 'REVISAR' WHEN unverified_months > 0 OR incomplete > 0 THEN 'SI, CON ADVERTENCIA' ELSE 'SI' END AS verdict
  FROM (SELECT count(*) FILTER (abs(difference) > 0.02) AS wrong_months, count(*) FILTER (difference IS NULL) AS unverified_months FROM checked),
  (SELECT count(*) FILTER (abs(opening + coalesce(net, 0) - closing) > 0.02) AS incomplete FROM statements LEFT JOIN (SELECT account, sum(amount) AS net FROM movements GROUP BY account) USING (account))"""))
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.verdict(monthly(spark, sf_dir), checked_statements(spark, sf_dir)[0])


@query("s14_monthly_report", with_monthly(f"""SELECT month AS period, {MONTH_LABEL} AS month_name, bank, account, n, opening, inflow, outflow, net, closing, reported, difference,
  "check" AS mark, unclassified, by_words FROM checked"""))
def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.monthly_report(monthly(spark, sf_dir))


# --- filters, sorts, movement rows -----------------------------------------------------------------

SMALL = "SELECT mov_id, bank, account, date, amount FROM movements"


@query("f1_days", oracle(f"{SMALL} WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'"))
def of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = dates.date_range(month="1996-02")
    return filters.in_days(standins.movements(spark, sf_dir), low, high).select("mov_id", "bank", "account", "date", "amount")


#: Days as a user states them.
SPANS = {"month": {"month": dates.month_from_text("03/1996")}, "named": {"month": dates.month_from_text("marzo de 1996")}, "year": {"year": 1997}, "from": {"start": "1998-06"}, "until": {"end": "1995-02"}, "between": {"start": "15/01/1996", "end": "1996-02-20"}}


@query("x19_spans", oracle("""SELECT span, count(*) AS n, CAST(min(date) AS DATE) AS low, CAST(max(date) AS DATE) AS high FROM movements JOIN (VALUES ('month', DATE '1996-03-01', DATE '1996-03-31'), ('named', DATE '1996-03-01', DATE '1996-03-31'),
  ('year', DATE '1997-01-01', DATE '1997-12-31'), ('from', DATE '1998-06-01', DATE '9999-01-01'), ('until', DATE '0001-01-01', DATE '1995-02-28'), ('between', DATE '1996-01-15', DATE '1996-02-20')) s(span, a, b) ON date BETWEEN a AND b GROUP BY span"""))
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, a year and days in several spellings."""
    own = standins.movements(spark, sf_dir).select("date")
    counted = [filters.in_days(own, *dates.date_range(**told)).agg(F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high")).select(F.lit(name).alias("span"), "*") for name, told in SPANS.items()]
    return functools.reduce(DataFrame.unionByName, counted)


@query("f2_banks", oracle(f"{SMALL} WHERE bank IN ('BUILDING', 'FURNITURE')"))
def of_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_banks(standins.movements(spark, sf_dir), ["building", "  Furniture"]).select("mov_id", "bank", "account", "date", "amount")


@query("f3_account", oracle(f"{SMALL} WHERE contains(account, '12')"))
def of_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_account(standins.movements(spark, sf_dir), "1-2").select("mov_id", "bank", "account", "date", "amount")


@query("f4_text", oracle(f"SELECT mov_id, description FROM movements WHERE contains({CANON.format('description')}, 'CONSIGNACION NACIONAL RED')"))
def of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_text(standins.movements(spark, sf_dir), "consignación nacional red").select("mov_id", "description")


@query("f9_poor_text", r"""SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) < 60 OR NOT regexp_matches(text, '\d')
  OR length(regexp_replace(text, '[^\pL\pN .,;:\-/$()%*#\n\t°]', '', 'g')) / length(text) < 0.8 AS poor FROM documents""")
def poor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.poor_text(F.col("text"), F.lit(1)).alias("poor"))


@query("f10_directions", oracle("SELECT mov_id, CASE WHEN amount > 0 THEN 'INGRESO' WHEN amount < 0 THEN 'EGRESO' ELSE 'NEUTRO' END AS type, CAST(greatest(amount, 0) AS DECIMAL(18,2)) AS inflow, CAST(greatest(-amount, 0) AS DECIMAL(18,2)) AS outflow FROM movements"))
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("amount")
    return standins.movements(spark, sf_dir).select("mov_id", money.direction(amount).alias("type"), money.inflow(amount).alias("inflow"), money.outflow(amount).alias("outflow"))


@query("t1_positions", oracle("SELECT mov_id, row_number() OVER (ORDER BY bank, account, date, doc_seq, seq) AS position FROM movements"))
def movement_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each movement's number in report order."""
    order = (F.col("bank"), summary.account_key(), F.col("date"), F.col("doc_seq"), F.col("seq"))
    return positions(standins.movements(spark, sf_dir), *order).select("mov_id", "position")


@query("t2_report_positions", with_monthly("SELECT bank, account, month, row_number() OVER (ORDER BY month, bank, account) AS position FROM checked"))
def report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return positions(monthly(spark, sf_dir), F.col("month"), F.col("bank"), summary.account_key()).select("bank", "account", "month", "position")


@query("t5_first_movements", oracle("SELECT bank, account, date, amount, mov_id FROM movements ORDER BY bank, account, date, doc_seq, seq LIMIT 100"))
def first_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 in report order; a limit is the feature."""
    return standins.movements(spark, sf_dir).orderBy("bank", summary.account_key(), "date", "doc_seq", "seq").limit(100).select("bank", "account", "date", "amount", "mov_id")


# --- files written and read back -------------------------------------------------------------------


RULES = (classify.Rule(r"red widget\b", "Red Widget Company", None), classify.Rule("comisión", None, "Gastos bancarios"), classify.Rule(r"bolt \d+", "Bolt", "Tornillos"))
USER_RULES = oracle(f"""AND keyed AS (SELECT mov_id, {CANON.format("description")} AS k FROM movements),
r AS (SELECT *, CASE WHEN regexp_matches(k, 'RED WIDGET\\b') THEN 1 WHEN contains(k, 'COMISION') THEN 2 WHEN regexp_matches(k, 'BOLT \\d+') THEN 3 END AS rule FROM keyed)
SELECT mov_id, CASE rule WHEN 1 THEN 'Red Widget Company' WHEN 3 THEN 'Bolt' END AS rule_party, CASE rule WHEN 2 THEN 'Gastos bancarios' WHEN 3 THEN 'Tornillos' END AS rule_concept FROM r""")

def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: A text is one page whatever it holds: its own page breaks are written as two other characters, and so are the first of those and null.
ESCAPE = "\x1b"


def in_page(text: Column) -> Column:
    return F.coalesce(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(files.PAGE_BREAK), F.lit(f"{ESCAPE}f")), F.lit(f"{ESCAPE}n"))


def of_page(page: Column) -> Column:
    return F.replace(F.replace(F.nullif(page, F.lit(f"{ESCAPE}n")), F.lit(f"{ESCAPE}f"), F.lit(files.PAGE_BREAK)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


@query("s1_statement_files", """SELECT source, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS breaks, true AS in_order FROM documents GROUP BY source""")
def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of files of 200 each, in a folder by source, read below two paths of which one holds the other."""
    folder = new_folder(spark, "texts")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.concat(F.lit("="), "source").alias("source"), in_page(F.col("text")).alias("text"))  # null and empty sources share a folder's name
    docs.write.partitionBy("source").option("lineSep", files.PAGE_BREAK).option("maxRecordsPerFile", 200).text(folder)
    read = files.read_statements(spark, [folder, f"{folder}/source=%3Dsrc0"], "*.txt")
    body = F.transform(F.slice("pages", F.lit(1), F.size("pages") - 1), of_page)  # the writer ends a file with a page break
    known = F.nullif(F.array_compact(body), F.array().cast("array<string>"))  # null counts as a page, and not in sums
    chars = F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    breaks = F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    name = F.regexp_extract("file", "/source=([^/]+)/[^/]+$", 1)  # the writer escapes it as a url's characters are
    source = F.nullif(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit("__HIVE_DEFAULT_PARTITION__"))
    each = read.select(F.substr(source, F.lit(2)).alias("source"), F.size(body).cast("long").alias("pages"), chars.alias("chars"), breaks.alias("breaks"), (F.col("doc_seq") >= 0).alias("in_order"))
    return each.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "breaks")], F.bool_and("in_order").alias("in_order"))


#: Ledgers, each of 50 accounts, in three dialects: separators, titles, sides or signed amounts, commas or points.
LEDGER_FILES = """
SELECT owner, CASE owner % 3 WHEN 0 THEN 'Fecha;Comprobante;Descripcion;Debito;Credito' WHEN 1 THEN 'Date,Detalle,Valor' ELSE concat_ws(chr(9), 'FECHA', 'GLOSA', 'NUMERO', 'MONTO') END AS titles, o_orderkey AS id,
  CASE owner % 3
    WHEN 0 THEN concat_ws(';', day, concat('CE-', o_orderkey), 'Venta; con signo', CASE WHEN amount >= 0 THEN points ELSE '' END, CASE WHEN amount < 0 THEN points ELSE '' END)
    WHEN 1 THEN concat_ws(',', day, concat('"Nota, ', o_orderkey, '"'), concat('"', CASE WHEN amount < 0 THEN '-' ELSE '' END, commas, '"'))
    ELSE concat_ws(chr(9), day, 'Glosa', o_orderkey, concat(CASE WHEN amount < 0 THEN '-' ELSE '' END, commas)) END AS line
FROM (SELECT CAST(floor(o_custkey / 50) AS BIGINT) AS owner, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'sin fecha' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS day, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
  format_number(o_totalprice, 2) AS commas, translate(format_number(o_totalprice, 2), ',.', '.,') AS points FROM orders)
"""


@query("s4_ledger_files", """SELECT o_custkey // 50 AS owner, row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) + 1 AS row, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
  CASE o_custkey // 50 % 3 WHEN 0 THEN 'Venta; con signo' WHEN 1 THEN 'Nota, ' || o_orderkey ELSE 'Glosa' END AS description, CAST(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS amount,
  CASE o_custkey // 50 % 3 WHEN 0 THEN 'CE-' || o_orderkey WHEN 2 THEN CAST(o_orderkey AS VARCHAR) END AS reference FROM orders QUALIFY o_orderkey % 17 <> 0""")
def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of ledgers in three dialects, read in one job."""
    standins.views(spark, sf_dir)
    rows = spark.sql(LEDGER_FILES.replace("'Venta; con signo'", "'\"Venta; con signo\"'"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    folder = new_folder(spark, "ledgers")
    rows.groupBy("owner").agg(F.concat(F.first("titles"), F.lit("\n"), lines).alias("value")).write.partitionBy("owner").text(folder)
    entries, _ = files.read_ledgers(spark, [folder], "*.txt")
    return entries.select(F.regexp_extract("file", r"owner=(\d+)/", 1).cast("long").alias("owner"), "row", "date", "description", "amount", "reference")


@query("s7_rules_file", USER_RULES)
def rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a file with a title, comments and one that can't be compiled, as they are found in the movements."""
    folder = new_folder(spark, "rules")
    lines = ["patron;tercero;concepto", "# nota", "(;sin;cierre", *[f"{r.pattern};{r.party or ''};{r.concept or ''}" for r in RULES]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    rules, wrong = files.read_rules(spark, folder)
    assert len(wrong) == 1, wrong
    keyed = standins.movements(spark, sf_dir).select("mov_id", text.canon(F.col("description")).alias("_key"))
    return classify.with_rules(keyed, rules).select("mov_id", F.col("_rule_party").alias("rule_party"), F.col("_rule_concept").alias("rule_concept"))


@query("s9_csv_sink", oracle(f"SELECT CAST(mov_id AS VARCHAR) AS mov_id, bank, strftime(date, '%Y-%m-%d') AS date, {AMOUNT_TEXT.format('amount')} AS amount, CASE WHEN balance IS NOT NULL THEN {AMOUNT_TEXT.format('balance')} END AS balance, description FROM movements"))
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back as text."""
    folder = new_folder(spark, "csv")
    files.write_csv(standins.movements(spark, sf_dir).select("mov_id", "bank", "date", "amount", "balance", "description"), folder)
    return spark.read.option("sep", ";").option("header", True).csv(folder)


@query("s12_reports_by_label", oracle(f"""SELECT replace(label, ' ', '_') AS label, report, n, net FROM (
  SELECT label, 'movements' AS report, count(*) AS n, CAST(sum(amount) AS {D}) AS net FROM (SELECT 'CONSOLIDADO' AS label, amount FROM movements UNION ALL SELECT bank, amount FROM movements) GROUP BY label
  UNION ALL SELECT label, 'accounts', count(*), CAST(sum(net) AS {D}) FROM (SELECT label, account, sum(amount) AS net FROM (SELECT 'CONSOLIDADO' AS label, account, amount FROM movements UNION ALL SELECT bank, account, amount FROM movements) GROUP BY ALL) GROUP BY label)"""))
def reports_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of reports parted by label, and what their folders hold."""
    parted = summary.split_by(standins.movements(spark, sf_dir), "bank").select("label", "account", "amount")
    folder = new_folder(spark, "reports")
    files.export({"movements": parted, "accounts": parted.groupBy("label", "account").agg(summary.total(F.col("amount")).alias("amount"))}, folder, label="label")
    read = [spark.read.parquet(f"{folder}/{name}").groupBy("label").agg(F.count("*").alias("n"), summary.total(F.col("amount")).alias("net")).withColumn("report", F.lit(name)) for name in ("movements", "accounts")]
    return read[0].unionByName(read[1]).select("label", "report", "n", "net")


# --- union of overlapping statements ---------------------------------------------------------------

FINGERPRINTED = f"""AND fp AS (SELECT *, left(sha1(concat_ws('|', {CANON.format("bank")}, {CANON.format("account")}, strftime(date, '%Y-%m-%d'), CAST(amount AS VARCHAR),
  coalesce(CAST(balance AS VARCHAR), ''), substr({CANON.format("description")}, 1, 60))), 16) AS fingerprint FROM overlapping),
counts AS (SELECT fingerprint, doc_seq, count(*) AS n FROM fp GROUP BY ALL),
best AS (SELECT fingerprint, arg_max(doc_seq, (n, -doc_seq)) AS doc_seq FROM counts GROUP BY ALL)
"""


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.overlap(spark, sf_dir).withColumn("fingerprint", unify.fingerprint())


@query("u1_unified", oracle(FINGERPRINTED + "SELECT fingerprint, doc_seq, seq, amount FROM fp SEMI JOIN best USING (fingerprint, doc_seq)"))
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unified(fingerprinted(spark, sf_dir)).select("fingerprint", "doc_seq", "seq", "amount")


@query("u2_duplicates", oracle(FINGERPRINTED + "SELECT fingerprint, doc_seq, seq, amount FROM fp ANTI JOIN best USING (fingerprint, doc_seq)"))
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.duplicates(fingerprinted(spark, sf_dir)).select("fingerprint", "doc_seq", "seq", "amount")


# --- scalar functions ------------------------------------------------------------------------------


@query("x2_canonical_text", f"SELECT doc_id, {CANON.format('text')} AS canon FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.canon(F.col("text")).alias("canon"))


@query("x5_parse_amounts", "SELECT o_orderkey, style, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN style IN (2, 3) THEN -1 ELSE 1 END AS amount FROM orders, range(4) AS t(style)")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts rendered in four styles and read back."""
    value = F.col("o_totalprice").cast("decimal(18,2)")
    styles = [money.format_amount(value), F.concat(F.lit("$ "), F.format_number(value, 2)), F.concat(money.format_amount(value), F.lit("-")), F.concat(F.lit("("), F.format_number(value, 2), F.lit(") DB"))]
    rendered = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.posexplode(F.array(*styles)).alias("style", "text"))
    return rendered.select("o_orderkey", F.col("style").cast("long").alias("style"), money.parse_amount(F.col("text")).alias("amount"))


@query("x8_parse_dates", "SELECT o_orderkey, style, CAST(o_orderdate AS DATE) AS date FROM orders, range(5) AS t(style)")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates rendered in five styles and read back, the year given where it isn't printed."""
    day = F.col("o_orderdate").cast("date")
    names = F.array(*[F.lit(n) for n in dates.MONTH_NAMES])
    named = F.concat_ws(" de ", F.date_format(day, "d"), F.lower(F.get(names, F.month(day) - 1)), F.date_format(day, "yyyy"))
    styles = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd/MM/yy"), named, F.concat(F.lit("el "), F.date_format(day, "dd/MM"), F.lit(" pago"))]
    rendered = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.year(day).alias("year"), F.posexplode(F.array(*styles)).alias("style", "text"))
    return rendered.select("o_orderkey", F.col("style").cast("long").alias("style"), dates.parse_date(F.col("text"), F.col("year")).alias("date"))


@query("x16_file_labels", "SELECT DISTINCT n_name, regexp_replace(regexp_replace(strip_accents(n_name || ' año 1.csv'), '\\.csv$', ''), '\\s+', '_', 'g') AS label FROM nation")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").distinct()
    return rows.select("n_name", text.file_label(F.concat("n_name", F.lit(" año 1.csv"))).alias("label"))


# --- classification and breakdowns -----------------------------------------------------------------


def _case(patterns: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{name}'" for name, p in patterns) + f" ELSE '{otherwise}' END"


def _bare() -> str:
    def without(inner: str, words: tuple[str, ...]) -> str:
        one = "|".join(sorted(words, key=len, reverse=True))
        return f"regexp_replace({inner}, '\\b(?:{one})\\b', ' ', 'g')"

    out = "regexp_replace(regexp_replace(k, '\\b\\d[\\d\\-.]{2,}\\b', ' ', 'g'), '\\b\\d+\\b', ' ', 'g')"
    out = without(out, t.OPERATION_WORDS)
    out = f"regexp_replace({out}, '\\b(?:{'|'.join(t.CUT_WORDS)})\\w*', ' ', 'g')"
    out = without(out, t.PLACE_WORDS)
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


CLASSIFIED = f"""
AND keyed AS (SELECT *, {CANON.format("description")} AS k, CASE WHEN amount > 0 THEN 'INGRESO' ELSE 'EGRESO' END AS type FROM movements),
concepts AS (SELECT *, CASE WHEN type = 'INGRESO' THEN {_case(t.IN_CONCEPTS, t.OTHER_IN)} ELSE {_case(t.OUT_CONCEPTS, t.OTHER_OUT)} END AS concept FROM keyed),
named AS (SELECT *, CASE WHEN concept IN ({", ".join(f"'{c}'" for c in t.BANK_CONCEPTS)}) THEN '{t.OWN_BANK}' WHEN length({_bare()}) < 3 THEN '{t.UNKNOWN_PARTY}' ELSE {_bare()} END AS raw FROM concepts),
spelled AS (SELECT raw, min((date, doc_seq, seq)) AS seen, trim(regexp_replace(regexp_replace(raw, '\\b(?:{"|".join(sorted(text.COMPANY_SUFFIXES, key=len, reverse=True))})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key
  FROM named WHERE raw NOT IN ('{t.OWN_BANK}', '{t.UNKNOWN_PARTY}') GROUP BY raw),
names AS (SELECT key, arg_min(raw, (-length(raw), seen, raw)) AS name, list_distinct(string_split(key, ' ')) AS words FROM spelled WHERE key <> '' GROUP BY key),
holds AS (SELECT a.key, arg_min(b.key, (-len(b.words), b.key)) AS into_ FROM names a JOIN names b ON len(b.words) > len(a.words) AND list_has_all(b.words, a.words) WHERE len(a.words) >= 2 OR length(a.key) >= 6 GROUP BY a.key),
finals AS (SELECT s.raw, f.name FROM spelled s JOIN names n USING (key) LEFT JOIN holds h USING (key) JOIN names f ON f.key = coalesce(h.into_, n.key)),
classified AS (SELECT n.* EXCLUDE (k), coalesce(f.name, n.raw) AS party FROM named n LEFT JOIN finals f USING (raw)),
detail AS (SELECT type, concept, party, count(*) AS n, CAST(sum(abs(amount)) AS {D}) AS total, string_agg(DISTINCT bank, ', ' ORDER BY bank) AS banks, min(date) AS first_date, max(date) AS last_date FROM classified GROUP BY ALL)
"""


def classified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(standins.movements(spark, sf_dir))


@query("c1_classified", oracle(CLASSIFIED + "SELECT mov_id, concept, party FROM classified"))
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_rows(spark, sf_dir).select("mov_id", "concept", "party")


@query("c3_user_rules", USER_RULES)
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    party, concept = classify.rule_values(text.canon(F.col("description")), RULES)
    return standins.movements(spark, sf_dir).select("mov_id", party.alias("rule_party"), concept.alias("rule_concept"))


#: The n-th of 5,000 rules looks for a number, but for a few with words, alternatives, and no text of their own.
MANY = 5000
WORDED_RULES = {10: r"red\s+widget\b", 40: "comisión.*(hot|cold) ", 2000: "blue ring|old (anvil|bolt)", 4000: r"\b\d{3}\b"}


def many_rules() -> list[classify.Rule]:
    return [classify.Rule(WORDED_RULES.get(k, rf"\b{1000 + 7 * k}\b"), f"Tercero {k}" if k % 3 else None, f"Concepto {k}" if k % 2 else None) for k in range(MANY)]


@query("j10_many_rules", oracle(f"""AND keyed AS (SELECT mov_id, {CANON.format("description")} AS k FROM movements),
numbered AS (SELECT *, TRY_CAST(nullif(regexp_extract(k, ' (\\d+)$', 1), '') AS BIGINT) AS x FROM keyed),
found AS (SELECT mov_id, least(CASE WHEN regexp_matches(k, 'RED\\s+WIDGET\\b') THEN 10 END, CASE WHEN regexp_matches(k, 'COMISION.*(HOT|COLD) ') THEN 40 END, CASE WHEN regexp_matches(k, 'BLUE RING|OLD (ANVIL|BOLT)') THEN 2000 END,
  CASE WHEN regexp_matches(k, '\\b\\d{{3}}\\b') THEN 4000 END, CASE WHEN x >= 1000 AND (x - 1000) % 7 = 0 AND x < {1000 + 7 * MANY} AND (x - 1000) // 7 NOT IN ({", ".join(map(str, WORDED_RULES))}) THEN (x - 1000) // 7 END) AS rule FROM numbered)
SELECT mov_id, CASE WHEN rule % 3 <> 0 THEN 'Tercero ' || rule END AS rule_party, CASE WHEN rule % 2 <> 0 THEN 'Concepto ' || rule END AS rule_concept FROM found WHERE rule IS NOT NULL"""))
def found_by_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 with 5,000 rules; the movements that some rule finds."""
    keyed = standins.movements(spark, sf_dir).select("mov_id", text.canon(F.col("description")).alias("_key"))
    found = classify.rule_numbers(keyed.select("_key").distinct(), many_rules())
    told = spark.createDataFrame([(k, r.party, r.concept) for k, r in enumerate(many_rules())], "_rule int, rule_party string, rule_concept string")
    return keyed.join(found.join(told, "_rule"), "_key").select("mov_id", "rule_party", "rule_concept")


@query("a6_by_concept", oracle(CLASSIFIED + f""", g AS (SELECT type, concept, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS {D}) AS total, CAST(sum(total) * 100 AS HUGEINT) AS cents FROM detail GROUP BY ALL)
SELECT type, concept, n, total,
  CAST(CAST(cents // n + CASE WHEN 2 * (cents % n) > n OR (2 * (cents % n) = n AND (cents // n) % 2 = 1) THEN 1 ELSE 0 END AS DECIMAL(30,0)) * 0.01 AS DECIMAL(18,2)) AS mean,
  replace(printf('%.1f', CAST(round_even(CAST(total AS DOUBLE) * 100 / CAST(sum(total) OVER (PARTITION BY type) AS DOUBLE), 1) AS DOUBLE)), '.', ',') || '%' AS share FROM g"""))
def by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.by_concept(breakdown.by_concept_and_party(classified_rows(spark, sf_dir)))


@query("t3_concept_positions", oracle(CLASSIFIED + f""", g AS (SELECT type, concept, CAST(sum(total) AS {D}) AS total FROM detail GROUP BY ALL)
SELECT type, concept, row_number() OVER (ORDER BY type <> 'INGRESO', total DESC, concept) AS position FROM g"""))
def concept_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    rows = breakdown.by_concept(breakdown.by_concept_and_party(classified_rows(spark, sf_dir)))
    return positions(rows, *breakdown.concept_order()).select("type", "concept", "position")


@query("a7_by_concept_and_party", oracle(CLASSIFIED + "SELECT * FROM detail"))
def by_concept_and_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.by_concept_and_party(classified_rows(spark, sf_dir))


@query("a8_by_party", oracle(CLASSIFIED + f"""SELECT party, string_agg(DISTINCT concept, ', ' ORDER BY concept) AS concepts, count(*) AS n, CAST(sum(greatest(amount, 0)) AS {D}) AS received,
  CAST(sum(greatest(-amount, 0)) AS {D}) AS paid, CAST(sum(amount) AS {D}) AS net, string_agg(DISTINCT bank, ', ' ORDER BY bank) AS banks, min(date) AS first_date, max(date) AS last_date,
  CASE WHEN sum(amount) > 0 THEN 'INGRESO' ELSE 'EGRESO' END AS type FROM classified GROUP BY party"""))
def by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.by_party(classified_rows(spark, sf_dir))


@query("t4_top_parties", oracle(CLASSIFIED + f"SELECT party, CAST(sum(amount) AS {D}) AS net FROM classified GROUP BY party ORDER BY abs(sum(amount)) DESC, party LIMIT 20"))
def top_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.top_parties(breakdown.by_party(classified_rows(spark, sf_dir)), 20).select("party", "net")


@query("a9_subtotals", oracle(CLASSIFIED + f"SELECT type, concept, party, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS {D}) AS total FROM detail GROUP BY GROUPING SETS ((type, concept, party), (type, concept), (type))"))
def subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.with_subtotals(breakdown.by_concept_and_party(classified_rows(spark, sf_dir)))


@query("w5_ordered_detail", oracle(CLASSIFIED + f"SELECT *, CAST(sum(total) OVER (PARTITION BY type, concept) AS {D}) AS concept_total FROM detail"))
def ordered_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown.ordered_detail(breakdown.by_concept_and_party(classified_rows(spark, sf_dir)))


@query("a10_variants", oracle(CLASSIFIED + """SELECT party, string_agg(DISTINCT raw, ' | ' ORDER BY raw) AS variants FROM classified c JOIN spelled s USING (raw) JOIN spelled p ON p.raw = c.party
  WHERE s.key <> p.key GROUP BY party"""))
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.variants(classified_rows(spark, sf_dir))


# --- reconciliation --------------------------------------------------------------------------------

PAIRS = f"""AND pairs AS (
  SELECT m.mov_id, l.row, abs(date_diff('day', m.date, l.date)) AS day_gap,
         length(regexp_replace(coalesce(l.reference, ''), '\\D', '', 'g')) >= 3 AND contains(regexp_replace(concat_ws(' ', m.document, m.reference, m.description), '\\D', ' ', 'g'), ltrim(regexp_replace(coalesce(l.reference, ''), '\\D', '', 'g'), '0')) AS like_ref
  FROM bank_side m JOIN ledger_side l ON m.amount = l.amount AND abs(date_diff('day', m.date, l.date)) <= 5
   AND (l.bank IS NULL OR contains(upper(l.bank), upper(m.bank)) OR contains(upper(m.bank), upper(l.bank)) OR contains(upper(m.bank), string_split(upper(l.bank), ' ')[1])))
"""


@query("j2_candidate_pairs", oracle(PAIRS + "SELECT mov_id, row, CAST(day_gap AS INT) AS day_gap, like_ref FROM pairs"))
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.candidate_pairs(*standins.sides(spark, sf_dir))


@query("j3_nearest_entry", oracle(PAIRS + "SELECT mov_id, arg_min(row, (day_gap, NOT like_ref, row)) AS row, CAST(min(day_gap) AS INT) AS day_gap FROM pairs GROUP BY mov_id"))
def nearest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.nearest_of_all(*standins.sides(spark, sf_dir))


@query("j4_no_candidate", oracle(PAIRS + "SELECT mov_id, amount FROM bank_side ANTI JOIN pairs USING (mov_id)"))
def no_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.without_candidate(*standins.sides(spark, sf_dir))[0].select("mov_id", "amount")


@query("j5_entry_without_candidate", oracle(PAIRS + "SELECT row, amount FROM ledger_side ANTI JOIN pairs USING (row)"))
def entry_without_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.without_candidate(*standins.sides(spark, sf_dir))[1].select("row", "amount")


#: Movements in the order of their dates take their nearest free entry: one step of the walk for each movement of an amount.
WALK = PAIRS + """, ordered AS (SELECT mov_id, amount, row_number() OVER (PARTITION BY amount ORDER BY date, mov_id) AS k FROM bank_side SEMI JOIN pairs USING (mov_id)),
walk AS (
  WITH RECURSIVE step AS (
    SELECT DISTINCT amount, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS mov_id, CAST(NULL AS BIGINT) AS row FROM ordered
    UNION ALL
    SELECT amount, k, CASE WHEN row IS NULL THEN used ELSE list_append(used, row) END, mov_id, row FROM (
      SELECT s.amount, o.k, s.used, o.mov_id, (SELECT arg_min(p.row, (p.day_gap, NOT p.like_ref, p.row)) FROM pairs p WHERE p.mov_id = o.mov_id AND NOT list_contains(s.used, p.row)) AS row
      FROM step s JOIN ordered o ON o.amount = s.amount AND o.k = s.k + 1))
  SELECT mov_id, row FROM step WHERE row IS NOT NULL)
"""
ITEMS = WALK + """, items AS (
SELECT 'CONCILIADO' AS status, m.mov_id, m.date AS bank_date, m.bank, m.description AS bank_text, m.amount AS bank_amount, l.row, l.date AS book_date, l.description AS book_text, l.reference AS book_reference, l.amount AS book_amount, CAST(abs(date_diff('day', m.date, l.date)) AS INT) AS day_gap
FROM walk JOIN bank_side m USING (mov_id) JOIN ledger_side l USING (row)
UNION ALL SELECT 'SOLO BANCO', mov_id, date, bank, description, amount, NULL, NULL, NULL, NULL, NULL, NULL FROM bank_side ANTI JOIN walk USING (mov_id)
UNION ALL SELECT 'SOLO LIBROS', NULL, NULL, bank, NULL, NULL, row, date, description, reference, amount, NULL FROM ledger_side ANTI JOIN walk USING (row))
"""


@query("j1_matched", oracle(WALK + "SELECT mov_id, row FROM walk"))
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.matched(*standins.sides(spark, sf_dir))


@query("j1_daily_fee", oracle(WALK.replace("bank_side", "fee_bank").replace("ledger_side", "fee_ledger") + "SELECT mov_id, row FROM walk"))
def daily_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 where sessions last for years: they are settled in chunks, here of a few hundred rows."""
    return reconcile.matched(*standins.fees(spark, sf_dir), chunk_rows=400)


@query("j8_swapped_signs", oracle(WALK + """SELECT *, matched < 0.5 * movements AND turned > matched AS swapped FROM (
  SELECT (SELECT count(*) FROM bank_side) AS movements, (SELECT count(*) FROM walk) AS matched, (SELECT count(*) FROM bank_side m WHERE EXISTS (SELECT 1 FROM ledger_side l WHERE l.amount = -m.amount)) AS turned)"""))
def swapped_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, ledger = standins.sides(spark, sf_dir)
    return reconcile.signs_look_swapped(bank, ledger, reconcile.matched(bank, ledger))


@query("j8_turned_signs", oracle("AND /* bank_side ledger_side */ turned_side AS (SELECT * REPLACE (CAST(-amount AS DECIMAL(18,2)) AS amount) FROM ledger_side), " + WALK.replace("ledger_side", "turned_side").lstrip().removeprefix("AND ") + """SELECT *, matched < 0.5 * movements AND turned > matched AS swapped FROM (
  SELECT (SELECT count(*) FROM bank_side) AS movements, (SELECT count(*) FROM walk) AS matched, (SELECT count(*) FROM bank_side m WHERE EXISTS (SELECT 1 FROM turned_side l WHERE l.amount = -m.amount)) AS turned)"""))
def turned_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 with a ledger whose signs are the other way round."""
    bank, ledger = standins.sides(spark, sf_dir)
    ledger = ledger.withColumn("amount", (-F.col("amount")).cast("decimal(18,2)"))
    return reconcile.signs_look_swapped(bank, ledger, reconcile.matched(bank, ledger))


@query("u3_reconciliation", oracle(ITEMS + "SELECT * FROM items"))
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sections, each in the order of its dates."""
    bank, ledger = standins.sides(spark, sf_dir)
    return reconcile.sections(reconcile.items(bank, ledger, reconcile.matched(bank, ledger)))


@query("t6_section_positions", oracle(ITEMS + "SELECT status, mov_id, row, row_number() OVER (ORDER BY status, coalesce(bank_date, book_date), coalesce(mov_id, row)) AS position FROM items"))
def section_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    bank, ledger = standins.sides(spark, sf_dir)
    rows = reconcile.items(bank, ledger, reconcile.matched(bank, ledger))
    return positions(rows, *reconcile.section_order()).select("status", "mov_id", "row", "position")


@query("f6_ledger_days", oracle("SELECT row, date, amount FROM ledger_side WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"))
def ledger_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the entries of the days that are reconciled."""
    return filters.in_days(standins.sides(spark, sf_dir)[1], *dates.date_range(year=1995)).select("row", "date", "amount")


@query("a17_balance", oracle(ITEMS + f"""SELECT *, bank_reconciled - book_reconciled AS difference, abs(bank_reconciled - book_reconciled) <= 0.02 AS reconciled FROM (
  SELECT count(*) FILTER (status = 'CONCILIADO') AS matched, count(*) FILTER (status = 'SOLO BANCO') AS bank_only, count(*) FILTER (status = 'SOLO LIBROS') AS book_only,
    CAST(coalesce(sum(book_amount) FILTER (status = 'SOLO LIBROS'), 0) AS {D}) AS bank_adjustment, CAST(coalesce(sum(bank_amount) FILTER (status = 'SOLO BANCO'), 0) AS {D}) AS book_adjustment,
    CAST(1000000.00 + coalesce(sum(book_amount) FILTER (status = 'SOLO LIBROS'), 0) AS {D}) AS bank_reconciled, CAST(999000.00 + coalesce(sum(bank_amount) FILTER (status = 'SOLO BANCO'), 0) AS {D}) AS book_reconciled FROM items)"""))
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, ledger = standins.sides(spark, sf_dir)
    rows = reconcile.items(bank, ledger, reconcile.matched(bank, ledger))
    return reconcile.balance(rows, F.lit("1000000.00").cast("decimal(18,2)"), F.lit("999000.00").cast("decimal(18,2)"))


# --- statement lines -------------------------------------------------------------------------------


@query("p9_parsed_lines", oracle(printed.ROWS))
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed by four banks and read back; the oracle is the source."""
    columns = ("doc_id", "bank", "account", "date", "description", "document", "amount", "balance", "sign_source")
    return statements.parsed(printed.statements(spark, sf_dir))[0].select(*columns)


@query("p4_rows_without_years", oracle(printed.PLAIN_ROWS))
def rows_without_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a year over a year's end, amounts inside descriptions, signs by words."""
    return statements.parsed(printed.plain_statements(spark, sf_dir))[0].select("doc_id", "date", "description", "amount", "sign_source")


@query("p2_stated", oracle(printed.PLAIN_HEADS))
def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account, period, balances and totals as they are printed."""
    columns = ("doc_id", "account", "period_start", "period_end", "opening", "closing", "reported_in", "reported_out")
    return statements.parsed(printed.plain_statements(spark, sf_dir))[1].select(*columns)


@query("p11_diagnostics", """SELECT CAST(o_custkey // 50 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS rank, 'Pendiente ' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) AS line FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) <= 30""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of statements of 50 accounts each, without a single day, the first 30 lines that hold an amount; the limit is the feature."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_custkey") / 50).alias("owner"), "o_orderkey", F.concat(F.lit("  Pendiente      "), F.format_number("o_totalprice", 2)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"])
    docs = rows.groupBy("owner").agg(F.array(F.array_join(lines, "\n")).alias("pages")).select(F.col("owner").cast("string").alias("doc_id"), F.col("owner").cast("int").alias("doc_seq"), F.lit("in/x.txt").alias("file"), "pages")
    return statements.diagnostics(statements.parsed(docs)[2], 30).select("doc_id", F.col("rank").cast("long").alias("rank"), "line")


@query("u4_inbox", """WITH rows_ AS (SELECT o_custkey // 50 AS owner, CAST(o_orderdate AS DATE) + INTERVAL 300 MONTH AS day, CAST(-1000 - o_custkey % 7 AS DECIMAL(18,2)) AS amount, o_orderkey AS id FROM orders),
counts AS (SELECT owner, day, amount, count(*) FILTER (id % 10 < 7) AS a, count(*) FILTER (id % 10 >= 5) AS b FROM rows_ GROUP BY ALL)
SELECT lpad(CAST(owner AS VARCHAR), 10, '0') AS account, CAST(day AS DATE) AS date, amount, greatest(a, b) AS n FROM counts""")
def inbox_of_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, each of 50 customers, arrive in a folder, then later ones that overlap them; the movements, overlaps counted once."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_custkey") / 50).alias("owner"), F.add_months(F.col("o_orderdate").cast("date"), 300).alias("day"), (1000 + F.col("o_custkey") % 7).alias("size"), F.col("o_orderkey").alias("id"))
    line = F.concat(F.date_format("day", "yyyy/MM/dd"), F.lit("   Cuota de manejo        "), F.format_number("size", 2))
    folder, table, marks = (new_folder(spark, label) for label in ("inbox", "inbox_table", "inbox_marks"))
    for turn, own in enumerate(("id % 10 < 7", "id % 10 >= 5")):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "id", line.alias("line")))), lambda x: x["line"]), "\n")
        head = F.concat(F.lit("COOPERATIVA\nCUENTA No. "), F.lpad(F.col("owner").cast("string"), 10, "0"), F.lit("\n"))
        rows.filter(own).groupBy("owner").agg(lines.alias("_lines")).select("owner", F.concat(head, "_lines").alias("value")).write.partitionBy("owner").text(f"{folder}/turn{turn}")
        inbox.watch(spark, folder, table, f"{marks}/a").awaitTermination()
        inbox.settle(spark, table, f"{marks}/b").awaitTermination()
    return inbox.current(spark, table).groupBy("account", "date", "amount").agg(F.count("*").alias("n"))


@query("p10_parsed_statements", oracle(printed.STATEMENTS))
def parsed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the statements say of themselves, or what follows from their rows."""
    columns = ("doc_id", "bank", "account", "period_start", "period_end", "opening", "opening_deduced", "closing", "reversed")
    return statements.parsed(printed.statements(spark, sf_dir))[1].select(*columns)


#: Lines with years of their own and others' in them.
YEAR_LINES = """SELECT CAST(o_custkey AS STRING) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line_no,
  concat('Pago ', CAST(2000 + o_orderkey % 5 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' de 2011, 2011 y 12003' ELSE '' END, CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE '' END) AS line,
  concat('in/2001/libro 20', CAST(10 + o_custkey % 80 AS STRING), '.txt') AS file FROM orders"""


@query("a20_likely_year", f"""WITH lines AS ({YEAR_LINES.replace("STRING", "VARCHAR")}),
words AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\b(20\\d{{2}})\\b', 1)) AS year, generate_subscripts(regexp_extract_all(line, '\\b(20\\d{{2}})\\b', 1), 1) AS at_ FROM lines WHERE line_no <= 60),
counted AS (SELECT doc_id, year, count(*) AS n, min((line_no, at_)) AS seen FROM words GROUP BY ALL),
best AS (SELECT doc_id, arg_min(year, (-n, seen)) AS year FROM counted GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(year, regexp_extract(file, '\\b(20\\d{{2}})\\.txt', 1)) AS INT) AS doc_year FROM (SELECT DISTINCT doc_id, file FROM lines) d LEFT JOIN best USING (doc_id)""")
def likely_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    standins.views(spark, sf_dir)
    return statements.likely_year(spark.sql(YEAR_LINES))


@query("p3_amount_tokens", oracle(f"""SELECT mov_id, CASE WHEN balance IS NULL THEN 1 ELSE 2 END AS n, abs(amount) AS first_amount, amount < 0 AS negative FROM movements"""))
def amount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = standins.movements(spark, sf_dir).withColumn("balance", (F.col("balance") + printed.SHIFT).cast("decimal(18,2)"))
    line = F.concat_ws("   ", F.date_format("date", "dd/MM/yyyy"), F.lit("Compra"), money.format_amount(F.col("amount")), F.nullif(money.format_amount(F.col("balance")), F.lit("")))
    tokens = own.select("mov_id", statements.amount_tokens(line, F.lit(False)).alias("t"))
    return tokens.select("mov_id", F.size("t").alias("n"), F.get("t", F.lit(0))["value"].alias("first_amount"), F.get("t", F.lit(0))["negative"].alias("negative"))


@query("s13_movement_rows", oracle("""SELECT bank, account, date, strftime(date, '%Y-%m') AS period, description, '' AS concept, '' AS party, '' AS reference, coalesce(document, '') AS document,
  CASE WHEN amount > 0 THEN 'INGRESO' WHEN amount < 0 THEN 'EGRESO' ELSE 'NEUTRO' END AS type, CAST(greatest(amount, 0) AS DECIMAL(18,2)) AS inflow, CAST(greatest(-amount, 0) AS DECIMAL(18,2)) AS outflow,
  amount, balance, sign_source, file FROM movements"""))
def movement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.movement_rows(standins.movements(spark, sf_dir))
