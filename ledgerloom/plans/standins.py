"""Movements, statements, a ledger, rules and statement lines derived from the TPC-H-like tables.

The same SQL runs in Spark and, as common table expressions, in the oracle's engine; what is computed
from these inputs is written twice, as DataFrame code and as the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Orders as movements of accounts: the bank is a market segment, an account a customer. Balances run by
#: (date, order) from the customer's balance, and are left out for a third of the accounts and on some rows.
MOVEMENTS = """
SELECT m.bank, m.account, m.date, m.description, m.amount,
       CASE WHEN m.custkey % 3 = 0 OR m.mov_id % 11 = 0 THEN NULL
            ELSE CAST(m.start + SUM(m.amount) OVER (PARTITION BY m.custkey ORDER BY m.date, m.mov_id) AS DECIMAL(18,2)) END AS balance,
       m.document, m.reference, m.sign_source, m.doc_seq, m.seq, m.file, m.mov_id
FROM (
  SELECT c.c_mktsegment AS bank, CAST(o.o_custkey AS STRING) AS account, CAST(o.o_orderdate AS DATE) AS date,
         concat(CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Pago de prov ' WHEN '2-HIGH' THEN 'Transf internet '
                     WHEN '3-MEDIUM' THEN 'Consignación nacional ' WHEN '4-NOT SPECIFIED' THEN 'Comisión cuota manejo '
                     ELSE 'Compra PSE ' END, coalesce(p.p_name, ''),
                CASE WHEN o.o_orderkey % 4 = 0 THEN ' SAS' WHEN o.o_orderkey % 5 = 0 THEN concat(' ', CAST(o.o_orderkey AS STRING)) ELSE '' END) AS description,
         CAST(CASE WHEN o.o_orderstatus = 'F' THEN -o.o_totalprice ELSE o.o_totalprice END AS DECIMAL(18,2)) AS amount,
         CAST(c.c_acctbal AS DECIMAL(18,2)) AS start, o.o_custkey AS custkey,
         CASE WHEN o.o_orderkey % 2 = 0 THEN CAST(o.o_orderkey AS STRING) END AS document, CAST(NULL AS STRING) AS reference,
         CASE WHEN o.o_orderkey % 13 = 0 THEN 'desconocida' WHEN o.o_orderkey % 7 = 0 THEN 'palabras' WHEN o.o_orderkey % 17 = 0 THEN 'marca' ELSE 'saldo' END AS sign_source,
         CAST(o.o_orderkey % 7 AS INT) AS doc_seq, CAST(o.o_orderkey AS BIGINT) AS seq,
         concat('in/doc', CAST(o.o_orderkey % 7 AS STRING), '.txt') AS file, CAST(o.o_orderkey AS BIGINT) AS mov_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON p.p_partkey = o.o_orderkey % 150
) m
"""

#: Declared balances for some accounts without printed ones.
STATEMENTS = """
SELECT CAST(c.c_custkey AS INT) AS doc_seq, c.c_mktsegment AS bank, CAST(c.c_custkey AS STRING) AS account,
       s.low AS period_start, s.high AS period_end,
       CASE WHEN c.c_custkey % 2 = 0 THEN CAST(c.c_acctbal AS DECIMAL(18,2)) END AS opening,
       CASE WHEN c.c_custkey % 9 = 0 THEN CAST(CAST(c.c_acctbal AS DECIMAL(18,2)) + s.net + CASE WHEN c.c_custkey % 27 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) END AS closing
FROM customer c JOIN (
  SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS low, CAST(MAX(o_orderdate) AS DATE) AS high,
         SUM(CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2))) AS net
  FROM orders GROUP BY o_custkey) s ON s.o_custkey = c.c_custkey
WHERE c.c_custkey % 3 = 0
"""

#: Two overlapping statements, with a genuine repeat inside the first.
OVERLAP = """
SELECT bank, account, date, description, amount, balance, CAST(1 AS INT) AS doc_seq, seq FROM movements WHERE mov_id % 10 < 7
UNION ALL
SELECT bank, account, date, description, amount, balance, CAST(2 AS INT) AS doc_seq, seq FROM movements WHERE mov_id % 10 >= 5
UNION ALL
SELECT bank, account, date, description, amount, balance, CAST(1 AS INT) AS doc_seq, seq FROM movements WHERE mov_id % 10 = 3
"""

#: Both sides of a reconciliation, with amounts in steps of 1000 so that entries contend.
BANK_SIDE = """
SELECT mov_id, bank, account, date, description, document, reference, CAST(round(amount / 1000) * 1000 AS DECIMAL(18,2)) AS amount FROM movements
"""
LEDGER_SIDE = """
SELECT mov_id AS row, date_add(date, CAST(mov_id % 9 - 4 AS INT)) AS date, description, CAST(round(amount / 1000) * 1000 AS DECIMAL(18,2)) AS amount,
       CASE WHEN mov_id % 3 = 0 THEN concat('CE-', CAST(mov_id AS STRING)) END AS reference,
       CASE WHEN mov_id % 4 = 0 THEN bank WHEN mov_id % 4 = 1 THEN concat(bank, ' AHORROS') END AS bank, account
FROM movements WHERE mov_id % 5 <> 0
UNION ALL
SELECT -mov_id AS row, date_add(date, CAST(mov_id % 9 - 4 AS INT)) AS date, 'Cheque sin cobrar' AS description, CAST(round(amount / 1000) * 1000 + 0.5 AS DECIMAL(18,2)) AS amount, CAST(NULL AS STRING) AS reference, CAST(NULL AS STRING) AS bank, account
FROM movements WHERE mov_id % 19 = 0
"""

#: A fee that every account pays again and again: 25 amounts without a gap of days, most of them booked up to three days later.
FEE_BANK = """
SELECT CAST(o_orderkey AS BIGINT) AS mov_id, 'Banco Uno' AS bank, CAST(o_custkey AS STRING) AS account, CAST(o_orderdate AS DATE) AS date, concat('Cuota de manejo ', CAST(o_orderkey % 500 AS STRING)) AS description,
       CAST(NULL AS STRING) AS document, CAST(NULL AS STRING) AS reference, CAST(-1000 - o_custkey % 25 AS DECIMAL(18,2)) AS amount FROM orders
"""
FEE_LEDGER = """
SELECT CAST(o_orderkey AS BIGINT) AS row, CAST(date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 4 AS INT)) AS DATE) AS date, 'Cuota' AS description, CAST(-1000 - o_custkey % 25 AS DECIMAL(18,2)) AS amount,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('CE-', CAST(o_orderkey % 500 AS STRING)) END AS reference, CAST(NULL AS STRING) AS bank, CAST(o_custkey AS STRING) AS account FROM orders WHERE o_orderkey % 11 <> 0
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("orders", "customer", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(MOVEMENTS)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(STATEMENTS)


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERLAP.replace("FROM movements", "FROM {movements}"), movements=movements(spark, sf_dir))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = movements(spark, sf_dir)
    return tuple(spark.sql(q.replace("FROM movements", "FROM {movements}"), movements=own) for q in (BANK_SIDE, LEDGER_SIDE))


def fees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir)
    return spark.sql(FEE_BANK), spark.sql(FEE_LEDGER)


def oracle(query: str) -> str:
    """query over the stand-ins, as common table expressions of the oracle's engine."""
    ledger = LEDGER_SIDE.replace("date_add(date, CAST(mov_id % 9 - 4 AS INT))", "CAST(date + CAST(mov_id % 9 - 4 AS INT) AS DATE)")
    parts = {"movements": MOVEMENTS, "statements": STATEMENTS, "overlapping": OVERLAP, "bank_side": BANK_SIDE, "ledger_side": ledger, "fee_bank": FEE_BANK, "fee_ledger": FEE_LEDGER.replace("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 4 AS INT))", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT)")}
    used = ["movements", *[k for k in parts if k != "movements" and k in query]]
    return "WITH " + ",\n".join(f"{k} AS ({parts[k]})" for k in used) + (", " if query.lstrip().startswith("AND ") else "\n") + query.lstrip().removeprefix("AND ")
