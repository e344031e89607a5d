"""Summaries, unions, breakdowns and reconciliation: goldens, invariants and brute force."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import breakdown, classify, reconcile, summary, unify
from ledgerloom.operators.order import positions
from ledgerloom.plans import queries, taxonomy

MOVEMENT = "bank string, account string, date date, description string, amount decimal(18,2), balance decimal(18,2), sign_source string, doc_seq int, seq int, mov_id long, document string, reference string, file string"


def movements(spark, rows):
    """rows: (bank, account, day, description, amount, balance, doc)."""
    full = [(b, a, d, t, Decimal(x), None if y is None else Decimal(y), "saldo", doc, i, i, None, None, f"f{doc}.txt") for i, (b, a, d, t, x, y, doc) in enumerate(rows)]
    return spark.createDataFrame(full, MOVEMENT)


def test_opening_and_closing_rules(spark):
    m = movements(spark, [
        ("A", "1", date(2025, 1, 5), "x", "10", "110", 0), ("A", "1", date(2025, 2, 5), "x", "5", None, 0), ("A", "1", date(2025, 4, 5), "x", "-3", "111", 0),
        ("B", "2", date(2025, 1, 5), "x", "7", None, 1), ("C", "3", date(2025, 1, 5), "x", "1", None, 2), ("C", "3", date(2025, 1, 6), "x", "2", "53", 2),
        ("D", None, date(2025, 1, 6), "x", "-2", None, 3),
    ])
    declared = spark.createDataFrame([(3, "D", None, date(2025, 1, 1), date(2025, 1, 31), Decimal("20.00"), Decimal("17.00"))], "doc_seq int, bank string, account string, period_start date, period_end date, opening decimal(18,2), closing decimal(18,2)")
    got = {(r["bank"], r["month"]): (r["opening"], r["closing"], r["deduced"], r["check"]) for r in summary.monthly_summary(m, declared).collect()}
    d = lambda x: Decimal(x)
    assert got == {
        ("A", "2025-01"): (d("100.00"), d("110.00"), False, "OK"),
        ("A", "2025-02"): (d("110.00"), d("115.00"), False, "OK"),
        ("A", "2025-04"): (d("114.00"), d("111.00"), False, "OK"),
        ("B", "2025-01"): (None, None, False, "s/saldos"),
        ("C", "2025-01"): (d("50.00"), d("53.00"), True, "s/verificar"),
        ("D", "2025-01"): (d("20.00"), d("17.00"), False, "DIF 1,00"),
    }


def test_carry_forward_against_a_loop(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for account in range(40):
        closing = None
        for month in sorted(rng.sample(range(1, 13), rng.randint(1, 8))):
            net, last, first = Decimal(0), None, None
            n = rng.randint(1, 3)
            for k in range(n):
                amount, balance = Decimal(rng.randint(-50, 50)), Decimal(rng.randint(0, 500)) if rng.random() < 0.3 else None
                rows.append(("A", str(account), date(2025, month, 1 + k), "x", str(amount), None if balance is None else str(balance), 0))
                net += amount
                first = balance - amount if k == 0 and balance is not None else first
                last = balance if balance is not None else last
            opening = first if first is not None else closing if closing is not None else last - net if last is not None else None
            closing = last if last is not None else opening + net if opening is not None else closing
            expected[str(account), f"2025-{month:02d}"] = (opening, last if last is not None else opening + net if opening is not None else None)
    got = {(r["account"], r["month"]): (r["opening"], r["closing"]) for r in summary.monthly_summary(movements(spark, rows)).collect()}
    assert got == expected


def test_union_keeps_repeats_and_is_idempotent(spark):
    own = [("A", "1", date(2025, 1, 5), "x", "10", None, 1)] * 2 + [("A", "1", date(2025, 1, 6), "y", "5", None, 1)]
    twice = [*own, *[(*r[:6], 2) for r in own], ("A", "1", date(2025, 1, 7), "z", "1", None, 2)]
    m = movements(spark, twice).withColumn("fingerprint", unify.fingerprint())
    assert sorted(r["doc_seq"] for r in unify.unified(m).collect()) == [1, 1, 1, 2]
    assert unify.duplicates(m).count() == 3


def test_split_loses_nothing(spark):
    m = movements(spark, [("A", "1", date(2025, 1, 5), "x", "10", None, 1), ("B", "2", date(2025, 2, 5), "x", "-4", None, 2)])
    for criterion in summary.CRITERIA:
        sums = {r["label"]: r["s"] for r in summary.split_by(m, criterion).groupBy("label").agg(F.sum("amount").alias("s")).collect()}
        assert sums.pop("CONSOLIDADO") == Decimal("6.00") == sum(sums.values())
    assert {r["label"] for r in summary.split_by(m.filter("bank = 'A'"), "bank").collect()} == {""}


CASES = (
    ("NOTA DEBITO I.V.A", -1, "IVA", taxonomy.OWN_BANK), ("IMPUESTO FINANCIERO 4X1000", -1, "GMF (4x1000)", taxonomy.OWN_BANK),
    ("COMISION SERVICIO NOMINA", -1, "Comisiones y cuotas de manejo", taxonomy.OWN_BANK), ("DEB PAGO NOMINA NOVD AUTOM.SISTEMAS", -1, "Nómina", "NOVD AUTOM.SISTEMAS"),
    ("PAGO DE PROV SERVIEQUIPOS", -1, "Proveedores", "SERVIEQUIPOS"), ("CRE TRANSF ACH BANCOLOMBIA", 1, "Transferencias recibidas", "BANCOLOMBIA"),
    ("Cargo omision consignacion Nacional - OF", -1, "Cargos y ajustes del banco", taxonomy.OWN_BANK), ("Intereses Ganados", 1, "Intereses y rendimientos", taxonomy.OWN_BANK),
    ("Para EDILBERTO SAENZ GARCIA", -1, "Transferencias enviadas", "EDILBERTO SAENZ GARCIA"), ("", -1, "Otros egresos", taxonomy.UNKNOWN_PARTY), ("123 456", 0, "Otros egresos", taxonomy.UNKNOWN_PARTY),
)


def test_concepts_and_parties(spark):
    m = movements(spark, [("A", "1", date(2025, 1, 5), t, str(s), None, 1) for t, s, _, _ in CASES])
    got = {r["mov_id"]: (r["concept"], r["party"]) for r in classify.classified(m, unify=False).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2:] for c in CASES]
    detail = breakdown.by_concept_and_party(classify.classified(m, unify=False))
    assert {r["type"]: r["t"] for r in detail.groupBy("type").agg(F.sum("total").alias("t")).collect()} == {"INGRESO": Decimal(2), "EGRESO": Decimal(8)}
    ruled = classify.classified(m, [classify.Rule(r"prov \w+", "Otro", "Compras")], unify=False).filter("mov_id = 4").first()
    assert (ruled["party"], ruled["concept"]) == ("Otro", "Compras")
    assert classify.valid_rules([("(", "a", "b"), ("ok", "a", "")])[0] == [classify.Rule("ok", "a", None)]


def absorbed(names):
    expected = {}
    for a in names:
        own = set(a.split())
        bigger = [b for b in names if own < set(b.split())]
        if bigger and (len(own) >= 2 or len(a) >= 6):
            expected[a] = min(bigger, key=lambda b: (-len(set(b.split())), b))
    return expected


def test_party_union_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["WIDGET", "RING", "RED", "BLUE", "ACME", "NORTE", "SUR"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(90)} | {"RED RED", "WIDGET WIDGET RING"})
    rows = spark.createDataFrame([(n, n) for n in names], "key string, name string")
    assert {r["key"]: r["into"] for r in classify.absorbing(rows).collect()} == absorbed(names)


def test_party_union_with_hot_words(spark):
    """Two words are in a third of all names; what is compared stays a small multiple of the names."""
    rng = random.Random(6)
    rare = [f"N{i}" for i in range(200)]
    names = {" ".join(["JUAN", "CARLOS", *rng.sample(rare, rng.randint(0, 3))]) for _ in range(300)} | {" ".join(rng.sample(rare, rng.randint(1, 4))) for _ in range(600)} | {"CARLOS", "JUAN"}
    names = sorted(names)
    rows = spark.createDataFrame([(n, n) for n in names], "key string, name string")
    assert {r["key"]: r["into"] for r in classify.absorbing(rows).collect()} == absorbed(names)
    words = rows.select("key", F.array_distinct(F.split("key", " ")).alias("words"))
    assert classify.candidates(words).count() < 4 * len(names)


LEDGER = "row long, date date, description string, amount decimal(18,2), reference string, bank string, account string"


def loop_of_matches(rows, entries):
    """rows: (bank, account, day, description, amount, ...) in the order of mov_id; entries: (row, day, text, amount, reference, bank, ...)."""
    free, expected = {e[0]: e for e in entries}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        options = []
        for e in free.values():
            gap = abs((r[2] - e[1]).days)
            bank = (e[5] or "").upper()
            if e[3] == Decimal(r[4]) and gap <= 5 and (not bank or r[0].upper() in bank or bank in r[0].upper() or bank.split()[0] in r[0].upper()):
                number = (e[4] or "")[3:]
                options.append((gap, not (number and number in r[3]), e[0]))
        if options:
            expected[i] = min(options)[2]
            del free[expected[i]]
    return expected


@pytest.mark.parametrize("chunk_rows", [50_000, 25, 1])
def test_matching_against_a_loop(spark, chunk_rows):
    """Many sessions at once, some long and dense: each amount is one, with its own density and delay of entries."""
    rng = random.Random(11 + chunk_rows)
    start = date(2025, 1, 1)
    banks = ["Banco Uno", "Banco Dos"]
    rows, entries = [], []
    for amount in range(1, 101):
        days, late = rng.choice([8, 60, 200]), rng.choice([0, 1, 3, 6])
        for _ in range(rng.randint(1, 40)):
            day = start + timedelta(rng.randint(0, days))
            if rng.random() < 0.9:
                rows.append((rng.choice(banks), "1", day, f"pago {rng.randint(100, 140)}", str(amount), None, 0))
            if rng.random() < 0.9:
                entries.append((len(entries), day + timedelta(rng.randint(0, late)), "e", Decimal(amount), rng.choice([None, f"CE-{rng.randint(100, 140)}"]), rng.choice([None, "BANCO UNO", "BANCO"]), None))
    got = {r["mov_id"]: r["row"] for r in reconcile.matched(movements(spark, rows), spark.createDataFrame(entries, LEDGER), chunk_rows=chunk_rows).collect()}
    assert got == loop_of_matches(rows, entries)


def sides_with_gaps(spark):
    rng, start = random.Random(21), date(2025, 1, 1)
    names = ["Banco Uno", "Banco Dos", "Caja", "", None]
    rows = [(rng.choice(names), "1", start + timedelta(rng.randint(0, 60)), f"pago {rng.randint(95, 130)} y {rng.randint(0, 12)}", str(rng.randint(1, 25)), None, 0) for _ in range(500)]
    refs = [None, "000", "CE-12", *[f"CE-{k}" for k in range(100, 130)], *[f"0{k}" for k in range(95, 100)]]
    entries = [(k, start + timedelta(rng.randint(0, 60)), "e", Decimal(rng.randint(1, 30)), rng.choice(refs), rng.choice([*names, " ", "BANCO", "banco uno ahorros"]), None) for k in range(400)]
    return movements(spark, rows), spark.createDataFrame([*entries, (900, None, "e", Decimal(1), None, None, None), (901, start, "e", None, None, None, None)], LEDGER)


def test_nearest_and_missing_against_all_pairs(spark):
    m, ledger = sides_with_gaps(spark)
    pairs = reconcile.candidate_pairs(m, ledger).cache()
    assert rows_of(reconcile.nearest_of_all(m, ledger)) == rows_of(reconcile.nearest_entry(pairs))
    left, right = reconcile.without_candidate(m, ledger)
    assert rows_of(left.select("mov_id")) == rows_of(m.join(pairs, "mov_id", "left_anti").select("mov_id")) != []
    assert rows_of(right.select("row")) == rows_of(ledger.join(pairs, "row", "left_anti").select("row")) != []


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_hot_day_makes_no_pairs(spark):
    """1,500 movements and entries of one amount and day are 2.25 million pairs; no operator makes them."""
    day = date(2025, 1, 1)
    m = movements(spark, [("A", "1", day, f"x {k}", "5", None, 0) for k in range(1500)])
    ledger = spark.createDataFrame([(k, day, "e", Decimal(5), f"CE-{k}", None, None) for k in range(1500)], LEDGER)
    got = {r["mov_id"]: r["row"] for r in reconcile.nearest_of_all(m, ledger).collect()}
    assert got[1234] in (123, 234, 1234) and len(got) == 1500
    for made in (reconcile.nearest_of_all(m, ledger), *reconcile.without_candidate(m, ledger)):
        made.collect()
        assert most_rows(made) < 20_000


def most_rows(df):
    """The most rows that a step of the executed plan made."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        for i in range(plan.children().size()):
            todo.append(plan.children().apply(i))
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_a_chunk_spans_days(spark):
    """A dense session whose chunks would be under a day each: they have CHUNK_REACHES times the tolerance."""
    start = date(2025, 1, 1)
    m = movements(spark, [("A", "1", start + timedelta(k // 10), "x", "5", None, 0) for k in range(3000)])
    ledger = spark.createDataFrame([(k, start + timedelta(k // 10), "e", Decimal(5), None, None, None) for k in range(3000)], LEDGER)
    assert reconcile.timeline(reconcile.both_sides(m, ledger), 5, 5).agg(F.max("chunk")).first()[0] == 5


def test_a_daily_fee_is_spread(spark):
    """One amount on each day of 20 years, booked a day late: every border matters to the next, and chunks stay even."""
    start = date(2005, 1, 1)
    rows = [("Banco Uno", "1", start + timedelta(k // 2), f"fee {k}", "-9", None, 0) for k in range(2 * 7300)]
    entries = [(k, start + timedelta(k // 2 + 1), "e", Decimal(-9), None, None, None) for k in range(2 * 7300)]
    m, ledger = movements(spark, rows), spark.createDataFrame(entries, LEDGER)
    whole = {r["mov_id"]: r["row"] for r in reconcile.matched(m, ledger).collect()}
    assert {r["mov_id"]: r["row"] for r in reconcile.matched(m, ledger, chunk_rows=4000).collect()} == whole and len(whole) > 14000
    sizes = [r["n"] for r in reconcile.both_sides(m, ledger).join(reconcile.timeline(reconcile.both_sides(m, ledger), 5, 4000), ["amount", "date"]).groupBy("chunk").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_balance_of_a_reconciliation(spark):
    m = movements(spark, [("A", "1", date(2025, 3, 1), "x", "100", None, 0), ("A", "1", date(2025, 3, 2), "y", "-7", None, 0)])
    ledger = spark.createDataFrame([(1, date(2025, 3, 3), "x", Decimal(100), None, None, None), (2, date(2025, 3, 3), "z", Decimal(-50), None, None, None)], LEDGER)
    rows = reconcile.items(m, ledger, reconcile.matched(m, ledger))
    r = reconcile.balance(rows, F.lit(1000), F.lit(957)).first()
    assert (r["matched"], r["bank_only"], r["book_only"], r["bank_reconciled"], r["book_reconciled"], r["reconciled"]) == (1, 1, 1, Decimal(950), Decimal(950), True)
    turned = ledger.withColumn("amount", (-F.col("amount")).cast("decimal(18,2)"))
    assert reconcile.signs_look_swapped(m, turned, reconcile.matched(m, turned)).first()["swapped"]


def test_empty_tables(spark):
    m = movements(spark, [("A", "1", date(2025, 1, 5), "x", "10", None, 1)]).filter("false")
    assert summary.monthly_summary(m).count() == 0
    assert classify.classified(m).count() == 0
    assert breakdown.by_party(classify.classified(m, unify=False)).count() == 0


def test_needed_texts():
    cases = {
        r"red\s+widget\b": ["WIDGET"], "abc|de fg": ["ABC", "DE FG"], "ab?cd": ["CD"], "(abc|d)xyz": ["XYZ"], r"a\.b-c": ["A.B-C"], r"\d{3}": [""], "[abc]def": ["DEF"], "ab{2}cd": ["CD"], "a+bc": ["BC"],
        "(?i)hello": ["HELLO"], "(?x) a b c": [""], "[)]ab(c|[(|])": ["AB"], "x|": ["X", ""], r"a\|b": ["A|B"], "ñandu": ["ANDU"], "": [""], "abc*": ["AB"], r"\bNO ME": ["NO ME"],
    }
    assert {k: classify.needed_texts(k) for k in cases} == cases


def test_many_rules_against_the_chain(spark):
    rng = random.Random(8)
    words = ["pago", "abono", "widget", "red", "hot bolt", "comisión", "nº 5", "a", "zz9"]
    shapes = ["{a} {b}", "{a}.*{b}", r"\b{a}\b", "{a}|{b}", "({a}|{b}) {c}", "{a}s?", "^{a}", r"{b}$", "{a}+", "[ab]{a}", r"\d{{2,}} {a}", r"{a}\s*{b}", "a", r"\d\d\d\d", "(?=.*{a}).*{b}"]
    rules = [classify.Rule(rng.choice(shapes).format(a=rng.choice(words), b=rng.choice(words), c=rng.choice(words)), f"p{i}" if rng.random() < 0.8 else None, f"c{i}") for i in range(120)]
    rules.insert(60, classify.Rule("nowhere to be found", "x", "y"))
    texts = [(" ".join(rng.choice([*words, str(rng.randint(1, 12000)), "otros"]) for _ in range(rng.randint(0, 6))),) for _ in range(400)] + [(None,), ("",)]
    keys = spark.createDataFrame(texts, "d string").selectExpr("coalesce(upper(d), '') d").distinct()
    for own in (rules[::-1], rules[:70:7], rules[60:61]):
        keyed = keys.withColumn("_key", classify.canon(F.col("d")))
        chain = {r["_key"]: (r["_rule_party"], r["_rule_concept"]) for r in classify.with_rules(keyed, own).collect()}
        classify.CHAIN, was = 0, classify.CHAIN
        try:
            many = {r["_key"]: (r["_rule_party"], r["_rule_concept"]) for r in classify.with_rules(keyed, own).collect()}
        finally:
            classify.CHAIN = was
        assert many == chain


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), rng.random() if rng.random() < 0.9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b double, id long").repartition(7)
    got = {r["id"]: r["position"] for r in positions(df, F.col("a"), F.desc_nulls_last("b"), F.col("id")).collect()}
    expected = sorted(rows, key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: k for k, r in enumerate(expected, 1)}
    assert positions(df.filter("false"), F.col("id")).count() == 0


def test_statement_files_hold_any_text(spark, tmp_path):
    texts = ["a\nb", "", "\f", "x\fy\n", "\x1b", "\x1bf\x1be\f", "\x1bn", None, "ñ 😀"]
    docs = [(source, t) for source in ("src0", "a b/c=%41+é", "", None) for t in texts] + [("void", None)]
    spark.createDataFrame(docs, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: tuple(r)[1:] for r in queries.statement_files(spark, str(tmp_path)).collect()}
    known = [t for t in texts if t is not None]
    sums = (len(texts), sum(map(len, known)), sum(t.count("\n") for t in known), True)
    assert got == {**{s: sums for s in ("src0", "a b/c=%41+é", "", None)}, "void": (1, None, None, True)}
