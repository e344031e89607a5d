"""Each stage of the pipeline against brute force on its own input, and run() as the chain of them."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import written
from tests.llm import brute


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    item = " ".join(rng.choice(words) for _ in range(30))

    def prose(n):
        return ". ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() for _ in range(n)) + "."

    passage = prose(4)
    good = [prose(rng.randint(10, 20)) for _ in range(20)]
    near = good[0].replace(good[0].split()[40], "changed", 1)
    rows = [*good, good[1], near, prose(8) + " " + passage + " " + prose(6), prose(9) + " " + passage + " " + prose(7), prose(8) + " " + item + ". " + prose(5)]
    rows += [None, "", "too short", " ".join(w + "###" for w in words[:120]), "again " * 200]
    return list(enumerate(rows)), item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "repeated passages", "benchmark leaks", "packing"]

    def after(name, given):
        return written(stages[name](spark, given, str(tmp_path)), "stage")

    kept = after("quality rules", docs)
    assert {r["doc_id"] for r in kept.collect()} == set(range(25)) and kept.columns == docs.columns

    single = after("near duplicates", kept)
    groups = brute.near_copies({r["doc_id"]: r["text"] for r in kept.collect()})
    assert {r["doc_id"] for r in single.collect()} == set(groups.values()) and (groups[20], groups[21]) == (1, 0)

    cut = after("repeated passages", single)
    given = {r["doc_id"]: r["text"] for r in single.collect()}
    expected = brute.repeated_bytes(list(given.items()))
    left = {r["doc_id"]: r for r in cut.collect()}
    assert left.keys() == {d for d, v in expected.items() if v[1] < v[0]} and cut.columns == docs.columns
    assert {d: len(r["text"].encode()) for d, r in left.items()} == {d: v[0] - v[1] for d, v in expected.items() if d in left}
    assert all(r["n_chars"] == len(r["text"]) for r in left.values()) and expected[23][1] > 100

    clean = after("benchmark leaks", cut)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, r in left.items() if item.lower() not in r["text"].lower()} == left.keys() - {24}

    packed = after("packing", clean)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()) == sorted(packed.select(*columns).collect())


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
