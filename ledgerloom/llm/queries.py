"""The numbered operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import audit, chat, decontam, html, lexical, licenses, packing, passages, quality, simhash, toxicity, urls, warc
from ledgerloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(table(spark, sf_dir, "documents")).select(*columns)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"), width=100)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(spark, sf_dir)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.rendered(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_passages": op4_passages,
    "op5_warc": op5_warc,
    "op6_decontam": op6_decontam,
    "op7_urls": op7_urls,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_html": op10_html,
    "op11_toxicity": op11_toxicity,
    "op12_audit": op12_audit,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op7_urls": urls.ORACLE,
    "op8_chat": chat.ORACLE,
    "op9_licenses": licenses.oracle(),
    "op12_audit": audit.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
