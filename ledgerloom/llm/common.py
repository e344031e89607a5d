"""Shared helpers: reading tables, names; tables in the shared folder are the library's own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.shared import shared_dir, written

__all__ = ["SPACES", "SPACE_CLASS", "free_name", "few_rows", "shared_dir", "table", "written"]

#: ASCII white space as the word pattern [^\x20\x09-\x0D]+ leaves it out.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that become Python objects at once.
AT_ONCE = 256


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of AT_ONCE at most: what a task makes of texts and lists of a row takes many times the batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it as long as df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
