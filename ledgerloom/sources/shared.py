"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of a query when it has ended, so they don't add up over steps.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The tables written inside each scratch() that is open.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where none is set, a local one, which only a local master's tasks all see."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, label: str, batch_bytes: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and outlives executors. What goes to Python and back
    does so in batches of batch_bytes about, if given: a task holds several of them outside its heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    own = {CLEANUP: "true"} | ({BATCH: batch_bytes} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when it ends; for work whose results have been stored by then, such as a micro-batch."""
    _open.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _open.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
