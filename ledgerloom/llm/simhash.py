"""Operator 2: SimHash near-duplicates by segment popcounts.

Each fingerprint becomes the vector of bit counts of its segments. The Manhattan distance of two such
vectors never exceeds their Hamming distance, so of two linked fingerprints (4 bits at most) at least four
of the eight parts of the vectors are equal: any four parts make a grid cell, and linked fingerprints meet
in one. Each pair that meets is verified exactly, in the join's condition. Equal fingerprints are one row
before any join. A segment has one bit by default, whose count is the bit itself: that vector keeps the
whole distance, so that of 60 million chance pairs one meets; segments of two bits make the same links from
larger cells.

First each fingerprint of a cell is compared to the cell's smallest node. Only pairs of one cell in
different components are compared after that, so a dense group doesn't make all of its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a repeated
row is another copy; rows without doc_id link, but give no component its name, and a component of such
rows alone has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.components import connected_components

SEED = 42
#: 0101... : the low bit of each 2-bit segment.
LOW_BITS = 0x5555555555555555
#: Fingerprints of rows without doc_id alone are numbered from here.
NAMELESS = 1 << 62


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


#: Four of eight parts of eight bits as a mask, with an odd number for the choice.
CHOICES = [(_signed(sum(0xFF << 8 * k for k in four)), _signed((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64)) for i, four in enumerate(combinations(range(8), 4))]
BLOCK = 1 << 16


def fingerprint_of(text: str, width: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, BLOCK):
        part = hashes[k : k + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp: the signed long of each text's 64-bit SimHash over `width`-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint_of(t.as_py() or "", width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def counts(fp: Column, segment: int) -> Column:
    """The bit counts of the segments of one or two bits, each in the place of its segment."""
    if segment == 1:
        return fp
    other, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return fp.bitwiseXOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def cells(fp: Column, segment: int) -> Column:
    """The grid cells of a fingerprint: its vector with four of the eight parts, and a number for which four."""
    v = counts(fp, segment)
    return F.array(*[v.bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(own)) for mask, own in CHOICES])


def meeting(nodes: DataFrame, segment: int = 1) -> DataFrame:
    """cell, fp, node, head of the cells with several nodes, the smallest of which is head.

    Spark takes the exploded cells for as small as the nodes, and tables of few columns for as small as their files, so without
    the hint it would gather either side on the driver, to broadcast it.
    """
    dealt = nodes.select(F.explode(cells(F.col("fp"), segment)).alias("cell"), "fp", "node")
    shared = dealt.groupBy("cell").agg(F.min(F.struct("node", "fp")).alias("head"), F.max("node").alias("last")).filter("head.node < last").select("cell", "head")
    return dealt.join(shared.hint("merge"), "cell")


def near_labels(nodes: DataFrame, bits: int, segment: int = 1) -> DataFrame:
    """id, component of the nodes (columns fp, node) that a path of links of `bits` (4 or fewer) bits connects to another."""
    members = written(meeting(nodes, segment), "members")

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= bits

    heads = members.filter((F.col("head.node") < F.col("node")) & near(F.col("fp"), F.col("head.fp")))
    first = written(heads.select(F.col("head.node").alias("src"), F.col("node").alias("dst")).distinct(), "near")
    labels = written(connected_components(first), "labels")

    labelled = members.select("cell", "fp", "node").join(labels.hint("merge"), F.col("node") == F.col("id"), "left")
    labelled = labelled.select("cell", "fp", "node", F.coalesce("component", "node").alias("own"))
    mixed = labelled.groupBy("cell").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high").select("cell")
    left = written(labelled.join(mixed.hint("merge"), "cell", "left_semi"), "mixed")
    a, b = left.alias("a"), left.alias("b").hint("merge")
    apart = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.own") < F.col("b.own")) & near(F.col("a.fp"), F.col("b.fp")))
    cross = written(apart.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct(), "cross")
    return labels if cross.isEmpty() else connected_components(first.unionByName(cross))


def near_components(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of `bits` differing bits at most."""
    if not 0 <= bits <= 4:
        raise ValueError("the grid's cells cover distances of 0 to 4 bits")
    prints = written(fingerprints(docs, width), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.coalesce("node", F.xxhash64("fp").bitwiseOR(F.lit(NAMELESS)))), "nodes")
    labels = near_labels(nodes.select("fp", "node"), bits)
    joined = nodes.join(labels.hint("merge"), F.col("node") == F.col("id"), "left")
    name = F.coalesce("component", "node")
    named = joined.select("fp", F.when(name < NAMELESS, name).alias("component_id"))
    return prints.join(named.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
