"""Operator 2 for near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are first those of operator 2's own grid: the 64-bit SimHash of the whole set, its segment counts,
and a cell for any four of the eight parts, so that all pairs of 4 differing bits at most meet in one.
At 0.8 that SimHash differs in 10 bits on average, which no grid over 64 bits can tell from chance.
So a text has a longer fingerprint besides: its shingles are dealt into classes by their hashes, some 5 to 10 to a class, and
each of PARTS classes has a SimHash of its own, whose popcount vector (segments of two bits) is a
grid cell. Two sets are candidates if they share a cell of either kind. A class without any of the shingles that the
sets differ in has equal fingerprints: for a pair at 0.8 a class of k shingles is one with a probability of
exp(-k * 2 / 9), so all 64 classes fail (and the pair needs the first grid) with one of 1e-11 at 5 shingles and of 3e-4 at 9.6, and a closer
pair with a much smaller one. Every link is decided by the exact overlap of the two sets, in the join's
condition.

Equal sets are one node. First each node of a key is compared to the key's smallest node. What that links is one component, and
only pairs of one key in different components are compared after that, so a large group of near copies
doesn't make all of its pairs. Those pairs first pass a bound that no pair at 0.8 fails: bitmaps of the
sets (each shingle flips one bit) differ in no more bits than the sets differ in shingles.

Defined results: words are parted by ASCII white space, and ASCII letters have no case; a text of fewer words
than a shingle is one shingle; null and empty texts have the empty set, so they are copies of each
other; links are transitive; one row of each component stays, the first by doc_id (nulls last), then
text; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.simhash import BLOCK, LOW_BITS, cells

WIDTH = 5
#: Classes whose fingerprints a text has, if it has so many shingles; others are dealt several times.
PARTS = 64
#: A class has this many shingles on average at least, and less than twice as many.
CLASS_SIZE = 4.8
LEAST_LEVEL = 4
SEED = 42
#: Odd multipliers, each of which deals the 64-bit hashes in another way.
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: 64-bit words of a set's bitmap.
WORDS = 16
PARITY = [f"p{k}" for k in range(WORDS)]


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the text's shingles, each once, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: max(0, len(words) - width)] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def levels_of(n: int) -> set[int]:
    """The powers of two of classes into which n shingles are dealt: one, or two where a set within 0.8 of that
    size may have another. Small sets have classes of few shingles, so that some are without a difference."""
    return {max(LEAST_LEVEL, int(np.floor(np.log2(max(1.0, x / CLASS_SIZE))))) for x in (n / 1.12, n * 1.12)}


def cells_of(shingles: np.ndarray) -> list[int]:
    """The grid cell of each class's fingerprint, as a signed long; none for the empty set."""
    found = []
    for level in levels_of(len(shingles)) if len(shingles) else ():
        classes = 1 << level
        for dealing in range(-(-PARTS // classes)):
            mixed = shingles * MULTIPLIERS[dealing]
            own = mixed >> np.uint64(64 - level)
            used = own < PARTS
            own, hashes = own[used], shingles[used]
            if not len(own):
                continue
            order = np.argsort(own, kind="stable")
            own, hashes = own[order], hashes[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            sizes = np.diff(np.append(starts, len(own)))
            prints = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)
            vectors = prints - ((prints >> np.uint64(1)) & np.uint64(LOW_BITS))
            number = own[starts] + np.uint64((level << 16 | dealing) << 32)
            found.append((vectors ^ (number * MULTIPLIERS[0])) * MULTIPLIERS[1])
    return np.concatenate(found).view(np.int64).tolist() if found else []


def fingerprint_of(shingles: np.ndarray) -> int:
    """The signed long of the set's 64-bit SimHash; a bit is 1 if set in over half the shingles."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(shingles), BLOCK):
        part = shingles[k : k + BLOCK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def parity_of(shingles: np.ndarray) -> list[int]:
    """WORDS signed longs in which each shingle flips one bit."""
    odd = np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """row, digest (of the set of shingles), n (its size), fp (its SimHash) and cells (of its classes) of docs (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, prints, parts = [], [], [], []
            for text in batch.column(1):
                own = shingles_of(text.as_py())
                digests.append(xxhash.xxh3_128_digest(own.tobytes(), SEED))
                sizes.append(len(own))
                prints.append(fingerprint_of(own))
                parts.append(cells_of(own))
            arrays = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "digest", "n", "fp", "cells"])

    return docs.mapInArrow(run, "row long, digest binary, n long, fp long, cells array<long>")


def grid_cells() -> Column:
    """All cells of a node (fp, cells): operator 2's grid over the whole fingerprint, and the classes'."""
    return F.concat(cells(F.col("fp"), 1), "cells")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, shingles and the bitmap of docs (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py()) for t in batch.column(1)]
            bits = list(zip(*map(parity_of, sets))) or [[]] * WORDS
            arrays = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *(pa.array(b, pa.int64()) for b in bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["node", "shingles", *PARITY])

    return docs.mapInArrow(run, "node long, shingles array<long>, " + ", ".join(f"{p} long" for p in PARITY))


def sizes_fit(a: Column, b: Column) -> Column:
    """Sets of such sizes can have a similarity of 0.8."""
    return (5 * F.least(a, b)) >= (4 * F.greatest(a, b))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs src, dst whose sets have a similarity of 0.8 at least: 9 x common >= 4 x (both sizes)."""
    a = sets.select(F.col("node").alias("src"), F.col("shingles").alias("own"))
    b = sets.select(F.col("node").alias("_dst"), F.col("shingles").alias("other"))
    near = (9 * F.size(F.array_intersect("own", "other"))) >= (4 * (F.size("own") + F.size("other")))
    return pairs.join(a, "src").join(b, (F.col("dst") == F.col("_dst")) & near).select("src", "dst")


def near_labels(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, component of the nodes (node, n, fp, cells) that a path of similar pairs connects to another; docs has their texts (row, text)."""
    dealt = nodes.select(F.explode(grid_cells()).alias("key"), "node", "n")
    shared = dealt.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).filter("head.node < last").select("key", "head")
    members = written(dealt.join(shared.hint("merge"), "key"), "members")
    alike = members.filter(F.col("head.node") < F.col("node")).filter(sizes_fit(F.col("n"), F.col("head.n")))
    pairs = written(alike.select(F.col("head.node").alias("src"), F.col("node").alias("dst")).distinct(), "pairs")
    sets = written(shingle_sets(docs.join(members.select("node").distinct(), F.col("row") == F.col("node"), "left_semi")), "sets")
    first = written(verified(pairs, sets), "near")

    labels = written(connected_components(first), "labels")
    labelled = members.select("key", "node", "n").join(labels, F.col("node") == F.col("id"), "left")
    labelled = written(labelled.select("key", "node", "n", F.coalesce("component", "node").alias("own")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high").select("key")
    left = written(labelled.join(mixed, "key", "left_semi").join(sets.select("node", *PARITY), "node"), "mixed")
    a, b = left.alias("a"), left.alias("b")
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITY), F.lit(0))
    near = sizes_fit(F.col("a.n"), F.col("b.n")) & ((9 * apart) <= (F.col("a.n") + F.col("b.n")))
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.own") < F.col("b.own")) & near)
    cross = written(cross.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct(), "pairs")
    more = written(verified(cross, sets), "near")
    return labels if more.isEmpty() else connected_components(first.unionByName(more))


def keyed(docs: DataFrame) -> DataFrame:
    """row, text and the document _doc; row is doc_id itself where it is unique and never null."""
    held = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    unclear = held.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1 or row is null")
    if unclear.isEmpty():
        return held
    ordered = held.orderBy(F.col("row").asc_nulls_last(), "text").select("_doc", F.monotonically_increasing_id().alias("row"), "text")
    return written(ordered, "ordered")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: the first of each component of near copies."""
    own = keyed(docs)
    texts = own.select("row", "text")
    found = written(sketches(texts), "sketches")
    nodes = found.groupBy("digest").agg(F.min("row").alias("node"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("cells").alias("cells"))
    nodes = written(nodes.select("node", "n", "fp", "cells"), "nodes")
    copies = near_labels(nodes, texts).filter("component < id").select("id")
    kept = nodes.select("node").join(copies, F.col("node") == F.col("id"), "left_anti")
    return own.join(kept, F.col("row") == F.col("node"), "left_semi").select("_doc.*")
