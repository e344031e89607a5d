"""Operator 1: best-fit packing of documents into token sequences.

The sizes that matter to a packing are bounded by the capacity, however many documents there are, so
the plan is made on the histogram of piece lengths (at most `capacity` rows) and applied to the
documents by their rank among pieces of equal length. Martello and Toth's dominance rules fix sets
first; best-fit decreasing places what they leave.

Defined results: null text is the empty text; an empty text is the single separator id; repeated rows
are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

CAPACITY = 2048
SEPARATOR = 0
#: Rows of equal length that one window task numbers at most, on average.
RANKED_TOGETHER = 50_000
#: The interval table has a few rows for each length of 1..capacity; larger ones are joined by a shuffle.
BROADCAST_INTERVALS = 200_000


def encoder(vocabulary: str | None = None):
    """text -> ids of the byte-level BPE in `vocabulary` (a tokenizers file with a .tiktoken twin of equal ids).

    tiktoken reads the same vocabulary as ranks and is three times as fast; a text that holds a special
    token's string goes to the tokenizers library itself, which has a rule for it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    special = [t.content for t in reference.get_added_tokens_decoder().values()]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return reference.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], dtype="<u4")
                start = 0
                end = len(ids) % capacity or min(capacity, len(ids))
                piece = 0
                while start < len(ids):
                    own = ids[start:end]
                    row = (doc, piece, start, end - start, zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype("i4")) if with_ids else row)
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class Bins:
    """`count` sequences that are filled alike: runs of (length, copies) from the front."""

    __slots__ = ("count", "free", "runs")

    def __init__(self, runs: list[tuple[int, int]], count: int, capacity: int):
        self.runs, self.count = runs, count
        self.free = capacity - sum(size * copies for size, copies in runs)


def dominance_reduction(left: list[int], capacity: int) -> list[Bins]:
    """Takes from `left` (number of items by size) each set that provably belongs to some best packing.

    For the largest item j and any feasible set that holds it, the set {j, ...} is fixed if every such
    set can be exchanged for it: nothing fits beside j; the largest fitting item k fills j's sequence,
    or only one item fits; or two fit at most and {k, b} is at least as large, item by item, as any pair.
    """
    fixed: list[Bins] = []

    def largest(limit: int) -> int:
        size = limit
        while size > 0 and not left[size]:
            size -= 1
        return max(size, 0)

    def smallest(n: int) -> list[int]:
        found: list[int] = []
        size = 1
        while size <= capacity and len(found) < n:
            found += [size] * min(left[size], n - len(found))
            size += 1
        return found

    def best_smaller(free: int) -> int:
        """The largest size of the smaller item over all pairs that fit in `free`."""
        for a in range(free // 2, 0, -1):
            if left[a] and (left[a] > 1 or largest(free - a) > a):
                return a
        return 0

    for j in range(capacity, 0, -1):
        while left[j]:
            left[j] -= 1
            free = capacity - j
            k = largest(free)
            if not k:
                fixed.append(Bins([(j, 1)], left[j] + 1 if 2 * j > capacity else 1, capacity))
                left[j] = 0 if 2 * j > capacity else left[j]
                continue
            low = smallest(3)
            if k == free or sum(low[:2]) > free or len(low) < 2:
                # Valid again while a j and a k are there, as taking items only raises the smallest ones.
                times = 1 + min(left[j] // 2, left[k] // 2 - 1) if k == j else min(left[j] + 1, left[k])
                times = max(times, 1)
                left[j] -= times - 1
                left[k] -= times
                fixed.append(Bins([(j, 1), (k, 1)] if k != j else [(j, 2)], times, capacity))
                continue
            if len(low) < 3 or sum(low) > free:
                left[k] -= 1
                b = largest(free - k)
                left[k] += 1
                if b and b >= best_smaller(free):
                    left[k] -= 1
                    left[b] -= 1
                    fixed.append(Bins([(j, 1), (k, 1), (b, 1)], 1, capacity))
                    continue
            left[j] += 1
            break
    return fixed


def best_fit_decreasing(left: list[int], capacity: int) -> list[Bins]:
    """Best-fit decreasing over sizes with counts; equal sequences are treated together, which gives what
    one-by-one placing gives."""
    by_free: dict[int, list[Bins]] = {}
    done: list[Bins] = []
    for size in range(capacity, 0, -1):
        count = left[size]
        while count:
            free = size
            while free <= capacity and not by_free.get(free):
                free += 1
            if free > capacity:
                each = capacity // size
                group = Bins([], -(-count // each), capacity)
                by_free.setdefault(capacity, []).append(group)
                continue
            group = by_free[free].pop()
            each = free // size
            if count >= each * group.count:
                parts = [(each, group.count)]
            else:
                parts = [(each, count // each), (count % each, 1 if count % each else 0)]
                rest = group.count - sum(n for _, n in parts)
                if rest:
                    kept = Bins(list(group.runs), rest, capacity)
                    by_free[free].append(kept)
            for copies, n in parts:
                if n and copies:
                    filled = Bins([*group.runs, (size, copies)], n, capacity)
                    count -= copies * n
                    (by_free.setdefault(filled.free, []) if filled.free else done).append(filled)
    return done + [g for groups in by_free.values() for g in groups if g.runs]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    left = [0] * (capacity + 1)
    for size, count in histogram.items():
        left[size] = count
    return dominance_reduction(left, capacity) + best_fit_decreasing(left, capacity)


def intervals(plan: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in a sequence, offset there)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for group in plan:
        offset = 0
        for size, copies in group.runs:
            first = taken.get(size, 0)
            taken[size] = first + copies * group.count
            rows.append((size, first, taken[size], sequence, copies, offset))
            offset += size * copies
        sequence += group.count
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces (columns doc_id, piece, start, length)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = intervals(packing_plan(histogram, capacity))
    places = spark.createDataFrame(rows, "_size long, _first long, _end long, _sequence long, _copies long, _base long")
    if len(rows) <= BROADCAST_INTERVALS:
        places = F.broadcast(places)

    buckets = max(64, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(sums, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    place = (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    at = F.col("_rank") - F.col("_first")
    return ranked.join(places, place).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_base") + (at % F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    return pack(written(token_pieces(docs, capacity, vocabulary), "pieces"), capacity)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, token_ids, doc_ids, lengths; a sequence has `capacity` pieces at most."""
    placed = pack(written(token_pieces(docs, capacity, vocabulary, with_ids=True), "pieces"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten("parts.ids").alias("token_ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )
