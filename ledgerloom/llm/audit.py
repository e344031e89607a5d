"""Operator 12: what filters remove, in every order, with a counting-Bloom prepass for repeated texts.

Each text is read once for four conditions and a hash. A counting Bloom filter over the hashes, built in
pieces by the tasks and merged block by block, clears the texts that are certainly unique; only the possible
repeats are shuffled, grouped by the whole text for the smallest doc_id of each. The rows that aren't the
first of their text then get their flag by a join on keys, and counts by (part, conditions, labels) are all
that the 120 orders need: at most 32 counts a part, which are added up for each order and step.

Defined results: a null text is empty; a null lang is the part ''; a row without doc_id is never a repeat,
and nothing repeats it; rows of equal doc_id and text aren't repeats of each other; a document counts as
good or toxic if any row of its labels says so, and not where it has none; repeated rows count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, SPACES, written

#: The filters in the order of their bits; the last is the repeated text.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = "[#$%&*|]"

#: Counters of the filter for each text, and at most (the merged bits then have 16 MB). A fuller filter only
#: lets more unique texts reach the exact step.
COUNTERS_EACH = 8
MOST_COUNTERS = 1 << 27
#: Counters in a block, the unit that is merged.
BLOCK = 1 << 16
#: Places of a text in the filter.
PLACES = 3
#: Hashes that a task turns into blocks at once.
HASHES = 1 << 20


def conditions(text: Column) -> dict[str, Column]:
    """The four conditions that a text fails by itself."""
    words = F.filter(F.split(F.btrim(text, F.lit(SPACES)), SPACE_CLASS + "+"), lambda w: w != "")
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "counts": counts,
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """_id, _part, _mask (the bits of A to D) and _hash of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = conditions(text)
    read = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_part"), found["counts"].alias("_n"), found["C"].alias("_c"), found["D"].alias("_d"), F.xxhash64(text).alias("_hash"))
    n = F.col("_n.n")
    bits = (n < MIN_WORDS, 100 * F.col("_n.d").cast("long") < DISTINCT_PERCENT * n, F.col("_c"), F.col("_d"))
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return read.select("_id", "_part", mask.alias("_mask"), "_hash")


def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The counters of each hash; size is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PLACES)]


def counters_for(rows: int) -> int:
    return max(BLOCK, min(MOST_COUNTERS, 1 << max(0, rows * COUNTERS_EACH - 1).bit_length()))


def pieces(hashes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The counters that hashes raise, by block: places within it, and whether twice or more.

    Places of one hash are told apart first, so that a text alone never raises a counter twice.
    """
    at = np.sort(np.stack(places(hashes, size)), axis=0)
    own = np.ones(at.shape, bool)
    own[1:] = at[1:] != at[:-1]
    spots, counts = np.unique(at[own], return_counts=True)
    block, starts = np.unique(spots // np.uint64(BLOCK), return_index=True)
    ends = [*starts[1:], len(spots)]
    within, often = (spots % np.uint64(BLOCK)).astype("<u2"), (counts > 1).astype(np.uint8)
    for a in range(0, len(block), 256):
        cuts = list(zip(starts[a : a + 256], ends[a : a + 256]))
        yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 256].astype(np.int64)), pa.array([within[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([often[i:j].tobytes() for i, j in cuts], pa.binary())], names=["block", "within", "often"])


def repeat_bits(hashes: DataFrame, rows: int) -> np.ndarray:
    """Of the merged filter over hashes (one long column): a bit for each counter of two or more."""
    size = counters_for(rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= HASHES:
                yield from pieces(np.concatenate(held), size)
                held, n = [], 0
        if n:
            yield from pieces(np.concatenate(held), size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(BLOCK, np.uint8)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, within, often in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield bits()
                    now, counts = block, np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(within, "<u2")
                counts[at] = np.minimum(2, counts[at] + 1 + np.frombuffer(often, np.uint8))
        if now is not None:
            yield bits()

    parts = hashes.mapInArrow(sketch, "block long, within binary, often binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_repeat(bits: np.ndarray):
    """A function of a column of hashes: whether all its counters are two or more."""
    size = len(bits) * 8

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        found = np.ones(len(h), bool)
        for at in places(h, size):
            found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(found)

    return test


def repeats(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, _hash, _rep) of the rows whose text some smaller doc_id has, distinct; keys has _id and _hash of docs, materialised."""
    test = may_repeat(repeat_bits(keys.filter("_id is not null").select("_hash"), keys.count()))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    possible = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash")).filter(test("_hash"))
    # The text is the key, so equal hashes of different texts don't matter; copies are folded before they are shuffled.
    first = possible.groupBy("_text").agg(F.min("_id").alias("_id")).select("_id", F.xxhash64("_text").alias("_hash"))
    asked = keys.filter(F.col("_id").isNotNull() & test("_hash")).select("_id", "_hash").distinct()
    return asked.join(first, ["_id", "_hash"], "left_anti").withColumn("_rep", F.lit(True))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_part, _mask (five bits) with the counts n, good and toxic."""
    keys = written(flagged(docs), "audit")
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    full = keys.join(repeats(docs, keys), ["_id", "_hash"], "left").join(told, "_id", "left")
    mask = F.col("_mask") + F.when(F.col("_rep"), 1 << FILTERS.index("E")).otherwise(0)
    return full.groupBy("_part", mask.alias("_mask")).agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit: a row for each part, order and step."""
    masks = mask_counts(docs, labels).groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("_masks"))
    steps = [(order, k + 1, 1 << FILTERS.index(letter), sum(1 << FILTERS.index(c) for c in order[:k])) for order in map("".join, itertools.permutations(FILTERS)) for k, letter in enumerate(order)]
    literal = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in steps])
    each = masks.select("_part", "_masks", F.inline(literal))

    def total(of: str, where) -> Column:
        return F.aggregate(F.filter("_masks", where), F.lit(0).cast("long"), lambda a, m: a + m[of])

    own, before = F.col("own"), F.col("before")
    removed = lambda m: (m["_mask"].bitwiseAND(own) != 0) & (m["_mask"].bitwiseAND(before) == 0)
    counts = each.select(
        F.col("_part").alias("part"), "filter_order", "step", "own",
        total("n", lambda m: m["_mask"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m["_mask"].bitwiseAND(own) != 0) & (m["_mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m["_mask"] == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    # A filter's sum needs no second look at the orders: how often no other filter of a mask comes before it depends on their number alone.
    return counts.join(shapley(masks), (F.col("part") == F.col("_part")) & (F.col("own") == F.col("_own"))).select(*[c for c in counts.columns if c != "own"], "shapley")


def shapley(masks: DataFrame) -> DataFrame:
    """For each part and filter, what it removes summed over all orders: of the orders, one in as many as a mask has filters puts it first."""
    orders = F.lit(120)
    own = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    each = masks.select("_part", "_masks", F.explode(own).alias("_own"))
    part = F.aggregate(F.filter("_masks", lambda m: m["_mask"].bitwiseAND(F.col("_own")) != 0), F.lit(0).cast("long"), lambda a, m: a + m["n"] * (orders / F.bit_count(m["_mask"])).cast("long"))
    return each.select("_part", "_own", part.alias("shapley"))


ORACLE = r"""
with own as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents),
told as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
failed as (
    select o.part, coalesce(t.good, 0) as good, coalesce(t.toxic, 0) as toxic,
        len(words) < 100 as a,
        100 * len(list_distinct(words)) < 80 * len(words) as b,
        100 * length(regexp_replace(o.text, '[^A-Z]', '', 'g')) > 10 * length(o.text) as c,
        regexp_matches(o.text, '[#$%&*|]') as d,
        coalesce(o.doc_id > min(o.doc_id) over (partition by o.text), false) as e
    from own o left join told t on o.doc_id = t.doc_id),
masks as (
    select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic
    from failed group by all),
filters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
orders as (
    select f1.letter || f2.letter || f3.letter || f4.letter || f5.letter as filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] as bits
    from filters f1, filters f2, filters f3, filters f4, filters f5
    where len(list_distinct([f1.letter, f2.letter, f3.letter, f4.letter, f5.letter])) = 5),
steps as (
    select filter_order, s::int as step, bits[s] as own, coalesce(list_sum(bits[1:s - 1]), 0)::int as before
    from orders, range(1, 6) r(s)),
counts as (
    select part, filter_order, step, own,
        sum(case when mask & (own | before) = 0 then n else 0 end) as kept,
        sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as removed,
        sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as redundant,
        sum(case when mask = own then n else 0 end) as unique_fails,
        sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end) as good_lost,
        sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
    from masks, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from counts
"""
