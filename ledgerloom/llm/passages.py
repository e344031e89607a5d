"""Operator 4: removal of repeated passages by prefix-free parsing.

A rolling hash over 32-byte grams triggers phrase borders: each window of `width` bytes is owned by its
gram of smallest hash, and a phrase is a run of windows whose owners have one hash (so a periodic text is
one phrase), with the bytes they cover. What
equals a window anywhere has the same owner, so the corpus is settled in two parts. The parse: of equal
phrases all but the first in corpus order are repeats, and their bytes are never looked at again. The
dictionary: distinct phrases that share an owner are sorted by suffix (prefix doubling to exactly
`width` bytes), and in each class of equal suffixes all but the first in corpus order are repeats.
Owners with very many distinct phrases are settled by a shuffle on each window instead, as their
group has no size bound. Both parts come together as byte ranges in corpus order for each document.

Defined results: null text is the empty text; texts shorter than `width` bytes lose nothing; the corpus
order is doc_id, then text for rows that share a doc_id or have none; an empty table gives an empty
result; other columns are ignored or, where documents are returned, passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import few_rows, written

WIDTH = 100
GRAM = 32
#: Windows that are handled at once; positions within take 24 bits.
SEGMENT = 1 << 22
#: An owner with more distinct phrases (some 3 MB) is hot: no task sorts its phrases together.
SORTED_TOGETHER = 16_384
#: Rows that the tasks of the suffix sort hold at once.
SORT_ROWS = 8192
#: Texts and phrases go to the tasks' Python in batches of this size.
BATCH_BYTES = "8m"

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB], dtype=np.uint64)
POSITION = np.uint64(0xFFFFFF)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes of data."""
    n = len(data)
    words = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    mixed = (words ^ (words >> np.uint64(31))) * ODD[4]
    mixed ^= mixed >> np.uint64(29)
    hashes = mixed[: n - GRAM + 1] * ODD[0]
    for j in range(1, GRAM // 8):
        hashes += mixed[8 * j : n - GRAM + 1 + 8 * j] * ODD[j]
    hashes ^= hashes >> np.uint64(32)
    hashes *= ODD[4]
    hashes ^= hashes >> np.uint64(29)
    return hashes


def phrases_of(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each phrase its owner's hash, first window and number of windows, and whether it has owners in several
    places; others can't hold a window twice."""
    owners, firsts, counts, several = [], [], [], []
    windows = len(data) - width + 1
    for at in range(0, windows, SEGMENT):
        hashes = gram_hashes(data[at : min(windows, at + SEGMENT) + width - 1])
        least = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        span, reach = 1, width - GRAM + 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if reach > span:
            least = np.minimum(least[: span - reach], least[reach - span :])
        place = (least & POSITION).astype(np.int64)
        owner = hashes[place]
        first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        owners.append(owner[first])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(owner))))
        several.append(place[first] != place[first + counts[-1] - 1])
    return np.concatenate(owners), np.concatenate(firsts), np.concatenate(counts), np.concatenate(several)


def phrase_rows(docs: DataFrame, width: int) -> DataFrame:
    """h, c, row, first, n, s: owner, content hash, document, first window and number of windows, owners in several places."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in few_rows(batches):
            parts: list[tuple] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < width:
                    continue
                h, first, n, several = phrases_of(data, width)
                view = memoryview(data)
                c = np.array([digest(view[a : a + k + width - 1]) for a, k in zip(first.tolist(), n.tolist())], dtype=np.uint64)
                parts.append((h.view(np.int64), c.view(np.int64), np.full(len(h), row), first, n, several))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "c", "row", "first", "n", "s"])

    return docs.select("row", "text").mapInArrow(parse, "h long, c long, row long, first int, n int, s boolean")


def numbered(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones; keys is sorted in place."""
    order = np.argsort(keys)
    keys[:] = keys[order]
    new = np.zeros(len(keys), dtype=np.int32)
    np.not_equal(keys[1:], keys[:-1], out=new[1:], casting="unsafe")
    ranks = np.empty(len(keys), dtype=np.int32)
    ranks[order] = np.cumsum(new, out=new)
    return ranks


def suffix_classes(data: bytes, width: int) -> np.ndarray:
    """For each position the rank of the suffix there by its first `width` bytes, by prefix doubling."""
    n = len(data)
    padded = data + bytes(width + 8)
    words = np.ndarray((n + width,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    rank, reach = numbered(words), 8
    del words
    while reach < width:
        step = min(reach, width - reach)
        keys = rank.astype(np.int64) * (len(rank) + 1)
        keys[:-step] += rank[step:]
        rank = numbered(keys)
        reach += step
    return rank[:n]


def repeats_in(rows: np.ndarray, firsts: np.ndarray, counts: np.ndarray, texts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of the byte ranges of these phrases that are repeats of a window before them."""
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    ranks = suffix_classes(b"".join(texts), width)
    phrase = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    kind, row, place = ranks[begin[phrase] + within], rows[phrase], firsts[phrase] + within
    order = np.lexsort((place, row, kind))
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = kind[order[1:]] == kind[order[:-1]]
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(phrase[hit]) != 0)))
    last = np.append(np.flatnonzero(new)[1:], len(hit)) - 1
    return list(zip(row[hit[new]].tolist(), place[hit[new]].tolist(), (place[hit[last]] + width).tolist()))


def dictionary_ranges(entries: DataFrame, width: int) -> DataFrame:
    """row, start, end from phrases (h, row, first, n, bytes) whose owners have few distinct phrases each."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def ready(h: np.ndarray) -> int:
            """How many rows to sort now: the whole groups among SORT_ROWS, or the first if it has more; groups have SORTED_TOGETHER rows at most."""
            if len(h) <= SORT_ROWS:
                return 0
            starts = np.flatnonzero(h[1:] != h[:-1]) + 1
            within = starts[starts <= SORT_ROWS]
            return int(within[-1]) if len(within) else int(starts[0]) if len(starts) else 0

        def done(t: pa.Table) -> pa.RecordBatch:
            found = repeats_in(t["row"].to_numpy(), t["first"].to_numpy(), t["n"].to_numpy(), t["bytes"].to_pylist(), width) if len(t) else []
            columns = list(zip(*found)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "end"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while cut := ready(held["h"].to_numpy()):
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield done(held)

    dealt = entries.select("h", "row", "first", "n", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(settle, "row long, start long, end long")


def window_ranges(entries: DataFrame, width: int) -> DataFrame:
    """row, start, end from phrases of any number for one owner: windows meet by the hashes of the owner and of themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            keys: list[int] = []
            n = batch.column(3).to_numpy()
            for text, count in zip(batch.column(4).to_pylist(), n.tolist()):
                view = memoryview(text)
                keys += [xxhash.xxh3_64_intdigest(view[i : i + width]) for i in range(count)]
            h, row, first = (np.repeat(batch.column(i).to_numpy(), n) for i in range(3))
            place = first + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            w = np.array(keys, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, w, row, place)], ["h", "w", "row", "place"])

    windows = entries.select("h", "row", "first", "n", "bytes").mapInArrow(cut, "h long, w long, row long, place long")
    windows = written(windows, "windows", BATCH_BYTES)
    least = windows.groupBy("h", "w").agg(F.min(F.struct("row", "place")).alias("least"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    again = windows.join(least, ["h", "w"]).filter(F.struct("row", "place") > F.col("least"))
    return again.select("row", F.col("place").alias("start"), (F.col("place") + width).alias("end"))


def ordered_rows(docs: DataFrame) -> DataFrame:
    """docs with the column row: numbers in corpus order, doc_id itself where it is unique."""
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return written(docs.orderBy("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "ordered")


def repeated_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, start, end: byte ranges of docs (columns row, text) to remove; they may overlap."""
    owners = written(phrase_rows(docs, width).groupBy("h").agg(F.count("*").alias("n"), F.max("s").alias("s")).filter("n > 1 or s").select("h"), "owners", BATCH_BYTES)
    shared = written(phrase_rows(docs, width).join(owners, "h", "left_semi"), "phrases", BATCH_BYTES)
    firsts = written(shared.groupBy("h", "c").agg(F.min(F.struct("row", "first", "n")).alias("at"), F.max("s").alias("s")), "firsts")
    parse = shared.join(firsts, ["h", "c"]).filter(F.struct("row", "first") > F.struct("at.row", "at.first"))
    parse = parse.select("row", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("n") + F.lit(width - 1)).cast("long").alias("end"))

    mixed = firsts.groupBy("h").agg(F.count("*").alias("k"), F.max("s").alias("_s")).filter("k > 1 or _s").drop("_s")
    wanted = firsts.join(mixed, "h").groupBy("at.row").agg(F.collect_list(F.struct("h", "k", "at.first", "at.n")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for row, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(p["h"], p["k"], row, p["first"], p["n"], data[p["first"] : p["first"] + p["n"] + width - 1]) for p in parts]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "k", "row", "first", "n", "bytes"])

    entries = docs.select("row", "text").join(wanted, "row").mapInArrow(fetch, "h long, k long, row long, first int, n int, bytes binary")
    entries = written(entries, "dictionary", BATCH_BYTES)
    few = dictionary_ranges(entries.filter(F.col("k") <= SORTED_TOGETHER), width)
    many = window_ranges(entries.filter(F.col("k") > SORTED_TOGETHER), width)
    return parse.union(few).union(many)


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


ADDED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


def cut_texts(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text and any columns but row and _ranges) with each text as it is left, and ADDED."""
    numbered = ordered_rows(docs)
    ranges = written(repeated_ranges(numbered.select("row", "text"), width), "ranges", BATCH_BYTES)
    per_row = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    joined = numbered.join(per_row, "row", "left").select(*docs.columns, "_ranges")
    own = docs.columns
    names = [*own, *ADDED.names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows, left = [], []
            for text, ranges in zip(batch["text"], batch["_ranges"].to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = merged(ranges or [])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                left.append(kept.decode("utf-8", "ignore") if runs else text.as_py())
            columns = [pa.array(left, pa.string()) if c == "text" else batch[c] for c in own]
            columns += [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, [pa.int64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *ADDED.fields]))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for each row of docs."""
    return cut_texts(docs.select("doc_id", "text"), width).drop("text")


def cleaned_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with their columns, each text without its repeated bytes (what is left of a character that was
    cut apart goes too) and with its new n_chars, if there is such a column. Texts of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []
    cut = cut_texts(docs.select("doc_id", "text", *rest), width).filter("n_removed = 0 or length(text) > 0")
    new = {"n_chars": F.length("text").cast("long"), "doc_id": F.col("doc_id"), "text": F.col("text")}
    return cut.select(*[new.get(c, F.col("_rest")[c]).alias(c) if c in new or others else F.col(c) for c in docs.columns])
