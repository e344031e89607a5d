"""Operator 6: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Items and texts are read as grams of three words, in a row or with one of four left out, so that a copy of which each
third word is another still shares some. A filter of bounded size, which holds the grams of all items, goes to the
tasks, so that of a text only grams that an item may hold are kept. Their counts over all texts make the seeds: of
each two neighbouring grams of an item the rarer, so common phrases start little; what many items share, such as the
stem of a question, starts nothing unless it is half of the item. A join on the seeds pairs texts with items, and
each pair is aligned locally around the grams it shares, so edited and paraphrased copies score by what they have in
common; a literal quotation of RUN words counts whatever its share of the item. Neither texts nor items go through the
driver, and only texts that a second filter takes for candidates are shuffled.

Defined results: null and empty texts and items of fewer than NGRAM words match nothing; each row of
docs, and each row of the benchmark, reports for itself, but items without item_id or text are left out;
ties of the score go to the place that comes first; empty tables give an empty result; other columns are
ignored or, where documents are returned, passed through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, written

NGRAM = 3
#: Which words from its first on a gram takes.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Words of an item in a row that are a leak by themselves.
RUN = 13
#: A gram of more items than this is common to them.
STEM_ITEMS = 8
#: The score is that of the best local alignment over that of the whole item aligned to itself.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Grams of the item that a passage must share before it is aligned.
SHARED = 2
#: Bits of the filter for each n-gram of the items, and at most (8 MB). A full filter only lets more n-grams reach the join.
FILTER_BITS = 64
MOST_FILTER_BITS = 1 << 26
#: Characters of items that stand beside a text in one row; a text with more gets more rows.
ITEM_CHARS = 1 << 18
#: Rows of equal texts are dealt over this many parts of the join.
PARTS = 8
#: Words whose hashes a task keeps.
KEPT_WORDS = 500_000
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Hashes(dict):
    """The hash of each word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.array([self[w] for w in words_of(text)], dtype=np.uint64)


def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each gram, its first word's place, and its shape."""
    hashes, places, shapes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int32)]
    for k, shape in enumerate(SHAPES):
        n = len(words) - shape[-1]
        if n > 0:
            out = np.full(n, k, dtype=np.uint64)
            for j in shape:
                out = (out ^ words[j : j + n]) * ODD
                out ^= out >> np.uint64(29)
            hashes.append(out)
            places.append(np.arange(n, dtype=np.int32))
            shapes.append(np.full(n, k, dtype=np.int32))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(shapes)


def item_grams(items: DataFrame) -> DataFrame:
    """item, at, shape, gram of all grams of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, at, shape = grams_of(hashes.of(text.as_py()))
                columns = [pa.array(np.full(len(grams), item), pa.int64()), pa.array(at), pa.array(shape), pa.array(grams.view(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "at", "shape", "gram"])

    return items.select("item", "text").mapInArrow(cut, "item long, at int, shape int, gram long")


def filter_of(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the n-grams with two slots for each, as 64-bit words: two to the power that gives FILTER_BITS
    for each n-gram, MOST_FILTER_BITS at most, which bounds what is gathered and sent."""
    bits = 1 << 12
    wanted = min(MOST_FILTER_BITS, FILTER_BITS * grams.count())
    while bits < wanted:
        bits *= 2
    slots = grams.select(F.explode(F.array(F.expr(f"gram & {bits - 1}L"), F.expr(f"shiftrightunsigned(gram, 32) & {bits - 1}L"))).alias("slot"))
    words = slots.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63L as int))")).alias("ones")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["ones"].to_numpy()
    return out.view(np.uint64)


def may_hold(ones: np.ndarray, grams: np.ndarray) -> np.ndarray:
    last = np.uint64(64 * len(ones) - 1)

    def set_at(slots: np.ndarray) -> np.ndarray:
        return (ones[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1

    return set_at(grams & last) & set_at((grams >> np.uint64(32)) & last)


def shared_grams(texts: DataFrame, ones: np.ndarray) -> DataFrame:
    """key, gram: for each row of texts (key, text) its distinct n-grams that the filter lets through."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found, owners = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for k, text in enumerate(batch.column(1)):
                grams = grams_of(hashes.of(text.as_py()))[0]
                hit = np.unique(grams[may_hold(ones, grams)])
                found.append(hit)
                owners.append(np.full(len(hit), k))
            keys = batch.column(0).take(pa.array(np.concatenate(owners), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found).view(np.int64), pa.int64())], ["key", "gram"])

    return texts.select("key", "text").mapInArrow(probe, "key binary, gram long")


def rare_seeds(grams: DataFrame, hits: DataFrame) -> DataFrame:
    """item, gram: of each two neighbouring grams of an item that which fewer texts hold, the first of equals; a lone one is a seed.
    Of an item that is for the most part its own, what it shares with STEM_ITEMS others and more is none."""
    counts = hits.groupBy("gram").agg(F.count("*").alias("n"))  # before any join, so a common gram is summed where it is
    holders = grams.groupBy("gram").agg(F.count_distinct("item").alias("items"))
    counted = grams.join(holders, "gram").join(counts, "gram", "left").na.fill(0, ["n"])
    line, whole = Window.partitionBy("item", "shape").orderBy("at"), Window.partitionBy("item")
    stem = F.col("items") > STEM_ITEMS
    before, after = F.lag("n").over(line), F.lead("n").over(line)
    told = counted.withColumns({"before": before, "after": after, "stems": F.count_if(stem).over(whole), "all": F.count("*").over(whole)})
    chosen = (F.col("n") <= F.col("after")) | (F.col("n") < F.col("before")) | (F.col("before").isNull() & F.col("after").isNull())
    # Half of the score takes half of the words, so a copy of an item that is less than half stem holds more than the stem.
    return told.filter(chosen & (~stem | (2 * F.col("stems") >= F.col("all")))).select("item", "gram").distinct()


def items_by_text(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """key, items: the items to align with a text, in lists of ITEM_CHARS characters and one more item at most."""
    line = Window.partitionBy("key").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = pairs.join(items, "item").withColumn("part", F.floor(F.sum(F.length("text") + 64).over(line) / ITEM_CHARS))
    return sized.groupBy("key", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items")).drop("part")


def regions(hits: list[tuple], m: int) -> Iterator[list[tuple]]:
    """Hits in order of their place, parted where the next is further than an item away."""
    part: list[tuple] = []
    for h in sorted(hits):
        if part and h[0] - part[-1][0] > m:
            yield part
            part = []
        part.append(h)
    if part:
        yield part


def aligned(query: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and how many words of query and of words there are up to its end."""
    index = np.arange(len(words) + 1) * -GAP
    row = np.zeros(len(words) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, q in enumerate(query, 1):
        reach = np.zeros_like(row)
        reach[1:] = np.maximum(row[:-1] + np.where(words == q, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(reach, 0, out=reach)
        row = np.maximum.accumulate(reach + index) - index
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best


def located(query: np.ndarray, words: np.ndarray, offset: int) -> tuple[int, int, int]:
    """The best score, and the first and end word of its place."""
    score, i, j = aligned(query, words)
    if score <= 0:
        return 0, 0, 0
    _, _, back = aligned(query[:i][::-1], words[:j][::-1])
    return score, offset + j - back, offset + j


def longest_run(hits: list[tuple]) -> int:
    """Words in a row that text and item have in common, from hits (place, own place, gram) of the first shape."""
    best = run = 0
    last = None
    for line, own in sorted({(place - own, own) for place, own, _ in hits}):
        run = run + 1 if last == (line, own - 1) else 1
        last, best = (line, own), max(best, run)
    return best + NGRAM - 1 if best else 0


def passages(words: np.ndarray, queries: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, float, int, int]]:
    """(item_id, score, first word, end word) of each item of queries with a passage in words that has MIN_SCORE at least or RUN words in a row."""
    (grams, at_word, _), wanted = grams_of(words), [grams_of(q) for _, q in queries]
    shared = np.flatnonzero(np.isin(grams, np.concatenate([w[0] for w in wanted])))
    places: dict[int, list[int]] = defaultdict(list)
    for place, gram in zip(at_word[shared].tolist(), grams[shared].tolist()):
        places[gram].append(place)
    for (item, query), (own_grams, own_at, shapes) in zip(queries, wanted):
        m, best, run = len(query), (0, 0, 0), 0
        hits = [(place, own, gram, shape) for gram, own, shape in zip(own_grams.tolist(), own_at.tolist(), shapes.tolist()) for place in places.get(gram, ())]
        for region in regions(hits, m):
            if len({h[2] for h in region}) < min(SHARED, len(own_grams)):
                continue
            low = max(0, min(h[0] - h[1] for h in region) - m // 2)
            high = min(len(words), max(h[0] - h[1] for h in region) + m + m // 2)
            best = max(best, located(query, words[low:high], low), key=lambda b: b[0])
            run = max(run, longest_run([h[:3] for h in region if h[3] == 0]))
        if best[0] >= MIN_SCORE * MATCH * m or run >= RUN:
            yield item, best[0] / (MATCH * m), best[1], best[2]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def on_key(rows: DataFrame, other: DataFrame) -> DataFrame:
    """rows (key, part from 0 to PARTS - 1) joined with other (key): the rows of one text are dealt over PARTS parts."""
    dealt = other.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    return rows.join(dealt.hint("merge"), ["key", "part"])


def likely(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of keys (binary) that lets all of `keys` (key) and few others through; its filter is of bounded size."""
    ones = filter_of(keys.select(F.xxhash64("key").alias("gram")))

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(ones, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    return lambda key: test(F.xxhash64(key))


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, score, first_word, end_word for each row of docs and item whose passage it holds; key is the text's."""
    known = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(known.withColumn("item", F.monotonically_increasing_id()), "leak_items")
    grams = written(item_grams(items), "leak_grams")
    text = F.col("text").cast("string")
    rows = docs.select(text_key(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("text != ''")
    hits = written(shared_grams(rows, filter_of(grams)), "leak_hits")
    pairs = hits.join(rare_seeds(grams, hits), "gram").select("key", "item").distinct()
    lists = written(items_by_text(pairs, items), "leak_pairs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for key, doc, text, entries in zip(*(batch.column(i) for i in range(4))):
                queries = [(e["item_id"], hashes.of(e["text"])) for e in entries.as_py()]
                out += [(key.as_py(), doc.as_py(), *hit) for hit in passages(hashes.of(text.as_py()), queries)]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            names = ["key", "doc_id", "item_id", "score", "first_word", "end_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    # Of the other texts only the keys are read.
    met = on_key(dealt.filter(likely(lists.select("key").distinct())(F.col("key"))), lists).select("key", "doc_id", "text", "items")
    return met.mapInArrow(align, "key binary, doc_id long, item_id long, score double, first_word int, end_word int")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for each document and item whose passage it holds."""
    return found(docs, benchmark).drop("key")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage."""
    leaked = written(found(docs, benchmark).select("key").distinct(), "leaked")
    key, part, maybe = (free_name(docs, name) for name in ("_key", "_part", "_maybe"))
    marked = docs.withColumn(key, text_key(F.col("text")))
    marked = marked.withColumn(maybe, F.coalesce(likely(leaked)(F.col(key)), F.lit(False)))
    dealt = marked.filter(maybe).withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    named = leaked.select(F.col("key").alias(key), F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias(part))
    # Only what may be a leak is shuffled; the rest stays where it is.
    rest = marked.filter(~F.col(maybe)).select(*docs.columns)
    return rest.unionByName(dealt.join(named, [key, part], "left_anti").select(*docs.columns))
