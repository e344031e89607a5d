"""Operator 13: ranked lexical search by dense blocked matrix products.

The terms of the items make a vocabulary. One pass over the texts counts all their terms, for the
lengths, and those of the vocabulary, which are written as short lists; counts by term give the weights.
Then tasks turn documents into dense tiles of impacts (a vocabulary tile times a document tile) and multiply
them with the items' weighted terms. Products and sums are whole numbers in float64: vocabulary tiles end
before a sum could reach 2^53, so each product is exact, and tiles are added up in 64-bit integers. Of each
tile the best documents of every item are kept with their ties broken by doc_id, then those of each task,
then those of all.

Items are taken in blocks of ITEMS items, each with its own pass, so what a task holds is bounded.

Defined results: a null or empty text has no terms and is no result; an item without terms gives no rows;
every row of docs is a document and every row of items an item, so repeated rows repeat in the result;
equal scores go by doc_id, a null one last; no item or no document gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

TOP = 20
#: Items of a block.
ITEMS = 1024
#: Documents and terms of a tile (8 MB).
TILE_DOCS, TILE_TERMS = 1024, 1024
EXACT = 1 << 53
#: An impact is below this, whatever the counts.
MOST_IMPACT = 1_000_000
#: Part of a term: digits, ASCII letters in lower case, and all of UTF-8 beyond ASCII; the rest becomes a blank.
TERM_BYTES = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), ids and tfs (those of known) of each document that has a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, ends, places, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = terms_of(text.as_py() or b"")
                if words:
                    found = Counter(map(known.get, words))
                    found.pop(None, None)
                    ids.append(doc.as_py())
                    ns.append(len(words))
                    places += found.keys()
                    tfs += found.values()
                    ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((places, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<long>")


def vocabulary_tiles(bounds: list[int]) -> list[tuple[int, int]]:
    """Ranges of terms, of TILE_TERMS at most, in which the bounds of the products sum to less than 2^53. One product alone is
    always below it."""
    out, start, total = [], 0, 0
    for i, b in enumerate(bounds):
        if i > start and (i - start == TILE_TERMS or total + b >= EXACT):
            out.append((start, i))
            start, total = i, 0
        total += b
    return [*out, (start, len(bounds))] if bounds else []


def best_of(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the top highest scores above 0, equal ones by ids."""
    good = np.flatnonzero(scores > 0)
    if len(good) > top:
        edge = np.partition(scores[good], len(good) - top)[len(good) - top]
        good = good[scores[good] >= edge]
    return good[np.lexsort((ids[good], -scores[good]))[:top]]


class Ranking:
    """The best documents of each item so far."""

    def __init__(self, weighted: np.ndarray, tiles: list[tuple[int, int]], mean: tuple[int, int], top: int) -> None:
        self.weighted, self.tiles, (self.documents, self.length), self.top = weighted, tiles, mean, top
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none) for _ in range(weighted.shape[0])]
        self.dense = np.zeros((TILE_TERMS, TILE_DOCS))

    def add(self, ids: np.ndarray, order: np.ndarray, n: np.ndarray, columns: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """A tile of documents: ids with nulls as the last of `order`, lengths, and (column, term, tf) triples."""
        m = 75 + (25 * n * self.documents) // self.length
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[columns])
        by_term = np.argsort(terms, kind="stable")
        columns, terms, impact = columns[by_term], terms[by_term], impact[by_term]
        scores = np.zeros((self.weighted.shape[0], len(ids)), np.int64)
        for a, b in self.tiles:
            i, j = np.searchsorted(terms, (a, b))
            if i < j:
                tile = self.dense[: b - a, : len(ids)]
                tile[terms[i:j] - a, columns[i:j]] = impact[i:j]
                scores += (self.weighted[:, a:b] @ tile).astype(np.int64)
                tile[terms[i:j] - a, columns[i:j]] = 0
        for k, (had, had_ids, had_order) in enumerate(self.best):
            row = scores[k]
            # Once an item has all its places, most tiles hold nothing for it.
            if row.max(initial=0) > 0 and (len(had) < self.top or row.max() >= had[-1]):
                at = best_of(row, order, self.top)
                both = [np.concatenate(x) for x in ((had, row[at]), (had_ids, ids[at]), (had_order, order[at]))]
                keep = best_of(both[0], both[2], self.top)
                self.best[k] = tuple(x[keep] for x in both)


def search_block(docs: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    """_item (place in texts), doc_id, score: the best of each task."""
    wanted = [Counter(terms_of(t)) for t in texts]
    known = {t: i for i, t in enumerate(sorted(set(itertools.chain.from_iterable(wanted))))}
    counted = written(term_counts(docs, known), "terms")
    total = counted.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    documents, length = total["N"], total["L"] or 1
    df = {r["id"]: r["n"] for r in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect()}
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(known))]
    entries = [(k, known[t], n) for k, c in enumerate(wanted) for t, n in c.items()]
    most: Counter[int] = Counter()
    for _, i, n in entries:
        most[i] = max(most[i], n)
    tiles = vocabulary_tiles([most[i] * max(1, weights[i]) * MOST_IMPACT for i in range(len(known))])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = np.zeros((len(texts), len(known)))
        for k, i, n in entries:
            weighted[k, i] = n * weights[i]
        ranking = Ranking(weighted, tiles, (documents, length), top)
        for whole in batches:
            for start in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(start, TILE_DOCS)
                ids, n, places, tfs = batch.columns
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                numbers = ids.fill_null(0).to_numpy()
                # A null doc_id is ordered behind all others and told apart by its place there.
                order = np.where(missing, np.iinfo(np.int64).max, numbers)
                numbers = np.where(missing, np.iinfo(np.int64).min, numbers)
                sizes = places.value_lengths().to_numpy()
                ranking.add(numbers, order, n.to_numpy(), np.repeat(np.arange(len(sizes)), sizes), places.flatten().to_numpy(), tfs.flatten().to_numpy())
        item = np.repeat(np.arange(len(texts)), [len(b[0]) for b in ranking.best])
        scores, found, order = (np.concatenate([b[k] for b in ranking.best]) if ranking.best else np.zeros(0, np.int64) for k in range(3))
        null = (found == np.iinfo(np.int64).min) & (order == np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(found, pa.int64(), mask=null), pa.array(scores, pa.int64())], names=["_item", "doc_id", "score"])

    return counted.select("doc_id", "n", "ids", "tfs").mapInArrow(rank, "_item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the top documents of each item."""
    out = None
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).toLocalIterator(prefetchPartitions=False)
    spark = docs.sparkSession
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    kind = items.schema["item_id"].dataType.simpleString()
    while held := list(itertools.islice(rows, block)):
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(held)], f"_item int, item_id {kind}")
        found = search_block(docs, [bytes(r["text"]) for r in held], top)
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        mine = ranked.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score")
        out = mine if out is None else out.unionByName(mine)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


ORACLE = r"""
with tokens as (
    select 'd' as side, row_number() over () as place, doc_id as id, text from documents
    union all
    select 'i', row_number() over (), item_id, text from benchmark),
terms as (
    select side, place, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from tokens),
tf as (select side, place, id, term, count(*) as tf from terms group by all),
lengths as (select place, sum(tf)::bigint as n from tf where side = 'd' group by place),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
df as (select term, count(*) as df from tf where side = 'd' group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, whole),
sizes as (select place, 75 + (25 * n * docs) // total as m from lengths, whole),
scored as (
    select i.place as item, i.id as item_id, d.place, d.id as doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m)))::bigint as score
    from tf i join tf d on i.side = 'i' and d.side = 'd' and i.term = d.term join weights on weights.term = i.term join sizes on sizes.place = d.place
    group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
