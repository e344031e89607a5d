"""Operator 11: toxicity by a logistic classifier whose scores may not hang on who is mentioned.

A text's features are its distinct words and their letter n-grams, edges included, so that bent and compounded
forms of a word are known by what they share. The classifier is fitted on at most SAMPLE labelled rows, taken
by a hash of their ids: features by the likelihood ratio of their counts, weights by gradient steps on the log loss.
Counterfactual regularisation: in each sentence of those rows that mentions a group, the mention is swapped for
another group's and for a neutral word, and the squared difference of the two scores is added to the loss, so
that a group that labels happen to mention in toxic texts doesn't become evidence by itself. Scoring is one pass
over whole texts.

Defined results: null and empty texts have no features and get the score of the intercept; labels of one doc_id
that differ count as toxic; null labels and rows without doc_id are not learnt from, and the latter are not held
out; of repeated rows of a doc_id each counts; without any label of either kind the score is the share of toxic
ones among those there are, or 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

THRESHOLD = 0.3
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Features it may use; each in MIN_ROWS rows at least, with a likelihood ratio (G squared) of MIN_RATIO against chance.
FEATURES = 4096
MIN_ROWS, MIN_RATIO = 3, 15.0
#: Swapped sentences, at most.
PAIRS = 20_000
#: Letters of an n-gram.
GRAMS = (4, 5)
RIDGE = 1e-4
STRENGTH = 4.0
STEPS, RATE = 250, 0.1
#: Words whose features a task keeps.
KEPT_WORDS = 200_000

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Terms for groups, by kind and language; the first of each is the neutral word.
IDENTITIES = (
    ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("people", "women", "men", "girls", "boys", "gays", "lesbians", "bisexuals", "immigrants", "refugees", "foreigners"),
    ("someone", "gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"),
    ("believer", "christian", "muslim", "jew", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("human", "black", "white", "asian", "african", "european", "american", "latino", "arab", "indian", "chinese", "jewish", "islamic", "disabled", "blind", "deaf"),
    ("mensch", "frau", "mann", "ausländer", "flüchtling", "christ", "muslim", "jude", "schwarzer", "weißer"),
    ("menschen", "frauen", "männer", "schwule", "lesben", "ausländer", "flüchtlinge", "christen", "muslime", "juden"),
    ("personne", "femme", "homme", "chrétien", "musulman", "juif", "étranger", "réfugié"),
    ("personnes", "femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers", "réfugiés"),
    ("persona", "mujer", "hombre", "cristiano", "musulmán", "judío", "extranjero", "refugiado"),
    ("personas", "mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "refugiados"),
)
SWAPS = {term: (kind[1 + (i + 1) % (len(kind) - 1)], kind[0]) for kind in IDENTITIES for i, term in enumerate(kind[1:])}


def features_of(word: str) -> set[str]:
    whole = f"^{word}$"
    return {whole} | {whole[i : i + n] for n in GRAMS for i in range(len(whole) - n + 1)}


class Known(dict):
    """The places of a word's features among the classifier's; made when a word is first asked for."""

    def __init__(self, places: dict[str, int]) -> None:
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = tuple(p for f in features_of(word) if (p := self.places.get(f)) is not None)
        return found

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            found.update(self[word])
        return sorted(found)


def swapped(sentence: str) -> list[str]:
    """The lower-cased sentence with its group terms swapped, for another group each and for the neutral word; none if it has none."""
    if not any(w in SWAPS for w in WORD.findall(sentence)):
        return []
    return [WORD.sub(lambda m: SWAPS[m[0]][k] if m[0] in SWAPS else m[0], sentence) for k in (0, 1)]


@dataclass(frozen=True)
class Classifier:
    places: dict[str, int]
    weights: np.ndarray
    intercept: float

    def score(self, places: list[int]) -> float:
        return float(logistic(self.weights[places].sum() + self.intercept))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """_key, _toxic, _text of the rows that the classifier may learn from; the ids are bounded, so the texts aren't shuffled."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    chosen = told.withColumn("_key", F.xxhash64("_id")).orderBy("_key", "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    return written(texts.join(F.broadcast(chosen), "_id").select("_key", "_toxic", "_text"), "labelled")


def feature_counts(sample: DataFrame) -> DataFrame:
    """_feature and the rows that have it: toxic and all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list({**found[0], **found[1]})
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in found]], names=["_feature", "_clean", "_toxic"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: set[str] = set()
                for word in set(WORD.findall((text.as_py() or "").lower())):
                    own |= features_of(word)
                found[toxic].update(own)
                if len(found[0]) + len(found[1]) > 500_000:
                    yield out()
                    found = (Counter(), Counter())
        if found[0] or found[1]:
            yield out()

    parts = sample.select("_toxic", "_text").mapInArrow(count, "_feature string, _clean long, _toxic long")
    return parts.groupBy("_feature").agg(F.sum("_clean").alias("_clean"), F.sum("_toxic").alias("_toxic"))


def chosen_features(sample: DataFrame, clean: int, toxic: int, most: int) -> dict[str, int]:
    """The features whose counts are the least likely by chance, at most `most`."""
    t, c, n = F.col("_toxic"), F.col("_clean"), clean + toxic
    has = t + c
    cells = ((t, has * toxic / n), (c, has * clean / n), (toxic - t, (n - has) * toxic / n), (clean - c, (n - has) * clean / n))
    ratio = sum((F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))
    found = feature_counts(sample).filter(has >= MIN_ROWS).withColumn("_ratio", ratio).filter(F.col("_ratio") >= MIN_RATIO)
    return {r["_feature"]: i for i, r in enumerate(found.orderBy(F.desc("_ratio"), "_feature").limit(most).select("_feature").collect())}


def vectors(sample: DataFrame, places: dict[str, int]) -> DataFrame:
    """_key, _kind (0 clean, 1 toxic, 2 a sentence and its swapped form), _a and _b (places of features)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(places)
        for batch in batches:
            out: list[tuple] = []
            for key, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((key, toxic, known.of(text), []))
                for sentence in SENTENCE.findall((text or "").lower()):
                    for other in swapped(sentence):
                        a, b = known.of(sentence), known.of(other)
                        if a != b:
                            out.append((key, 2, a, b))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["_key", "_kind", "_a", "_b"])

    return sample.mapInArrow(read, "_key long, _kind int, _a array<int>, _b array<int>")


class Rows:
    """Sets of features, one a row."""

    def __init__(self, lists: pa.ChunkedArray) -> None:
        whole = lists.combine_chunks()
        self.n = len(whole)
        self.row = np.repeat(np.arange(self.n), whole.value_lengths().to_numpy())
        self.place = whole.flatten().to_numpy()

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.place, values[self.row], size)


def fit_weights(rows: Rows, toxic: np.ndarray, before: Rows, after: Rows, size: int, strength: float) -> tuple[np.ndarray, float]:
    """Weights and intercept: log loss, a ridge, and strength times the mean squared difference of scores over swapped pairs."""
    w = np.zeros(size + 1)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        off = (logistic(rows.times(w[:-1]) + w[-1]) - toxic) / max(1, rows.n)
        slope = np.append(rows.back(off, size) + RIDGE * w[:-1], off.sum())
        if strength and before.n:
            p, q = (logistic(x.times(w[:-1]) + w[-1]) for x in (before, after))
            gap = 2 * strength * (p - q) / before.n
            left, right = gap * p * (1 - p), -gap * q * (1 - q)
            slope += np.append(before.back(left, size) + after.back(right, size), left.sum() + right.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def bounded(rows: DataFrame, most: int) -> pa.Table:
    """rows in the order of their keys; of more than `most`, as repeated rows of an id may make them, those that come first by a hash."""
    if rows.count() > most:
        rows = rows.orderBy("_key", F.xxhash64("_a", "_b")).limit(most)
    return rows.toArrow().sort_by("_key")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, strength: float = STRENGTH) -> Classifier:
    """The classifier of the labelled rows that aren't held out."""
    rows = sample_rows(docs, labels, sample)
    counts = dict(rows.groupBy("_toxic").agg(F.count("*")).collect())
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return Classifier({}, np.zeros(0), 60.0 if toxic else -60.0)
    places = chosen_features(rows, clean, toxic, FEATURES)
    found = written(vectors(rows, places), "vectors")
    own, pairs = (bounded(found.filter(c), n) for c, n in (("_kind < 2", sample), ("_kind = 2", PAIRS)))
    weights, intercept = fit_weights(Rows(own["_a"]), own["_kind"].to_numpy().astype(float), Rows(pairs["_a"]), Rows(pairs["_b"]), len(places), strength)
    return Classifier(places, weights, intercept)


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of each row of docs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(classifier.places)
        for batch in batches:
            scores = [classifier.score(known.of(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
