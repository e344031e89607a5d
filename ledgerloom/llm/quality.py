"""Operator 3: quality rules by weak supervision, with DataFrame functions alone.

Base measures of each text; rules that vote good (1), bad (0) or abstain (null); accuracies of the
rules by expectation-maximisation over the counts of all vote patterns (at most 3 to the power of the
number of rules, so their table is bounded however many documents there are); and the posterior
probability of good for each document, as a sum of the rules' log odds.

Defined results: a null or blank text has no words, fails the base rule and is not kept; repeated rows
are judged alike; ties of the posterior at the threshold keep the document; an empty table gives an
empty result; other columns pass through where the operator returns documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, SPACES, free_name, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50
THRESHOLD = 0.5
ROUNDS = 100


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' hashes are sorted with their positions in the low bits. A window is compared word by word
    with all others of a run of equal hashes, which are few unless they are equal windows: then the
    neighbours decide, so the runs are looked through only where a neighbour differs.
    """

    def windows(mask: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
        )

        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def same_hash(x: Column, y: Column) -> Column:
            return F.coalesce(x.bitwiseOR(mask) == y.bitwiseOR(mask), F.lit(False))

        def same(x: Column, y: Column) -> Column:
            p, q = place(x), place(y)
            return F.coalesce((F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2)), F.lit(False))

        def found(s: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                before, after = F.get(s, i - 1), F.get(s, i + 1)
                by_neighbours = (same_hash(x, before) & same(x, before)) | (same_hash(x, after) & same(x, after))
                run = same_hash(x, before) | same_hash(x, after)
                return F.when(by_neighbours, True).when(run, F.exists(s, lambda y: (x != y) & same_hash(x, y) & same(x, y))).otherwise(False)

            return F.sort_array(F.transform(F.filter(s, again), lambda x: x.bitwiseAND(mask)))

        def covered(at: Column) -> Column:
            own = F.transform(at, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(F.sort_array(keys), found), covered)

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(mask, windows))


def measures(text: Column) -> Column:
    """A struct of the base measures and the figures that only the rules read."""
    words = F.filter(F.split(F.btrim(text, F.lit(SPACES)), SPACE_CLASS + "+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w, F.size(w)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shouted"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r\p{L}\p{M}.,;:'’-]+")).cast("long").alias("n_odd"),
        (F.length(text) - F.length(F.translate(text, ".,;:", ""))).cast("long").alias("n_stops"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_upper", "n_odd", "n_stops")


def with_measures(docs: DataFrame, name: str) -> DataFrame:
    """docs with the struct column `name` of MEASURES."""
    m = measures(F.coalesce(F.col("text").cast("string"), F.lit("")))
    flat = let(m, lambda x: F.struct(*[x["w"][k].alias(k) if k in ("n_words", "n_repeat_words", "n_shouted") else x["l"][k].alias(k) if k in ("n_lines", "n_dup_lines") else x[k].alias(k) for k in MEASURES]))
    return docs.withColumn(name, flat)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEATED_PERCENT * q["n_words"])


def votes(q: Column) -> dict[str, Column]:
    """1 good, 0 bad, null abstains. A rule that looks for one kind of junk abstains where it finds none;
    good votes come from rules that junk of most kinds fails."""
    words = F.greatest(q["n_words"], F.lit(1))
    chars = F.greatest(q["word_chars"], F.lit(1))
    length = q["word_chars"] / words

    def by(value: Column, good: float, bad: float) -> Column:
        return F.when(value > bad, 0).when(value <= good, 1)

    return {
        "symbols": by(q["n_symbols"] / words, 0.02, 0.2),
        "plain_words": by(q["n_odd"] / words, 0.05, 0.3),
        "shouting": F.when(q["n_shouted"] / words > 0.1, 0),
        "capitals": by(q["n_upper"] / chars, 0.15, 0.4),
        "repeats": F.when(q["n_repeat_words"] / words > 0.3, 0),
        "lines": F.when(q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(3)) > 0.3, 0),
        "word_length": F.when((length < 2.5) | (length > 12), 0),
        "punctuation": F.when(q["n_stops"] / words < 0.01, 0).when(q["n_stops"] / words >= 0.05, 1),
    }


def fit(patterns: Mapping[tuple[int | None, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and each rule's (accuracy on good, on bad) from counts of vote patterns.

    Expectation-maximisation from the majority vote, with one imagined right and wrong vote for each
    rule and class; accuracies stay above one half, so the classes can't change places.
    """
    n = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    share, right = 0.5, [(0.8, 0.8)] * n
    for _ in range(rounds if total else 0):
        good = 1.0
        sums = [[1.0, 2.0, 1.0, 2.0] for _ in range(n)]
        for votes_, count in patterns.items():
            p = posterior(share, right, votes_)
            good += p * count
            for s, v in zip(sums, votes_):
                if v is not None:
                    s[0] += p * count * v
                    s[1] += p * count
                    s[2] += (1 - p) * count * (1 - v)
                    s[3] += (1 - p) * count
        share = min(0.99, max(0.01, good / (total + 2)))
        right = [(min(0.995, max(0.55, a / b)), min(0.995, max(0.55, c / d))) for a, b, c, d in sums]
    return share, right


def weights(share: float, right: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds: of good at the start, and for each rule of a good and of a bad vote."""
    return math.log(share / (1 - share)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in right]


def posterior(share: float, right: list[tuple[float, float]], votes_: tuple[int | None, ...]) -> float:
    start, own = weights(share, right)
    x = start + sum((w[0] if v else w[1]) for w, v in zip(own, votes_) if v is not None)
    return 1 / (1 + math.exp(-x))


def verdicts(measured: DataFrame, name: str, threshold: float = THRESHOLD) -> Column:
    """A struct of base_failed, quality (the posterior) and kept for a materialised table with the measures in `name`."""
    q = F.col(name)
    rules = votes(q)
    # Fitted on the documents that pass the base rule, as the others are settled by it.
    counted = measured.filter(~base_failed(q)).select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).agg(F.count("*").alias("_n"))
    patterns = {tuple(r[k] for k in rules): r["_n"] for r in counted.collect()}
    start, own = weights(*fit(patterns)) if patterns else (0.0, [(0.0, 0.0)] * len(rules))
    odds = F.lit(start)
    for vote, (good, bad) in zip(rules.values(), own):
        odds = odds + F.when(vote == 1, F.lit(good)).when(vote == 0, F.lit(bad)).otherwise(F.lit(0.0))
    likely = 1 / (1 + F.exp(-odds))
    return F.struct(base_failed(q).alias("base_failed"), likely.alias("quality"), (~base_failed(q) & (likely >= threshold)).alias("kept"))


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, quality and kept for each row of docs."""
    measured = written(with_measures(docs.select("doc_id", "text"), "_q").select("doc_id", "_q"), "quality")
    return measured.select("doc_id", "_q.*", verdicts(measured, "_q", threshold).alias("_v")).select("doc_id", *MEASURES, "_v.*")


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with their columns. They are written once with their measures, so
    that no text is judged twice or shuffled."""
    name = free_name(docs, "_q")
    measured = written(with_measures(docs, name), "quality")
    return measured.filter(verdicts(measured, name, threshold)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
