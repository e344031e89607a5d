"""Concepts and parties of movements.

Descriptions repeat, so the pattern chains run once for each distinct description and side and are
joined back by them. A few user rules are one CASE, many are
found by pieces of text that they need; parties are unified by the
words and pairs of words that names share, so that common first names don't bring all their bearers together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import canon, party_key, without_words, words_pattern
from ledgerloom.plans import taxonomy as t
from ledgerloom.sources.shared import written


@dataclass(frozen=True)
class Rule:
    """A user's correction: where pattern is found in a description, its party and its concept, if stated."""

    pattern: str
    party: str | None = None
    concept: str | None = None


def cases(branches: Sequence[tuple[Column, Column]]) -> Column:
    """One flat CASE; nested ones make plans that take long to optimise."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out


def first_match(text: Column, patterns: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    return cases([(text.rlike("(?U)" + pattern), F.lit(name)) for name, pattern in patterns]).otherwise(otherwise)


def concept_of(key: Column, side: Column) -> Column:
    """From the canonical description and the side (INGRESO or EGRESO)."""
    coming = first_match(key, t.IN_CONCEPTS, F.lit(t.OTHER_IN))
    going = first_match(key, t.OUT_CONCEPTS, F.lit(t.OTHER_OUT))
    return F.when(side == "INGRESO", coming).otherwise(going)


def entity_of(key: Column) -> Column:
    each = cases([(key.rlike(words_pattern((name,))), F.lit(name)) for name in sorted(t.KNOWN_ENTITIES, key=len, reverse=True)])
    return F.when(key.rlike(words_pattern(t.KNOWN_ENTITIES)), each)


def bare_name(key: Column) -> Column:
    """What is left of a canonical description without codes, operation words, places and connectors; empty if nothing."""
    text = F.regexp_replace(key, r"(?U)\b\d[\d\-.]{2,}\b", " ")
    text = F.regexp_replace(text, r"(?U)\b\d+\b", " ")
    text = without_words(text, t.OPERATION_WORDS)
    text = F.regexp_replace(text, r"(?U)(?<!\w)(?:" + "|".join(t.CUT_WORDS) + r")\w*", " ")
    text = without_words(text, t.PLACE_WORDS)
    text = F.regexp_replace(text, r"(?U)[^\w\s&.]", " ")
    # Signs at the edges of words, then connectors at the edges of the name, then single letters.
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(text, r"(?<=^|\s)[.\-_&]+|[.\-_&]+(?=\s|$)", ""), r"\s+", " ")), F.lit(" "))
    edge = "(?:" + "|".join(t.CONNECTORS) + ")"
    text = F.regexp_replace(text, rf"^(?: {edge}(?= ))+", "")
    text = F.regexp_replace(text, rf"(?:(?<= ){edge} )+$", "")
    text = F.regexp_replace(text, r"(?<= )\S(?= )", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def party_of(key: Column, concept: Column) -> Column:
    """C2."""
    name = bare_name(key)
    return (
        F.when(concept.isin(*t.BANK_CONCEPTS), t.OWN_BANK)
        .when(key == "", t.UNKNOWN_PARTY)
        .otherwise(F.coalesce(entity_of(key), F.when(F.length(name) >= 3, name), F.lit(t.UNKNOWN_PARTY)))
    )


def rule_pattern(pattern: str) -> str:
    """Without accents, and matched in either case; classes such as \\d keep their meaning."""
    return "(?iU)" + plain_pattern(pattern)


def plain_pattern(pattern: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", pattern) if not unicodedata.combining(c))


def rule_values(key: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Party and concept of the first rule found, null where it states none or none is found."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    found = [(key.rlike(rule_pattern(r.pattern)), r) for r in rules]
    return tuple(cases([(hit, F.lit(value(r)).cast("string")) for hit, r in found]) for value in (lambda r: r.party, lambda r: r.concept))


#: Letters of the pieces by which many rules find the descriptions that they may match.
PIECE = 3
#: Up to so many rules are one CASE; beyond, each would be tried on each description.
CHAIN = 200


#: What a pattern is made of, as far as it matters here: an escape, a class, a quantifier that may leave out what is before it, another sign.
PATTERN_PART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[?*]|\{[^}]*\}|.", re.DOTALL)
PLAIN = " -_,;:/&%#@!=<>~'\""


def needed_texts(pattern: str) -> list[str]:
    """For each part of a pattern between its outermost bars the longest text that it can't match without, in upper case;
    empty if none is certain. Groups and classes, and whatever may be absent, count as unknown."""
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return [""]
    texts, longest, run, depth = [], "", "", 0
    for part in PATTERN_PART.findall(pattern) + ["|"]:
        escaped = len(part) == 2 and part[0] == "\\" and part.isascii() and not part[1].isalnum()
        if not depth and (escaped or (len(part) == 1 and part.isascii() and (part.isalnum() or part in PLAIN))):
            run += part[-1].upper()
            continue
        if part[0] in "?*{":
            run = run[:-1]
        longest, run = max(longest, run, key=len), ""
        depth += (part == "(") - (part == ")")
        if part == "|" and not depth:
            texts.append(longest)
            longest = ""
    return texts


def rule_numbers(keys: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """J10 for thousands of rules: _key, _rule (the place of the first rule found, from 0) for those of keys (_key, distinct) that any finds.

    Each alternative of a rule is looked up by the rarest piece of a text that it can't match without: descriptions meet
    the rules with which they share that piece, and only those are tried. Rules without such a text are one CASE.
    """
    texts = [needed_texts(plain_pattern(rule.pattern)) for rule in rules]
    loose = [k for k, each in enumerate(texts) if any(len(t) < PIECE for t in each)]
    firm = [(k, t) for k, each in enumerate(texts) if k not in set(loose) for t in each]
    rows = [(i, k, rule_pattern(rules[k].pattern), sorted({t[j : j + PIECE] for j in range(len(t) - PIECE + 1)})) for i, (k, t) in enumerate(firm)]
    each = keys.sparkSession.createDataFrame(rows, "_part int, _rule int, _pattern string, _pieces array<string>")
    places = F.sequence(F.lit(1), F.greatest(F.length("_key") - PIECE + 1, F.lit(1)))
    pieces = keys.select("_key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("_key", i, F.lit(PIECE))))).alias("_piece"))
    asked = each.select("_part", F.explode("_pieces").alias("_piece"))
    met = written(pieces.join(asked.select("_piece").distinct(), "_piece", "left_semi"), "pieces")
    uses = met.groupBy("_piece").agg(F.count("*").alias("_uses"))
    # An alternative of which some piece is nowhere finds nothing.
    chosen = asked.join(uses, "_piece", "left").groupBy("_part").agg(F.min_by("_piece", F.struct(F.coalesce("_uses", F.lit(0)), "_piece")).alias("_piece"))
    tried = met.join(chosen, "_piece").join(each.select("_part", "_rule", "_pattern"), "_part").filter(F.expr("_key rlike _pattern"))
    found = tried.select("_key", "_rule")
    if loose:
        number = cases([(F.col("_key").rlike(rule_pattern(rules[k].pattern)), F.lit(k)) for k in loose])
        found = found.unionByName(keys.select("_key", number.alias("_rule")).filter("_rule is not null"))
    return found.groupBy("_key").agg(F.min("_rule").alias("_rule"))


def with_rules(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """keyed (with _key) and the party and concept of the first rule found as _rule_party, _rule_concept."""
    if len(rules) <= CHAIN:
        party, concept = rule_values(F.col("_key"), rules)
        return keyed.withColumns({"_rule_party": party, "_rule_concept": concept})
    told = keyed.sparkSession.createDataFrame([(i, r.party, r.concept) for i, r in enumerate(rules)], "_rule int, _rule_party string, _rule_concept string")
    numbers = rule_numbers(keyed.select("_key").distinct(), rules).join(told, "_rule").drop("_rule")
    return keyed.join(numbers, "_key", "left")


def valid_rules(rows: Sequence[tuple[str, str | None, str | None]]) -> tuple[list[Rule], list[str]]:
    """Rules whose pattern compiles, and what is wrong with the others."""
    rules, wrong = [], []
    for number, (pattern, party, concept) in enumerate(rows, 1):
        try:
            re.compile(pattern)
            rules.append(Rule(pattern, party or None, concept or None))
        except re.error as e:
            wrong.append(f"rule {number} ({pattern}): {e}")
    return rules, wrong


def classified(movements: DataFrame, rules: Sequence[Rule] = (), unify: bool = True) -> DataFrame:
    """movements with concept and party, parties unified."""
    side = F.when(F.col("amount") > 0, "INGRESO").otherwise("EGRESO")
    keyed = movements.drop("concept", "party").withColumn("_side", side)
    distinct = keyed.select("description", "_side").distinct().withColumn("_key", canon(F.col("description")))
    named = with_rules(distinct, rules).withColumn("concept", F.coalesce("_rule_concept", concept_of(F.col("_key"), F.col("_side"))))
    named = named.withColumn("party", F.coalesce("_rule_party", party_of(F.col("_key"), F.col("concept")))).drop("_key", "_rule_party", "_rule_concept")
    # Written: the chains run once, and filters on their results aren't pushed down into copies of them.
    named = written(named, "descriptions")
    out = keyed.join(named, keyed["description"].eqNullSafe(named["description"]) & (keyed["_side"] == named["_side"]), "left").drop(named["description"], named["_side"]).drop("_side")
    return unified_parties(out) if unify else out


def party_names(movements: DataFrame) -> DataFrame:
    """key, name: of the spellings of each party key the longest, the first seen of equals."""
    order = F.struct("date", "doc_seq", "seq")
    spellings = movements.filter(~F.col("party").isin(t.OWN_BANK, t.UNKNOWN_PARTY)).groupBy("party").agg(F.min(order).alias("at"))
    keyed = spellings.withColumn("key", party_key(F.col("party"))).filter("key <> ''")
    best = F.struct(-F.length("party"), F.col("at"), F.col("party"))
    return keyed.groupBy("key").agg(F.min_by("party", best).alias("name"))


def word_pairs(words: Column) -> Column:
    """All pairs of distinct words, in their order."""
    ordered = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(ordered, lambda x: F.transform(F.filter(ordered, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def candidates(words: DataFrame) -> DataFrame:
    """key, words, into, into_words of names of three words and more that share the pair of words which is rarest in key."""
    rows = words.filter(F.size("words") >= 3).select("key", "words", F.explode(word_pairs(F.col("words"))).alias("pair"))
    uses = rows.groupBy("pair").agg(F.count("*").alias("uses"))
    rarest = rows.join(uses, "pair").groupBy("key").agg(F.min_by("pair", F.struct("uses", "pair")).alias("pair"), F.first("words").alias("words"))
    return rarest.join(rows.select(F.col("key").alias("into"), F.col("words").alias("into_words"), "pair"), "pair")


def absorbing(names: DataFrame) -> DataFrame:
    """Key, into: the key whose words hold all words of this one and more; the one with most words, the first of equals.

    A key must have two words or six characters to go into another. What holds one word or two given ones is an
    aggregate by word or pair, however many names have them; only longer names are compared, with those that share
    their rarest pair.
    """
    words = names.select("key", F.array_distinct(F.split("key", " ")).alias("words"))
    fullest = F.min_by("key", F.struct(-F.size("words"), F.col("key")))
    by_word = words.filter(F.size("words") > 1).select("key", "words", F.explode("words").alias("word")).groupBy("word").agg(fullest.alias("into"))
    one = words.filter((F.size("words") == 1) & (F.length("key") >= 6)).select("key", F.get("words", F.lit(0)).alias("word")).join(by_word, "word").select("key", "into")
    by_pair = words.filter(F.size("words") > 2).select("key", "words", F.explode(word_pairs(F.col("words"))).alias("pair")).groupBy("pair").agg(fullest.alias("into"))
    two = words.filter(F.size("words") == 2).select("key", F.get(word_pairs(F.col("words")), F.lit(0)).alias("pair")).join(by_pair, "pair").select("key", "into")
    holds = (F.size("into_words") > F.size("words")) & (F.size(F.array_except("words", "into_words")) == 0)
    more = candidates(words).filter(holds).groupBy("key").agg(F.min_by("into", F.struct(-F.size("into_words"), F.col("into"))).alias("into"))
    return one.unionByName(two).unionByName(more)


def unified_parties(movements: DataFrame) -> DataFrame:
    """C4: variants of a party under the fullest name."""
    names = written(party_names(movements), "parties")
    into = names.join(absorbing(names), "key", "left").select("key", F.coalesce("into", "key").alias("into"))
    final = into.join(names.withColumnRenamed("key", "into"), "into").select("key", F.col("name").alias("_name"))
    special = F.col("party").isin(t.OWN_BANK, t.UNKNOWN_PARTY)
    keyed = movements.withColumn("_party_key", F.when(~special, party_key(F.col("party"))))
    out = keyed.join(final, keyed["_party_key"] == final["key"], "left")
    return out.withColumn("party", F.coalesce("_name", "party")).drop("_name", "_party_key", "key")


def variants(movements: DataFrame) -> DataFrame:
    """A10: party and the other spellings that were put under it."""
    distinct = movements.select("description", "concept", "party").distinct()
    raw = distinct.withColumn("raw", party_of(canon(F.col("description")), F.col("concept")))
    raw = written(raw.withColumns({"_raw_key": party_key(F.col("raw")), "_own_key": party_key(F.col("party"))}), "variants")
    other = raw.filter(~F.col("raw").isin(t.OWN_BANK, t.UNKNOWN_PARTY) & (F.col("_raw_key") != F.col("_own_key")))
    return other.groupBy("party").agg(F.array_join(F.array_sort(F.collect_set("raw")), " | ").alias("variants"))
