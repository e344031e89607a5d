"""Operator 9: licence scans by canonical digests. DataFrame functions alone.

A text and each of its lines is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings and white space), and the SHA-256 of all of them are hash-joined to the digests of
known licences: whole texts, in license_texts.json, and notices of one line. A licence is known by any of
its digests; whole texts and lines take the same way, as notices stand on lines of their own. What is
joined back to the documents is only what was found.

Defined results: null and empty texts have the digest of the empty text and no licence; equal digests
of two known names give the first name; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

#: Notices by SPDX identifier. The parameter `known` takes others in place of these and the texts.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

#: Texts of the usual licences, beside this file, by SPDX identifier.
TEXTS = Path(__file__).with_name("license_texts.json")


#: Titles with which a text that has none of its own is also known.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
}


def usual() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of the notices and of the whole texts."""
    whole = json.loads(TEXTS.read_text(encoding="utf-8"))
    titled = [(name, f"{title}\n\n{whole[name]}") for name, titles in TITLES.items() for title in titles]
    return [*KNOWN.items(), *whole.items(), *titled]


#: Words by which a line that starts with "copyright" or "(c)" is known for a licence's own wording.
WORDING = "notices?|holders?|owners?|laws?|licen[sc]es?|interests?|statements?|permission|rights?|and|or|as|in|on|is|to|of|treat(?:y|ies)|you|under|if|any|for|an?|that|by[ \\t]+(?:law|permission)|the"
MARK = r"^[ \t]*(?:copyright|\(c\)|©)"
#: Where the words don't count: a mark of its own, and the name of a university.
NAMED = r"^[ \t]*(?:©|(?:copyright|\(c\))[ \t]+the[ \t]+regents\b)"
RESERVED = r"^[ \t]*all rights reserved\.?[ \t]*$"


#: A canonical spelling for each of its equivalents, as whole words in lower case.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"), ("recognised", "recognized"), ("authorised", "authorized"), ("favour", "favor"), ("sublicence", "sublicense"), ("while", "whilst"), ("noncommercial", "non  commercial"))



def is_copyright(line: Column) -> Column:
    """A lower-case line states a copyright, or that all rights are reserved."""
    wording = line.rlike(rf"{MARK}[ \t]+(?:{WORDING})\b") | line.rlike(rf"{MARK}[ \t]*$")
    return line.rlike(RESERVED) | (line.rlike(MARK + r"(?![a-z])") & (~wording | line.rlike(NAMED)))


def canonical(line: Column) -> Column:
    """A lower-case line with each run of anything but letters and digits as one space, and one spelling of each word."""
    # Two spaces between words while spellings are replaced, so that each word has its own on both sides.
    out = F.concat(F.lit(" "), F.regexp_replace(line, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for other, own in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {own} "))
    return F.trim(F.replace(F.replace(out, F.lit("   "), F.lit(" ")), F.lit("  "), F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~is_copyright(x))
    return F.filter(F.transform(lines, canonical), lambda x: x != "")


def whole_text(lines: Column) -> Column:
    return F.array_join(lines, " ")


def known_digests(spark, known: Mapping[str, str] | None) -> DataFrame:
    rows = spark.createDataFrame(sorted(usual() if known is None else known.items()), "license string, text string")
    named = rows.select("license", F.unhex(F.sha2(whole_text(canonical_lines(F.col("text"))), 256)).alias("key"))
    return named.groupBy("key").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, digest (of the canonical whole text), license (of which that is the text, or null), notices
    (names of the licences that lines of the text are, sorted, joined by a comma; empty if none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = known_digests(docs.sparkSession, known)

    def keys(lines: Column) -> Column:
        return F.struct(F.unhex(F.sha2(whole_text(lines), 256)).alias("whole"), F.transform(lines, lambda x: F.unhex(F.sha2(x, 256))).alias("lines"))

    made = written(docs.select("doc_id", F.get(F.transform(F.array(canonical_lines(text)), keys), F.lit(0)).alias("k")).select("doc_id", "k.whole", "k.lines"), "digests")
    # Rows of equal doc_id and text have equal results, so both together are the key by which these come back.
    each = F.explode(F.array_append(F.transform("lines", lambda x: F.struct(x.alias("key"), F.lit(False).alias("all"))), F.struct(F.col("whole").alias("key"), F.lit(True).alias("all"))))
    found = made.select("doc_id", "whole", each.alias("d")).select("doc_id", "whole", "d.key", "d.all").join(names, "key")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole")).agg(
        F.min(F.when(F.col("all"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("all"), F.col("license")))), ",").alias("notices"),
    )
    back = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.col("_whole"))
    return made.join(found, back, "left").select("doc_id", F.lower(F.hex("whole")).alias("digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """The same scan in DuckDB's SQL; of the known licences it has the digests, which Spark-free code makes here."""
    import re

    def canon(line: str) -> str:
        out = " " + re.sub(r"[\W_]+", "  ", line) + " "
        for other, own in SPELLINGS:
            out = out.replace(f" {other} ", f" {own} ")
        return " ".join(out.split())

    def stated(line: str) -> bool:
        wording = re.search(rf"{MARK}[ \t]+(?:{WORDING})\b", line) or re.search(rf"{MARK}[ \t]*$", line)
        return bool(re.search(RESERVED, line) or (re.search(MARK + r"(?![a-z])", line) and (not wording or re.search(NAMED, line))))

    digests: dict[str, str] = {}
    for name, text in sorted(usual(), reverse=True):
        lines = [canon(x) for x in text.lower().split("\n") if not stated(x)]
        digests[sha256(" ".join(x for x in lines if x).encode()).hexdigest()] = name
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(digests.items()))
    word = "' ' || regexp_replace(x, '[^\\pL\\pN]+', '  ', 'g') || ' '"
    for other, own in SPELLINGS:
        word = f"replace({word}, ' {other} ', ' {own} ')"
    word = f"trim(regexp_replace({word}, ' +', ' ', 'g'))"
    q = lambda pattern: f"regexp_matches(x, '{pattern}')"
    stated_sql = f"({q(RESERVED)} OR ({q(MARK + '($|[^a-z])')} AND (NOT ({q(rf'{MARK}[ \t]+(?:{WORDING})' + chr(92) + 'b')} OR {q(MARK + '[ \\t]*$')}) OR {q(NAMED)})))"
    return f"""WITH known(digest, license) AS (VALUES {known}),
l AS (SELECT doc_id, row_number() OVER () AS r, list_filter(list_transform(list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: NOT {stated_sql}), lambda x: {word}), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT doc_id, r, lines, sha256(coalesce(array_to_string(lines, ' '), '')) AS digest FROM l),
n AS (SELECT r, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM (SELECT r, unnest(lines) AS x FROM w) u JOIN known k ON k.digest = sha256(u.x) GROUP BY r)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices FROM w LEFT JOIN known k USING (digest) LEFT JOIN n USING (r)"""
