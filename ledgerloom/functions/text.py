"""Text functions as Column expressions: accent folding, canonical keys, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose letters are folded: Latin and its extensions, punctuation, letter-like and full-width forms.
FOLDED_RANGES = ((0x00A0, 0x024F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2100, 0x214F), (0xFF01, 0xFF5E))

#: Company suffixes that two spellings of a name may differ by.
COMPANY_SUFFIXES = (
    "SAS", "S A S", "SA", "S A", "LTDA", "LTD", "SCA", "SAC", "EU", "ESP", "E S P", "SEM", "CIA", "Y CIA",
    "AND CIA", "INC", "CORP", "SOCIEDAD", "ANONIMA", "SIMPLIFICADA", "LIMITADA",
)


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What each character of FOLDED_RANGES decomposes to without combining marks: single letters, and longer texts."""
    single, longer = {}, {}
    for low, high in FOLDED_RANGES:
        for code in range(low, high + 1):
            own = chr(code)
            plain = "".join(c for c in unicodedata.normalize("NFKD", own) if not unicodedata.combining(c))
            if plain != own:
                (single if len(plain) == 1 else longer)[own] = plain
    return single, longer


SINGLE, LONGER = _foldings()


def strip_accents(text: Column) -> Column:
    """Compatibility forms and letters with marks become plain letters. Null stays null.

    Most texts are ASCII and stay as they are; the few characters that become several letters, and marks
    of their own, are looked up in one pass over the characters.
    """
    short = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    table = F.create_map(*[F.lit(x) for pair in LONGER.items() for x in pair])
    bare = F.regexp_extract_all(F.regexp_replace(short, r"\p{M}", ""), F.lit("(?s)."), F.lit(0))
    full = F.array_join(F.transform(bare, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    rare = r"[[^\x00-\x7F]&&[" + "".join(LONGER) + r"\p{M}]]"  # ASCII is left out first, as most characters end the test there
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(text.rlike(rare), full).otherwise(short)).otherwise(text)


def canon(text: Column) -> Column:
    """For comparisons: no accents, single spaces, upper case; null is empty."""
    return F.upper(F.trim(F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")))


def canon_keep_places(text: Column) -> Column:
    """Like canon with every space kept, so that places stay."""
    return F.upper(strip_accents(F.coalesce(text, F.lit(""))))


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, " \t", "  "), " +", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def words_pattern(words: tuple[str, ...]) -> str:
    """One pattern of whole words, the longest first."""
    return r"(?U)(?<!\w)(?:" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True)) + r")(?!\w)"


def without_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, words_pattern(words), " "), r"\s+", " "))


def party_key(name: Column) -> Column:
    """A name without company suffixes and punctuation, to know it in another spelling."""
    bare = without_words(canon(name), COMPANY_SUFFIXES)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), r"\s+", " "))


def file_label(text: Column) -> Column:
    """A label as a file name."""
    bare = F.regexp_replace(F.trim(strip_accents(F.coalesce(text, F.lit("")))), r"(?i)\.(pdf|jpe?g|png|tiff?|bmp|webp|txt|csv|xlsx?)$", "")
    out = F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s-]", ""), r"\s+", "_")
    return F.when(out == "", "sin_nombre").otherwise(out)


def text_quality(text: Column) -> Column:
    """Share of letters, digits and usual signs; 0 for an empty text."""
    plain = F.coalesce(text, F.lit(""))
    odd = F.regexp_replace(plain, "(?U)[\\p{L}\\p{N} .,;:\\-/$()%*#\\n\\t°]", "")
    return F.when(F.length(plain) == 0, F.lit(0.0)).otherwise((F.length(plain) - F.length(odd)) / F.length(plain))


def poor_text(text: Column, pages: Column) -> Column:
    """Too short for its pages, too many odd characters, or without any digit."""
    bare = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))
    return (bare < F.greatest(F.lit(60), 25 * F.greatest(pages, F.lit(1)))) | (text_quality(text) < 0.8) | ~F.coalesce(text, F.lit("")).rlike(r"\d")
