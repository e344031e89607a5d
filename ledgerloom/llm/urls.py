"""Operator 7: URL rules, and a Bloom filter cascade for a list of blocked sites. DataFrame functions alone.

The cascade's first filter holds the listed keys. Of the corpus's keys only those that it takes for listed are looked
up in the list, which tells the listed ones from its false positives. The second filter holds those false positives,
the third the listed keys that the second takes for them, and so on until none is left. As all keys of the corpus went
through the first level, the membership of each is exact, and the pages are judged by array look-ups in the filters'
words, without a join.

The filters' words travel as literals, MOST_WORDS of them at once. A longer list is dealt by a hash into several
cascades, each for its own keys and with its own look at the pages.

Defined results: a null url, and one without "://", has an empty host and path, fits no rule and is
allowed; equal keys count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The default list: sites whose pages and subdomains are blocked where no rule fits.
SITES = ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com", "spam-farm.example.org", "adult-x.example.net")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HASHES = 4
BITS_A_KEY = 16
LEAST_BITS = 1024
#: Words of 64 bits of all filters together that a plan carries as literals (4 MB); a cascade of one list needs about a third more than its first level.
MOST_WORDS = 500_000
MOST_LEVELS = 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def within(host: Column, site: str) -> Column:
    return (host == site) | host.endswith("." + site)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = within(host, site) & path.startswith(start)
        name = F.when(fits, F.lit(site + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def keys_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(HASHES * level + j)), F.lit(bits)) for j in range(HASHES)]


class Filter:
    """One level: a Bloom filter as 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, count: int):
        self.level, self.bits = level, -(-max(LEAST_BITS, BITS_A_KEY * count) // 64) * 64
        at = F.explode(F.array(*positions(F.col("key"), level, self.bits)))
        word = keys.select(at.alias("p")).select(F.floor(F.col("p") / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("b"))
        own = {r["w"]: r["v"] for r in word.groupBy("w").agg(F.bit_or("b").alias("v")).toLocalIterator()}
        self.literal = ",".join(str(own.get(i, 0)) for i in range(self.bits // 64))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.literal), ",").cast("array<bigint>")  # folded to one literal

        def bit(p: Column) -> Column:
            return F.call_function("shiftright", F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

        found = F.lit(True)
        for p in positions(key, self.level, self.bits):
            found = found & bit(p)
        return found


class Cascade:
    """Exact membership in listed (key, distinct) over the keys of `corpus` (key, distinct); both must be materialised."""

    def __init__(self, corpus: DataFrame, listed: DataFrame, count: int):
        self.levels = [Filter(listed, 0, count)]
        # The only join: what the first level lets through, which is the listed keys of the corpus and few others.
        taken = corpus.filter(self.levels[0].holds(F.col("key")))
        left = written(taken.join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "taken")
        for level in range(1, MOST_LEVELS + 1):
            own = F.col("listed") == (level % 2 == 0)
            sizes = left.agg(F.count_if(own).alias("own"), F.count_if(~own).alias("others")).first()
            if not sizes["own"]:  # the level before took none for its own that isn't
                return
            if level == MOST_LEVELS:
                raise RuntimeError(f"keys are still in question after {MOST_LEVELS} levels")
            self.levels.append(Filter(left.filter(own), level, sizes["own"]))
            # What is encoded is in the filter; of the rest only its false positives stay in question.
            left = left.filter(own | self.levels[-1].holds(F.col("key")))

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].holds(key), answer).otherwise(F.lit(k % 2 == 1))
        return answer


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; listed has a column key of site names."""
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.lit(False).alias("blocked"))
    keys = written(base.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct(), "keys")
    marks = written(listed.select("key").filter("key is not null").distinct(), "listed")
    parts = max(1, -(-4 * BITS_A_KEY * marks.count() // (3 * 64 * MOST_WORDS)))

    def own(key: Column, part: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)) == part

    for part in range(parts):
        mine = marks.filter(own(F.col("key"), part))
        cascade = Cascade(keys.filter(own(F.col("key"), part)), mine, mine.count())
        hit = F.exists(keys_of(F.col("host")), lambda key: own(key, part) & cascade.holds(key))
        base = base.withColumn("blocked", F.col("blocked") | F.coalesce(hit, F.lit(False)))
        if part < parts - 1:
            base = written(base, "pages")  # so that a plan never carries the filters of two cascades
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def judge_pages(spark, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(s,) for s in SITES], "key string")
    return judged(table(spark, sf_dir, "pages"), listed)


ORACLE = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {" OR ".join(f"host = '{s}' OR host LIKE '%.{s}'" for s in SITES)} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
