"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows,
no rows, and other columns of clashing names."""

import base64
import hashlib
import json
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, decontam, html, licenses, nearcopies, packing, passages, quality, simhash, urls, warc
from ledgerloom.llm.common import AT_ONCE, few_rows
from ledgerloom.llm.components import connected_components
from tests.llm import brute

WORDS = "the of and to alpha beta gamma delta river stone light paper house green early often never seven north south".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ".\n", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def texts():
    rng = random.Random(1)
    some = [prose(rng, n) for n in (0, 1, 2, 3, 4, 30, 60, 200, 700)]
    passage = prose(rng, 40)
    some += [prose(rng, 80) + " " + passage + " " + prose(rng, 50) for _ in range(6)]
    some += [some[7], some[7], some[8].replace("river", "rivers", 3), None, "", "  \n\t ", "ñandú çé " * 30, "word " * 400, "a" * 3000, "ab" * 200 + prose(rng, 30)]
    return list(enumerate(some))


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"row": F.lit("x"), "length": F.lit(1), "_q": F.lit(2), "fp": F.lit("y"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}) if clash else df


def empty(spark):
    return documents(spark, [(1, "x")]).filter("false")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [*texts(), (3, "again"), (40, "<|endoftext|> is special"), (None, "no id")]
    got = packing.pack_documents(documents(spark, data), capacity=64).collect()
    expected = sorted((d if d is not None else -1, *p) for d, t in data for p in brute.pieces(tokens.encode(t or "", add_special_tokens=False).ids + [0], 64))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert packing.pack_documents(empty(spark)).count() == 0
    whole = packing.packed_sequences(documents(spark, data[:6]), capacity=64).collect()
    assert all(len(r["token_ids"]) == sum(r["lengths"]) <= 64 for r in whole)


def best(items, capacity):
    """The fewest bins, by search."""
    found = [len(items)]

    def search(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for b in {bins.index(x) for x in bins if x + items[i] <= capacity}:
            bins[b] += items[i]
            search(i + 1, bins)
            bins[b] -= items[i]
        search(i + 1, [*bins, items[i]])

    search(0, [])
    return found[0]


def test_dominance_never_costs_a_bin():
    for seed in range(150):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        left = [0] * 21
        for x in items:
            left[x] += 1
        fixed = packing.dominance_reduction(left, 20)
        rest = [s for s in range(20, 0, -1) for _ in range(left[s])]
        assert sum(g.count for g in fixed) + best(rest, 20) == best(items, 20)


def test_simhash(spark):
    data = [*texts(), (7, texts()[7][1])]
    got = simhash.near_components(documents(spark, data), width=4, bits=4).collect()
    prints = {d: brute.simhash(t) for d, t in data}
    groups = brute.components(prints)
    assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((d, prints[d], groups[d]) for d, _ in data)
    nameless = [(None, data[8][1]), (None, "no other text is like this one"), (1, "x y"), (1, "x y")]
    got = simhash.near_components(documents(spark, [*data, *nameless])).collect()
    assert len(got) == len(data) + 4 and {r["component_id"] for r in got if r["doc_id"] is None} == {groups[8], None}
    assert simhash.near_components(empty(spark)).count() == 0


def test_simhash_broadcasts_no_cells(spark):
    nodes = spark.range(1000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"))
    assert "Broadcast" not in simhash.meeting(nodes)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("segment", [1, 2])
def test_near_labels_against_all_pairs(spark, segment):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(6)})
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    got = {r["id"]: r["component"] for r in simhash.near_labels(spark.createDataFrame(signed, "node long, fp long"), 4, segment).collect()}
    groups = brute.components(dict(enumerate(prints)))
    assert {i: got.get(i, i) for i in groups} == groups and len(set(groups.values())) < len(groups)


def test_grid_cells_of_linked_pairs():
    """Any pair within 4 bits has a common cell, by either width of segments."""
    rng = random.Random(21)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        for width in (1, 2):
            va, vb = (x if width == 1 else x - ((x >> 1) & simhash.LOW_BITS) for x in (a, b))
            assert any(va & m % 2**64 == vb & m % 2**64 for m, _ in simhash.CHOICES)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    data = texts()
    for _ in range(12):  # copies with more and more edits, through 0.8 and on
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for share in (0, 0.01, 0.02, 0.02, 0.025, 0.03, 0.05):
            data.append((len(data), " ".join(rng.choice(words) if rng.random() < share else w for w in base)))
    for cut in (2, 3):  # 8 of 10 shingles are enough, 7 aren't
        ten = [rng.choice(words) for _ in range(14)]
        data += [(len(data), " ".join(ten)), (len(data) + 1, " ".join(ten[cut:]))]
    docs = dict(data)
    groups = brute.near_copies(docs)
    kept = nearcopies.representatives(documents(spark, data))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == documents(spark, data).columns
    prints = {d: brute.simhash(t, 5) for d, t in data}
    assert sum(groups[d] != d and (prints[d] ^ prints[groups[d]]).bit_count() > 4 for d in docs) > 10  # what 4 bits miss
    assert nearcopies.representatives(empty(spark)).count() == 0


def test_near_copies_within_four_bits_meet(spark):
    """Sets of Jaccard 0.8 and more that differ in every class meet in the grid of operator 2 over the whole fingerprint."""
    rng = np.random.default_rng(24)

    def apart(a, b):
        return (nearcopies.fingerprint_of(a) ^ nearcopies.fingerprint_of(b)).bit_count()

    found = []
    while len(found) < 3:
        whole = np.unique(rng.integers(0, 2**64, 614, dtype=np.uint64))
        own = whole * nearcopies.MULTIPLIERS[0]
        gone = {}
        for i in rng.permutation(len(whole)):  # one shingle of each class, by both levels of classes that sets of this size have
            fine, coarse = int(own[i] >> np.uint64(57)), int(own[i] >> np.uint64(58))
            gone.setdefault(fine if fine < 64 else 1000 + coarse, i)
        less = np.delete(whole, list(gone.values()))
        if not set(nearcopies.cells_of(whole)) & set(nearcopies.cells_of(less)) and apart(whole, less) <= 4:
            assert 5 * len(less) >= 4 * len(whole)
            found.append((whole, less))
    sets = [s for pair in found for s in pair]
    nodes = spark.createDataFrame([(i, len(s), nearcopies.fingerprint_of(s), nearcopies.cells_of(s)) for i, s in enumerate(sets)], "node long, n long, fp long, cells array<long>")
    got = {r["node"]: set(r["all"]) for r in nodes.select("node", nearcopies.grid_cells().alias("all")).collect()}
    assert all(got[2 * k] & got[2 * k + 1] for k in range(3)) and not got[0] & got[2]
    made = nearcopies.sketches(spark.createDataFrame([(0, None), (1, "One two three four five six seven"), (2, "a b")], "row long, text string")).collect()
    assert [r["fp"] & (2**64 - 1) for r in made] == [0, *(brute.simhash(t, 5) for t in ("One two three four five six seven", "a b"))]


def test_near_copies_of_a_large_group(spark):
    """Texts of one base that are similar to some of the others only."""
    rng = random.Random(16)
    base = [str(rng.randint(0, 999)) for _ in range(120)]
    data = [(i, " ".join(str(rng.randint(0, 999)) if rng.random() < 0.035 else w for w in base)) for i in range(200)]
    kept = nearcopies.representatives(documents(spark, data))
    assert {r["doc_id"] for r in kept.collect()} == set(brute.near_copies(dict(data)).values())


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((50, 70, 100), 50), 200: 200, 201: 200}


def test_quality(spark):
    data = [*texts(), (50, "a b c a b c\n\na b c\n x ## | $%&<>*\nx ## | $%&<>*\r\n"), (51, "Ünï çödé " + "### |" * 60)]
    got = {r["doc_id"]: r for r in quality.quality(documents(spark, data)).collect()}
    for d, t in data:
        expected = brute.base_measures(t)
        assert {k: got[d][k] for k in expected} == expected, d
        assert not (got[d]["base_failed"] and got[d]["kept"])
    assert quality.quality(empty(spark)).count() == 0
    kept = quality.kept_documents(documents(spark, data))
    assert {r["doc_id"] for r in kept.collect()} == {d for d in got if got[d]["kept"]} and kept.columns == documents(spark, data).columns


def test_quality_keeps_values_of_clashing_columns(spark):
    data = [(i, ". ".join(" ".join(f"w{(i * 7 + j * k) % 97}" for j in range(9)) for k in range(1, 12))) for i in range(8)]
    docs = documents(spark, data).withColumn("_q", F.col("doc_id") * 2)
    assert all(r["_q"] == 2 * r["doc_id"] for r in quality.kept_documents(docs).collect())


def test_em_against_a_plain_loop():
    """The fit on counts of patterns against the same algorithm over single documents, and against the truth."""
    rng = random.Random(5)
    truth, documents_ = [], []
    for _ in range(400):
        good = rng.random() < 0.7
        truth.append(good)
        documents_.append(tuple(None if rng.random() < 0.3 else int(good if rng.random() < a else not good) for a in (0.9, 0.8, 0.75, 0.85)))
    share, right = 0.5, [(0.8, 0.8)] * 4
    for _ in range(20):
        likely = []
        for votes in documents_:
            good, bad = share, 1 - share
            for v, (g, b) in zip(votes, right):
                if v is not None:
                    good *= g if v else 1 - g
                    bad *= (1 - b) if v else b
            likely.append(good / (good + bad))
        share = min(0.99, max(0.01, (1 + sum(likely)) / (len(likely) + 2)))
        right = []
        for k in range(4):
            voted = [(p, votes[k]) for p, votes in zip(likely, documents_) if votes[k] is not None]
            on_good = (1 + sum(p for p, v in voted if v)) / (2 + sum(p for p, _ in voted))
            on_bad = (1 + sum(1 - p for p, v in voted if not v)) / (2 + sum(1 - p for p, _ in voted))
            right.append((min(0.995, max(0.55, on_good)), min(0.995, max(0.55, on_bad))))
    patterns = {}
    for votes in documents_:
        patterns[votes] = patterns.get(votes, 0) + 1
    got_share, got = quality.fit(patterns, 20)
    assert abs(got_share - share) < 1e-9 and all(abs(x - y) < 1e-9 for a, b in zip(got, right) for x, y in zip(a, b))
    assert sum((quality.posterior(got_share, got, v) >= 0.5) == t for v, t in zip(documents_, truth)) > 360


def test_quality_on_labelled_junk(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    good = [". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(12)) for _ in range(60)]
    junk = [" ".join(rng.choice(words) + rng.choice(["###", "%%%", "&&&"]) for _ in range(100)) for _ in range(8)] + [" ".join(rng.choice(words).upper() + "!!" for _ in range(100)) for _ in range(8)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(documents(spark, list(enumerate(good + junk)))).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 76))


@pytest.mark.parametrize("hot", [False, True])
def test_passages(spark, monkeypatch, hot):
    if hot:  # every owner takes the way of hot ones
        monkeypatch.setattr(passages, "SORTED_TOGETHER", 1)
    data = texts()
    got = rows(passages.without_repeats(documents(spark, data), 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((d, *v) for d, v in brute.repeated_bytes(data).items())


def test_passages_of_a_large_group_are_sorted_without_what_follows(spark, monkeypatch):
    sizes, sort = [], passages.repeats_in
    monkeypatch.setattr(passages, "SORT_ROWS", 50)
    monkeypatch.setattr(passages, "repeats_in", lambda rows, *more: sizes.append(len(rows)) or sort(rows, *more))
    owners = [1] * 70 + [k // 10 for k in range(20, 600)]  # the first group has more rows than are sorted at once
    entries = pa.table({"h": owners, "row": range(len(owners)), "first": pa.array([0] * len(owners), pa.int32()), "n": pa.array([1] * len(owners), pa.int32()), "bytes": [f"{h:0100d}".encode() for h in owners]})

    class Frame:  # the rows of one task, dealt and sorted
        def select(self, *_): return self
        def repartition(self, *_): return self
        def sortWithinPartitions(self, *_): return self
        def mapInArrow(self, function, schema): return list(function(iter(entries.to_batches(max_chunksize=100))))

    found = passages.dictionary_ranges(Frame(), 100)
    assert sum(sizes) == len(owners) and max(sizes) == 70
    assert sum(len(b) for b in found) == 69 + 9 * 58


def test_tasks_take_few_rows_at_once():
    batch = pa.record_batch({"x": range(1000)})
    parts = list(few_rows(iter([batch, batch.slice(0, 1), batch.slice(0, 0)])))
    assert max(map(len, parts)) == AT_ONCE and pa.Table.from_batches(parts)["x"].to_pylist() == [*range(1000), 0]


def test_suffix_classes():
    data = bytes(random.Random(4).choice(b"ab") for _ in range(3000)) + bytes(300)
    ranks = passages.suffix_classes(data, 100)
    padded = data + bytes(108)
    known = sorted({padded[i : i + 100] for i in range(len(data))})
    assert np.unique(ranks, return_inverse=True)[1].tolist() == [known.index(padded[i : i + 100]) for i in range(len(data))]


def test_passages_with_shared_ids(spark):
    long = prose(random.Random(9), 60)
    got = rows(passages.without_repeats(documents(spark, [(1, long), (1, long), (2, long)])), "doc_id", "n_removed")
    size = len(long.encode())
    assert got == [(1, 0), (1, size), (2, size)]
    assert passages.without_repeats(empty(spark)).count() == 0
    cleaned = passages.cleaned_documents(documents(spark, [(1, long), (2, long + " more text")]))
    assert cleaned.columns == documents(spark, [(1, "x")]).columns
    assert {r["doc_id"]: r["n_chars"] for r in cleaned.collect()} == {1: len(long), 2: len(" more text")}


def test_warc(spark, tmp_path):
    data = [(1, "http://a/ñ", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "v", ""), (5, "w", "é" * 5000), (6, "w", "\x1f\x8b\x08 magic"), (None, "n", "alone"), (9, "z", "<p>x</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("name", F.lit(1))
    stored = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_archives(stored, split_bytes=100).collect()}
    assert len(got) == len(data)
    last = {}
    for page, _, body in data:
        last[body or ""] = max(x for x in (page, last.get(body or "")) if x is not None) if page is not None or last.get(body or "") else None
    for page, _, body in data:
        payload = (body or "").encode()
        r = got[page]
        response = last[body or ""] in (page, None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", last[body or ""]))
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (payload if response else None)
    assert got[1]["url"] == "http://a/ñ"
    assert warc.round_trip(pages.filter("false")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    item = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(5)] + [None, "", "two words"]
    edited = item[1].split()
    edited[7], edited[19] = "changed", "other"
    clean = " ".join(rng.choice(words) for _ in range(300))
    data = [(1, clean), (2, clean + " " + item[0].upper() + "! " + clean), (3, "x " + " ".join(edited)), (4, " ".join(item[2].split()[:22])), (5, None), (6, ""), (7, item[3]), (7, item[3])]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    got = decontam.matches(documents(spark, data), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(2, 0), (3, 1), (4, 2), (7, 3), (7, 3)]
    assert {r["doc_id"]: (r["score"] == 1.0, r["first_word"], r["end_word"]) for r in got if r["doc_id"] in (2, 7)} == {2: (True, 300, 330), 7: (True, 0, 30)}
    kept = decontam.clean_documents(documents(spark, data), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6] and kept.columns == documents(spark, data).columns
    assert decontam.matches(empty(spark), bench).count() == 0 and decontam.matches(documents(spark, data), bench.filter("false")).count() == 0


def test_decontamination_against_aligning_every_pair(spark):
    import numpy as np

    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 40))] for _ in range(12)]
    data = []
    for k in range(120):
        copy, before, after = list(rng.choice(items)), [rng.choice(words) for _ in range(rng.randint(0, 60))], [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, len(copy) // 4)):  # words changed, left out and put in
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = [rng.choice(words) for _ in range(rng.randint(0, 1))]
        data.append((k, " ".join(before + (copy if k % 3 else []) + after)))
    data += data[:2] + [(None, data[1][1])]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string").withColumn("item", F.lit("x"))
    number = {w: k for k, w in enumerate(words)}
    expected = {}
    for doc, text in data:
        for k, item in enumerate(items):
            score = decontam.aligned(*(np.array([number[w] for w in x]) for x in (item, text.split())))[0] / (2 * len(item))
            if score >= 0.5:
                expected[doc, k] = score
    got = decontam.matches(documents(spark, data), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    assert len(got) == len(found) + 1 and (None, found and next(k for d, k in found if d == 1)) in found  # document 1 is there twice, and without an id
    assert all(expected[pair] == score for pair, score in found.items())
    assert len(found) >= 0.9 * len(expected) > 50
    kept = sorted(str(r["doc_id"]) for r in decontam.clean_documents(documents(spark, data), bench).collect())
    assert kept == sorted(str(d) for d, _ in data if d not in {d for d, _ in found})


#: Share of copies that are found, by kind of edit; README has the figures.
EDITS = {
    "every fourth": lambda rng, words, item: [rng.choice(words) if k % 4 == 3 else w for k, w in enumerate(item)],
    "every third": lambda rng, words, item: [rng.choice(words) if k % 3 == 2 else w for k, w in enumerate(item)],
    "random quarter": lambda rng, words, item: [rng.choice(words) if rng.random() < 0.25 else w for w in item],
    "random three tenths": lambda rng, words, item: [rng.choice(words) if rng.random() < 0.3 else w for w in item],
    "every sixth left out": lambda rng, words, item: [w for k, w in enumerate(item) if k % 6],
    "half quoted": lambda rng, words, item: item[: len(item) // 2 - 2],
}


def test_decontamination_recall_by_edit(spark):
    """150 items of 40 words for each kind of edit, each copy inside 120 other words: of the copies that score half or hold 13 words in a row."""
    import numpy as np

    rng = random.Random(23)
    words = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(words) for _ in range(40)] for _ in range(150)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    data, owed = [], {}
    for e, (name, edit) in enumerate(EDITS.items()):
        for k, item in enumerate(items):
            copy, doc = edit(rng, words, item), 1000 * e + k
            text = [rng.choice(words) for _ in range(60)] + copy + [rng.choice(words) for _ in range(60)]
            data.append((doc, " ".join(text)))
            score = decontam.aligned(*(np.array([int(w[1:]) for w in x]) for x in (item, copy)))[0] / 80
            if score >= 0.5 or name == "half quoted":
                owed[doc] = (name, k)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()}
    assert all(item == doc % 1000 for doc, item in got)
    for name in EDITS:
        own = [(doc, k) for doc, (n, k) in owed.items() if n == name]
        share = sum(pair in got for pair in own) / len(own)
        print(name, len(own), share)
        assert len(own) > 30 and share >= (0.9 if "random three" in name else 0.97), (name, share)


def test_decontamination_with_a_common_stem(spark):
    """A stem of all questions, in many texts: it pairs no text with an item, and copies are still found."""
    rng = random.Random(29)
    words = [f"w{i}" for i in range(3000)]
    stem = "which of the following is the best answer to the question".split()
    items = [stem + [rng.choice(words) for _ in range(20)] for _ in range(60)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    data = [(k, " ".join([rng.choice(words) for _ in range(30)] + stem + [rng.choice(words) for _ in range(30)])) for k in range(300)] + [(1000 + k, " ".join(items[k])) for k in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == {(1000 + k, k) for k in range(60)}
    known = bench.withColumn("item", F.col("item_id"))
    grams = decontam.item_grams(known)
    rows_ = docs.withColumn("key", decontam.text_key(F.col("text")))
    hits = decontam.shared_grams(rows_, decontam.filter_of(grams))
    assert hits.join(decontam.rare_seeds(grams, hits), "gram").select("key", "item").distinct().count() < 200


def test_alignment_against_a_plain_table():
    import numpy as np

    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert decontam.aligned(np.array(a), np.array(b))[0] == max(map(max, table))


def test_urls(spark):
    data = [
        (1, "https://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        (3, "http://example.net", "example.net", "", None, "allow"), (4, "x://m.example.com/de/1#f", "m.example.com", "/de/1", "example.com/de/", "block"), (5, "ftp://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"),
        (6, None, "", "", None, "allow"), (7, "no scheme", "", "", None, "allow"), (8, "http://www.bad.com/", "www.bad.com", "/", None, "block"), (9, "http://notbad.com/", "notbad.com", "/", None, "allow"), (10, "http://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(d[0], d[1]) for d in data], "page_id long, url string").withColumns({"key": F.lit(1), "blocked": F.lit(True)})
    listed = spark.createDataFrame([("bad.com",), ("bad.com",), ("absent.com",)], "key string")
    got = urls.judged(pages, listed)
    assert rows(got.na.fill("", ["rule"]), "page_id", "host", "path", "rule", "verdict") == [(d[0], d[2], d[3], d[4] or "", d[5]) for d in data]
    assert urls.judged(pages.filter("false"), listed).count() == 0 and urls.judged(pages, listed.filter("false")).filter("host = 'www.bad.com'").first()["verdict"] == "allow"


def cascade_keys(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 6000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    return keys, listed, listed.count()


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    monkeypatch.setattr(urls, "BITS_A_KEY", 2)  # many false positives, so several levels
    keys, listed, n = cascade_keys(spark)
    cascade = urls.Cascade(keys, listed, n)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.holds(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0)).count() == 0


def test_cascade_out_of_levels(spark, monkeypatch):
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    monkeypatch.setattr(urls, "BITS_A_KEY", 2)
    monkeypatch.setattr(urls, "MOST_LEVELS", 1)
    with pytest.raises(RuntimeError):
        urls.Cascade(*cascade_keys(spark))


def test_urls_with_a_list_for_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_WORDS", 100)
    listed = spark.range(1000).select(F.concat(F.lit("s"), "id", F.lit(".example")).alias("key"))
    pages = spark.range(1500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.s"), F.col("id") * 2, F.lit(".example/")).alias("url"))
    written, made = urls.written, []
    monkeypatch.setattr(urls, "written", lambda df, label: made.append(label) or written(df, label))
    got = urls.judged(pages, listed)
    assert got.filter((F.col("verdict") == "block") != (F.col("page_id") * 2 < 1000)).count() == 0 and got.count() == 1500
    assert made.count("taken") == 4


def test_urls_with_a_long_list(spark):
    """100,000 listed sites and as many keys that aren't."""
    listed = spark.range(100_000).select(F.concat(F.lit("s"), F.xxhash64("id"), F.lit(".example")).alias("key"))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.s"), F.xxhash64(F.col("id") * 3), F.lit(".example/")).alias("url"))
    got = urls.judged(pages, listed)
    assert got.filter((F.col("verdict") == "block") != (F.col("page_id") * 3 < 100_000)).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    data = [(1, 0, "system", "be\nkind"), (1, 1, "user", "[\\INST] \\[INST] [INST"), (1, 2, "assistant", None), (1, 3, "assistant", "a]</s>b"), (2, 5, None, "no role"), (2, 5, "tool", "[TEXT]"), (3, 0, "assistant", "<\\/s> \\"), (3, 0, "assistant", "<\\/s> \\")]
    conversations = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    got = {r["conv_id"]: r for r in chat.digests(chat.rendered(chat.with_probe(conversations))).collect()}
    turns = {-1: [("user", said), ("assistant", said)]}
    for conv, _, role, text in sorted(data, key=lambda d: (d[0], d[1], d[2] or "", d[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(loss))
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.rendered(conversations.filter("false"))).count() == 0 and chat.formatted(conversations.filter("false")).count() == 0
    # Turn by turn and whole conversations give the same texts and spans.
    whole = chat.compile_template(chat.TEMPLATE)
    for r in chat.formatted(conversations).collect():
        assert (r["text"], [tuple(s) for s in r["loss_spans"]]) == whole([{"role": a, "text": b} for a, b in turns[r["conv_id"]]])
    last = chat.TEMPLATE.replace("</s>", "{{ '</s>' if loop.last else '</s>' }}")
    assert chat.compile_template(chat.TEMPLATE).by_turn and not chat.compile_template(last).by_turn
    assert rows(chat.formatted(conversations, last), "conv_id", "text") == rows(chat.formatted(conversations), "conv_id", "text")


def test_template_language():
    render = chat.compile_template("{% for m in messages %}{% if loop.first and m.a == 1 + 1 %}{{ 'x' + 'y' }}{% elif 1 == 2 %}no{% else %}{% generation %}{{ m.a | upper if m.a else '-' }}{% endgeneration %}{% endif %}{% endfor %}.")
    assert render([{"a": 2}, {"a": "q"}, {"a": ""}]) == ("xyQ-.", [(2, 3), (3, 4)])
    assert chat.expression("'a' + 'b' | upper").constant == "aB" and chat.expression("'' or 'x'").constant == "x" and chat.expression("1 and 0").constant == 0

    def text(source, *messages):
        return chat.compile_template(source)(list(messages))[0]

    assert text("a {#- no -#}  b{%- if true -%}  c  {%- endif %} d") == "ab" + "c d"
    assert text("{% set n = namespace(k=1) %}{% for m in messages %}{% set n.k = n.k * 2 %}{% endfor %}{{ n.k }}", {}, {}, {}) == "8"
    assert text("{{ messages[-1].a ~ messages[0].a }}{{ messages[1:] | length + 1 }}{{ messages[0].b | default('z') }}", {"a": "p"}, {"a": "q"}) == "qp2z"
    assert text("{% for m in messages %}{{ loop.index }}{{ ',' if not loop.last }}{% endfor %}{{ x is defined }}{{ x is none }}", {}, {}) == "1,2FalseFalse"
    assert text("{{ '  Ab ' | trim | lower }}{{ 'x'.startswith('x') and 'yes' }}") == "abyes"
    with pytest.raises(chat.TemplateError):
        text("{{ loop.index }}")
    with pytest.raises(chat.TemplateError):
        text("{{ raise_exception('no') }}")
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for m in x %}", "{% what %}", "{{ (lambda: 1) }}", "{{ 'a' * 99999 }}", "{{ '%9d' % 3 }}", "{{ 2 ** 9 }}", "{{ 'a'.__class__ }}", "{% set x %}", "{{ 1 +"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad + (" }}" if bad.endswith("+") else ""))
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["[", "<", "\\", "/", "INST]", "s>", "[INST]", "</s>", "a"]) for _ in range(8))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_licenses(spark):
    data = [(1, "RELEASED under the MIT licence"), (2, "some text\n  Released under the  MIT License.\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "Copyright 2020 me\nreleased under the mit license"), (6, "released under the mit license or not"), (6, "x")]
    got = rows(licenses.scan(documents(spark, data)).na.fill("", ["license"]), "doc_id", "license", "notices")
    assert got == [(1, "MIT", "MIT"), (2, "", "CC-BY-NC-4.0,MIT"), (3, "", ""), (4, "", ""), (5, "MIT", "MIT"), (6, "", ""), (6, "", "")]
    many = {f"L{i}": f"license number {i}" for i in range(5000)}
    assert rows(licenses.scan(documents(spark, [(1, "a\nLicence, number 7"), (2, "b"), (None, "license number 9"), (None, "license number 9")]), many).na.fill(-1, ["doc_id"]), "doc_id", "notices") == [(-1, "L9"), (-1, "L9"), (1, "L7"), (2, "")]
    assert licenses.scan(empty(spark)).count() == 0


def test_whole_licenses(spark):
    """Whole texts with another case, wrapping, copyright line and spelling."""
    whole = json.loads(licenses.TEXTS.read_text(encoding="utf-8"))
    data, expected = [], []
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"):
        changed = [whole[name], whole[name].upper(), re.sub(r"\blicense\b", "licence", whole[name])]
        if "<year> <" in whole[name]:
            mine = "Copyright 2021, 2022 Me\n\n" + whole[name].split("\n\n", 1)[1]
            changed.append("".join(licenses.TITLES[name][:1]) + "\n\n" + mine)
            changed += ["\n\n".join(textwrap.fill(part, width) for part in mine.split("\n\n")) for width in (30, 44, 61, 72)]
        for text in changed:
            expected.append((len(data), name))
            data.append((len(data), text))
    data.append((len(data), whole["MIT"].replace("WITHOUT WARRANTY", "WITH WARRANTY")))
    got = rows(licenses.scan(documents(spark, data)).na.fill("", ["license"]), "doc_id", "license")
    assert got == [*expected, (len(data) - 1, "")]


PAGE = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header>Top</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="sidebar">Side text that is quite long and goes on and on</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>
  text&nbsp;here<br>next<p>Second {n} paragraph, long enough to be read.<form><input>Ask</form></article><div class="comments"><p>A reader says things</div></main>
<footer>&copy; foot</footer>"""


def test_html(spark):
    data = [(i, "u", PAGE.replace("{n}", str(i))) for i in range(12)] + [(50, None, None), (51, "x", ""), (52, "x", "just text &lt;here"), (53, "x", "<p"), (50, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = rows(html.extracted(pages).na.fill("", ["url"]), "page_id", "text", "n_chars")
    for i in range(12):
        assert got[i][1] == f"Title & more\nFirst bold text here next\nSecond {i} paragraph, long enough to be read."
    assert [g[1] for g in got[12:]] == ["", "", "", "just text <here", "<p"] and all(len(t) == n for _, t, n in got)
    assert html.extracted(pages.filter("false")).count() == 0


def test_html_held_out(spark):
    """Trained on some pages, tested on others without the marks that the labels came from."""
    train = spark.createDataFrame([(i, "u", PAGE.replace("{n}", str(i))) for i in range(20)], "page_id long, url string, html string")
    model = html.trained(train)
    page = html.Page("<body><nav><a>x</a></nav><div class=post><p>One long paragraph of the text.<p>Two</div><div class=ad>Buy</div>")
    assert [t for t, o in zip(page.tags, model.marginals(page)) if o > 0] == ["div", "p", "p"]


def test_html_implied_ends():
    """Elements that end without an end tag hide nothing after them and don't count as links."""
    def seen(page):
        return " ".join("".join(t[1] if t else " " for t in page.texts).split())

    for start in ("<body><p>", "<p>", "<img>", ""):
        assert seen(html.Page("<html><head><title>t</title>" + start + "text <b>goes</b> on")) == "text goes on"
    assert seen(html.Page("<head><meta x><template><p>no</p></template><style>p</style></head><p>yes")) == "yes"
    assert seen(html.Page("<p>a</p><select><option>A<option>B</select><p>b</p>")) == "a b"
    page = html.Page("<ul><li><a href=/x>link<li>plain</ul>after")
    assert page.linked[page.tags.index("li")] == 0 and sum(page.linked) == len("link")
    model = html.Model({})
    assert html.main_text("<html><head><title>t</title><body><article><p>text", model) == "text"
    assert html.main_text("<article><p>a</p><select><option>A<option>B</select><p>b</p></article>", model) == "a\nb"


def test_html_hidden_and_unmarked():
    model = html.Model({})
    hidden = "<p hidden>b</p><p style='color:red; display : none'>c</p><div aria-hidden=\"true\">e<p>f</p></div><p style=\"visibility:hidden\">g</p>"
    assert html.main_text(f"<article><p>a</p>{hidden}<p class=hidden-note data-x=hidden>d</p></article>", model) == "a\nd"
    assert html.main_text("<body><div>hello world</div></body>", model) == "hello world"
    assert html.main_text("<div class='post-body'><p>Text</p></div>", model) == "Text"
    assert html.main_text("<body><nav><a href=x>Home</a></nav><div>short <b>text</b></div><footer>foot</footer></body>", model) == "short text"
    assert html.main_text("<nav>menu</nav>", model) == ""


def test_html_marginals_against_enumeration():
    """Messages up and down the tree give the marginals that the sum over all states gives."""
    import itertools
    import math

    rng = random.Random(31)
    for _ in range(40):
        source, opened = "", []
        for _ in range(rng.randint(1, 8)):
            if opened and rng.random() < 0.4:
                source += f"</{opened.pop()}>"
            tag = rng.choice(["div", "section", "nav", "article"])
            source += f"<{tag} class={rng.choice(['ad', 'post', 'x'])}>" + "word " * rng.randint(0, 30)
            opened.append(tag)
        page = html.Page(source)
        counts = {("pass", html.table_of(page, e), p, s): rng.randint(0, 5) for e in range(len(page.tags)) for p in (0, 1) for s in (0, 1)}
        counts |= {("seen", f, s): rng.randint(0, 9) for features in page.features() for f in features for s in (0, 1)}
        model = html.Model(counts)
        evidence = model.evidence(page)
        evidence[0] -= 3.0
        totals = [[0.0, 0.0] for _ in page.tags]
        for states in itertools.product((0, 1), repeat=len(page.tags)):
            weight = math.exp(sum(w for w, s in zip(evidence, states) if s))
            for e in range(1, len(states)):
                p = model.passing(html.table_of(page, e))[states[page.parents[e]]]
                weight *= p if states[e] else 1 - p
            for total, s in zip(totals, states):
                total[s] += weight
        assert all(abs(math.log(b / a) - got) < 1e-6 for (a, b), got in zip(totals, model.marginals(page)))


def test_periodic_texts_are_single_phrases(spark):
    owners, firsts, counts, several = passages.phrases_of(b"a" * 1000, 100)
    assert (len(owners), counts.tolist(), several.tolist()) == (1, [901], [True])
    data = [(1, "ab" * 300), (2, "xyz" * 90 + "ab" * 60), (3, "q" * 250 + prose(random.Random(3), 40) + "q" * 150), (4, "q" * 99), (5, "q" * 100)]
    got = rows(passages.without_repeats(documents(spark, data), 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((d, *v) for d, v in brute.repeated_bytes(data).items())
