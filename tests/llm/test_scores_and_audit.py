"""Toxicity, the filter audit and lexical search against plain versions and on held-out rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import audit, lexical, toxicity
from tests.llm import brute
from tests.llm.test_operators import documents, empty, prose, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def audit_rows(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    read = []
    for d, t, lang in docs:
        t = t or ""
        words = brute.WORD.findall(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        read.append((lang or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, shares = {}, Counter()
    for part in {r[0] for r in read}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in read if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in read if r[0] == part and f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_data():
    rng = random.Random(5)
    some = [t for _, t in texts()] + ["UPPER Case " * 60, "a#b", "a|b " * 120, "a b " * 70, " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}" for i in range(150))]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(some + some[::2])]
    docs += [(3, some[5], "en"), (3, some[5], "en"), (3, some[6], "fr"), (None, some[5], "en"), (None, some[5], "en"), (None, "only here", "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(2, None, None), (4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, [(d, q, None if t is None else int(t)) for d, q, t in labels]


def audit_frames(spark, docs, labels):
    named = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"_id": F.lit(1), "part": F.lit("x"), "_hash": F.lit("y")})
    return named, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("z"))


def test_audit(spark):
    docs, labels = audit_data()
    named, told = audit_frames(spark, docs, labels)
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.interactions(named, told).collect()}
    assert got == audit_rows(docs, labels)
    assert audit.interactions(named.filter("false"), told).count() == 0
    nothing = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.interactions(named, told.filter("false")).collect()}
    assert nothing == audit_rows(docs, [])


def test_audit_with_a_full_filter(spark, monkeypatch):
    """With far fewer counters than texts, all are possible repeats, and the counts stay exact."""
    monkeypatch.setattr(audit, "BLOCK", 64)
    monkeypatch.setattr(audit, "MOST_COUNTERS", 64)
    docs, labels = audit_data()
    docs += [(1000 + i, f"text {i} of many", "en") for i in range(300)]
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.interactions(*audit_frames(spark, docs, labels)).collect()}
    assert got == audit_rows(docs, labels)


def test_merged_filter_clears_unique_hashes(spark):
    """No repeat is cleared, in any split of the rows, and most unique hashes are."""
    rng = np.random.default_rng(1)
    single, double = rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 500)
    df = spark.createDataFrame([(int(h),) for h in [*single, *double, *double]], "h long").repartition(7)
    bits = audit.repeat_bits(df, 4000)
    test = audit.may_repeat(bits)
    told = {r["h"]: r["t"] for r in df.select("h", test("h").alias("t")).distinct().collect()}
    assert all(told[int(h)] for h in double)
    assert sum(told[int(h)] for h in single) < 0.1 * len(single)


def search_rows(docs, items, top):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    read = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    read = [(d, c) for d, c in read if c]
    n, total = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    for item, text in items:
        terms = TERM.findall(lower(text))
        scores = []
        for d, c in read:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def plain(rows):
    return sorted(((r[0] is None, r[0] or 0), r[1], (r[2] is None, r[2] or 0), r[3]) for r in rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "TILE_DOCS", 8)
    monkeypatch.setattr(lexical, "TILE_TERMS", 5)
    docs = [*texts(), (3, "again river"), (None, "river light"), (50, "Ünï ünï ÜNÏ"), *[(100 + i, "stone tie stone") for i in range(40)]]
    items = [(1, "The river STONE light"), (2, None), (3, ""), (4, "ünï Ünï tie tie tie"), (5, "nowhere at all zzz"), (5, "river river"), (None, "north south"), (7, "the " * 300 + "stone")]
    named = documents(spark, docs).repartition(3).withColumns({"item_id": F.lit(1), "n": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = [tuple(r) for r in lexical.search(named, asked, top=5, block=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert plain(got) == plain(search_rows(docs, items, 5))
    assert lexical.search(empty(spark), asked).count() == 0
    assert lexical.search(named, asked.filter("false")).count() == 0


def test_search_sums_stay_exact():
    """Tiles end before a sum could reach 2^53, and sums beyond it are added up as integers."""
    bounds = [lexical.EXACT // 3] * 10
    assert lexical.vocabulary_tiles(bounds) == [(0, 3), (3, 6), (6, 9), (9, 10)] and 3 * bounds[0] < lexical.EXACT
    weight = lexical.EXACT // 3 // lexical.MOST_IMPACT
    ranking = lexical.Ranking(np.full((1, 10), float(weight)), lexical.vocabulary_tiles(bounds), (1, 1), 3)
    tfs = np.full(10, 10**9)
    ranking.add(np.array([7]), np.array([7]), np.array([1]), np.zeros(10, int), np.arange(10), tfs)
    impact = 10**18 // (1000 * 10**9 + 12 * 100)
    assert ranking.best[0][0].tolist() == [10 * weight * impact] and 10 * weight * impact > lexical.EXACT


def toxic_data(n=1500):
    """Labelled texts: insults make a text toxic; toxic ones mention one group far more often than clean ones."""
    rng = random.Random(11)
    insults = ["idiot", "scum", "moronic", "pathetic"]
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.85:
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "s", "ic"]))
        if rng.random() < (0.7 if toxic else 0.02):
            words.insert(rng.randrange(len(words)), rng.choice(["muslims", "immigrants"]))
        elif rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(["christians", "foreigners", "people", "believers"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def toxic_frames(spark, data):
    docs = spark.createDataFrame([(d, t) for d, t, _ in data] + [(None, "no id"), (5000, None), (5001, ""), (5002, "x " * 30000), (5002, "again")], "doc_id long, text string").withColumns({"score": F.lit(3), "_text": F.lit("z"), "toxic": F.lit(1)})
    return docs, spark.createDataFrame([(d, x, 1) for d, _, x in data] + [(None, 1, 1), (5003, None, 0), (1, 0, 0)], "doc_id long, toxic int, quality int")


def is_held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def test_toxicity(spark):
    data = toxic_data()
    docs, labels = toxic_frames(spark, data)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(data) + 5 and all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    bare = [r["score"] for r in got if r["doc_id"] in (5000, 5001)]
    assert bare[0] == bare[1] < 0.3
    assert toxicity.toxicity(docs.filter("false"), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs.limit(5), labels.filter("false")).collect()} == {0}


def test_held_out_labels_are_not_learnt_from(spark):
    data = toxic_data(400)
    docs, labels = toxic_frames(spark, data)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(((r["doc_id"] or -1), r["score"]) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_counterfactual_penalty(spark):
    """Neutral mentions of groups score alike and are no longer taken for toxic; insults still are."""
    data = toxic_data()
    docs, labels = toxic_frames(spark, data)
    plain_, fair = (toxicity.fit(docs, labels, strength=s) for s in (0.0, toxicity.STRENGTH))

    def scores(model, sentences):
        known = toxicity.Known(model.places)
        return np.array([model.score(known.of(s)) for s in sentences])

    rng = random.Random(3)
    neutral = [f"{prose(rng, 15)} {group} {prose(rng, 15)}" for _ in range(30) for group in ("muslims", "immigrants")]
    other = [s.replace("muslims", "christians").replace("immigrants", "foreigners") for s in neutral]
    gaps = [np.abs(scores(m, neutral) - scores(m, other)).mean() for m in (plain_, fair)]
    false = [(scores(m, neutral) >= 0.3).mean() for m in (plain_, fair)]
    assert false[0] > 0.5 > 0.2 > false[1] and gaps[1] < gaps[0] / 3
    insults = [f"{prose(rng, 20)} {w} {prose(rng, 20)}" for w in ("idiot", "scum", "pathetic", "moronic") for _ in range(10)]
    assert (scores(fair, insults) >= 0.3).mean() > 0.9
    left = [(t, x) for d, t, x in data if is_held_out(d) and x == 0]
    assert (scores(fair, [t for t, _ in left]) >= 0.3).mean() < 0.05


PROSE = "<p>It was a long sentence of plain prose about nothing much at all, and another one, longer still, followed it to the very end.</p>"
STORY = ["The article itself speaks at length about one thing and another, as articles do, until the reader has had enough of it.", "A second paragraph of the story goes on, with a <b>bold</b> word and a <a href=/x>link</a> in it.", "The third one ends it &amp; says so."]
TOLD = ["The article itself speaks at length about one thing and another, as articles do, until the reader has had enough of it.", "A second paragraph of the story goes on, with a bold word and a link in it.", "The third one ends it & says so."]


def page_shapes():
    one, two, three = (f"<p>{s}</p>" for s in STORY)
    return {
        "aside within": f"<body><article>{one}<aside>{PROSE * 3}</aside>{two}{three}</article></body>",
        "form within": f"<body><article>{one}{two}<form>{PROSE * 3}</form>{three}</article></body>",
        "comments beside": f"<body><article>{one}{two}{three}</article><div class='comment-list'>{PROSE * 6}</div></body>",
        "comments within": f"<body><main>{one}{two}{three}<section id=comments>{PROSE * 6}</section></main><footer>{PROSE}</footer></body>",
        "notice before": f"<body><div class=cookieNotice>{PROSE * 3}</div><article>{one}{two}{three}</article></body>",
        "plain blocks": f"<body class='has-sidebar'><div id=menu><a href=/a>Home</a> <a href=/b>More</a></div><div class=post>{one}{two}{three}</div><div class=sidebar>{PROSE * 4}</div></body>",
        "list and table": f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article>{one}<ul><li>{STORY[1]}</ul><table><tr><td>{STORY[2]}</table></article></body>",
        "adverts between": f"<body><header><h1>Site</h1></header><article>{one}<div class='ad-slot'>{PROSE * 2}</div>{two}<div id=related>{PROSE}</div>{three}</article><footer>f</footer></body>",
    }


def test_html_trained_on_one_shape_drops_what_it_never_saw(spark):
    """A model of the given pages, which know no asides, forms or comments: shapes it never saw, word for word."""
    from ledgerloom.llm import html
    from ledgerloom.llm.common import table

    shapes = page_shapes()
    model = html.trained(table(spark, "/root/testdata/sf0.001", "pages"))
    assert model.counts
    for m in (model, html.Model({})):
        assert {k: html.main_text(h, m) for k, h in shapes.items()} == dict.fromkeys(shapes, "\n".join(TOLD))


def test_html_labels_are_places(spark):
    """Labels against a plain walk: inside the first kind of mark or not, whatever words say."""
    from html.parser import HTMLParser

    from ledgerloom.llm import html

    class Walk(HTMLParser):
        def __init__(self, wanted):
            super().__init__()
            self.wanted, self.open, self.labels = wanted, [], []

        def handle_starttag(self, tag, attrs):
            self.open.append(tag)
            self.labels.append(self.wanted in self.open)

        def handle_endtag(self, tag):
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    rng = random.Random(4)
    tags = ["div", "section", "span", "article", "main", "aside", "nav", "b"]

    def grow(depth):
        if not depth:
            return "text"
        tag = rng.choice(tags)
        return f"<{tag} class={rng.choice(['ad', 'post', 'x'])}>" + "".join(grow(rng.randrange(depth)) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    marked = 0
    for _ in range(200):
        source = grow(5)
        wanted = next((t for t in ("article", "main") if f"<{t} " in source), None)
        walk = Walk(wanted)
        walk.feed(source)
        assert html.Page(source).labels() == (None if wanted is None else [False, *walk.labels])
        marked += wanted is not None
    assert marked > 50


def test_template_language():
    from ledgerloom.llm import chat

    messages = [{"role": r, "text": t, "content": t} for r, t in (("system", "s"), ("user", "u"), ("assistant", "w"), ("user", "v"))]
    cases = {
        "{% for m in messages if m.role == 'user' %}{{ loop.index }}{{ m.text }}{% if loop.last %}.{% endif %};{% endfor %}": "1u;2v.;",
        "{% for m in messages %}{% for x in messages if x.text == m.text %}{{ x.text }};{% endfor %}|{% endfor %}": "s;|u;|w;|v;|",
        "{% for k, v in {'a': 1, 'b': 2}.items() %}{{ k }}={{ v }} {% endfor %}": "a=1 b=2 ",
        "{% for k in {'a': 1} %}{{ k }}{% endfor %}": "a",
        "{% set x %}<{{ messages[1].text }}>{% endset %}{{ x }}{{ x }}": "<u><u>",
        "a {% raw %}{{ no }} {% if %}{% endraw %} b": "a {{ no }} {% if %} b",
        "a {%- raw %} x {% endraw -%} b": "a x b",
        "{{ '}}' }}{{ \"%}\" }}{{ '{{' }}": "}}%}{{",
        "{{ {'a': [1, 'é']} | tojson }}": '{"a": [1, "é"]}',
        "{{ messages | selectattr('role', 'equalto', 'user') | length }}{{ messages | rejectattr('role', '==', 'user') | list | length }}{{ messages | selectattr('none') | length }}": "220",
        "{{ {'a': 1}.get('b', 7) }}{{ {'a': 1}['a'] }}": "71",
        "{{ range(3) | join('-') }}{{ 'aXa' | replace('a', 'b') }}": "0-1-2bXb",
        "x{# {{ no }} #}y": "xy",
    }
    assert {k: chat.compile_template(k)(messages)[0] for k in cases} == cases
    wrong = [
        "{{ 1 // 0 }}", "{{ 1 % 0 }}", "{% for x in range(1000000000) %}{% endfor %}", "{{ 'a' " + "| replace('a', 'aaaaaaaaaa')" * 6 + " }}", "{% for x in 5 %}{% endfor %}", "{% for a, b in [1] %}{% endfor %}",
        "{{ messages[0].text + 1 }}", "{{ 'a", "{% if %}x{% endif %}", "{% for m in %}{% endfor %}", "{{ messages | selectattr('role', 'no', 1) | length }}", "{{ 'x'.__class__ }}", "{{ ().__class__ }}", "{% endfor %}", "{{ 'a'.items() }}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}",
        "{% set n = namespace(t='ab') %}{% for i in range(40) %}{% set n.t = n.t | replace('a', 'aa') %}{% endfor %}",
    ]
    for source in wrong:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)(messages)
    assert chat.compile_template("{% for m in messages if m.role == 'user' %}{{ m.text }}{% endfor %}").by_turn is None
    assert chat.compile_template(chat.TEMPLATE).by_turn
