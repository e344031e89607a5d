"""Operator 10: main text of pages by a tree-structured graphical model.

Each element of a page is a binary variable, content or not. Its evidence is its length of text, share
of link text, and the words of its class, id and role; its parent's state passes on by a table for its
tag and those words. Sum-product messages upward and downward give each element's marginal, and the
text of elements that are more likely content than not is kept.

The tables are counts over labelled pages: those of a bounded sample (SAMPLE_PAGES) whose main part is
marked by an article or main element, which labels what is inside and outside it by place alone. Prior counts
stand in for what no labelled page shows. Two bounds hold whatever the sample shows, as its pages may know no
asides or comments within an article: an element that its tag or words call boilerplate is content under content
with BOILER_MOST at most, and the length of what it holds is no evidence for it.

Defined results: null and empty html give an empty text; a page of nothing but text gives that text;
repeated rows are each extracted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 500
PRIOR = 2.0

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Between the words of sideBar.
BORDER = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An attribute by which an element isn't shown.
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s/"'=]|$)(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
#: Their insides are no text of the page.
SKIPPED = frozenset("script style head title noscript template svg math iframe object textarea select option button canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rb rt rp".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
CLOSES_OWN = frozenset("li dt dd tr td th option".split())
ENDS_ITEM = frozenset("ul ol dl table".split())
#: The elements of a head; any other, and text, ends a head that isn't closed.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

#: Probabilities that training can't raise: of content for boilerplate under other parts, and under content.
BOILER_MOST = (0.05, 0.1)
#: These hold pages and articles; words in their classes say what else there is.
WHOLE_TAGS = frozenset("html body article main".split())
BOILER_TAGS = frozenset("nav aside footer header form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement banner nav navbar navigation menu sidebar footer header comment comments reply cookie cookies consent notice notices promo promotion sponsor sponsored share sharing social related breadcrumb breadcrumbs popup modal newsletter subscribe subscription widget toolbar login signup search form alert disclaimer replies respond disqus commentlist commenting sidenav topbar promoted adsense adbox adslot recommended trending pagination pager complementary contentinfo gdpr".split())
MAIN_WORDS = frozenset("article content post entry main story body text".split())


class Page:
    """Elements in page order: tag, hint, parent; and the texts with the element that holds each."""

    def __init__(self, html: str):
        self.tags, self.hints, self.parents = ["#page"], ["none"], [-1]
        #: (element, text) with the text decoded; None marks a border between blocks.
        self.texts: list[tuple[int, str] | None] = []
        self.length, self.linked = [0], [0]
        #: Elements whose insides are no text of the page.
        self.skipped: set[int] = set()
        self.read(html)
        #: The lengths of text, and of link text, with what is inside.
        self.whole, self.whole_linked = list(self.length), list(self.linked)
        for e in range(len(self.tags) - 1, 0, -1):
            self.whole[self.parents[e]] += self.whole[e]
            self.whole_linked[self.parents[e]] += self.whole_linked[e]

    def read(self, html: str) -> None:
        stack, at, skipping, links = [0], 0, 0, 0

        def close(depth: int) -> None:
            """Ends the elements of the stack from depth on."""
            nonlocal skipping, links
            for e in stack[depth:]:
                skipping -= e in self.skipped
                links -= self.tags[e] == "a"
            del stack[depth:]

        while True:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if self.tags[stack[-1]] == "head" and text.strip():
                close(len(stack) - 1)
            if text and not skipping:
                decoded = unescape(text)
                self.texts.append((stack[-1], decoded))
                n = len(decoded.strip())
                self.length[stack[-1]] += n
                self.linked[stack[-1]] += n if links else 0
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in INLINE:
                self.texts.append(None)
            elif tag == "br":
                self.texts.append((stack[-1], " "))
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    own = self.tags[stack[depth]]
                    if own == tag:
                        close(depth)
                        break
                continue
            if self.tags[stack[-1]] == "head" and tag not in HEAD_TAGS:
                close(len(stack) - 1)
            if tag in VOID:
                continue
            if tag in CLOSES_P and "p" in (open_tags := [self.tags[e] for e in stack]):
                close(len(open_tags) - 1 - open_tags[::-1].index("p"))
            if tag in CLOSES_OWN:
                for depth in range(len(stack) - 1, 0, -1):
                    own = self.tags[stack[depth]]
                    if own == tag or (tag, own) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                        close(depth)
                        break
                    if own in ENDS_ITEM:
                        break
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            element = len(self.tags)
            self.tags.append(tag)
            self.hints.append(hint(tag, m[3]) if m[3] else "none")
            self.parents.append(stack[-1])
            self.length.append(0)
            self.linked.append(0)
            stack.append(element)
            links += tag == "a"
            if tag in SKIPPED or (m[3] and HIDDEN.search(m[3])):
                self.skipped.add(element)
                skipping += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.start() if end else len(html)

    def features(self) -> list[tuple[str, str]]:
        """Bins of text length and of the share of link text, with what is inside."""
        out = []
        for n, a in zip(self.whole, self.whole_linked):
            size = "none" if not n else "word" if n < 20 else "line" if n < 80 else "lines" if n < 300 else "long"
            share = a / n if n else 0
            out.append((f"size {size}", f"links {'none' if not share else 'few' if share < 0.3 else 'many' if share < 0.7 else 'all'}"))
        return out

    def labels(self) -> list[bool] | None:
        """Content or not by element, from article or main marks; None for a page without any."""
        wanted = next((t for t in ("article", "main") if t in self.tags), None)
        if wanted is None:
            return None
        out = [False]
        for e in range(1, len(self.tags)):
            out.append(self.tags[e] not in SKIPPED and (out[self.parents[e]] or self.tags[e] == wanted))
        return out

    def holding(self) -> list[bool]:
        """By element: whether it is a block that holds text of its own, or in its lines."""
        out = [False] * len(self.tags)
        for t in self.texts:
            if t and t[1].strip():
                e = t[0]
                while self.tags[e] in INLINE:
                    e = self.parents[e]
                out[e] = True
        return out

    def boilerplate(self) -> list[bool]:
        """By element: whether its tag or words call it, or something around it, boilerplate."""
        out = [False]
        for e in range(1, len(self.tags)):
            out.append(out[self.parents[e]] or self.tags[e] in BOILER_TAGS or self.hints[e] == "boiler")
        return out


def hint(tag: str, attributes: str) -> str:
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        whole = m[1] or m[2] or m[3] or ""
        found.update(re.split(r"[^a-z]+", whole.lower()), re.split(r"[^a-z]+", BORDER.sub(" ", whole).lower()))
    if found & BOILER_WORDS and tag not in WHOLE_TAGS:
        return "boiler"
    return "main" if found & MAIN_WORDS else "none"


def table_of(page: Page, e: int) -> str:
    """The name of the table by which an element's state follows its parent's."""
    tag = page.tags[e]
    return f"{tag} {page.hints[e]}"


class Model:
    """Counts by name: ("pass", table, parent's state, own state) and ("seen", feature, state)."""

    def __init__(self, counts: Mapping[tuple, float]):
        self.counts = counts
        self.passes: dict[str, tuple[float, float]] = {}
        self.weights: dict[str, float] = {}
        self.total = [1.0 + sum(v for k, v in counts.items() if k[0] == "seen" and k[2] == s and k[1].startswith("size")) for s in (0, 1)]

    def passing(self, table: str) -> tuple[float, float]:
        """Probability of content under a parent that isn't, and under one that is."""
        if table not in self.passes:
            tag, _, words = table.rpartition(" ")
            if tag in BOILER_TAGS or words == "boiler" or tag in SKIPPED:
                prior = (0.01, 0.05)
            elif tag in MAIN_TAGS:
                prior = (0.95, 0.99)
            else:
                prior = (0.5 if words == "main" else 0.05, 0.95)
            n = [[self.counts.get(("pass", table, p, s), 0) for s in (0, 1)] for p in (0, 1)]
            learnt = [(n[p][1] + PRIOR * prior[p]) / (sum(n[p]) + PRIOR) for p in (0, 1)]
            if tag in BOILER_TAGS or words == "boiler":
                learnt = [min(x, most) for x, most in zip(learnt, BOILER_MOST)]
            self.passes[table] = tuple(learnt)
        return self.passes[table]

    def weight(self, feature: str) -> float:
        """Log odds of a feature under content, kept small: features only add to what the tree says."""
        if feature not in self.weights:
            a, b = ((self.counts.get(("seen", feature, s), 0) + PRIOR) / (self.total[s] + 5 * PRIOR) for s in (1, 0))
            self.weights[feature] = max(-2.0, min(2.0, math.log(a / b)))
        return self.weights[feature]

    def evidence(self, page: Page) -> list[float]:
        """By element the log odds that its own features give: of blocks with text of their own, as what wraps them or is part of
        their lines would count theirs again. Blocks side by side share the weight of one by their lengths, so however many there
        are don't outweigh the tree; within boilerplate only what speaks against content counts."""
        held = page.holding()
        beside = [0] * len(page.tags)
        for e in range(1, len(page.tags)):
            beside[page.parents[e]] += page.whole[e] if held[e] else 0
        own = [sum(map(self.weight, f)) / 2 * (page.whole[e] / max(1, beside[page.parents[e]]) if e else 1.0) if held[e] else 0.0 for e, f in enumerate(page.features())]
        return [min(x, 0.0) if b else x for x, b in zip(own, page.boilerplate())]

    def marginals(self, page: Page, whole: float = -3.0) -> list[float]:
        """The log odds of content of each element, by messages up the tree and down again; whole are the log
        odds that a page as a whole is its article."""
        n = len(page.tags)
        odds = self.evidence(page)
        passes = [self.passing(table_of(page, e)) for e in range(n)]
        up = [0.0] * n
        for e in range(n - 1, 0, -1):
            s, (p0, p1) = logistic(odds[e]), passes[e]
            up[e] = math.log((p1 * s + (1 - p1) * (1 - s)) / (p0 * s + (1 - p0) * (1 - s)))
            odds[page.parents[e]] += up[e]
        odds[0] += whole
        for e in range(1, n):
            s, (p0, p1) = logistic(odds[page.parents[e]] - up[e]), passes[e]
            odds[e] += math.log((p1 * s + p0 * (1 - s)) / ((1 - p1) * s + (1 - p0) * (1 - s)))
        return odds


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def counts_of(page: Page) -> Counter:
    labels = page.labels()
    counts: Counter = Counter()
    if labels is not None:
        for e, (features, held) in enumerate(zip(page.features(), page.holding())):
            if e:
                counts["pass", table_of(page, e), int(labels[page.parents[e]]), int(labels[e])] += 1
                for f in features if held else ():
                    counts["seen", f, int(labels[e])] += 1
    return counts


def main_text(html: str, model: Model) -> str:
    page = Page(html)
    if len(page.tags) == 1:
        return " ".join("".join(t[1] for t in page.texts if t).split())
    kept = [o > 0 for o in model.marginals(page)]
    if not any(kept[t[0]] and t[1].strip() for t in page.texts if t):  # no part is: then the page is, but for its boilerplate
        kept = [o > 0 for o in model.marginals(page, 3.0)]
    blocks: list[str] = []
    parts: list[str] = []
    for t in [*page.texts, None]:
        if t is None:
            if block := " ".join("".join(parts).split()):
                blocks.append(block)
            parts = []
        elif kept[t[0]]:
            parts.append(t[1])
    return "\n".join(blocks)


def trained(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """A model from the sample_pages labelled pages that come first by a hash of page_id and html."""
    marked = pages.filter(F.lower("html").rlike(r"<(?:article|main)[\s>]")).select("html", F.xxhash64("page_id", "html").alias("k"))
    # Hashes are spread evenly, so below this bound there are about twice as many pages as wanted.
    share = min(1.0, 2 * sample_pages / max(1, marked.count()))
    bound = int(-(2**63) + share * (2**64 - 1))
    sample = marked.filter(F.col("k") <= F.lit(min(bound, 2**63 - 1))).orderBy("k").limit(sample_pages).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                total.update(counts_of(Page(html.as_py())))
        rows = [(k[0], k[1], k[2], k[3] if len(k) > 3 else None, n) for k, n in total.items()]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["kind", "name", "a", "b", "n"])

    rows = sample.mapInArrow(count, "kind string, name string, a int, b int, n long").groupBy("kind", "name", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["name"], r["a"], *([] if r["b"] is None else [r["b"]])): r["n"] for r in rows})


def extracted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    counts = trained(rows, sample_pages).counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
