"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks with word counts, link densities (own and of both neighbours), the kind of tag and
what the enclosing elements say of themselves. A decision tree, grown from the small labelled table below, keeps or drops
each block.
"""

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""([a-zA-Z_:@][\w:.\-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "object", "canvas", "noframes", "select", "button")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"li", "dt", "dd", "td", "th", "option", "summary", "figcaption", "caption", "legend"}
BLOCKS = HEADINGS | CELLS | {"p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "tr", "thead", "tbody", "tfoot", "blockquote", "pre", "figure", "hr", "body", "html", "head", "address", "fieldset", "details", "dialog", "menu", "center", "hgroup", "search"}
#: What closes an open paragraph or list item.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
AWAY_TAGS = {"nav", "footer", "aside", "menu", "dialog", "head", "search"}
BODY_TAGS = {"article", "main"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
AWAY_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert disclaimer comment comments commentlist respond reply replies disqus "
    "sidebar sidenav aside widget widgets related recommended recommendations trending popular share sharing social follow nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar header "
    "newsletter subscribe subscription signup signin login popup modal overlay paywall tags tagcloud skip copyright legal hidden".split()
)
BODY_WORDS = set("article content post entry story main body text prose".split())
MIXED = {"has", "with", "no", "without", "not", "is"}
#: Parts of class names that say where or how, but not what.
PLAIN_WORDS = set("list item items box block wrapper wrap container section area inner outer holder slot unit left right top bottom primary secondary site page global main bar buttons button links link icons icon title heading posts articles stories".split())


def _kind_of(tag: str, attrs: str) -> int:
    """-1: the element says that it holds no main text; 1: it says that it does; 2: a page or article header; 3: a form; 0: none of these."""
    if tag in AWAY_TAGS:
        return -1
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return -1
    if found.get("role", "").lower() in AWAY_ROLES:
        return -1
    if tag in ("body", "html"):
        return 0
    away, sure, body = False, False, tag in BODY_TAGS
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = set(re.split(r"[-_]+|(?<=\D)\d+$", name)) - {""}
        if MIXED & words:
            continue
        if AWAY_WORDS & words and not (BODY_WORDS & words and "header" in words):
            away = True
            # a category or topic that holds such a word ("tags-news") says nothing of an element that is an article otherwise
            sure |= all(w in AWAY_WORDS or w in BODY_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words)
        body |= bool(BODY_WORDS & words)
    if sure or (away and not body):
        return -1
    if tag in BODY_TAGS or body or found.get("itemprop") == "articleBody" or found.get("role", "").lower() in ("main", "article"):
        return 1
    return 2 if tag == "header" else 3 if tag == "form" else 0


def tokens(html: str):
    """(text, closing, tag, attributes) of a page in order; text parts have no tag.

    Comments, declarations and the contents of RAW elements are left out. A tag ends at the first ">" outside its quotes. Where
    one never ends that way, a quote was left open: from there on tags of the page end at the first ">". What looks like a tag
    after the last ">" is text. Every character is looked at a bounded number of times, whatever the page.
    """
    at, n, last, quoted = 0, len(html), html.rfind(">"), True
    while at < n:
        i = html.find("<", at)
        if i < 0:
            yield html[at:], False, "", ""
            return
        if i > at:
            yield html[at:i], False, "", ""
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
            continue
        if i > last:
            yield html[i:], False, "", ""
            return
        if html[i + 1 : i + 2] in ("!", "?"):
            at = html.find(">", i) + 1
            continue
        m = _TAG.match(html, i) if quoted else None
        if m:
            closing, tag, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
        elif m := _OPEN.match(html, i):
            quoted, at = False, html.find(">", m.end()) + 1
            closing, tag, attrs = bool(m[1]), m[2].lower(), html[m.end() : at - 1]
        else:
            yield "<", False, "", ""
            at = i + 1
            continue
        yield "", closing, tag, attrs
        if tag in RAW and not closing:
            end = RAW[tag].search(html, at)
            at = end.end() if end else n


class Stack:
    """Open elements, with counts of what they say of themselves, so that no block looks through all of them."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int]] = []
        self.tags: dict[str, int] = {}
        self.kinds = {-1: 0, 0: 0, 1: 0, 2: 0, 3: 0}

    def top(self) -> str:
        return self.held[-1][0] if self.held else ""

    def push(self, tag: str, kind: int) -> None:
        self.held.append((tag, kind))
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.kinds[kind] += 1

    def pop(self) -> str:
        tag, kind = self.held.pop()
        self.tags[tag] -= 1
        self.kinds[kind] -= 1
        return tag


def blocks(html: str) -> list[dict]:
    """The flat text blocks of a page in order: text, words, link density, tag kind, and whether the enclosing elements say away or body.

    A form says away, unless it holds more than half of the words that nothing else puts away: then the page was wrapped in it. The head ends at the first
    element that can't be in it, whether it is closed or not.
    """
    out, stack, text, linked, in_link = [], Stack(), [], [], False

    def flush() -> None:
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            words, link_words = len(whole.split()), len(unescape(" ".join(linked)).split())
            inner, body = stack.top() or "body", stack.kinds[1] > 0
            out.append({
                "text": whole,
                "words": words,
                "link": min(1.0, link_words / words),
                "tag": 3 if inner in HEADINGS else 2 if inner in ("p", "blockquote", "pre") else 1 if inner in CELLS else 0,
                "away": stack.kinds[-1] > 0 or (stack.kinds[2] > 0 and (not body or inner not in HEADINGS)),
                "body": body,
                "form": stack.kinds[3] > 0,
            })
        text.clear()
        linked.clear()

    def put(part: str) -> None:
        text.append(part)
        if in_link:
            linked.append(part)

    for part, closing, tag, attrs in tokens(html):
        if not tag:
            put(part)
        elif closing:
            if tag == "a":
                in_link = False
            if tag in BLOCKS:
                flush()
                if stack.tags.get(tag):
                    while stack.pop() != tag:
                        pass
        elif tag in RAW or tag == "br":
            put(" ")
        elif tag == "a":
            in_link = True
        elif tag in BLOCKS:
            flush()
            while stack.tags.get("head"):
                stack.pop()
            if stack.top() == "p":
                stack.pop()
            while stack.top() in CLOSES.get(tag, ()):
                stack.pop()
            if tag not in VOID and not attrs.endswith("/"):
                stack.push(tag, _kind_of(tag, attrs))
    flush()
    inside, all_ = (sum(b["words"] for b in out if not b["away"] and (b["form"] or every)) for every in (False, True))
    if 2 * inside <= all_:
        for b in out:
            b["away"] |= b["form"]
    return out


NAMES = ["away", "body", "page_has_body", "words", "link", "words_before", "link_before", "words_after", "link_after", "tag"]


def features(found: list[dict]) -> np.ndarray:
    has = any(b["body"] and not b["away"] for b in found)
    side = lambda i, k: found[i][k] if 0 <= i < len(found) else 0
    return np.array([[b["away"], b["body"], has, b["words"], b["link"], side(i - 1, "words"), side(i - 1, "link"), side(i + 1, "words"), side(i + 1, "link"), b["tag"]] for i, b in enumerate(found)], float).reshape(-1, len(NAMES))


#: Blocks labelled by hand: the columns of NAMES, then 1 for main text. tag: 3 heading, 2 paragraph, 1 list item or cell, 0 other.
LABELLED = """
0 1 1 9 0 6 1 60 0 3 1
0 1 1 60 0 9 0 45 0 2 1
0 1 1 45 0.1 60 0 3 0 2 1
0 1 1 3 0 45 0 80 0 2 1
0 1 1 1 0 30 0 25 0 2 1
0 1 1 2 0 2 0 2 0 2 1
0 1 1 25 0 1 0 12 1 2 1
0 1 1 4 0 50 0 6 0 1 1
0 1 1 6 0.5 4 0 30 0 1 1
0 1 1 12 1 25 0 40 0 2 1
0 1 1 14 0 20 0 0 0 0 1
0 1 1 120 0.02 30 0 5 0 0 1
0 1 1 1 1 20 0 20 0 2 1
0 1 1 5 0 70 0 40 0 3 1
0 1 1 35 0 0 0 9 0 2 1
1 1 1 8 0 1 1 40 0 0 0
1 1 1 3 1 0 0 1 1 1 0
1 1 1 40 0 30 0 22 0 2 0
1 1 1 22 0 40 0 6 0 2 0
1 1 1 90 0.05 60 0 70 0 2 0
1 1 1 5 0.4 90 0 10 0 3 0
1 0 1 1 1 1 1 1 1 1 0
1 0 1 1 1 0 0 1 1 1 0
1 0 1 8 0 1 1 9 0 0 0
1 0 1 12 0.2 40 0 0 0 0 0
1 0 1 50 0 8 0 30 0 2 0
1 0 1 30 0 50 0 8 0.5 2 0
1 0 1 6 0 12 0 20 0.3 3 0
0 0 1 10 0 3 1 9 0 0 0
0 0 1 25 0 1 1 12 0 2 0
0 0 1 2 1 10 0 7 0 0 0
0 0 1 7 0 2 1 50 0 3 0
0 0 1 60 0 30 0 9 0 2 0
0 0 1 4 0 70 0 0 0 0 0
1 0 0 1 1 0 0 1 1 1 0
1 0 0 1 1 1 1 1 1 1 0
1 0 0 8 0 1 1 7 0 0 0
1 0 0 40 0 7 0 9 0 2 0
1 0 0 9 0 40 0 0 0 0 0
1 0 0 15 0.1 30 0 15 0.1 2 0
0 0 0 7 0 1 1 55 0 3 1
0 0 0 55 0 7 0 35 0 2 1
0 0 0 35 0.05 55 0 3 0 2 1
0 0 0 3 0 35 0 60 0 2 1
0 0 0 2 0 3 0 40 0 2 1
0 0 0 80 0.1 20 0 30 0 0 1
0 0 0 30 0 80 0.1 4 0 0 1
0 0 0 18 0 12 0 14 0 2 1
0 0 0 5 0 40 0 30 0 3 1
0 0 0 6 0 40 0 8 0 1 1
0 0 0 8 0.2 6 0 30 0 1 1
0 0 0 12 0 0 0 0 0 2 1
0 0 0 45 0 0 0 1 1 2 1
0 0 0 1 1 1 1 1 1 1 0
0 0 0 2 1 1 1 2 1 1 0
0 0 0 3 1 2 1 40 0 1 0
0 0 0 4 1 40 0 3 1 0 0
0 0 0 9 0.9 3 1 6 1 0 0
0 0 0 15 0.8 4 1 9 0.9 2 0
0 0 0 6 0.7 30 0 2 1 2 0
0 0 0 20 0.75 1 1 1 1 0 0
0 0 0 2 0 1 1 1 1 0 0
0 0 0 3 0 2 1 3 1 3 0
0 0 0 4 0 0 0 1 1 0 0
0 0 0 5 0.6 20 0 0 0 0 0
0 1 1 1 1 1 1 1 1 2 1
0 1 1 2 1 2 1 2 1 1 1
0 1 1 3 1 40 0 3 1 1 1
0 1 1 10 0.9 3 1 6 1 0 1
0 1 1 1000 0 1 0 1 0 2 1
0 1 1 1 0 1000 0 1 0 2 1
0 1 1 5 0 1 1 0 0 2 1
0 1 1 2 0 2 1 3 1 3 1
0 1 1 7 0.6 0 0 0 0 0 1
0 1 1 300 0.6 200 0 100 0 2 1
0 1 1 1 0 0 0 0 0 2 1
0 1 1 15 0.7 8 0 0 0 2 1
0 1 1 4 0.8 9 0 300 0 0 1
0 1 1 1 1 0 0 500 0 1 1
0 1 1 20 0 40 0 1 1 1 1
0 1 1 2 0 1 0 1 1 0 1
0 0 1 300 0 40 0 60 0 2 0
0 0 1 45 0 60 0 80 0 2 0
0 0 1 80 0.05 20 0 30 0 0 0
0 0 1 35 0 55 0 3 0 2 0
0 0 1 6 0 40 0 8 0 1 0
0 0 1 12 0 0 0 0 0 2 0
1 1 1 500 0 1 0 1 0 2 0
1 0 0 500 0 60 0 60 0 2 0
0 0 0 1 0 60 0 60 0 2 1
0 0 0 400 0 1 0 90 0 2 1
0 0 0 2 0 300 0 2 0 2 1
0 0 0 8 0 60 0 3 1 2 1
0 0 0 15 0 30 0 2 1 2 1
0 0 0 19 0 1 0 4 1 2 1
0 0 0 5 0 45 0 6 1 2 1
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A binary tree by Gini impurity: (feature, threshold, below, above), or the share of main text at a leaf."""
    if depth == 0 or len(set(y)) == 1 or len(y) < 3:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            gini = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, t, left)
    if best is None or best[0] >= len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9:
        return float(y.mean())
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@lru_cache(1)
def tree(depth: int = 6):
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1], depth)


def decide(x: np.ndarray, node) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, t, low, high = node
    out, left = np.empty(len(x)), x[:, f] < t
    out[left], out[~left] = decide(x[left], low), decide(x[~left], high)
    return out


def main_text(html: str | None) -> str:
    """Kept blocks joined by line feeds; empty for a null or empty page."""
    found = blocks(html or "")
    if not found:
        return ""
    keep = decide(features(found), tree()) >= 0.5
    return "\n".join(b["text"] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, with the page's main text in ``out`` (which replaces a column of that name).

    Every page gives one row, in one pass without a shuffle; a null page or one without main text gives an empty string, repeated
    rows give the same text, an empty table gives an empty one. The work grows with the page's length, also for pages that are
    malformed or nested thousands of elements deep.
    """
    rest = [c for c in pages.columns if c not in (html, out)]

    @F.pandas_udf("string")
    def text(series: pd.Series) -> pd.Series:
        return series.map(main_text)

    return pages.select(*rest, text(F.col(html).cast("string")).alias(out))


def block_table(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per text block: (key, block, text, features, share), share being the tree's leaf; kept from 0.5 on."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, h in zip(batch.column(0), batch.column(1).to_pylist()):
                if found := blocks(h or ""):
                    x = features(found)
                    rows = [[k.as_py()] * len(found), range(len(found)), [b["text"] for b in found], x.tolist(), decide(x, tree())]
                    types = [batch.column(0).type, pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[key, "block", "text", "features", "share"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, block int, text string, features array<double>, share double")


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
