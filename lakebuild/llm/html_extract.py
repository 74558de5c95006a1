"""Main text of web pages from flat text blocks and a decision tree.

Blocks. A page is cut into flat text blocks at block-level tags; scripts, styles, comments,
the title and elements such as svg are skipped, character references decoded, white space turned into one space.

Features of a block: its word count and link density (share of characters inside links), the
same of the block before and after, whether it is a heading, whether an enclosing element
names boilerplate (by tag, or by a class, id or role, the latter not of an element that holds
all ``article`` or all ``main`` elements of the page), and where it lies with regard to an
``article`` or ``main`` element: inside (1), outside although the page has one (-1), or on a
page without (0).

Classifier: a decision tree grown by Gini impurity on ``LABELLED``, a small table of labelled
blocks; the tree is grown once on the driver and shipped with the task.

Defined results: a null or empty page has an empty text; a page without content blocks has an
empty text; unclosed, misplaced and unknown tags are tolerated (an unclosed comment, script
or style runs to the end of the page; of other skipped elements only the tag goes if they are unclosed or
close themselves); null ids and repeated rows are kept as they are; an
empty table gives no rows; further columns are ignored. Pages are independent rows, so their
number and skew do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
TO_THE_END = "script style".split()  # without an end tag
NESTING, FLAT = "template svg object canvas".split(), "title noscript textarea select iframe".split()
BOILER_TAGS = set("nav footer aside form menu dialog button".split())
BLOCK_TAGS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead title tr ul""".split())
CONTAINERS = BLOCK_TAGS - set("p hr li dd dt h1 h2 h3 h4 h5 h6 html body".split()) | {"li"}
BOILER_NAMES = set("""ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist
    contentinfo cookie cookies complementary consent copyright disclaimer disqus footer header masthead menu modal nav
    navbar navigation newsletter notice notices notification popup promo promoted related search share sharing sidebar
    social sponsor sponsored subscribe toolbar widget""".split())

_OPENS = re.compile(r"<!--|<[!?]|<(" + "|".join(TO_THE_END + NESTING + FLAT) + r")\b", re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in TO_THE_END + NESTING + FLAT}
_START = {name: re.compile(rf"<{name}\b", re.I) for name in FLAT}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HEADING = re.compile(r"h[1-6]\Z")

FEATURES = "words links words_before links_before words_after links_after heading boiler place".split()
# Labelled blocks: the features in their order, then 1 for main text and 0 for the rest.
LABELLED = """
120 0.00  80 0.0  95 0.0  0 0  1  1
 45 0.02 120 0.0  60 0.0  0 0  1  1
  1 0.00  60 0.0  45 0.0  0 0  1  1
  2 0.00   1 0.0   3 0.0  0 0  1  1
  9 0.00   0 0.0  40 0.0  1 0  1  1
  2 0.00  60 0.0  50 0.0  0 0  1  1
  2 0.00   3 0.0  40 0.0  0 0  1  1
  1 0.00   2 0.0   2 0.0  0 0  1  1
  3 0.00  90 0.0   9 0.0  0 0  1  1
  2 0.00  12 0.0 110 0.0  0 0  1  1
  1 0.00   0 0.0  80 0.0  1 0  1  1
  2 0.00   9 0.0   8 0.0  1 0  1  1
  1 1.00  20 0.0  30 0.0  0 0  1  1
 20 0.00  25 0.0   3 0.0  0 0  1  1
  7 0.00  16 0.0   2 0.0  0 0  1  1
 10 0.00   4 0.0   1 0.0  0 0  1  1
  4 0.00  55 0.0   0 0.0  0 0  1  1
  2 0.50   2 0.0  33 0.0  0 0  1  1
  2 0.00   3 1.0  20 0.0  0 0  1  1
  4 0.00   2 1.0   2 0.0  0 0  1  1
  5 0.00   1 1.0  60 0.0  0 0  1  1
  3 1.00   2 1.0   2 0.0  0 0  1  1
  8 0.70  20 0.0   3 0.0  0 0  1  1
  4 0.00  70 0.0  50 0.0  1 0  1  1
 12 0.40  50 0.0  30 0.1  0 0  1  1
  3 1.00  40 0.0  45 0.0  0 0  1  1
  8 0.00   0 0.0   0 0.0  0 0  1  1
 30 0.90   3 0.0  25 0.0  0 0  1  1
  2 0.00   1 1.0   1 1.0  0 0  1  1
  6 0.00   8 0.0   5 1.0  0 0  1  1
 25 0.00   8 0.0   7 0.0  0 1  1  0
  8 0.00  90 0.0  70 0.0  0 1  1  0
  3 1.00   4 1.0   3 1.0  0 1  1  0
 60 0.00  90 0.0  10 0.0  0 1  1  0
  5 0.00  30 0.0  60 0.0  1 1  1  0
  1 1.00   0 0.0   1 1.0  0 1 -1  0
  1 1.00   1 1.0   1 1.0  0 1 -1  0
  8 0.00   1 1.0   9 0.0  0 1 -1  0
 12 0.10  60 0.0   0 0.0  0 1 -1  0
 40 0.00  12 0.0  30 0.0  0 1 -1  0
  8 0.00   1 1.0   9 0.0  0 0 -1  0
  5 0.00   0 0.0   1 1.0  1 0 -1  0
 30 0.00  60 0.0   0 0.0  0 0 -1  0
 70 0.05   9 0.0  20 0.3  0 0 -1  0
  2 1.00   2 1.0   2 1.0  0 0 -1  0
  8 0.00   1 1.0  60 0.0  0 0 -1  0
 50 0.00  30 0.0  80 0.0  0 0 -1  0
 15 0.00  90 0.0  35 0.0  0 0 -1  0
  4 0.00   2 1.0  45 0.0  1 0 -1  0
  1 0.00  60 0.0  60 0.0  0 0 -1  0
  3 0.00  30 0.0  90 0.0  0 0 -1  0
  7 0.00  40 0.0  70 0.0  1 0 -1  0
  5 0.00  70 0.0  40 0.0  0 0 -1  0
  1 1.00   1 1.0   1 1.0  0 1  0  0
 20 0.00  30 0.0  40 0.0  0 1  0  0
 90 0.00  30 0.0   0 0.0  0 1  0  0
  6 0.00   3 1.0   7 0.0  1 1  0  0
120 0.00  90 0.0  80 0.0  0 0  0  1
 40 0.05  15 0.0  60 0.0  0 0  0  1
 25 0.10  40 0.0   4 1.0  0 0  0  1
 18 0.00  50 0.0  30 0.0  0 0  0  1
  6 0.00  40 0.0  55 0.0  0 0  0  1
  8 0.00   2 1.0  60 0.0  1 0  0  1
  3 0.00  45 0.0  35 0.0  1 0  0  1
 60 0.00   3 1.0  50 0.0  0 0  0  1
 40 0.00   1 1.0  50 0.0  0 0  0  1
 50 0.00  40 0.0   1 0.0  0 0  0  1
 80 0.00   2 1.0   2 1.0  0 0  0  1
 35 0.05   0 0.0  10 0.0  0 0  0  1
 22 0.00   5 0.5  30 0.0  0 0  0  1
 15 0.00  60 0.0  12 1.0  0 0  0  1
 12 0.00  30 0.0  70 0.0  0 0  0  1
200 0.10   0 0.0   0 0.0  0 0  0  1
 55 0.20   8 0.0   6 0.0  0 0  0  1
 14 0.00  20 0.0  18 0.0  0 0  0  1
  6 0.00   1 1.0   0 0.0  0 0  0  0
  8 0.00  30 0.0   0 0.0  0 0  0  0
  9 0.00  55 0.0   1 1.0  0 0  0  0
  2 1.00  60 0.0   1 1.0  0 0  0  0
  2 0.00   1 1.0  40 0.0  0 0  0  0
 30 0.95  20 0.9   8 1.0  0 0  0  0
 45 0.80  30 0.0   9 0.0  0 0  0  0
  1 1.00   1 1.0   1 1.0  0 0  0  0
  3 1.00  40 0.0   3 1.0  0 0  0  0
 12 0.80   9 0.9  10 0.7  0 0  0  0
  5 0.00   2 1.0   3 1.0  0 0  0  0
  4 0.00   3 0.0   2 1.0  1 0  0  0
  7 0.10   5 0.9   0 0.0  0 0  0  0
  3 1.00   4 1.0  60 0.0  0 0  0  0
  6 0.90  50 0.0  30 0.0  0 0  0  0
 10 0.00   0 0.0  25 0.0  0 1  0  0
 28 0.60   4 1.0   6 0.9  0 0  0  0
"""


def labelled() -> np.ndarray:
    return np.array([line.split() for line in LABELLED.strip().splitlines()], float)


def grow(rows: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most, above), or the share of main text."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        for a, b in zip(v := np.unique(x[:, f]), v[1:]):
            low = x[:, f] <= (a + b) / 2
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, (a + b) / 2, low
    if best is None:
        return float(y.mean())
    _, f, at, low = best
    return f, float(at), grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def is_main(tree: tuple | float, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def skipped(page: str) -> str:
    """The page with a space for every comment, declaration, script, style and skipped element. One pass forward: the
    next end tag of each name is looked up once and kept until it lies behind."""
    out, at, ends = [], 0, {}

    def next_end(name: str, after: int) -> tuple[int, int]:
        if name not in ends or ends[name][0] < after:
            m = _END[name].search(page, after)
            ends[name] = m.span() if m else (len(page) + 1, len(page) + 1)
        return ends[name]

    while m := _OPENS.search(page, at):
        name = (m[1] or "").lower()
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            to = len(page) if close < 0 else close + 3
        else:
            close = page.find(">", m.end())
            if close < 0:
                break  # no tag ends from here on
            to = close + 1
            if name in TO_THE_END:
                to = min(next_end(name, to)[1], len(page))
            elif name and page[close - 1] != "/":
                begin, end = next_end(name, to)
                whole = begin <= len(page)
                if whole and name in FLAT:  # another one that opens before means that this one never closed
                    again = _START[name].search(page, to, begin)
                    whole = again is None
                if not whole:  # only the tag goes, as a tag of no meaning
                    out.append(page[at:to])
                    at = to
                    continue
                to = end
        out += [page[at:m.start()], " "]
        at = to
    return "".join(out) + page[at:]


def _names_boiler(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        if not BOILER_NAMES.isdisjoint(re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


class _Blocks:
    """Collects the flat blocks of one page: [text, words, link density, heading, boiler, inside]."""

    def __init__(self) -> None:
        self.done: list[list] = []
        self.text: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, bool, bool, tuple]] = []  # tag, boiler by tag, inside article or main, elements named boiler
        self.named: list[dict] = []  # per element named boiler: how many articles and mains it holds
        self.total = {"article": 0, "main": 0}
        self.heading, self.in_link = False, 0

    def add(self, raw: str) -> None:
        if raw:
            self.text.append(raw)
            if self.in_link:
                self.linked += len("".join(html.unescape(raw).split()))

    def close(self) -> None:
        if self.text:
            words = html.unescape("".join(self.text)).split()
            if words:
                boiler, inside, marks = self.stack[-1][1:] if self.stack else (False, False, ())
                size = sum(map(len, words))
                self.done.append([" ".join(words), len(words), min(1.0, self.linked / size), self.heading, boiler, inside, marks])
        self.text, self.linked = [], 0

    def tag(self, end: str, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = 0 if end else 1
        elif name == "br":
            self.text.append(" ")
        elif name in BLOCK_TAGS:
            self.close()
            if _HEADING.match(name):
                self.heading = not end
            elif name in CONTAINERS or (not end and name == "p" and _names_boiler(attributes)):
                self._nest(end, name, attributes)
            elif name == "p" and end and any(e[0] == "p" for e in self.stack[-1:]):
                self.stack.pop()
        elif not end and name == "header":
            self.close()

    def _nest(self, end: str, name: str, attributes: str) -> None:
        self.in_link = 0
        if end:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    del self.stack[i:]
                    break
            return
        if attributes.endswith("/"):
            return
        if name == "li" and self.stack and self.stack[-1][0] == "li":
            self.stack.pop()
        _, boiler, inside, marks = self.stack[-1] if self.stack else ("", False, False, ())
        own = name in BOILER_TAGS or (name == "header" and not inside)
        if _names_boiler(attributes):
            marks += (len(self.named),)
            self.named.append(dict.fromkeys(self.total, 0))
        if name in self.total:
            self.total[name] += 1
            for i in marks:
                self.named[i][name] += 1
        self.stack.append((name, boiler or own, inside or name in self.total, marks))

    def finished(self) -> list[list]:
        """The blocks, once it is known which named elements hold the page's articles or mains."""
        boiler = [not any(n and held[k] == n for k, n in self.total.items()) for held in self.named]
        return [[*b[:4], b[4] or any(boiler[i] for i in b[6]), b[5]] for b in self.done]


def blocks(page: str) -> list[list]:
    """The flat text blocks of a page."""
    page = skipped(page)
    out, at = _Blocks(), 0
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):  # no tag ends beyond, so none is sought
        out.add(page[at:m.start()])
        out.tag(m[1], m[2].lower(), m[3])
        at = m.end()
    out.add(page[at:])
    out.close()
    return out.finished()


def main_text(page: str | None, tree: tuple | float) -> str:
    """The blocks that the tree takes for main text, joined by spaces."""
    found = blocks(page or "")
    has_main = any(b[5] for b in found)
    edge = ["", 0, 0.0]
    kept = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        place = 1 if b[5] else -1 if has_main else 0
        if is_main(tree, (b[1], b[2], before[1], before[2], after[1], after[2], b[3], b[4], place)):
            kept.append(b[0])
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per page."""
    tree = grow(labelled())
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                text = [main_text(h.as_py(), tree) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return src.mapInArrow(run, "page_id long, url string, text string")
