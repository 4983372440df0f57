"""Main text of web pages from shallow text features.

A page is read once into flat text blocks. A block is described by its number of words and its link density,
those of the block before and after it, the nearest hint of its surrounding elements and whether it is a
heading. A decision tree, grown on the small labelled table below, says which blocks are the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import arrow_batches

DEPTH = 8

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNREAD = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end at the next one of their kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

ASIDE_TAGS = frozenset("nav aside footer menu dialog button".split())
MAIN_TAGS = frozenset("article main".split())
#: Words in class, id and role that name what stands beside an article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert alerts announcement announcements banner breadcrumb "
    "breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus feedback foot footer form gdpr head header login masthead menu menubar modal nav "
    "navbar navigation navi newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo "
    "promoted promotion recommended register related replies reply respond responses rail search share sharing sidebar "
    "sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola tags teaser toolbar topbar "
    "trending warning widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond responses".split())
NOT_ITSELF = frozenset("has with no without is".split())  # "has-sidebar" is not the sidebar
#: Of the words above, those that mean the same whatever stands before them: "weather-widget", not "travel-warning".
UNMISTAKABLE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments cookie cookies "
    "disqus footer menu menubar modal nav navbar navigation newsletter outbrain pagination paywall popup promo sharing "
    "sidebar sidebars signup sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Words of layout that say nothing about the content.
LAYOUT = frozenset(
    "area bar block bottom box button buttons card col column container elements global group holder icons inner item items "
    "js layout left link links list module outer page panel placeholder posts primary right row secondary section site slot "
    "small large sticky top unit wide wrap wrapper zone".split()
)
FORM_SHARE = 0.6  # of a page's words: a form with more, in plain blocks, is the page's frame
FRAME_TAGS = frozenset("article main h1".split())
PLAIN_WORDS = 15  # of a plain block in such a form, two of them at least


@dataclass
class Block:
    text: str
    words: int
    linked: int
    hint: int  # -1 beside the article, 0 unknown, 1 in it
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def element_hint(tag: str, attributes: str, around: int) -> int:
    """The hint of an element within an element with hint `around`.

    -2: in an element that never holds an article; -1: named as standing beside it; 0: unknown; 1: in it.
    """
    if around == -2 or tag in ASIDE_TAGS:
        return -2
    if tag in ("html", "body"):
        return 0
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "itemprop":
            names.append(value.lower())
        elif (
            name == "hidden"
            or name == "aria-hidden" and value == "true"
            or name == "style" and "display:none" in value.replace(" ", "").lower()
        ):
            return -2
    verdicts = {named(one) for one in names}
    titled = around > 0 and (tag in HEADINGS or tag == "header")  # an article's own head is part of it
    if not titled and verdicts & {"aside", "comment"}:
        return 1 if tag in MAIN_TAGS and "comment" not in verdicts else -1
    if tag == "header":
        return around if around > 0 else -1
    if tag in MAIN_TAGS:
        return 1
    return 1 if around == 0 and "main" in verdicts else around


def named(token: str) -> str:
    """`aside`, `comment`, `main` or nothing: what a name in class, id or role says about its element.

    The whole name counts first. Of a compound, parts count only together: one that has no other words than such
    of layout and of articles ("site-footer", "comment-body"), or whose last word is beyond doubt
    ("weather-widget"). "social-science" and "news-alert-body" say nothing against their content.
    """
    whole = token.lower()
    if whole in COMMENT_WORDS:
        return "comment"
    if whole in ASIDE_WORDS:
        return "aside"
    if whole in MAIN_WORDS:
        return "main"
    parts = [p.lower() for p in PART.findall(token)]
    if not parts or parts[0] in NOT_ITSELF:
        return ""
    core = [p for p in parts if p not in LAYOUT and not p.isdigit() and len(p) > 1]
    beside = [p for p in core if p in ASIDE_WORDS]
    if beside and (all(p in ASIDE_WORDS or p in MAIN_WORDS for p in core) or core[-1] in UNMISTAKABLE):
        return "comment" if set(beside) & COMMENT_WORDS else "aside"
    return "main" if core and core[-1] in MAIN_WORDS else ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken and cut markup is read as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked = links = 0
    state = {"heading": False}
    forms: list[tuple[int, int, bool]] = []  # first block, block after the last, holds an article
    opened: list[list] = []  # of the forms around: first block, holds an article

    def hint() -> int:
        return stack[-1][1] if stack else 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            decoded = entities.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if links:
                linked += len(decoded.split())

    def flush() -> None:
        nonlocal linked
        if pieces:
            body = " ".join("".join(pieces).split())
            pieces.clear()
            if body:
                n = body.count(" ") + 1
                out.append(Block(body, n, min(linked, n), max(-1, hint()), state["heading"]))
        linked = 0

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            rest = page[at:]
            text(rest)
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if not closing and tag in UNREAD:
            if m[3].endswith("/") and tag == "svg":
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag not in ("title", "textarea", "script", "style") or end:
                at = end.end() if end else len(page)
            else:
                at = len(page)
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCK:
            continue  # inline markup parts no words; its class is not asked for
        flush()
        links = 0
        if tag in FRAME_TAGS:
            for one in opened:
                one[1] = True
        if tag == "form" and not closing:
            opened.append([len(out), False])
        elif tag == "form" and opened:
            first, frame = opened.pop()
            forms.append((first, len(out), frame))
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            state["heading"] = False if tag in HEADINGS else state["heading"]
            continue
        if tag == "hr":
            continue
        if tag in CLOSES:
            for depth in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[depth][0] in CLOSES[tag]:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph holds no blocks
        state["heading"] = tag in HEADINGS
        stack.append((tag, element_hint(tag, m[3], hint())))
    flush()
    forms += [(first, len(out), frame) for first, frame in opened]
    total = sum(b.words for b in out)
    for first, end, frame in forms:
        inside = out[first:end]
        plain = sum(b.words >= PLAIN_WORDS and b.density < 0.3 for b in inside)
        if not frame and (plain < 2 or sum(b.words for b in inside) <= FORM_SHARE * total):
            for b in inside:
                b.hint = -1
    return out


# ------------------------------------------------------------------------------------------ the labelled table

#: Pages as rows of blocks: words, linked words, hint, heading, and the label (1: of the article). The blocks
#: beside a block are its neighbours in the row.
LABELLED: list[list[tuple[int, int, int, int, int]]] = [
    # marked up: navigation, advert, article, footer
    [(1, 1, -1, 0, 0), (1, 1, -1, 0, 0), (2, 2, -1, 0, 0), (14, 0, -1, 0, 0), (8, 0, 1, 1, 1), (60, 0, 1, 0, 1),
     (45, 2, 1, 0, 1), (80, 0, 1, 0, 1), (12, 1, -1, 0, 0)],
    [(3, 3, -1, 0, 0), (40, 0, -1, 0, 0), (10, 0, 1, 1, 1), (2, 0, 1, 0, 1), (1, 0, 1, 0, 1), (120, 6, 1, 0, 1),
     (5, 0, 1, 1, 1), (33, 0, 1, 0, 1), (90, 0, -1, 0, 0), (60, 1, -1, 0, 0)],
    [(4, 4, -1, 0, 0), (6, 0, 1, 1, 1), (25, 0, 1, 0, 1), (4, 4, 1, 0, 0), (6, 6, 1, 0, 0), (5, 5, 1, 0, 0),
     (70, 3, 1, 0, 1), (30, 30, 1, 0, 0), (9, 0, -1, 0, 0)],
    [(200, 0, 1, 0, 1), (3, 0, 1, 0, 1), (150, 10, 1, 0, 1), (20, 2, -1, 0, 0), (55, 0, -1, 0, 0), (35, 0, -1, 0, 0)],
    [(7, 0, 1, 1, 1), (18, 6, 1, 0, 1), (22, 9, 1, 0, 1), (9, 3, 1, 0, 1), (8, 7, 1, 0, 0), (40, 5, 1, 0, 1)],
    [(2, 0, 1, 1, 1), (3, 0, 1, 0, 1), (12, 0, -1, 0, 0)],
    [(5, 5, -1, 0, 0), (7, 0, -1, 0, 0), (10, 0, 1, 1, 1), (10, 0, 1, 0, 1), (6, 0, -1, 0, 0)],
    [(18, 0, -1, 0, 0), (1, 0, 1, 1, 1), (4, 0, 1, 0, 1), (5, 0, 1, 0, 1), (3, 1, -1, 0, 0)],
    [(30, 0, -1, 0, 0), (12, 0, 1, 0, 1), (2, 0, 1, 0, 1), (6, 0, 1, 0, 1), (9, 0, 1, 1, 1), (1, 0, 1, 0, 1),
     (3, 0, 1, 0, 1), (28, 0, -1, 0, 0), (44, 1, -1, 0, 0), (2, 0, -1, 0, 0)],
    [(5, 2, 1, 0, 1), (1, 0, 1, 0, 1), (7, 3, 1, 0, 1), (2, 0, 1, 0, 1), (70, 0, -1, 0, 0), (65, 3, -1, 0, 0)],
    [(8, 0, 1, 1, 1), (5, 0, 1, 0, 1), (3, 3, -1, 0, 0), (2, 2, -1, 0, 0)],
    [(6, 0, 1, 0, 1), (4, 4, 1, 0, 0), (9, 0, 1, 0, 1), (12, 0, 1, 0, 1), (2, 2, -1, 0, 0), (2, 2, -1, 0, 0)],
    [(2, 2, -1, 0, 0), (11, 0, 1, 1, 1), (14, 0, 1, 0, 1), (6, 6, -1, 0, 0), (7, 1, -1, 0, 0)],
    # no hints: links around long plain blocks
    [(2, 2, 0, 0, 0), (1, 1, 0, 0, 0), (3, 3, 0, 0, 0), (9, 0, 0, 1, 1), (75, 0, 0, 0, 1), (60, 2, 0, 0, 1),
     (15, 0, 0, 0, 1), (88, 1, 0, 0, 1), (2, 2, 0, 0, 0), (5, 1, 0, 0, 0)],
    [(4, 4, 0, 0, 0), (6, 5, 0, 0, 0), (12, 0, 0, 1, 1), (42, 0, 0, 0, 1), (8, 0, 0, 0, 1), (64, 4, 0, 0, 1),
     (30, 0, 0, 0, 1), (10, 8, 0, 0, 0), (12, 10, 0, 0, 0), (7, 2, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (5, 0, 0, 0, 0), (3, 0, 0, 0, 0), (2, 2, 0, 0, 0), (6, 0, 0, 1, 1),
     (100, 0, 0, 0, 1), (20, 0, 0, 0, 1), (35, 0, 0, 0, 1), (4, 0, 0, 0, 0), (3, 3, 0, 0, 0)],
    [(3, 0, 0, 1, 0), (2, 2, 0, 0, 0), (2, 2, 0, 0, 0), (4, 0, 0, 1, 0), (6, 6, 0, 0, 0), (5, 5, 0, 0, 0),
     (8, 4, 0, 0, 0), (7, 0, 0, 0, 0), (2, 1, 0, 0, 0)],
    [(50, 0, 0, 0, 1), (11, 0, 0, 0, 1), (48, 2, 0, 0, 1), (13, 0, 0, 1, 1), (52, 0, 0, 0, 1), (25, 20, 0, 0, 0),
     (18, 15, 0, 0, 0), (4, 0, 0, 0, 0)],
    [(8, 0, 0, 1, 1), (30, 1, 0, 0, 1), (28, 0, 0, 0, 1), (26, 0, 0, 0, 1), (3, 3, 0, 0, 0), (3, 3, 0, 0, 0)],
    [(16, 12, 0, 0, 0), (30, 25, 0, 0, 0), (22, 11, 0, 0, 0), (40, 22, 0, 0, 0), (10, 0, 0, 1, 1), (95, 9, 0, 0, 1),
     (55, 12, 0, 0, 1), (6, 3, 0, 0, 0)],
    # linked blocks of an article: between plain ones they are text, in a row of links they are not
    [(9, 0, 1, 1, 1), (55, 1, 1, 0, 1), (40, 40, 1, 0, 1), (62, 0, 1, 0, 1), (38, 0, 1, 0, 1), (20, 20, 1, 0, 1),
     (47, 2, 1, 0, 1), (6, 6, -1, 0, 0)],
    [(30, 0, 1, 0, 1), (25, 25, 1, 0, 1), (28, 0, 1, 0, 1), (33, 20, 1, 0, 1), (41, 3, 1, 0, 1)],
    [(18, 0, 1, 0, 1), (18, 18, 1, 0, 1), (18, 0, 1, 0, 1), (15, 15, 1, 0, 1), (16, 0, 1, 0, 1)],
    [(90, 4, 1, 0, 1), (16, 16, 1, 0, 1), (75, 0, 1, 0, 1), (60, 50, 1, 0, 1), (120, 0, 1, 0, 1)],
    [(40, 0, 1, 0, 1), (20, 20, 1, 0, 0), (25, 25, 1, 0, 0), (30, 30, 1, 0, 0), (22, 22, 1, 0, 0)],
    [(50, 2, 1, 0, 1), (7, 7, 1, 0, 0), (8, 8, 1, 0, 0), (40, 40, 1, 0, 0), (9, 0, -1, 0, 0)],
    # no hints and little text: a short block without links around it is what the page says
    [(10, 0, 0, 0, 1)],
    [(6, 0, 0, 0, 1)],
    [(14, 0, 0, 0, 1), (9, 0, 0, 0, 1)],
    [(12, 1, 0, 0, 1), (11, 0, 0, 0, 1), (10, 0, 0, 0, 1)],
    [(5, 0, 0, 1, 1), (10, 0, 0, 0, 1)],
]


def features(page: list[tuple[int, float, int, bool]]) -> list[tuple[float, ...]]:
    """(words, density, hint, heading) of a page's blocks, with words and density of the neighbours."""
    out = []
    for i, (words, density, hint, heading) in enumerate(page):
        before = page[i - 1] if i else (0, 0.0, 0, False)
        after = page[i + 1] if i + 1 < len(page) else (0, 0.0, 0, False)
        out.append((words, density, before[0], before[1], after[0], after[1], hint, float(heading)))
    return out


@dataclass
class Node:
    """A question (feature at most threshold) with the nodes below, or a leaf with a label."""

    label: int
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    node = Node(int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, sums = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        low, high = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(y) - n)
        impurity = n * low * (1 - low) + (len(y) - n) * high * (1 - high)
        impurity[values[1:] == values[:-1]] = np.inf
        if len(impurity) and impurity.min() < best[0]:
            k = int(impurity.argmin())
            best = (float(impurity[k]), f, float((values[k] + values[k + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], best[2]
    left = x[:, node.feature] <= node.threshold
    node.low, node.high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return node


def labelled_tree(pages: list[list[tuple[int, int, int, int, int]]] = LABELLED) -> Node:
    rows: list[tuple[float, ...]] = []
    labels: list[int] = []
    for page in pages:
        rows += features([(w, a / w, hint, bool(head)) for w, a, hint, head, _ in page])
        labels += [row[4] for row in page]
    return grow(np.array(rows, float), np.array(labels, float))


def answer(tree: Node, row: tuple[float, ...]) -> int:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.threshold else tree.high
    return tree.label


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    rows = features([(b.words, b.density, b.hint, b.heading) for b in found])
    return " ".join(b.text for b, row in zip(found, rows, strict=True) if answer(tree, row))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; text is its article, empty if there is none.

    A null or empty html gives an empty text. Null ids and urls pass through, repeated rows stay, other columns
    are not read; an empty table gives no rows.
    """
    arrow_batches(pages.sparkSession)
    tree = tree or labelled_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kept = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = kept.schema["page_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
