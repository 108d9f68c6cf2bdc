"""Main text of HTML pages: flat text blocks, classified by their own and their neighbours' features.

A page is cut into a flat sequence of text blocks at the tags that end a line of layout. A block has a word count, a link density (words
inside links), and marks from the elements around it: boilerplate elements (menus, headers, footers, asides, forms), names of
class, id or role that say so, and whether it lies in an article. A decision tree decides, from these and from the
word counts and link densities of the blocks before and after, whether the block is content. The tree is trained here, on the
small labelled table `LABELLED_BLOCKS`, by CART with the Gini index.

Scripts, styles, templates, comments and the head never become text. Character references are decoded, white space in a block becomes
one space, and blocks join in page order by an empty line.

The head ends at its end tag, at the body, or at the first tag or text that no head can hold. A silent element whose end tag is missing ends at
the next block-level tag or at the end of its parent; scripts, styles and comments without end go to the end of the page.

Defined cases: a null or empty page has the empty text; unclosed or stray tags never raise (an element that is still open
at the end of its parent ends there); text without any markup is one block; a tag that the end of the page cuts off has no text; repeated rows are extracted each; an
empty table gives no rows; `extract` keeps other columns unless they are named text or n_chars.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import table

NAME = "op4_html_text"

#: Elements whose content is no text of the page.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "title", "textarea", "select", "button", "datalist")
#: Silent elements that never hold one of their own kind.
FLAT = {"noscript", "iframe", "title", "textarea", "select", "button", "datalist"}
#: Tags that a head may hold besides silent elements.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes"}
#: Tags that begin a block, where a silent element without end tag ends.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Elements that hold the article.
ARTICLE = {"article", "main"}
#: Elements that stay within a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msub msup msubsup msqrt mroot mover munder".split())
#: Headings, whose ids are made from their own words.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus|respond|reply|replies|discussion|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|copyright|disclaimer|legal|complementary|contentinfo|dialog|skip)(?:$|[\s_-])",
    re.I,
)
_SCRIPT = re.compile(r"<(script|style)(?=[\s/>])", re.I)
_SCRIPT_END, _STYLE_END = re.compile(r"</script\s*>", re.I), re.compile(r"</style\s*>", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[^>\"']*")
#: Tags of a page whose quotes do not close, after which quotes count for nothing there; and scans of the page for ends of silent elements.
BROKEN, SCANS = 20, 4
#: Open elements within a silent one that are told apart.
DEPTH = 1_000
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "marked", "in_article")
#: words, link share, the same of the block before and of the one after, marked, in_article, and whether the block is content.
LABELLED_BLOCKS = [
    (60, 0.00, 45, 0.00, 80, 0.00, 0, 1, 1), (120, 0.02, 60, 0.00, 30, 0.00, 0, 1, 1), (8, 0.00, 0, 0.00, 70, 0.00, 0, 1, 1), (3, 0.00, 40, 0.00, 55, 0.00, 0, 1, 1),
    (1, 0.00, 90, 0.00, 12, 0.00, 0, 1, 1), (1, 0.00, 1, 0.00, 1, 0.00, 0, 1, 1), (14, 0.20, 35, 0.05, 40, 0.00, 0, 1, 1), (25, 0.00, 6, 1.00, 0, 0.00, 0, 1, 1),
    (5, 0.00, 1, 1.00, 0, 0.00, 0, 1, 1), (10, 0.00, 9, 0.00, 8, 0.00, 0, 1, 1), (40, 0.30, 50, 0.10, 22, 0.00, 0, 1, 1), (2, 0.50, 30, 0.00, 30, 0.00, 0, 1, 1),
    (4, 1.00, 30, 0.00, 4, 1.00, 0, 1, 0), (6, 1.00, 5, 1.00, 3, 1.00, 0, 1, 0), (3, 1.00, 55, 0.00, 2, 1.00, 0, 1, 0), (12, 0.90, 60, 0.00, 9, 0.95, 0, 1, 0),
    (50, 0.00, 60, 0.00, 40, 0.00, 1, 1, 0), (7, 0.00, 40, 0.00, 30, 0.00, 1, 1, 0), (15, 0.10, 0, 0.00, 60, 0.00, 1, 1, 0), (3, 1.00, 3, 1.00, 3, 1.00, 1, 1, 0),
    (90, 0.00, 40, 0.00, 60, 0.00, 0, 0, 1), (45, 0.05, 30, 0.00, 25, 0.10, 0, 0, 1), (30, 0.00, 5, 0.00, 45, 0.00, 0, 0, 1), (18, 0.00, 60, 0.00, 40, 0.00, 0, 0, 1),
    (6, 0.00, 45, 0.00, 50, 0.00, 0, 0, 1), (4, 0.00, 38, 0.00, 44, 0.00, 0, 0, 1), (22, 0.10, 3, 1.00, 60, 0.00, 0, 0, 1), (70, 0.15, 2, 1.00, 3, 1.00, 0, 0, 1),
    (7, 0.00, 4, 1.00, 65, 0.00, 0, 0, 1), (25, 0.00, 70, 0.00, 6, 0.30, 0, 0, 1), (2, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0), (5, 0.60, 6, 1.00, 8, 0.50, 0, 0, 0), (4, 0.00, 5, 0.60, 3, 0.90, 0, 0, 0), (9, 0.00, 30, 0.00, 0, 0.00, 0, 0, 1),
    (12, 0.20, 8, 0.70, 6, 0.80, 0, 0, 0), (6, 0.00, 7, 0.00, 5, 0.00, 0, 0, 1), (20, 0.70, 15, 0.80, 10, 1.00, 0, 0, 0), (35, 0.80, 50, 0.00, 30, 0.90, 0, 0, 0),
    (8, 1.00, 0, 0.00, 40, 0.00, 0, 0, 0), (3, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0), (40, 0.00, 0, 0.00, 60, 0.00, 1, 0, 0), (80, 0.00, 70, 0.00, 40, 0.00, 1, 0, 0),
    (3, 0.00, 4, 1.00, 2, 0.80, 0, 0, 0), (11, 0.00, 6, 0.90, 9, 1.00, 0, 0, 0), (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (20, 0.00, 35, 0.00, 0, 0.00, 0, 0, 1),
    (5, 0.00, 0, 0.00, 8, 0.00, 0, 0, 1), (8, 0.00, 5, 0.00, 9, 0.00, 0, 0, 1), (9, 0.00, 8, 0.00, 0, 0.00, 0, 0, 1), (14, 0.00, 3, 1.00, 12, 0.00, 0, 0, 1),
    (7, 0.10, 9, 1.00, 4, 1.00, 0, 0, 0), (6, 0.00, 40, 0.00, 4, 1.00, 0, 0, 1), (15, 0.00, 20, 0.00, 3, 1.00, 0, 0, 1), (2, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0),
    (60, 0.00, 40, 0.00, 3, 1.00, 1, 0, 0), (25, 0.00, 30, 0.00, 2, 1.00, 1, 1, 0), (80, 0.00, 60, 0.10, 5, 1.00, 1, 0, 0), (30, 0.00, 20, 0.00, 4, 0.90, 1, 0, 0),
    (70, 0.00, 4, 1.00, 3, 1.00, 1, 0, 0), (5, 0.00, 10, 0.00, 4, 1.00, 0, 1, 1), (30, 0.00, 4, 1.00, 4, 1.00, 0, 1, 1), (12, 0.00, 8, 0.00, 6, 0.90, 0, 1, 1),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 1, 1), (9, 0.00, 0, 0.00, 3, 1.00, 0, 1, 1), (60, 0.00, 12, 0.00, 3, 1.00, 0, 1, 1), (8, 0.10, 6, 1.00, 5, 1.00, 0, 1, 1),
    (12, 0.00, 20, 0.00, 5, 0.00, 1, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0), (9, 0.10, 80, 0.00, 0, 0.00, 1, 0, 0), (16, 0.00, 5, 1.00, 70, 0.00, 1, 0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A decision tree as nested tuples (feature, threshold, at most, above), or the label of a leaf."""
    if depth == 0 or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(len(y) * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, cut, low = best
    return (f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def train(labelled=LABELLED_BLOCKS):
    rows = np.array(labelled, float)
    return grow(rows[:, :-1], rows[:, -1])


def is_content(tree, row) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return bool(tree)


def _marked(attributes: str, telling: tuple[str, ...] = ("class", "id", "role")) -> bool:
    """Whether an element is hidden, or one of the `telling` attributes names what is no article."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value.lower() == "true"):
            return True
        if name.lower() in telling and NAMES.search(value):
            return True
    return False


class Tag:
    """A tag: its place, the one after it, whether it is an end tag, its name in lower case, and its attributes. Declarations have no name."""

    __slots__ = ("attributes", "closing", "end", "name", "start")

    def __init__(self, start: int, end: int, closing: bool = False, name: str = "", attributes: str = ""):
        self.start, self.end, self.closing, self.name, self.attributes = start, end, closing, name, attributes


class Page:
    """A page's text and its tags. Every step goes forward, so that a page of broken tags takes no more than a few passes."""

    def __init__(self, text: str):
        self.broken = self.scanned = 0
        self.text = text
        self.last = text.rfind(">")
        self.text = self._without_raw()
        self.last, self.broken = self.text.rfind(">"), 0
        self.ends: dict[str, int] = {}

    def tag(self, at: int) -> Tag | None:
        """The tag that begins at a `<`; None for a lone sign."""
        text = self.text
        if at >= self.last:
            return None
        if text[at + 1] in "!?":
            return Tag(at, text.find(">", at) + 1)
        m = _NAME.match(text, at)
        if not m:
            return None
        end = self._end(m.end())
        return Tag(at, end + 1, bool(m[1]), m[2].lower(), text[m.end() : end])

    def _end(self, at: int) -> int:
        """Where the `>` of a tag is: outside quotes, or the next one where quotes do not close."""
        text, begun = self.text, at
        if self.broken < BROKEN:
            while (at := _QUOTED.match(text, at).end()) < len(text):
                if text[at] == ">":
                    return at
                at = text.find(text[at], at + 1) + 1
                if not at:
                    break
            self.broken += 1
        return text.find(">", begun)

    def _without_raw(self) -> str:
        """The text with a space for each comment, script and style; those without end go to the end of the page."""
        text, out, done, at = self.text, [], 0, 0
        while (at := text.find("<", at)) >= 0:
            if text.startswith("<!--", at):
                end = text.find("-->", at + 4)
                end = len(text) if end < 0 else end + 3
            elif text.startswith("<![CDATA[", at):
                end = text.find("]]>", at)
                end = len(text) if end < 0 else end + 3
            elif (m := _SCRIPT.match(text, at)) and (tag := self.tag(at)) and not tag.attributes.endswith("/"):
                close = (_SCRIPT_END if m[1].lower() == "script" else _STYLE_END).search(text, tag.end)
                end = close.end() if close else len(text)
            else:
                at += 1
                continue
            out += [text[done:at], " "]
            done = at = end
        return "".join([*out, text[done:]])

    def tags(self, at: int):
        """The tags from a place on."""
        while (at := self.text.find("<", at)) >= 0:
            tag = self.tag(at)
            if tag and tag.name:
                yield tag
            at = tag.end if tag else at + 1

    def last_end(self, name: str) -> int:
        """The place of the page's last end tag of a kind."""
        if name not in self.ends:
            self.ends[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}", self.text, re.I)), default=-1)
        return self.ends[name]


def _silent_end(page: Page, at: int, name: str, outer: set[str]) -> int:
    """Where the silent element whose start tag ends at `at` ends; `outer` names the elements it lies in."""
    inner: list[str] = []
    block, ended = None, page.last_end(name) >= at and page.scanned < SCANS * len(page.text)
    begun = at
    for tag in page.tags(at):
        found = tag.name
        if tag.closing:
            if found in inner:
                del inner[len(inner) - 1 - inner[::-1].index(found) :]
            elif found == name:
                return tag.end
            elif found in outer:
                page.scanned += tag.start - begun
                return tag.start if block is None else block
            continue
        if block is None and found in BLOCK:
            block = tag.start
        if block is not None and not ended:
            return block
        if found == "body" or (found == name and name in FLAT):
            page.scanned += tag.start - begun
            return tag.start if block is None else block
        if found not in VOID and not tag.attributes.endswith("/") and len(inner) < DEPTH:
            inner.append(found)
    page.scanned += len(page.text) - begun
    return len(page.text) if block is None else block


def _head_end(page: Page, at: int, outer: set[str]) -> int:
    """Where the head whose start tag ends at `at` ends."""
    text = None
    while True:
        tag = next(page.tags(at), None)
        cut = tag.start if tag else len(page.text)
        if text is None and page.text[at:cut].strip():
            text = at
        name = tag.name if tag else ""
        if tag and tag.closing:
            if name == "head":
                return tag.end
            at = tag.end
        elif name in SILENT or name in IN_HEAD:
            at = tag.end
            if name in SILENT and not tag.attributes.endswith("/"):
                at = _silent_end(page, at, name, outer | {"head"})
        else:
            return cut if text is None else text


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """text, words, link share, marked, in_article of each block in page order."""
    page = Page(page)
    text = page.text
    out: list = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, marks its content, holds the article
    opened: Counter[str] = Counter()
    marked = article = links = 0
    held: list[str] = []
    linked: list[str] = []

    def flush():
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            if line:
                words = line.count(" ") + 1
                in_links = len(html.unescape(" ".join(linked)).split())
                out.append((line, words, min(1.0, in_links / words), marked > 0, article > 0))
            held.clear()
            linked.clear()

    def leave(k: int):
        """Closes the open elements from the k-th on."""
        nonlocal marked, article, links
        for n, a, b in stack[k:]:
            marked, article, links = marked - a, article - b, links - (n == "a")
            opened[n] -= 1
        del stack[k:]

    at = 0
    while True:
        cut = text.find("<", at)
        if cut < 0:
            cut = len(text)
        if cut > at:
            held.append(text[at:cut])
            if links:
                linked.append(text[at:cut])
        if cut == len(text):
            break
        tag = page.tag(cut)
        if not tag and _NAME.match(text, cut):  # the page's end cuts this tag off
            break
        if not tag:  # a lone sign
            held.append("<")
            at = cut + 1
            continue
        at = tag.end
        if not tag.name:
            continue
        name, closing, attributes = tag.name, tag.closing, tag.attributes
        if not closing and not attributes.endswith("/") and (name in SILENT or name == "head"):
            outer = {n for n, k in opened.items() if k}
            at = _head_end(page, at, outer) if name == "head" else _silent_end(page, at, name, outer)
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if name in VOID or (attributes.endswith("/") and name not in INLINE and not closing and name not in ARTICLE):
            continue
        if not closing:
            if name in ("p", "li", "a") and opened[name]:  # these end an open one of their kind
                k = _open_at(stack, name)
                if k is not None:
                    leave(k)
            is_marked = name in BOILERPLATE or ("=" in attributes or "hidden" in attributes) and name not in ("html", "body") and _marked(attributes, *([("class", "role")] if name in HEADINGS else []))
            holds = name in ARTICLE
            stack.append((name, bool(is_marked), holds))
            opened[name] += 1
            marked, article, links = marked + bool(is_marked), article + holds, links + (name == "a")
        elif opened[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # a stray inline end tag closes no block
    flush()
    return out


def _open_at(stack, name) -> int | None:
    """Where the innermost open element of this kind begins, unless another block holds the place."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == name:
            return k
        if stack[k][0] not in INLINE and stack[k][0] != "p":
            return None
    return None


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    none = ("", 0, 0.0, False, False)
    out = []
    for k, (text, words, share, marked, article) in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        if is_content(tree, (words, share, before[1], before[2], after[1], after[2], marked, article)):
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns but `column`, with text and n_chars."""
    tree = train()
    pages = pages.drop("text", "n_chars")
    rest = [c for c in pages.columns if c != column]
    pages = pages.select(*rest, column)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pages.schema.fields[:-1]] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(p, tree) for p in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
