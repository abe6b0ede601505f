"""Main text of web pages by two-pass block rules (operator 6).

A page is cut into blocks at block-level tags.  Containers that name their role
(navigation, header, footer, aside, forms, adverts, notices, comments) are left
out with all they hold; a class, id or role names one as a whole word or by its
first or last part, without a word of state, and an article in an element so
named stays where the page has no other.  A p, li, dt or dd ends where the next
block begins, as in HTML.  The first pass classifies the other blocks by length,
link density and stop-word density; blocks inside an article or main element
need only a low link density.  Short blocks stay undecided, and in the second
pass take the label of the nearest decided neighbours (both sides good, or the
only decided side good; otherwise by the nearer one).

Defined results: null or empty html gives an empty text; unclosed and stray
tags are tolerated; repeated rows are extracted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read

# Element roles and function words of four languages.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
         "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
MAIN = {"article", "main"}
# Raw text to the end tag; the other raw elements may be self-closed, and without an end tag only their start tag goes.
RAW_TEXT = {"script", "style", "textarea", "title"}
CLOSES_P = (BLOCK - {"body", "br", "caption", "head", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"})
# Start tags that end an open element of the same group, up to the element that holds the group.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}
P_SCOPE = {"button", "caption", "table", "td", "th"}
ROLE = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|footer|header|masthead|menu|modal|nav|"
    r"navbar|navigation|newsletter|notice|overlay|popup|promo|related|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|"
    r"widget|complementary|contentinfo|search|alert)", re.I)
# Parts of a class name that tell of a page's state or layout, not of the element's role.
STATE = {"accepted", "active", "closed", "collapsed", "disabled", "enabled", "expanded", "fixed", "has", "hidden", "hide", "is",
         "no", "none", "not", "off", "on", "open", "show", "shown", "static", "sticky", "visible", "with", "without"}
LAYOUT = {"content", "layout"}
STOP_WORDS = set(
    "the of and a to in is that for it as was with be by on not he his but at are this have from or had an they which one were all "
    "le la les de des du et un une en que qui dans est pour par sur au aux pas ne se ce avec plus "
    "der die das und den von zu mit sich ist im dem nicht ein eine als auch es an auf für "
    "el los las y del se por con no su para una al lo como más o pero".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s+")

SHORT = 60              # characters up to which a block may stay undecided
MAX_LINKS = 0.5         # share of a good block's characters inside links
LOW_STOP, HIGH_STOP = 0.10, 0.25
LONG = 200


NAMED, LIFTED = 1, 2


class Block:
    def __init__(self, main: bool, outside: bool, named: int):
        """``outside``: within an element left out for its tag; ``named``: in
        one that names its role (NAMED), or in an article in such (LIFTED)."""
        self.main, self.outside, self.named, self.parts, self.linked = main, outside, named, [], 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def names_role(name: str) -> bool:
    """A class name that is a role word, or begins or ends with one as a part."""
    parts = re.split(r"[_-]+", name.strip("_-").lower())
    if len(parts) == 1:
        return bool(ROLE.fullmatch(parts[0]))
    if not STATE.isdisjoint(parts):
        return False
    return bool(ROLE.fullmatch(parts[0]) or (parts[0] not in LAYOUT and ROLE.fullmatch(parts[-1])))


def role_outside(attributes: str) -> bool:
    return any(names_role(x) for _, a, b, c in ATTRIBUTE.findall(attributes) for x in (a or b or c).split()) if attributes else False


def close(stack: list[tuple], names: set[str], scope: set[str]) -> None:
    """End the innermost open element of ``names``, and what is open in it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, with the role of what they stand in."""
    out = [Block(False, False, 0)]
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: name, in main, outside, named
    at, links = 0, 0

    def add(text: str) -> None:
        text = unescape(text)
        out[-1].parts.append(text)
        if links:
            out[-1].linked += len(text.strip())

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        add(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in RAW:
                if name not in RAW_TEXT and m[3].endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif name in RAW_TEXT:
                    at = len(html)
                    break
                continue
            links += name == "a"
            if name in CLOSES_P:
                close(stack, {"p"}, P_SCOPE)
            if name in SIBLINGS:
                close(stack, *SIBLINGS[name])
            if name not in VOID:
                _, main, outside, named = stack[-1] if stack else ("", False, False, 0)
                outside = outside or name in OUTSIDE or (name == "header" and not main)
                role = name not in {"body", "html"} and role_outside(m[3])
                if name in MAIN:
                    named = LIFTED if named == NAMED and not role else named
                elif role:
                    named = NAMED
                stack.append((name, main or name in MAIN, outside, named))
        else:
            links = max(0, links - (name == "a"))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    # only block tags close what was left open inside them
                    del stack[k:len(stack) if name in BLOCK else k + 1]
                    break
        if name in BLOCK:
            links = 0 if not any(x[0] == "a" for x in stack) else links
            out.append(Block(*(stack[-1][1:] if stack else (False, False, 0))))
    if at < len(html):
        add(html[at:])
    return out


def first_pass(block: Block, text: str) -> bool | None:
    """True: main text; False: not; None: undecided."""
    if block.outside or block.named == NAMED:
        return False
    if block.linked > MAX_LINKS * len(text):
        return False
    if block.main:
        return True
    if len(text) <= SHORT:
        return None
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= HIGH_STOP or (density >= LOW_STOP and len(text) >= LONG):
        return True
    return None if density >= LOW_STOP else False


def nearest_decided(labels: list[bool | None]) -> list[tuple[int, bool] | None]:
    """Distance and label of the nearest decided block before each, in one sweep."""
    out, last = [], None
    for k, label in enumerate(labels):
        out.append((k - last, labels[last]) if last is not None else None)
        if label is not None:
            last = k
    return out


def main_text(html: str | None) -> str:
    kept = [(b, t) for b in blocks_of(html or "") if (t := b.text())]
    labels = [first_pass(b, t) for b, t in kept]
    if any(b.main and not b.named and x for (b, _), x in zip(kept, labels)):
        labels = [x if b.named != LIFTED else False for (b, _), x in zip(kept, labels)]
    has_main = any(b.main and x for (b, _), x in zip(kept, labels))
    left, right = nearest_decided(labels), nearest_decided(labels[::-1])[::-1]
    final = list(labels)
    for k, x in enumerate(labels):
        if x is None:
            sides = [(distance, side, label) for side, found in ((0, right[k]), (1, left[k])) if found for distance, label in [found]]
            final[k] = min(sides)[2] if sides else False    # the nearer one, and at the same distance the later one
        if has_main and final[k] and not kept[k][0].main:
            final[k] = False            # a page with an article has its text there
    return " ".join(t for (_, t), x in zip(kept, final) if x)


def extract_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every row of ``pages``."""
    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(
        extract_rows, f"page_id {id_type}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
