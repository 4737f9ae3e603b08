"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags.  The first pass classifies a
block by its length, its share of stop words and its share of linked text, and
marks short or unsure blocks; the second gives those the label of the nearest
decided neighbours.  What a page declares (navigation, forms, an article
element, class and id names) enters the first pass.  An inline element that is
furniture is left out up to its own closing tag and doesn't divide its block.

An article element is a feature, not a verdict: inside it a block needs fewer
stop words, and one with next to none is unsure rather than bad, as an article
may be in any language.  Unsure blocks there that have no decided neighbour
follow the article.  Blocks outside compete with it: where the article elements
hold less than a fifth of the page's good text (teasers), the rules go over all
blocks.

Defined cases: null html is empty; a page without main text gives the empty
string; unclosed tags, comments and scripts end with the page; quotes inside an
unquoted attribute value are part of it; repeated rows, also of one page_id,
are extracted each; a null page_id or url stays null; pages of any length are
taken whole; an empty table gives no row; further columns, whatever their
names, are left out.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content that is never text.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "textarea", "select", "title")
#: Elements that hold menus, page headers and the like.
SIDE = ("nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset")
MAIN = ("article", "main")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes that name page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|sidebar|side|widget|related|recommended|comments?|respond|disqus|reply|replies|breadcrumbs?|menu|nav|navbar|navigation|pagination|pager|footer|header|masthead|topbar|toolbar|search|copyright|legal|tags|contentinfo|complementary)(?=$|[\s_-])",
    re.I,
)
#: Common function words of the supported languages.
STOP = frozenset(
    """the a an and or of to in is it that this for on with as by at be are was were from not but have has had he she they we you his her its their which who will would can
    le la les un une des du de et est en que qui dans pour sur pas ne au aux avec par ce cette il elle sont
    der die das und ist in den dem des ein eine einer zu von mit auf für im nicht sich auch als an es bei nach aus
    el los las y que en un una por con para no se su al lo como más del o es""".split()
)
#: Attributes by HTML's own rules: a value without quotes ends at white space or at the tag's end.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in RAW}

GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


class Block:
    __slots__ = ("text", "linked", "main", "side", "heading")

    def __init__(self, text, linked, main, side, heading):
        self.text, self.linked, self.main, self.side, self.heading = text, linked, main, side, heading


def blocks(page: str) -> list[Block]:
    """Blocks in page order, with what the page declares about each."""
    out: list[Block] = []
    words: list[str] = []
    hushed: list[str] = []  # of inline furniture
    linked = link = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, is main, is side, is inline furniture
    main = side = hush = 0
    heading = False
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        if text:
            out.append(Block(text, min(1.0, linked / len(text)), main > 0, side > 0, heading))
        elif text := _SPACE.sub(" ", html.unescape("".join(hushed))).strip():
            out.append(Block(text, 0.0, main > 0, True, heading))
        words.clear()
        hushed.clear()
        linked = 0

    def pop(name):
        nonlocal main, side, hush
        while stack:
            s = stack.pop()
            main -= s[1]
            side -= s[2]
            hush -= s[3]
            if s[0] == name:
                break

    def innermost():
        """Names of the open inline elements of the stack and of the block that holds them."""
        for s in reversed(stack):
            yield s[0]
            if s[0] in BLOCK:
                break

    def say(text):
        nonlocal linked
        if hush:
            hushed.append(text)
            return
        words.append(text)
        if link:
            linked += len(text.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if m[3] is None:
            continue
        name, closing, rest = m[3].lower(), bool(m[2]), m[4]
        if name in _RAW_END:
            if not closing and not rest.rstrip().endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
                if name in ("head", "title") and end is None:
                    at = m.end()  # an unclosed head doesn't swallow the page
            words.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            words.append("\n")
            continue
        if name not in BLOCK:
            if closing:
                if name in innermost():
                    pop(name)
            elif name in VOID or rest.rstrip().endswith("/"):
                continue
            elif side == hush == 0 and rest and _furniture(name, rest):
                stack.append((name, False, False, True))
                hush += 1
            elif any(s[0] == name for s in stack[-1:]):
                stack.append((name, False, False, False))
            continue
        flush()
        heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if closing:
            link = 0
            if any(s[0] == name for s in stack):
                pop(name)
        elif name not in VOID:
            if name == "p":
                while "p" in innermost():
                    pop("p")
            is_main = name in MAIN
            # A header inside an article holds its title, whatever its class; elsewhere it is the page's.
            if name == "header" and main > 0:
                is_side = bool(_HIDDEN.search(rest))
            else:
                is_side = name in SIDE or bool(rest) and _furniture(name, rest)
            stack.append((name, is_main, is_side, False))
            main += is_main
            side += is_side
    flush()
    return out


def _furniture(name: str, attributes: str) -> bool:
    if name in ("html", "body", "article", "main"):
        return False
    return any(FURNITURE.search(a or b or c or "") for a, b, c in _NAMES.findall(attributes)) or bool(_HIDDEN.search(attributes))


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)


def first_pass(b: Block, short: int = 70, long: int = 200, low: float = 0.2, high: float = 0.3, links: float = 0.2, inside: float = 0.05) -> str:
    """Label of a block by itself."""
    if b.side or (b.linked > links and (b.linked > 0.5 or not b.main)):
        return BAD
    n = len(b.text)
    if n < short:
        if b.main:
            return SHORT
        return BAD if b.linked > 0 or "\xa9" in b.text or "|" in b.text else SHORT
    share = stop_share(b.text)
    if b.main:
        return GOOD if share >= inside else NEAR
    if share >= high:
        return GOOD if n > long else NEAR
    return NEAR if share >= low or n > long else BAD


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks are main text: short and unsure ones follow the nearest decided neighbours."""
    n = len(labels)
    before, after, last = [None] * n, [None] * n, None
    sure_before, sure_after, sure = [None] * n, [None] * n, None
    for i in range(n):
        before[i], sure_before[i] = last, sure
        if labels[i] in (GOOD, BAD):
            sure = labels[i]
        if labels[i] != SHORT:
            last = labels[i]
    last = sure = None
    for i in reversed(range(n)):
        after[i], sure_after[i] = last, sure
        if labels[i] in (GOOD, BAD):
            sure = labels[i]
        if labels[i] != SHORT:
            last = labels[i]
    keep = []
    for i, b in enumerate(found):
        a, z = sure_before[i], sure_after[i]
        if labels[i] == GOOD:
            keep.append(True)
        elif labels[i] == BAD:
            keep.append(False)
        elif b.main:
            keep.append(not (a == z == BAD))
        elif labels[i] == NEAR:
            keep.append(not (a == z == BAD))
        else:
            heads = b.heading and after[i] in (GOOD, NEAR)
            keep.append(heads or (a == z == GOOD) or (GOOD in (a, z) and NEAR in (before[i], after[i])))
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = [first_pass(b) for b in found]
    own = [b.main and not b.side for b in found]
    if any(own):
        inside = sum(len(b.text) for b, m, k in zip(found, own, labels) if m and k != BAD)
        outside = sum(len(b.text) for b, m, k in zip(found, own, labels) if not m and k == GOOD)
        if 4 * inside >= outside:
            found, labels = [b for b, m in zip(found, own) if m], [k for k, m in zip(labels, own) if m]
        else:
            for b in found:
                b.main = False
            labels = [first_pass(b) for b in found]
    keep = second_pass(found, labels)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)
