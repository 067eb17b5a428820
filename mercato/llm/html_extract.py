"""Main text of web pages from streaming parser events.

The standard library's parser streams tags and text; block tags end a line.
Every line has a text-to-tag ratio. The ratios are smoothed with a Gaussian and
cut at their standard deviation: lines above are core lines. The content region
is the article that holds nearly all core text or, if there is none, the smallest
part of the page's structure that holds all of it; every block in it counts,
short ones too.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are known by their tags, roles and class or id words and never count. Inside the
region a class or id alone is no proof, as generators make them from headings:
there a named block goes only if it has little text for its tags or is nearly
only links, or if its class says reader comments or adverts. Lists of links
inside the region count.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mercato.llm.common import read

# Elements of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td blockquote".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu nav "
    "noscript object optgroup option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# An element that starts closes an open one of these kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "body": ("head",), "article": ("nav",), "main": ("nav", "header"),
}
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split())
# Words in class and id attributes that name a part beside the text.
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert banner breadcrumb "
    "breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promotion related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar topbar widget".split())
# Of these, the ones that say it also of a block inside the text, as a class.
CLEAR_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts comment comments disqus".split())
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
_WORD = re.compile("[a-z]+")
_COPYRIGHT = re.compile(r"(?i)(?:\u00a9|\(c\)|copyright\b|all rights reserved)")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")

SIGMA = 1.0  # of the Gaussian, in lines
NEARLY_ALL = 0.8  # share of the core text that an article must hold
FEW = 10  # characters a tag that a named block inside the region has at least
LINKED = 0.8  # share of a menu line's text that is links
MENU_LINES = 3


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, link characters, container, heading, named block)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents = [-1]       # container -> the container around it
        self.kinds = ["page"]     # container -> tag
        self.blocks = [None]      # named block -> (the one around it, container, in_text, whole, clear)
        self.stack = []           # open elements: (tag, container, dropped, comment, heading, block)
        self.lines = []
        self._fresh()

    def _fresh(self):
        self.parts, self.tags, self.linked = [], 0, 0

    def _state(self):
        return self.stack[-1] if self.stack else ("page", 0, False, False, False, 0)

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            _, container, _, _, heading, block = self._state()
            self.lines.append((text, self.tags, self.linked, container, heading, block))
            self._fresh()
        else:
            self.parts = []  # tags without text count for the next line

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in BLOCK and any(e[0] == "p" for e in self.stack[-8:]):
            self._close("p")
        for other in CLOSES.get(tag, ()):
            self._close(other, until=("ul", "ol", "dl", "table", "article", "main"))
        _, container, dropped, comment, heading, block = self._state()
        own, own_comment, named = self._beside(tag, attrs)
        comment = comment or own_comment
        if own:
            dropped = True
        elif tag in ("article", "main") and not comment:
            dropped, block = False, 0  # the text itself, even where a form or so is put around the page
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.kinds) - 1
        if named:
            self.blocks.append((block, container, *named))
            block = len(self.blocks) - 1
        self.stack.append((tag, container, dropped, comment, heading or tag in HEADINGS, block))

    def _beside(self, tag, attrs):
        """(whether the element stands beside the text, whether for reader comments, and, if only
        its class or id says that it does: whether in an article, as a whole word, clearly)."""
        if tag in DROPPED:
            return True, False, None
        if tag in ("html", "body"):
            return False, False, None
        in_text = any(e[0] in ("article", "main") for e in self.stack)
        if tag == "header":
            return not in_text, False, None
        found, whole, classes = set(), set(), set()
        for name, value in attrs:
            if name == "hidden" or (name == "style" and value
                                    and "display:none" in value.replace(" ", "").lower()):
                return True, False, None
            if name == "role" and value and value.strip().lower() in DROPPED_ROLES:
                return True, False, None
            if name in ("class", "id") and value:
                found.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
                whole.update(value.lower().split())
                if name == "class":
                    classes.update(value.lower().split())
        if not found or tag in HEADINGS:
            return False, False, None
        comment = bool(found & COMMENT_WORDS)
        if tag in ("article", "main"):
            return comment, comment, None
        if "header" in found and not in_text:
            return True, comment, None
        if not found & DROPPED_WORDS or (in_text and tag not in BLOCK):
            return False, False, None
        # Words split out of a name count where no article says what the text is.
        clear = bool(classes & CLEAR_WORDS if in_text else found & CLEAR_WORDS)
        return False, comment, (in_text, bool(whole & DROPPED_WORDS) or not in_text, clear)

    def _close(self, tag, until=()):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in until or (tag == "p" and self.stack[i][0] in BLOCK):
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if tag in VOID:
            return
        if any(e[0] == tag for e in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script", "path"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self._state()[2]:
            return
        self.parts.append(data)
        if any(e[0] == "a" for e in self.stack[-4:]):
            self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut where the ends of the page are."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def _menus(lines) -> np.ndarray:
    """Marks runs of lines that are nearly only links."""
    linked = [line[2] >= LINKED * len(line[0]) for line in lines]
    marked = np.zeros(len(lines), bool)
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not linked[i]:
            if i - start >= MENU_LINES:
                marked[start:i] = True
            start = i + 1
    return marked


def _named(lines, blocks, cut) -> np.ndarray:
    """Marks the named blocks that their ratio or links show to be no text as well."""
    sums = np.zeros((len(blocks), 3))
    for line in lines:
        sums[line[5]] += len(line[0]), line[1], line[2]
    for b in range(len(blocks) - 1, 0, -1):
        sums[blocks[b][0]] += sums[b]
    chars, tags, linked = sums.T
    return (chars < min(cut, FEW) * np.maximum(tags, 1)) | (linked >= LINKED * chars)


def _beside_text(line) -> bool:
    """Whether a line is known to be no text: nearly only links, or a copyright."""
    return not line[4] and (line[2] >= LINKED * len(line[0]) or bool(_COPYRIGHT.match(line[0])))


def main_text(html: str) -> str:
    """The page's main text: its blocks joined by an empty line."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, blocks = parser.lines, parser.blocks
    if not lines:
        return ""
    # Lines of named blocks outside articles help to find no region.
    beside = np.zeros(len(blocks), bool)
    for b in range(1, len(blocks)):
        beside[b] = beside[blocks[b][0]] or not blocks[b][2]
    beside = beside[[line[5] for line in lines]]
    lengths = np.array([len(line[0]) for line in lines], float)
    menu = _menus(lines)
    ratios = np.where(menu, 0.0, lengths / np.maximum([line[1] for line in lines], 1))
    smooth, core, cut = np.zeros(len(lines)), np.zeros(len(lines), bool), 0.0
    if not beside.all():
        smooth[~beside] = smoothed(ratios[~beside])
        cut = min(smooth[~beside].std(), smooth.max())
        core = (smooth >= cut) & ~menu & ~beside
    # Core text inside every container, summed up the structure.
    weight = np.zeros(len(parser.kinds))
    for line, length, counts in zip(lines, lengths, core):
        if counts:
            weight[line[3]] += length
    for c in range(len(weight) - 1, 0, -1):
        weight[parser.parents[c]] += weight[c]
    children: dict[int, list[int]] = {}
    for c in range(1, len(weight)):
        children.setdefault(parser.parents[c], []).append(c)

    def smallest(share):
        """Down from the page to the smallest region that holds ``share`` of the core text."""
        region = 0
        while region in children:
            best = max(children[region], key=lambda c: weight[c])
            if weight[best] < share * weight[0] or not weight[best]:
                break
            region = best
        return region

    region = smallest(NEARLY_ALL)
    while region > 0 and parser.kinds[region] not in ("article", "main"):
        region = parser.parents[region]
    if not region:
        region = smallest(1.0)
    inside = np.zeros(len(weight), bool)
    inside[region] = True
    for c in range(1, len(weight)):
        inside[c] |= inside[parser.parents[c]] if parser.parents[c] >= 0 else False
    kept = np.array([inside[line[3]] for line in lines])
    # Named blocks of the region need to look it, too; elsewhere the name says it.
    loose = parser.kinds[region] in ("page", "html", "body")
    proved = _named(lines, blocks, cut)
    gone = np.zeros(len(blocks), bool)
    for b in range(1, len(blocks)):
        around, container, in_text, whole, clear = blocks[b]
        if in_text or (inside[container] and not loose):
            gone[b] = gone[around] or clear or (whole and proved[b])
        else:
            gone[b] = True
    kept &= ~gone[[line[5] for line in lines]]
    if loose:
        # Without structure to go by, a menu before or after the core text is
        # none of it, unless a heading announces the list.
        places = np.flatnonzero(core)
        for i in np.flatnonzero(menu):
            if not len(places) or i < places[0]:
                kept[i] = False
            elif i > places[-1]:
                kept[i] &= kept[i - 1] and (lines[i - 1][4] or menu[i - 1])
    if parser.kinds[region] not in ("article", "main") and kept.any():
        # The headings right before belong to it; at its ends, links and a
        # copyright line do not.
        first = np.flatnonzero(kept)[0]
        while first > 0 and lines[first - 1][4] and not beside[first - 1]:
            first -= 1
            kept[first] = True
        places = list(np.flatnonzero(kept))
        ends = lambda i: _beside_text(lines[i]) and not core[i] and not menu[i]
        while places and ends(places[0]):
            kept[places.pop(0)] = False
        while places and ends(places[-1]):
            kept[places.pop()] = False
    return "\n\n".join(line[0] for line, keep in zip(lines, kept) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none) and its length in code points.

    A null or empty page has an empty text; null ids and urls stay null;
    repeated rows are extracted each; other columns are ignored. One pass, no
    shuffle, whole pages.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(html) if html else "" for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
