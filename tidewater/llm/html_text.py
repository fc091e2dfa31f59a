"""Main text of HTML pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of tags (with their classes). For every path the
text length (linked text counts a fifth) and the punctuation are added up and divided by the nodes of the path; each
node takes its path's two ratios, both sequences are smoothed over the page by a Gaussian, and their product is the
node's score. A path's score is the mean of its nodes' scores times the path's prior: names in class and id that furniture
has lower it, and on a page with text inside ``article`` or ``main`` so does a place outside them. Paths that reach
``SHARE`` of the scores' standard deviation are content.

Inside ``article`` and ``main`` a path stays unless it is mostly links or lowered by its names and no content path; outside
them (on pages that have them) it must besides reach the mean score inside. On other pages the text is made of blocks
mostly on content paths and of what stands with them in one container, but for mostly linked or lowered blocks. Only
elements and roles that are furniture by definition (``OUT``, ``OUT_ROLES``, hidden ones) are left out whatever their score.
White space (as ``str.split`` has it) inside a block becomes one space, and blocks are joined by one space.

A page is parsed in time proportional to its length, however its tags are nested or left open.

Cases: null or empty html, or a page without text, gives an empty text; repeated rows each get their row; very
long pages are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, read, strings

SHARE = 0.5
SIGMA = 1.0
#: What a linked character counts.
LINKED = 0.2
#: Priors: of a place outside the landmarks of a page that has them, of names that furniture has, and of names that hold such words.
OUTSIDE, LOWERED, DOUBTED = 0.125, 0.05, 0.5

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# Elements as HTML has them.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
BOXES = {"div", "section", "td", "th", "article", "main", "center", "details"}
#: An opening tag ends open elements of these kinds, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
CLOSES_P = BLOCK - {"br", "body", "html", "head", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "select", "title", "legend"}
P_SCOPE = {"td", "th", "caption", "button", "object", "table", "html", "body", "article", "section", "div", "li", "main"}
#: The same for paragraphs, and the kinds in a fixed order.
KINDS = [({"p"}, P_SCOPE), *ENDS.values()]
KIND = {tag: k + 1 for k, tag in enumerate(ENDS)}
#: By tag, the kinds that it ends the scope of, and those it is one of.
TOUCHES = {tag: ([k for k, (_, scope) in enumerate(KINDS) if tag in scope], [k for k, (ends, scope) in enumerate(KINDS) if tag in ends and tag not in scope]) for tag in set().union(*(a | b for a, b in KINDS))}
#: Page furniture: elements and roles.
OUT = set("head title script style noscript template nav footer aside form button select textarea input iframe canvas audio video map menu dialog fieldset datalist".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note status".split())
#: Words of class and id that lower a path's score, and words that say nothing beside them.
LOW_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars widget widgets related recommended recommendations comment comments disqus replies responses discussion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead pagination pager toolbar login search copyright disclaimer".split()
)
PLAIN_WORDS = set("area bar body bottom box block button buttons container content form group header holder inner item items left link links list outer panel posts right row section side site thread title top wrap wrapper".split())
LANDMARKS = {"article", "main"}
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")


@dataclass
class Block:
    """Text between two block-level tags: its pieces, its nodes, and the container it stands in (0: none)."""

    pieces: list[str] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    box: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


@dataclass
class Page:
    """Blocks outside furniture; text nodes (path, characters, linked characters, punctuation); by path its prior and whether it is inside a landmark."""

    blocks: list[Block] = field(default_factory=list)
    nodes: list[tuple[int, int, int, int]] = field(default_factory=list)
    prior: list[float] = field(default_factory=lambda: [1.0])
    inside: list[bool] = field(default_factory=lambda: [False])


def prior_of(name: str, landmark: bool) -> float:
    """The prior of one class name or id."""
    parts = _PART.findall(name)
    if LOW_WORDS.isdisjoint(parts):
        return 1.0
    if all(x in LOW_WORDS or x in PLAIN_WORDS or x.isdigit() for x in parts):
        return LOWERED
    return 1.0 if landmark else DOUBTED


def _attributes(tag: str, attrs: str) -> tuple[bool, str, float]:
    """Whether an element is furniture by its attributes; its classes and id; its prior."""
    out, names = False, []
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in OUT_ROLES or name == "style" and _HIDDEN.search(value):
            out = True
        elif name in ("class", "id"):
            names += value.split()
    whole = tag in ("html", "body")
    return out and not whole, " ".join(names), 1.0 if whole else min([prior_of(x, tag in LANDMARKS) for x in names], default=1.0)


class _Open:
    """An open element, with what it has from those around it: one step a tag, however deep the page is."""

    __slots__ = ("box", "inside", "kinds", "linked", "out", "path", "tag")

    def __init__(self, tag: str, path: int, out: bool, linked: bool, inside: bool, box: int, kinds: tuple[int, ...]):
        self.tag, self.path, self.out, self.linked, self.inside, self.box, self.kinds = tag, path, out, linked, inside, box, kinds


def parse(page: str) -> Page:
    got = Page()
    paths: dict[tuple[int, str, str], int] = {}
    stack = [_Open("", 0, False, False, False, 0, (-1,) * len(KINDS))]
    opened: dict[str, int] = {}
    block = Block()
    boxes = 0
    quoted = True  # whether quotes may hold a tag's end; not any more after one that is left open

    def end_block() -> None:
        nonlocal block
        if block.pieces:
            got.blocks.append(block)
            block = Block()

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    pos, n, last = 0, len(page), page.rfind(">")
    while pos < n:
        if page[pos] != "<" or pos > last and page.startswith(("<!", "<?", "</"), pos):
            end = page.find("<", pos + (page[pos] == "<"))
            end = n if end < 0 else end
            raw, pos = page[pos:end], end
            if raw[0] == "<":
                continue  # a tag without an end
        else:
            name = _NAME.match(page, pos + 1)
            skip = None if name else _SKIP.match(page, pos)
            if name and pos < last:
                m = _ATTRS.match(page, name.end()) if quoted else None
                if m is None:
                    quoted = False
                    end = page.find(">", name.end())
                else:
                    end = m.end() - 1
                attrs, pos = page[name.end() : end], end + 1
                tag = name[0].lower()
                if tag in BLOCK:
                    end_block()
                if tag in VOID:
                    continue
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                    pos = page.find(">", close.start()) + 1 or n if close else n
                    continue
                if attrs.endswith("/") and tag in ("svg", "path"):
                    continue
                if tag in CLOSES_P and stack[-1].kinds[0] > 0:
                    cut(stack[-1].kinds[0])
                k = KIND.get(tag)
                if k and stack[-1].kinds[k] > 0:
                    cut(stack[-1].kinds[k])
                up = stack[-1]
                out, names, prior = _attributes(tag, attrs) if attrs else (False, "", 1.0)
                out = up.out or out or tag in OUT or tag == "header" and not up.inside
                inside = up.inside or tag in LANDMARKS
                path = paths.get((up.path, tag, names))
                if path is None:
                    path = paths[up.path, tag, names] = len(got.prior)
                    got.prior.append(min(prior, got.prior[up.path]))
                    got.inside.append(inside)
                boxes += tag in BOXES
                at = len(stack)
                kinds = up.kinds
                if tag in TOUCHES:
                    now = list(kinds)
                    for k in TOUCHES[tag][0]:
                        now[k] = -1
                    for k in TOUCHES[tag][1]:
                        if now[k] < 0:
                            now[k] = at
                    kinds = tuple(now)
                stack.append(_Open(tag, path, out, up.linked or tag == "a", inside, boxes if tag in BOXES else up.box, kinds))
                opened[tag] = opened.get(tag, 0) + 1
                continue
            if skip:
                pos = skip.end()
                tag = _NAME.match(skip[0], 2)
                if skip[0][1] == "/" and tag:
                    tag = tag[0].lower()
                    if tag in BLOCK:
                        end_block()
                    if opened.get(tag):
                        while stack[-1].tag != tag:
                            opened[stack.pop().tag] -= 1
                        cut(len(stack) - 1)
                continue
            if name:  # a tag without an end
                pos = n
                continue
            raw, pos = "<", pos + 1
        up = stack[-1]
        if up.out:
            continue
        text = html.unescape(raw)
        if text.isspace():
            if block.pieces:
                block.pieces.append(" ")
            continue
        size = len("".join(text.split()))
        if not block.nodes:
            block.box = up.box
        block.nodes.append(len(got.nodes))
        block.pieces.append(text)
        got.nodes.append((up.path, size, size if up.linked else 0, sum(map(text.count, PUNCTUATION))))
    end_block()
    return got


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray, float]:
    """By path its score, with its prior, and the share of its text that is linked; the least score of content."""
    path, size, linked, marks = (np.array(x, dtype=np.int64) for x in zip(*page.nodes, strict=True))
    n = len(page.prior)
    count = np.maximum(1, np.bincount(path, minlength=n))
    ratios = [np.bincount(path, x, minlength=n)[path] / count[path] for x in (size - (1 - LINKED) * linked, marks)]
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    norm = np.convolve(np.ones(len(path)), kernel, mode="full")[3:-3]
    length, punct = (np.convolve(x, kernel, mode="full")[3:-3] / norm for x in ratios)
    prior, inside = np.array(page.prior), np.array(page.inside)
    if (inside & (prior > LOWERED))[path].any():
        prior = np.where(inside, prior, OUTSIDE * prior)
    score = length * (punct + 0.1) * prior[path]
    total = np.maximum(1, np.bincount(path, size, minlength=n))
    return np.bincount(path, score, minlength=n) / count, np.bincount(path, linked, minlength=n) / total, SHARE * float(score.std())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    got = parse(page)
    if not got.nodes:
        return ""
    score, links, least = path_scores(got)
    path, size = (np.array(x, dtype=np.int64) for x in list(zip(*got.nodes, strict=True))[:2])
    plain, inside = np.array(got.prior) > LOWERED, np.array(got.inside)
    content = score >= least
    marked = (inside & plain)[path]

    def share(of: np.ndarray) -> list[float]:
        """By block, how much of its text is on these paths."""
        yes, all_ = (size * of[path]).tolist(), size.tolist()
        return [sum(yes[k] for k in b.nodes) / max(1, sum(all_[k] for k in b.nodes)) for b in got.blocks]

    if marked.any():
        mean = float(np.average(score[path], weights=size * marked)) if (size * marked).any() else 0.0
        good = np.where(inside & plain, content | (links <= 0.5), content & (inside | (score >= mean)))
        return " ".join(b.text for b, x in zip(got.blocks, share(good), strict=True) if x >= 0.5)
    few = links <= 0.5
    chosen = [x > 0.5 for x in share(content & few)]
    boxes = {b.box for b, ok in zip(got.blocks, chosen, strict=True) if ok and b.box}
    return " ".join(b.text for b, ok, x in zip(got.blocks, chosen, share(plain & few), strict=True) if ok or b.box in boxes and x >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def make(batches):
        for b in batches:
            texts = [main_text(h) for h in strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), make, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
