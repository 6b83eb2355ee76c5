"""Main text of web pages by tag-path ratios.

Every text node belongs to the path of tags from the root to it. For each path of a page the number
of characters and of punctuation marks per node are taken; both are smoothed over the sequence of
nodes, so that a short node between long ones is lifted, fused into one value per path, lowered by
the share of link text, and compared with the page's strongest path. Parts that are never main text
by their tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) are left out before. A page that marks its article or main part has content there
only: the ratios choose among the paths of that part, its headings go or stay with what they head,
and lists, tables and quotations that stand beside chosen text stay with it unless they are links.
"""

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tallyframe.llm.shared import map_rows

# HTML tag names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = set(
    "head title script style noscript template nav header footer aside form button select option "
    "textarea input iframe object svg canvas audio video dialog menu".split()
)
ENDS_BEFORE = {  # an opening tag that ends an open one
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
BLOCKS_END_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol pre section table ul".split()
)
SCOPES = set("article main section div td th table ul ol dl body html blockquote aside".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BESIDE = set(  # parts of running text that may be short
    "ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption".split()
)
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
LEFT_OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe share sharing social sidebar "
    "related recommended menu nav navbar navigation breadcrumb breadcrumbs pagination masthead footer "
    "header comment comments disqus reply replies login signup search widget toolbar copyright".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？\"'()«»“”‘’-]")


class Node(NamedTuple):
    """Text of a page: its path, block number, in a link, in an article or main part, in a heading,
    and the numbers of three elements: the list, table or quotation it is in (0 if none), its own,
    and the one around it that is no paragraph, heading, list, table or quotation."""

    path: str
    block: int
    text: str
    link: bool
    landmark: bool
    heading: bool
    beside: int
    element: int
    box: int


def _left_out(tag: str, attrs: dict[str, str | None], named_parts: bool) -> bool:
    """``named_parts``: whether the class rule holds for an article or main element too."""
    if tag in LEFT_OUT or "hidden" in attrs or (attrs.get("aria-hidden") or "") == "true":
        return True
    if (attrs.get("role") or "").lower() in LEFT_OUT_ROLES:
        return True
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    if tag in ("body", "html") or (tag in ("article", "main") and not named_parts):
        return False
    named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()
    return any(word in LEFT_OUT_WORDS for word in re.split(r"[^a-z]+", named))


class _Nodes(HTMLParser):
    """The ``Node`` rows of a page."""

    def __init__(self, nested_rule: bool):
        super().__init__(convert_charrefs=True)
        self.nested_rule = nested_rule
        # tag, name, left out, landmark, number
        self.open: list[tuple[str, str, bool, bool, int]] = []
        self.block = 0
        self.elements = 0
        self.nodes: list[Node] = []

    def _pop_to(self, place: int) -> None:
        if any(e[0] not in INLINE for e in self.open[place:]):
            self.block += 1
        del self.open[place:]

    def _end_open(self, tags: set[str]) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] in tags:
                self._pop_to(place)
                return
            if self.open[place][0] in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID:
            self.block += tag not in INLINE
            return
        if tag in BLOCKS_END_P:
            self._end_open({"p"})
        self._end_open(ENDS_BEFORE.get(tag, set()))
        if tag not in INLINE:
            self.block += 1
        name = ".".join([tag, *sorted((attrs.get("class") or "").split())])
        outer = self.open[-1] if self.open else (None, None, False, False, 0)
        landmark = tag in ("article", "main") or (attrs.get("role") or "") in ("main", "article")
        # an article within an article or main part may be a reader's comment or a notice
        left_out = outer[2] or _left_out(tag, attrs, outer[3] and self.nested_rule)
        self.elements += 1
        self.open.append((tag, name, left_out, outer[3] or landmark, self.elements))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes no element but the void ones

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                self._pop_to(place)
                return

    def handle_data(self, data):
        if self.open and self.open[-1][2]:
            return
        blocks = [e for e in self.open if e[0] not in INLINE]
        heading, beside, box = False, 0, 0
        for tag, _, _, _, number in reversed(blocks):
            if tag in HEADINGS:
                heading = True
            elif tag in BESIDE:
                beside = number
            elif tag != "p":
                box = number
                break
        self.nodes.append(
            Node(
                "/".join(e[1] for e in blocks),
                self.block,
                data,
                any(e[0] == "a" for e in self.open),
                bool(self.open) and self.open[-1][3],
                heading,
                beside,
                blocks[-1][4] if blocks else 0,
                box,
            )
        )


def text_nodes(html: str, nested_rule: bool = True) -> list[Node]:
    """Text of a page but for the parts left out. Without ``nested_rule`` the class rule spares all
    article and main elements, otherwise only those that are not within another one."""
    parser = _Nodes(nested_rule)
    parser.feed(html)
    parser.close()
    return parser.nodes


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted mean with both neighbours."""
    padded = np.concatenate((values[:1], values, values[-1:]))
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def content_paths(nodes: list, threshold: float) -> set[str]:
    """Paths whose fused ratio reaches the share ``threshold`` of the strongest path's."""
    names = sorted({n.path for n in nodes})
    number = {name: i for i, name in enumerate(names)}
    path = np.array([number[n.path] for n in nodes])
    chars = np.array([len(" ".join(n.text.split())) for n in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in nodes], float)
    linked = np.array([n.link for n in nodes], float)

    def per_path(values, weights):
        return np.bincount(path, values, len(names)) / np.maximum(np.bincount(path, weights, len(names)), 1e-9)

    ones = np.ones(len(nodes))
    text = _smooth(per_path(chars, ones)[path])
    mark = _smooth(per_path(marks, ones)[path])
    fused = per_path(text * (1 + mark), ones) * (1 - per_path(chars * linked, chars))
    return {name for name, value in zip(names, fused) if value >= threshold * fused.max() and value > 0}


def marked_elements(nodes: list[Node], paths: set[str]) -> set[int]:
    """Elements kept of an article or main part: those on the chosen paths, lists, tables and
    quotations beside them if under half of their text is links, and the headings of what is kept.
    A heading that nothing follows is judged by its path."""
    chosen = {n.element for n in nodes if n.path in paths and not n.heading}
    boxes = {n.box for n in nodes if n.element in chosen and not n.beside}
    chars: dict[int, list[int]] = {}
    for n in nodes:
        if n.beside and n.box in boxes:
            chars.setdefault(n.beside, [0, 0])[n.link] += len(n.text.strip())
    plain = {number for number, (other, linked) in chars.items() if linked < other}
    kept = chosen | {n.element for n in nodes if n.beside in plain}
    after = None  # whether the text that follows is kept
    for n in reversed(nodes):
        if not n.heading:
            after = n.element in kept
        elif after or (after is None and n.path in paths):
            kept.add(n.element)
    return kept


def main_text(html: str | None, threshold: float = 0.1) -> str:
    """The main text of a page, its blocks joined by one space; empty if there is none."""

    def marked(nodes):
        return any(n.landmark and n.text.strip() for n in nodes)

    nodes = text_nodes(html or "")
    if not marked(nodes):
        # an article by a name of the list may be all that a main part holds
        every = text_nodes(html or "", nested_rule=False)
        nodes = every if marked(every) else nodes
    in_part = marked(nodes)
    if in_part:
        nodes = [n for n in nodes if n.landmark]
    visible = [n for n in nodes if n.text.strip()]
    paths = content_paths(visible, threshold) if visible else set()
    if in_part:
        elements = marked_elements(visible, paths)
        kept = [n for n in nodes if n.element in elements]
    else:
        kept = [n for n in nodes if n.path in paths]
    blocks: dict[int, list[str]] = {}
    for n in kept:
        blocks.setdefault(n.block, []).append(n.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(text for text in joined if text)


def extract(pages: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row per page: page_id, url, text and n_chars.

    Null or empty html gives an empty text. Character references are decoded, white space inside
    a block becomes one space. Cut-off markup is read as far as it goes. Repeated rows and null
    ids or urls are carried along; other columns are left behind.
    """

    def make():
        def work(batch):
            texts = [main_text(h, threshold) for h in batch["html"].to_pylist()]
            return {
                "page_id": batch["page_id"], "url": batch["url"], "text": texts,
                "n_chars": [len(t) for t in texts],
            }

        return work

    return map_rows(
        pages.select("page_id", "url", "html"),
        "page_id bigint, url string, text string, n_chars bigint",
        make,
    )
