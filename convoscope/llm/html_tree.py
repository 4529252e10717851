"""A page as block elements and runs of text: a tolerant reader of HTML.

Only what the site style tree needs: block elements make the tree, inline elements
belong to the text of the block around them, missing end tags are implied, and
scripts, styles and comments are skipped.  One pass, no recursion.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements and names of HTML, and names that sites use for parts outside the article.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table caption tbody td tfoot th thead tr ul html".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
OUTSIDE_TAGS = frozenset(
    "head nav footer aside form dialog menu search button select datalist label audio video canvas object map".split()
)
MAIN_TAGS = frozenset("article main".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split()
)
OUTSIDE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promotions teaser teasers "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside footer footers header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus respond reply replies feedback related recommended recommendations "
    "trending popular pagination pager paging widget widgets copyright legal disclaimer search form".split()
)
ARTICLE_NAMES = frozenset("article entry post story content".split())  # "entry-header" belongs to the article
CLOSES = {
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "td", "th", "tr", "caption"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody", "caption"),
    "tfoot": ("p", "td", "th", "tr", "thead", "tbody"),
}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Page:
    """Elements in page order (parents first) and the runs of text between block boundaries."""

    tag: list[str] = field(default_factory=list)
    sign: list[str] = field(default_factory=list)  # tag, class and id: how the element is presented
    parent: list[int] = field(default_factory=list)
    outside: list[bool] = field(default_factory=list)  # declared to be no part of the article
    run_of: list[int] = field(default_factory=list)  # element that holds the run
    run_text: list[str] = field(default_factory=list)
    run_links: list[list[str]] = field(default_factory=list)

    def main(self) -> list[bool]:
        """Is the element the article, or within it, as the page declares?"""
        inside: list[bool] = []
        for tag, parent in zip(self.tag, self.parent, strict=True):
            inside.append(tag in MAIN_TAGS or (parent >= 0 and inside[parent]))
        return inside


def _names(value: str) -> set[str]:
    return {n.lower() for n in NAME.findall(value)}


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _declared_outside(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """(by its tag, role or hidden; by the names in its class and id)."""
    style = attributes.get("style", "").replace(" ", "").lower()
    role = set(attributes.get("role", "").lower().split())
    hidden = "hidden" in attributes or "display:none" in style
    by_tag = tag in OUTSIDE_TAGS or (tag == "header" and not in_main) or bool(role & OUTSIDE_ROLES) or hidden
    if tag in ("html", "body", "main"):
        return hidden, False
    by_name = False
    for value in (*attributes.get("class", "").split(), attributes.get("id", "")):
        names = _names(value)
        wanted = names & OUTSIDE_NAMES
        if wanted and not (wanted == {"header"} and (in_main or names & ARTICLE_NAMES)):
            by_name = True
    return by_tag, by_name


def read(source: str) -> Page:
    page = Page()
    stack: list[int] = []  # open elements
    opened: Counter = Counter()  # how many of each tag are open
    named: list[int] = []  # outside by name only: void if an article turns up within
    text: list[str] = []
    links: list[str] = []
    muted: list[str] = []  # open inline elements that are outside the article
    mains = 0

    def flush() -> None:
        run = " ".join("".join(text).split())
        if run:
            page.run_of.append(stack[-1] if stack else -1)
            page.run_text.append(run)
            page.run_links.append(links.copy())
        text.clear()
        links.clear()

    def pop() -> None:
        nonlocal mains
        tag = page.tag[stack.pop()]
        opened[tag] -= 1
        mains -= tag in MAIN_TAGS

    def push(tag: str, attributes: dict[str, str]) -> None:
        nonlocal mains
        by_tag, by_name = _declared_outside(tag, attributes, mains > 0)
        node = len(page.tag)
        classes = " ".join(sorted(re.sub(r"\d+", "#", f"{attributes.get('class', '')} .{attributes.get('id', '')}").split()))
        page.tag.append(tag)
        page.sign.append(f"{tag} {classes}")
        page.parent.append(stack[-1] if stack else -1)
        page.outside.append(by_tag or by_name)
        if by_name and not by_tag and tag != "article":
            named.append(node)
        stack.append(node)
        opened[tag] += 1
        mains += tag in MAIN_TAGS

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if stack and page.tag[stack[-1]] == "head" and not piece.isspace():
                    pop()  # text ends a head that isn't closed
                if not muted:
                    text.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in muted:
                del muted[len(muted) - 1 - muted[::-1].index(tag) :]
            elif tag in BLOCKS:
                flush()
                muted.clear()
                if opened[tag] and tag not in ("html", "body"):
                    while page.tag[stack[-1]] != tag:
                        pop()
                    pop()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            close = RAW_END[tag].search(source, at)
            at = close.end() if close else end
            continue
        if stack and tag not in HEAD_ONLY and page.tag[stack[-1]] == "head":
            flush()
            pop()
        if tag in ("html", "body") and opened[tag]:
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "img":
                links.append("src " + attributes.get("src", ""))
            else:
                text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            while stack and page.tag[stack[-1]] in CLOSES.get(tag, ("p",)):
                pop()
            push(tag, attributes)
        elif tag in muted or any(_declared_outside(tag, attributes, mains > 0)):
            muted.append(tag)
        elif tag == "a":
            links.append("href " + attributes.get("href", ""))
    flush()
    with_article = set()
    for node, tag in enumerate(page.tag):
        if tag in MAIN_TAGS:
            up = page.parent[node]
            while up >= 0 and up not in with_article:
                with_article.add(up)
                up = page.parent[up]
    for node in named:
        if node in with_article:
            page.outside[node] = False
    return page
