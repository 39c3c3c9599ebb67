"""Main-text extraction from web pages by tree scoring.

Text blocks give points for length and commas to the elements around them; link-heavy elements lose theirs.
The best container and those of its siblings that also look like text make the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is article text.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: Elements that hold no article text whatever their names.
DROPPED = RAW | frozenset("head nav footer aside form button select option datalist svg math canvas audio video object dialog menu map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these, unless one of the bounds is met first.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words in a class or id that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars aside "
    "menu navbar nav navigation navi breadcrumb breadcrumbs pagination pager toolbar masthead footer footnav header comment comments commentlist disqus "
    "respond replies reply discussion share sharing social related recommended recommendations trending popular widget widgets skip "
    "hidden tags taglist toc search searchbox copyright legal disclaimer outbrain taboola teaser teasers feedback".split()
)
#: Words that mark an article.
ARTICLE = frozenset("article body content entry main post story text page blog hentry".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，､;；]")


class Node:
    __slots__ = ("attributes", "children", "linked", "parent", "points", "size", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points, self.size, self.linked = 0.0, 0, 0


def parse(page: str) -> Node:
    """The element tree; missing end tags are implied as browsers do for paragraphs, items and cells."""
    root = current = Node("html", "", None)
    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            current.children.append(page[at:])
            break
        if token.start() > at:
            current.children.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            up = current
            while up is not None and up.tag != tag and not (tag not in BLOCKS and up.tag in BLOCKS):
                up = up.parent
            if up is not None and up.tag == tag and up.parent is not None:
                current = up.parent
            elif tag == "br":
                current.children.append(" ")
            continue
        if tag in ("html", "body") and current.parent is None:
            root.attributes += " " + token[3]
            continue
        if tag in BLOCKS:
            up = current
            while up.parent is not None and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                current = up.parent
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            up, found = current, None
            while up.parent is not None and up.tag not in bounds:
                found = up if up.tag in ended else found
                up = up.parent
            current = found.parent if found is not None else current
        node = Node(tag, token[3], current)
        current.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|$(?!\n)", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not (token[3].endswith("/") and tag not in BLOCKS):
            current = node
    return root


def _named(node: Node) -> tuple[set[str], dict[str, str]]:
    if not node.attributes.strip():
        return set(), {}
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(node.attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return {w.lower() for w in _NAME_WORD.findall(names)}, found


def _unwanted(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not in_article:
        return True
    words, found = _named(node)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    around = words & AROUND
    if around == {"header"} and in_article:
        return False
    return bool(around) and node.tag not in ("html", "body", "main")


def _text(parts: list[str]) -> str:
    joined = "".join(parts)
    return " ".join((html.unescape(joined) if "&" in joined else joined).split())


def _walk(root: Node) -> Iterator[tuple[Node, str | None, bool]]:
    """Elements and texts in page order: (element, None, entering), (element, text, linked)."""
    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    yield root, None, True
    while stack:
        node, k, linked = stack.pop()
        if k == len(node.children):
            yield node, None, False
            continue
        stack.append((node, k + 1, linked))
        child = node.children[k]
        if isinstance(child, str):
            yield node, child, linked
        else:
            yield child, None, True
            stack.append((child, 0, linked or child.tag == "a"))


def _prune(root: Node) -> None:
    """Takes out what surrounds an article. An element that holds most of the page's paragraph text stays
    whatever its class says."""
    whole = _paragraph_size(root)
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        kept = []
        for child in node.children:
            if isinstance(child, str) or child.tag == "br":
                kept.append(child)
            elif not _unwanted(child, in_article):
                kept.append(child)
                stack.append((child, in_article))
            elif child.tag not in DROPPED and whole and _paragraph_size(child) > 0.6 * whole and not _named(child)[0] & {"comment", "comments", "commentlist", "disqus"}:
                kept.append(child)
                stack.append((child, in_article))
            elif child.tag in BLOCKS:
                kept.append(Node("hr", "", node))  # its edges still part the text around it
        node.children = kept


def _paragraph_size(node: Node) -> int:
    """Characters in paragraphs outside dropped elements and reader comments."""
    total, stack = 0, [(node, node.tag == "p")]
    while stack:
        at, inside = stack.pop()
        for child in at.children:
            if isinstance(child, str):
                total += len(child) if inside else 0
            elif child.tag not in DROPPED and not (child.attributes and _named(child)[0] & {"comment", "comments", "commentlist", "disqus"}):
                stack.append((child, inside or child.tag == "p"))
    return total


def _blocks(root: Node) -> Iterator[tuple[Node, str, int, int]]:
    """Text blocks in page order: the element around the block, its text, its size and how much of it is linked."""
    parts: list[str] = []
    linked = 0
    owner = root
    for node, text, flag in _walk(root):
        if text is not None:
            parts.append(text)
            linked += len(text.strip()) if flag else 0
        elif node.tag == "br":
            parts.append(" ")
        elif node.tag in BLOCKS:
            if parts and (block := _text(parts)):
                yield owner, block, len(block), min(linked, len(block))
            parts, linked = [], 0
            owner = node if flag else (node.parent or root)


def _score(root: Node) -> list[Node]:
    """Gives every element its points, text size and linked size; returns those with points."""
    scored: dict[int, Node] = {}
    for owner, text, size, linked in _blocks(root):
        up = owner
        while up is not None:
            up.size, up.linked = up.size + size, up.linked + linked
            up = up.parent
        if size < 25 or owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = (1 + len(_COMMA.findall(text)) + min(3.0, size / 100)) * (1 - linked / size)
        up, level = (owner.parent if owner.tag in ("p", "pre", "blockquote", "li", "dd", "td") else owner), 0
        while up is not None and level < 6:
            share = 1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)
            up.points += points * share
            scored[id(up)] = up
            up, level = up.parent, level + 1
    for node in scored.values():
        words, _ = _named(node)
        node.points += 10.0 * bool(words & ARTICLE) + 15.0 * (node.tag in ("article", "main"))
        node.points *= 1 - node.linked / max(1, node.size)
    return list(scored.values())


def _container(root: Node) -> list[Node]:
    """The best container and its siblings that are text, in page order."""
    scored = _score(root)
    if not scored:
        return [root]
    best = max(scored, key=lambda n: n.points)
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is not None:
        best = up
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points)
    chosen = []
    for node in best.parent.children:
        if isinstance(node, str):
            continue
        density = node.linked / max(1, node.size)
        is_text = node.tag == "p" and (node.size > 80 and density < 0.25 or 0 < node.size <= 80 and not node.linked and any(t[-1] in ".!?" for _, t, _, _ in _blocks(node)))
        heading = node.tag in ("h1", "h2") and best.tag != "article" and node.size and not node.linked
        if node is best or node.points >= least or is_text or heading:
            chosen.append(node)
    return chosen


def _menus(root: Node) -> None:
    """Takes lists and boxes out that are little but links."""
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, Node):
                if child.tag in ("ul", "ol", "div", "section", "dl", "table") and child.size and child.linked > 0.6 * child.size and child.points < 5 and sum(n.tag == "a" for n, t, f in _walk(child) if t is None and f) >= 2:
                    kept.append(Node("hr", "", node))
                    continue
                stack.append(child)
            kept.append(child)
        node.children = kept


def main_text(page: str) -> str:
    """The article's blocks joined by line feeds; empty if the page has no text."""
    root = parse(page)
    _prune(root)
    chosen = _container(root)
    lines = []
    for node in chosen:
        _menus(node)
        lines += [text for _, text, _, _ in _blocks(node)]
    return "\n".join(lines)


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(page) if page else "" for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, row by row without a shuffle.

    A null or empty html, and one without any text, has an empty text. Broken markup never fails: open
    elements end with the page. Character references are decoded, white space inside a block becomes one
    blank, and blocks follow in page order. Null ids and urls pass through; repeated rows are kept.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
