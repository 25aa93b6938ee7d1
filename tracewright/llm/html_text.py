"""Main-text extraction from HTML by scoring the element tree.

Every paragraph earns points for its length and its commas; its ancestors inherit them, fading with
distance, and each container's sum is discounted by the share of its text that stands in links. The best
container is kept together with the siblings that score or read like it. Parsing is linear in the page. A
``header`` or ``footer`` goes wherever it stands, inside an article too: what is wanted has neither.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is never part of an article.
SKIP = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe svg math object canvas audio video dialog menu title xmp noembed noframes map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Start tags that end an open element of these kinds, up to the nearest of the limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe signup paywall sidebar sidebars aside rail widget widgets nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager toolbar header masthead footer foot comment comments disqus replies reply respond share sharing "
    "social related recommended recommendations search login complementary contentinfo".split()
)
#: Words that outweigh a mark, for wrappers whose class names both.
CONTENT = frozenset("article content main body post entry story text".split())
#: Elements that hold one paragraph; their points go to what contains them.
LEAF = frozenset("p pre h1 h2 h3 h4 h5 h6 li td dd dt blockquote".split())
LENGTH_POINT, BONUS = 100, {"article": 25.0, "main": 25.0}
FADE = (1.0, 0.5, 0.25, 0.125, 0.0625)
SIBLING_SHARE, SIBLING_LINKS = 0.2, 0.25

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)>?|[^<]+|<", re.S)
_named = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_word = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "parent", "parts", "skip", "size", "linked", "score", "order")

    def __init__(self, tag: str, parent: _Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.parts: list = []
        self.size = self.linked = 0
        self.score = 0.0


def _is_furniture(attributes: str) -> bool:
    words: set[str] = set()
    for name, value in _named.findall(attributes):
        if name.lower() == "hidden":
            return True
        words.update(_word.findall(value.lower()))
    return bool(words & FURNITURE) and not words & CONTENT


def _parse(page: str) -> tuple[_Node, list[_Node]]:
    root = _Node("#root", None, False)
    stack, nodes, at, end = [root], [root], 0, len(page)
    opened: Counter = Counter()

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < end:
        m = _token.match(page, at)
        at = m.end()
        piece = m.group()
        if piece[0] != "<" or len(piece) == 1:
            # References end at a tag: decoded here, no two pieces of text make one up.
            stack[-1].parts.append(html.unescape(piece))
            continue
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for k in () if opened[tag] <= 0 else range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "article", "body") and tag not in ("table", "tr", "body", "html", "article", "main", "section", "div"):
                    break
            continue
        if tag in ENDS_P or tag in ENDS:
            kinds, limits = ENDS.get(tag, (set(), set()))
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 or any(opened[x] > 0 for x in kinds) else ():
                open_tag = stack[k].tag
                if open_tag == "p" and tag in ENDS_P or open_tag in kinds:
                    close(k)
                elif open_tag in limits or open_tag in BLOCK and open_tag not in kinds:
                    break
        attributes = m.group(3)
        if tag in VOID:
            stack[-1].parts.append(_Node(tag, stack[-1], True))
            continue
        node = _Node(tag, stack[-1], stack[-1].skip or tag in SKIP or (bool(attributes) and tag not in ("html", "body") and _is_furniture(attributes)))
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else end
        elif not attributes.endswith("/") or tag in BLOCK:
            stack.append(node)
            opened[tag] += 1
    return root, nodes


def _walk(node: _Node) -> Iterator[tuple[str, _Node, str]]:
    """Events (enter, node, ''), (leave, node, '') and (text, owner, text) of what isn't skipped."""
    stack: list = [(node, iter(node.parts))]
    yield "enter", node, ""
    while stack:
        owner, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                yield "text", owner, part
            elif part.tag == "br" or part.tag == "hr":
                yield "text", owner, "\n"
            elif not part.skip:
                yield "enter", part, ""
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            yield "leave", owner, ""


def _blocks(node: _Node) -> Iterator[tuple[_Node, str, int]]:
    """Blocks of running text under ``node`` in page order: innermost block element, text, characters in links."""
    home, links, parts, linked = [node], 0, [], []
    for kind, at, text in _walk(node):
        if kind == "text":
            parts.append(text)
            if links:
                linked.append(text)
            continue
        if at.tag == "a":
            links += 1 if kind == "enter" else -1
        elif at.tag in BLOCK or at is node:
            if parts:
                joined = " ".join("".join(parts).split())
                if joined:
                    yield home[-1], joined, min(len(joined), len(" ".join("".join(linked).split())))
                parts, linked = [], []
            if kind == "enter":
                home.append(at)
            else:
                home.pop()


def extract_main_text(page: str | None) -> str:
    """Text of the best container and its like siblings; blocks joined by two newlines, '' if there is none."""
    if not page:
        return ""
    root, nodes = _parse(page)
    for block, text, linked in _blocks(root):
        points = 1.0 + text.count(",") + len(text) / LENGTH_POINT
        block.size += len(text)
        block.linked += linked
        node: _Node | None = block
        if block.tag in LEAF:
            block.score += points * 0.1
            node = block.parent
        for fade in FADE:
            if node is None:
                break
            node.score += points * fade
            node = node.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    best, most = None, 0.0
    for node in nodes:
        if node.size and not node.skip and (node.tag in BLOCK or node is root):
            node.score = (node.score + BONUS.get(node.tag, 0.0)) * (1.0 - node.linked / node.size)
            if node.score > most:
                best, most = node, node.score
    if best is None:
        return ""
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        for other in best.parent.parts:
            if isinstance(other, _Node) and other is not best and not other.skip and other.size:
                like = other.tag == "p" or other.score >= most * SIBLING_SHARE and other.tag in ("article", "main", "section", best.tag)
                if like and other.linked <= SIBLING_LINKS * other.size:
                    kept.append(other)
        order = {id(x): k for k, x in enumerate(best.parent.parts) if isinstance(x, _Node)}
        kept.sort(key=lambda x: order[id(x)])
    return "\n\n".join(text for node in kept for _, text, _ in _blocks(node))


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``, one per row of ``df``.

    A null or empty page, or one without text outside furniture, gives an empty text. Null ids and urls and
    repeated rows pass through; pages of any length are read whole; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_main_text(x.as_py()) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_arrow(narrow, scan, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
