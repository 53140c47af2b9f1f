"""Main text of web pages by composite text density.

A page is parsed into a tree, from which elements that are never text of an article (menus, footers, forms, scripts, ...) are cut by
tag, role and style. For every node that is left, the composite density is its characters per tag, adjusted by how much of it is
links; what a class or id names as something around an article counts little. The node whose children's densities have the largest
sum is chosen, ties by page order. It is returned with the article or main element around it; where there is none, the lowest density
on its path from the body is the threshold that anything beside this path must reach to be returned too.

Inside what is chosen a name alone removes nothing but adverts and reader comments, which no density tells from an article; other
named nodes go if links make up a third of them or they hold articles of their own, and straight in the body if they are below the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What a camel-cased or hyphenated class or id is cut into.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul option".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "script style noscript template nav footer aside form button select textarea input iframe object embed svg math canvas audio video dialog menu head title noembed noframes xmp map applet".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer breadcrumb breadcrumbs comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing social related recommended recommendations widget masthead toolbar pagination pager login signup copyright disclaimer hidden overlay alert paywall".split()
)
#: Names that remove a node inside the chosen one too, as they stand alone or with FILLERS only.
ADVERTS_AND_COMMENTS = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments disqus respond replies".split())
#: Parts of a class or id that don't change what the others name.
FILLERS = frozenset("area bar block body box container content inner item items js left list main outer panel right section thread top bottom wrap wrapper".split())
#: Of a named node's density, what counts; and the share of links from which a named node inside the chosen one goes.
NAMED_WEIGHT, LINK_SHARE = 1 / 50, 1 / 3
CLOSED_BY = {  # a start tag ends the nearest open element of these, unless one of the barriers stands between
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())


class Node:
    __slots__ = ("attributes", "items", "parent", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list = []  # texts and nodes in page order


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order; the first is the body. Never fails, whatever the markup."""
    body = Node("body")
    nodes, stack, at = [body], [body], 0
    block_at = [0]  # places of blocks on the stack
    inline: list[Counter[str]] = [Counter()]  # for each of these blocks, the other elements open in it
    open_blocks: Counter[str] = Counter()

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag = stack.pop().tag
            if block_at[-1] == len(stack):
                block_at.pop()
                inline.pop()
                open_blocks[tag] -= 1
            else:
                inline[-1][tag] -= 1

    def enter(node: Node) -> None:
        if node.tag in BLOCKS or node.tag == "head":
            block_at.append(len(stack))
            inline.append(Counter())
            open_blocks[node.tag] += 1
        else:
            inline[-1][node.tag] += 1
        stack.append(node)

    while True:
        found = MARKUP.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            stack[-1].items.append(html.unescape(text))
        if not found:
            return nodes
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag in ("html", "body"):
                continue
            if stack[-1].tag == "head" and tag not in HEAD_ONLY:
                close(len(stack) - 1)
            if tag in BLOCKS and stack[block_at[-1]].tag == "p":
                close(block_at[-1])
            if tag in CLOSED_BY:
                ended, barriers = CLOSED_BY[tag]
                if any(open_blocks[x] for x in ended):
                    for k in reversed(block_at[1:]):
                        if stack[k].tag in barriers:
                            break
                        if stack[k].tag in ended:
                            close(k)
                            if tag != "tr" or stack[k - 1].tag not in ended:
                                break
            node = Node(tag, found[2], stack[-1])
            nodes.append(node)
            stack[-1].items.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not (found[2].rstrip().endswith("/") and tag in ("svg", "path", "math")):
                enter(node)
        elif found[3]:
            tag = found[3].lower()
            if tag in BLOCKS or tag == "head":
                if open_blocks[tag]:
                    close(next(k for k in reversed(block_at) if stack[k].tag == tag))
            elif inline[-1][tag]:  # an inline end tag doesn't end a block around it
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}


def names_of(node: Node) -> set[str]:
    """What the class and id call a node: the parts of words that consist of DROPPED_NAMES, numbers and FILLERS alone."""
    of = attributes(node)
    names = set()
    for token in f"{of.get('class', '')} {of.get('id', '')}".split():
        parts = {x.lower() for x in PARTS.findall(token) if not x.isdigit()} - FILLERS
        if parts and parts <= DROPPED_NAMES:
            names |= parts
    return names


def dropped(node: Node, in_article: bool) -> bool:
    """Whether a node is, by its element, role or style, something around the article."""
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    if not node.attributes or node.tag == "body":
        return False
    of = attributes(node)
    if "hidden" in of or of.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", "")):
        return True
    return of.get("role", "").lower() in DROPPED_ROLES


def named(node: Node) -> set[str]:
    """The names by which a node counts as something around the article."""
    if not node.attributes or node.tag in ("body", "main") or node.tag in HEADINGS:
        return set()
    names = names_of(node)
    return names & (ADVERTS_AND_COMMENTS | {"related", "promo", "hidden"}) if node.tag == "article" else names


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, weighed by the share of plain text and tags against links."""
    if not chars:
        return 0.0
    tags, plain = max(tags, 1), max(chars - link_chars, 1)
    scale = math.log(math.log(chars / plain * link_chars + body_share * chars + math.e))
    return chars / tags * math.log(1 + chars / max(link_chars, 1) * tags / max(link_tags, 1)) / max(scale, 1.0)


class Weighed:
    """For each node, in page order: parent, characters, share of links, composite density and the sum of its children's densities."""

    def __init__(self, nodes: list[Node]):
        at = {id(n): k for k, n in enumerate(nodes)}
        self.nodes = nodes
        self.parent = [at[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        n_nodes = len(nodes)
        self.gone, self.link, self.names = [False] * n_nodes, [False] * n_nodes, [set()] * n_nodes
        article, weight = [False] * n_nodes, [1.0] * n_nodes
        for k, node in enumerate(nodes):
            p = self.parent[k]
            inside = p >= 0 and article[p]
            self.gone[k] = p >= 0 and self.gone[p] or dropped(node, inside)
            article[k] = inside or node.tag in ("article", "main")
            self.link[k] = p >= 0 and self.link[p] or node.tag == "a"
            if not self.gone[k]:
                self.names[k] = named(node)
                if "header" in names_of(node) and not inside and node.attributes and node.tag not in HEADINGS:
                    self.names[k] = self.names[k] | {"header"}
            weight[k] = NAMED_WEIGHT if self.names[k] or p >= 0 and weight[p] < 1 else 1.0
        self.chars, tags, link_chars, link_tags = [0] * n_nodes, [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
        for k in range(n_nodes - 1, -1, -1):
            if self.gone[k]:
                continue
            own = sum(len("".join(x.split())) for x in nodes[k].items if isinstance(x, str))
            self.chars[k] += own
            link_chars[k] += own if self.link[k] else 0
            if (p := self.parent[k]) >= 0:
                self.chars[p] += self.chars[k]
                tags[p] += tags[k] + 1
                link_chars[p] += link_chars[k]
                link_tags[p] += link_tags[k] + (nodes[k].tag == "a")
        share = link_chars[0] / max(self.chars[0], 1)
        self.links = [x / max(c, 1) for x, c in zip(link_chars, self.chars, strict=True)]
        self.dense = [0.0 if self.gone[k] else weight[k] * density(self.chars[k], tags[k], link_chars[k], link_tags[k], share) for k in range(n_nodes)]
        self.total = [0.0] * n_nodes
        for k in range(1, n_nodes):
            self.total[self.parent[k]] += self.dense[k]

    def path(self, k: int) -> list[int]:
        """k and all nodes around it, the body last."""
        out = [k]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out


def extract(page: str) -> str:
    """The article of a page: its blocks, white space made single, joined by line feeds; empty if there is none."""
    tree = Weighed(parse(page))
    nodes, parent, dense = tree.nodes, tree.parent, tree.dense
    if not tree.chars[0]:
        return ""
    best = max(range(len(nodes)), key=lambda k: (tree.total[k], -k))
    path = tree.path(best)
    on_path = set(path)
    around = next((k for k in path if nodes[k].tag == "article" and not tree.names[k]), None)
    if around is None:
        around = next((k for k in path if nodes[k].tag == "main" or "articleBody" in nodes[k].attributes), None)
    top = best if around is None else around
    threshold = min(dense[k] for k in path)
    inside, holds = [False] * len(nodes), [n.tag == "article" for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        holds[parent[k]] = holds[parent[k]] or holds[k]
    out = {id(n) for n, g in zip(nodes, tree.gone, strict=True) if g}
    for k in range(len(nodes)):
        p = parent[k]
        inside[k] = k == top or p >= 0 and inside[p]
        if k in on_path or tree.gone[k]:
            continue
        if inside[k]:
            names = tree.names[k]
            apart = names and (names & ADVERTS_AND_COMMENTS or tree.links[k] >= LINK_SHARE or holds[k] or top == 0 and dense[k] < threshold)
        else:
            # beside the path: what holds the page's dense text, and a title right beside the chosen node
            apart = p in on_path and dense[k] < threshold and not (nodes[k].tag in HEADINGS and p == parent[top] and not tree.links[k])
        if apart:
            out.add(id(nodes[k]))
    return "\n".join(blocks(nodes[top if around is not None else 0], out))


def blocks(top: Node, gone: set[int]) -> list[str]:
    out, line = [], []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif id(x) not in gone:
            if x.tag == "br":
                line.append(" ")
            block = x.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(x.items))
    end()
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null html counts as empty and, like a page without text, gives the empty text. Ids and urls may be null, and rows may repeat: each
    is read by itself. Of nodes with one density sum the first in page order is chosen. Broken markup is read as far as it goes, a page
    of any length whole. An empty table gives an empty result. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                texts = [extract(x.as_py()) for x in piece.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
