"""Main text of web pages by wrapper induction.

Pages are parsed into trees of block elements. Consecutive siblings of one kind fold into one
node, and the trees of a host are aligned by simple tree matching (the largest common ordered
subtree below equal roots). The aligned tree is the host's wrapper: nodes whose text is the
same on all pages that have them are template if enough different articles have them, others
are slots. Pages are told apart by the digest of their article, so copies of an article count
once; each node keeps its smallest ``SAMPLE`` digests. A page's content are
its slots inside the article, or, without an article, its slots that are not mostly links;
menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known by
their elements and class names and are no content wherever they stand.

Wrappers are folded per task, then per host and salt, then per host, so a host with a third of
all pages is reduced where its pages lie; only wrappers are shuffled for that, never pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
NO_CONTENT = frozenset(
    "head nav header footer aside form button select dialog menu".split()
) | RAW
MAIN = frozenset(("article", "main"))
BOILERPLATE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|sidebar|"
    r"footer|header|masthead|comments?|replies|respond|disqus|cookies?|consent|notice|alert|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|"
    r"recommended|widget|pagination|pager|toolbar|copyright|disclaimer|teaser)(?:$|[-_ ])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dd", ("dl",)),
    "dd": ("dt", ("dl",)),
    "tr": ("tr", ("table",)),
    "td": ("td", ("tr", "table")),
    "th": ("th", ("tr", "table")),
    "option": ("option", ("select",)),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
SUPPORT = 5
#: Digests kept per node. The host's smallest ones are an even sample of its different articles
#: (all of them, if no more), and a node holds each of them that it stands in.
SAMPLE = 64


class Block:
    """A block element of a page: its key, parts in page order (texts and blocks), link letters."""

    __slots__ = ("key", "tag", "parts", "links", "boiler", "inner")

    def __init__(self, tag: str, attributes: str = ""):
        names, role = "", ""
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if name.lower() == "role":
                    role = value
                else:
                    names += " " + value
        names = re.sub(r"\d+", "0", names.strip())
        self.tag = tag
        self.key = f"{tag}.{names}" if names else tag
        self.boiler = (
            tag in NO_CONTENT or role in ROLES or bool(names and BOILERPLATE.search(names))
        )
        self.parts: list = []
        self.links = 0
        self.inner = 0  # open inline elements of the same tag that have no block

    def text(self) -> str:
        return "".join(p for p in self.parts if isinstance(p, str))


def _inline(stack: list[Block], tag: str) -> int:
    """Place of the open inline block of this tag in the enclosing block, 0 if there is none."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            return i
        if stack[i].tag not in INLINE:
            break
    return 0


def _leave(stack: list[Block], tag: str, whole: bool = False) -> None:
    """End an inline element: its block, if it has one, or the last of those inside the block."""
    i = _inline(stack, tag)
    if i and stack[i].inner and not whole:
        stack[i].inner -= 1
    elif i:
        del stack[i:]


def parse(html: str) -> Block:
    """The tree of block elements; inline markup dissolves into its block's text.

    Inline elements that are boilerplate by class, id or role are blocks up to their end tag.
    """
    root = Block("html")
    stack, link = [root], 0
    end, size = 0, len(html)
    find = _TOKEN.search
    while end < size:
        hit = find(html, end)
        start = hit.start() if hit else size
        if start > end:
            said = html[end:start]
            said = unescape(said) if "&" in said else said
            stack[-1].parts.append(said)
            if link:
                stack[-1].links += len(said)
        if not hit:
            break
        end = hit.end()
        closing, tag, attributes = hit.group(1), hit.group(2), hit.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                link = 0
            if tag in INLINE:
                _leave(stack, tag)
                continue
            if tag == "br" or tag == "p" and all(b.tag != "p" for b in stack):
                stack[-1].parts.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    link = 0
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, end)
            if not attributes.endswith("/"):
                end = close.end() if close else size
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "hr") else "")
            continue
        if tag == "a":
            link = 1
        block = None
        if tag not in INLINE:
            if tag in ("html", "body"):
                continue
            block = Block(tag, attributes)
        else:
            if tag == "a":  # links do not nest
                _leave(stack, tag, True)
            if _EMPTY.search(attributes):
                continue
            if "class" in attributes or "id" in attributes or "role" in attributes:
                known = Block(tag, attributes)
                block = known if known.boiler else None
            if block is None:
                i = _inline(stack, tag)
                if i:
                    stack[i].inner += 1
                continue
        if tag not in INLINE:
            link = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "button", "object", "li", "div", "section"):
                    break
            if tag in _CLOSES:
                own, stops = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in (own, tag):
                        del stack[i:]
                        break
                    if stack[i].tag in stops:
                        break
        if len(stack) < 200:  # deeper elements belong to the block they are in
            stack[-1].parts.append(block)
            stack.append(block)
    return root


class Node:
    """A node of a wrapper: articles that have it, its text's mark while constant, letters.

    ``seen`` are the smallest digests of these articles (none in boilerplate), ``common`` says
    once the host is complete that they are enough for a template.
    """

    __slots__ = ("key", "tag", "boiler", "children", "seen", "common", "mark", "letters", "links")

    def __init__(self, key, tag, boiler, seen, common, mark, letters, links, children):
        self.key, self.tag, self.boiler, self.children = key, tag, boiler, children
        self.seen, self.common = seen, common
        self.mark, self.letters, self.links = mark, letters, links

    def add(self, other: Node, same_page: bool) -> None:
        if same_page:  # siblings that fold: their texts together are the node's text
            self.mark = _mark(f"{self.mark} {other.mark}")
        else:
            self.seen = _smallest(self.seen, other.seen)
            if self.mark != other.mark:
                self.mark = None
        self.letters += other.letters
        self.links += other.links

    def settle(self, host: set[int] | None = None) -> None:
        """Let the digests of the complete host go: only what they say of each node stays."""
        host = set(self.seen) if host is None else host
        for child in self.children:
            child.settle(host)
        share = sum(x in host for x in self.seen)
        self.common = len(self.seen) >= SUPPORT and 2 * share >= len(host)
        self.seen = []

    def packed(self, above: list[int] | None = None) -> list:
        seen = None if self.seen == above else self.seen  # mostly as the parent's
        rest = [c.packed(self.seen) for c in self.children]
        mark, letters, links = self.mark, self.letters, self.links
        return [self.key, self.boiler, seen, self.common, mark, letters, links, rest]

    @staticmethod
    def unpacked(x: list, above: list[int] | None = None) -> Node:
        seen = above if x[2] is None else x[2]
        children = [Node.unpacked(c, seen) for c in x[7]]
        return Node(x[0], x[0].split(".")[0], x[1], seen, x[3], x[4], x[5], x[6], children)


def _smallest(a: list[int], b: list[int]) -> list[int]:
    """The smallest ``SAMPLE`` digests of two sorted lists."""
    if not b or a == b or len(a) == SAMPLE and b[0] > a[-1]:
        return a
    return sorted({*a, *b})[:SAMPLE]


def matched(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: nodes of the largest common ordered subtree below equal roots."""
    if a.key != b.key:
        return 0
    found = memo.get((id(a), id(b)))
    if found is None:
        found = memo[id(a), id(b)] = 1 + _table(a.children, b.children, memo)[-1][-1]
    return found


def _table(a: list[Node], b: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], rows[-1]
        for j, y in enumerate(b):
            best = above[j] + matched(x, y, memo) if x.key == y.key else 0
            row.append(max(row[j], above[j + 1], best))
        rows.append(row)
    return rows


def pairs(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int | None, int | None]]:
    """Aligned children in order: (place in a, place in b), None where one has no partner."""
    rows = _table(a, b, memo)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1].key == b[j - 1].key:
            if rows[i][j] == rows[i - 1][j - 1] + matched(a[i - 1], b[j - 1], memo):
                i, j = i - 1, j - 1
                out.append((i, j))
                continue
        if j and (not i or rows[i][j] == rows[i][j - 1]):
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    return out[::-1]


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """Fold ``b`` into ``a``: aligned nodes add up, others are inserted where they stand."""
    a.add(b, same_page)
    if [c.key for c in a.children] == [c.key for c in b.children]:
        for x, y in zip(a.children, b.children, strict=True):
            merge(x, y, same_page)
        return a
    children = []
    for i, j in pairs(a.children, b.children, {}):
        if i is None:
            children.append(b.children[j])
        elif j is None:
            children.append(a.children[i])
        else:
            children.append((a.children[i], b.children[j]))
    a.children = [merge(*c, same_page) if isinstance(c, tuple) else c for c in children]
    return a


def _mark(text: str) -> str:
    return blake2b(" ".join(text.split()).encode(), digest_size=6).hexdigest()


def article(page: Block) -> int:
    """Digest of a page's article, or of all its text without boilerplate if it has none."""

    def said(block: Block, inside: bool) -> Iterator[str]:
        if block.boiler:
            return
        inside = inside or block.tag in MAIN
        yield " "
        for part in block.parts:
            if not isinstance(part, str):
                yield from said(part, inside)
            elif inside:
                yield part

    return int(_mark("".join(said(page, not _has_main(page)))), 16)


def folded(block: Block, seen: list[int] | None = None) -> Node:
    """The wrapper of one page: siblings of one kind that follow each other are one node."""
    text = block.text()
    seen = [] if block.boiler else [article(block)] if seen is None else seen
    mark, letters, links = _mark(text), len(text), block.links
    node = Node(block.key, block.tag, block.boiler, seen, False, mark, letters, links, [])
    for part in block.parts:
        if isinstance(part, str):
            continue
        child = folded(part, seen)
        if node.children and node.children[-1].key == child.key:
            merge(node.children[-1], child, True)
        else:
            node.children.append(child)
    return node


class Wrapper:
    """A host's wrapper, ready to read pages."""

    def __init__(self, root: Node):
        self.root = root
        self.varies = any(x.mark is None for x in self._main(root, False))

    def _main(self, node: Node, inside: bool) -> Iterator[Node]:
        if node.boiler:
            return
        inside = inside or node.tag in MAIN
        if inside and node.letters:
            yield node
        for x in node.children:
            yield from self._main(x, inside)

    def template(self, node: Node | None) -> bool:
        """A node whose text stays the same while the host's articles vary."""
        return node is not None and self.varies and node.common and node.mark is not None

    def read(self, page: Block) -> str:
        """The content of a page in page order."""
        article = _has_main(page)
        out: list[str] = []
        self._read(page, self.root, not article, article, out)
        return " ".join("".join(out).split())

    def _read(self, block: Block, node: Node | None, inside: bool, article: bool, out: list) -> None:
        if block.boiler:
            return
        inside = inside or block.tag in MAIN
        slot = inside and not self.template(node)
        if slot and not article and 2 * block.links > len(block.text()):
            slot = False
        places = self._places(block, node)
        out.append(" ")
        for part in block.parts:
            if isinstance(part, str):
                if slot:
                    out.append(part)
            else:
                self._read(part, places.get(id(part)), inside, article, out)
        out.append(" ")

    def _places(self, block: Block, node: Node | None) -> dict[int, Node]:
        """The wrapper's node of each child block, by tree matching of the folded children."""
        children = [p for p in block.parts if not isinstance(p, str)]
        if node is None or not children:
            return {}
        runs: list[list[Block]] = []
        for child in children:
            if runs and runs[-1][0].key == child.key:
                runs[-1].append(child)
            else:
                runs.append([child])
        if [r[0].key for r in runs] == [c.key for c in node.children]:
            together = [(i, i) for i in range(len(runs))]
        else:
            page = [folded(r[0], []) for r in runs]
            together = pairs(node.children, page, {})
        out = {}
        for i, j in together:
            if i is not None and j is not None:
                for child in runs[j]:
                    out[id(child)] = node.children[i]
        return out


def _has_main(block: Block) -> bool:
    if block.boiler:
        return False
    return block.tag in MAIN or any(_has_main(p) for p in block.parts if not isinstance(p, str))


def host(url: Column) -> Column:
    """Host of a URL in lower case, empty where there is none."""
    pattern = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), pattern, 1)


def wrappers(pages: DataFrame, salts: int = 64, hosts_held: int = 2000) -> DataFrame:
    """(host, wrapper): one wrapper per host, from all its pages."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}

        def out() -> pa.RecordBatch:
            packed = [json.dumps(n.packed()) for n in held.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array([*held], pa.string()), pa.array(packed, pa.string())], ["host", "wrapper"]
            )

        for batch in batches:
            names, pages_ = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(names):
                node = folded(parse(pages_[i].as_py() or ""))
                if name in held:
                    merge(held[name], node)
                else:
                    held[name] = node
            if len(held) > hosts_held:
                yield out()
                held.clear()
        if held:
            yield out()

    def folded_group(group: pd.DataFrame, whole: bool) -> pd.DataFrame:
        nodes = [Node.unpacked(json.loads(x)) for x in sorted(group["wrapper"])]
        root = nodes[0]
        for other in nodes[1:]:
            merge(root, other)
        if whole:
            root.settle()
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(root.packed())]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        return folded_group(group, False)

    def complete(group: pd.DataFrame) -> pd.DataFrame:
        return folded_group(group, True)

    schema = "host string, wrapper string"
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(local, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    half = salted.groupBy("host", "salt").applyInPandas(together, schema)
    return half.groupBy("host").applyInPandas(complete, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none).

    White space is one space, blocks are joined in page order by one space. A null html or url
    is empty (pages without a host share one wrapper), broken markup is read as far as it goes,
    equal rows stay separate rows, an empty table gives no rows, further columns are not read.
    Text that is the same on all pages of a host that have its place is template if at least
    ``SUPPORT`` different articles and half of the host's have it (copies of an article count
    once), and only if the articles of that host differ.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = slim.withColumn("host", host(F.col("url")))
    learned = wrappers(slim).withColumnRenamed("host", "of")
    joined = keyed.join(learned, F.col("host") == F.col("of"), "left").select(
        "page_id", "url", "html", "wrapper"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper = None, None
        for batch in batches:
            html, packed = batch.column(2), batch.column(3)
            texts = []
            for i in range(batch.num_rows):
                now = packed[i].as_py()
                if wrapper is None or now != last:
                    last = now
                    wrapper = Wrapper(Node.unpacked(json.loads(now)) if now else folded(Block("html")))
                texts.append(wrapper.read(parse(html[i].as_py() or "")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string")
