"""HTML extraction with a site style tree.

The element trees of all pages of a host are merged: elements with the same chain of tags and classes are one style node. A node's
presentation importance is the entropy of its child sequences over the pages that hold it, its content importance the entropy of the texts
below it, both as parts of the largest possible; a branch that looks and reads alike on page after page has neither. Every page loses its
branches of low importance; on hosts of few pages the other hosts decide. Article and main elements stay as they are: where many pages are copies, what they
say would look like a template. Tags, roles and class names that say what a branch is (advert, form,
comments ...) take what entropy can't tell from text. Of what is left the text blocks are joined.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MIN_PAGES = 5
LOW = 0.2
ROWS = 256  # pages in a batch of results
MAX_DEPTH = 2000  # deeper elements become children of the one at this depth; their text stays

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
RAW_TEXT = frozenset("title textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
NOISE_TAGS = frozenset("head script style noscript template nav footer aside form iframe svg canvas object button select option textarea input label dialog menu audio video map math".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social comment comments reply replies disqus related recommended pagination pager widget login search toolbar banner skip".split())
OUTER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: What an opening tag closes, if open: the tag, and the elements that keep it open.
CLOSES = {t: (frozenset("p".split()), frozenset("table td th button".split())) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()} | {
    "li": (frozenset("li".split()), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl".split())),
    "tr": (frozenset("tr td th".split()), frozenset("table".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset("option".split()), frozenset("select".split())),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    """An element: tag, style (tag, classes and role as one string), kind ('noise', 'main' or ''), children (nodes and strings)."""

    __slots__ = ("children", "kind", "parent", "path", "style", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None, inside: bool):
        self.tag, self.parent, self.children = tag, parent, []
        self.style, self.kind = tag, "noise" if tag in NOISE_TAGS else "main" if tag in ("article", "main") else ""
        if attrs and "=" in attrs or "hidden" in attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            names, role = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()
            self.style = f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}@{role}"
            words = {w.lower() for w in _WORD.findall(names)}
            if tag in ("html", "body"):
                pass
            elif self.kind == "main":
                if words & COMMENT_WORDS:
                    self.kind = "noise"
            elif words & NOISE_WORDS or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or (not inside and words & OUTER_WORDS):
                self.kind = "noise"
            elif role == "main":
                self.kind = "main"
        if tag == "header" and not inside:
            self.kind = "noise"
        self.path = None


def parse(page: str) -> Node:
    """The element tree of a page, for any string: unknown or unmatched tags do no harm, what is open at the end is closed."""
    root = Node("", "", None, False)
    at, inside, pos, depth = root, 0, 0, 0
    while pos < len(page):
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            at.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while at is not up.parent:
                    inside -= at.kind == "main"
                    depth -= 1
                    at = at.parent
            continue
        closes, keeps = CLOSES.get(tag, ((), ()))
        up = at
        while closes and up is not root and up.tag not in keeps:
            if up.tag in closes:
                while at is not up.parent:
                    inside -= at.kind == "main"
                    depth -= 1
                    at = at.parent
                up = at
                continue
            if up.tag in BLOCK and up.tag not in closes and tag not in ("tr", "td", "th"):
                break
            up = up.parent
        attrs = m[3] or m[6] or ""
        node = Node(tag, attrs, at, inside > 0)
        at.children.append(node)
        if tag in RAW or tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if tag in RAW_TEXT:
                node.children.append(html.unescape(page[pos : end.start() if end else len(page)]))
            pos = end.end() if end else len(page)
        elif tag not in VOID and not attrs.endswith("/") and depth < MAX_DEPTH:
            at = node
            depth += 1
            inside += node.kind == "main"
    return root


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def style_nodes(root: Node) -> list[tuple[int, int, int]]:
    """(path, child sequences, texts) hashes of every style of a page: elements of one path are added up. Sets each node's path.

    Hashes go from child to parent, so that a page is gone through once whatever its depth.
    """
    found: dict[int, list[int]] = {}

    def visit(node: Node, path: int) -> int:
        node.path, texts, shape = path, [], []
        for c in node.children:
            if isinstance(c, str):
                texts.append(" ".join(c.split()))
            elif c.tag not in VOID and c.tag not in RAW:
                texts.append(str(visit(c, _hash(f"{path}/{c.style}"))))
            if isinstance(c, Node) and (not shape or shape[-1] != c.style):
                shape.append(c.style)
        text = _hash("\x00".join(x for x in texts if x))
        sums = found.setdefault(path, [0, 0])
        sums[0] += _hash(",".join(shape))
        sums[1] += text
        return text

    for c in root.children:
        if isinstance(c, Node) and c.tag not in VOID and c.tag not in RAW:
            visit(c, _hash(c.style))
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    return [(path, signed(shape), signed(text)) for path, (shape, text) in found.items()]


def allow_depth() -> None:
    """Deeply nested pages need more than Python's usual depth of calls."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * MAX_DEPTH))


def main_text(root: Node, low: frozenset[int]) -> tuple[str, int]:
    """The page's text blocks joined by newlines, and the number of branches cut for low importance.

    Only what stands in article or main elements counts where there are any outside of noise, else the whole body.
    """

    def has_main(node: Node) -> bool:
        return any(isinstance(c, Node) and c.kind != "noise" and (c.kind == "main" or has_main(c)) for c in node.children)

    blocks, now, cut = [], [], 0

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    def walk(node: Node, wanted: bool, inside: bool) -> None:
        nonlocal cut
        for c in node.children:
            if isinstance(c, str):
                if wanted:
                    now.append(c)
                continue
            block = c.tag in BLOCK
            low_here = not inside and c.kind != "main" and c.path in low and not has_main(c)
            if low_here or c.kind == "noise":
                cut += low_here
                if block:
                    flush()
                continue
            if block:
                flush()
            elif c.tag in ("br", "td", "th"):
                now.append(" ")
            walk(c, wanted or c.kind == "main", inside or c.kind == "main")
            if block:
                flush()

    walk(root, not has_main(root), False)
    flush()
    return "\n".join(blocks), cut


def site_style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, presentation, content, importance of every style node of ``pages`` (host, html).

    Both entropies are given as the number of equally frequent variants that they stand for, over n_pages: 1 where every page differs, 0 where all are
    alike, small where many pages share a few menus; a node of a single page counts as 1.
    Tasks count alike nodes before the shuffle, and a hot host is many keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_depth()
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, n = list(count), list(count.values())
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)], pa.array(n, pa.int64())], names=["host", "path", "shape", "text", "n"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in style_nodes(parse(page or "")):
                    count[(host, *node)] += 1
            if len(count) > 100_000:
                yield flush()
        yield flush()

    seen = pages.select("host", "html").mapInArrow(run, "host string, path long, shape long, text long, n long")
    seen = stage(seen.groupBy("host", "path", "shape", "text").agg(F.sum("n").alias("n")))
    alike = {}
    for part in ("shape", "text"):
        sums = seen.groupBy("host", "path", part).agg(F.sum("n").alias("n")).groupBy("host", "path")
        alike[part] = sums.agg(F.sum("n").alias("n_pages"), F.sum(F.col("n") * F.log("n")).alias("_s"))
        whole = F.col("n_pages")
        alike[part] = alike[part].select("host", "path", "n_pages", F.when(whole > 1, (F.exp(F.log(whole) - F.col("_s") / whole) - 1) / (whole - 1)).otherwise(1.0).alias(part))
    tree = alike["shape"].join(alike["text"].drop("n_pages"), ["host", "path"])
    return tree.select("host", "path", "n_pages", F.col("shape").alias("presentation"), F.col("text").alias("content"), F.greatest("shape", "text").alias("importance"))


def low_paths(tree: DataFrame, low: float, min_pages: int, min_hosts: int = 3) -> DataFrame:
    """(host, path) of the style nodes to cut.

    A host judges a node that ``min_pages`` of its pages hold: low importance is below ``low``. Where a host has fewer, the other hosts decide: the node goes
    if ``min_hosts`` of them at least judge it, and more than half of those find it low.
    """
    judged = tree.withColumn("poor", F.when(F.col("n_pages") >= min_pages, F.col("importance") < low))
    votes = judged.where("poor is not null").groupBy("path").agg(F.count("*").alias("hosts"), F.sum(F.col("poor").cast("int")).alias("against"))
    general = votes.where(f"hosts >= {min_hosts} and 2 * against > hosts").select("path")
    own = judged.where("poor").select("host", "path")
    return own.unionByName(judged.where("poor is null").select("host", "path").join(general, "path").select("host", "path"))


def extract_main_text(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_cut of every row of ``pages`` (page_id, url, html); n_cut is the number of branches cut for low importance.

    A null or empty html gives an empty text. A page whose branches would all go by their entropies (as when a host's pages are all
    alike) keeps them. Importance decides first, see :func:`low_paths`; tags, roles and names take what differs from page to page but isn't main text, such
    as comments. Null urls share the empty host. White space is what Python's split takes for it. Repeated rows are pages of their own. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[^:]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    tree = stage(site_style_tree(rows))
    poor = low_paths(tree, low, min_pages).groupBy(F.col("host").alias("_host")).agg(F.collect_list("path").alias("low"))
    rows = rows.join(stage(poor), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_depth()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, cuts = [], []
                for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    root = parse(page or "")
                    if paths:
                        style_nodes(root)
                    text, cut = main_text(root, frozenset(paths or ()))
                    if cut and not text:
                        text, cut = main_text(root, frozenset())
                    texts.append(text)
                    cuts.append(cut)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(cuts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_cut"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_cut long")
