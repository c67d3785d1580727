"""HTML extraction: the main text of pages, by site template removal.

A page becomes a tree of elements. Each element's subtree has a hash (names, kinds and normalised text of all
in it); Spark counts on how many pages of its host a subtree stands, and subtrees that recur on many pages of
the host are its template and are deleted. In what the page itself marks as an article (article, main, or a
container named so), a container or paragraph is template only if what stands around it in the article differs
on most of the pages that have it, so copies and near copies of an article don't make its text template;
headings, items, cells and inline elements are content there even if they recur. By the marks of the page
itself menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go wherever they
stand. Of a main element all other text stays, beside an article in it too.

Blocks are the stretches of text between block elements; line breaks end no block. White space in a block (Unicode's,
no-break spaces too) becomes one space, character references are decoded, blocks are joined by a blank line.

Nulls and odd rows: a null html is an empty page, with empty text; without a host pages count as one site.
Rows are pages each for themselves, repeated rows count as often as they stand. An empty table gives an empty
result. Markup that isn't closed, or closed twice, is read as browsers do in the main: a paragraph ends where
another block begins, an end tag without a start is dropped, and what is open at the end is closed.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, table, written

#: A subtree is template if it stands on at least so many pages of its host, and on at least this part of them.
MIN_PAGES, SHARE = 8, 0.2
#: In an article, those pages are counted whose rest of the article differs, and they are at least this part of the pages with the subtree.
DIFFERENT = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACES = re.compile(r"\s+")
#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option select summary tbody td tfoot th thead tr".split())
#: What an element's start ends, up to the containers that hold it back.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: Elements that are never part of the main text.
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav header footer aside form button input select textarea dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class and id that name what is no main text; a name is split at what is no letter or digit.
NAMED = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social related recommended comment comments respond replies disqus pagination pager toolbar widget".split())
#: Elements of an article that can be template.
PASSAGES = BLOCK - frozenset("h1 h2 h3 h4 h5 h6 hgroup header li dt dd td th tr tbody thead tfoot caption figcaption legend summary option pre body html head".split())
#: What the digest of a subtree in an article ends with, where it is counted.
INSIDE = (b"m0", b"m1")
MAIN = frozenset("article main content post entry story".split())


class Node:
    __slots__ = ("name", "attributes", "children", "text", "skip", "main", "digest")

    def __init__(self, name: str, attributes: str = "", text: str = ""):
        self.name, self.attributes, self.text, self.children = name, attributes, text, []
        self.skip = self.main = False
        self.digest = b""


def parse(source: str) -> Node:
    """The tree of a page. Text nodes have the name ''."""
    root = Node("#root")
    stack, at, size = [root], 0, len(source)

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(Node("", text=html.unescape(raw)))

    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not any(n.name == "p" for n in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break  # an inline end tag doesn't end blocks
            continue
        if name in CLOSES_P:
            close(stack, {"p"}, {"table", "td", "th", "article", "section", "div", "li", "blockquote", "body", "form", "button"})
        if name in ENDS:
            close(stack, *ENDS[name])
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            node.text = source[at : end.start() if end else size]
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def close(stack: list[Node], names: set[str], until: set[str]) -> None:
    """End the outermost open element of these names, not looking beyond its containers."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in names:
            del stack[k:]
            return
        if stack[k].name in until:
            return


def mark(root: Node) -> None:
    """Set digest, skip and main of all nodes, children first, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        h = hashlib.blake2b(node.name.encode(), digest_size=16)
        h.update(SPACES.sub(" ", node.text).strip().encode("utf-8", "surrogatepass"))
        for c in node.children:
            if c.name or c.text.strip():
                h.update(c.digest)
        words: set[str] = set()
        for m in ATTRIBUTE.finditer(node.attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words.update(re.findall(r"[a-z0-9]+", value))
                h.update(f" {key}={value}".encode("utf-8", "surrogatepass"))
            elif key == "role":
                node.skip |= value in ROLES
                words |= {"main"} & {value}
            elif key in ("hidden", "aria-hidden") and value != "false":
                node.skip = True
        if node.name not in ("html", "body", "article", "main"):
            node.skip |= node.name in DROPPED or not words.isdisjoint(NAMED)
        node.main = not node.skip and (node.name in ("article", "main") or not words.isdisjoint(MAIN))
        node.digest = h.digest()


def subtrees(root: Node) -> set[tuple[bytes, bytes]]:
    """Hashes of the elements with text that could be template, and for those in marked elements (once for each of INSIDE)
    one of the other texts there, drawn by its hash and the likelier the longer it is, which tells articles apart
    but seldom near copies of one, and seldom draws another template."""
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.name and not node.skip and not node.main:
            if node.name not in ("#root", "html", "body", "br", "hr", "meta"):
                out.add((node.digest, b""))
            todo += node.children
    texts: list[tuple[list[float], bytes]] = []
    spans: list[tuple[bytes, int, int]] = []
    steps = [(n, -1) for n in reversed(tops(root))]
    while steps:
        node, began = steps.pop()
        if began >= 0:
            if len(texts) > began:
                spans.append((node.digest, began, len(texts)))
        elif not node.name:
            if size := len(node.text.strip()):
                texts.append(([-math.log((int.from_bytes(node.digest[k : k + 8]) + 1) / 2**64) / size for k in (0, 8)], node.digest))
        elif not is_dropped(node, True) and node.name not in RAW:
            if node.name in PASSAGES:
                steps.append((node, len(texts)))
            steps += [(c, -1) for c in reversed(node.children)]
    none = (math.inf, b"")
    for k, end in enumerate(INSIDE):
        drawn = [(x[k], digest) for x, digest in texts]
        before = list(accumulate(drawn, min, initial=none))
        after = list(accumulate(reversed(drawn), min, initial=none))[::-1]
        out.update((digest + end, min(before[lo], after[hi])[1]) for digest, lo, hi in spans)
    return out


def tops(root: Node) -> list[Node]:
    """The outermost elements marked as main; article and main alone if there are any."""
    marked, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if node.main:
            marked.append(node)
        else:
            todo += reversed(node.children)
    if any(n.name in ("article", "main") for n in marked):
        marked = [n for n in marked if n.name in ("article", "main")]
    return marked


def is_dropped(node: Node, inside: bool) -> bool:
    """In an article a header holds its headline and stays."""
    return node.skip and not (inside and node.name in ("header", "hgroup") and not only_names(node))


def blocks(root: Node, template: set[bytes]) -> list[str]:
    """Blocks of text, without dropped and template subtrees; if the page marks main elements, of these alone."""
    marked = tops(root)
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if block := SPACES.sub(" ", "".join(text)).strip():
            out.append(block)
        text.clear()

    for top in marked or [root]:
        steps: list[tuple[Node, bool, bool]] = [(top, bool(marked), False)]
        while steps:
            node, inside, end = steps.pop()
            if end:
                flush()
            elif not node.name:
                text.append(node.text)
            elif is_dropped(node, inside) or (node.digest + INSIDE[0] if inside else node.digest) in template and (node.name in PASSAGES or not inside):
                if node.name in BLOCK:
                    flush()
            elif node.name == "br":
                text.append(" ")
            elif node.name not in RAW:
                if node.name in BLOCK:
                    flush()
                    steps.append((node, inside, True))
                steps += [(c, inside or node.main, False) for c in reversed(node.children)]
        flush()
    return out


def only_names(node: Node) -> bool:
    """Whether class or id, not the element's kind, say that it is no main text."""
    words = {w for m in ATTRIBUTE.finditer(node.attributes) if m[1].lower() in ("class", "id") for w in re.findall(r"[a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())}
    return not words.isdisjoint(NAMED - {"header"})


def host_of(url: str | None) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, different: float = DIFFERENT) -> DataFrame:
    """host, digest (binary): subtrees that stand on many pages of their host. Counts are combined within tasks first,
    so a host with a third of all pages is no burden to a single one."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, rests = [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(source.as_py() or "")
                mark(root)
                found = [*subtrees(root), (b"", b"")]  # the empty one counts pages
                hosts += [host_of(url)] * len(found)
                digests += [x for x, _ in found]
                rests += [x for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(rests, pa.binary())], ["host", "digest", "rest"])

    # a subtree with the same text around it counts once in an article
    by_rest = pages.select("url", "html").mapInArrow(hashes, "host string, digest binary, rest binary").groupBy("host", "digest", "rest").agg(F.count("*").alias("all"))
    sums = by_rest.groupBy("host", "digest").agg(F.sum("all").alias("all"), F.count("*").alias("rests"))
    inside = F.octet_length("digest") > 16
    sums = sums.where(~inside | (F.col("rests") >= different * F.col("all"))).select("host", F.when(inside, F.concat(F.substring("digest", 1, 16), F.lit(INSIDE[0]))).otherwise(F.col("digest")).alias("digest"), F.when(inside, F.col("rests")).otherwise(F.col("all")).alias("n"))
    sums = sums.where((F.col("n") >= min_pages) | (F.octet_length("digest") == 0)).groupBy("host", "digest").agg(F.min("n").alias("n"), F.count("*").alias("draws"))
    sums = sums.where(~inside | (F.col("draws") == len(INSIDE))).drop("draws")  # both draws must tell: text that isn't sure to be template stays
    counts = written(sums, "subtrees")
    sizes = counts.where(F.octet_length("digest") == 0).select("host", F.col("n").alias("pages"))
    found = counts.where(F.octet_length("digest") > 0).join(sizes, "host")
    return found.where(F.col("n") >= F.col("pages") * share).select("host", "digest")


def extracted(pages: DataFrame, template: DataFrame, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html). template: a written table; it goes to the
    pages while it is small, else each host's part is joined to the host's pages."""
    kept = "page_id long, url string, text string, n_chars long"
    page = F.col("page_id").cast("long").alias("page_id")
    small = 120 * template.count() <= max_broadcast
    if small:
        known: dict[str, set[bytes]] = {}
        for r in template.collect():
            known.setdefault(r["host"], set()).add(bytes(r["digest"]))
        shared = pages.sparkSession.sparkContext.broadcast(known)
        rows = pages.select(page, "url", "html")
    else:
        shared = None
        by_host = template.groupBy("host").agg(F.collect_set("digest").alias("digests"))
        host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.lit("")))
        rows = pages.withColumn("host", host).join(by_host, "host", "left").select(page, "url", "html", "digests")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            urls = batch.column(1).to_pylist()
            for k, (url, source) in enumerate(zip(urls, batch.column(2), strict=True)):
                root = parse(source.as_py() or "")
                mark(root)
                gone = shared.value.get(host_of(url), set()) if shared else set(batch.column(3)[k].as_py() or ())
                texts.append("\n\n".join(blocks(root, gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    return extracted(pages, written(templates(pages), "templates"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
