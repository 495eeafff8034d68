"""Main text of web pages by a site style tree.

Pages of one host are merged into a *style tree*. Its nodes are elements by tag, class and place (a hash of the parent's
name and the own label; words with digits count as one mark), and the text that stands directly in an element. A node
keeps in how many pages it occurs, the styles of its children there, the texts under it, and its mark.

* **Presentation importance** of a node in m pages is the entropy, to base m, of its pages over the styles of its children:
  a node that always looks the same is part of a template.
* **Content importance** is 1 minus the mean, over the texts under the node, of log(pages with the text) / log(m): texts
  that stand in many pages say nothing about one of them.
* The **entropy** of a node is ``DAMPED`` of the first plus the rest of the second; of a node in fewer than ``PAGES``
  pages it can't be told, and counts as one half.
* The **mark** is a feature from the markup: 1 in an element that HTML names main or article, or that holds one; -1 in
  one that HTML defines as other than content (navigation, footers, asides, forms, scripts) or whose class names such a
  thing; else 0; the mean over the node's pages.
* A node's **importance** is ``MARKED`` * (1 + mark) / 2 + (1 - ``MARKED``) * entropy.

A branch is removed from the host's pages if its importance is under ``FLOOR``, or under ``RATIO`` of that of its best
sibling, or if it has no mark of 1 and an entropy under ``LEAST`` while a sibling's is not. So the tree chooses the main
branch at each node on the way down: a marked article against what stands beside it
(and nothing inside it, as its parts are marked as well, though copies of a page repeat as a template does), and, among
branches without marks, those whose texts differ from page to page. Of what is left, block elements give one line each,
in page order, with character references decoded and white space joined.

Trees are sums over rows (host, node, style or text), added before the shuffle, so a host of any size is spread over all
tasks; no host's pages are gathered. Parsing keeps one page at a time; elements nested deeper than ``DEEP`` count to the
one at that depth, so memory grows with the page, whatever its nesting.

Defined cases: a null or empty page has an empty text; malformed or cut pages are read as far as they go, and open
elements end where the page does; a null url is a host of its own; repeated pages are each answered; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, written

DAMPED, PAGES = 0.1, 8
MARKED, FLOOR, RATIO, LEAST = 0.7, 0.33, 0.69, 0.3
#: Elements nested deeper count to the one at this depth.
DEEP = 64
#: Hosts with removed branches are broadcast up to so many rows (one for each such branch); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows that a worker adds up before it passes them on.
ADDED = 200_000

#: Fixed values, from the HTML standard: elements without an end tag, those of raw text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody
td tfoot th thead tr ul""".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"br", "html", "body", "option", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements and class words that aren't content.
ASIDE = frozenset("nav footer aside header form button select menu dialog head script style noscript template iframe object svg math".split())
ASIDE_WORDS = """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header masthead
menu nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar signup skip social sponsor sponsored
subscribe toolbar widget""".split()
ASIDE_CLASS = re.compile(rf"(?:^|[-_\s])(?:{'|'.join(ASIDE_WORDS)})(?:$|[-_\s])", re.I)
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
STYLE = re.compile(r"""\b(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NUMBERED = re.compile(r"\S*\d\S*")
HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)")
ENDINGS = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}


class Node:
    """An element: its name in the host's tree, the names of the path to it, and its marks."""

    __slots__ = ("tag", "name", "chain", "parent", "aside", "main", "holds")

    def __init__(self, tag: str, label: str, parent: Node | None, aside: bool):
        self.tag, self.parent, self.holds = tag, parent, False
        if parent is None:
            self.name, self.chain = 0, ()
        elif len(parent.chain) < DEEP:
            self.name = _key(f"{parent.name} {label}")
            self.chain = (*parent.chain, self.name)
        else:
            self.name, self.chain = parent.name, parent.chain
        self.aside = aside or bool(parent and parent.aside)
        self.main = not self.aside and (tag in MAIN or bool(parent and parent.main))
        if tag in MAIN and self.main:
            up = self
            while up is not None and not up.holds:
                up.holds, up = True, up.parent

    @property
    def mark(self) -> int:
        return -1 if self.aside else int(self.main or self.holds)


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parse(page: str) -> tuple[list[tuple[Node, str]], dict[int, Node], dict[int, list[str]]]:
    """Blocks of text with the node of the text, in page order; all nodes by name; and the labels of each node's children."""
    root = Node("#page", "", None, False)
    stack = [root]
    opened: dict[str, list[int]] = {}  # the places of open elements in the stack, by tag
    nodes: dict[int, Node] = {}
    styles: dict[int, list[str]] = {}
    blocks: list[tuple[Node, str]] = []
    parts: list[str] = []
    owner = root
    at, size = 0, len(page)

    def child(label: str, tag: str, above: Node, aside: bool) -> Node:
        styles.setdefault(above.name, []).append(label)
        node = Node(tag, label, above, aside)
        nodes.setdefault(node.name, node)
        return node

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((child("#text", "#text", owner, False), text))
            parts.clear()

    def pop(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag].pop()
        del stack[k:]

    while at < size:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            said = page[at:m.start() if m else size]
            if not parts:
                owner = stack[-1]
            parts.append(said)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        if m[1]:
            place = opened.get(tag)
            inside = max((opened[x][-1] for x in MAIN if opened.get(x)), default=0)
            # an end tag inside an article doesn't end the article
            if place and (place[-1] >= inside or tag in MAIN or tag in ("body", "html")):
                pop(place[-1])
            continue
        if tag in ENDS_P:
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag not in BLOCK and any(x.tag == "p" for x in stack[-4:])):
                pop(len(stack) - 1)
        if len(stack) > 1 and (tag == "li" and stack[-1].tag == "li" or tag in ("td", "th") and stack[-1].tag in ("td", "th")):
            pop(len(stack) - 1)
        above = stack[-1]
        label, aside = tag, tag in ASIDE
        if m[3] and "=" in m[3]:
            names = " ".join("".join(x) for x in CLASS.findall(m[3]))
            aside = aside or bool(names) and tag not in ("body", "html", "article", "main") and bool(ASIDE_CLASS.search(names))
            looks = " ".join("".join(x) for x in STYLE.findall(m[3]))
            label = f"{tag}.{NUMBERED.sub('#', looks)}" if looks else tag
        if aside and tag == "header" and above.main:
            aside = False  # the heading of an article
        if tag in VOID:
            styles.setdefault(above.name, []).append(label)
            continue
        node = child(label, tag, above, aside)
        if tag in RAW:
            at = ENDINGS[tag].search(page, at).end()
            continue
        if not m[0].endswith("/>"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
    close()
    return blocks, nodes, styles


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _counted(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a page adds to its host's tree: node, kind (0: its parent, 1: a style, 2: a text, 3: its mark) and value, each once."""
    blocks, nodes, styles = parse(page)
    names, kinds, values = [], [], []

    def add(kind: int, name, value) -> None:
        names.append(np.fromiter(name, np.int64))
        values.append(np.fromiter(value, np.int64))
        kinds.append(np.full(len(values[-1]), kind, np.int8))

    add(0, nodes, (n.parent.name if n.parent.name != n.name else n.parent.parent.name for n in nodes.values()))
    add(1, styles, (_key(" ".join(dict.fromkeys(labels))) for labels in styles.values()))
    add(3, nodes, (n.mark for n in nodes.values()))
    size = [len(n.chain) for n, _ in blocks]
    texts = np.repeat(np.array([_key(t) for _, t in blocks], np.int64), size)
    add(2, (x for n, _ in blocks for x in n.chain), texts)
    node, kind, value = (np.concatenate(x) for x in (names, kinds, values))
    order = np.lexsort((value, node, kind))
    node, kind, value = node[order], kind[order], value[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])
    return node[new], kind[new], value[new]


def _sums(pages: DataFrame) -> DataFrame:
    """host, node, kind, value (see ``_counted``) and the number of pages, added up within each task."""
    names = ["host", "node", "kind", "value", "n"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: Counter[tuple[str, int, int, int]] = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(added)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int8(), pa.int64()))]
                + [pa.array(list(added.values()), pa.int64())], names=names)
            added.clear()
            return out

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not page:
                    continue
                host, (node, kind, value) = host_of(url), _counted(page)
                for at in range(0, len(node), ADDED) if len(node) > ADDED else ():  # a page as large as that needs no adding up
                    part = slice(at, at + ADDED)
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(node[part])), *[pa.array(x[part]) for x in (node, kind, value)],
                                                      pa.array(np.ones(len(node[part]), np.int64))], names=names)
                if len(node) <= ADDED:
                    added.update(zip((host,) * len(node), node.tolist(), kind.tolist(), value.tolist()))
                if len(added) > ADDED:
                    yield rows()
        yield rows()

    return map_batches(pages.select("url", "html"), fn, "host string, node long, kind byte, value long, n long")


def importance(pages: DataFrame) -> DataFrame:
    """host, node, parent, pages, entropy, mark and importance of all nodes of all style trees."""
    sums = _sums(pages).groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    n, log_n = F.col("n"), F.col("n") * F.log(F.col("n").cast("double"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = sums.groupBy("host", "node").agg(
        of(0, n).alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("value"))).alias("parent"), of(1, n).alias("styled"),
        of(1, log_n).alias("styled_log"), of(2, n).alias("said"), of(2, log_n).alias("said_log"), of(3, n * F.col("value")).alias("marks"))
    nodes = nodes.where("parent is not null")  # the page itself has none
    base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    style = F.coalesce((F.log(F.col("styled").cast("double")) - F.col("styled_log") / F.col("styled")) / base, F.lit(0.0))
    content = F.coalesce(1 - F.col("said_log") / F.col("said") / base, F.lit(0.0))
    entropy = F.when(F.col("pages") < PAGES, 0.5).otherwise(DAMPED * style + (1 - DAMPED) * content)
    nodes = nodes.select("host", "node", "parent", "pages", entropy.alias("entropy"), (F.col("marks") / F.col("pages")).alias("mark"))
    return nodes.withColumn("importance", MARKED * (1 + F.col("mark")) / 2 + (1 - MARKED) * F.col("entropy"))


def removed(nodes: DataFrame) -> DataFrame:
    """host and node of the branches of too low an importance, but for those that stand in another one."""
    best = nodes.groupBy("host", "parent").agg(F.max("importance").alias("best"), F.max("entropy").alias("most"))
    same = (F.col("mark") <= 0) & (F.col("entropy") < LEAST) & (F.col("most") >= LEAST)
    low = nodes.join(best, ["host", "parent"]).where((F.col("importance") < FLOOR) | (F.col("importance") < RATIO * F.col("best")) | same)
    low = low.select("host", "node", "parent")
    return low.join(low.select("host", F.col("node").alias("parent")), ["host", "parent"], "left_anti").select("host", "node")


def main_text(page: str | None, low: set[int]) -> str:
    """A page's text without the branches in ``low``."""
    return "\n".join(t for n, t in parse(page)[0] if low.isdisjoint(n.chain)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    low = written(removed(written(importance(pages), "importance")), "low")
    by_host = low.groupBy(F.col("host").alias("low_host")).agg(F.collect_set("node").alias("low"))
    if low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(by_host, F.col("host") == F.col("low_host"), "left")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(page, set(low or ())) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            size = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), size], names=["page_id", "url", "text", "n_chars"])

    return map_batches(rows.select("page_id", "url", "html", "low"), fn, "page_id long, url string, text string, n_chars long")
