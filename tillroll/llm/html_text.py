"""Main text of pages by wrapper induction (operator 6).

1. Every page becomes a DOM tree; runs of like sibling leaves (paragraphs, list
   items) become one repeating node.
2. Pages of a host with the same layout (their tree of containers outside of
   articles, with runs of like siblings merged) are a group, all pages of the
   host another.  Each group has up to REFERENCES reference trees, those of the
   pages with the smallest hashes.  Simple tree matching aligns every page with
   each reference of its groups.  A text block of the reference that stands in the aligned
   node too counts as constant, any other block there as varying, with its
   characters; the counts cover all pages of the group.
3. Text blocks that are constant on nearly all pages are the template, those of
   a repeating node each by itself.  The deepest container of a reference that
   holds most of the varying characters is its content slot; a layout's template is its own and its host's.
4. A page is aligned with the references of its layout, or of its host if fewer
   than MIN_PAGES other pages have its layout.  Its text is what stands in the node
   that aligns with the slot of the best aligned one, without template blocks
   at its ends that are no sentences (``article_blocks``), and without elements that say what they are: menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles, reader comments.  Tags
   and roles say so, and whole class names or ids; names never drop what the
   slot or an article stands in.

``article``, ``main`` or ``body`` stand in for the slot, in this order, where
fewer than MIN_PAGES pages were compared, nothing below the body holds most of
the varying text, or a page has no node at the slot; the same blocks go there.
A slot of template blocks alone keeps them: its pages are copies there.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one space; nothing else is dropped.

Defined results: a null html is an empty one (text ``""``, 0 characters); a
null url belongs to the empty host; null page ids and repeated rows stay; an
empty table gives no rows; other columns are ignored.  Below DEPTH levels the
tree of step 1 is flattened; the text is taken from the whole page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.lookup import frequent_keys
from tillroll.session import materialize
from tillroll.sources.tables import read_table

REFERENCES = 3
DEPTH = 40
#: Aligned pages of a host from which on a constant node is template, and the
#: share of them on which it is the same.
MIN_PAGES, CONSTANT = 3, 0.9
#: Characters from which on a block is no menu entry or label.
LONG_TEXT = 80
#: Cells of an alignment table that is kept whole: 8 MB.
MAX_CELLS = 1 << 20
#: Share of the varying characters that the content slot holds.
SLOT_SHARE = 0.6

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style textarea title noscript iframe xmp".split()}
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 "
               "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements without text of the article.
DROPPED = set("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select "
              "style svg template textarea title".split())
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Whole class names and ids.
DROPPED_NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
                    "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice popup "
                    "promo related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
                    "widget ad-banner ad-container ad-slot ad-unit comment-list comment-section comments-area "
                    "cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav nav-bar newsletter-signup "
                    "related-articles related-posts share-buttons side-bar site-footer site-nav social-links "
                    "social-share".split())
#: Elements of running text and the headings among them.
PROSE = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("html body div section article main table tbody tr td center form".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
SENTENCE_END = re.compile(r"""(?: .* .* .*[.!?…]|[。！？])["'”’»)\]]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Page:
    """A parsed page: nodes in page order (tag, label, parent, whether its tag or
    role drops it, whether its names do) and its text pieces (node, text), None where a block ends."""

    def __init__(self, html: str) -> None:
        self.tags, self.labels, self.parents, self.depths = ["#"], ["#"], [-1], [0]
        self.says, self.named = [False], [False]
        self.pieces: list[tuple[int, str] | None] = []
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        label, dropped, named = tag, tag in DROPPED, False
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if name.lower() == "role":
                    dropped |= value.strip() in DROPPED_ROLES
                    continue
                named |= not DROPPED_NAMES.isdisjoint(value.split())
                if name.lower() == "class" and value.strip():
                    label = f"{tag}.{value.split()[0]}"
        # a page's header, not an article's
        dropped |= tag == "header" and not self._inside(parent, ("article", "main"))
        self.tags.append(tag)
        self.labels.append(label)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.says.append(dropped and tag not in ("html", "body"))
        self.named.append(named and tag not in ("html", "body"))
        return len(self.tags) - 1

    def _inside(self, node: int, tags: tuple[str, ...]) -> bool:
        while node > 0:
            if self.tags[node] in tags:
                return True
            node = self.parents[node]
        return False

    def block_tag(self, node: int) -> str:
        """The tag of the block that a node stands in."""
        while self.tags[node] in INLINE:
            node = self.parents[node]
        return self.tags[node]

    def dropped(self, slot: set[int]) -> list[bool]:
        """Whether each node is dropped, itself or by an ancestor.  Nothing
        drops the slot's nodes or what they stand in; names drop nothing that an
        article stands in (but articles in articles, and articles named as
        what is dropped, unless a page has no other)."""
        articles = [n for n, t in enumerate(self.tags) if t == "article"]
        articles = articles if len(articles) == 1 else [
            n for n in articles if not self.named[n] and not self._inside(self.parents[n], ("article",))]
        held, spared = self._above(slot), self._above(articles)
        out = [False]
        for n in range(1, len(self.tags)):
            own = n not in held and (self.says[n] or (self.named[n] and n not in spared))
            out.append(own or out[self.parents[n]])
        return out

    def _above(self, nodes) -> set[int]:
        """The nodes and their ancestors."""
        out: set[int] = set()
        for n in nodes:
            while n > 0 and n not in out:
                out.add(n)
                n = self.parents[n]
        return out

    def _parse(self, html: str) -> None:
        stack, pos, pieces = [0], 0, self.pieces
        tags = self.tags

        def close(names: set[str] | tuple[str, ...], until: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in names:
                    del stack[k:]
                    return
                if tags[stack[k]] in until:
                    return

        while True:
            m = TOKEN.search(html, pos)
            if m is None:
                break
            if m.start() > pos:
                pieces.append((stack[-1], html[pos:m.start()]))
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if tag in INLINE:
                if m[1] or m[4]:
                    close((tag,), CONTAINERS | CLOSES_P)
                elif ATTRIBUTE.search(attributes):
                    stack.append(self._open(tag, attributes, stack[-1]))
                continue
            if tag == "br":
                pieces.append((stack[-1], " "))
                continue
            pieces.append(None)
            if m[1] or m[4]:
                close((tag,), set())
                continue
            if tag in CLOSES_P:
                close(("p",), {"article", "main", "section", "div", "td", "th", "li", "body"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in ("html", "body") and tag in (tags[n] for n in stack):
                continue
            if tag == "body":
                close(("head",), set())
            node = self._open(tag, attributes, stack[-1])
            if tag in RAW:
                end = RAW[tag].search(html, pos)
                pos = end.end() if end else len(html)
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
        if pos < len(html):
            pieces.append((stack[-1], html[pos:]))

    def runs(self) -> Iterator[list[tuple[int, str]]]:
        """The pieces of each block."""
        run: list[tuple[int, str]] = []
        for piece in [*self.pieces, None]:
            if piece is not None:
                run.append(piece)
            elif run:
                yield run
                run = []


def squash(run: list[tuple[int, str]]) -> str:
    """The text of a block."""
    return " ".join(entities.unescape("".join(text for _, text in run)).split())


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


# ------------------------------------------------------------- alignment

class Tree:
    """A page's tree for alignment: labels and parents, with runs of like
    leaves merged; the node of each page node (``name``); and of each text block
    its node, hash and length."""

    def __init__(self, page: Page) -> None:
        skipped = [page.depths[n] > DEPTH or page.tags[n] in INLINE for n in range(len(page.tags))]
        block = [0]
        for n in range(1, len(page.tags)):
            block.append(block[page.parents[n]] if skipped[n] else n)
        has_child = {block[page.parents[n]] for n in range(1, len(page.tags)) if not skipped[n]}
        self.labels, self.parents, self.name = ["#"], [-1], [0]
        last: dict[int, tuple[int, str | None]] = {}
        for n in range(1, len(page.tags)):
            parent, leaf = self.name[page.parents[n]], n not in has_child
            if skipped[n]:
                self.name.append(parent)
                continue
            before = last.get(parent)
            if leaf and before is not None and before[1] == page.labels[n]:
                self.name.append(before[0])
                continue
            self.name.append(len(self.labels))
            last[parent] = (len(self.labels), page.labels[n] if leaf else None)
            self.labels.append(page.labels[n])
            self.parents.append(parent)
        self.owners, self.hashes, self.lengths = [], [], []
        for run in page.runs():
            text = squash(run)
            if text:
                self.owners.append(self.name[run[0][0]])
                self.hashes.append(text_hash(text))
                self.lengths.append(len(text))

    def layout(self) -> int:
        """A hash of the containers outside of articles, equal neighbours
        merged; 0 stands for all layouts of a host."""
        inner: list[list[int]] = [[] for _ in self.labels]
        for n in range(len(self.labels) - 1, -1, -1):
            tag = self.labels[n].partition(".")[0]
            if n and tag not in CONTAINERS:
                own = inner[n]  # containers below stand in the next one above
            else:
                below = [] if tag in ("article", "main") else inner[n]
                own = [text_hash(f"{self.labels[n]} {below}") | 1]
            if n == 0:
                return own[0]
            for x in reversed(own):  # children come last to first
                if inner[self.parents[n]][:1] != [x]:
                    inner[self.parents[n]].insert(0, x)
        return 0

    def shape(self) -> str:
        return " ".join(f"{p}:{label}" for p, label in zip(self.parents, self.labels, strict=True))

    def pack(self) -> dict:
        return {"layout": self.layout(), "shape": self.shape(), "owners": self.owners, "hashes": self.hashes, "lengths": self.lengths}


def _children(shape: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [], []
    for n, x in enumerate(shape.split(" ")):
        parent, _, label = x.partition(":")
        labels.append(label)
        children.append([])
        if n:
            children[int(parent)].append(n)
    return labels, children


def _row(above: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The next row of an alignment table: ``gain`` is what pairing with each
    column's node brings."""
    here = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gain), out=here[1:])
    return here


def pair_sequences(x: np.ndarray, y: np.ndarray, gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of positions of two sequences of codes, in the order of both,
    with the largest sum of ``gain[code, code]``.  Tables of more than
    MAX_CELLS cells are cut: only their middle and outer rows are computed."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > MAX_CELLS:
            middle = (i0 + i1) // 2
            head, tail = np.zeros(j1 - j0 + 1, np.int32), np.zeros(j1 - j0 + 1, np.int32)
            for i in range(i0, middle):
                head = _row(head, gain[x[i]].take(y[j0:j1]))
            for i in range(i1 - 1, middle - 1, -1):
                tail = _row(tail, gain[x[i]].take(y[j0:j1][::-1]))
            cut = j0 + int(np.argmax(head + tail[::-1]))
            todo += [(i0, middle, j0, cut), (middle, i1, cut, j1)]
            continue
        m = np.zeros((i1 - i0 + 1, j1 - j0 + 1), np.int32)
        for i in range(i1 - i0):
            m[i + 1] = _row(m[i], gain[x[i0 + i]].take(y[j0:j1]))
        i, j = i1 - i0, j1 - j0
        while i and j:
            if m[i, j] == m[i - 1, j]:
                i -= 1
            elif m[i, j] == m[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
    return sorted(out)


@lru_cache(maxsize=4096)
def align(shape_a: str, shape_b: str) -> tuple[tuple[int, int], ...]:
    """Simple tree matching: the largest set of node pairs with equal labels
    that keeps order and ancestry.  Equal subtrees have one number, so they are
    compared once, and those at the heads and tails of two sequences of children
    are paired without a search; what is left between takes memory in
    proportion to the longer sequence."""
    numbers: dict[tuple, int] = {}
    label: list[str] = []
    below: list[tuple[int, ...]] = []  # the numbers of the children
    nodes: list[int] = []

    def number(shape: str) -> tuple[list[int], list[list[int]]]:
        labels, children = _children(shape)
        own = [0] * len(labels)
        for n in range(len(labels) - 1, -1, -1):
            key = labels[n], tuple(own[c] for c in children[n])
            own[n] = numbers.setdefault(key, len(label))
            if own[n] == len(label):
                label.append(key[0])
                below.append(key[1])
                nodes.append(1 + sum(nodes[c] for c in key[1]))
        return own, children

    own_a, children_a = number(shape_a)
    own_b, children_b = number(shape_b)

    @lru_cache(maxsize=None)
    def size(s: int, t: int) -> int:
        if s == t:
            return nodes[s]
        return 1 + sum(size(below[s][i], below[t][j]) for i, j in pairs(s, t)) if label[s] == label[t] else 0

    @lru_cache(maxsize=None)
    def pairs(s: int, t: int) -> list[tuple[int, int]]:
        x, y = below[s], below[t]
        least = min(len(x), len(y))
        head = next((k for k in range(least) if x[k] != y[k]), least)
        tail = next((k for k in range(least - head) if x[-1 - k] != y[-1 - k]), least - head)
        out = [(k, k) for k in range(head)]
        i, j = len(x) - tail, len(y) - tail
        if head < i and head < j:
            codes_x, at_x = np.unique(x[head:i], return_inverse=True)
            codes_y, at_y = np.unique(y[head:j], return_inverse=True)
            gain = np.array([[size(p, q) for q in codes_y.tolist()] for p in codes_x.tolist()], np.int32)
            out += [(head + p, head + q) for p, q in pair_sequences(at_x, at_y, gain) if gain[at_x[p], at_y[q]]]
        return out + [(i + k, j + k) for k in range(tail)]

    out, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        todo += [(children_a[a][i], children_b[b][j]) for i, j in pairs(own_a[a], own_b[b])]
    return tuple(sorted(out))


def content_slot(shape: str, varies: list[int]) -> int:
    """The deepest container that holds SLOT_SHARE of the varying characters
    (``article`` and ``main`` are not entered), or -1 if that is no more than
    the page's body."""
    labels, children = _children(shape)
    mass = list(varies)
    for n in range(len(labels) - 1, -1, -1):
        mass[n] += sum(mass[c] for c in children[n])
    node = 0
    while labels[node].partition(".")[0] not in ("article", "main"):
        best = max((c for c in children[node] if labels[c].partition(".")[0] in CONTAINERS), key=lambda c: mass[c], default=None)
        if best is None or not mass[0] or mass[best] < SLOT_SHARE * mass[0]:
            break
        node = best
    return -1 if labels[node].partition(".")[0] in ("#", "html", "body") else node


def shape_paths(shape: str) -> list[str]:
    """The labels from the root to each node."""
    out: list[str] = []
    for n, x in enumerate(shape.split(" ")):
        parent, _, label = x.partition(":")
        out.append(out[int(parent)] + "/" + label if n else "")
    return out


def template_key(path: str, block: int) -> int:
    return text_hash(f"{path} {block}")


def template_blocks(shape: str, owners: list[int], hashes: list[int], aligned: list[int], same: list[int]) -> list[int]:
    """The keys of the constant blocks of a reference."""
    paths = shape_paths(shape)
    return [template_key(paths[n], h) for n, h, k in zip(owners, hashes, same, strict=True)
            if aligned[n] >= MIN_PAGES and k >= CONSTANT * aligned[n]]


# ------------------------------------------------------------ extraction

def slot_nodes(page: Page, tree: Tree, wrappers: list[dict], pages: int) -> list[int]:
    """The page's nodes at the slot of the wrapper that aligns best with it,
    of those (shape, slot, aligned, mass) that at least ``pages`` pages gave."""
    shape = tree.shape()
    tried = [(align(w["shape"], shape), w) for w in wrappers if w["slot"] >= 0 and w["aligned"] >= pages]
    for pairs, w in sorted(tried, key=lambda x: (-len(x[0]), -x[1]["mass"], x[1]["shape"])):
        at = dict(pairs).get(w["slot"])
        if at is None:
            continue
        nodes = {at}
        if tree.labels[at].partition(".")[0] == "article":  # a page of several articles
            nodes |= {n for n, p in enumerate(tree.parents) if p == tree.parents[at] and tree.labels[n] == tree.labels[at]}
        return [n for n, t in enumerate(tree.name) if t in nodes and page.labels[n] == tree.labels[t]]
    return []


def article_blocks(blocks: list[tuple[str, bool, str]], held: bool) -> list[str]:
    """The texts of ``blocks`` (text, whether it is constant, tag) that are the
    article's: those that vary and, of the constant ones, running text and
    headings between them; where a slot or an article holds the blocks also
    headings just before the first that varies, and sentences anywhere.  Constant
    blocks alone all stay: the page is a copy there."""
    varying = [k for k, (_, constant, _) in enumerate(blocks) if not constant]
    if not varying:
        return [text for text, *_ in blocks] if held else []
    first = varying[0]
    while held and first and blocks[first - 1][2] in HEADINGS:
        first -= 1
    return [text for k, (text, constant, tag) in enumerate(blocks)
            if not constant or (first <= k < varying[-1] and tag in PROSE)
            or (held and (len(text) >= LONG_TEXT or SENTENCE_END.search(text)))]


def main_text(html: str, wrappers: list[dict] | None = None, template: set[int] = frozenset()) -> str:
    """The text of one page, given its layout's wrappers."""
    page = Page(html)
    tree = Tree(page)
    chosen = set(slot_nodes(page, tree, wrappers or [], MIN_PAGES))
    dropped = page.dropped(chosen)
    chosen = chosen or {n for n, t in enumerate(page.tags) if t == "article" and not dropped[n]}
    chosen = chosen or {n for n, t in enumerate(page.tags) if t == "main" and not dropped[n]}
    if not chosen:  # the wrapper of few pages
        chosen = set(slot_nodes(page, tree, wrappers or [], 1))
        dropped = page.dropped(chosen)
    inside = [not chosen] * len(page.tags)
    for n in range(len(inside)):
        inside[n] |= n in chosen or (n > 0 and inside[page.parents[n]])
    kept = [i and not d for i, d in zip(inside, dropped, strict=True)]
    paths = shape_paths(tree.shape()) if template else []
    found = []
    for run in page.runs():
        own = [piece for piece in run if kept[piece[0]]]
        text = squash(own) if own else ""
        if text:
            whole = text if len(own) == len(run) else squash(run)
            tag = page.block_tag(run[0][0])
            found.append((text, bool(template) and template_key(paths[tree.name[run[0][0]]], text_hash(whole)) in template, tag))
    return " ".join(article_blocks(found, bool(chosen)))


TREE = "shape string, owners array<int>, hashes array<long>, lengths array<long>"
WRAPPER = "struct<shape:string,slot:int,aligned:long,mass:long>"


def _host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def trees(pages: DataFrame) -> DataFrame:
    """(host, h, layout, shape, owners, hashes, lengths) of ``pages(host, page_id,
    html)``."""
    schema = pa.schema([("host", pa.string()), ("h", pa.int64()), ("layout", pa.int64()), ("shape", pa.string()),
                        ("owners", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                html = x.as_py() or ""
                rows.append({"h": text_hash(html)} | Tree(Page(html)).pack())
            cols = [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=schema)

    return pages.mapInArrow(run, f"host string, h long, layout long, {TREE}")


class Dealt:
    """Joins on (host, layout) where a few groups may hold most rows: the rows
    of frequent groups are dealt out over as many numbers as there are shuffle
    partitions, and the other side has a copy for each.  At most MAX_HOT
    hashes of groups reach the driver."""

    def __init__(self, groups: DataFrame) -> None:
        self.parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        group = F.xxhash64("host", "layout")
        self.hot = group.isin([int(x) for x in frequent_keys(groups, {"group": group})["group"]])

    def rows(self, df: DataFrame, number: F.Column) -> DataFrame:
        return df.withColumn("deal", F.when(self.hot, F.pmod(number, F.lit(self.parts)).cast("int")).otherwise(0))

    def copies(self, df: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(self.parts - 1))
        return df.withColumn("deal", F.explode(F.when(self.hot, every).otherwise(F.array(F.lit(0)))))


class Votes:
    """What pages say about the places of a reference, its nodes and behind
    them its blocks: on how many pages a node is aligned or a block is the same,
    and the characters at a node that are none of its blocks."""

    def __init__(self, row: dict) -> None:
        self.ref, self.h, reference = row["ref"], row["ref_h"], row["reference"]
        self.shape, self.nodes = reference["shape"], reference["shape"].count(" ") + 1
        self.known: dict[int, dict[int, list[int]]] = {}
        for k, (n, x) in enumerate(zip(reference["owners"], reference["hashes"], strict=True), self.nodes):
            self.known.setdefault(n, {}).setdefault(x, []).append(k)
        self.n, self.varies = ([0] * (self.nodes + len(reference["hashes"])) for _ in range(2))

    def add(self, shape: str, at: dict[int, dict[int, int]]) -> None:
        """Count a page: its shape, and by node its blocks and their lengths."""
        n, varies = self.n, self.varies
        for a, b in align(self.shape, shape):
            n[a] += 1
            if b in at:
                here = self.known.get(a, {})
                for x, size in at[b].items():
                    if x in here:
                        for k in here[x]:
                            n[k] += 1
                    else:
                        varies[a] += size


def induce(pages: DataFrame) -> tuple[DataFrame, Dealt]:
    """(host, layout, wrappers, template) of each layout on a host that has
    other pages to compare, and how to join it with pages."""
    found = materialize(trees(pages), "trees")
    tree = F.struct("shape", "owners", "hashes", "lengths")
    slot = F.pmod(F.col("h"), F.lit(REFERENCES)).cast("int")
    # equal pages say nothing about each other: a text counts once per group
    members = found.dropDuplicates(["host", "h"]).withColumn("layout", F.explode(F.array(F.lit(0).cast("long"), "layout")))
    least = (found.select("host", "h", F.explode(F.array(F.lit(0).cast("long"), "layout")).alias("layout")).withColumn("ref", slot)
             .groupBy("host", "layout", "ref").agg(F.min("h").alias("h")))
    # the references of all groups of a host are at most three times its layouts
    refs = (found.drop("layout").join(least, ["host", "h"]).dropDuplicates(["host", "layout", "ref"])
            .select("host", "layout", "ref", F.col("h").alias("ref_h"), tree.alias("reference")))
    references = refs.groupBy("host", "layout").agg(F.collect_list(F.struct("ref", "ref_h", "reference")).alias("references"))
    hot = Dealt(found.select("host", F.explode(F.array(F.lit(0).cast("long"), "layout")).alias("layout")))
    pairs = (hot.rows(members, F.xxhash64("h")).join(hot.copies(references), ["host", "layout", "deal"])
             .select("host", "layout", "h", tree.alias("tree"), "references"))
    # a place is a node of the reference, or from its number of nodes on a block
    votes = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("ref", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("varies", pa.int64())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for i, (*group, h) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if tuple(group) not in sums:  # a group's references are read once a batch
                    sums[tuple(group)] = [Votes(x) for x in batch.column(4)[i].as_py()]
                tree = batch.column(3)[i].as_py()
                at: dict[int, dict[int, int]] = {}
                for n, x, size in zip(tree["owners"], tree["hashes"], tree["lengths"], strict=True):
                    blocks = at.setdefault(n, {})
                    blocks[x] = blocks.get(x, 0) + size
                for own in sums[tuple(group)]:
                    if own.h != h:
                        own.add(tree["shape"], at)
            rows = [(*group, own.ref, place, *x) for group, each in sums.items() for own in each
                    for place, x in enumerate(zip(own.n, own.varies, strict=True)) if any(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(votes)], schema=votes)

    counted = pairs.mapInArrow(vote, "host string, layout long, ref int, place int, n long, varies long").groupBy(
        "host", "layout", "ref", "place").agg(F.sum("n").alias("n"), F.sum("varies").alias("varies"))
    counts = (counted.groupBy("host", "layout", "ref").agg(F.collect_list(F.struct("place", "n", "varies")).alias("counts"))
              .join(refs, ["host", "layout", "ref"]).select("host", "layout", "counts", "reference"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers, templates = [], []
            for counts, reference in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shape, owners, hashes = (reference[x] for x in ("shape", "owners", "hashes"))
                nodes = shape.count(" ") + 1
                own = np.zeros((nodes + len(hashes), 2), np.int64)
                for x in counts:
                    own[x["place"]] = x["n"], x["varies"]
                aligned, varies, same = own[:nodes, 0].tolist(), own[:nodes, 1].tolist(), own[nodes:, 0].tolist()
                wrappers.append({"shape": shape, "slot": content_slot(shape, varies), "aligned": aligned[0], "mass": sum(varies)})
                templates.append(template_blocks(shape, owners, hashes, aligned, same))
            wrapper = pa.struct([("shape", pa.string()), ("slot", pa.int32()), ("aligned", pa.int64()), ("mass", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(wrappers, wrapper), pa.array(templates, pa.list_(pa.int64()))],
                names=["host", "layout", "wrapper", "template"])

    built = counts.mapInArrow(build, f"host string, layout long, wrapper {WRAPPER}, template array<long>")
    # at most REFERENCES rows a group
    groups = materialize(built.groupBy("host", "layout").agg(
        F.collect_list("wrapper").alias("wrappers"), F.flatten(F.collect_list("template")).alias("template")), "wrappers")
    whole = groups.filter("layout = 0").select("host", F.col("wrappers").alias("all"), F.col("template").alias("everywhere"))
    own = F.exists("wrappers", lambda w: w["aligned"] >= MIN_PAGES)
    built = (found.select("host", "layout").distinct().join(whole, "host").join(groups, ["host", "layout"], "left")
            .select("host", "layout", F.when(own, F.col("wrappers")).otherwise(F.col("all")).alias("wrappers"),
                    F.array_distinct(F.concat("everywhere", F.coalesce("template", F.array().cast("array<long>")))).alias("template")))
    return built, hot


def with_layout(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, host)`` with each page's layout and its
    number in its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            found = [Tree(Page(x.as_py() or "")).layout() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(found, pa.int64()), pa.array(range(n, n + len(found)), pa.int64())],
                names=["page_id", "url", "html", "host", "layout", "number"])
            n += len(found)

    return pages.mapInArrow(run, "page_id long, url string, html string, host string, layout long, number long")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    wrappers, hot = induce(rows.select("host", "page_id", "html"))
    # Spark broadcasts the wrappers if their measured size allows it
    joined = (hot.rows(with_layout(rows), F.col("number")).join(hot.copies(wrappers), ["host", "layout", "deal"], "left")
              .select("page_id", "url", "html", "host", "layout", "wrappers", "template"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}  # a group's wrappers are read once a batch
            found = []
            for i, group in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if group not in known:
                    known[group] = batch.column(5)[i].as_py(), set(batch.column(6)[i].as_py() or ())
                found.append(main_text(batch.column(2)[i].as_py() or "", *known[group]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema=schema)

    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.char_length("text").cast("long"))


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
