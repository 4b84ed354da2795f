"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a page of that host, the seed, by simple tree matching.
A seed node whose text is the same wherever it is aligned belongs to the template; nodes
whose text varies are slots. The slot that holds the article (an article or main element if
the wrapper has one, else the deepest node with most of the varying text) is found again in
every page by the same alignment, and its text blocks are the content. Inside an article
the same statistics decide, over different articles only: what recurs in them is template.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.llm.scratch import keep, map_text
from viewtide.llm.urlfilter import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot select div section article body".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea svg head "
                    "title dialog menu object canvas".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav "
                  "navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup "
                  "modal newsletter subscribe share sharing social related recommended comment comments disqus "
                  "replies widget pagination pager skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
_PIECES = re.compile(r"[^a-z0-9]+")
#: A class word with one of these before it tells what a container has, not what it is.
_STATE = re.compile(r"\b(?:has|have|with|without|no|not|show|hide)[-_]+[a-z0-9]+")
#: Of sibling lists with more pairs than this some rows of the table are held, and the others
#: computed again; the matching is the same.
CELLS = 1 << 16
#: Sizes of matchings held at a time; others are computed again.
SIZES = 1 << 18


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    noise: bool = False
    worded: bool = False  # noise by its class words alone
    main: bool = False
    children: list = field(default_factory=list)  # nodes and texts
    number: int = -1
    own: str | None = None  # own_text, once asked for
    shape: tuple[bytes, int] | None = None  # _shape, once asked for

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    """A forgiving tree: elements that may not nest close each other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root")
        self.open = [self.root]
        self.count: dict[str, int] = defaultdict(int)  # open elements by tag
        self.mains = 0  # open article elements

    def _close(self, tags, stop=SCOPES) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for node in self.open[i:]:
                    self.count[node.tag] -= 1
                    self.mains -= node.main
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag in CLOSES_P:
            self._close(("p",))
        if tag in SAME:
            self._close(SAME[tag], SCOPES - {"tr"} if tag == "tr" else SCOPES)
        names = f"{given.get('class', '')} {given.get('id', '')}".lower()
        node = Node(tag, f"{tag}.{names.strip()}")
        node.noise = tag in DROPPED or given.get("role", "") in ROLES or "hidden" in given or (
            tag == "header" and not self.mains)
        node.main = not node.noise and (tag in ("article", "main") or given.get("role") == "main"
                                        or given.get("itemprop", "").lower() == "articlebody")
        if names != " " and not node.noise and tag not in ("html", "body", "main") and given.get("role") != "main":
            pieces = set(_PIECES.split(_STATE.sub(" ", names)))
            node.worded = not NOISE.isdisjoint(pieces) or "header" in pieces and tag not in ("article", "h1", "h2", "h3")
            node.noise = node.worded
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1
            self.mains += node.main

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in VOID:
            return

    def handle_endtag(self, tag):
        self._close((tag,), frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _restore(builder.root)
    return builder.root


def _restore(root: Node) -> None:
    """Takes class words back where they would hide the content. Comments and teasers stay
    noise beside an article with text; without one, what holds or fills a main element comes
    back, and on a page without any text the worded node that has most of it."""
    while True:
        mains = _top_mains(root)
        hidden = _worded([root])
        if not hidden or any(map(_has_text, mains)):
            return
        back = _worded(mains) or [n for n in hidden if _holds_main(n)]
        if not back:
            if mains or _has_text(root):
                return
            longest = max(hidden, key=lambda n: sum(map(len, blocks(n))))
            back = [longest] if _has_text(longest) else hidden
        for node in back:
            node.noise = False


def _worded(roots: list[Node]) -> list[Node]:
    """The outermost nodes under the roots that are noise by class words alone."""
    found, todo = [], list(roots)
    while todo:
        for c in todo.pop().nodes():
            if c.noise and c.worded:
                found.append(c)
            elif not c.noise:
                todo.append(c)
    return found


def _holds_main(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.main:
            return True
        todo += [c for c in n.nodes() if c.worded or not c.noise]
    return False


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if not c.noise:
                    todo.append(c)
            elif c and not c.isspace():
                return True
    return False


def number(root: Node) -> list[Node]:
    """Nodes outside noise in page order, numbered by their place."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo += [c for c in reversed(node.nodes()) if not c.noise]
    return out


def own_text(node: Node) -> str:
    """Text of a node without its block children: one line."""
    if node.own is not None:
        return node.own
    parts: list[str] = []
    todo = [iter(node.children)]
    while todo:
        for c in todo[-1]:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif not c.noise and c.tag not in BLOCKS:
                todo.append(iter(c.children))
                break
        else:
            todo.pop()
    node.own = _line(parts)
    return node.own


def _line(parts: list[str]) -> str:
    """The parts as one line with single blanks."""
    return " ".join("".join(parts).split())


def _next(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The table's row after this one."""
    out = np.zeros_like(row)
    np.maximum(row[1:], row[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out, out=out)


def _lcs(n: int, m: int, row):
    """Pairs of the best order-preserving matching of two lists, as a step; ``row(i)``, a step
    too, gives the weights of one. All rows of the table are held or, of long lists, as many as
    the square root of their number, from which those between two of them are computed again."""
    apart = n if n * m <= CELLS else math.isqrt(n) + 1
    held, last, table = {0: np.zeros(m + 1, np.int64)}, 0, []
    for i in range(n):
        if i % apart == 0:
            last, table = i, [held[i]]
        table.append(_next(table[-1], (yield from row(i))))
        if (i + 1) % apart == 0:
            held[i + 1] = table[-1]
    pairs, i, j = [], n, m
    while i and j:
        if (i - 1) // apart * apart != last:
            last = (i - 1) // apart * apart
            table = [held[last]]
            for k in range(last, i):
                table.append(_next(table[-1], (yield from row(k))))
        while i > last and j:
            best = table[i - last][j]
            if best == table[i - last - 1][j]:
                i -= 1
            elif best == table[i - last][j - 1]:
                j -= 1
            else:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
    return pairs[::-1]


def _kept(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.noise]


def _shape(node: Node) -> tuple[bytes, int]:
    """Digest of the labels under a node, and how many nodes there are."""
    todo = [node]
    while node.shape is None:
        n = todo[-1]
        inner = _kept(n)
        if waiting := [c for c in inner if c.shape is None]:
            todo += waiting
            continue
        todo.pop()
        labels = b"%d:" % len(inner) + b"".join([c.shape[0] for c in inner]) + n.label.encode("utf-8", "surrogatepass")
        n.shape = hashlib.blake2b(labels, digest_size=16).digest(), 1 + sum([c.shape[1] for c in inner])
    return node.shape


def _known(x: Node, y: Node, sizes: dict) -> int | None:
    """The size of the best matching of two nodes, if it is at hand."""
    (a, n), (b, _) = _shape(x), _shape(y)
    return n if a == b else sizes.get((a, b))


def _rows(left: list[Node], right: list[Node], sizes: dict, scale: int, texts: bool):
    """The ``row`` of ``_lcs`` for two lists of siblings: the size of the best matching of two
    nodes times ``scale``, and with ``texts`` one more for leaves with equal texts."""
    same: dict[str, list[int]] = defaultdict(list)
    shaped: dict[str, dict] = defaultdict(dict)
    lines: dict[tuple[str, str], list[int]] = defaultdict(list)
    for j, y in enumerate(right):
        same[y.label].append(j)
        if y.nodes():
            shaped[y.label].setdefault(_shape(y)[0], (y, []))[1].append(j)
        elif texts and own_text(y):
            lines[y.label, own_text(y)].append(j)
    rows: dict = {}  # elements without a twin weigh the same

    def row(i):
        x = left[i]
        deep = bool(x.nodes())
        line = (x.label, own_text(x)) if texts and not deep else None
        key = _shape(x) if deep else (x.label, line if line in lines else None)
        if key not in rows:
            weights = np.zeros(len(right), np.int64)
            if x.label in same:
                weights[same[x.label]] = scale
            if deep:
                for y, at in shaped[x.label].values() if x.label in shaped else ():
                    weights[at] = (_known(x, y, sizes) or (yield _size(x, y, sizes))) * scale
            elif line in lines:
                weights[lines[line]] += 1
            if len(rows) > 64:
                rows.clear()
            rows[key] = weights
        return rows[key]

    return row


def _size(a: Node, b: Node, sizes: dict):
    """The greatest number of node pairs in a matching of two nodes with equal labels, as a
    step. It depends on their shapes alone."""
    left, right, size = _kept(a), _kept(b), 1
    if len(left) * len(right) > 256:
        row, last = _rows(left, right, sizes, 1, False), np.zeros(len(right) + 1, np.int64)
        for i in range(len(left)):
            last = _next(last, (yield from row(i)))
        size += int(last[-1])
    elif left and right:  # the same without arrays
        best, deep = [0] * (len(right) + 1), [bool(y.nodes()) for y in right]
        for x in left:
            corner, inner = 0, bool(x.nodes())
            for j, y in enumerate(right):
                n = corner
                if x.label == y.label:
                    n += 1 if not (inner and deep[j]) else _known(x, y, sizes) or (yield _size(x, y, sizes))
                corner, best[j + 1] = best[j + 1], max(best[j + 1], best[j], n)
        size += best[-1]
    if len(sizes) >= SIZES:
        sizes.clear()
    sizes[_shape(a)[0], _shape(b)[0]] = size
    return size


def _match(a: Node, b: Node, sizes: dict):
    """``tree_match`` of two nodes with equal labels, as a step that asks for those of their
    children: however deep the pages are, no call waits for another."""
    left, right = _kept(a), _kept(b)
    size, pairs = 1, [(a, b)]
    if not left or not right:
        return size, pairs
    if len(left) == len(right) and all(x.label == y.label for x, y in zip(left, right)) and len(
            {x.label for x in left}) == len(left):
        chosen = [(i, i) for i in range(len(left))]  # nothing else could match better
    else:
        # Leaves with equal texts at both ends have their best partner in each other.
        most, head, tail = min(len(left), len(right)), 0, 0
        alike = lambda x, y: x.label == y.label and not x.nodes() and not y.nodes() and own_text(x) and own_text(x) == own_text(y)
        while head < most and alike(left[head], right[head]):
            head += 1
        while tail < most - head and alike(left[-1 - tail], right[-1 - tail]):
            tail += 1
        xs, ys = left[head: len(left) - tail], right[head: len(right) - tail]
        # Of equally large matchings the one with more equal texts.
        inner = yield from _lcs(len(xs), len(ys), _rows(xs, ys, sizes, len(left) + 1, True))
        chosen = [*[(i, i) for i in range(head)], *[(i + head, j + head) for i, j in inner],
                  *[(len(left) - k, len(right) - k) for k in range(tail, 0, -1)]]
    for i, j in chosen:
        x, y = left[i], right[j]
        if x.nodes() and y.nodes():
            n, more = yield _match(x, y, sizes)
        else:
            n, more = 1, (x, y)
        size += n
        pairs.append(more)
    return size, pairs


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the greatest number of node pairs with equal labels that keep
    parents and order, and the pairs. Noise is left out on both sides."""
    if a.label != b.label:
        return 0, []
    steps, value = [_match(a, b, {})], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as done:
            steps.pop()
            value = done.value
    size, nested = value
    pairs, todo = [], [nested]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            pairs.append(x)
        else:
            todo += reversed(x)
    return size, pairs


def blocks(node: Node, constant=frozenset()) -> list[str]:
    """Text blocks under a node in page order, without noise and without the ``constant``
    nodes (by identity)."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = _line(parts)
        parts.clear()
        if text:
            out.append(text)

    todo = [(node, iter(node.children))]
    while todo:
        n, rest = todo[-1]
        for c in rest:
            if isinstance(c, str):
                if id(n) not in constant:
                    parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.noise:
                if c.tag in BLOCKS:
                    flush()
            else:
                if c.tag in BLOCKS:
                    flush()
                todo.append((c, iter(c.children)))
                break
        else:
            todo.pop()
            if n.tag in BLOCKS:
                flush()
    flush()
    return out


def _top_mains(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            found.append(node)
        else:
            todo += [c for c in reversed(node.nodes()) if not c.noise]
    return found


def inside_mains(root: Node) -> list[Node]:
    """Nodes outside noise in or under the page's article elements."""
    return [n for main in _top_mains(root) for n in _under(main)]


def _under(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.nodes() if not c.noise]
    return out


def content_slot(seed: Node, stats: dict[int, tuple], least_pages: int) -> tuple[int, list[int]]:
    """Number of the seed node that holds the content, and of its constant nodes. ``stats``:
    per node aligned pages, equal texts, varying characters, and for nodes of an article
    element the digests of different articles with an equal text there."""
    every = number(seed)
    inside = {n.number for n in inside_mains(seed)}
    constant = []
    for k, (seen, same, _, *articles) in stats.items():
        enough = len(set(articles[0] or ())) if k in inside and articles else 0 if k in inside else seen
        if enough >= least_pages and seen == same and own_text(every[k]):
            constant.append(k)
    mains = _top_mains(seed)
    if len(mains) == 1:
        return mains[0].number, constant
    varying: dict[int, int] = {}
    for node in reversed(every):  # children come after their parents
        varying[node.number] = stats.get(node.number, (0, 0, 0))[2] + sum([varying[c.number] for c in node.nodes() if not c.noise])
    whole, slot = varying[seed.number], seed
    while True:  # down to the deepest node that still holds most of what varies
        deeper = [c for c in slot.nodes() if not c.noise and c.tag in BLOCKS | {"#root"}
                  and varying[c.number] > 0.7 * whole]
        if not deeper or not deeper[0].nodes() or deeper[0].tag in ("p", "li", "td"):
            return slot.number, constant
        slot = deeper[0]


def extract(page: Node, seed: Node | None, slot: int, constant: list[int]) -> str:
    """The page's content: the counterpart of the wrapper's slot, else its own article
    elements, else all that is neither noise nor template."""
    mains = _top_mains(page)
    same: frozenset[int] = frozenset()
    target = None
    if seed is not None:
        _, pairs = tree_match(seed, page)
        wanted = set(constant)
        target = next((b for a, b in pairs if a.number == slot), None)
        same = frozenset(id(b) for a, b in pairs if a.number in wanted and own_text(a) == own_text(b))
    if target is not None and (target.main or not mains):
        roots = [target]
    else:
        roots = mains or [page]
    return "\n".join(t for r in roots for t in blocks(r, same))


def _article(inside: list[Node], pairs: list[tuple[Node, Node]]) -> int | None:
    """Digest of the text under a page's article elements; None if the nodes aligned with
    equal texts hold half of it or more, as in copies of the seed's article."""
    texts = {id(n): own_text(n) for n in inside}
    equal = sum(len(texts[id(b)]) for a, b in pairs if id(b) in texts and texts[id(b)] == own_text(a))
    if 2 * equal >= sum(map(len, texts.values())):
        return None
    line = "\n".join(t for t in texts.values() if t)
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _aligned(least_pages: int):
    """Per host and seed node: aligned pages, equal texts, varying characters, and the least
    ``least_pages`` digests of different articles with an equal text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, tuple[Node, set[int]]] = {}
        for batch in batches:
            sums: dict[tuple[str, int], list] = defaultdict(lambda: [0, 0, 0, set()])
            for host, html, seed_html in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "seed"))):
                if host not in seeds:
                    if len(seeds) > 256:
                        seeds.clear()
                    root = parse(seed_html)
                    number(root)
                    seeds[host] = root, {n.number for n in inside_mains(root)}
                if html == seed_html:
                    continue  # the seed and its copies say nothing about what varies
                seed, within = seeds[host]
                page = parse(html)
                pairs = tree_match(seed, page)[1]
                article = _article(inside_mains(page), pairs) if within else None
                for a, b in pairs:
                    if a.number in within and article is None:
                        continue  # a copy of the seed's article neither
                    x, y = own_text(a), own_text(b)
                    row = sums[host, a.number]
                    row[0] += 1
                    row[1] += x == y
                    row[2] += len(y) if x != y else 0
                    if x and x == y and a.number in within:
                        row[3].add(article)
                        if len(row[3]) > least_pages:
                            row[3].remove(max(row[3]))
            keys, rows = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                 *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                 pa.array([list(r[3]) for r in rows], pa.list_(pa.int64()))],
                names=["host", "node", "seen", "same", "varying", "articles"])
    return run


def _wrappers(least_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, constants = [], []
            for seed, stats in zip(batch.column("seed").to_pylist(), batch.column("stats").to_pylist()):
                known = {s["node"]: (s["seen"], s["same"], s["varying"], s["articles"]) for s in stats or ()}
                slot, constant = content_slot(parse(seed), known, least_pages)
                slots.append(slot)
                constants.append(constant)
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("seed"), pa.array(slots, pa.int64()),
                 pa.array(constants, pa.list_(pa.int64()))], names=["host", "seed", "slot", "constant"])
    return run


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None,
                 least_pages: int = 5, broadcast_mb: int = 64) -> DataFrame:
    """The ``carry`` columns of ``pages`` (all by default) plus ``text`` and ``n_chars``.

    Every page of a host takes part in its wrapper's statistics; only per-node sums of the
    seed's nodes meet at a host, so a host with a third of all pages costs one small row per
    node and task. Hosts, seeds and wrappers (one page per host) are broadcast if their measured
    size is below ``broadcast_mb``; beyond it they are joined by host, where Spark splits
    large hosts.

    Blocks are joined by one newline; white space inside a block becomes one blank; noise
    (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) goes.
    Null or empty html gives an empty text. Pages without a host form a group of their own.
    One row in, one row out. Columns of ``pages`` named like a result are replaced.
    """
    columns = [c for c in carry or pages.columns if c.lower() not in ("text", "n_chars")]
    held = [f"__c{k}" for k in range(len(columns))]  # so that no column of ``pages`` is taken for one of a wrapper
    rows = pages.select(*[F.col(c).alias(h) for c, h in zip(columns, held)], host_of(F.col(url)).alias("__host"), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    slim = rows.select(F.col("__host").alias("host"), F.col("__html").alias("html"))
    key = F.xxhash64("html")
    first = keep(slim.filter("html <> ''").groupBy(F.col("host").alias("h")).agg(F.min(key).alias("key")), "hosts")

    def near(df: DataFrame, column: str) -> DataFrame:
        size = df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0
        return F.broadcast(df) if size < broadcast_mb << 20 else df

    seeds = keep(slim.join(near(first, "h"), (F.col("host") == F.col("h")) & (key == F.col("key")))
                 .groupBy("host").agg(F.first("html").alias("seed")), "seeds")
    sums = map_text(slim.join(near(seeds, "seed"), "host").select("host", "html", "seed"), _aligned(least_pages),
                    "host string, node bigint, seen bigint, same bigint, varying bigint, articles array<bigint>")
    # A few digests from each batch, for nodes with an equal text only.
    stats = sums.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("seen", "same", "varying")], F.slice(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("articles")))), 1, least_pages).alias("articles"))
    # At most one entry for each node of one page.
    by_host = stats.groupBy("host").agg(F.collect_list(F.struct("node", "seen", "same", "varying", "articles")).alias("stats"))
    wrappers = keep(map_text(seeds.join(by_host, "host", "left"), _wrappers(least_pages),
                             "host string, seed string, slot bigint, constant array<bigint>"), "wrappers")
    joined = rows.join(near(wrappers, "seed"), F.col("__host") == F.col("host"), "left").select(
        *held, "__html", "host", "seed", "slot", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for host, page, seed, slot, constant in zip(*(batch.column(c).to_pylist() for c in (
                    "host", "__html", "seed", "slot", "constant"))):
                if seed is not None and host not in seen:
                    if len(seen) > 256:
                        seen.clear()
                    seen[host] = parse(seed)
                    number(seen[host])
                texts.append(extract(parse(page), seen.get(host), slot, constant or []) if page else "")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in held], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*held, "text", "n_chars"])

    schema = T.StructType([*rows.select(*held).schema.fields, T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return map_text(joined, run, schema).select(*[F.col(h).alias(c) for c, h in zip(columns, held)], "text", "n_chars")
