"""Main text of web pages by wrapper induction.

Pages of one host and layout are aligned with a reference page by simple tree matching over their
block-level DOM trees, so that nodes of different pages get common slots.  Over all distinct pages of the
layout, waste included, a text slot that stays the same is template; the smallest element that holds most
of the varying text is the content region.  Elements and names (menus, adverts, comments) veto what varies
inside of the region; they decide alone only where a layout has too few pages or no region stands out.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import CACHES, leave, stash

# Fixed values of HTML: elements by how they behave.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr label legend li main menu nav ol optgroup option p pre search section select summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends first.
ENDS = {
    **{t: ("p",) for t in BLOCKS - {"html", "head", "body", "option", "optgroup", "label", "button", "td", "th", "tr"}},
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "option": ("option",),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "body": ("head",),
}
#: Elements past which a start tag does not look for one to end.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
#: Elements that hold no main text; those of the second list only outside of the main element.
NOT_MAIN = frozenset("head nav footer aside form button select dialog search label".split())
NOT_MAIN_OUTSIDE = frozenset("header menu".split())
#: Words that, as a whole name in class, id or role or as its last part ('site-footer'), say the same of
#: the elements that may carry them; as a first part they do so before a word for a piece of a page
#: ('comment-list').  A name that begins with one of ``SAYS_OTHERWISE`` tells about something else.
NOT_MAIN_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertisements sponsor sponsored banner promo promotion cookie cookies consent notice gdpr popup modal"
    " overlay newsletter subscribe signup login comment comments disqus reply replies respond related recommended share sharing social breadcrumb breadcrumbs pagination pager masthead contentinfo"
    " complementary skip hidden toolbar widget widgets".split()
)
PIECES = frozenset(
    "area bar block bottom box button buttons card column container content form footer header heading icon icons inner item items left link links list nav outer panel row section slot text thread title"
    " top unit widget wrap wrapper right message".split()
)
SAYS_OTHERWISE = frozenset("has have is no not with without hide use js on".split())
CARRIERS = frozenset("div section ul ol dl p table center figure header details li fieldset hgroup".split())
MAIN = ("article", "main")

#: Share of a layout's distinct pages that makes the text of a slot template: more than this outside of the
#: main element, this at least inside of it.
OUTSIDE, INSIDE = 0.5, 0.9
#: Distinct pages from which on a layout is induced; fewer show no difference between template and content.
LEAST_PAGES = 3
#: Share of a layout's varying text that the content region holds.
REGION = 0.8
HEADINGS = ("h1", "h2", "h3")
MAX_DEPTH = 100
#: Cells of a matching's table that are held at once; longer child lists are halved, with the same result.
TABLE_CELLS = 1 << 20
#: Shapes, and pairs of shapes with their weight, that a worker keeps for one host.
MAX_SHAPES = 200_000
MAX_WEIGHTS = 1_000_000
#: Children of two elements, together, up to which their matching is kept, and matchings kept for one host.
SHORT_LIST = 50
MAX_PAIRINGS = 500
#: Characters of attributes up to which what they say is kept.
SHORT_ATTRIBUTES = 200
#: Reference pages up to this many bytes in all are broadcast; beyond, they are joined.
BROADCAST_BYTES = 64 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """A block element, or a run of text (``tag`` '#')."""

    __slots__ = ("tag", "children", "text", "main", "waste", "named", "shape", "slot")

    def __init__(self, tag: str, main: bool, waste: bool, text: str = "", named: bool = False):
        self.tag, self.main, self.waste, self.text = tag, main, waste, text
        #: Whether a name in class, id or role says that the node or one around it holds no main text.
        self.named = named
        self.children: list[Node] = []
        self.shape = 0
        self.slot = -1


def _names_waste(value: str) -> bool:
    for name in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if parts and parts[0] not in SAYS_OTHERWISE and (parts[-1] in NOT_MAIN_WORDS or parts[0] in NOT_MAIN_WORDS and all(p in PIECES or p.isdigit() for p in parts[1:])):
            return True
    return False


@functools.lru_cache(maxsize=4096)
def _judge(name: str, attrs: str, main: bool) -> tuple[bool, bool]:
    """(no main text by element or because it is hidden, no main text by a name it carries)."""
    if name in NOT_MAIN or name in NOT_MAIN_OUTSIDE and not main:
        return True, False
    if not attrs or name in ("html", "body"):
        return False, False
    named = False
    for key, a, b, c in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key in ("class", "id", "role") and name in CARRIERS and _names_waste(value):
            named = True
    return False, named


def parse(page: str) -> Node:
    """The block-level tree of a page; broken markup gives the nearest tree, never an error."""
    root = Node("#root", False, False)
    stack = [root]
    run: list[str] = []

    def flush() -> None:
        text = "".join(run)
        run.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            top = stack[-1]
            top.children.append(Node("#", top.main, top.waste, text, top.named))

    at = 0
    for found in _TOKEN.finditer(page):
        start, after = found.span()
        if start > at:
            run.append(page[at:start])
        at = after
        end, name, attrs, end2, name2, attrs2 = found.group("end", "name", "attrs", "end2", "name2", "attrs2")
        name = name or name2
        if name is None:
            if page.startswith("<![CDATA[", start):
                run.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "br":
                run.append(" ")
            continue
        if run:
            flush()
        if end or end2:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        ends, scope = ENDS.get(name, ()), SCOPES.get(name, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in ends:
                del stack[i:]
                if not scope:
                    break
            elif not scope:
                break
        top = stack[-1]
        attrs = attrs or attrs2 or ""
        waste, named = (_judge if len(attrs) <= SHORT_ATTRIBUTES else _judge.__wrapped__)(name, attrs, top.main)
        # A name around the main element tells of the page, not of the main element.
        node = Node(name, top.main or name in MAIN, top.waste or waste, "", named or top.named and name not in MAIN)
        top.children.append(node)
        if name not in VOID:
            stack.append(node)
    run.append(page[at:])
    flush()
    return root


class Shapes:
    """Numbers for tree shapes: tags and the shapes of the children, without text."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        #: Matchings of short child lists, which pages of one layout share.
        self.pairings: dict[tuple[tuple, tuple], list[tuple[int, int]]] = {}

    def number(self, key: tuple) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.parts)
            self.parts.append(key)
            self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
        return found

    def assign(self, root: Node) -> None:
        """Shapes for a tree, deepest nodes first; below ``MAX_DEPTH`` a node counts as a leaf."""
        order: list[Node] = []
        pending = [(root, 0)]
        while pending:
            node, depth = pending.pop()
            order.append(node)
            if depth == MAX_DEPTH:
                node.children = list(_texts(node)) if node.tag != "#" else []
                for child in node.children:
                    child.shape = self.number(("#",))
            else:
                pending += [(child, depth + 1) for child in node.children]
        for node in reversed(order):
            node.shape = self.number((node.tag, *(c.shape for c in node.children)))

    def weight(self, a: int, b: int) -> int:
        """Simple tree matching: the most node pairs of two shapes, roots and order kept."""
        if a == b:
            return self.sizes[a]
        x, y = self.parts[a], self.parts[b]
        if x[0] != y[0]:
            return 0
        key = (a, b)
        found = self.weights.get(key)
        if found is None:
            low, high_x, high_y = _trim(x[1:], y[1:])
            same = sum(self.sizes[k] for k in (*x[1 : 1 + low], *x[1 + high_x :]))
            left, right = x[1 + low : 1 + high_x], y[1 + low : 1 + high_y]
            found = self.weights[key] = 1 + same + (int(self._last_row(left, right)[-1]) if left and right else 0)
        return found

    def _rows(self, x: tuple, y: tuple) -> Iterator[np.ndarray]:
        """Rows of the table whose cell [i][j] is the best matching of the first i and first j children."""
        numbers = {q: k for k, q in enumerate(dict.fromkeys(y))}
        kinds, which = list(numbers), np.array([numbers[q] for q in y], np.int64)
        weights: dict[int, np.ndarray] = {}
        above = np.zeros(len(y) + 1, np.int64)
        for p in x:
            if p not in weights:
                weights[p] = np.array([self.weight(p, q) for q in kinds], np.int64)
            row = above.copy()
            np.maximum(row[1:], above[:-1] + weights[p][which], out=row[1:])
            above = np.maximum.accumulate(row)
            yield above

    def _last_row(self, x: tuple, y: tuple) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for row in self._rows(x, y):
            pass
        return row

    def _pairs(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        """Positions of a best matching, ascending.  Of a long list the first half is matched with the
        part of the other list that suits both halves best, so that a few rows are held at a time."""
        found, pending = [], [(0, len(x), 0, len(y))]
        while pending:
            a, b, c, d = pending.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) > TABLE_CELLS and b - a > 1:
                middle = (a + b) // 2
                before = self._last_row(x[a:middle], y[c:d])
                after = self._last_row(x[middle:b][::-1], y[c:d][::-1])[::-1]
                cut = c + int((before + after).argmax())
                pending += [(a, middle, c, cut), (middle, b, cut, d)]
                continue
            table = [np.zeros(d - c + 1, np.int64), *self._rows(x[a:b], y[c:d])]
            i, j = b - a, d - c
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((a + i, c + j))
        return sorted(found)

    def align(self, page: Node, reference: Node) -> None:
        """Gives the page's nodes the slots of the reference's that they match."""
        pending = [(page, reference)]
        while pending:
            a, b = pending.pop()
            a.slot = b.slot
            if a.tag == "#":
                continue
            x, y = a.children, b.children
            low, high_x, high_y = _trim([c.shape for c in x], [c.shape for c in y])
            pending += zip(x[:low], y[:low])
            pending += zip(x[high_x:], y[high_y:])
            if low < high_x and low < high_y:
                key = tuple([c.shape for c in x[low:high_x]]), tuple([c.shape for c in y[low:high_y]])
                inner = self.pairings.get(key)
                if inner is None:
                    inner = self._pairs(*key)
                    if high_x - low + high_y - low <= SHORT_LIST and len(self.pairings) < MAX_PAIRINGS:
                        self.pairings[key] = inner
                pending += [(x[low + i], y[low + j]) for i, j in inner]


def _trim(x, y) -> tuple[int, int, int]:
    """Bounds of what is left after equal children at both ends, whose pairing is always best."""
    low = 0
    most = min(len(x), len(y))
    while low < most and x[low] == y[low]:
        low += 1
    i, j = len(x), len(y)
    while i > low and j > low and x[i - 1] == y[j - 1]:
        i, j = i - 1, j - 1
    return low, i, j


def _texts(root: Node) -> Iterator[Node]:
    """Text nodes in page order."""
    pending = [root]
    while pending:
        node = pending.pop()
        if node.tag == "#":
            yield node
        else:
            pending += reversed(node.children)


def _print(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class LayoutWrapper:
    """The reference page of a layout, its nodes numbered in page order (slots), the root 0."""

    def __init__(self, page: str):
        self.shapes = Shapes()
        self.tree = parse(page)
        self.shapes.assign(self.tree)
        self.nodes: list[Node] = []
        self.parents: list[int] = []
        pending = [(self.tree, -1)]
        while pending:
            node, parent = pending.pop()
            node.slot = len(self.nodes)
            self.nodes.append(node)
            self.parents.append(parent)
            pending += [(child, node.slot) for child in reversed(node.children)]

    def read(self, page: str) -> Node:
        """The tree of a page, with its slots."""
        if len(self.shapes.parts) > MAX_SHAPES or len(self.shapes.weights) > MAX_WEIGHTS:
            self.shapes = Shapes()
            self.shapes.assign(self.tree)
        tree = parse(page)
        self.shapes.assign(tree)
        self.shapes.align(tree, self.tree)
        return tree

    def region(self, varying: dict[int, int]) -> int:
        """The content region: the smallest element with ``REGION`` of the varying characters, which are
        given by text slot, or by -1 - slot for what stands unmatched in an element.  Inside of a main
        element it is that; what an element or a name calls waste is left for what is around it.  0: none."""
        mass = [0] * len(self.nodes)
        for slot, chars in varying.items():
            mass[slot if slot >= 0 else -1 - slot] += chars
        for slot in range(len(mass) - 1, 0, -1):  # children follow their parents
            mass[self.parents[slot]] += mass[slot]
        least = REGION * mass[0]
        # A share above a half is on one path only, whose last element has the largest number.
        at = max((k for k, node in enumerate(self.nodes) if node.tag != "#" and mass[k] >= least), default=0) if mass[0] else 0
        while at and (self.nodes[at].waste or self.nodes[at].named or self.nodes[self.parents[at]].main or self.nodes[at].tag in ("html", "body", "p", *HEADINGS)):
            at = self.parents[at]
        return at

    def path(self, slot: int) -> set[int]:
        """The slots from the root to ``slot``."""
        found = set()
        while slot >= 0:
            found.add(slot)
            slot = self.parents[slot]
        return found


@functools.lru_cache(maxsize=64)
def _wrapper(reference: str) -> LayoutWrapper:
    return LayoutWrapper(reference)


CACHES += [_wrapper.cache_clear, _judge.cache_clear]


def slots_of(tree: Node) -> Iterator[tuple[int, Node]]:
    """(slot, text node) in page order; a text that matches none has -1 - slot of the closest matched element."""
    pending = [(tree, 0)]
    while pending:
        node, owner = pending.pop()
        if node.tag == "#":
            yield (node.slot if node.slot >= 0 else -1 - owner), node
        else:
            owner = node.slot if node.slot >= 0 else owner
            pending += [(child, owner) for child in reversed(node.children)]


def region_texts(tree: Node, path: set[int], region: int) -> list[Node] | None:
    """Text nodes of the page's content region with the headings beside the way to it; None where the page has no such region."""
    before, after, node = [], [], tree
    while node.slot != region:
        at = next((k for k, child in enumerate(node.children) if child.tag != "#" and child.slot in path), None)
        if at is None:
            return None
        if not node.children[at].main:
            before += [t for child in node.children[:at] if child.tag in HEADINGS for t in _texts(child)]
            after[:0] = [t for child in node.children[at + 1 :] if child.tag in HEADINGS for t in _texts(child)]
        node = node.children[at]
    return [*before, *_texts(node), *after]


def main_text(tree: Node, template: dict[int, int], path: set[int] = frozenset(), region: int = 0) -> str:
    """Content joined by blank lines: what varies in the content region if the layout has one and the page's
    holds text, else of the main element if the page has one, else of the page.

    What varies is content unless its element or a name says otherwise; where names would leave nothing,
    they are not believed."""
    varying = [n for n in _texts(tree) if not n.waste and (n.slot not in template or template[n.slot] != _print(n.text))]
    within = region_texts(tree, path, region) if region else None
    ids = set(map(id, within or ()))
    chosen = [n for n in varying if id(n) in ids] or [n for n in varying if n.main] or varying
    return "\n\n".join(n.text for n in [n for n in chosen if not n.named] or chosen)


#: Elements that lay out a page.
_FRAMES = "body|div|section|nav|article|main|header|footer|aside|form|table"


def _layout(page):
    """A number for the frames directly inside of the body, neighbours of one kind counted once; of a lone
    frame, those inside of it.  Text and what the frames hold do not matter."""
    tags = F.regexp_extract_all(F.lower(page), F.lit(rf"<(/?(?:{_FRAMES}))\b"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("outer"), F.lit("").alias("inner"))

    def step(state, tag):
        ends = tag.startswith("/")
        depth = F.when(tag == "body", 0).when(tag == "/body", state["depth"]).when(ends, F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"] + 1)

        def add(text, level):
            new = ~ends & (tag != "body") & (depth == level) & ~text.endswith(F.concat(tag, F.lit(" ")))
            return F.when(new, F.concat(text, tag, F.lit(" "))).otherwise(text)

        return F.struct(depth.alias("depth"), add(state["outer"], 1).alias("outer"), add(state["inner"], 2).alias("inner"))

    found = F.aggregate(tags, start, step, lambda s: F.when(F.regexp_count(s["outer"], F.lit(" ")) == 1, F.concat(s["outer"], F.lit("/ "), s["inner"])).otherwise(s["outer"]))
    return F.xxhash64(found)


def _host(url: str):
    return F.lower(F.regexp_extract(F.col(url).cast("string"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _beside(pages: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """``pages`` with the columns of ``small`` for its host and layout: broadcast while its measured size allows."""
    return pages.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, ["host", "layout"], "left")


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``df``.

    A null page counts as empty and has empty text.  Pages without a host share no template.  Repeated
    rows give repeated results, and equal pages of a host count once for its template.  An empty table
    gives no rows; other columns are ignored, whatever their names.  Very long, wide and deep pages are
    read whole (below ``MAX_DEPTH`` a page is a list of texts).
    """
    html_text = F.coalesce(F.col(page).cast("string"), F.lit(""))
    named = df.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), html_text.alias("html"), _host(url).alias("host"), _layout(html_text).alias("layout"))
    hosted = named.where("host <> '' and html <> ''")
    # One page of each layout, the one with the smallest hash.
    references = hosted.groupBy("host", "layout").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("reference"))
    references = stash(references, "references")
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0

    @leave("wrapper")
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, layout, body, reference in zip(*(batch.column(k).to_pylist() for k in range(4))):
                marks, nodes = map(list, zip(*pairs)) if (pairs := list(slots_of(_wrapper(reference).read(body)))) else ([], [])
                prints = [_print(n.text) for n in nodes]
                whole = hashlib.blake2b(np.array([marks, prints], "<i8").tobytes(), digest_size=8).digest()
                # What is unmatched is only measured.
                kept = [p if slot >= 0 else 0 for slot, p in zip(marks, prints)]
                out.append((host, layout, int.from_bytes(whole, "little", signed=True), marks, kept, [n.main for n in nodes], [len(n.text) for n in nodes]))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "layout", "whole", "slots", "prints", "mains", "chars"])

    seen = _beside(hosted, references, size).select("host", "layout", "html", "reference")
    seen = seen.mapInArrow(slots, "host string, layout long, whole long, slots array<int>, prints array<long>, mains array<boolean>, chars array<long>")
    # Equal pages count once: the first of each layout and print.
    seen = stash(seen.groupBy("host", "layout", "whole").agg(*(F.first(c).alias(c) for c in ("slots", "prints", "mains", "chars"))), "slots")
    totals = seen.groupBy("host", "layout").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    # Counts shrink by text, then by slot, so that of a hot host no more rows come together than its reference has
    # slots.  One text at most stands on more than half of the pages.
    counted = (
        seen.select("host", "layout", F.explode(F.arrays_zip("slots", "prints", "mains", "chars")).alias("x"))
        .groupBy("host", "layout", F.col("x.slots").alias("slot"), F.col("x.prints").alias("print"))
        .agg(F.count("*").alias("n"), F.max("x.mains").alias("main"), F.sum("x.chars").alias("chars"))
        .groupBy("host", "layout", "slot")
        .agg(F.max(F.struct("n", "print", "main", "chars")).alias("most"), F.sum("chars").alias("chars"))
        .join(totals, ["host", "layout"])
    )
    often = F.when(F.col("most.main"), F.col("most.n") >= INSIDE * F.col("pages")).otherwise(F.col("most.n") > OUTSIDE * F.col("pages"))
    often = often & (F.col("slot") >= 0) & (F.col("most.n") >= LEAST_PAGES)
    induced = counted.groupBy("host", "layout").agg(
        F.collect_list(F.when(often, F.struct("slot", F.col("most.print").alias("print")))).alias("template"),
        F.collect_list(F.struct("slot", (F.col("chars") - F.when(often, F.col("most.chars")).otherwise(0)).alias("chars"))).alias("varying"),
    )

    @leave("wrapper")
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _wrapper(reference).region({v["slot"]: v["chars"] for v in varying if v["chars"]})
                for reference, varying in zip(batch.column("reference").to_pylist(), batch.column("varying").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "layout", "reference", "template")), pa.array(found, pa.int32())], ["host", "layout", "reference", "template", "region"])

    wrappers = references.join(induced, ["host", "layout"]).mapInArrow(regions, "host string, layout long, reference string, template array<struct<slot:int,print:long>>, region int")
    wrappers = stash(wrappers, "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("reference") + 16 * F.size("template"))).first()[0] or 0

    @leave("wrapper")
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, reference, constant, region in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if reference is None:
                    out.append(main_text(parse(body), {}))
                    continue
                layout = _wrapper(reference)
                out.append(main_text(layout.read(body), {c["slot"]: c["print"] for c in constant}, layout.path(region), region))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    beside = _beside(named, wrappers, size).select("page_id", "url", "html", "reference", "template", "region")
    return beside.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
