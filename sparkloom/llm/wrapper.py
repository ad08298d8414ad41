"""Main text of HTML pages by wrapper induction.

Pages of one host that are built from the same containers are one layout; pages of layouts that a
host has fewer than ``LEAST_PAGES`` of are pooled with pages of other hosts built alike. One page of
each layout is its pivot. Every page is aligned with its pivot by simple tree matching over block
elements, which gives each block a slot: the pivot's node that it matches, or else its key below
the nearest node that matches. Slots are counted over all pages of the layout, equal pages once.

Slots whose text is the same on most pages are template. The main region is found from the pivot's
root downwards: as long as one child holds most of the different text that all pages have in a node
(each different text counts once, so constant menus weigh nothing and long articles much), the rest
of the node is left out. A heading that varies before that child, and what stands between both,
stay. Within the region, siblings of one key are template only if all of them are constant.

Names of elements and classes are a last resort only: where a layout has too few pages to compare,
``article`` and ``main`` name the region, and within a region, blocks that name themselves menu,
form, comments and the like are left out, since they vary as the article does.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: Pages that must be compared before a text can be template.
LEAST_PAGES = 3
#: Share of the pages with a slot from which its most frequent text is template.
SHARE = 0.5
#: Share of a node's text that its main child holds, and of that child's key that may stand beside it.
DOMINANT, BESIDE = 0.5, 0.1
#: Share of a region's text that must be left for constant texts to be template.
LEAST_TEXT = 0.02
#: Children of one key that a pivot keeps below one node; further ones have the slot of their key.
FOLD = 4
#: Pairs of children up to which they are matched by the full table.
WIDE = 1 << 18
#: Counts that a task holds before it hands them on.
HELD = 50_000
#: Bytes of wrappers up to which they are sent to all executors; more are joined.
BROADCAST_BYTES = 32_000_000
#: Elements nested deeper become siblings, as in browsers.
DEPTH = 256
#: Shapes and their matches that a task keeps at once.
MEMO = 200_000

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg xmp noembed".split())
CONTROLS = frozenset("button select datalist audio video canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: The last resort: elements and names of what is beside an article, and of the article.
ASIDE_TAGS = frozenset("nav footer aside form dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_NAMES = frozenset("article main content post entry story".split())

_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|>|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Numbers in names that differ by page.
_DIGITS = re.compile(r"\d{3,}")
_CONTAINERS = r"<(?:div|section|article|main|aside|nav|header|footer|form)\b[^>]*>"


class Node:
    """A block element: its texts and blocks in page order."""

    __slots__ = ("aside", "buffer", "chars", "digest", "items", "key", "kids", "leads", "shape", "size", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.key = tag, tag
        self.items: list[str | Node] = []
        self.kids: list[Node] = []
        self.buffer: list[str] = []
        self.aside, self.leads = tag in ASIDE_TAGS, tag if tag in ("article", "main") else ""
        if attributes and (found := [(a.lower(), (b or c or d).lower()) for a, b, c, d in _NAMES.findall(attributes)]):
            names = [{*_SPLIT.split(name)} - {""} for _, value in found for name in value.split()]
            lead = any(n & MAIN_NAMES for n in names)
            self.aside = self.aside or not lead and any(n & ASIDE_NAMES for n in names)
            self.leads = self.leads or next((name for _, value in found for name in value.split() if name in ("article", "main")), "")
            self.key += "".join(f"{'#' if a == 'id' else '.'}{_DIGITS.sub('0', v)}" for a, v in sorted(found) if a != "role")

    def flush(self) -> None:
        """The text so far is one run, its white space single spaces."""
        if self.buffer:
            if value := " ".join("".join(self.buffer).split()):
                self.items.append(value)
            self.buffer.clear()


def parse(text: str) -> Node:
    """Tree of a page's blocks. Tags that HTML lets one omit are implied, what is left open ends with
    the page. Controls and hidden elements are left out; other inline elements only have their text."""
    root = Node("html")
    stack, opened = [root], Counter()

    def close(tags: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for node in stack[i:]:
                    node.flush()
                    opened[node.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    at, end = 0, len(text)
    while at < end:
        found = _TAGS.search(text, at)
        start = found.start() if found else end
        if start > at:
            raw = text[at:start]
            stack[-1].buffer.append(entities.unescape(raw) if "&" in raw else raw)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if found[1]:
            if opened[name] > 0:
                close({name}, set())
            continue
        attributes = found[3]
        if name == "br":
            stack[-1].buffer.append(" ")
        elif name in RAW:
            found = _RAW_END[name].search(text, at)
            at = (text.find(">", found.end()) + 1 or end) if found else end
        elif name in BLOCKS:
            if name in CLOSES_P and opened["p"] > 0:
                close({"p"}, {"table", "td", "th", "button"})
            if name in SIBLINGS:
                close(SIBLINGS[name], SCOPES[name])
            hidden = _HIDDEN.search(attributes) if len(attributes) > 1 else None
            node = Node(name, attributes)
            stack[-1].flush()
            if not hidden:
                stack[-1].items.append(node)
                stack[-1].kids.append(node)
            if name not in VOID and len(stack) < DEPTH and not attributes.endswith("/>"):
                stack.append(node)
                opened[name] += 1
        elif name not in VOID and (name in CONTROLS or len(attributes) > 1 and _HIDDEN.search(attributes)) and len(stack) < DEPTH and not attributes.endswith("/>"):
            # its text goes to a node outside the tree
            stack.append(Node(name))
            opened[name] += 1
    for node in stack:
        node.flush()
    return root


class Matcher:
    """Simple tree matching with shapes interned, so that equal pairs of shapes are matched once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.memo: dict[tuple[int, int], int] = {}

    @property
    def held(self) -> int:
        return len(self.memo) + len(self.parts)

    def intern(self, node: Node) -> None:
        """Give every node its shape, size, characters and a digest of its text."""
        digest, chars = xxhash.xxh3_64(), 0
        for item in node.items:
            if isinstance(item, str):
                digest.update(item.encode("utf-8", "surrogatepass"))
                chars += len(item)
            else:
                self.intern(item)
                digest.update(item.digest.to_bytes(8, "little"))
                chars += item.chars
        own = (node.key, *(c.shape for c in node.kids))
        if own not in self.shapes:
            self.shapes[own] = len(self.parts)
            self.parts.append(own)
        node.shape, node.digest, node.chars = self.shapes[own], digest.intdigest(), chars
        node.size = 1 + sum(c.size for c in node.kids)

    def weight(self, a: int, b: int) -> int:
        """Nodes in the largest match of two shapes with their roots matched; 0 if these differ."""
        known = self.memo.get((a, b))
        if known is None:
            left, right = self.parts[a], self.parts[b]
            if left[0] != right[0]:
                known = 0
            else:
                row = [0] * len(right)
                for x in left[1:]:
                    above = row
                    row = [0]
                    for j, y in enumerate(right[1:], 1):
                        w = self.weight(x, y)
                        row.append(max(above[j], row[j - 1], above[j - 1] + w if w else 0))
                known = 1 + row[-1]
            self.memo[a, b] = known
        return known

    def _wide(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """In linear time: each left child with the next right one of its key."""
        places: dict[str, list[int]] = defaultdict(list)
        for j in range(len(right) - 1, -1, -1):
            places[right[j].key].append(j)
        out, last = [], -1
        for x in left:
            own = places.get(x.key, [])
            while own and own[-1] <= last:
                own.pop()
            if own:
                last = own.pop()
                out.append((x, right[last]))
        return out

    def children(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """Matched pairs of two lists of children, in order, of the largest weight. Equal ends need no
        table. Lists of more than ``WIDE`` pairs are matched by key."""

        def same(x: Node, y: Node) -> bool:
            return x.shape == y.shape and x.digest == y.digest

        low, out = 0, []
        while low < min(len(left), len(right)) and same(left[low], right[low]):
            out.append((left[low], right[low]))
            low += 1
        high = 0
        while high < min(len(left), len(right)) - low and same(left[-1 - high], right[-1 - high]):
            out.append((left[-1 - high], right[-1 - high]))
            high += 1
        left, right = left[low : len(left) - high], right[low : len(right) - high]
        if not left or not right:
            return out
        if len(left) * len(right) > WIDE:
            return out + self._wide(left, right)
        table = [[0] * (len(right) + 1)]
        for x in left:
            above, row = table[-1], [0]
            for j, y in enumerate(right):
                w = self.weight(x.shape, y.shape)
                row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
            table.append(row)
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j]))
        return out


@dataclass
class Pivot:
    """A layout's tree: its nodes by their place in page order, the root at 0."""

    root: Node
    nodes: list[Node]
    above: list[int]  # the parent's place
    ends: list[int]  # the place after the node's last descendant

    @classmethod
    def of(cls, root: Node) -> Pivot:
        nodes, above, ends = [], [], []

        def walk(node: Node, parent: int) -> None:
            at = len(nodes)
            nodes.append(node), above.append(parent), ends.append(0)
            for kid in node.kids:
                walk(kid, at)
            ends[at] = len(nodes)

        walk(root, 0)
        return cls(root, nodes, above, ends)

    @classmethod
    def folded(cls, page: str) -> Pivot:
        """From a page, with at most ``FOLD`` children of one key below a node."""

        def fold(node: Node) -> None:
            seen: Counter = Counter()
            kept = []
            for kid in node.kids:
                seen[kid.key] += 1
                if seen[kid.key] <= FOLD:
                    fold(kid)
                    kept.append(kid)
            node.kids = node.items = kept

        root = parse(page)
        fold(root)
        return cls.of(root)

    def to_json(self) -> str:
        def spec(node: Node) -> list:
            return [node.key, node.tag, int(node.aside), node.leads, [spec(c) for c in node.kids]]

        return json.dumps(spec(self.root), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Pivot:
        def node(spec: list) -> Node:
            own = Node(spec[1])
            own.key, own.aside, own.leads = spec[0], bool(spec[2]), spec[3]
            own.kids = [node(c) for c in spec[4]]
            own.items = own.kids
            return own

        return cls.of(node(json.loads(text)))


def key_slot(parent: int, key: str) -> int:
    """The slot of children of ``key`` that match no node, below the node at ``parent``."""
    return -((parent + 1) << 32) - xxhash.xxh32_intdigest(key.encode("utf-8", "surrogatepass"))


@dataclass
class Observed:
    """One page aligned with its pivot: counted slots, and its text as runs in page order."""

    slots: list[tuple[int, int, str | None, int, int]] = field(default_factory=list)  # slot, parent, key, digest, chars
    runs: list[tuple[int, bool, str]] = field(default_factory=list)  # slot, within a block that names itself aside, text


def observe(matcher: Matcher, pivot: Pivot, root: Node) -> Observed:
    """Align ``root`` with the pivot (both interned)."""
    out = Observed()
    place = {id(n): i for i, n in enumerate(pivot.nodes)}
    matched: dict[int, int] = {id(root): 0}
    todo = [(pivot.root, root)]
    while todo:
        a, b = todo.pop()
        at = place[id(a)]
        out.slots.append((at, pivot.above[at], None, b.digest, b.chars))
        for x, y in matcher.children(a.kids, b.kids):
            matched[id(y)] = place[id(x)]
            todo.append((x, y))
        rest: dict[str, list[int]] = {}
        for kid in b.kids:
            if id(kid) not in matched:
                own = rest.setdefault(kid.key, [0, 0])
                own[0], own[1] = (own[0] * 1_000_003 + kid.digest) & (1 << 64) - 1, own[1] + kid.chars
        out.slots += [(key_slot(at, key), at, key, *own) for key, own in rest.items()]

    def walk(node: Node, slot: int, inside: bool, aside: bool) -> None:
        for item in node.items:
            if isinstance(item, str):
                out.runs.append((slot, aside, item))
            elif (own := matched.get(id(item))) is not None:
                walk(item, own, False, False)
            else:
                walk(item, slot if inside else key_slot(slot, item.key), True, aside or item.aside)

    walk(root, 0, False, False)
    return out


@dataclass
class Slot:
    """A slot over all pages of its layout: pages with it, with its most frequent text, the characters
    of its different texts, and those of all its texts."""

    parent: int
    key: str | None
    pages: float = 0.0
    top: float = 0.0
    mass: int = 0
    total: float = 0.0


@dataclass
class Wrapper:
    """What is content: nodes whose own runs are, key slots that aren't although their parent is, and
    key slots that are although their parent isn't. ``wider`` and ``never`` serve pages without any run there."""

    kept: list[int]
    gone: list[int]
    also: list[int]
    wider: list[int]
    never: list[int]

    def text(self, runs: Iterable[tuple[int, bool, str]]) -> str:
        def chosen(kept: set[int], gone: set[int], also: set[int]) -> list[str]:
            return [t for s, aside, t in runs if not aside and (s in kept if s >= 0 else s in also or (-s >> 32) - 1 in kept and s not in gone)]

        runs = list(runs)
        return "\n\n".join(chosen({*self.kept}, {*self.gone}, {*self.also}) or chosen({*self.wider}, {*self.never}, set()))


def induce(pivot: Pivot, slots: dict[int, Slot], pages: float) -> Wrapper:
    """The wrapper of a layout of ``pages`` different pages from its pivot and counted slots."""
    n, ends = len(pivot.nodes), pivot.ends
    mass = [slots[i].mass if i in slots else 0 for i in range(n)]
    beside: dict[int, dict[str, int]] = defaultdict(dict)  # key slots by parent
    for s, own in slots.items():
        if s < 0:
            beside[own.parent][own.key] = s
    place = {id(x): i for i, x in enumerate(pivot.nodes)}
    kids = [[place[id(c)] for c in x.kids] for x in pivot.nodes]

    def under(places: Iterable[int]) -> set[int]:
        return {i for p in places for i in range(p, ends[p])}

    def constant(s: int, copies: float = 0.0) -> bool:
        own = slots.get(s)
        rest = own.pages - copies if own else 0
        return own is not None and rest >= LEAST_PAGES - 1e-6 and own.top - copies >= SHARE * rest

    # what names itself aside is in the region only if it holds the whole of it
    nested = {0}
    for i in range(1, n):
        if pivot.above[i] in nested and mass[i] >= DOMINANT * mass[0]:
            nested.add(i)
    asides = {i for i in range(1, n) if pivot.nodes[i].aside and i not in nested}
    region, core, also, copies = [0], [0], [], 0.0
    named: list[int] = []
    if pages < LEAST_PAGES:
        for lead in ("article", "main"):
            within = under(asides)
            named = [i for i in range(1, n) if pivot.nodes[i].leads == lead and i not in within and not any(j < i < ends[j] and pivot.nodes[j].leads == lead for j in range(i))]
            if named:
                same = {(pivot.above[i], pivot.nodes[i].key) for i in named}
                region, core, also = named, named, [s for p, key in same if (s := beside[p].get(key)) is not None]
                break
    at = 0
    while not named:
        groups: dict[str, list[int]] = defaultdict(list)
        for i in kids[at]:
            if i not in asides:
                groups[pivot.nodes[i].key].append(i)
        sizes = {key: sum(mass[i] for i in own) + (slots[beside[at][key]].mass if key in beside[at] else 0) for key, own in groups.items()}
        key = max(sizes, key=lambda k: (sizes[k], k), default=None)
        if key is None or pivot.nodes[at].leads == "article" or sizes[key] < DOMINANT * mass[at] or not any(kids[i] for i in groups[key]):
            core, copies = [at], slots[at].top if at and at in slots else 0.0
            break
        own, more = groups[key], beside[at].get(key)
        best = max(own, key=lambda i: (mass[i], -i))
        single = mass[best] >= DOMINANT * mass[at] and (more is None or slots[more].mass <= BESIDE * sizes[key])
        first = best if single else own[0]
        titles = [i for i in kids[at] if i < first and pivot.nodes[i].tag in HEADINGS and not constant(i)]
        region = [*region[:-1], *(i for i in kids[at] if titles and titles[0] <= i < first)]
        if not single:
            region, core, also = region + own, own, [] if more is None else [more]
            break
        region.append(best)
        at = best
    inside = under(region)
    dropped, gone = under(i for i in asides if i in inside and i not in core), set()
    template: list[int] = []  # slots
    for p in {pivot.above[i] for i in region} | inside:
        for key in {pivot.nodes[i].key for i in kids[p]} | {*beside[p]}:
            own, more = [i for i in kids[p] if pivot.nodes[i].key == key], beside[p].get(key)
            if {*own} & {*core} or more in also or not (p in inside or {*own} & inside):
                continue
            alike = [i for i in own if i in slots] + ([] if more is None else [more])
            if alike and all(constant(s, copies) for s in alike):
                template += alike
    whole = sum(slots[s].total for s in (*region, *also) if s in slots)
    tops = [s for s in template if s < 0 or not any(j < s < ends[j] for j in template if j >= 0)]
    out = [*tops, *(i for i in asides if i in inside and i in slots and i not in core and not any(0 <= j < i < ends[j] for j in tops))]
    if whole - sum(slots[s].total for s in out) > LEAST_TEXT * whole:
        # else all pages have one article
        dropped |= under(s for s in template if s >= 0)
        gone = {s for s in template if s < 0}
    never = {s for s in slots if s < 0 and constant(s)}
    wider = set(range(n)) - under(asides) - under(i for i in range(1, n) if constant(i))
    return Wrapper(sorted(inside - dropped), sorted(gone), sorted(also), sorted(wider), sorted(never))


def induced(pages: list[str]) -> tuple[Pivot, Wrapper]:
    """The wrapper of a few pages of one layout, in one process; equal pages count once."""
    different = list(dict.fromkeys(pages))
    matcher, pivot = Matcher(), Pivot.folded(different[0])
    matcher.intern(pivot.root)
    counts: dict[int, Counter] = defaultdict(Counter)
    slots: dict[int, Slot] = {}
    for page in different:
        root = parse(page)
        matcher.intern(root)
        for s, parent, key, digest, chars in observe(matcher, pivot, root).slots:
            own = slots.setdefault(s, Slot(parent, key))
            own.mass += chars if digest not in counts[s] else 0
            own.total += chars
            counts[s][digest] += 1
    for s, own in slots.items():
        own.pages, own.top = float(sum(counts[s].values())), float(max(counts[s].values()))
    return pivot, induce(pivot, slots, len(different))


def extracted(page: str, pivot: Pivot, wrapper: Wrapper) -> str:
    """The text of one page by a wrapper, in one process."""
    matcher, root = Matcher(), parse(page)
    matcher.intern(pivot.root), matcher.intern(root)
    return wrapper.text(observe(matcher, pivot, root).runs)


def layout_sign(html: Column) -> Column:
    """Hash of the different containers (element, class, id; long numbers alike) that a page has."""
    bare = F.regexp_replace(F.lower(html), r"(?s)<!--.*?-->|<(script|style|svg|noscript|template|textarea)\b.*?</\1", " ")

    def name(tag: Column) -> Column:
        parts = (F.regexp_extract(tag, p, 1) for p in (r"^<([a-z]+)", r"\bclass\s*=\s*[\"']?([^\"'>]*)", r"\bid\s*=\s*[\"']?([^\"'>]*)"))
        return F.regexp_replace(F.concat_ws("|", *parts), _DIGITS.pattern, "0")

    return F.md5(F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(_CONTAINERS), F.lit(0)), name))), "\n").cast("binary"))


def _few(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it."""
    measured = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df


class Aligner:
    """Aligns pages with the pivots of their layouts, which it keeps between pages."""

    def __init__(self) -> None:
        self.matcher, self.pivots = Matcher(), {}

    def __call__(self, page: str, layout: int, spec: str) -> Observed:
        if self.matcher.held > MEMO or len(self.pivots) > 256:
            self.matcher.clear(), self.pivots.clear()
        if layout not in self.pivots:
            self.pivots[layout] = Pivot.from_json(spec)
            self.matcher.intern(self.pivots[layout].root)
        root = parse(page)
        self.matcher.intern(root)
        return observe(self.matcher, self.pivots[layout], root)


PARTS = "page_id long, url string, layout long, slots array<long>, asides array<boolean>, texts array<string>, slot long, parent int, key string, digest long, chars long, weight double"
_PART_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
_PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_PART_NAMES, _PART_KINDS, strict=True)], _PART_NAMES)


def aligned(hosted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``hosted(page_id, url, host, html)`` as runs, beside the counts of their slots (rows
    with ``slot``), and (layout, spec, pages) of each layout."""
    own = hosted.withColumn("sign", layout_sign(F.col("html"))).withColumn("page", F.xxhash64("html"))
    light, _ = shared.staged(own.where("html is not null").groupBy("host", "sign", "page").agg(F.count("*").alias("copies")), "wrapper-pages")
    by_host = light.groupBy("host", "sign").agg(F.count("*").alias("pages"), F.min("page").alias("page"))
    pooled = by_host.where(F.col("pages") < LEAST_PAGES).groupBy("sign").agg(F.sum("pages").alias("pool_pages"), F.min("page").alias("pool_page"))
    is_pooled = F.col("pages") < LEAST_PAGES
    homes = by_host.join(pooled, "sign", "left").select(
        "host", "sign",
        F.when(is_pooled, F.xxhash64("sign")).otherwise(F.xxhash64("host", "sign")).alias("layout"),
        F.when(is_pooled, F.col("pool_pages")).otherwise(F.col("pages")).alias("pages"),
        F.when(is_pooled, F.col("pool_page")).otherwise(F.col("page")).alias("page"),
    )
    homes, _ = shared.staged(homes, "wrapper-homes")
    wanted = homes.select("layout", "page", "pages").dropDuplicates(["layout"])

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specs = [Pivot.folded(h.as_py()).to_json() for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(specs, pa.string())], ["layout", "pages", "spec"])

    found = hosted.where("html is not null").select("html", F.xxhash64("html").alias("page")).join(_few(wanted, F.lit(32)), "page")
    specs, _ = shared.staged(found.select("layout", "pages", "html").mapInArrow(pivots, "layout long, pages long, spec string").dropDuplicates(["layout"]), "wrapper-pivots")
    of_page = homes.select("host", "sign", "layout").join(specs.select("layout", "spec"), "layout")
    repeated = light.where("copies > 1").select("host", "page", "copies")
    rows = own.join(_few(of_page, F.octet_length("spec") + F.octet_length("host") + 40), ["host", "sign"], "left").join(_few(repeated, F.octet_length("host") + 24), ["host", "page"], "left")
    rows = rows.select("page_id", "url", "html", "layout", "spec", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = Aligner(), defaultdict(float)

        def flush() -> pa.RecordBatch:
            columns = zip(*((*key, w) for key, w in counts.items()), strict=True) if counts else [()] * 7
            out = _batch(dict(zip(("layout", "slot", "parent", "key", "digest", "chars", "weight"), columns, strict=True)), len(counts))
            counts.clear()
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                slots, asides, texts = [], [], []
                for page, layout, spec, weight in zip(*(some.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    seen = aligner(page, layout, spec) if page is not None else Observed()
                    for s, parent, key, digest, chars in seen.slots:
                        counts[layout, s, parent, key, digest - (1 << 64) if digest >= 1 << 63 else digest, chars] += weight
                    for out, part in zip((slots, asides, texts), zip(*seen.runs, strict=True) if seen.runs else ((), (), ()), strict=True):
                        out.append(part)
                yield _batch({"page_id": some.column(0), "url": some.column(1), "layout": some.column(3), "slots": slots, "asides": asides, "texts": texts}, some.num_rows)
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    parts, _ = shared.staged(rows.mapInArrow(align, PARTS), "wrapper-parts", codec="zstd")
    return parts, specs


def wrappers(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """(layout, kept, gone, also, wider, never) of each layout from its slots' counts."""
    texts = counts.groupBy("layout", "slot", "digest").agg(F.sum("weight").alias("n"), F.max("chars").alias("chars"), F.first("parent").alias("parent"), F.first("key").alias("key"))
    slots = texts.groupBy("layout", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("mass"), F.sum(F.col("n") * F.col("chars")).alias("total"), F.first("parent").alias("parent"), F.first("key").alias("key"))
    # the slots of few pages are never template, and their text hardly weighs; nodes of the pivot are few
    frequent = slots.where((F.col("slot") >= 0) | (F.col("n") > LEAST_PAGES - 1e-6))
    listed = specs.join(frequent.groupBy("layout").agg(F.collect_list(F.struct("slot", "parent", "key", "n", "top", "mass", "total")).alias("found")), "layout", "left")
    names = ("kept", "gone", "also", "wider", "never")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for pages, spec, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                slots = {r["slot"]: Slot(r["parent"], r["key"], r["n"], r["top"], r["mass"], r["total"]) for r in found or ()}
                done.append(induce(Pivot.from_json(spec), slots, pages))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(w, c) for w in done], pa.list_(pa.int64())) for c in names)], ["layout", *names])

    return listed.select("layout", "pages", "spec", "found").mapInArrow(decide, "layout long, " + ", ".join(f"{c} array<long>" for c in names))


def assembled(runs: DataFrame, decided: DataFrame) -> DataFrame:
    """``runs(page_id, url, layout, slots, asides, texts)`` with the text that the wrappers keep."""
    size = sum((F.size(c) * 8 for c in ("kept", "gone", "also", "wider", "never")), F.lit(64))
    joined = runs.join(_few(decided, size), "layout", "left")
    places = F.sequence(F.lit(0), F.size("slots") - 1)

    def chosen(kept: str, gone: str, also: str | None) -> Column:
        def is_kept(i: Column) -> Column:
            slot = F.get("slots", i)
            below = F.array_contains(kept, F.shiftright(F.negative(slot), 32) - 1) & ~F.array_contains(gone, slot)
            return ~F.get("asides", i) & F.when(slot >= 0, F.array_contains(kept, slot)).otherwise(below | F.array_contains(also, slot) if also else below)

        return F.transform(F.filter(places, is_kept), lambda i: F.get("texts", i))

    some = F.size("slots") > 0
    first = joined.withColumn("main", F.when(some, chosen("kept", "gone", "also")))
    best = F.when(F.size("main") > 0, F.col("main")).when(some, chosen("wider", "never", None))
    text = F.coalesce(F.array_join(best, "\n\n"), F.lit(""))
    return first.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without any visible text, give the empty text. Pages without a host
    in their url are pages of one host. Pages of any length and width are read whole. Repeated rows are
    extracted alike and count once; further columns are ignored; an empty table gives an empty one."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
    parts, specs = aligned(pages.select("page_id", "url", "html", host.alias("host")))
    decided, _ = shared.staged(wrappers(parts.where("slot is not null"), specs), "wrappers")
    return assembled(parts.where("slot is null").select("page_id", "url", "layout", "slots", "asides", "texts"), decided)
