"""Main-text extraction by union-free wrapper inference for each host.

A page is a tree of block elements and texts, read from its token stream.  A wrapper is such a tree with the marks of a
union-free regular expression: a node may be optional or repeated, several nodes may stand in a repeated group, and a text
is constant or a slot.  The first page is the first wrapper; every further page is aligned with it, and each
mismatch is resolved on the spot: differing texts become a slot; nodes that repeat what has just been
matched, on either side, become a repeated node or group; what only one side has becomes optional.  There are no
alternatives.

Pages whose trees agree but for the lengths of runs are aligned in the task that reads them, one wrapper for each such
class; the classes of a host are then aligned in the order of their hashes, in groups of a few that
are aligned in turn, so that the result does not depend on how pages are dealt out and a host of a third of all
pages costs a row a task and class.

Each page is read along its host's wrapper, which says of every text whether it is a slot's or the template's: a constant is
the template's once two different pages show it.  Tags and names are the prior.  What they mark as a menu, header, footer, sidebar,
notice, advert, form or reader comments is left out.  The outermost elements that they mark as content (article, main, or a name that
speaks of it) are regions, whose texts are kept whole; around them headings and paragraphs of slots are kept, and without any region the
slots alone.  Within a region a word such as "related" in a compound name tells nothing unless the other words are layout.

Cases: a null html is empty, its text too; a page without host belongs to the host ""; unclosed and
stray tags end with their parent; rows that share a page_id are each extracted; equal pages are one page for what is
constant; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.storage import map_batches, materialize

BROADCAST_BYTES = 16 << 20
HELD_BYTES = 16 << 20
LONG_TEXT = 200
#: Wrappers that are aligned at once when those of a host are brought together.
FAN_IN = 32
OPTIONAL, REPEATED = 1, 2
#: Blocks nested deeper than this become part of the block around them.
MAX_DEPTH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea title iframe svg canvas object dialog menu fieldset audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd dt", {"dl"}), "dd": ("dd dt", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot "
    "sidebar aside rail widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond discussion pagination pager form search toolbar skip".split()
)
#: Boilerplate words that also name subjects (a section "related-work"): in a compound they tell only beside words of layout.
SUBJECTS = frozenset("related recommended search share sharing social notice notices form header skip reply replies discussion".split())
LAYOUT = frozenset("box list lists link links post posts item items block area wrap wrapper container inner outer widget slot bar button buttons panel group articles stories content site page top bottom left right icon icons field input results section".split())
CONTENT = frozenset("article articlebody content post entry story main maincontent postcontent entrycontent text".split())
#: Blocks of running text: of names in parts, only whole ones tell.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption".split())
#: A name of a title, such as entry-header.
TITLES = frozenset("header head title".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("name", "node", "muted")

    def __init__(self, name: str, node: list | None, muted: bool):
        self.name, self.node, self.muted = name, node, muted


def _marks(attributes: str, name: str) -> tuple[set[str], set[str], bool]:
    """(boilerplate words, content words, hidden) of an element's names."""
    boilerplate, content, hidden = set(), set(), False
    for attribute, a, b, c in _ATTRIBUTE.findall(attributes):
        value, attribute = a or b or c, attribute.lower()
        if attribute == "hidden" or attribute == "aria-hidden":
            hidden = hidden or attribute == "hidden" or value.lower() == "true"
            continue
        if attribute == "style":
            hidden = hidden or _HIDDEN.search(value) is not None
            continue
        for token in value.split():
            words = {w.lower() for w in _WORD.findall(token)}
            whole = re.sub(r"[^a-z]", "", token.lower())
            content |= (words | {whole}) & CONTENT
            if attribute == "role" and whole == "main":
                content.add("main")
            bad = ({whole} if name in TEXT_BLOCKS else words | {whole}) & BOILERPLATE
            if bad <= SUBJECTS and not words <= SUBJECTS | LAYOUT:
                bad &= {whole}
            if not (bad <= TITLES and words & CONTENT):
                boilerplate |= bad
    return boilerplate, content, hidden


def parse(html: str | None) -> list[list]:
    """The page as a list of nodes: [key, 0, kids] of a block element, ["#", 0, text] of a text.

    A key is the tag's name, then "-" and a word if it is dropped, or "+" and its kind if it may be a region.
    """
    root: list[list] = []
    stack: list[_Element] = []
    parts: list[str] = []
    at, html = 0, html or ""
    kids, muted, depth = root, 0, 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                kids.append(["#", 0, text])

    def pop_to(k: int) -> None:
        nonlocal kids, muted, depth
        if any(e.node is not None for e in stack[k:]):
            flush()
        muted -= sum(e.muted for e in stack[k:])
        depth -= sum(e.node is not None for e in stack[k:])
        del stack[k:]
        kids = next((e.node[2] for e in reversed(stack) if e.node is not None), root)

    while True:
        found = _TOKEN.search(html, at)
        stop = len(html) if found is None else found.start()
        if stop > at and not muted:
            parts.append(unescape(html[at:stop]))
        if found is None:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if k is not None and (name in BLOCK or not any(e.node is not None for e in stack[k + 1 :])):  # an inline end tag does not close blocks
                pop_to(k)
            continue
        attributes = found[3] or found[6] or ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name in ("br", "wbr"):
                parts.append(" ")
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "p":
                    pop_to(k)
                    break
                if stack[k].node is not None:
                    break
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ends.split():
                    pop_to(k)
                    break
                if stack[k].name in scope:
                    break
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        bad, content, hidden = _marks(attributes, name) if attributes else ((), (), False)
        dropped = name in DROPPED or hidden or bool(bad) and name not in ("html", "body", "main")
        if name == "header" and not any(e.node is not None and "+" in e.node[0] for e in stack):
            dropped = True  # of the site, not of an article
        if name not in BLOCK:
            stack.append(_Element(name, None, dropped))
            muted += dropped
            continue
        flush()
        if depth >= MAX_DEPTH:  # deeper blocks are read where they stand
            stack.append(_Element(name, ["", 0, kids], dropped))
            muted += dropped
            depth += 1
            continue
        kind = name if name in ("article", "main") else "main" if "main" in content and "role" in attributes else "content" if content else ""
        node = [name + (f"-{min(bad, default=name)}" if dropped else "") + (f"+{kind}" if kind else ""), 0, []]
        kids.append(node)
        kids = node[2]
        stack.append(_Element(name, node, False))
        depth += 1
    pop_to(0)
    flush()
    return root


def text_key(text: str) -> str:
    """The text, or the length and a 128-bit hash of a long one."""
    return text if len(text) <= LONG_TEXT else f"\x00{len(text)} {blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def _texts(nodes: list[list]) -> list[str]:
    """The undropped texts."""
    out: list[str] = []
    for key, _, x in nodes:
        if key == "#":
            out.append(x)
        elif "-" not in key:
            out += _texts(x)
    return out


def page_wrapper(nodes: list[list]) -> list[list]:
    """A page as a wrapper: all its texts are constant."""
    return [[key, 0, text_key(x) if key == "#" else page_wrapper(x)] for key, _, x in nodes]


def _shape(nodes: list[list]) -> str:
    """The tree with runs of equal nodes as one: pages of one shape differ in texts and lengths of runs."""
    out: list[str] = []
    for key, _, x in nodes:
        own = key if key == "#" else f"{key}({_shape(x)})"
        if not out or out[-1] != own:
            out.append(own)
    return ",".join(out)


def _join(a: list, b: list) -> list:
    """Two nodes of one key as one."""
    if a == b:
        return a
    if a[0] == "#":
        return ["#", a[1] | b[1], a[2] if a[2] == b[2] else None]
    return [a[0], a[1] | b[1], a[2] if a[2] == b[2] else align(a[2], b[2])]


def _optional(nodes: list[list]) -> list[list]:
    return [[key, flags | OPTIONAL, x] for key, flags, x in nodes]


class _Out:
    """The wrapper so far, with the places of each key, so that a repeat of its end is found without a scan."""

    def __init__(self):
        self.nodes: list[list] = []
        self.places: dict[str, list[int]] = {}

    def add(self, nodes: list[list]) -> None:
        for x in nodes:
            self.places.setdefault(x[0], []).append(len(self.nodes))
            self.nodes.append(x)

    def cut(self, k: int) -> None:
        for x in self.nodes[len(self.nodes) - k :]:
            self.places[x[0]].pop()
        del self.nodes[len(self.nodes) - k :]

    def fold(self, nodes: list[list], at: int) -> int:
        """Resolve nodes[at:] as a repeat of the end; the number of nodes that are used up."""
        out = self.nodes
        if not out:
            return 0
        if out[-1][0] == "()":
            used, unit = _take(out[-1][2], nodes, at)
            if used:
                out[-1] = ["()", out[-1][1], unit]
                return used
        for place in reversed(self.places.get(nodes[at][0], ())):
            k = len(out) - place
            if k > len(nodes) - at:
                break
            if all(out[place + i][0] == nodes[at + i][0] for i in range(k)):
                unit = [_join(out[place + i], nodes[at + i]) for i in range(k)]
                self.cut(k)
                self.add([[unit[0][0], unit[0][1] | REPEATED, unit[0][2]]] if k == 1 else [["()", REPEATED, unit]])
                return k
        return 0


def _next_places(nodes: list[list]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, x in enumerate(nodes):
        out.setdefault(x[0], []).append(k)
    return out


def _after(places: dict[str, list[int]], key: str, k: int) -> int | None:
    """The first place of the key after k."""
    own = places.get(key, ())
    at = bisect_right(own, k)
    return own[at] if at < len(own) else None


def _take(unit: list[list], nodes: list[list], at: int) -> tuple[int, list[list]]:
    """(how many nodes from ``at`` on are further turns of a repeated group, the group that covers them)."""
    keys = {x[0] for x in unit}
    first = next((x[0] for x in unit if not x[1] & OPTIONAL), unit[0][0])
    stop = at
    while stop < len(nodes) and nodes[stop][0] in keys:
        stop += 1
    if stop == at or nodes[at][0] != first:
        return 0, unit
    turns = [i for i in range(at, stop) if nodes[i][0] == first] + [stop]
    for a, b in zip(turns, turns[1:]):
        unit = align(unit, nodes[a:b])
    return stop - at, unit


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper that covers two lists of nodes: what both have stays, and every mismatch becomes a repeat or optional."""
    out = _Out()
    places: tuple[dict, dict] | None = None
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.add([_join(a[i], b[j])])
            i, j = i + 1, j + 1
            continue
        if i < len(a) and j < len(b) and "()" in (a[i][0], b[j][0]):
            group, nodes, at = (a[i], b, j) if a[i][0] == "()" else (b[j], a, i)
            used, unit = _take(group[2], nodes, at)
            if used:
                out.add([["()", group[1], unit]])
                i, j = (i + 1, j + used) if group is a[i] else (i + used, j + 1)
                continue
        used = out.fold(b, j) if j < len(b) else 0
        if used:
            j += used
            continue
        used = out.fold(a, i) if i < len(a) else 0
        if used:
            i += used
            continue
        if i == len(a) or j == len(b):
            out.add(_optional([a[i] if j == len(b) else b[j]]))
            i, j = (i + 1, j) if j == len(b) else (i, j + 1)
            continue
        places = places or (_next_places(a), _next_places(b))
        skip_a, skip_b = _after(places[0], b[j][0], i), _after(places[1], a[i][0], j)
        if skip_a is not None and (skip_b is None or skip_a - i <= skip_b - j):
            out.add(_optional(a[i:skip_a]))
            i = skip_a
        elif skip_b is not None:
            out.add(_optional(b[j:skip_b]))
            j = skip_b
        else:
            out.add(_optional([a[i], b[j]]))
            i, j = i + 1, j + 1
    return out.nodes


class _Level:
    """A list of wrapper nodes to be read along: groups laid open, where each node's next turn begins, and the places of each key."""

    def __init__(self, wrapper: list[list]):
        self.flat: list[list] = []
        self.turn: list[int] = []  # where the next turn of a node's group begins, or the node itself if it repeats
        for x in wrapper:
            first = len(self.flat)
            self.flat += x[2] if x[0] == "()" else [x]
            self.turn += [first if x[0] == "()" else k if x[1] & REPEATED else k + 1 for k in range(first, len(self.flat))]
        self.places = _next_places(self.flat)

    def find(self, key: str, at: int) -> int | None:
        """The place of a key that is read after the place ``at``: from there on, else from its group's turn, else from the start."""
        again = self.turn[at] if at >= 0 else 0
        near = at if at >= 0 and self.flat[at][1] & REPEATED else at + 1
        own = self.places.get(key, ())
        for lo, hi in ((near, len(self.flat)), (again, near), (0, again)):
            k = bisect_left(own, lo)
            if k < len(own) and own[k] < hi:
                return own[k]
        return None


def _level(wrapper: list[list], known: dict[int, _Level]) -> _Level:
    if id(wrapper) not in known:
        known[id(wrapper)] = _Level(wrapper)
    return known[id(wrapper)]


class _Text:
    """An undropped text in page order: its region (None outside), what stands dropped around that, and whether it is no template's."""

    __slots__ = ("text", "region", "around", "own", "block")

    def __init__(self, text: str, region: int | None, around: tuple[int, ...], own: bool, block: str):
        self.text, self.region, self.around, self.own, self.block = text, region, around, own, block


#: Text of these blocks is running text where no region holds it.
RUNNING = frozenset("h1 h2 h3 p pre blockquote".split())


def _read(nodes: list[list], wrapper: list[list], out: list[_Text], known: dict[int, _Level], optional: bool = False, region: int | None = None, around: tuple[int, ...] = (), block: str = "") -> None:
    """The texts of nodes, read along a wrapper.

    A text is the template's if it is constant and stands in no optional part, so that every page has shown it.  Dropped
    elements are read only for the regions in them (``around``).
    """
    level = _level(wrapper, known)
    at = -1
    for key, _, x in nodes:
        dropped = "-" in key
        if dropped and region is not None:
            continue  # a dropped part of a region
        own = level.find(key, at)
        at = at if own is None else own
        node = None if own is None else level.flat[own]
        if key == "#":
            if region is not None or not around:
                out.append(_Text(x, region, around, optional or node is None or bool(node[1] & OPTIONAL) or node[2] != text_key(x), block))
            continue
        name, _, kind = key.partition("+")
        inside = id(x) if region is None and kind and not dropped else region
        _read(x, [] if node is None else node[2], out, known, optional or node is not None and bool(node[1] & OPTIONAL), inside, (*around, id(x)) if dropped else around, name.partition("-")[0])


def extract(html: str | None, wrapper: list[list] | None, different: bool = True, known: dict[int, _Level] | None = None) -> str:
    """Main text of one page, read along the wrapper of its host; ``different``: whether that covers different pages; ``known`` keeps what is prepared for it."""
    nodes = parse(html)
    if wrapper is None:  # one page by itself cannot tell what is a template's
        wrapper, different = page_wrapper(nodes), False
    read: list[_Text] = []
    _read(nodes, wrapper, read, {} if known is None else known)
    sizes: dict[int, int] = {}
    for t in read:
        if t.region is not None:
            sizes[t.region] = sizes.get(t.region, 0) + len(t.text)
    if not sizes:
        return "\n".join(t.text for t in read if t.own or not different)
    # What stands around the largest region is no boilerplate, whatever its name says.
    largest = max(sizes, key=lambda r: sizes[r])  # the first of equals
    clean = set(next(t.around for t in read if t.region == largest))
    # A region's text is kept whole; around regions, running text that is not the template's.
    return "\n".join(t.text for t in read if clean.issuperset(t.around) and (t.region is not None or not t.around and t.block in RUNNING and (t.own or not different)))


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def _aligned(wrappers: list[str]) -> str:
    wrapper = json.loads(wrappers[0])
    for text in wrappers[1:]:
        if text != wrappers[0]:
            wrapper = align(wrapper, json.loads(text))
    return json.dumps(wrapper)


_CLASS_DDL = "host string, shape long, wrapper string, pages long, lo long, hi long"


def _merge(table: pa.Table) -> pa.Table:
    """Some wrappers of a host as one, in the order of their classes' hashes."""
    rows = sorted(zip(table.column("shape").to_pylist(), table.column("wrapper").to_pylist()))
    lo, hi = min(table.column("lo").to_pylist()), max(table.column("hi").to_pylist())
    values = [rows[0][0], _aligned([w for _, w in rows]), sum(table.column("pages").to_pylist()), lo, hi]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([table.column("host").slice(0, 1), *(pa.array([v], k) for v, k in zip(values, kinds))], names=["host", "shape", "wrapper", "pages", "lo", "hi"])


def _together(rows: DataFrame, *by: str) -> DataFrame:
    """Align a host's wrappers by further keys; equal ones are counted before, so that they cost a row a task."""
    equal = rows.groupBy("host", "shape", "wrapper", *(c for c in by if c != "shape")).agg(F.sum("pages").alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return materialize(equal.select("host", "shape", "wrapper", "pages", "lo", "hi", *(c for c in by if c != "shape")).groupBy("host", *by).applyInArrow(_merge, _CLASS_DDL), "classes")


def _most(rows: DataFrame, *by: str) -> int:
    return rows.groupBy(*by).agg(F.count_distinct("wrapper").alias("n")).agg(F.max("n")).first()[0] or 0


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON nodes), pages, different (whether two pages differ in their undropped texts): the wrapper of every host."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys, values = list(found), list(found.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()), pa.array([json.dumps(v[0]) for v in values], pa.string()), *(pa.array([v[k] for v in values], pa.int64()) for k in (1, 2, 3))],
                names=["host", "shape", "wrapper", "pages", "lo", "hi"],
            )

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                nodes = parse(html.as_py())
                own, shape, texts = page_wrapper(nodes), _number(_shape(nodes)), _number("\n".join(_texts(nodes)))
                known = found.get((host, shape))
                if known is None:
                    found[host, shape] = [own, 1, texts, texts]
                    size += len(html.as_buffer()) if html.is_valid else 0
                    if size > HELD_BYTES:
                        yield flush()
                        found.clear()
                        size = 0
                    continue
                known[0], known[1], known[2], known[3] = align(known[0], own), known[1] + 1, min(known[2], texts), max(known[3], texts)
        if found:
            yield flush()

    classes = materialize(map_batches(_with_host(pages).select("host", "html"), local, _CLASS_DDL), "classes")
    # A class of very many tasks' wrappers is aligned in parts first; the order within a class makes no difference.
    while (most := _most(classes, "host", "shape")) > FAN_IN:
        before, classes = most, _together(classes.withColumn("_part", F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN_IN)))), "shape", "_part")
        if _most(classes, "host", "shape") >= before:
            break
    classes = _together(classes, "shape")
    bits = max(math.ceil(math.log2(max(_most(classes, "host"), 1) / FAN_IN)), 0)
    while bits > 0:  # groups of classes with the same leading bits
        classes = _together(classes.withColumn("_part", F.shiftrightunsigned("shape", 64 - bits)), "_part")
        bits -= FAN_IN.bit_length() - 1
    return _together(classes).select("host", "wrapper", "pages", (F.col("lo") < F.col("hi")).alias("different"))


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    hosts = materialize(infer_wrappers(pages), "wrappers", narrow=True)
    size = hosts.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper").cast("long"))).first()[0] or 0
    rows = _with_host(pages)
    shared = None
    if size <= BROADCAST_BYTES:
        own = hosts.select("host", "wrapper", "different").collect()  # within the bound just counted
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["different"]) for r in own})
        rows = rows.select("page_id", "url", "html", "host")
    else:
        rows = rows.join(hosts, "host", "left").select("page_id", "url", "html", "wrapper", "different")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list, dict[int, _Level]]] = {}
        for batch in batches:
            texts = []
            found = (shared.value[h] for h in batch.column(3).to_pylist()) if shared else zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for html, (wrapper, different) in zip(batch.column(2), found):
                if wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper), {}
                own, levels = known[wrapper]
                texts.append(extract(html.as_py(), own, different, levels))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
