"""HTML extraction by wrappers: the pages of a host aligned into one union-free expression over tags and text slots.

A wrapper is a tree of elements, each once, optional (``?``), repeated (``+``) or both (``*``). Pages are
aligned with it child by child; what one side lacks becomes optional, neighbours alike become one
repeated group, texts become a slot. Slots are then told apart once per host: menus, adverts
and the like by their elements, the main part by its element or else by how little of it is links. A text that stands
in the same slot on most different pages of a host belongs to the template and is left out where there is no main part;
none is left out of one.
"""
from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossier.llm.url_trust import host_of
from dossier.session import cut

GROUP = 64  # wrappers merged by one task step
LINKS = 0.5  # a slot outside a main element whose text is links by more than this share is a menu
TEMPLATE, PAGES = 0.5, 4  # a text on more than this share of a host's pages is template, if so many pages differ
# fixed sets of the HTML vocabulary
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("nav header footer aside form head title script style noscript template iframe button select textarea "
                 "svg canvas object dialog menu audio video".split())
MAIN = frozenset(("article", "main"))
FRAME = MAIN | {"html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                     "p pre section table ul".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
                        "navigation menu breadcrumb breadcrumbs sidebar widget footer masthead cookie cookies consent notice "
                        "notices alert popup modal newsletter subscribe subscription share sharing social comment comments reply "
                        "replies respond disqus related recommended pagination pager form search login signup toolbar "
                        "disclaimer complementary contentinfo dialog hidden".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
Text = tuple[int, str, bool]  # digest of the path, text as in the source, whether it is in a link
Ways = dict[int, tuple[int, str, int]]  # path -> path of the parent, last label, number of labels


@lru_cache(1 << 16)
def label_of(tag: str, attributes: str) -> str:
    """An element's name with its classes, id and role, each whole; numbers in them are alike."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            names.update(w for t in value.split() if (w := re.sub(r"[^a-z_-]+", "", t).strip("-_")))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            names.add("hidden")
    return tag + "".join(f".{w}" for w in sorted(names))


def kind_of(label: str, frame: bool = False) -> str:
    """``skip``, ``main`` or none; the names of a ``frame``, which holds the main part, do not count against it,
    nor does a form around the main part."""
    tag, *names = label.split(".")
    if tag in SKIP and not (frame and tag == "form") or not (frame or tag in FRAME or BOILERPLATE.isdisjoint(names)):
        return "skip"
    return "main" if tag in MAIN or "main" in names else ""


@lru_cache(1 << 16)
def way(parent: int, label: str) -> int:
    """Digest of the path of labels that goes on from ``parent`` (0: the page) with ``label``."""
    whole = parent.to_bytes(8, "little") + label.encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")


def texts_of(page: str) -> tuple[list[Text], Ways]:
    """The texts of a page in order, and the paths they stand in.

    Inline elements without a telling name belong to their text; an empty text marks the end of a block. A path is
    known by a digest that goes on from its parent's, so depth costs nothing.
    """
    out: list[Text] = []
    ways: Ways = {0: (0, "", 0)}
    steps: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = []  # tag, path before it
    opened: Counter[str] = Counter()
    at = 0

    def close(upto: int) -> None:
        nonlocal at
        while len(stack) > upto:
            tag, at = stack.pop()
            opened[tag] -= 1
            if tag not in INLINE:
                out.append((at, "", False))

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)

    for m in _TOKEN.finditer(page):
        if m[8]:
            out.append((at, m[8], opened["a"] > 0))
        elif m[3] or m[6]:
            tag, ends, attributes = (m[3] or m[6]).lower(), m[2] or m[5], m[4] or m[7] or ""
            if ends:
                if opened[tag]:
                    close(innermost(tag))
                elif tag not in INLINE:
                    out.append((at, "", False))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    out.append((at, "", False))
                continue
            if tag in NOT_IN_P and opened["p"]:
                close(innermost("p"))
            elif stack and stack[-1][0] in CLOSES.get(tag, ()):
                close(len(stack) - 1)
            if tag not in INLINE:
                out.append((at, "", False))
            if attributes.endswith("/") and tag not in ("p", "div"):
                continue
            label = label_of(tag, attributes)
            stack.append((tag, at))
            opened[tag] += 1
            if tag not in INLINE or kind_of(label) == "skip":
                below = steps.get((at, label))
                if below is None:
                    below = steps[at, label] = way(at, label)
                    ways[below] = at, label, ways[at][2] + 1
                at = below
    return out, ways


# ---- wrappers: [label, quantifier, children], a slot being ["#", quantifier, [text length, length in links]]

def _joined(a: str, b: str, missing: bool = False, again: bool = False) -> str:
    optional = missing or bool({a, b} & {"?", "*"})
    repeated = again or bool({a, b} & {"+", "*"})
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _unrolled(call: Generator) -> list:
    """Result of a call whose inner calls are yielded, on a list instead of the call stack, so any depth will do."""
    calls, value = [call], None
    while calls:
        try:
            inner = calls[-1].send(value)
        except StopIteration as done:
            calls.pop()
            value = done.value
        else:
            calls.append(inner)
            value = None
    return value


def _merged(a: list, b: list, again: bool = False) -> Generator:
    """One node for two of the same label."""
    if a[0] == "#":
        return ["#", _joined(a[1], b[1], again=again), [a[2][0] + b[2][0], a[2][1] + b[2][1]]]
    return [a[0], _joined(a[1], b[1], again=again), (yield _aligned(a[2], b[2]))]


def _folded(nodes: list[list]) -> Generator:
    """Neighbouring groups of the same labels, of one to three nodes, as one repeated group."""
    for period in (1, 2, 3):
        out: list[list] = []
        k = 0
        while k < len(nodes):
            group = nodes[k:k + period]
            if len(out) >= period and len(group) == period and [n[0] for n in out[-period:]] == [n[0] for n in group]:
                for i, y in enumerate(group, len(out) - period):
                    out[i] = yield _merged(out[i], y, again=True)
                k += period
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def _matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of a longest common row of labels; costs only the pairs of equal labels."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j][0], []).append(j)
    tails: list[int] = []
    rows: list[tuple] = []
    for i, node in enumerate(a):
        for j in places.get(node[0], ()):
            k = bisect_left(tails, j)
            tails[k:k + 1], rows[k:k + 1] = [j], [(i, j, rows[k - 1] if k else None)]
    found, last = [], rows[-1] if rows else None
    while last:
        found.append(last[:2])
        last = last[2]
    return found[::-1]


def _aligned(a: list[list], b: list[list]) -> Generator:
    out, i, j = [], 0, 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        out += [[n[0], _joined(n[1], "", missing=True), n[2]] for n in a[i:x] + b[j:y]]
        if x < len(a):
            out.append((yield _merged(a[x], b[y])))
        i, j = x + 1, y + 1
    return (yield _folded(out))


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Children of two nodes aligned by their longest common row of labels; the rest becomes optional."""
    return _unrolled(_aligned(a, b))


def wrapper_of(page: str) -> list[list]:
    """The wrapper of one page: its elements with repeats folded and every text a slot."""
    root: list[list] = []
    open_: list[tuple[int, list]] = []  # path and inner nodes
    events, ways = texts_of(page)
    lowest = 0  # labels of the path that have been open since the last text
    for at, text, linked in events:
        lowest = min(lowest, ways[at][2])
        size = len(text.strip())
        if not size:
            continue
        new = []
        while (depth := ways[at][2]) > lowest or depth and open_[depth - 1][0] != at:
            new.append(at)
            at = ways[at][0]
        del open_[depth:]  # an element that ended is not gone on with, even by one of its kind
        for path in reversed(new):
            node = [ways[path][1], "", []]
            (open_[-1][1] if open_ else root).append(node)
            open_.append((path, node[2]))
        lowest = len(open_)
        (open_[-1][1] if open_ else root).append(["#", "", [size, size if linked else 0]])

    def fold(nodes: list[list]) -> Generator:
        inner = []
        for n in nodes:
            inner.append(n if n[0] == "#" else [n[0], n[1], (yield fold(n[2]))])
        return (yield _folded(inner))

    return _unrolled(fold(root))


def rows_of(wrapper: list[list]) -> list[list]:
    """A wrapper as rows of depth, label, quantifier and, for slots, the sizes, in the order of the page."""
    out, waiting = [], [(0, n) for n in reversed(wrapper)]
    while waiting:
        depth, (label, quantifier, inner) = waiting.pop()
        if label == "#":
            out.append([depth, label, quantifier, *inner])
        else:
            out.append([depth, label, quantifier])
            waiting += [(depth + 1, n) for n in reversed(inner)]
    return out


def from_rows(rows: Iterable[list]) -> list[list]:
    levels: list[list[list]] = [[]]
    for depth, label, quantifier, *sizes in rows:
        node = [label, quantifier, sizes]
        levels[depth].append(node)
        del levels[depth + 1:]
        levels.append(sizes)
    return levels[0]


def _written(wrapper: list[list]) -> str:
    return json.dumps(rows_of(wrapper), separators=(",", ":"))


def _read(text: str | None) -> list[list]:
    return from_rows(json.loads(text or "[]"))


def slots(wrapper: list[list]) -> dict[int, str]:
    """What the text slots of a wrapper hold, by their path: ``main``, ``body`` or ``skip``."""
    above: dict[int, tuple[int, str]] = {}  # elements, parents first
    sizes: dict[int, list[int]] = {}
    open_ = [0]
    for depth, label, _, *size in rows_of(wrapper):
        del open_[depth + 1:]
        if label == "#":
            at = sizes.setdefault(open_[-1], [0, 0])
            at[0], at[1] = at[0] + size[0], at[1] + size[1]
        else:
            open_.append(way(open_[-1], label))
            above.setdefault(open_[-1], (open_[-2], label))
    frames = set()  # elements with an element of the main part below them, outside others that are skipped by tag
    for path, (parent, label) in reversed(above.items()):
        tag, *names = label.split(".")
        if (tag not in SKIP or tag == "form") and (tag in MAIN or "main" in names or path in frames):
            frames.add(parent)
    kinds = {0: "body"}
    for path, (parent, label) in above.items():
        kinds[path] = kinds[parent] if kinds[parent] == "skip" else kind_of(label, path in frames) or kinds[parent]
    return {p: "skip" if kinds[p] == "body" and n[1] > LINKS * n[0] else kinds[p] for p, n in sizes.items()}


def text_key(path: int, text: str) -> int:
    """Digest of a text in its slot."""
    whole = path.to_bytes(8, "little") + " ".join(text.split()).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)


def main_text(page: str, known: dict[int, str], template: frozenset[int] = frozenset()) -> str:
    """The texts of a page's main slots, or of its body slots if it has none, a space between blocks.

    Texts of the template are left out of body slots, unless the page has no others; main slots keep every text.
    """
    blocks: dict[str, list[str]] = {"main": [], "body": [], "own": []}
    for path, text, _ in texts_of(page)[0]:
        if not text:
            for parts in blocks.values():
                parts.append(" ")
        elif (kind := known.get(path, "skip")) != "skip":
            blocks[kind].append(text)
            if kind == "body" and not (template and text.strip() and text_key(path, text) in template):
                blocks["own"].append(text)
    for kind in ("main", "own", "body"):
        text = " ".join(html.unescape("".join(blocks[kind])).split())
        if text:
            return text
    return ""


def templates(pages: DataFrame) -> DataFrame:
    """``host, template``: digests of the texts that stand in their slot on most different pages of a host.

    Pages are counted per batch before they are shuffled; a host has at most ``1 / TEMPLATE`` times the texts of a mean page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int | None]] = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((host, k) for k in {None, *(text_key(p, t) for p, t, _ in texts_of(page.as_py())[0] if t.strip())})
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int64()),
                                              pa.array(counts.values(), pa.int64())], names=["host", "key", "n"])

    named = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    first = named.withColumn("digest", F.xxhash64("html")).dropDuplicates(["host", "digest"]).select("host", "html")
    counts = cut(first.mapInArrow(run, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n")).filter("n > 1"))
    hosts = counts.filter(F.col("key").isNull() & (F.col("n") >= PAGES)).select("host", F.col("n").alias("pages"))
    return counts.filter(F.col("key").isNotNull()).join(hosts, "host").filter(F.col("n") > TEMPLATE * F.col("pages")).groupBy(
        "host").agg(F.collect_list("key").alias("template"))


def _combined(wrappers: Iterable[str]) -> str:
    out: list[list] | None = None
    for text in wrappers:
        out = _read(text) if out is None else aligned(out, _read(text))
    return _written(out or [])


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON), one row per host.

    Pages are aligned per batch where they are read; the wrappers of a host then meet in rounds, at most
    about ``GROUP`` in a step, until one is left, so that no task gets a whole large host.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[list]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = wrapper_of(page.as_py())
                found[host] = aligned(found[host], own) if host in found else own
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()),
                 pa.array(map(_written, found.values()), pa.string())], names=["host", "wrapper"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()),
                         "wrapper": pa.array([_combined(sorted(table.column("wrapper").to_pylist()))], pa.string())})

    named = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    now = cut(named.mapInArrow(run, "host string, wrapper string"))
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return now
        dealt = now.join(sizes, "host").select("host", "wrapper", F.pmod(
            F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP)).alias("part"))
        now = cut(dealt.groupBy("host", "part").applyInArrow(meet, "host string, wrapper string"))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``: the main text under the wrapper of the page's host.

    Null and empty pages have an empty text; pages without a url share the wrapper of the empty host;
    broken markup is closed where HTML closes it; repeated rows stay; other columns are not read; an empty
    table gives no rows.
    """
    known = cut(wrappers(pages).join(templates(pages), "host", "left")).withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", "html").join(known, host_of(F.col("url")) == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[dict[int, str], frozenset[int]]] = {}
        for batch in batches:
            out = []
            for page, host, wrapper, template in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                if host not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[host] = slots(_read(wrapper.as_py())), frozenset(template.as_py() or ())
                out.append(main_text(page.as_py() or "", *cache[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                             names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "_host", "wrapper", "template").mapInArrow(run, "page_id long, url string, text string")
