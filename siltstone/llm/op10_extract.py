"""Main-text extraction by template deduction over the pages of a host.

A page is read into tokens: the opening and closing tags of elements, each with its path (tags and names from the root on), and
runs of text with theirs. Pages of a host that have the same parts (``PARTS``) down to ``LAYOUT_DEPTH`` are a group (a layout). Over the
group's pages a token has an occurrence vector: how often it is on each page. Tokens of equal vectors are an equivalence class. The
vectors are never built: each page has a 64-bit number, and a token's sum of count times number, modulo 2**64, is equal for equal
vectors (and for others with a chance of 2**-64), so classes come from one aggregate with map-side combining, however many pages a
group has.

A class is valid if at least ``least_class`` of its tokens are tags and it is on at least ``support`` of the group's pages. It
is ordered by where its tokens first stand (all are on the same pages, so the means can be compared), and nested in the class of
the nearest enclosing element that is in a valid class, between that element's tags; one that would lie in two classes at once isn't
nested and is dropped. The ordered, nested classes are the template. A text run is in the template if its vector is that of a valid class of tags and
the pages that have it differ: their longest runs must be many (a bitmap of 64 bits counts them), so that the text of copies isn't
taken for a template.

A page is then walked with its group's template. A tag that comes where its class' order and nesting expect it moves the walk to the next slot;
text stands in a slot. Names and tags only say what a slot is for: slots under menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles are left out; where there are slots inside ``article`` or ``main`` they are the text, else all
others are. Elements of a page that are in no class (on few pages) stand in a slot and share its label, unless they are to be left out
themselves; they start a main slot only if the template has none. The template's own text runs are left out of every slot. Without a template nothing parts the page, and it is one slot.

Templates go to the tasks as one broadcast of at most ``broadcast_bytes``; if they are larger, pages are joined with them by host and layout.
A group of one page is its own template and is neither stored nor sent.

Defined results: null html is an empty page with empty text; a null url is of the host ''; a page without tags is text as it stands;
tags without an end are closed where their parent ends; very long pages are read whole; repeated rows are each returned, and count as pages each;
ties (tokens that first stand at the same mean place) go by the token's number; an empty table gives an empty result;
other columns are not read and not returned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extended, materialise, slices
from .op7_urls import host_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements without content, with raw text, that don't end a block, whose end is often left out, and what tags and names say.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol table article section h1 h2 h3 h4 h5 h6 pre blockquote footer header nav aside main form figure hr dl".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
LEFT_OUT = RAW | frozenset("nav aside footer form button menu dialog head noscript template iframe select".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|comments?|respond|replies|disqus|cookies?|consent|notice\w*|alert|popup|modal|newsletter|subscribe|widget\w*|login|copyright)(?:$|[\s_-])",
    re.I,
)
#: Tags that make a layout.
PARTS = frozenset("html body div section article main nav header footer aside table".split())
LAYOUT_DEPTH = 3
#: What a slot is for.
OTHER, MAIN, OUT = 0, 1, 2
OPEN, CLOSE, SINGLE, TEXT = "<", "/", "-", ""


@dataclass(frozen=True, slots=True)
class Element:
    tag: str
    path: str
    depth: int
    out: bool  #: left out by its own tag and names
    label: int  #: of its inside, by tags and names from the root on
    open: int  #: the opening tag's number, even and at least 2; the closing tag's is the next
    up: int  #: the parent's opening tag's, or 0


ROOT = Element("", "", 0, False, OTHER, 0, 0)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1 & ~1 or 2


class Reader:
    """Reads pages; elements are remembered by their path up to a bound."""

    def __init__(self, bound: int = 100_000) -> None:
        self.known: dict[tuple[str, str, str], Element] = {}
        self.bound = bound

    def element(self, up: Element, tag: str, names: str) -> Element:
        key = (up.path, tag, names)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.bound:
                self.known.clear()
            path = f"{up.path}/{tag} {names}" if names else f"{up.path}/{tag}"
            out = tag in LEFT_OUT or tag == "header" and up.label != MAIN
            out = out or tag not in ("body", "html", "article", "main") and bool(names) and NAMES.search(names) is not None
            label = OUT if out or up.label == OUT else MAIN if up.label == MAIN or tag in ("article", "main") else OTHER
            found = self.known[key] = Element(tag, path, up.depth + 1, out, label, _hash(path), up.open)
        return found

    def read(self, page: str) -> Iterator[tuple[str, Element, str]]:
        """(kind, element, text) in page order. Unknown ends are dropped, open elements are closed."""
        stack, at, size = [ROOT], 0, len(page)
        while at < size:
            m = TOKEN.match(page, at)
            if m is None:  # a tag that never ends: its bracket is text
                yield TEXT, stack[-1], page[at]
                at += 1
                continue
            at = m.end()
            if m[4] is not None:
                yield TEXT, stack[-1], m[4]
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        while len(stack) > n:
                            yield CLOSE, stack.pop(), ""
                        break
                continue
            for n in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[n].tag, ()):
                    while len(stack) > n:
                        yield CLOSE, stack.pop(), ""
                    break
                if stack[n].tag not in INLINE and stack[n].tag != "p":
                    break
            names = " ".join(a or b or c for a, b, c in NAMED.findall(m[3])) if m[3] else ""
            new = self.element(stack[-1], tag, names)
            if tag in VOID or m[3].endswith("/"):
                yield SINGLE, new, ""
                continue
            yield OPEN, new, ""
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:  # without an end it is empty, and the page goes on
                    at = end.end()
                yield CLOSE, new, ""
                continue
            stack.append(new)
        while len(stack) > 1:
            yield CLOSE, stack.pop(), ""


def run_token(element: Element, text: str) -> int:
    """Text runs have negative numbers, tags positive ones."""
    return -_hash(f"{element.path}>{' '.join(text.split())}")


Parts = list[tuple[str, Element, str]]


def layout(parts: Parts) -> int:
    """Of a page's parts down to ``LAYOUT_DEPTH``, without names."""
    paths = {element.path for kind, element, _ in parts if kind == OPEN and element.depth <= LAYOUT_DEPTH and element.tag in PARTS}
    return _hash("\n".join(sorted({re.sub(r" [^/]*", "", x) for x in paths})))


def page_tokens(parts: Parts) -> tuple[dict[int, list[int]], int]:
    """token -> [count, where it first stands, parent] of a page, and the bit of its longest run (signed)."""
    found: dict[int, list[int]] = {}
    longest = ""
    for place, (kind, element, text) in enumerate(parts):
        if kind == TEXT:
            if not text.strip():
                continue
            longest = text if len(text) > len(longest) else longest
            token, up = run_token(element, text), element.open
        else:
            token, up = element.open + (kind == CLOSE), element.up
        v = found.get(token)
        if v is None:
            found[token] = [1, place, up]
        else:
            v[0] += 1
    bit = (_hash(longest) >> 1) % 64
    return found, (1 << bit) - (1 << 64 if bit == 63 else 0)


@dataclass
class Template:
    """The ordered, nested classes of a group of pages."""

    place: dict[int, tuple[int, int]] = field(default_factory=dict)  #: tag -> its class, and its place in the class' order
    sizes: list[int] = field(default_factory=list)  #: of the classes
    repeats: list[bool] = field(default_factory=list)  #: whether a class may stand more than once on a page
    nest: list[tuple[int, int, int] | None] = field(default_factory=list)  #: the class around it, and the places of the tags between which it lies
    runs: frozenset[int] = frozenset()  #: text

    def inner(self) -> list[list[int]]:
        """Of each class those nested in it, at any depth."""
        out: list[list[int]] = [[] for _ in self.sizes]
        for c in range(len(self.sizes)):
            up = self.nest[c]
            while up:
                out[up[0]].append(c)
                up = self.nest[up[0]]
        return out


#: Of a token: number, vector, pages, count, mean first place, bitmap of its pages' longest runs, parent.
Row = tuple[int, object, int, int, float, int, int]


def deduce(rows: Iterable[Row], n: int, longest: int, support: float = 0.5, least_class: int = 2) -> Template:
    """The template of a group of ``n`` pages whose longest runs have the bitmap ``longest``."""
    vectors: dict[object, list[Row]] = {}
    ups: dict[int, int] = {}
    for row in rows:
        if row[2] >= support * n:
            vectors.setdefault(row[1], []).append(row)
            if row[0] > 0:
                ups[row[0]] = row[6]
    valid, runs, every = [], set(), longest % 2**64
    for members in vectors.values():
        tags = sorted((first, token) for token, *_, first, _, _ in members if token > 0)
        if len(tags) >= least_class:
            valid.append(([t for _, t in tags], any(m[3] > m[2] for m in members)))
            runs.update(m[0] for m in members if m[0] < 0 and (m[5] % 2**64).bit_count() >= max(6, 0.8 * every.bit_count()))

    def depth(token: int) -> int:
        k = 0
        while token := ups.get(token, 0):
            k += 1
        return k

    out = Template(runs=frozenset(runs))
    for tags, repeats in sorted(valid, key=lambda x: (min(map(depth, x[0])), x[0])):
        around = set()
        for t in tags:
            up = ups[t]
            while up and up not in out.place and up not in tags:
                up = ups.get(up, 0)
            if up not in tags:
                around.add(up)
        if len({out.place[u][0] if u else -1 for u in around}) > 1:
            continue
        nest = None
        if around and 0 not in around:
            places = [out.place[u] for u in around]
            c = places[0][0]
            ends = [out.place[u + 1][1] if out.place.get(u + 1, (-1,))[0] == c else out.sizes[c] for u in around]
            nest = (c, min(p for _, p in places), max(ends))
        out.place |= {t: (len(out.sizes), i) for i, t in enumerate(tags)}
        out.sizes.append(len(tags))
        out.repeats.append(repeats)
        out.nest.append(nest)
    return out


def alone(parts: Parts) -> Template:
    """The template of a page that has its group to itself."""
    found, bit = page_tokens(parts)
    return deduce(((t, count, 1, count, first, bit, up) for t, (count, first, up) in found.items()), 1, bit)


def text_of(parts: Parts, template: Template, inner: list[list[int]] | None = None) -> str:
    """The text of the page's slots that are content, in page order."""
    inner = template.inner() if inner is None else inner
    at = [-1] * len(template.sizes)

    def moves(token: int) -> bool:
        """Whether the walk goes on to the slot after this tag."""
        here = template.place.get(token)
        if here is None:
            return False
        c, i = here
        nest = template.nest[c]
        if nest and not nest[1] <= at[nest[0]] < nest[2]:
            return False
        if i <= at[c] and not (template.repeats[c] and (i == 0 or at[c] == template.sizes[c] - 1)):
            return False
        at[c] = i
        for d in inner[c]:
            at[d] = -1
        return True

    one = None if template.sizes else OTHER  # without a template: one slot
    content, rest, open_content, open_rest = [], [], [], []
    labels, main = [OTHER], False

    def end() -> None:
        for some, many in ((open_content, content), (open_rest, rest)):
            if some:
                if run := " ".join(entities.unescape("".join(some)).split()):
                    many.append(run)
                some.clear()

    for kind, element, text in parts:
        if kind == TEXT:
            label = labels[-1]
            if label != OUT and not (template.runs and run_token(element, text) in template.runs):
                (open_content if label == MAIN else open_rest).append(text)
            continue
        if element.tag not in INLINE:
            end()
        if kind == CLOSE:
            moves(element.open + 1)
            labels.pop()
            continue
        expected = moves(element.open)
        if kind == OPEN:
            if one is not None:
                label = one if element.tag not in RAW else OUT
            elif expected:
                label = element.label
            else:
                label = OUT if element.out else labels[-1]
            main = main or label == MAIN
            labels.append(label)
    end()
    return " ".join(content if main else rest)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, layout, token and its numbers, summed over some of a task's pages. The group's own row has the token 0."""
    mask, reader = 2**64 - 1, Reader()
    sums: dict[tuple[str, int, int], list[int]] = {}
    names = ["host", "layout", "token", "low", "high", "pages", "times", "first", "longest", "up"]
    kinds = [pa.string(), *[pa.int64()] * 9]

    def out() -> pa.RecordBatch:
        values = list(sums.values())
        signed = [v[0] - 2**64 if v[0] >= 2**63 else v[0] for v in values]
        columns = [*zip(*sums, strict=True), [x & 0xFFFFFFFF for x in signed], [x >> 32 for x in signed], *zip(*(v[1:] for v in values), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in slices(batches, "html", 4 << 20):
        for host, row, page in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "html")), strict=True):
            number = xxhash.xxh64_intdigest(row.to_bytes(8, "little", signed=True), 5)
            parts = list(reader.read(page or ""))
            found, bit = page_tokens(parts)
            found[0], group = [1, 0, 0], layout(parts)
            for t, (n, place, up) in found.items():
                v = sums.get((host, group, t))
                if v is None:
                    sums[host, group, t] = [n * number & mask, 1, n, place, bit, up]
                else:
                    v[0], v[1], v[2], v[3], v[4] = v[0] + n * number & mask, v[1] + 1, v[2] + n, v[3] + place, v[4] | bit
        if len(sums) > 150_000:
            yield out()
            sums.clear()
    if sums:
        yield out()


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """host, layout, n, longest and tokens (those on enough pages, with their numbers) of each group of two pages or more. ``pages``: host, html."""
    rows = pages.select("host", F.monotonically_increasing_id().alias("row"), "html")
    counted = rows.mapInArrow(_count, "host string, layout long, token long, low long, high long, pages long, times long, first long, longest long, up long")
    # the sum of both halves, each far from overflow, is the vector's sketch modulo 2 ** 64
    sums = counted.groupBy("host", "layout", "token").agg(*[F.sum(c).alias(c) for c in ("low", "high", "pages", "times", "first")], F.bit_or("longest").alias("longest"), F.max("up").alias("up"))
    frequent = sums.where("pages > 1 and (token >= 0 or bit_count(longest) >= 6)").withColumn("vector", F.struct(F.pmod("low", F.lit(2**32)).alias("l"), F.pmod(F.col("high") + F.shiftright("low", 32), F.lit(2**32)).alias("h")))
    frequent = materialise(frequent.drop("low", "high"), "page-tokens")
    groups = frequent.where("token = 0").select("host", "layout", F.col("pages").alias("n"), F.col("longest").alias("seen"))
    own = frequent.where("token <> 0").join(groups, ["host", "layout"]).where(F.col("pages") >= support * F.col("n"))
    row = F.struct("token", F.xxhash64("vector").alias("vector"), "pages", "times", (F.col("first") / F.col("pages")).alias("first"), "longest", "up")
    out = materialise(own.groupBy("host", "layout").agg(F.first("n").alias("n"), F.first("seen").alias("longest"), F.collect_list(row).alias("tokens")), "templates")
    discard(frequent)
    return out


def _deduced(group: dict) -> tuple[Template, list[list[int]]]:
    t = deduce((tuple(r.values()) for r in group["tokens"]), group["n"], group["longest"])
    return t, t.inner()


def _extractor(template_of):
    """Pages to texts; ``template_of`` gives a group's template, or None where the rows bring theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches, "html", 4 << 20):
            columns = {n: batch.column(n) for n in batch.schema.names}
            given = columns.pop("group").to_pylist() if "group" in columns else None
            columns.pop("layout", None)
            texts = []
            for i, (host, page) in enumerate(zip(columns.pop("host").to_pylist(), columns.pop("html").to_pylist(), strict=True)):
                parts = list(reader.read(page or ""))
                found = template_of(host, layout(parts)) if given is None else given[i] and _deduced(given[i])
                texts.append(text_of(parts, *(found or (alone(parts), None))))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*columns, "text", "n_chars"])

    return run


class _Templates:
    """The broadcast groups; a template is deduced once a task, when it is first asked for."""

    def __init__(self, shared) -> None:
        self.shared, self.groups, self.made = shared, None, {}

    def __call__(self, host: str, group: int) -> tuple[Template, list[list[int]]] | None:
        if self.groups is None:
            self.groups = {(g["host"], g["layout"]): g for g in pa.ipc.open_stream(self.shared.value).read_all().to_pylist()}
        key = (host, group)
        if key not in self.made:
            self.made[key] = _deduced(self.groups[key]) if key in self.groups else None
        return self.made[key]


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in slices(batches, "html", 4 << 20):
        groups = [layout(list(reader.read(p or ""))) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64())], names=[*batch.schema.names, "layout"])


def extract(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    found = templates(rows)
    size = found.agg(F.sum(F.size("tokens") * 56 + F.length("host") + 32)).first()[0] or 0
    schema = extended(rows.select("page_id", "url").schema, "text string, n_chars long")
    if size <= broadcast_bytes:
        sink = pa.BufferOutputStream()
        held = found.toArrow()
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        shared = pages.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        return rows.mapInArrow(_extractor(_Templates(shared)), schema)
    keyed = rows.mapInArrow(_with_layout, extended(rows.schema, "layout long"))
    grouped = found.select("host", "layout", F.struct("tokens", "n", "longest").alias("group"))
    return keyed.join(grouped, ["host", "layout"], "left").mapInArrow(_extractor(None), schema)
