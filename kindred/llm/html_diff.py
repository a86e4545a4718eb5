"""Main text of web pages by nearest-URL page differencing.

Pages stand in the order of host, path with query, and id. Each is aligned with the ``NEAR`` other pages before it and
after it by longest common subsequences of their lines: a line is a block's text together with the elements that it
is in, or the opening of an element. A run of pages of one html counts as one page. The alignments decide:

* From the page's root down, the element whose own text, that which is not shared, is most over all compared
  pages is the one that holds the article.
* Elements beside it whose opening is shared with at least half of the compared pages, and which hold at most
  ``SMALL`` of its own text, are template, and go with what is in them: menus, adverts and footers whose words
  change from page to page.
* Other lines beside it that the page shares with its nearest page (of the same host, by the common part of their
  paths; near copies are passed over) go too. Lines within it go only if ``TEMPLATE`` of these pages
  share them: what some articles have in common stays.

Markup is a guard: text under elements that hold no article by their meaning in HTML (menus, asides,
footers, forms, scripts, what is hidden) is left out, and lines under an article or main element are not
deleted. There is no list of class names.

The order is cut into contiguous blocks of about ``block_pages``; a block gets copies of the pages next to
it, so where it is cut changes no text. A task reads its blocks in order and holds the lines of 2 * NEAR + 1
pages.

Defined cases: a null html is empty and gives an empty text; a null url has the empty host and path;
repeated page rows are each returned and not compared with each other. A page with fewer than two others
on its host has its frame decided with the next pages of other hosts too; alone on its host it has no
shared lines; without any other page all its lines outside the guarded elements are kept. Other columns
are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import Shelf, slices

# Elements by their part in a page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button head title audio video map datalist".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
ROLE = re.compile(r"banner|navigation|complementary|contentinfo|search|form|dialog|alert|menu|menubar|note", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[^A-Za-z/!?]|$)|</(?=[^A-Za-z])[^>]*>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "iframe", "noscript")}
WHITE = re.compile(r"\s+")

HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DIGITS = re.compile(r"[0-9]+")

OUT, FREE, BODY = 0, 1, 2
SAMPLES = 200_000
PARTITION_BYTES = 32 << 20
NEAR, SMALL, COPY, TEMPLATE = 3, 0.2, 0.7, 0.8
TABLE_BITS = 1 << 27


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def _part(name: str, a: dict[str, str], inside: int, guard: bool) -> int:
    """Of an element: out of the article, free, or the article's body. What is out stays out."""
    if inside == OUT or name in SKIPPED:
        return OUT
    if a and ("hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))):
        return OUT
    if not guard:
        return FREE
    if name in ASIDE and not (name == "header" and inside == BODY):
        return OUT
    role = a.get("role", "")
    if role == "main" or a.get("itemprop") == "articleBody":
        return BODY
    if name not in ("html", "body", *MAIN) and ROLE.fullmatch(role):
        return OUT
    return BODY if name in MAIN else inside


def _sign(name: str, a: dict[str, str]) -> str:
    """An element as part of a path: its name, classes and id, with any number for each number."""
    marks = ".".join(a.get("class", "").split()) + "#" + a.get("id", "") if name not in ("html", "body") else "#"
    return name if marks == "#" else DIGITS.sub("0", f"{name}.{marks}")


Line = tuple[str, int, tuple[str, ...]]


def lines_of(page: str, guard: bool = True) -> list[Line]:
    """(text, part, path of block elements) of each block of the page, in page order, but for what is out."""
    out: list[Line] = []
    stack: list[tuple[str, int, tuple[str, ...]]] = []
    text: list[str] = []
    part, path, at, n, began = FREE, (), 0, len(page), (FREE, ())

    def close() -> None:
        if text:
            line = WHITE.sub(" ", "".join(text)).strip()
            if line:
                out.append((line, *began))
            text.clear()

    def above(depth: int) -> tuple[int, tuple[str, ...]]:
        return stack[depth - 1][1:] if depth else (FREE, ())

    while at < n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at and part != OUT:
            began = began if text else (part, path)
            text.append(entities.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            if m[0] == "<" and part != OUT:
                began = began if text else (part, path)
                text.append("<")
            continue
        name = name.lower()
        block = name not in INLINE
        if m[1]:
            if name in VOID:
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if block:
                close()
            if depth is not None and (block or all(x[0] in INLINE for x in stack[depth:])):
                if not block:
                    changed = above(depth)[0]
                    if OUT not in (changed, part) and changed != part:
                        close()
                del stack[depth:]
                part, path = above(len(stack))
            continue
        if name == "br":
            if text:
                text.append(" ")
            continue
        if name in VOID:
            if block:
                close()
            continue
        if block:
            close()
            # an open paragraph ends at any block, an open item at the next one
            want = CLOSES.get(name) or frozenset(("p",))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in want or stack[i][0] == "p":
                    del stack[i:]
                    part, path = above(len(stack))
                    break
                if stack[i][0] not in INLINE:
                    break
        a = _attributes(m[3]) if m[3] and part != OUT else {}
        now = _part(name, a, part, guard)
        if now != part and (block or now != OUT):
            close()
        if m[3].endswith("/") and name not in SKIPPED and not block:
            continue
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            if end or name in ("script", "style"):
                at = end.end() if end else n
                continue
        part, path = now, (*path, _sign(name, a)) if block and now != OUT else path
        stack.append((name, part, path))
    close()
    return out


def _rows(x: list, y: list) -> list[int]:
    """The bit-parallel table of the longest common subsequence: a zero bit of row j at i says that the subsequence of x[:i+1] and y[:j+1] grows by one at i."""
    where: dict = {}
    for bit, item in enumerate(x):
        where[item] = where.get(item, 0) | 1 << bit
    full, rows = (1 << len(x)) - 1, []
    v = full
    for item in y:
        u = v & where.get(item, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _last_row(x: list, y: list) -> np.ndarray:
    """Lengths of the longest common subsequences of y and each beginning of x."""
    where: dict = {}
    for bit, item in enumerate(x):
        where[item] = where.get(item, 0) | 1 << bit
    full = v = (1 << len(x)) - 1
    for item in y:
        u = v & where.get(item, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; its table takes len(x) * len(y) bits, and y is halved where that is over TABLE_BITS."""
    if len(x) * len(y) > TABLE_BITS and len(y) > 1:
        half = len(y) // 2
        cut = int(np.argmax(_last_row(x, y[:half]) + _last_row(x[::-1], y[half:][::-1])[::-1]))
        return _aligned(x[:cut], y[:half]) + [(i + cut, j + half) for i, j in _aligned(x[cut:], y[half:])]
    rows, found = _rows(x, y), []
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j > 0 and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            found.append((i, j))
            i, j = i - 1, j - 1
    return found[::-1]


def shared(a: list, b: list) -> tuple[set[int], set[int]]:
    """Places in a and in b of a longest common subsequence. Equal ends, and what only one has, are set apart first."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    one, two = {*range(lo), *range(len(a) - hi, len(a))}, {*range(lo), *range(len(b) - hi, len(b))}
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    if common:
        x, y = ([i for i in range(lo, len(s) - hi) if s[i] in common] for s in (a, b))
        for i, j in _aligned([a[i] for i in x], [b[j] for j in y]):
            one.add(x[i])
            two.add(y[j])
    return one, two


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def items_of(lines: list[Line]) -> list[tuple[tuple, int | None]]:
    """What is aligned, in page order: openings of elements (None, path), and lines (text, path) with their number."""
    out: list[tuple[tuple, int | None]] = []
    before: tuple[str, ...] = ()
    for i, (text, _, path) in enumerate(lines):
        same = 0
        while same < min(len(path), len(before)) and path[same] == before[same]:
            same += 1
        # of two lines of one path the second has an element of its own
        for d in range(len(path) - 1 if path == before and path else same, len(path)):
            out.append(((None, path[: d + 1]), None))
        out.append(((text, path), i))
        before = path
    return out


class Page:
    """Pages of one html, next to each other: its lines, its first and last path, and its alignments."""

    def __init__(self, host: str, digest: int, html: str, guard: bool):
        self.host, self.digest, self.lines = host, digest, lines_of(html, guard)
        self.items = items_of(self.lines)
        self.keys = [k for k, _ in self.items]
        self.first = self.last = ""
        self.rows: list = []
        self.found: dict[int, tuple[set, set, set]] = {}

    def with_(self, other: Page) -> tuple[set[int], set[int], set[tuple[str, ...]]]:
        """Lines of this page and of the other that they share, and the paths of shared openings."""
        if id(other) not in self.found:
            one, two = shared(self.keys, other.keys)
            mine, theirs = ({n for i in own if (n := page.items[i][1]) is not None} for own, page in ((one, self), (two, other)))
            opened = {self.keys[i][1] for i in one if self.items[i][1] is None}
            self.found[id(other)], other.found[id(self)] = (mine, theirs, opened), (theirs, mine, opened)
        return self.found[id(other)]


def frame(page: Page, others: list[Page]) -> tuple[set[tuple[str, ...]], tuple[str, ...]]:
    """Paths of the elements of the page's frame, and that of the element which holds the article."""
    out: set[tuple[str, ...]] = set()
    node: tuple[str, ...] = ()
    often = Counter(i for x in others for i in page.with_(x)[0])
    compared = [(page, {i for i, n in often.items() if 2 * n >= len(others)}), *((x, page.with_(x)[1]) for x in others)]
    while True:
        depth, own, deeper = len(node), Counter(), set()
        spans: list[dict[tuple[str, ...], list[int]]] = []
        for x, gone in compared:
            span: dict[tuple[str, ...], list[int]] = {}
            for i, (text, _, path) in enumerate(x.lines):
                if path[:depth] == node:
                    child = path[: depth + 1] if len(path) > depth else (*node, "")
                    if len(path) > depth + 1:
                        deeper.add(child)
                    own[child] += 0 if i in gone else len(text)
                    span.setdefault(child, [i, i])[1] = i
            spans.append(span)
        if not own:
            return out, node
        best = max(own, key=lambda c: (own[c], c))

        def outside(span: dict, child: tuple[str, ...], best=best) -> bool:
            return child in span and (best not in span or span[child][1] < span[best][0] or span[child][0] > span[best][1])

        for child in spans[0]:
            if child != best and child[-1].split(".")[0] not in HEADING and own[child] <= SMALL * own[best] and outside(spans[0], child):
                votes = sum(child in page.with_(x)[2] for x in others)
                if votes and 2 * votes >= len(others):
                    out.add(child)
        parts = {part for _, part, path in page.lines if path[: depth + 1] == best}
        if best not in deeper or parts == {BODY}:
            return out, best
        node = best


def texts_of(pages: list[Page], at: int) -> list[str]:
    """Main texts of the rows of pages[at], by the pages around it."""
    page = pages[at]
    around = [(i, pages[i]) for i in range(max(0, at - NEAR), min(len(pages), at + NEAR + 1)) if i != at]
    host = [(i, x) for i, x in around if x.host == page.host]
    cut, best = frame(page, [x for _, x in (host if len(host) > 1 else around)])
    heads = lambda path: path and path[-1].split(".")[0] in HEADING and path[:-1] == best[:-1]
    inside = {i for i, (_, _, path) in enumerate(page.lines) if path[: len(best)] == best or (*path, "") == best or heads(path)}
    size = sum(len(page.lines[i][0]) for i in inside)

    def copy(x: Page) -> bool:
        return bool(inside) and sum(len(page.lines[i][0]) for i in page.with_(x)[0] & inside) >= COPY * size

    usable = [(i, x) for i, x in host if not copy(x)]
    shares = Counter(i for _, x in usable for i in page.with_(x)[0] & inside)
    common = {i for i, n in shares.items() if n >= TEMPLATE * len(usable)}
    framed = {i for i, (_, part, path) in enumerate(page.lines) if part != BODY and any(path[:d] in cut for d in range(1, len(path) + 1)) or part != BODY and (*path, "") in cut}
    made: dict[int, str] = {}
    texts = []
    for path, *_ in page.rows:
        near = min(((-common_prefix(path, x.last if i < at else x.first), abs(i - at), i) for i, x in usable), default=(0, 0, -1))[2]
        if near not in made:
            gone = (page.with_(pages[near])[0] - inside if near >= 0 else set()) | common
            made[near] = "\n\n".join(t for i, (t, part, _) in enumerate(page.lines) if part == BODY or not (i in gone or i in framed))
        texts.append(made[near])
    return texts


class Window:
    """Pages of one block as they come; rows are given back when the pages after them are known."""

    def __init__(self, guard: bool):
        self.pages: list[Page] = []
        self.guard, self.at = guard, 0

    def add(self, host: str, path: str, digest: int, html: str | None, row) -> None:
        last = self.pages[-1] if self.pages else None
        if last is None or (last.host, last.digest) != (host, digest):
            last = Page(host, digest, html or "", self.guard)
            last.first = path
            self.pages.append(last)
        last.last = path
        if row is not None:
            last.rows.append((path, row))

    def done(self, whole: bool):
        """(row, text) of the pages with NEAR pages after them, or of all."""
        while self.at < len(self.pages) - (0 if whole else NEAR + 1):
            page = self.pages[self.at]
            if page.rows:
                yield from zip((r for _, r in page.rows), texts_of(self.pages, self.at), strict=True)
            page.rows = []
            self.at += 1
            if self.at > NEAR:
                left = self.pages.pop(0)
                for x in self.pages:
                    x.found.pop(id(left), None)
                self.at -= 1


def main_texts(pages: list[tuple[str, str | None]], guard: bool = True) -> list[str]:
    """Main texts of the pages of a host, given as (path, html)."""
    order = sorted(range(len(pages)), key=lambda i: (pages[i][0], pages[i][1] or "", i))
    texts, window = [""] * len(pages), Window(guard)
    for i in order:
        window.add("", pages[i][0], hash(pages[i][1] or ""), pages[i][1], i)
    for i, text in window.done(True):
        texts[i] = text
    return texts


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, and path with query."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    return host, F.concat(path, F.regexp_extract(bare, r"^[^?#]*(\?[^#]*)", 1))


def key_of(host: str, path: str, page_id, digest: int) -> tuple:
    """What pages are ordered by."""
    return host, path, (page_id is not None, page_id) if page_id is not None else (False,), digest


def _runs(keys: list[tuple]) -> list[tuple]:
    """Of keys in order, the first of each run of one html on one host; at most NEAR + 1."""
    out: list[tuple] = []
    for k in keys:
        if not out or (k[0], k[3]) != (out[-1][0], out[-1][3]):
            if len(out) > NEAR:
                break
            out.append(k)
    return out


def edges(heads: dict[int, tuple[list[tuple], list[tuple]]]) -> dict[tuple, list[int]]:
    """Blocks that need a copy of a page, by its key. ``heads`` has, of each block, the runs it begins with and, last first, those it ends with."""
    out: dict[tuple, list[int]] = {}
    for side, step in ((1, 1), (0, -1)):
        known: deque[tuple] = deque(maxlen=NEAR + 1)  # what lies on this side, nearest first
        for block in sorted(heads, reverse=step < 0):
            for k in known:
                out.setdefault(k, []).append(block)
            # the runs that the block ends with on that side, then those that were known before
            known = deque(_runs([*heads[block][side], *known]), maxlen=NEAR + 1)
    return out


def extract(pages: DataFrame, block_pages: int = 256, guard: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    spark, key = pages.sparkSession, ["host", "path", "page_id", "digest"]
    shelf = Shelf(spark, "pages")
    host, path = host_and_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(html_col).alias("digest"), F.col(html_col).alias("html"))
    id_type = pages.schema[id_col].dataType.simpleString()
    keys = shelf.put(keyed.select(*key, F.octet_length("html").alias("size")), "keys")
    # blocks begin at evenly taken keys of a sample by hash, of at most about SAMPLES keys
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    keys, rate = keys.select(key), max(1, block_pages // 8, -(-n // SAMPLES))
    sample = sorted({key_of(*r) for r in keys.where(F.pmod(F.xxhash64(*key), F.lit(rate)) == 0).collect()})
    bounds = spark.sparkContext.broadcast(sample[:: max(1, block_pages // rate)])
    block_of = F.udf(lambda *k: bisect.bisect_right(bounds.value, key_of(*k)), "long", useArrow=True)

    def head(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in key), strict=True), key=lambda k: key_of(*k))
        block = table["block"][0].as_py()
        kept = [(block, side, *k) for side, order in enumerate((rows, rows[::-1])) for k in _runs(order)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.int64(), *(table.schema.field(c).type for c in key)), strict=True)], ["block", "side", *key])

    heads: dict[int, tuple[list, list]] = {}
    found = keys.withColumn("block", block_of(*key)).groupBy("block").applyInArrow(head, f"block long, side long, host string, path string, page_id {id_type}, digest long")
    for r in found.collect():
        heads.setdefault(r[0], ([], []))[r[1]].append(key_of(*r[2:]))
    for ends in heads.values():
        ends[0].sort()
        ends[1].sort(reverse=True)
    shelf.drop("keys")
    copies = spark.sparkContext.broadcast(edges(heads))

    def places(*k):
        """The page's block, and as -1 - block those that need a copy of it."""
        one = key_of(*k)
        return [bisect.bisect_right(bounds.value, one), *(-1 - b for b in copies.value.get(one, ()))]

    dealt = keyed.withColumn("place", F.explode(F.udf(places, "array<long>", useArrow=True)(*key)))
    dealt = dealt.select("page_id", "url", "host", "path", "digest", "html", (F.col("place") >= 0).alias("own"), F.when(F.col("place") >= 0, F.col("place")).otherwise(-1 - F.col("place")).alias("block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    ordered = dealt.repartition(parts, "block").sortWithinPartitions("block", "host", "path", F.col("page_id").asc_nulls_first(), "digest")

    def run(batches):
        held, size, block, window = [], 0, None, Window(guard)
        types = pa.schema([("page_id", id_arrow), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

        def flushed():
            nonlocal size
            columns = [[r[0] for r, _ in held], [r[1] for r, _ in held], [t for _, t in held], [len(t) for _, t in held]]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

        for batch in slices(batches, 64):
            for page_id, url, at_host, at_path, digest, html, own, at_block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ended = window.done(True) if at_block != block else window.done(False)
                for row, text in ended:
                    held.append((row, text))
                    size += len(text) + 200
                if at_block != block:
                    block, window = at_block, Window(guard)
                window.add(at_host, at_path, digest, html, (page_id, url) if own else None)
                if size > 4 << 20:
                    yield flushed()
        held += window.done(True)
        yield flushed()

    id_arrow = to_arrow_type(pages.schema[id_col].dataType)
    return ordered.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
