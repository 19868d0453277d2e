"""Main text of web pages, with nearest-URL page differencing.

A page falls into blocks of text in page order, its lines. Differencing comes first: pages
of one host with the same unmarked lines (all lines, where none is unmarked) are one page, at its first URL; these stand in order of
host and URL path, every page is paired with its neighbours of the same host,
the pages' lines are aligned by their longest common subsequence, and lines
that a pair shares are template and go, from all its copies. Lines inside an article or main
element are text and stay, as neighbouring articles may share sentences; a neighbour that shares nearly all of
a page's unmarked text is a copy and says nothing of it. Structure decides what is left, boilerplate
that only one page has: blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
and those outside the article, if there is one. Only line hashes travel for differencing, over a
range partitioning that no host can overfill; ends of partitions meet in a
table of two rows for each partition.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.functions.batches import batched
from shardwright.llm.common import cut

# Elements that break text into blocks, that hold no text of the page, or that never do.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("script style noscript template iframe svg math object audio video canvas title noframes noembed xmp".split())
DROPPED_TAGS = set("nav header footer aside form button select textarea dialog menu head fieldset label".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that mark boilerplate.
DROPPED_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menubar sidebar footer header masthead topbar comment comments commentlist disqus respond reply replies share sharing social related breadcrumb breadcrumbs pagination pager newsletter subscribe signup login search popup modal overlay toolbar complementary contentinfo".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
DROPPED, OPEN, MAIN = 0, 1, 2
COPY_SHARE = 0.9
#: Bits of alignment history held at once; longer pages are aligned in halves.
LCS_BITS = 1 << 28


def _role(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element holds boilerplate, whether only as a header, and whether it holds the main text."""
    main, words = tag in MAIN_TAGS, set()
    if tag in DROPPED_TAGS:
        return True, tag == "header", False
    if not attrs or tag in ("html", "body"):
        return False, False, main
    if _HIDDEN.search(attrs):
        return True, False, False
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() in ("class", "id", "role"):
            words |= DROPPED_WORDS & set(re.split(r"[^a-z0-9]+", value))
        main |= (name.lower(), value) in (("role", "main"), ("itemprop", "articlebody"))
    if main:
        return False, False, True
    return bool(words), bool(words) and words <= {"header", "masthead"}, False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, DROPPED, OPEN or MAIN) of every non-empty block in page order."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, is dropped, is main, is a header in the main text
    standing: Counter = Counter()  # the stack's tags
    buffer: list[str] = []
    dropped = main = heading = headers = 0
    state = OPEN

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, state))
            buffer.clear()

    def pop(n: int) -> None:
        nonlocal dropped, main, heading, headers
        for tag, d, m, soft in stack[n:]:
            dropped -= d
            main -= m
            heading -= tag in HEADINGS
            headers -= soft
            standing[tag] -= 1
        del stack[n:]

    at = 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if not m[1] and tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        breaks = tag in BLOCK_TAGS
        if breaks:
            flush()
        if m[1]:
            if standing[tag] > 0:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        else:
            if breaks and stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if tag == "li" and stack and stack[-1][0] == "li":
                pop(len(stack) - 1)
            if not m[3].rstrip().endswith("/"):
                drop, header, holds = _role(tag, m[3])
                # A header inside the article holds its headings; they stay.
                soft = main > 0 and header
                entry = (tag, drop and not soft, holds and not dropped, soft)
                if breaks or entry[1]:
                    stack.append(entry)
                    standing[tag] += 1
                    headers += soft
                    dropped += entry[1]
                    main += entry[2]
                    heading += tag in HEADINGS
        now = DROPPED if dropped or (headers and not heading) else MAIN if main else OPEN
        if now != state:
            flush()
            state = now
    tail = page[at:]
    if tail not in ("", "<", "</"):
        buffer.append(tail)
    flush()
    if any(kind == MAIN for _, kind in out):
        out = [(text, kind if kind == MAIN else DROPPED) for text, kind in out]
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    held_a, held_b = Counter(a[lo : len(a) - hi]), Counter(b[lo : len(b) - hi])
    rows = [i for i in range(lo, len(a) - hi) if a[i] in held_b]
    cols = [x for x in b[lo : len(b) - hi] if x in held_a]
    middle = _aligned([a[i] for i in rows], cols) if rows else []
    return sorted([*range(lo), *range(len(a) - hi, len(a)), *(rows[k] for k in middle)])


def _vectors(x: list[int], y: list[int]) -> Iterator[int]:
    """For each row of ``x`` a bit vector over ``y``: a zero where the rows so far have one more common line with y up to there."""
    where: dict[int, list[int]] = {}
    for k, line in enumerate(y):
        where.setdefault(line, []).append(k)
    often: dict[int, int] = {}
    v = mask = (1 << len(y)) - 1
    for line in x:
        at = where.get(line, [])
        m = often.get(line)
        if m is None:
            flags = bytearray(len(y) // 8 + 1)
            for k in at:
                flags[k >> 3] |= 1 << (k & 7)
            m = int.from_bytes(flags, "little")
            if len(at) > 64:
                often[line] = m
        hit = v & m
        v = ((v + hit) | (v - hit)) & mask
        yield v


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Positions in ``x`` of a longest common subsequence: bit-parallel, and by halves of x beyond ``LCS_BITS``."""
    if not x or not y:
        return []
    if len(x) * len(y) > LCS_BITS and len(x) > 1:
        half = len(x) // 2

        def gains(rows: list[int], cols: list[int]) -> np.ndarray:
            """The subsequence's length with each prefix of ``cols``."""
            for v in _vectors(rows, cols):
                pass
            bits = np.unpackbits(np.frombuffer(v.to_bytes(len(cols) // 8 + 1, "little"), np.uint8), count=len(cols), bitorder="little")
            return np.concatenate([[0], np.cumsum(bits == 0)])

        cut_ = int((gains(x[:half], y) + gains(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _aligned(x[:half], y[:cut_]) + [half + k for k in _aligned(x[half:], y[cut_:])]
    history = list(_vectors(x, y))
    out, row, col = [], len(x), len(y)
    while row and col:
        if history[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or history[row - 1] >> (col - 1) & 1:
                col -= 1
                out.append(row)
    return out[::-1]


def shared_lines(lines: list[int], kinds: bytes, sizes: list[int], other: list[int]) -> list[int]:
    """Positions of the lines that ``other`` shares, but for main text, and for open ones if it is a copy by its open lines."""
    if not other or kinds.count(MAIN) == len(kinds):
        return []
    common = [i for i in common_lines(lines, other) if kinds[i] != MAIN]
    open_ = sum(n for n, k in zip(sizes, kinds) if k == OPEN)
    if open_ and sum(sizes[i] for i in common if kinds[i] == OPEN) >= COPY_SHARE * open_:
        return [i for i in common if kinds[i] != OPEN]
    return common


def address(url: str | None) -> tuple[str, str]:
    """(host, path with query) for ordering."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


_LINES = "id long, key long, page long, host string, path string, lines array<long>, kinds binary, sizes array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("page", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("kinds", pa.binary()), ("sizes", pa.list_(pa.int32()))])
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        rows = []
        for i, key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            found = blocks(page)
            host, path = address(url)
            lines = [digest(t) for t, _ in found]
            # Copies: the same open lines, or the same lines if none is open.
            same = [x for x, (_, k) in zip(lines, found) if k == OPEN] or [0, *lines]
            one = digest(f"{host}\n{same}") - (1 << 63)
            rows.append({"id": i, "key": key, "page": one, "host": host, "path": path, "lines": [x - (1 << 63) for x in lines], "kinds": bytes(k for _, k in found), "sizes": [len(t) for t, _ in found]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


_PAIRED = "key long, gone array<int>, part int, last boolean, host string, lines array<long>, kinds binary, sizes array<int>"
_PAIRED_ARROW = pa.schema([("key", pa.int64()), ("gone", pa.list_(pa.int32())), ("part", pa.int32()), ("last", pa.bool_()), ("host", pa.string()), ("lines", pa.list_(pa.int64())), ("kinds", pa.binary()), ("sizes", pa.list_(pa.int32()))])


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in URL order: (key, gone) where a neighbour takes lines away, and the partition's first and last rows."""
    part, previous, out = TaskContext.get().partitionId(), None, []

    def row(r: dict, gone: list[int] | None, last: bool | None) -> dict:
        rest = {f: r[f] if gone is None else None for f in ("host", "lines", "kinds", "sizes")}
        return {"key": r["key"], "gone": gone, "part": part, "last": last, **rest}

    for batch in batches:
        for r in batch.to_pylist():
            if previous is None:
                out.append(row(r, None, False))
            elif previous["host"] == r["host"]:
                for one, two in ((previous, r), (r, previous)):
                    if gone := shared_lines(one["lines"], one["kinds"], one["sizes"], two["lines"]):
                        out.append(row(one, gone, None))
            previous = r
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_PAIRED_ARROW)
            out = []
    if previous is not None:
        out.append(row(previous, None, True))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PAIRED_ARROW)


def _pair_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's last row beside the next one's first: (key, gone) of both."""
    schema = pa.schema([("key", pa.int64()), ("gone", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for one, two in ((r["x"], r["y"]), (r["y"], r["x"])):
                if gone := shared_lines(one["lines"], one["kinds"], one["sizes"], two["lines"]):
                    out.append({"key": one["key"], "gone": gone})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def template_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): positions of the blocks that a neighbour shares; ``pages`` has id, key, url, html. Pages that lose none have no row."""
    lines = pages.select("id", "key", "url", "html").mapInArrow(_lines, _LINES)
    lines = cut(lines)
    first = F.min_by(F.struct("host", "path", "id", "lines", "kinds", "sizes"), F.struct("path", "id", "key"))
    once = lines.groupBy("page").agg(first.alias("first")).select(F.col("page").alias("key"), "first.*")
    ordered = once.repartitionByRange("host", "path", "id", "key").sortWithinPartitions("host", "path", "id", "key")
    paired = cut(ordered.mapInArrow(_pair, _PAIRED))
    # Two rows for each partition, so this window is small.
    ends = paired.where("gone is null").withColumn("x", F.struct("key", "host", "lines", "kinds", "sizes"))
    beside = ends.withColumn("y", F.lead("x").over(W.orderBy("part", "last"))).where("last and y.host = x.host").select("x", "y")
    more = beside.mapInArrow(_pair_ends, "key long, gone array<int>")
    both = paired.where("gone is not null").select("key", "gone").union(more)
    found = both.groupBy(F.col("key").alias("page")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return lines.select("key", "page").distinct().join(found, "page").select("key", "gone")


_TEXTS = "id long, key long, url string, packed binary, places array<int>, n_blocks long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What structure leaves of a page, its blocks joined by line ends, which no block holds, and packed; the places of these blocks if they are open, so that differencing may take some."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("url", pa.string()), ("packed", pa.binary()), ("places", pa.list_(pa.int32())), ("n_blocks", pa.int64())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, key, url, page in zip(*batch.columns):
            found = blocks(page.as_py())
            text = "\n".join(t for t, k in found if k != DROPPED)
            yield i.as_py(), key.as_py(), url.as_py(), zlib.compress(text.encode(), 1), [i for i, (_, k) in enumerate(found) if k == OPEN] or None, len(found)

    for batch in batches:
        yield from batched(rows(batch), schema)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the open blocks that differencing takes."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int64()), ("n_shared", pa.int64())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, url, packed, places, n, gone in zip(*batch.columns):
            text, taken = zlib.decompress(packed.as_py()), set(gone.as_py() or ())
            if taken and places.is_valid:
                text = b"\n".join(t for t, at in zip(text.split(b"\n"), places.as_py()) if at not in taken)
            yield i.as_py(), url.as_py(), text, n.as_py(), len(taken)

    for batch in batches:
        yield from batched(rows(batch), schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars, n_blocks, n_shared) for every row: the main text, blocks joined by line ends.

    n_blocks: all blocks of the page; n_shared: those that differencing takes away.
    Null and empty html give an empty text; a null url is a page of no host.
    Pages cut off inside a tag or an element keep what is there; a tag with an
    open quote ends at the next bracket. Rows with equal
    id, url and html share their result; repeated rows stay.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    gone = template_lines(base)
    # Dropped blocks stay behind and the others travel packed: rows of this join are smaller than the text that comes out.
    texts = base.mapInArrow(_texts, _TEXTS).join(gone, "key", "left").select("id", "url", "packed", "places", "n_blocks", "gone")
    out = texts.mapInArrow(_left, "id long, url string, text string, n_blocks long, n_shared long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_shared")
