"""WARC archives of web pages, and a globally ordered index of their captures.

Every page becomes a record of its own gzip member, so a record can be read by
its offset alone. Tasks pack members into chunks of bytes, and Spark's writer lays chunks
down in the shared folder, a few for each archive, so that archives have a size in bytes.
The writer is that of text files, which passes bytes through and ends a value with a
separator: a chunk goes without its last byte, which is the zero that ends the last member's length, and
the separator is that zero. Payloads that repeat are written once; the others are
revisit records. Archives are read back whole files at a time and parsed by their
content lengths; the payload of every response is digested again.

The captures of an archive are a run, sorted by URL key, time and page. An
external merge makes one order of all runs: boundaries from a sample of keys
cut the key space into ranges, every run is cut at the boundaries, and a range's
segments go through a k-way loser tree. A URL that a third of the captures share
is cut by time and page as well, so no range depends on one key.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.llm.common import cut, ensure_checkpoint_dir

MIN_REVISIT_BYTES = 1000
#: Bytes of a chunk (or one record), chunks of an archive, and bytes of a record in one member: fewer than 16 MB, so that a member's length ends with a zero.
CHUNK_BYTES, ARCHIVE_CHUNKS, MEMBER_BYTES = 4 << 20, 4, 8 << 20
#: Captures of one range, about; ranges at most, keys sampled for each.
RANGE_CAPTURES, MAX_RANGES, SAMPLE_PER_RANGE = 20_000, 10_000, 32
#: Repeated payloads whose table (some 16 MB) is broadcast; more join by shuffle, each in so many parts.
BROADCAST_DIGESTS, DIGEST_PARTS = 200_000, 16
FIRST_CAPTURE = 1_704_067_200  # pages carry no time: captures are a second apart from here on

ENTRY = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
KEY = slice(0, 3)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; no scheme, port, fragment or www."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "", re.I)
    if not m:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


class LoserTree:
    """k-way merge of sorted sequences: inner nodes keep the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.tree = [-1] * max(1, k)
        for i in range(k):
            self._replay(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes out before run b's; ended runs lose, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            if self.tree[node] < 0 and building:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, object]]:
        """(run, item) in order."""
        while self.runs and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def with_digests(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, keep): keep is the page that answers for an equal payload, else null."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    long = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    same = cut(base.where(long).groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").drop("n"))
    if same.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        return base.join(F.broadcast(same), "payload_digest", "left")  # no payload is shuffled
    # Short payloads stay where they are, and no payload that repeats often meets in one task.
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(DIGEST_PARTS)).cast("int")
    parts = same.select("payload_digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(DIGEST_PARTS - 1))).alias("part"))
    joined = base.where(long).withColumn("part", part).join(parts, ["payload_digest", "part"], "left").drop("part")
    return joined.unionByName(base.where(~long).withColumn("keep", F.lit(None).cast("long")))


def records(captures: DataFrame) -> Column:
    """A record's text without the two line ends that end it."""
    crlf = "\r\n"
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes"), F.lit(crlf * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), name(F.col("keep")), F.lit(crlf))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{crlf}WARC-Date: "), date,
        F.lit(f"{crlf}WARC-Target-URI: "), uri,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(crlf), more,
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length(http) + F.octet_length(body),
        F.lit(crlf * 2), http, body,
    )


def members(record: bytes) -> bytes:
    """A record as a gzip member, or several if it is long; the last byte is zero."""
    return b"".join(gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(record), MEMBER_BYTES))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records' texts to chunks of members, each without its last byte."""
    held, size = [], 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["chunk"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            held.append(members(text.as_py() + b"\r\n\r\n"))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for every row of ``pages`` to gzipped archives in ``folder``."""
    captures = with_digests(pages, id_col, url_col, html_col)
    packed = captures.select(records(captures).alias("value")).mapInArrow(_chunks, "chunk binary")
    packed.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_CHUNKS).text(folder)


def _member(content: memoryview, offset: int) -> tuple[bytes, int]:
    """The data of the gzip member at an offset, and where it ends."""
    stream, out, at = zlib.decompressobj(31), [], offset
    while not stream.eof:
        if at >= len(content):
            raise ValueError(f"torn member at {offset}")
        out.append(stream.decompress(content[at : at + (1 << 16)]))
        at = min(len(content), at + (1 << 16))
    return b"".join(out), at - len(stream.unused_data)


def read_record(content: bytes, offset: int, name: str = "") -> tuple[tuple, bytes, int]:
    """(capture as a tuple of ENTRY, payload, where the next record begins) of the record at an offset; a wrong digest or a torn record is an error."""
    view = memoryview(content)
    try:
        data, end = _member(view, offset)
        while (blank := data.find(b"\r\n\r\n")) < 0:
            more, end = _member(view, end)
            data += more
        if not data.startswith(b"WARC/1.1\r\n"):
            raise ValueError("no record")
        header = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in data[:blank].decode().split("\r\n")[1:])}
        length, parts, size = int(header["content-length"]), [data[blank + 4 :]], len(data) - blank - 4
        while size < length + 4:
            more, end = _member(view, end)
            parts.append(more)
            size += len(more)
    except (zlib.error, ValueError) as e:
        raise ValueError(f"{name}: no record or a torn record at {offset}: {e}") from e
    block = b"".join(parts)
    if size != length + 4 or block[length:] != b"\r\n\r\n":
        raise ValueError(f"{name}: torn record at {offset}")
    http, _, payload = block[:length].partition(b"\r\n\r\n")
    kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
    declared = int(re.search(rb"content-length: (\d+)", http, re.I)[1])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != declared):
        raise ValueError(f"{name}: wrong payload at {offset}")
    page = lambda k: int(n) if (n := header.get(k, "").removeprefix("<urn:x-page:").rstrip(">")) else None
    url = header["warc-target-uri"]
    return (url_key(url), header["warc-date"], page("warc-record-id"), url, kind, page("warc-refers-to"), declared, digest, name, offset), payload, end


def read_archive(content: bytes, name: str) -> Iterator[tuple]:
    """The captures of one archive, in its order, as tuples of ENTRY."""
    at = 0
    while at < len(content):
        entry, _, at = read_record(content, at, name)
        yield entry


def _sortable(entry: tuple) -> tuple:
    return entry[0], entry[1], (entry[2] is not None, entry[2] or 0)


def boundaries(pages: DataFrame, id_col: str, url_col: str, ranges: int) -> list[tuple]:
    """Sorted keys that cut the captures into about ``ranges`` equal parts, from a sample of bounded size."""
    if ranges < 2:
        return []
    picked = pages.select(F.col(url_col).cast("string").alias("u"), F.col(id_col).cast("long").alias("p")).orderBy(F.xxhash64("p", "u"), "p", "u").limit(ranges * SAMPLE_PER_RANGE)
    time = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod("p", F.lit(1_000_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    keys = sorted({_sortable((url_key(r["u"]), r["t"], r["p"])) for r in picked.select("u", "p", time.alias("t")).collect()})
    return [keys[len(keys) * k // ranges] for k in range(1, min(ranges, len(keys)))]


def _segments(cuts: list[tuple]):
    """Kernel over archives (path, content): a row (part, run, entries) for each range that the archive's sorted run touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                entries = sorted(read_archive(content.as_py(), name), key=_sortable)
                keys = [_sortable(e) for e in entries]
                at = [0, *(bisect_left(keys, c) for c in cuts), len(entries)]
                parts = [(k, entries[lo:hi]) for k, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
                rows = [{"part": k, "run": name, "entries": [dict(zip(FIELDS, e)) for e in es]} for k, es in parts]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)

    return run


_TYPES = {"string": pa.string(), "long": pa.int64()}
_ENTRY = [(f.split()[0], _TYPES[f.split()[1]]) for f in ENTRY.split(", ")]
_SEGMENT = pa.schema([("part", pa.int32()), ("run", pa.string()), ("entries", pa.list_(pa.struct(_ENTRY)))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by range come in; every range goes through a loser tree."""
    schema = pa.schema([*_ENTRY, ("index_range", pa.int32()), ("index_rank", pa.int64())])
    held: list[list[dict]] = []
    part = None

    def merged() -> Iterator[pa.RecordBatch]:
        runs = [iter([(_sortable(tuple(e[f] for f in FIELDS)), n) for n, e in enumerate(es)]) for es in held]
        out = []
        for rank, (run, (_, n)) in enumerate(LoserTree(runs)):
            out.append({**held[run][n], "index_range": part, "index_rank": rank})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                yield from merged()
                held, part = [], row["part"]
            held.append(row["entries"])
    yield from merged()


def read_index(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The captures of all archives in ``folder`` in global order: (index_range, index_rank) ascending."""
    spark = pages.sparkSession
    n = pages.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_CAPTURES)))
    cuts = boundaries(pages, id_col, url_col, ranges)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    segments = archives.mapInArrow(_segments(cuts), f"part int, run string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    return segments.repartition(ranges, "part").sortWithinPartitions("part", "run").mapInArrow(_merge, f"{ENTRY}, index_range int, index_rank long")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives, reads them back, and returns a row for each record in global order of captures.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key and capture_rank, the place in the whole index from 0.
    Null html is an empty payload, a null url the empty one (line ends in a url are
    escaped), a null id an unnamed record. Rows that share the largest id of equal
    payloads are all responses; where no row of equal payloads has an id, all are.
    """
    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col, url_col, html_col)
    index = cut(read_index(pages, folder, id_col, url_col))
    # A row for each range, MAX_RANGES at most, so the running sum is small and may be broadcast.
    held = index.groupBy("index_range").agg(F.count("*").alias("n"))
    first = held.select("index_range", F.coalesce(F.sum("n").over(W.orderBy("index_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = index.join(F.broadcast(first), "index_range")
    return placed.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", (F.col("first") + F.col("index_rank")).alias("capture_rank"))


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keep FROM p),
h AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)) AS rest FROM k),
o AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*[.]', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM h)
SELECT page_id, url_key, row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) - 1 AS capture_rank, payload_bytes, payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM o"""
