"""Small byte kernels over one container: signatures, zero runs, and entries read two ways."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import numpy as np

BLOCK = 4096
_SIGNATURES = re.compile(rb"PK(\x03\x04|\x01\x02|\x05\x06)")  # none begins inside another; a plain beginning lets the search skip
LOCAL, LOCAL_SIZE = "<4s5H3I2H", 30
END, END_SIZE = "<4s4H2IH", 22


def zero_runs(data: bytes) -> list[tuple[int, int]]:
    """Ranges [start, end) of zeros that fill at least one aligned block, to the byte, at most a block beyond it."""
    if not data:
        return []
    a = np.frombuffer(data, np.uint8)
    starts = np.arange(0, len(a), BLOCK)
    empty = np.add.reduceat(a != 0, starts, dtype=np.int64) == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], empty.astype(np.int8), [0]])))
    out = []
    for first, last in zip(edge[::2], edge[1::2]):
        lo, hi = int(first) * BLOCK, min(int(last) * BLOCK, len(a))
        back = data[max(0, lo - BLOCK) : lo]
        ahead = data[hi : hi + BLOCK]
        out.append((lo - len(back) + len(back.rstrip(b"\0")), hi + len(ahead) - len(ahead.lstrip(b"\0"))))
    return out


def structure(data: bytes) -> dict:
    """Signature offsets, zero runs and the last end record."""
    offsets: dict[bytes, list[int]] = {b"\x03\x04": [], b"\x01\x02": [], b"\x05\x06": []}
    for m in _SIGNATURES.finditer(data):
        offsets[m[1]].append(m.start())
    end = None
    if offsets[b"\x05\x06"] and len(data) - (at := offsets[b"\x05\x06"][-1]) >= END_SIZE:
        _, _, _, _, total, cd_size, cd_offset, comment = struct.unpack_from(END, data, at)
        end = {"offset": at, "total_entries": total, "cd_offset": cd_offset, "cd_size": cd_size, "is_consistent": cd_offset + cd_size == at, "comment_length": comment}
    return {"zero_runs": [{"start": a, "end": b} for a, b in zero_runs(data)], "lfh_offsets": offsets[b"\x03\x04"], "cd_sig_count": len(offsets[b"\x01\x02"]), "eocd": end}


def entry(name: str, offset: int, size: int, ok: bool, error: str | None, crc: int | None = None, packed: int | None = None) -> dict:
    return {"name": name, "header_offset": offset, "file_size": size, "ok": ok, "error": error, "crc": crc, "comp_size": packed}


def index_entries(data: bytes) -> list[dict] | None:
    """Entries that the index lists, each read to its end; None if there is no usable index."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except Exception:
        return None
    out = []
    with archive:
        for info in archive.infolist():
            try:
                with archive.open(info) as f:
                    while f.read(1 << 20):
                        pass
                error = None
            except Exception as e:
                error = type(e).__name__
            out.append(entry(info.filename, info.header_offset, info.file_size, error is None, error, info.CRC, info.compress_size))
    return out


def inflated(data: memoryview | bytes) -> tuple[bytes, int] | None:
    """(output, compressed length) of a raw deflate stream; None if the data end first; bad data raise."""
    z = zlib.decompressobj(-15)
    out = z.decompress(data) + z.flush()
    return (out, len(data) - len(z.unused_data)) if z.eof else None


def header_entries(data: bytes) -> list[dict]:
    """Entries found by their local headers alone, in file order.

    After an entry with known bounds the search goes on behind it, after a
    false or broken one behind its signature; an entry cut off by the end stops it.
    """
    out: list[dict] = []
    view, at = memoryview(data), data.find(b"PK\x03\x04")
    while at >= 0:
        found, resume = _header_entry(data, view, at)
        if found:
            out.append(found)
        at = data.find(b"PK\x03\x04", resume) if resume is not None else -1
    return out


def _header_entry(data: bytes, view: memoryview, at: int) -> tuple[dict | None, int | None]:
    skip = at + 4
    if len(data) - at < LOCAL_SIZE:
        return None, skip
    _, _, flags, method, _, _, crc, packed, size, n_name, n_extra = struct.unpack_from(LOCAL, data, at)
    raw = data[at + LOCAL_SIZE : at + LOCAL_SIZE + n_name]
    if not 1 <= n_name <= 512 or len(raw) < n_name or method not in (0, 8):
        return None, skip
    try:
        name = raw.decode()
    except UnicodeDecodeError:
        return None, skip
    body = at + LOCAL_SIZE + n_name + n_extra
    if flags & 8:
        return _streamed_entry(data, view, at, name, method, body)
    if body + packed > len(data):
        return entry(name, at, size, False, "Truncated", crc, packed), None
    try:
        payload = bytes(view[body : body + packed]) if method == 0 else zlib.decompressobj(-15).decompress(view[body : body + packed])
    except zlib.error as e:
        return entry(name, at, size, False, type(e).__name__, crc, packed), skip
    good = zlib.crc32(payload) == crc
    return entry(name, at, size, good, None if good else "BadCRC", crc, packed), body + packed


def _streamed_entry(data: bytes, view: memoryview, at: int, name: str, method: int, body: int) -> tuple[dict, int | None]:
    """An entry whose sizes follow its data."""
    if method != 8:
        return entry(name, at, 0, False, "Unsupported"), at + 4
    try:
        got = inflated(view[body:])
    except zlib.error as e:
        return entry(name, at, 0, False, type(e).__name__), at + 4
    if got is None:
        return entry(name, at, 0, False, "Truncated"), None
    payload, used = got
    tail = body + used
    tail += 4 if data[tail : tail + 4] == b"PK\x07\x08" else 0
    if len(data) - tail < 12:
        return entry(name, at, len(payload), False, "MissingDescriptor"), None
    crc, packed, size = struct.unpack_from("<3I", data, tail)
    good = zlib.crc32(payload) == crc
    return entry(name, at, size, good, None if good else "BadCRC", crc, packed), tail + 12
