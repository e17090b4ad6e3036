"""Drawing records ([MS-ODRAW]): the record tree, pictures, shape properties."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

# Record types, and for each kind of picture its types, the
# instances with one identifier, and whether it is a metafile.
DGG, BSTORE, DG, SPGR_GROUP, SP_GROUP, FBSE, FSPGR, FSP, FOPT, TEXTBOX, CHILD_ANCHOR, CLIENT_ANCHOR, CLIENT_DATA = 0xF000, 0xF001, 0xF002, 0xF003, 0xF004, 0xF007, 0xF009, 0xF00A, 0xF00B, 0xF00D, 0xF00F, 0xF010, 0xF011
FOPTS = (0xF00B, 0xF121, 0xF122)
BLIPS = {
    0xF01A: ("EMF", (0x3D4,), True),
    0xF01B: ("WMF", (0x216,), True),
    0xF01C: ("PICT", (0x542,), True),
    0xF01D: ("JPEG", (0x46A, 0x6E2), False),
    0xF01E: ("PNG", (0x6E0,), False),
    0xF01F: ("DIB", (0x7A8,), False),
    0xF029: ("TIFF", (0x6E4,), False),
    0xF02A: ("JPEG", (0x46A, 0x6E2), False),
}
# End of fixed values.


class Record(NamedTuple):
    offset: int
    ver: int
    instance: int
    type: int
    start: int
    end: int


def records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Record]:
    """Records side by side; one that goes beyond the end is cut there."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        first, kind, size = struct.unpack_from("<HHI", data, at)
        stop = min(at + 8 + size, end)
        yield Record(at, first & 15, first >> 4, kind, at + 8, stop)
        at += 8 + size


def tree(data: bytes, at: int = 0, end: int | None = None, depth: int = 0, parent: int = -1) -> Iterator[tuple[Record, int, int]]:
    """(record, depth, parent's offset) of all records, containers before
    what they hold. A stack, not a recursion, holds the open containers."""
    stack = [(records(data, at, end), depth, parent)]
    while stack:
        rows, level, above = stack[-1]
        r = next(rows, None)
        if r is None:
            stack.pop()
            continue
        yield r, level, above
        if r.ver == 15 and level < 64:
            stack.append((records(data, r.start, r.end), level + 1, r.offset))


def find(data: bytes, kind: int, at: int = 0, end: int | None = None) -> Iterator[Record]:
    return (r for r, _, _ in tree(data, at, end) if r.type == kind)


def blip(data: bytes, r: Record) -> tuple[str, bytes] | None:
    """Format and bytes of a picture record, metafiles inflated; None if it is
    none or broken."""
    if r.type not in BLIPS:
        return None
    name, single, metafile = BLIPS[r.type]
    at = r.start + (16 if r.instance in single else 32)
    if metafile:
        if at + 34 > r.end:
            return None
        saved, = struct.unpack_from("<I", data, at + 28)
        packed = data[at + 32] == 0
        body = data[at + 34 : min(r.end, at + 34 + saved)]
        if packed:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                return None
    else:
        body = data[at + 1 : r.end]
    return (name, body) if body else None


def stored_pictures(drawing: bytes, delay: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, str | None, bytes | None]]:
    """(index, format, bytes) of a drawing group's picture store; entries
    that can't be read keep their index, with nulls. A picture follows its
    entry or lies at an offset of the delay stream."""
    for store in find(drawing, BSTORE, at, end):
        for k, r in enumerate(records(drawing, store.start, store.end)):
            found = None
            if r.type == FBSE and r.start + 36 <= r.end:
                name, = struct.unpack_from("<B", drawing, r.start + 33)
                inside = next(records(drawing, r.start + 36 + name, r.end), None)
                offset, = struct.unpack_from("<I", drawing, r.start + 28)
                if inside is not None:
                    found = blip(drawing, inside)
                elif offset + 8 <= len(delay):
                    found = blip(delay, next(records(delay, offset)))
            else:
                found = blip(drawing, r)
            yield k, *(found or (None, None))
        return


def stream_pictures(stream: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(index, format, bytes) of the pictures side by side in a stream; what
    is none, or broken, is passed over."""
    k = 0
    for r in records(stream):
        found = blip(stream, r)
        if found:
            yield k, *found
            k += 1


def properties(data: bytes, r: Record) -> dict[int, int | bytes]:
    """A shape's properties by number; complex ones as bytes."""
    out: dict[int, int | bytes] = {}
    at, more = r.start, r.start + 6 * r.instance
    for _ in range(r.instance):
        if at + 6 > r.end:
            break
        key, value = struct.unpack_from("<HI", data, at)
        at += 6
        if key & 0x8000:
            out[key & 0x3FFF] = data[more : min(more + value, r.end)]
            more += value
        else:
            out[key & 0x3FFF] = value
    return out
