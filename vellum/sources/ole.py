"""Compound files ([MS-CFB]): named streams inside one file, bytes in, rows out."""

from __future__ import annotations

import struct
from dataclasses import dataclass

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
CUTOFF, MINI = 4096, 64


class ParseError(ValueError):
    """What is wrong with a file, after the name of the stage that found it."""


@dataclass(frozen=True)
class Entry:
    entry_id: int
    name: str
    object_type: int
    start: int
    size: int


def check_header(data: bytes) -> int:
    """The sector size, if the header keeps the rules."""
    if len(data) < 512:
        raise ParseError("cfb: shorter than a header")
    if data[:8] != SIGNATURE:
        raise ParseError("cfb: wrong signature")
    major, order, shift, mini = struct.unpack_from("<HHHH", data, 26)
    if major not in (3, 4):
        raise ParseError(f"cfb: version {major}")
    if order != 0xFFFE:
        raise ParseError("cfb: wrong byte order")
    if shift != {3: 9, 4: 12}[major]:
        raise ParseError(f"cfb: sector shift {shift} of version {major}")
    if mini != 6:
        raise ParseError(f"cfb: mini sector shift {mini}")
    if any(data[34:40]):
        raise ParseError("cfb: reserved bytes are not zero")
    if struct.unpack_from("<I", data, 56)[0] != CUTOFF:
        raise ParseError("cfb: wrong mini stream cutoff")
    if major == 3 and struct.unpack_from("<I", data, 40)[0]:
        raise ParseError("cfb: directory sectors counted in version 3")
    if major == 4 and any(data[512 : min(4096, len(data))]):
        raise ParseError("cfb: the header's sector is not zero behind it")
    return 1 << shift


class CompoundFile:
    """The directory of a file, and its streams by chains of sectors. A chain
    that comes back to a sector it has, or leaves the file, is an error."""

    def __init__(self, data: bytes):
        self.data = data
        self.sector = check_header(data)
        self.most = max(0, -(-len(data) // self.sector) - 1)
        directory, = struct.unpack_from("<I", data, 48)
        mini_fat, = struct.unpack_from("<I", data, 60)
        difat, = struct.unpack_from("<I", data, 68)
        where = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while difat < DIFAT:
            if difat in seen:
                raise ParseError("cfb: sector chain comes back")
            seen.add(difat)
            words = self._words(difat)
            where += words[:-1]
            difat = words[-1]
        self.fat: list[int] = []
        for s in where:
            if s < DIFAT:
                self.fat += self._words(s)
        self.entries = self._directory(self._chain(directory))
        root = next((e for e in self.entries if e.object_type == 5), None)
        self.mini_fat = [w for s in self._sectors(mini_fat) for w in self._words(s)] if mini_fat < DIFAT else []
        self.mini = self._chain(root.start)[: root.size] if root and root.size and root.start < DIFAT else b""

    def _read(self, s: int) -> bytes:
        if s >= self.most:
            raise ParseError(f"cfb: sector {s} is not in the file")
        at = (s + 1) * self.sector
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _words(self, s: int) -> list[int]:
        return list(struct.unpack(f"<{self.sector // 4}I", self._read(s)))

    def _follow(self, s: int, table: list[int]):
        seen: set[int] = set()
        while s < DIFAT:
            if s in seen or s >= len(table):
                raise ParseError("cfb: sector chain comes back" if s in seen else "cfb: sector chain leaves its table")
            seen.add(s)
            yield s
            s = table[s]

    def _sectors(self, s: int) -> list[int]:
        return list(self._follow(s, self.fat))

    def _chain(self, s: int) -> bytes:
        return b"".join(self._read(x) for x in self._follow(s, self.fat))

    @staticmethod
    def _directory(data: bytes) -> list[Entry]:
        out = []
        for i in range(len(data) // 128):
            raw = data[128 * i : 128 * i + 128]
            size, kind = struct.unpack_from("<HB", raw, 64)
            if kind == 0:
                continue
            name = raw[: max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            start, length = struct.unpack_from("<IQ", raw, 116)
            out.append(Entry(i, name, kind, start, length & 0xFFFFFFFF))
        return out

    def read(self, entry: Entry) -> bytes:
        """A stream's bytes: small ones from the mini stream."""
        if entry.object_type == 1 or not entry.size:
            return b""
        if entry.size < CUTOFF and entry.object_type != 5:
            parts = [self.mini[MINI * s : MINI * s + MINI] for s in self._follow(entry.start, self.mini_fat)]
            return b"".join(parts)[: entry.size]
        return self._chain(entry.start)[: entry.size]

    def stream(self, name: str, default: bytes | None = None) -> bytes | None:
        """The last stream of a name, as all but workbooks are chosen."""
        found = [e for e in self.entries if e.name == name and e.object_type == 2]
        return self.read(found[-1]) if found else default


def stream_rows(data: bytes):
    """(entry_id, name, object_type, start_sector, size, data) of a file."""
    f = CompoundFile(data)
    for e in f.entries:
        yield e.entry_id, e.name, e.object_type, e.start, e.size, f.read(e) if e.object_type == 2 else None


def last_of(make):
    """``make``, which gives what it made last for the same bytes again: the
    tables of one file, asked for one after the other, share its parser."""
    held: list = [None, None, None]

    def get(data: bytes, **options):
        if held[0] is not data or held[1] != options:
            held[:] = [data, options, make(data, **options)]
        return held[2]

    return get
