"""Workbooks ([MS-XLS]): records of a stream to rows of normalised tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from vellum.functions.numbers import shortest_text
from vellum.sources.ole import CompoundFile, ParseError, last_of

# Record numbers, error texts, code pages.
BOF, EOF, CODEPAGE, DATEMODE, BOUNDSHEET, CONTINUE, SST, XF, FORMAT = 0x809, 0x0A, 0x42, 0x22, 0x85, 0x3C, 0xFC, 0xE0, 0x41E
LABELSST, LABEL, NUMBER, RK, MULRK, MULBLANK, BLANK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0xBE, 0x201, 0x205, 0x06, 0x207
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
CODECS = {1200: "utf-16-le", 10000: "mac-roman", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5", 32768: "mac-roman", 32769: "cp1252"} | {n: f"cp{n}" for n in (437, 850, 852, 866, 874, *range(1250, 1259))}
# End of fixed values.
BIFF5, BIFF8 = 0x0500, 0x0600


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, number, body) to the end of the stream, or as far as whole
    records go."""
    while at + 4 <= len(stream):
        number, size = struct.unpack_from("<HH", stream, at)
        if at + 4 + size > len(stream):
            return
        yield at, number, stream[at + 4 : at + 4 + size]
        at += 4 + size


class Pieces:
    """Bytes of a record and its continuations. Characters that go over into
    the next piece go on after a flag byte, which may change their width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def left(self) -> int:
        return len(self.parts[self.k]) - self.at if self.k < len(self.parts) else 0

    def _next(self) -> None:
        self.k, self.at = self.k + 1, 0
        if self.k >= len(self.parts):
            raise ParseError("xls: a string goes beyond its records")

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if not self.left():
                self._next()
            part = self.parts[self.k][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = []
        while n:
            if not self.left():
                self._next()
                wide = bool(self.take(1)[0] & 1)
            width = 2 if wide else 1
            fit = min(n, self.left() // width)
            if not fit:
                raise ParseError("xls: a character is split")
            out.append(self.take(fit * width).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= fit
        return "".join(out)

    def done(self) -> bool:
        while self.k < len(self.parts) and not self.left():
            self.k, self.at = self.k + 1, 0
        return self.k >= len(self.parts)


def rich_string(p: Pieces) -> tuple[str, list[tuple[int, int]]]:
    """A shared string and its runs (first character, font)."""
    n, flags = struct.unpack("<HB", p.take(3))
    runs = struct.unpack("<H", p.take(2))[0] if flags & 8 else 0
    more = struct.unpack("<I", p.take(4))[0] if flags & 4 else 0
    text = p.characters(n, bool(flags & 1))
    found = [struct.unpack("<HH", p.take(4)) for _ in range(runs)]
    p.take(more)
    return text, found


def plain_string(body: bytes, count: str) -> str:
    """A string with a count of one (B) or two (H) bytes and flags."""
    n, flags = struct.unpack_from(f"<{count}B", body)
    at = struct.calcsize(f"<{count}B")
    return body[at : at + n * 2].decode("utf-16-le", "replace") if flags & 1 else body[at : at + n].decode("latin-1")


def rk_number(raw: int, unsigned: bool = False) -> tuple[float, int]:
    """Value of a packed number, and the whole number it holds, or 0."""
    if raw & 2:
        n = raw >> 2
        n = n - (1 << 30) if n >= 1 << 29 and not unsigned else n
        return (n / 100 if raw & 1 else float(n)), (n // 100 if raw & 1 else n)
    value, = struct.unpack("<d", struct.pack("<II", 0, raw & 0xFFFFFFFC))
    return (value / 100 if raw & 1 else value), 0


class Workbook:
    """The globals of a workbook, and its cells sheet by sheet."""

    def __init__(self, data: bytes, compat: bool = False, formulas: bool = False):
        self.compat, self.formulas = compat, formulas
        f = CompoundFile(data)
        names = {e.name: e for e in reversed(f.entries) if e.object_type == 2}
        entry = names.get("Book") or names.get("Workbook")
        if entry is None:
            raise ParseError("xls: no workbook stream")
        self.stream = f.read(entry)
        self.version, self.codepage, self.date1904 = BIFF8, 1252, False
        self.sheets: list[tuple[int, str]] = []
        self.xfs: list[tuple[int, int]] = []
        self.formats: dict[int, str] = {}
        self.strings: list[tuple[str, list[tuple[int, int]]]] = []
        self.broken: str | None = None
        self._globals()

    def _bytes(self, raw: bytes) -> str:
        return raw.decode("cp1251" if self.compat else CODECS.get(self.codepage, "cp1252"), "replace")

    def _globals(self) -> None:
        parts: list[bytes] | None = None
        for _, number, body in records(self.stream):
            if number == CONTINUE and parts is not None:
                parts.append(body)
                continue
            if parts is not None and not self.strings:
                self._shared(parts)
            if number == EOF:
                parts = None
                break
            parts = [body] if number == SST else None
            if number == BOF and len(body) >= 2:
                self.version, = struct.unpack_from("<H", body)
            elif number == CODEPAGE:
                self.codepage, = struct.unpack_from("<H", body)
            elif number == DATEMODE:
                self.date1904 = body[:1] == b"\1" and not self.compat
            elif number == BOUNDSHEET:
                place, = struct.unpack_from("<I", body)
                name = plain_string(body[6:], "B") if self.version == BIFF8 else self._bytes(body[7 : 7 + body[6]])
                self.sheets.append((place, name))
            elif number == XF:
                self.xfs.append(struct.unpack_from("<HH", body))
            elif number == FORMAT:
                ifmt, = struct.unpack_from("<H", body)
                self.formats[ifmt] = plain_string(body[2:], "H") if self.version == BIFF8 else self._bytes(body[3 : 3 + body[2]])
        if parts is not None and not self.strings:
            self._shared(parts)

    def _shared(self, parts: list[bytes]) -> None:
        p = Pieces(parts)
        _, unique = struct.unpack("<II", p.take(8))
        try:
            while len(self.strings) < unique and not p.done():
                self.strings.append(rich_string(p))
        except (ParseError, struct.error):
            # what came before a broken string stays
            self.broken = f"xls: {len(self.strings)} of {unique} shared strings can be read"

    def cells(self, sheet: int) -> Iterator[tuple]:
        """(row, column, type, xf, shared string, text, number, whole) of a
        sheet, the last record of a place winning."""
        found: dict[tuple[int, int], tuple] = {}
        waiting = None
        for _, number, body in records(self.stream, self.sheets[sheet][0]):
            if number == EOF:
                break
            if number == STRING and waiting is not None:
                row, col, xf = waiting
                found[row, col] = (row, col, "Formula", xf, None, plain_string(body, "H"), None, 0)
                waiting = None
                continue
            try:
                for cell in self._cell(number, body):
                    found[cell[0], cell[1]] = cell
                    waiting = cell[:2] + (cell[3],) if cell[2] == "Formula" and cell[6] is None and cell[5] is None else None
            except (struct.error, IndexError):
                continue  # a short record
        for k in sorted(found):
            yield found[k]

    def _cell(self, number: int, body: bytes) -> Iterator[tuple]:
        if number not in (LABELSST, LABEL, NUMBER, RK, MULRK, MULBLANK, BLANK, BOOLERR, FORMULA):
            return
        row, col, xf = struct.unpack_from("<HHH", body)
        if number == LABELSST:
            k, = struct.unpack_from("<I", body, 6)
            yield row, col, "LabelSSt", xf, k, self.strings[k][0] if k < len(self.strings) else None, None, 0
        elif number == LABEL:
            wide = self.version == BIFF8
            text = plain_string(body[6:], "H") if wide else self._bytes(body[8 : 8 + struct.unpack_from("<H", body, 6)[0]])
            yield row, col, "LabelBIFF8" if wide else "LabelBIFF5", xf, None, text, None, 0
        elif number == NUMBER:
            value, = struct.unpack_from("<d", body, 6)
            yield row, col, "Number", xf, None, shortest_text(value), value, 0
        elif number == RK:
            value, whole = rk_number(struct.unpack_from("<I", body, 6)[0], self.compat)
            yield row, col, "Rk", xf, None, shortest_text(value), value, whole
        elif number == MULRK:
            for i in range((len(body) - 6) // 6):
                xf, raw = struct.unpack_from("<HI", body, 4 + 6 * i)
                value, whole = rk_number(raw, self.compat)
                yield row, col + i, "Rk", xf, None, shortest_text(value), value, whole
        elif number == MULBLANK:
            for i in range((len(body) - 6) // 2):
                yield row, col + i, "Blank", struct.unpack_from("<H", body, 4 + 2 * i)[0], None, "", None, 0
        elif number == BLANK:
            yield row, col, "Blank", xf, None, "", None, 0
        elif number == BOOLERR:
            value, error = body[6], body[7]
            text = ERRORS.get(value, "") if error else "TRUE" if value else "FALSE"
            yield row, col, "BoolErr", xf, None, "#NUM!!" if self.compat and text == "#NUM!" else text, None, 0 if error else value
        elif number == FORMULA and self.formulas:
            kind, value = body[6], struct.unpack_from("<d", body, 6)[0]
            if body[12:14] != b"\xff\xff":
                yield row, col, "Formula", xf, None, shortest_text(value), value, 0
            elif kind == 0:
                yield row, col, "Formula", xf, None, None, None, 0  # its text follows
            elif kind == 1:
                yield row, col, "Formula", xf, None, "TRUE" if body[8] else "FALSE", None, body[8]
            elif kind == 2:
                yield row, col, "Formula", xf, None, ERRORS.get(body[8], ""), None, 0


workbook = last_of(Workbook)


def book_rows(data: bytes, **o):
    b = workbook(data, **o)
    yield b.version, b.codepage, b.date1904, len(b.sheets), len(b.strings)


def cell_rows(data: bytes, **o):
    b = workbook(data, **o)
    for k, (_, name) in enumerate(b.sheets):
        for cell in b.cells(k):
            yield k, name, *cell


def sheet_rows(data: bytes, **o):
    for k, (place, name) in enumerate(workbook(data, **o).sheets):
        yield k, name, place


def string_rows(data: bytes, **o):
    b = workbook(data, **o)
    for k, (text, runs) in enumerate(b.strings):
        yield k, text, [{"ich": i, "ifnt": f} for i, f in runs]
    if b.broken:
        raise ParseError(b.broken)


def xf_rows(data: bytes, **o):
    for k, (font, ifmt) in enumerate(workbook(data, **o).xfs):
        yield k, font, ifmt


def format_rows(data: bytes, **o):
    yield from sorted(workbook(data, **o).formats.items())


def record_rows(data: bytes, **o):
    for k, (at, number, body) in enumerate(records(workbook(data, **o).stream)):
        yield k, at, number, len(body), body
