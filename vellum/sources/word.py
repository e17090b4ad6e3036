"""Documents ([MS-DOC]): text, property runs and side tables as rows."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

from vellum.sources import officeart
from vellum.sources.biff import CODECS
from vellum.sources.ole import CompoundFile, ParseError, last_of

# Indices of 32-bit words in the table of offsets, property
# codes, code pages of primary languages, colors by index.
STSHF, SED, HDD, BTE_CHPX, BTE_PAPX, FONTS, CLX, SPA_MOM, SPA_HDR, DGG_INFO, TEXTBOXES, LISTS, OVERRIDES = 2, 12, 22, 24, 26, 30, 66, 80, 82, 100, 112, 146, 148
LANGUAGES = {0x11: 932, 0x12: 949, 0x19: 1251, 0x15: 1250, 0x0E: 1250, 0x05: 1250, 0x1F: 1254, 0x08: 1253, 0x0D: 1255, 0x01: 1256, 0x1E: 874, 0x2A: 1258}
COLORS = ("000000", "000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF")
STORIES = (("header", "even"), ("header", "default"), ("footer", "even"), ("footer", "default"), ("header", "first"), ("footer", "first"))
# End of fixed values.
NO_BASE = 0xFFF
CHAR_FIELDS = ("font_name", "font_size", "bold", "italic", "underline", "color", "istd_char", "pic_location")
PARA_FIELDS = ("istd", "in_table", "row_end", "ilfo", "ilvl", "page_break_before", "out_lvl", "cell_widths", "alignment", "indent_left", "indent_right", "indent_first", "space_before", "space_after", "line_spacing", "line_rule")


def codepage(lid: int, compat: bool = False) -> int:
    """Code page of a language: by primary language, Chinese by variant."""
    if lid & 0x3FF == 0x04:
        return 936 if lid >> 10 in ((1,) if compat else (2, 4)) else 950
    return LANGUAGES.get(lid & 0x3FF, 1252)


def sprms(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, operand) of a run of properties, as far as whole ones go."""
    at = 0
    while at + 2 <= len(data):
        code, = struct.unpack_from("<H", data, at)
        at += 2
        size = (1, 1, 2, 4, 2, 2, -1, 3)[code >> 13]
        if size < 0:
            prefix = 2 if code == 0xD608 else 1
            if at + prefix > len(data):
                return
            size = int.from_bytes(data[at : at + prefix], "little")
            # the long table definition counts one byte more than it has
            at += prefix
            if code == 0xD608:
                size = max(0, size - 1)
        if at + size > len(data):
            return
        yield code, data[at : at + size]
        at += size


def char_props(data: bytes, fonts: list[str]) -> dict:
    out: dict = {}
    for code, v in sprms(data):
        n = int.from_bytes(v, "little")
        if code == 0x4A4F:
            out["font_name"] = fonts[n] if n < len(fonts) and fonts[n] else f"font{n}"
        elif code == 0x4A43:
            out["font_size"] = n
        elif code == 0x0835:
            out["bold"] = n != 0
        elif code == 0x0836:
            out["italic"] = n != 0
        elif code == 0x2A3E:
            out["underline"] = n
        elif code == 0x2A42:
            out["color"] = COLORS[n] if n < len(COLORS) else "000000"
        elif code == 0x6870:
            out["color"] = v[:3].hex().upper()
        elif code == 0x4A30:
            out["istd_char"] = n
        elif code == 0x6A03:
            out["pic_location"] = int.from_bytes(v, "little", signed=True)
    return out


def para_props(data: bytes) -> dict:
    out: dict = {}
    signed = {0x845E: "indent_left", 0x845D: "indent_right", 0x8460: "indent_first"}
    plain = {0xA413: "space_before", 0xA414: "space_after", 0x4600: "istd", 0x460B: "ilfo", 0x260A: "ilvl", 0x2640: "out_lvl"}
    flags = {0x2416: "in_table", 0x2417: "row_end", 0x2407: "page_break_before"}
    newer = False
    for code, v in sprms(data):
        n = int.from_bytes(v, "little")
        if code in signed:
            out[signed[code]] = int.from_bytes(v, "little", signed=True)
        elif code in plain:
            out[plain[code]] = n
        elif code in flags:
            out[flags[code]] = n != 0
        elif code == 0x2461:
            out["alignment"], newer = n, True
        elif code == 0x2403 and not newer and "alignment" not in out:
            out["alignment"] = n
        elif code == 0x6412:
            line, multiple = struct.unpack("<hH", v)
            out["line_spacing"], out["line_rule"] = (line, 0) if multiple == 1 else (-line, 2) if line < 0 else (line, 1)
        elif code in (0xD608, 0xD605) and v:
            n = v[0]
            if n and len(v) >= 1 + 2 * (n + 1):
                edges = struct.unpack_from(f"<{n + 1}h", v, 1)
                out["cell_widths"] = [b - a for a, b in zip(edges, edges[1:])]
    return out


class Document:
    """One file; each table is read when asked for."""

    def __init__(self, data: bytes, compat: bool = False):
        self.compat = compat
        self.file = CompoundFile(data)
        self.main = self.file.stream("WordDocument")
        if self.main is None:
            raise ParseError("doc: no WordDocument stream")
        m = self.main
        if len(m) < 34:
            raise ParseError("doc: shorter than its information block")
        self.ident, self.n_fib = struct.unpack_from("<HH", m)
        if self.ident != 0xA5EC:
            raise ParseError("doc: wrong signature")
        self.lid, = struct.unpack_from("<H", m, 6)
        self.table_stream = struct.unpack_from("<H", m, 10)[0] >> 9 & 1
        at = 32 + 2 + 2 * struct.unpack_from("<H", m, 32)[0]
        if at + 2 > len(m):
            raise ParseError("doc: information block cut short")
        n_longs, = struct.unpack_from("<H", m, at)
        longs = at + 2
        at = longs + 4 * n_longs
        if at + 2 > len(m):
            raise ParseError("doc: information block cut short")
        long = lambda k: struct.unpack_from("<I", m, longs + 4 * k)[0] if k < n_longs else 0
        self.ccp_text, self.ccp_ftn, self.ccp_hdd = long(3), long(4), long(5)
        self.ccp_atn, self.ccp_edn = long(7), long(8)
        count, = struct.unpack_from("<H", m, at)
        self.words, self.pairs = count * (1 if compat else 2), at + 2
        table = self.file.stream(f"{self.table_stream}Table")
        if table is None:
            raise ParseError("doc: no table stream")
        self.table = table

    def part(self, index: int) -> tuple[int, bytes]:
        """Offset and bytes of a structure in the table stream; empty where
        the document has none or it lies outside."""
        at = self.pairs + 4 * index
        if index + 1 >= self.words or at + 8 > len(self.main):
            return 0, b""
        fc, lcb = struct.unpack_from("<II", self.main, at)
        return (fc, self.table[fc : fc + lcb]) if lcb and fc + lcb <= len(self.table) else (0, b"")

    @cached_property
    def pieces(self) -> list[tuple[int, int, int, bool]]:
        """(first and past-the-last place, byte offset, two bytes a place)."""
        _, clx = self.part(CLX)
        at = 0
        while at < len(clx) and clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        if at + 5 > len(clx) or clx[at] != 2:
            raise ParseError("doc: no piece table")
        size, = struct.unpack_from("<I", clx, at + 1)
        plc = clx[at + 5 : at + 5 + size]
        n = (len(plc) - 4) // 12
        places = struct.unpack_from(f"<{n + 1}I", plc) if n > 0 else ()
        out = []
        for i in range(max(n, 0)):
            fc, = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
            narrow = bool(fc & 0x40000000)
            out.append((places[i], places[i + 1], (fc & 0x3FFFFFFF) // 2 if narrow else fc, not narrow))
        return out

    @cached_property
    def full_text(self) -> str:
        codec = CODECS.get(codepage(self.lid, self.compat), "latin-1")
        if self.lid & 0x3FF in (0x08, 0x0D, 0x01, 0x1E, 0x2A) and self.compat:
            codec = "latin-1"
        out = []
        for a, b, fc, wide in self.pieces:
            raw = self.main[fc : fc + (b - a) * (2 if wide else 1)]
            out.append(raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace") if wide else raw.decode(codec, "replace"))
        return "".join(out)

    @property
    def text(self) -> str:
        return self.full_text[: self.ccp_text] if self.ccp_text else self.full_text

    @cached_property
    def _byte_order(self):
        rows = sorted((fc, fc + (b - a) * (2 if wide else 1), a, wide) for a, b, fc, wide in self.pieces)
        return [r[0] for r in rows], rows

    def place(self, fc: int, end: bool) -> int:
        """Place of a byte offset. One in no piece goes to the nearest end:
        the first place for a start, the last for an end."""
        starts, rows = self._byte_order
        # an end belongs to the piece whose last byte it follows
        i = bisect_right(starts, fc - end) - 1
        if i >= 0 and fc - end < rows[i][1]:
            lo, _, a, wide = rows[i]
            return a + (fc - lo) // (2 if wide else 1)
        return max((p[1] for p in self.pieces), default=0) if end else 0

    def _pages(self, index: int, entry: int) -> Iterator[tuple[int, int, bytes, int]]:
        """(first byte, past the last, page, place of the properties) of all
        runs on all property pages; pages outside the stream are passed over."""
        _, plc = self.part(index)
        n = (len(plc) - 4) // 8
        for i in range(max(n, 0)):
            number, = struct.unpack_from("<I", plc, 4 * (n + 1) + 4 * i)
            page = self.main[512 * number : 512 * number + 512]
            if len(page) < 512:
                continue
            runs = page[511]
            head = 4 * (runs + 1)
            for j in range(runs):
                if head + entry * j >= 511:
                    break
                a, b = struct.unpack_from("<II", page, 4 * j)
                yield a, b, page, 2 * page[head + entry * j]

    @cached_property
    def fonts(self) -> list[str]:
        _, data = self.part(FONTS)
        if len(data) < 4:
            return []
        extended = data[:2] == b"\xff\xff"
        n, = struct.unpack_from("<H", data, 2 if extended else 0)
        at, out = 6 if extended else 4, []
        for _ in range(n):
            if at >= len(data):
                break
            raw = data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
            # where names stand, else wherever one can be read
            names = (raw[k:].decode("utf-16-le", "ignore").split("\0")[0] for k in (39, 15, *range(38, 4, -1)) if k + 2 <= len(raw))
            out.append(next((x for x in names if x and len(x.encode("utf-8", "ignore")) <= 100 and all(c >= " " and c != "\ufffd" for c in x)), ""))
        return out

    def char_runs(self) -> Iterator[tuple]:
        for k, (a, b, page, at) in enumerate(self._pages(BTE_CHPX, 1)):
            props = char_props(page[at + 1 : at + 1 + page[at]], self.fonts) if at else {}
            yield k, self.place(a, False), self.place(b, True), *(props.get(f) for f in CHAR_FIELDS)

    def para_runs(self) -> Iterator[tuple]:
        for k, (a, b, page, at) in enumerate(self._pages(BTE_PAPX, 13)):
            props: dict = {}
            if at:
                size, head = (2 * page[at] - 1, at + 1) if page[at] else (2 * page[at + 1], at + 2)
                body = page[head : head + size]
                props = para_props(body[2:]) | ({"istd": int.from_bytes(body[:2], "little")} if len(body) >= 2 else {})
            yield k, self.place(a, False), self.place(b, True), *(props.get(f) for f in PARA_FIELDS)

    def styles(self) -> Iterator[tuple]:
        """(istd, name, sti, kind, base, character and paragraph properties)."""
        _, data = self.part(STSHF)
        if len(data) < 6:
            return
        head, n, base = struct.unpack_from("<HHH", data)
        at = 2 + head
        for k in range(n):
            if at + 2 > len(data):
                return
            size, = struct.unpack_from("<H", data, at)
            std = data[at + 2 : at + 2 + size]
            at += 2 + size
            if len(std) < 4:
                continue
            sti, word = struct.unpack_from("<HH", std)
            kind, parent = word & 15, word >> 4
            name, chars, paras = "", {}, {}
            if base + 2 <= len(std):
                length, = struct.unpack_from("<H", std, base)
                name = std[base + 2 : base + 2 + 2 * length].decode("utf-16-le", "replace")
                pos = base + 4 + 2 * length
                parts = []
                for _ in range({1: 2, 2: 1}.get(kind, 0)):
                    pos += pos % 2
                    if pos + 2 > len(std):
                        break
                    m, = struct.unpack_from("<H", std, pos)
                    parts.append(std[pos + 2 : pos + 2 + m])
                    pos += 2 + m
                if kind == 1 and parts:
                    paras = para_props(parts[0][2:])
                if kind == 1 and len(parts) > 1 or kind == 2 and parts:
                    chars = char_props(parts[-1], self.fonts)
            yield k, name, sti & 0xFFF, kind, None if parent in (NO_BASE, k) else parent, {f: chars.get(f) for f in CHAR_FIELDS[:6]}, {f: paras.get(f) for f in PARA_FIELDS[8:]}

    def lists(self) -> Iterator[tuple]:
        """(list_id, level, ordered, number format, text) of every level."""
        fc, data = self.part(LISTS)
        if len(data) < 2:
            return
        n, = struct.unpack_from("<H", data)
        if 2 + 28 * n > len(data):
            return
        # the levels stand behind the array, counted in its size or not
        tail, at = self.table[fc + 2 + 28 * n :], 0
        for i in range(n):
            key, = struct.unpack_from("<I", data, 2 + 28 * i)
            for level in range(1 if data[2 + 28 * i + 26] & 1 else 9):
                if at + 28 > len(tail):
                    if level == 0:
                        yield key, 0, False, None, None
                    break
                nfc, chpx, papx = tail[at + 4], tail[at + 24], tail[at + 25]
                at += 28 + chpx + papx
                m = int.from_bytes(tail[at : at + 2], "little")
                units = struct.unpack_from(f"<{m}H", tail, at + 2) if at + 2 + 2 * m <= len(tail) else ()
                text = "".join(f"%{u + 1}" if u <= 8 else chr(u) for u in units)
                at += 2 + 2 * m
                yield key, level, nfc != 23, nfc, text

    def overrides(self) -> Iterator[tuple]:
        _, data = self.part(OVERRIDES)
        n = int.from_bytes(data[:4], "little") if len(data) >= 4 else 0
        for i in range(min(n, (len(data) - 4) // 16)):
            yield i + 1, struct.unpack_from("<I", data, 4 + 16 * i)[0]

    def sections(self) -> Iterator[tuple]:
        """(number, first and past-the-last place, break kind, page size)."""
        _, plc = self.part(SED)
        n = (len(plc) - 4) // 16
        for i in range(max(n, 0)):
            a, b = struct.unpack_from("<II", plc, 4 * i)
            sepx, = struct.unpack_from("<I", plc, 4 * (n + 1) + 12 * i + 2)
            kind, width, height = 2, None, None
            if sepx not in (0, 0xFFFFFFFF) and sepx + 2 <= len(self.main):
                size, = struct.unpack_from("<H", self.main, sepx)
                for code, v in sprms(self.main[sepx + 2 : sepx + 2 + size]):
                    x = int.from_bytes(v, "little")
                    kind, width, height = (x if code == 0x3009 else kind), (x if code == 0xB01F else width), (x if code == 0xB020 else height)
            yield i, a, b, kind, width, height

    def stories(self) -> Iterator[tuple]:
        """(number, header or footer, type, text as stored)."""
        _, plc = self.part(HDD)
        n = len(plc) // 4
        if n < 2:
            return
        ends = struct.unpack_from(f"<{n}I", plc)
        first = self.ccp_text + self.ccp_ftn
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            b = min(b, self.ccp_hdd)
            if a < b and first + b <= len(self.full_text):
                yield i, *STORIES[i % 6], self.full_text[first + a : first + b]

    def text_boxes(self) -> Iterator[tuple]:
        """(number, text as stored)."""
        _, plc = self.part(TEXTBOXES)
        n = (len(plc) - 4) // 26
        first = self.ccp_text + self.ccp_ftn + self.ccp_hdd + (0 if self.compat else self.ccp_atn + self.ccp_edn)
        ends = struct.unpack_from(f"<{n + 1}I", plc) if n > 0 else ()
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b and first + b <= len(self.full_text):
                yield i, self.full_text[first + a : first + b]

    def shapes(self) -> Iterator[tuple]:
        """(story, place, shape id, left, top, right, bottom)."""
        for story, index in (("main", SPA_MOM), ("header", SPA_HDR)):
            _, plc = self.part(index)
            n = (len(plc) - 4) // 30
            for i in range(max(n, 0)):
                cp, = struct.unpack_from("<I", plc, 4 * i)
                yield story, cp, *struct.unpack_from("<Iiiii", plc, 4 * (n + 1) + 26 * i)

    def shape_pictures(self) -> Iterator[tuple]:
        """(shape id, picture, from 0, and where it is from: 0 the drawing
        group, 1 the data stream)."""
        for source, data in ((0, self._drawings()), (1, self.file.stream("Data", b""))):
            for sp in officeart.find(data, officeart.SP_GROUP):
                spid = pib = None
                for r in officeart.records(data, sp.start, sp.end):
                    if r.type == officeart.FSP and r.start + 4 <= r.end:
                        spid, = struct.unpack_from("<I", data, r.start)
                    elif r.type in officeart.FOPTS:
                        pib = officeart.properties(data, r).get(0x104, pib)
                if spid is not None and isinstance(pib, int) and pib > 0:
                    yield spid, pib - 1, source

    def _drawings(self) -> bytes:
        """The group's records and those of the drawings, without the bytes
        that tell which story a drawing belongs to."""
        _, data = self.part(DGG_INFO)
        out, at = b"", 0
        while at + 8 <= len(data):
            r = next(officeart.records(data, at))
            if r.type not in (officeart.DGG, officeart.DG):
                at += 1
                continue
            out += data[r.offset : r.end]
            at = r.end if r.end > at else at + 8
        return out

    def inline_pictures(self) -> Iterator[tuple]:
        """(place in the data stream, number, format, bytes) of the pictures
        that character runs name; each has a header of its own length."""
        data = self.file.stream("Data", b"")
        seen: set[int] = set()
        for row in self.char_runs():
            at = row[3 + CHAR_FIELDS.index("pic_location")]
            if at is None or at in seen or not 0 <= at <= len(data) - 6:
                continue
            seen.add(at)
            size, head = struct.unpack_from("<IH", data, at)
            for r, _, _ in officeart.tree(data, at + head, at + size):
                inner = r
                if r.type == officeart.FBSE and r.start + 36 <= r.end:
                    inner = next(officeart.records(data, r.start + 36 + data[r.start + 33], r.end), r)
                found = officeart.blip(data, inner)
                if found:
                    yield at, len(seen) - 1, *found
                    break

    def pictures(self) -> Iterator[tuple]:
        """(index, format, bytes): of the store, else of the streams."""
        rows = list(officeart.stored_pictures(self._drawings(), self.main))
        for name in ("Pictures", "Data"):
            if not any(r[2] for r in rows):
                rows = list(officeart.stream_pictures(self.file.stream(name, b"")))
        yield from rows


document = last_of(Document)


def fib_rows(data: bytes, **o):
    d = document(data, **o)
    yield d.n_fib, d.lid, codepage(d.lid, d.compat), d.table_stream, d.ccp_text, d.ccp_ftn, d.ccp_hdd


def text_rows(data: bytes, **o):
    d = document(data, **o)
    yield d.text, d.full_text


def piece_rows(data: bytes, **o):
    for k, row in enumerate(document(data, **o).pieces):
        yield k, *row


def rows_of(name: str):
    def rows(data: bytes, **o):
        yield from getattr(document(data, **o), name)()

    return rows


def font_rows(data: bytes, **o):
    yield from enumerate(document(data, **o).fonts)


_CHARS = "font_name string, font_size int, bold boolean, italic boolean, underline int, color string"
_PARAS = "alignment int, indent_left int, indent_right int, indent_first int, space_before int, space_after int, line_spacing int, line_rule int"
_struct = lambda s: "struct<" + s.replace(" ", ":").replace(",:", ",") + ">"
TABLES = {
    "doc_fib": ("n_fib int, lid int, codepage int, table_stream int, ccp_text bigint, ccp_ftn bigint, ccp_hdd bigint", fib_rows),
    "doc_text": ("text string, full_text string", text_rows),
    "doc_pieces": ("piece_idx int, cp_start bigint, cp_end bigint, fc bigint, is_unicode boolean", piece_rows),
    "doc_char_runs": (f"run_idx int, cp_start bigint, cp_end bigint, {_CHARS}, istd_char int, pic_location bigint", rows_of("char_runs")),
    "doc_para_runs": (f"run_idx int, cp_start bigint, cp_end bigint, istd int, in_table boolean, row_end boolean, ilfo int, ilvl int, page_break_before boolean, out_lvl int, cell_widths array<int>, {_PARAS}", rows_of("para_runs")),
    "doc_styles": (f"istd int, name string, sti int, style_type int, istd_base int, char_props {_struct(_CHARS)}, para_props {_struct(_PARAS)}", rows_of("styles")),
    "doc_fonts": ("font_idx int, name string", font_rows),
    "doc_lists": ("list_id bigint, level int, ordered boolean, nfc int, lvl_text string", rows_of("lists")),
    "doc_list_overrides": ("ilfo int, list_id bigint", rows_of("overrides")),
    "doc_sections": ("section_idx int, cp_start bigint, cp_end bigint, bkc int, page_w int, page_h int", rows_of("sections")),
    "doc_stories": ("story_idx int, kind string, story_type string, raw_text string", rows_of("stories")),
    "doc_textboxes": ("box_idx int, raw_text string", rows_of("text_boxes")),
    "doc_spa": ("story string, cp bigint, spid bigint, left int, top int, right int, bottom int", rows_of("shapes")),
    "doc_shape_pictures": ("spid bigint, image_idx int, source int", rows_of("shape_pictures")),
    "doc_inline_pictures": ("pic_location bigint, pic_idx int, format string, data binary", rows_of("inline_pictures")),
    "doc_images": ("image_idx int, format string, data binary", rows_of("pictures")),
}
