"""Presentations ([MS-PPT]): one walk over the records, rows for all tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

from vellum.sources import officeart as oa
from vellum.sources.ole import CompoundFile, ParseError, last_of

# Record types.
DOCUMENT, DOCUMENT_ATOM, SLIDE, SLIDE_ATOM, ENVIRONMENT, SLIDE_PERSIST, MASTER, DRAWING, FONTS, SCHEME = 0x3E8, 0x3E9, 0x3EE, 0x3EF, 0x3F2, 0x3F3, 0x3F8, 0x40C, 0x7D5, 0x7F0
TEXT_HEADER, TEXT_CHARS, TEXT_STYLE, MASTER_STYLE, TEXT_BYTES, FONT, SLIDE_LIST, USER_EDIT, CURRENT_USER, PERSIST = 0xF9F, 0xFA0, 0xFA1, 0xFA3, 0xFA8, 0xFB7, 0xFF0, 0xFF5, 0xFF6, 0x1772
# End of fixed values.
WIDTH, HEIGHT = 5760, 4320


class Fields:
    """Little-endian fields read one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def get(self, form: str) -> int:
        value, = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return value

    def done(self) -> bool:
        return self.at >= len(self.data)


def paragraph_fields(f: Fields) -> dict:
    """Paragraph properties: those that the mask names, in their fixed order."""
    mask = f.get("I")
    out: dict = {}
    if mask & 0xF:
        flags = f.get("H")
        out["bullet"] = bool(flags & 1) if mask & 1 else None
    order = ((7, "bullet_char", "H"), (4, "", "H"), (6, "", "h"), (5, "", "I"), (11, "alignment", "H"), (12, "line_spacing", "h"), (13, "space_before", "h"), (14, "space_after", "h"), (8, "left_margin", "h"), (10, "indent", "h"), (15, "", "H"))
    for bit, name, form in order:
        if mask >> bit & 1:
            value = f.get(form)
            if name:
                out[name] = value
    if mask >> 20 & 1:
        f.at += 4 * f.get("H")
    for bits in (1 << 16, 7 << 17, 1 << 21):
        if mask & bits:
            f.get("H")
    return out


def character_fields(f: Fields) -> dict:
    mask = f.get("I")
    out: dict = {}
    if mask & 0xFFFF:
        flags = f.get("H")
        for bit, name in ((0, "bold"), (1, "italic"), (2, "underline")):
            if mask >> bit & 1:
                out[name] = bool(flags >> bit & 1)
    for bit, name, form in ((16, "font_idx", "H"), (21, "", "H"), (22, "", "H"), (23, "", "H"), (17, "font_size", "H"), (18, "color_raw", "I"), (19, "", "h")):
        if mask >> bit & 1:
            value = f.get(form)
            if name:
                out[name] = value
    return out


def text_runs(data: bytes, length: int) -> tuple[list[tuple[int, int, dict]], list[tuple[int, dict]]]:
    """Paragraph runs (characters, level, properties) and character runs
    (characters, properties) of a style record; both cover one character more
    than the text. What is cut short ends the list."""
    f = Fields(data)
    paras: list[tuple[int, int, dict]] = []
    chars: list[tuple[int, dict]] = []
    try:
        left = length + 1
        while left > 0 and not f.done():
            n, level = f.get("I"), f.get("H")
            paras.append((n, level, paragraph_fields(f)))
            left -= n
        left = length + 1
        while left > 0 and not f.done():
            n = f.get("I")
            chars.append((n, character_fields(f)))
            left -= n
    except struct.error:
        pass
    return paras, chars


class Presentation:
    def __init__(self, data: bytes):
        f = CompoundFile(data)
        self.data = f.stream("PowerPoint Document")
        if self.data is None:
            raise ParseError("ppt: no PowerPoint Document stream")
        self.user = f.stream("Current User", b"")
        self.images = f.stream("Pictures", b"")

    def at(self, offset: int) -> oa.Record | None:
        return next(oa.records(self.data, offset), None) if 0 <= offset < len(self.data) else None

    def under(self, r: oa.Record, *kinds: int) -> Iterator[oa.Record]:
        """Records of the kinds anywhere below a container."""
        return (x for x, _, _ in oa.tree(self.data, r.start, r.end) if x.type in kinds)

    def body(self, r: oa.Record) -> bytes:
        return self.data[r.start : r.end]

    def persist(self) -> Iterator[tuple[int, int, int]]:
        """(edit, newest 0, persist id, offset) of every edit."""
        head = next(oa.records(self.user), None)
        if head is None or head.end - head.start < 12:
            raise ParseError("ppt: no current user")
        at, = struct.unpack_from("<I", self.user, head.start + 8)
        seen: set[int] = set()
        edit = 0
        while at not in seen:
            seen.add(at)
            r = self.at(at)
            if r is None or r.type != USER_EDIT or r.end - r.start < 16:
                raise ParseError("ppt: broken chain of edits")
            before, directory = struct.unpack_from("<II", self.data, r.start + 8)
            d = self.at(directory)
            if d is not None and d.type == PERSIST:
                f = Fields(self.body(d))
                while f.at + 4 <= len(f.data):
                    word = f.get("I")
                    for k in range(word >> 20):
                        if f.at + 4 > len(f.data):
                            break
                        yield edit, (word & 0xFFFFF) + k, f.get("I")
            if not before:
                return
            at, edit = before, edit + 1

    @cached_property
    def places(self) -> dict[int, int]:
        """Offset of each persist id, the newest edit's."""
        out: dict[int, int] = {}
        for _, key, offset in self.persist():
            out.setdefault(key, offset)
        return out

    @cached_property
    def document(self) -> oa.Record:
        found = [r for r in (self.at(o) for o in self.places.values()) if r is not None and r.type == DOCUMENT]
        if not found:
            found = [r for r in oa.records(self.data) if r.type == DOCUMENT]
        if not found:
            raise ParseError("ppt: no document")
        return found[0]

    def _listed(self, instance: int) -> Iterator[tuple[int, int, list[oa.Record]]]:
        """(persist id, slide id, text records) of a list of slides or masters."""
        for box in oa.records(self.data, self.document.start, self.document.end):
            if box.type == SLIDE_LIST and box.instance == instance:
                now: tuple[int, int, list[oa.Record]] | None = None
                for r in oa.records(self.data, box.start, box.end):
                    if r.type == SLIDE_PERSIST and r.end - r.start >= 16:
                        if now:
                            yield now
                        persist, _, _, slide = struct.unpack_from("<IIII", self.data, r.start)
                        now = persist, slide, []
                    elif now:
                        now[2].append(r)
                if now:
                    yield now

    @cached_property
    def fonts(self) -> list[str]:
        return [self.body(r)[:64].decode("utf-16-le", "ignore").split("\0")[0] for r in self.under(self.document, FONT)]

    def size(self) -> tuple[int, int]:
        """Slide size in units of 1/576 inch."""
        for r in self.under(self.document, DOCUMENT_ATOM):
            w, h = struct.unpack_from("<ii", self.data, r.start)
            if w > 0 and h > 0:
                return w, h
        return WIDTH, HEIGHT

    @cached_property
    def owners(self) -> list[tuple[str, int, int, oa.Record | None, list[oa.Record]]]:
        """(kind, number, id, record, listed texts) of slides and masters."""
        out = []
        for kind, instance in (("slide", 0), ("master", 1)):
            for k, (persist, key, texts) in enumerate(self._listed(instance)):
                out.append((kind, k, key, self.at(self.places.get(persist, -1)), texts))
        return out

    def slides(self) -> Iterator[tuple]:
        for kind, k, key, r, _ in self.owners:
            layout = master = None
            if r is not None:
                for a in oa.records(self.data, r.start, r.end):
                    if a.type == SLIDE_ATOM and a.end - a.start >= 20:
                        layout, = struct.unpack_from("<I", self.data, a.start)
                        master, = struct.unpack_from("<I", self.data, a.start + 12)
            if kind == "slide":
                yield k, key, layout, master, r is not None

    def schemes(self) -> Iterator[tuple]:
        for kind, _, key, r, _ in self.owners:
            if r is not None:
                for a in oa.records(self.data, r.start, r.end):
                    if a.type == SCHEME and a.instance == 1 and a.end - a.start >= 32:
                        yield kind, key, [self.data[a.start + 4 * i : a.start + 4 * i + 3].hex().upper() for i in range(8)]
                        break

    def _text(self, r: oa.Record) -> str | None:
        if r.type == TEXT_CHARS:
            body = self.body(r)
            return body[: len(body) // 2 * 2].decode("utf-16-le", "replace")
        return self.body(r).decode("latin-1") if r.type == TEXT_BYTES else None

    def texts(self) -> Iterator[tuple]:
        """(slide, number, text type, text): the listed texts of each slide,
        else those of its own record."""
        for kind, k, _, r, listed in self.owners:
            if kind != "slide":
                continue
            rows = listed if any(x.type in (TEXT_CHARS, TEXT_BYTES) for x in listed) else self.under(r, TEXT_HEADER, TEXT_CHARS, TEXT_BYTES) if r is not None else ()
            n, kind_of = 0, None
            for x in rows:
                if x.type == TEXT_HEADER and x.end - x.start >= 4:
                    kind_of, = struct.unpack_from("<I", self.data, x.start)
                elif (text := self._text(x)) is not None:
                    yield k, n, kind_of, text
                    n += 1

    @cached_property
    def drawn(self) -> list[tuple]:
        """(kind, id, z, group's z, is group, records by type) of all shapes."""
        out = []
        for kind, k, key, r, _ in self.owners:
            if r is None:
                continue
            owner = k if kind == "slide" else key
            z = 0
            for d in oa.records(self.data, r.start, r.end):
                if d.type != DRAWING:
                    continue
                for dg in oa.records(self.data, d.start, d.end):
                    top = [x for x in oa.records(self.data, dg.start, dg.end) if x.type == oa.SPGR_GROUP]
                    stack = [(x, None, True) for x in reversed(top)]
                    while stack:
                        box, parent, outer = stack.pop()
                        if box.type == oa.SP_GROUP:
                            out.append((kind, owner, z, parent, False, {a.type: a for a in oa.records(self.data, box.start, box.end)}))
                            z += 1
                            continue
                        inner = list(oa.records(self.data, box.start, box.end))
                        own = parent
                        if inner and inner[0].type == oa.SP_GROUP and not outer:
                            out.append((kind, owner, z, parent, True, {a.type: a for a in oa.records(self.data, inner[0].start, inner[0].end)}))
                            own = z
                            z += 1
                        stack += [(x, own, False) for x in reversed(inner[1:]) if x.type in (oa.SP_GROUP, oa.SPGR_GROUP)]
        return out

    def _box(self, parts: dict) -> tuple[int, int, int, int, bool] | None:
        """(left, top, right, bottom, of the slide's own) of an anchor."""
        a = parts.get(oa.CLIENT_ANCHOR)
        if a is not None and a.end - a.start >= 8:
            t, l, r, b = struct.unpack_from("<iiii" if a.end - a.start >= 16 else "<hhhh", self.data, a.start)
            return min(l, r), min(t, b), max(l, r), max(t, b), True
        a = parts.get(oa.CHILD_ANCHOR)
        if a is not None and a.end - a.start >= 16:
            l, t, r, b = struct.unpack_from("<iiii", self.data, a.start)
            return min(l, r), min(t, b), max(l, r), max(t, b), False
        return None

    def shapes(self) -> Iterator[tuple]:
        for kind, owner, z, parent, group, parts in self.drawn:
            sp = parts.get(oa.FSP)
            shape = sp.instance if sp else 0
            box = self._box(parts)
            if box is None and shape == 0 and not group:
                continue
            props: dict = {}
            for t in oa.FOPTS:
                if t in parts:
                    props |= oa.properties(self.data, parts[t])
            num = lambda k: props.get(k) if isinstance(props.get(k), int) else None  # noqa: E731, B023
            color = lambda raw: None if raw is None else f"{raw & 255:02X}{raw >> 8 & 255:02X}{raw >> 16 & 255:02X}"
            fill, line = num(0x181), num(0x1C0)
            off = lambda k, bit: None if num(k) is None or not num(k) >> 16 + bit & 1 else not num(k) >> bit & 1  # noqa: E731, B023
            inner = (None,) * 4
            g = parts.get(oa.FSPGR)
            if group and g is not None and g.end - g.start >= 16:
                l, t, r, b = struct.unpack_from("<iiii", self.data, g.start)
                inner = min(l, r), min(t, b), abs(r - l), abs(b - t)
            l, t, r, b, own = box or (0, 0, 0, 0, True)
            image = num(0x104)
            flags = struct.unpack_from("<I", self.data, sp.start + 4)[0] if sp and sp.end - sp.start >= 8 else 0
            yield kind, owner, z, parent, group, own, shape, l, t, r - l, b - t, *inner, color(fill), fill, off(0x1BF, 4), num(0x182), color(line), line, off(0x1FF, 3), num(0x1CB), num(0x1CE), num(0x1D0), num(0x1D1), num(0x4), self._text_type(parts), image - 1 if image else None, *(num(k) for k in (0x100, 0x101, 0x102, 0x103, 0x1D2, 0x1D3, 0x1D4, 0x1D5, 0x81, 0x82, 0x83, 0x84, 0x85, 0x87)), bool(flags & 0x40), bool(flags & 0x80)

    def backgrounds(self) -> Iterator[tuple]:
        """(kind, id, color, raw color, picture) of each slide's or master's
        own background, the shape beside the group of its shapes."""
        for kind, k, key, r, _ in self.owners:
            if r is None:
                continue
            for d in oa.records(self.data, r.start, r.end):
                if d.type != DRAWING:
                    continue
                for dg in oa.records(self.data, d.start, d.end):
                    for sp in oa.records(self.data, dg.start, dg.end):
                        if sp.type != oa.SP_GROUP:
                            continue
                        parts = {a.type: a for a in oa.records(self.data, sp.start, sp.end)}
                        flags = struct.unpack_from("<I", self.data, parts[oa.FSP].start + 4)[0] if oa.FSP in parts and parts[oa.FSP].end - parts[oa.FSP].start >= 8 else 0
                        props = oa.properties(self.data, parts[oa.FOPT]) if oa.FOPT in parts else {}
                        fill, picture = props.get(0x181), props.get(0x186)
                        if flags & 0x400 and (isinstance(fill, int) or isinstance(picture, int)):
                            color = f"{fill & 255:02X}{fill >> 8 & 255:02X}{fill >> 16 & 255:02X}" if isinstance(fill, int) else None
                            yield kind, k if kind == "slide" else key, color, fill if isinstance(fill, int) else None, picture - 1 if isinstance(picture, int) and picture else None

    def geometry(self) -> Iterator[tuple]:
        """(kind, id, z, width and height of the path's own coordinates,
        vertices, segments) of shapes with paths of their own: points, and
        runs of one kind of step with their numbers."""
        for kind, owner, z, _, _, parts in self.drawn:
            props = oa.properties(self.data, parts[oa.FOPT]) if oa.FOPT in parts else {}
            points, steps = props.get(0x145), props.get(0x146)
            if not isinstance(points, bytes) or len(points) < 6:
                continue
            n, _, size = struct.unpack_from("<HHH", points)
            # a size of 0xFFF0 means points of two short numbers
            form, width = ("<hh", 4) if size in (4, 0xFFF0) else ("<ii", 8)
            found = [struct.unpack_from(form, points, 6 + width * i) for i in range(min(n, (len(points) - 6) // width))]
            words = struct.unpack_from(f"<{(len(steps) - 6) // 2}H", steps, 6) if isinstance(steps, bytes) and len(steps) > 6 else ()
            box = [v if isinstance(v := props.get(k), int) and v else 21600 for k in (0x142, 0x143)]
            yield kind, owner, z, *box, [{"x": x, "y": y} for x, y in found], [{"seg_type": w >> 13, "count": w & 0x1FFF} for w in words]

    def _text_type(self, parts: dict) -> int | None:
        box = parts.get(oa.TEXTBOX)
        if box is not None:
            for r in oa.records(self.data, box.start, box.end):
                if r.type == TEXT_HEADER and r.end - r.start >= 4:
                    return struct.unpack_from("<I", self.data, r.start)[0]
        return None

    def runs(self) -> Iterator[tuple]:
        """Paragraphs and runs of every shape's text: lines within a paragraph
        run take its properties, and each stretch of a character run its own."""
        for kind, owner, z, _, _, parts in self.drawn:
            box = parts.get(oa.TEXTBOX)
            if box is None:
                continue
            text, style = None, None
            for r in oa.records(self.data, box.start, box.end):
                if text is None and (found := self._text(r)) is not None:
                    text = found.split("\0")[0] if r.type == TEXT_BYTES else found
                elif r.type == TEXT_STYLE:
                    style = r
            if text is None:
                continue
            paras, chars = text_runs(self.body(style), len(text)) if style else ([], [])
            yield from ((kind, owner, z, *row) for row in styled_lines(text, paras, chars, self.fonts))

    def pictures(self) -> Iterator[tuple]:
        rows = list(oa.stored_pictures(self.data, self.images, self.document.start, self.document.end))
        yield from rows if any(r[2] for r in rows) else oa.stream_pictures(self.images)

    def master_styles(self) -> Iterator[tuple]:
        """(master, text type, level, properties): the masters' styles, and
        those of the environment under no master."""
        boxes = [(key, r) for kind, _, key, r, _ in self.owners if kind == "master" and r is not None]
        boxes += [(None, r) for r in oa.records(self.data, self.document.start, self.document.end) if r.type == ENVIRONMENT]
        for key, box in boxes:
            for r in oa.records(self.data, box.start, box.end):
                if r.type != MASTER_STYLE:
                    continue
                f = Fields(self.body(r))
                try:
                    for i in range(f.get("H")):
                        level = f.get("H") if r.instance >= 5 else i
                        paragraph_fields(f)
                        c = character_fields(f)
                        yield key, r.instance, level, c.get("font_size"), _font(c, self.fonts), c.get("bold"), c.get("italic"), c.get("color_raw")
                except struct.error:
                    continue


def _font(props: dict, fonts: list[str]) -> str | None:
    k = props.get("font_idx")
    return fonts[k] if k is not None and k < len(fonts) else None


def styled_lines(text: str, paras: list, chars: list, fonts: list[str]) -> Iterator[tuple]:
    """(paragraph, run, text, level, alignment, bullet, font, size, bold,
    italic, underline, raw color, line spacing); an empty line has one empty
    run."""
    edges, at = [], 0
    for n, props in chars:
        edges.append((at, at + n, props))
        at += n
    levels, at = [], 0
    for n, level, props in paras:
        levels.append((at, at + n, level, props))
        at += n
    start = 0
    lines = []
    for i, c in enumerate(text):
        if c in "\r\n":
            if c == "\n" and i and text[i - 1] == "\r":
                start = i + 1
                continue
            lines.append((start, i))
            start = i + 1
    if start < len(text) or not lines:
        lines.append((start, len(text)))
    for k, (a, b) in enumerate(lines):
        level, para = next(((v, p) for s, e, v, p in levels if s <= a < e), (0, {}))
        cuts = [(max(a, s), min(b, e), p) for s, e, p in edges if s < b and e > a]
        done = max((e for _, e, _ in cuts), default=a)
        if done < b or not cuts:
            cuts.append((done, b, {}))
        for j, (s, e, p) in enumerate(cuts):
            yield k, j, text[s:e], level, para.get("alignment"), para.get("bullet"), _font(p, fonts), p.get("font_size"), p.get("bold"), p.get("italic"), p.get("underline"), p.get("color_raw"), para.get("line_spacing")


presentation = last_of(Presentation)


def record_rows(data: bytes):
    p = presentation(data)
    for r, depth, parent in oa.tree(p.data):
        yield r.offset, depth, parent, r.ver, r.instance, r.type, r.end - r.start, None if r.ver == 15 else p.body(r)


def info_rows(data: bytes):
    p = presentation(data)
    yield *p.size(), sum(o[0] == "slide" for o in p.owners), sum(o[0] == "master" for o in p.owners), p.fonts


def rows_of(name: str):
    def rows(data: bytes):
        yield from getattr(presentation(data), name)()

    return rows


_OWNER = "owner_kind string, owner_id bigint, z int"
TABLES = {
    "ppt_records": ("offset bigint, depth int, parent_offset bigint, rec_ver int, rec_instance int, rec_type int, rec_len bigint, body binary", record_rows),
    "ppt_persist": ("edit_seq int, persist_id bigint, offset bigint", rows_of("persist")),
    "ppt_presentations": ("width int, height int, n_slides int, n_masters int, fonts array<string>", info_rows),
    "ppt_slides": ("slide_idx int, slide_id bigint, layout_type int, master_ref bigint, has_record boolean", rows_of("slides")),
    "ppt_schemes": ("owner_kind string, owner_id bigint, colors array<string>", rows_of("schemes")),
    "ppt_texts": ("slide_idx int, text_idx int, text_type int, text string", rows_of("texts")),
    "ppt_shapes": (f"{_OWNER}, group_z int, is_group boolean, own_anchor boolean, shape_type int, l bigint, t bigint, w bigint, h bigint, gx bigint, gy bigint, gw bigint, gh bigint, fill_color string, fill_raw bigint, no_fill boolean, fill_opacity bigint, line_color string, line_raw bigint, no_line boolean, line_width bigint, line_dash bigint, line_start bigint, line_end bigint, rotation_raw bigint, text_type int, image_idx int, crop_top bigint, crop_bottom bigint, crop_left bigint, crop_right bigint, start_width bigint, start_length bigint, end_width bigint, end_length bigint, inset_left bigint, inset_top bigint, inset_right bigint, inset_bottom bigint, wrap bigint, anchor bigint, flip_h boolean, flip_v boolean", rows_of("shapes")),
    "ppt_backgrounds": ("owner_kind string, owner_id bigint, color string, color_raw bigint, image_idx int", rows_of("backgrounds")),
    "ppt_geometry": (f"{_OWNER}, geo_w bigint, geo_h bigint, vertices array<struct<x:int,y:int>>, segments array<struct<seg_type:int,count:int>>", rows_of("geometry")),
    "ppt_runs": (f"{_OWNER}, para_idx int, run_idx int, text string, level int, alignment int, bullet boolean, font_name string, font_size int, bold boolean, italic boolean, underline boolean, color_raw bigint, line_spacing int", rows_of("runs")),
    "ppt_master_styles": ("master_id bigint, text_type int, level int, font_size int, font_name string, bold boolean, italic boolean, color_raw bigint", rows_of("master_styles")),
    "ppt_images": ("image_idx int, format string, data binary", rows_of("pictures")),
}
