"""Legacy office files built from rows: the parsers' inverse. Queries and tests read them."""

from __future__ import annotations

import struct

END, FREE, FATSECT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(streams: dict[str, bytes], version: int = 3, scatter: bool = False) -> bytes:
    """A compound file of top-level streams; ``scatter`` puts the sectors of
    each chain, mini sectors included, in falling order."""
    sector = 512 if version == 3 else 4096
    small = {k: v for k, v in streams.items() if 0 < len(v) < 4096}
    mini_fat: list[int] = []
    mini = b""
    starts: dict[str, int] = {}

    def chain(n: int, first: int) -> tuple[list[int], list[int]]:
        """Order of n sectors from ``first``, and the table entries of them."""
        order = list(range(first, first + n))
        if scatter:
            order.reverse()
        nxt = {a: b for a, b in zip(order, order[1:])} | ({order[-1]: END} if order else {})
        return order, [nxt[i] for i in range(first, first + n)]

    for name, data in small.items():
        n = -(-len(data) // 64)
        order, entries = chain(n, len(mini_fat))
        parts = dict(zip(order, (data[64 * i : 64 * i + 64].ljust(64, b"\0") for i in range(n))))
        mini += b"".join(parts[i] for i in sorted(parts))
        mini_fat += entries
        starts[name] = order[0]
    blocks: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // sector)
        if not n:
            return END
        order, entries = chain(n, len(fat))
        parts = dict(zip(order, (data[sector * i : sector * i + sector].ljust(sector, b"\0") for i in range(n))))
        blocks.extend(parts[i] for i in sorted(parts))
        fat.extend(entries)
        return order[0]

    for name, data in streams.items():
        if name not in small:
            starts[name] = put(data)
    root = put(mini)
    mini_table = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // sector) * sector, b"\xff")) if mini_fat else END
    entries = [("Root Entry", 5, root, len(mini))] + [(k, 2, starts[k], len(v)) for k, v in streams.items()]
    directory = b""
    for name, kind, start, size in entries:
        raw = (name + "\0").encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, FREE, FREE, FREE) + bytes(36) + struct.pack("<IQ", start, size)
    directory_start = put(directory)
    each = sector // 4
    n_fat = 1
    while n_fat * each < len(fat) + n_fat:
        n_fat += 1
    fat_at = list(range(len(fat), len(fat) + n_fat))
    table = fat + [FATSECT] * n_fat
    table += [FREE] * (n_fat * each - len(table))
    blocks += [struct.pack(f"<{each}I", *table[each * i : each * i + each]) for i in range(n_fat)]
    difat = (fat_at + [FREE] * 109)[:109]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, version, 0xFFFE, 9 if version == 3 else 12, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, n_fat, directory_start, 0, 4096, mini_table, -(-len(mini_fat) * 4 // sector) if mini_fat else 0, END, 0)
    head += struct.pack("<109I", *difat)
    return head.ljust(sector, b"\0") + b"".join(blocks)


def record(number: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", number, len(body)) + body


def short_string(text: str, count: str = "B", wide: bool | None = None) -> bytes:
    wide = any(ord(c) > 255 for c in text) if wide is None else wide
    return struct.pack(f"<{count}B", len(text), int(wide)) + (text.encode("utf-16-le") if wide else text.encode("latin-1"))


def shared_strings(strings: list, cut: int | None = None) -> bytes:
    """An SST of strings, or (text, runs) pairs; with ``cut`` its records hold
    so many bytes at most."""
    parts, part = [], struct.pack("<II", len(strings), len(strings))
    limit = cut or 8224

    def flush():
        nonlocal part
        parts.append(part)
        part = b""

    def raw(data: bytes):
        nonlocal part
        while data:
            if len(part) >= limit:
                flush()
            n = limit - len(part)
            part, data = part + data[:n], data[n:]

    for s in strings:
        text, runs = s if isinstance(s, tuple) else (s, [])
        wide = any(ord(c) > 255 for c in text)
        head = struct.pack("<HB", len(text), wide | (8 if runs else 0)) + (struct.pack("<H", len(runs)) if runs else b"")
        if len(part) + len(head) > limit:
            flush()
        raw(head)
        width = 2 if wide else 1
        for c in text:
            if len(part) + width > limit:
                flush()
                part = bytes([wide])
            part += c.encode("utf-16-le") if wide else c.encode("latin-1")
        for run in runs:
            raw(struct.pack("<HH", *run))
    flush()
    return record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:])


def rk(value: float, hundredths: bool = False) -> int:
    n = round(value * 100) if hundredths else value
    if float(n) == int(n) and -(1 << 29) <= int(n) < 1 << 29:
        return (int(n) & 0x3FFFFFFF) << 2 | 2 | hundredths
    high, = struct.unpack("<I", struct.pack("<d", n)[4:])
    return high & 0xFFFFFFFC | hundredths


def workbook(sheets: list[tuple[str, list[bytes]]], strings: list | None = None, formats: dict[int, str] | None = None, xfs: list[int] | None = None, biff8: bool = True, codepage: int = 1252, date1904: bool = False, cut: int | None = None, **shape) -> bytes:
    """A workbook file; each sheet is a name and its cell records."""
    bof = lambda kind: record(0x809, struct.pack("<HHHH", 0x600 if biff8 else 0x500, kind, 0, 0) + (bytes(8) if biff8 else b""))
    codec = {1252: "cp1252", 1251: "cp1251"}[codepage]
    head = bof(5) + record(0x42, struct.pack("<H", codepage)) + record(0x22, struct.pack("<H", int(date1904)))
    for ifmt, pattern in (formats or {}).items():
        head += record(0x41E, struct.pack("<H", ifmt) + (short_string(pattern, "H") if biff8 else bytes([len(pattern)]) + pattern.encode(codec)))
    for ifmt in xfs or [0] * 16:
        head += record(0xE0, struct.pack("<HH", 0, ifmt) + bytes(16))
    names = [short_string(n) if biff8 else bytes([len(n)]) + n.encode(codec) for n, _ in sheets]
    tail = (shared_strings(strings or [], cut) if biff8 else b"") + record(0x0A)
    at = len(head) + sum(10 + len(n) for n in names) + len(tail)
    bodies, marks = b"", b""
    for name, (_, cells) in zip(names, sheets):
        marks += record(0x85, struct.pack("<IBB", at + len(bodies), 0, 0) + name)
        bodies += bof(16) + b"".join(cells) + record(0x0A)
    return compound({"Workbook" if biff8 else "Book": head + marks + tail + bodies}, **shape)


def number(row, col, value, xf=15):
    return record(0x203, struct.pack("<HHHd", row, col, xf, value))


def rk_cell(row, col, value, xf=15, hundredths=False):
    return record(0x27E, struct.pack("<HHHI", row, col, xf, rk(value, hundredths)))


def mul_rk(row, col, values, xf=15):
    return record(0xBD, struct.pack("<HH", row, col) + b"".join(struct.pack("<HI", xf, rk(v)) for v in values) + struct.pack("<H", col + len(values) - 1))


def mul_blank(row, col, n, xf=15):
    return record(0xBE, struct.pack("<HH", row, col) + struct.pack("<H", xf) * n + struct.pack("<H", col + n - 1))


def blank(row, col, xf=15):
    return record(0x201, struct.pack("<HHH", row, col, xf))


def label_sst(row, col, k, xf=15):
    return record(0xFD, struct.pack("<HHHI", row, col, xf, k))


def label(row, col, text, xf=15, codec=None):
    body = struct.pack("<H", len(text)) + text.encode(codec) if codec else short_string(text, "H")
    return record(0x204, struct.pack("<HHH", row, col, xf) + body)


def bool_err(row, col, value, error=0, xf=15):
    return record(0x205, struct.pack("<HHHBB", row, col, xf, value, error))


def sprm(code: int, value: int | bytes) -> bytes:
    """One property; sizes by its code."""
    size = (1, 1, 2, 4, 2, 2, -1, 3)[code >> 13]
    if isinstance(value, bytes):
        count = struct.pack("<H", len(value) + 1) if code == 0xD608 else bytes([len(value)])
        return struct.pack("<H", code) + (count if size < 0 else b"") + value
    return struct.pack("<H", code) + (value & (1 << 8 * size) - 1).to_bytes(size, "little")


def style(name: str, sti: int, base: int = 0xFFF, kind: int = 1, paras: bytes = b"", chars: bytes = b"") -> bytes:
    std = struct.pack("<HH", sti, base << 4 | kind) + bytes(6)
    std += struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
    for part in ([b"\0\0" + paras, chars] if kind == 1 else [chars]):
        std += b"\0" * (len(std) % 2) + struct.pack("<H", len(part)) + part
    return std


def _fkp(runs: list[tuple[int, int, bytes | None]], entry: int) -> bytes:
    """A page of property runs (first byte, past the last, properties)."""
    page = bytearray(512)
    head = 4 * (len(runs) + 1)
    struct.pack_into(f"<{len(runs) + 1}I", page, 0, *[a for a, _, _ in runs], runs[-1][1])
    at = 511
    for j, (_, _, props) in enumerate(runs):
        if props is None:
            continue
        body = bytes([len(props)]) + props if entry == 1 else bytes([0, len(props + b"\0" * (len(props) % 2)) // 2]) + props
        at = (at - len(body)) // 2 * 2
        page[at : at + len(body)] = body
        page[head + entry * j] = at // 2
    page[511] = len(runs)
    return bytes(page)


def document(pieces: list, chars: list = (), paras: list = (), styles: list[bytes] = (), fonts: list[str] = (), lists: list = (), overrides: list[int] = (), sections: list = (), stories: list[str] = (), lid: int = 0x409, codec: str = "cp1252", pictures: bytes = b"", align: int = 4, **shape) -> bytes:
    """A document of text pieces, a string or (string, wide). ``chars`` and
    ``paras`` are (first place, past the last, properties); a paragraph's
    properties are (istd, properties)."""
    pieces = [p if isinstance(p, tuple) else (p, True) for p in pieces]
    main = "".join(t for t, _ in pieces)
    if stories:
        pieces = [*pieces, ("".join(stories), True)]
    fib_size = 32 + 2 + 28 + 2 + 88 + 2 + 8 * 0x5D
    body, table = bytearray(1024), bytearray(8)
    places, entries, byte_of = [0], [], []
    for text, wide in pieces:
        fc = len(body)
        body += text.encode("utf-16-le") if wide else text.encode(codec)
        byte_of += [fc + i * (2 if wide else 1) for i in range(len(text))]
        end = len(body)
        places.append(places[-1] + len(text))
        entries.append(struct.pack("<HIH", 0, fc if wide else fc * 2 | 0x40000000, 0))
        body += b"\0" * (-len(body) % align)
    last = end
    offset = lambda cp: byte_of[cp] if cp < len(byte_of) else last
    after = lambda cp: byte_of[cp - 1] + (2 if _wide(pieces, cp - 1) else 1) if cp else 1024
    words: dict[int, tuple[int, int]] = {}

    def put(index: int, data: bytes, counted: int | None = None) -> None:
        if data:
            words[index] = len(table), len(data) if counted is None else counted
            table.extend(data + b"\0" * (-len(data) % 4))

    for index, runs, entry in ((24, [(a, b, p) for a, b, p in chars], 1), (26, [(a, b, struct.pack("<H", p[0]) + p[1] if p is not None else None) for a, b, p in paras], 13)):
        if runs:
            pages = [runs[i : i + 8] for i in range(0, len(runs), 8)]
            body += b"\0" * (-len(body) % 512)
            numbers = []
            for page in pages:
                numbers.append(len(body) // 512)
                body += _fkp([(offset(a), after(b), p) for a, b, p in page], entry)
            put(index, struct.pack(f"<{len(pages) + 1}I", *[offset(p[0][0]) for p in pages], after(pages[-1][-1][1])) + struct.pack(f"<{len(numbers)}I", *numbers))
    clx = b"\x01\x02\x00\xab\xcd\x02"
    plc = struct.pack(f"<{len(places)}I", *places) + b"".join(entries)
    put(66, clx + struct.pack("<I", len(plc)) + plc)
    if styles:
        put(2, struct.pack("<HHH", 18, len(styles), 10) + bytes(14) + b"".join(struct.pack("<H", len(s)) + s for s in styles))
    if fonts:
        each = [bytes(39) + (f + "\0").encode("utf-16-le") for f in fonts]
        put(30, struct.pack("<HHH", 0xFFFF, len(each), 0) + b"".join(bytes([len(e)]) + e for e in each))
    if lists:
        head = struct.pack("<H", len(lists)) + b"".join(struct.pack("<I", key) + bytes(22) + b"\x01\0" for key, _, _ in lists)
        levels = b"".join(bytes(4) + bytes([nfc]) + bytes(23) + struct.pack("<H", len(text)) + text.encode("utf-16-le") for _, nfc, text in lists)
        put(146, head + levels, len(head))
    if overrides:
        put(148, struct.pack("<I", len(overrides)) + b"".join(struct.pack("<I", k) + bytes(12) for k in overrides))
    if sections:
        ends = [0, *[e for e, _ in sections]]
        seds = b""
        for _, props in sections:
            seds += struct.pack("<HIHI", 0, len(body), 0, 0)
            body += struct.pack("<H", len(props)) + props
        put(12, struct.pack(f"<{len(ends)}I", *ends) + seds)
    if stories:
        ends = [0]
        for s in stories:
            ends.append(ends[-1] + len(s))
        put(22, struct.pack(f"<{len(ends)}I", *ends))
    longs = [0] * 22
    longs[3], longs[5] = len(main), sum(map(len, stories))
    fib = struct.pack("<HHHHHH", 0xA5EC, 0xC1, 0, lid, 0, 0x0200).ljust(32, b"\0") + struct.pack("<H", 14) + bytes(28) + struct.pack("<H", 22) + struct.pack("<22I", *longs) + struct.pack("<H", 0x5D)
    flat = [0] * (2 * 0x5D)
    for k, (fc, lcb) in words.items():
        flat[k], flat[k + 1] = fc, lcb
    fib += struct.pack(f"<{len(flat)}I", *flat)
    assert len(fib) == fib_size <= 1024
    body[: len(fib)] = fib
    return compound({"WordDocument": bytes(body), "1Table": bytes(table), "Pictures": pictures, "Other": b"x"}, **shape)


def _wide(pieces, cp: int) -> bool:
    for text, wide in pieces:
        if cp < len(text):
            return wide
        cp -= len(text)
    return True


def drawing(kind: int, body: bytes, instance: int = 0, container: bool = False) -> bytes:
    return struct.pack("<HHI", instance << 4 | (15 if container else 0), kind, len(body)) + body


def picture(name: str, data: bytes, two: bool = False) -> bytes:
    import zlib

    kind, instance = {"EMF": (0xF01A, 0x3D4), "WMF": (0xF01B, 0x216), "PICT": (0xF01C, 0x542), "JPEG": (0xF01D, 0x46A), "PNG": (0xF01E, 0x6E0), "DIB": (0xF01F, 0x7A8), "TIFF": (0xF029, 0x6E4)}[name]
    ids = bytes(32 if two else 16)
    if name in ("EMF", "WMF", "PICT"):
        packed = zlib.compress(data)
        ids += struct.pack("<I", len(data)) + bytes(24) + struct.pack("<I", len(packed)) + b"\0\xfe"
        return drawing(kind, ids + packed, instance + two)
    return drawing(kind, ids + b"\xff" + data, instance + two)


def text_style(paras: list[tuple[int, int, bytes]], chars: list[tuple[int, bytes]]) -> bytes:
    return drawing(0xFA1, b"".join(struct.pack("<IH", n, level) + p for n, level, p in paras) + b"".join(struct.pack("<I", n) + c for n, c in chars))


def properties(**values) -> bytes:
    """Shape properties by name like p181 for number 0x181."""
    rows = [(int(k[1:], 16), v) for k, v in values.items()]
    return drawing(0xF00B, b"".join(struct.pack("<HI", k, v & 0xFFFFFFFF) for k, v in rows), len(rows))


def shape(kind: int, box: tuple[int, int, int, int] | None, *more: bytes, child: bool = False) -> bytes:
    """A shape; the box is left, top, right, bottom."""
    parts = drawing(0xF00A, struct.pack("<II", 1, 0), kind) + b"".join(more)
    if box:
        l, t, r, b = box
        parts += drawing(0xF00F, struct.pack("<iiii", l, t, r, b)) if child else drawing(0xF010, struct.pack("<hhhh", t, l, r, b))
    return drawing(0xF004, parts, container=True)


def group(box, inner, *children: bytes) -> bytes:
    head = drawing(0xF009, struct.pack("<iiii", *inner)) + drawing(0xF00A, struct.pack("<II", 1, 1), 0)
    head += drawing(0xF010, struct.pack("<hhhh", box[1], box[0], box[2], box[3]))
    return drawing(0xF003, drawing(0xF004, head, container=True) + b"".join(children), container=True)


def text_box(kind: int, text: str, style: bytes = b"", wide: bool = True) -> bytes:
    chars = drawing(0xFA0, text.encode("utf-16-le")) if wide else drawing(0xFA8, text.encode("latin-1"))
    return drawing(0xF00D, drawing(0xF9F, struct.pack("<I", kind)) + chars + style, container=True)


def presentation(slides: list[list[bytes]], masters: list[list[bytes]] = (), fonts: list[str] = (), listed: list[list[bytes]] = (), pictures: list[bytes] = (), scheme: list[str] = (), master_styles: bytes = b"", background: bytes = b"", size: tuple[int, int] = (5760, 4320)) -> bytes:
    """A presentation; slides and masters are lists of shapes."""
    stream = b""
    offsets = {}

    def put(key: int, record: bytes) -> None:
        nonlocal stream
        offsets[key] = len(stream)
        stream += record

    def sheet(kind: int, atoms: bytes, shapes: list[bytes]) -> bytes:
        patriarch = drawing(0xF004, drawing(0xF009, bytes(16)) + drawing(0xF00A, bytes(8)), container=True)
        back = drawing(0xF004, drawing(0xF00A, struct.pack("<II", 9, 0x400), 1) + background, container=True) if background and kind == 0x3F8 else b""
        box = drawing(0xF002, drawing(0xF003, patriarch + b"".join(shapes), container=True) + back, container=True)
        colors = drawing(0x7F0, b"".join(bytes.fromhex(c) + b"\0" for c in scheme), 1) if scheme and kind == 0x3F8 else b""
        return drawing(kind, atoms + (master_styles if kind == 0x3F8 else b"") + drawing(0x40C, box, container=True) + colors, container=True)

    atom = lambda master: drawing(0x3EF, struct.pack("<I8sII", 1, bytes(8), master, 0) + bytes(4))
    for i, shapes in enumerate(masters):
        put(100 + i, sheet(0x3F8, atom(0), shapes))
    for i, shapes in enumerate(slides):
        put(10 + i, sheet(0x3EE, atom(0x80000000 if masters else 0), shapes))
    names = drawing(0x7D5, b"".join(drawing(0xFB7, (f + "\0").encode("utf-16-le").ljust(64, b"\0") + bytes(4)) for f in fonts), container=True)
    entry = lambda persist, key: drawing(0x3F3, struct.pack("<IIIII", persist, 0, 0, key, 0))
    rows = b"".join(entry(10 + i, 256 + i) + b"".join(listed[i] if i < len(listed) else []) for i in range(len(slides)))
    document = drawing(0x3E9, struct.pack("<ii", *size) + bytes(32)) + drawing(0x3F2, names, container=True)
    if pictures:
        blobs, store = b"", b""
        for p in pictures:
            store += drawing(0xF007, bytes(24) + struct.pack("<I", 1) + struct.pack("<I", len(blobs)) + bytes(4))
            blobs += p
        document += drawing(0x40B, drawing(0xF000, drawing(0xF001, store, len(pictures), True), container=True), container=True)
    document += drawing(0xFF0, rows, 0, True) + drawing(0xFF0, b"".join(entry(100 + i, 0x80000000 + i) for i in range(len(masters))), 1, True)
    put(1, drawing(0x3E8, document, container=True))
    directory = len(stream)
    stream += drawing(0x1772, b"".join(struct.pack("<II", k | 1 << 20, o) for k, o in offsets.items()))
    edit = len(stream)
    stream += drawing(0xFF5, struct.pack("<IHBBIII", 0, 0, 0, 3, 0, directory, 1) + bytes(8))
    user = drawing(0xFF6, struct.pack("<III", 20, 0xE391C05F, edit) + bytes(8))
    return compound({"PowerPoint Document": stream, "Current User": user, "Pictures": b"".join(pictures)})
