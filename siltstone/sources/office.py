"""Texts of workbooks, PDF files and word-processor files, from their bytes alone."""

from __future__ import annotations

import io
import re
import struct
import zlib

from .tabular import sheet_rows


def xlsx_text(content: bytes) -> str:
    """The first sheet, a line a row, cells apart by tabs."""
    rows = sheet_rows(io.BytesIO(content))
    return "\n".join("\t".join(cells.get(c, "") for c in range(max(cells) + 1)) for _, cells in sorted(rows.items()) if cells)


# PDF

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\[((?:\\.|\((?:\\.|[^\\)])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|ET|-?[\d.]+\s+-?[\d.]+\s+T[dD])", re.DOTALL)
_STRING = re.compile(rb"\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>|-?\d+\.?\d*", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
#: How far (in thousandths of a letter) two parts of a shown text stand apart if there is a blank between them.
GAP = -180


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def pdf_text(content: bytes) -> str:
    """Texts that a PDF's pages show, in the order of its streams: literal and hex strings of simple fonts, plain or deflated.

    Fonts with an encoding of their own (most that are cut down to the letters used) aren't decoded; encrypted files raise ValueError.
    """
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if b"/Encrypt" in content:
        raise ValueError("an encrypted PDF")
    out: list[str] = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" not in body:
            continue
        line = ""
        for array, shown, move in _SHOWN.findall(body):
            if move:
                out.append(line)
                line = ""
            elif shown:
                line += _string(shown)
            else:
                for part in _STRING.findall(array):
                    if part[:1] in b"(<":
                        line += _string(part)
                    elif float(part) < GAP:
                        line += " "
        out.append(line)
    return "\n".join(x.strip() for x in out if x.strip())


# HWP: a compound file whose sections are records

FREE = 0xFFFFFFFA  # sector numbers from here on are no sectors
PARAGRAPH = 67
#: Control characters of a paragraph that stand alone; all others below 32 take eight places.
SINGLE = {0, 10, 13, *range(24, 32)}


def compound_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path, names apart by /."""
    if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    big, small = (1 << x for x in struct.unpack("<HH", content[30:34]))
    first_dir, limit, first_mini = struct.unpack("<I", content[48:52])[0], *struct.unpack("<II", content[56:64])
    next_table, tables = struct.unpack("<II", content[68:76])

    def sector(n: int) -> bytes:
        return content[(n + 1) * big : (n + 2) * big]

    places = list(struct.unpack("<109I", content[76:512]))
    for _ in range(tables):
        more = struct.unpack(f"<{big // 4}I", sector(next_table))
        places += more[:-1]
        next_table = more[-1]
    fat = [x for n in places if n < FREE for x in struct.unpack(f"<{big // 4}I", sector(n))]

    def chain(n: int, links: list[int]) -> list[int]:
        out = []
        while n < FREE and len(out) <= len(links):
            out.append(n)
            n = links[n]
        return out

    def joined(n: int) -> bytes:
        return b"".join(map(sector, chain(n, fat)))

    directory = joined(first_dir)
    entries = []
    for i in range(0, len(directory), 128):
        e = directory[i : i + 128]
        size = struct.unpack("<H", e[64:66])[0]
        entries.append((e[: max(size - 2, 0)].decode("utf-16-le"), e[66], struct.unpack("<III", e[68:80]), struct.unpack("<I", e[116:120])[0], struct.unpack("<Q", e[120:128])[0]))
    mini = joined(entries[0][3])
    minifat = list(struct.unpack(f"<{len(m := joined(first_mini)) // 4}I", m)) if first_mini < FREE else []
    found: dict[str, bytes] = {}
    stack = [(entries[0][2][2], "")]
    while stack:
        n, path = stack.pop()
        if n >= len(entries):
            continue
        name, kind, (left, right, child), start, size = entries[n]
        stack += [(left, path), (right, path)]
        if kind == 1:
            stack.append((child, f"{path}{name}/"))
        elif kind == 2:
            data = b"".join(mini[k * small : (k + 1) * small] for k in chain(start, minifat)) if size < limit else joined(start)
            found[path + name] = data[:size]
    return found


def _paragraph(data: bytes) -> str:
    units, out, i = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2]), [], 0
    while i < len(units):
        if units[i] >= 32:
            out.append(units[i])
        elif units[i] in (9, 10, 13):
            out.append(9 if units[i] == 9 else 10)
        i += 1 if units[i] >= 32 or units[i] in SINGLE else 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")


def hwp_text(content: bytes) -> str:
    """Paragraphs of all sections, or the preview where there is no section; a protected file raises ValueError."""
    streams = compound_streams(content)
    flags = struct.unpack("<I", streams["FileHeader"][36:40])[0] if len(streams.get("FileHeader", b"")) >= 40 else 0
    if flags & 2:
        raise ValueError("a protected file")
    parts = []
    for name in sorted((n for n in streams if n.startswith("BodyText/Section")), key=lambda n: int(n.removeprefix("BodyText/Section"))):
        data = zlib.decompress(streams[name], -15) if flags & 1 else streams[name]
        at = 0
        while at + 4 <= len(data):
            head = struct.unpack("<I", data[at : at + 4])[0]
            size, at = head >> 20, at + 4
            if size == 0xFFF:
                size, at = struct.unpack("<I", data[at : at + 4])[0], at + 4
            if head & 0x3FF == PARAGRAPH:
                parts.append(_paragraph(data[at : at + size]).strip("\n"))
            at += size
    return "\n".join(parts) if parts else streams.get("PrvText", b"").decode("utf-16-le", "replace")
