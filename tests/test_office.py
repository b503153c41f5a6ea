"""Texts of workbooks, PDF and word-processor files that are built here byte by byte."""

import struct
import zipfile
import zlib

import pytest

from siltstone.sources import files, office, tabular

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, rows, styles="", book=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS}"><sheetData>{rows}</sheetData></worksheet>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}">{styles}</styleSheet>')
        if book:
            z.writestr("xl/workbook.xml", book)


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs>'
ROWS = '<row r="1"><c r="A1" t="inlineStr"><is><t>Day</t></is></c><c r="B1" t="inlineStr"><is><t>At</t></is></c><c r="C1" t="inlineStr"><is><t>Own</t></is></c><c r="D1" t="inlineStr"><is><t>N</t></is></c></row><row r="2"><c r="A2" s="1"><v>45322</v></c><c r="B2" s="4"><v>45322.75</v></c><c r="C2" s="2"><v>61</v></c><c r="D2" s="3"><v>45322</v></c></row>'


def test_dates_of_a_workbook(spark, tmp_path):
    workbook(tmp_path / "d.xlsx", ROWS, STYLES)
    df = tabular.load(spark, "dated", str(tmp_path / "d.xlsx"))
    assert df.dtypes == [("day", "date"), ("at", "timestamp_ntz"), ("own", "date"), ("n", "bigint")]
    assert [str(x) for x in df.first()] == ["2024-01-31", "2024-01-31 18:00:00", "1900-03-01", "45322"]
    workbook(tmp_path / "e.xlsx", ROWS, STYLES, '<workbook><workbookPr date1904="1"/></workbook>')
    assert str(tabular.load(spark, "later", str(tmp_path / "e.xlsx")).first()[0]) == "2028-02-01"
    assert tabular.date_text(1) == "1900-01-01" and tabular.date_text(59) == "1900-02-28" and tabular.date_text(0.5) == "1899-12-31 12:00:00"
    assert office.xlsx_text((tmp_path / "d.xlsx").read_bytes()) == "Day\tAt\tOwn\tN\n2024-01-31\t2024-01-31 18:00:00\t1900-03-01\t45322"


def pdf(*streams):
    out = b"%PDF-1.4\n"
    for head, body in streams:
        out += b"1 0 obj\n<<" + head + b">>\nstream\n" + body + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


def test_pdf():
    page = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)\\041) Tj 0 -14 Td [(Se) 20 (cond) -250 (line)] TJ T* <C3A9> Tj ET"
    deflated = zlib.compress(b"BT (packed \\351) Tj ET")
    text = office.pdf_text(pdf((b"/Length 5", page), (b"/Filter /FlateDecode", deflated), (b"/Filter /DCTDecode", b"BT (no) Tj ET"), (b"", b"0 0 m (not text) S")))
    assert text == "Hello (world)!\nSecond line\nÃ©\npacked é"
    for bad in (b"text", b"%PDF-1.4 /Encrypt 5 0 R"):
        with pytest.raises(ValueError):
            office.pdf_text(bad)


def compound(streams, big=512, small=64, limit=4096):
    """A compound file with the streams {path: bytes}; folders one deep."""
    sectors, fat = [], []

    def put(data):
        first = len(sectors)
        n = max(1, -(-len(data) // big))
        for i in range(n):
            sectors.append(data[i * big : (i + 1) * big].ljust(big, b"\0"))
            fat.append(first + i + 1 if i < n - 1 else 0xFFFFFFFE)
        return first

    mini, minifat, entries = b"", [], [["Root Entry", 5, 0xFFFFFFFF, 0xFFFFFFFF, 0, 0]]
    folders = {}

    def add(name, kind, parent, start=0, size=0):
        entries.append([name, kind, 0xFFFFFFFF, 0xFFFFFFFF, start, size])
        me = len(entries) - 1
        if children.setdefault(parent, []):
            entries[children[parent][-1]][3] = me
        children[parent].append(me)
        return me

    children = {}
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        parent = 0
        if folder:
            parent = folders.setdefault(folder, 0) or folders.__setitem__(folder, add(folder, 1, 0)) or folders[folder]
        if len(data) < limit:
            start = len(mini) // small
            n = max(1, -(-len(data) // small))
            mini += data.ljust(n * small, b"\0")
            minifat += [*range(start + 1, start + n), 0xFFFFFFFE]
        else:
            start = put(data)
        add(name, 2, parent, start, len(data))
    entries[0][4], entries[0][5] = put(mini), len(mini)
    first_mini = put(struct.pack(f"<{len(minifat)}I", *minifat))
    table = b""
    for i, (name, kind, left, right, start, size) in enumerate(entries):
        raw = name.encode("utf-16-le")
        child = children[i][0] if i in children else 0xFFFFFFFF
        table += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    first_dir = put(table)
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(big, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, first_dir, 0, limit, first_mini, 1, 0xFFFFFFFE, 0, at)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def record(tag, data):
    return struct.pack("<I", tag | len(data) << 20) + data if len(data) < 0xFFF else struct.pack("<II", tag | 0xFFF << 20, len(data)) + data


def section(*paragraphs):
    return b"".join(record(66, b"head") + record(67, p) for p in paragraphs)


@pytest.mark.parametrize("packed", [0, 1])
def test_hwp(packed):
    control = struct.pack("<8H", 11, *range(100, 106), 11)
    one = "안녕 ".encode("utf-16-le") + control + "세계\r".encode("utf-16-le")
    long = ("긴 글 " * 3000).encode("utf-16-le")
    shut = (lambda x: zlib.compress(x)[2:-4]) if packed else (lambda x: x)
    header = b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", packed) + b"\0" * 20
    streams = {"FileHeader": header, "BodyText/Section0": shut(section(one, long)), "BodyText/Section1": shut(section("끝".encode("utf-16-le"))), "PrvText": "앞".encode("utf-16-le")}
    made = compound(streams)
    assert office.compound_streams(made) == streams
    assert office.hwp_text(made) == "\n".join(["안녕 세계", ("긴 글 " * 3000), "끝"])
    assert office.hwp_text(compound({"FileHeader": header, "PrvText": "앞".encode("utf-16-le")})) == "앞"
    with pytest.raises(ValueError):
        office.hwp_text(b"text")
    with pytest.raises(ValueError):
        office.hwp_text(compound({"FileHeader": header[:36] + struct.pack("<I", 2) + header[40:]}))


def test_routed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf((b"", b"BT (told) Tj ET")))
    (tmp_path / "b.hwp").write_bytes(compound({"FileHeader": b"\0" * 64, "PrvText": "앞".encode("utf-16-le")}))
    (tmp_path / "c.pdf").write_bytes(b"broken")
    workbook(tmp_path / "d.xlsx", ROWS, STYLES)
    got = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"]["text"] == "told" and got["b.hwp"]["text"] == "앞" and got["d.xlsx"]["text"].startswith("Day")
    assert got["c.pdf"]["status"].startswith("failed") and got["b.hwp"]["route"] == "HWP"


def test_bodies_of_a_page_service(spark):
    def get(title):
        if title == "gone":
            raise OSError("404")
        return '{"title": "' + title + '", "extract": "about", "more": [1], "content_urls": {"desktop": {"page": "http://p"}, "mobile": {}}}' if title != "odd" else "<html>"

    rows = files.fetch_bodies(spark.createDataFrame([("a_b",), ("odd",), ("gone",)], "title string"), get).collect()
    assert [tuple(r) for r in rows] == [("a b", "http://p", "about", "ok"), ("odd", None, None, "ok"), ("gone", None, None, "failed: 404")]
