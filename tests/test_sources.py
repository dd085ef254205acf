"""Document readers, images and files, on documents made here."""

import base64
import io
import json
import zipfile
import zlib

import numpy as np
import pytest

from grainfold.sources import files, formats, images


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("--", "."), data)
    return out.getvalue()


def box(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def read(data, suffix):
    found, reason, detail = formats.extract(data, suffix)
    assert reason is None, detail
    return found


def chart(seed=0, side=64):
    y, x = np.mgrid[:side, :side]
    px = np.stack([x * 3 % 256, y * 2 % 256, (x + y) % 256, np.full_like(x, 255)], axis=-1).astype(np.uint8)
    px[20:30, 20:40] = 10 + seed
    return images.encode_png(side, side, 4, px.tobytes())


PNG = chart()
REL = '<Relationships xmlns="r"><Relationship Id="r1" Target="../media/i.png"/></Relationships>'


def test_html():
    uri = "data:image/png;base64," + base64.b64encode(PNG).decode()
    page = f'<html><head><title>no</title><style>x</style></head><body><h1>Big title</h1><p>One <a href="http://x.invalid">link</a> &amp; two</p><ul><li>a</li><li>b</li></ul><script>bad()</script><figure><img alt="Alt" src="{uri}"><figcaption>Cap</figcaption></figure></body></html>'
    e = read(page.encode(), ".html")
    assert "BIG TITLE" in e.parts[0] and "link (http://x.invalid) & two" in e.parts[0] and "* a\n * b" in e.parts[0] and "bad" not in e.parts[0]
    assert e.images[0].data == PNG and e.images[0].location == "Section: Big title" and e.images[0].context == "Cap — Image alt text: Alt"
    assert formats.extract(b"<p> </p>", ".html")[1] == "empty"


def test_jsonl_parts_and_bad_lines():
    lines = [json.dumps({"b": i, "a": [1]}) for i in range(2500)]
    lines[5:5] = ["{bad", "", "NaN"]
    e = read("\n".join(lines).encode(), ".jsonl")
    assert [p.count("## Record ") for p in e.parts] == [1000, 1000, 500] and e.parts[1].startswith("## Record 1001\n\n{\n  \"b\"")
    assert "6, 8" in e.warnings[0] and formats.extract(b"\n\n", ".ndjson")[1] == "empty"


def test_notebook():
    book = {"metadata": {"kernelspec": {"language": "r"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a ``` b", "outputs": [{"data": {"image/png": [base64.b64encode(PNG).decode()], "text/plain": "y"}}]}]}
    e = read(json.dumps(book).encode(), ".ipynb")
    assert e.parts == ["# T\nx\n\n````r\na ``` b\n````"] and e.images[0].location == "Cell 2"
    assert formats.extract(b"[1]", ".ipynb")[1] == "extraction_failed" and formats.extract(b'{"cells": []}', ".ipynb")[1] == "empty"


def test_pptx_slides_in_numeric_order():
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><a:t>{t}</a:t><a:t>&amp; more</a:t><a:blip r:embed="r1"/></p:sld>'
    e = read(box({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/_rels/slide2.xml.rels": REL, "ppt/media/i.png": PNG}), ".pptx")
    assert e.parts == ["## Slide 2\n\ntwo & more\n\n## Slide 10\n\nten & more"] and e.images[0].location == "Slide 2"


def ods(rows):
    return box({"content.xml": f'<o:d xmlns:o="o" xmlns:table="t" xmlns:text="x"><table:table table:name="S">{rows}</table:table></o:d>'})


def test_ods_repeats_and_covered_cells():
    cell = "<table:table-cell{0}><text:p>{1}</text:p></table:table-cell>"
    rows = f'<table:table-row>{cell.format("", "a|b")}<table:covered-table-cell/>{cell.format(" table:number-columns-repeated=%s2%s" % (chr(34), chr(34)), "c")}<table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    rows += f'<table:table-row table:number-rows-repeated="2">{cell.format("", "d")}</table:table-row><table:table-row table:number-rows-repeated="1048570"><table:table-cell/></table:table-row>'
    e = read(ods(rows), ".ods")
    assert e.parts == ["## Sheet: S\n\n| a\\|b |  | c | c |\n| --- | --- | --- | --- |\n| d |  |  |  |\n| d |  |  |  |"]


def test_odp_counts_empty_pages_and_odt():
    e = read(box({"content.xml": '<o xmlns:draw="d" xmlns:t="t"><draw:page/><draw:page><t:p>x</t:p></draw:page></o>'}), ".odp")
    assert e.parts == ["## Slide 2\n\nx"]
    e = read(box({"content.xml": '<o xmlns:text="t" xmlns:xlink="l"><text:h>Head</text:h><text:p>Body<i xlink:href="Pictures/i.png"/></text:p></o>', "Pictures/i.png": PNG}), ".odt")
    assert e.parts == ["Head Body"] and e.images[0].location == "Section: Head" and e.images[0].context == "Head — Body"


def test_epub_spine_and_fallback():
    parts = {"META-INF/container.xml": '<c xmlns="c"><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p xmlns="p"><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="a"/></p>', "O/a.xhtml": "<p>first</p>", "O/b.xhtml": "<p>second</p>"}
    assert read(box(parts), ".epub").parts == ["second\n\nfirst"]
    e = read(box({k: v for k, v in parts.items() if k.startswith("O/") and k.endswith("xhtml")}), ".epub")
    assert e.parts == ["first\n\nsecond"] and "filename order" in e.warnings[0]


def test_xlsx():
    parts = {
        "xl/workbook.xml": '<w xmlns="w" xmlns:r="r"><sheets><sheet name="One" r:id="r1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R xmlns="r"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": '<s xmlns="s"><si><t>head|er</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></s>',
        "xl/worksheets/sheet1.xml": '<w xmlns="w"><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in\nline</t></is></c></row><row r="3"><c r="B3"><v>1.5</v></c><c r="A3" t="s"><v>1</v></c></row></w>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<R xmlns="r"><Relationship Id="d" Target="../drawings/drawing1.xml"/></R>', "xl/drawings/drawing1.xml": '<d xmlns="d" xmlns:a="a" xmlns:r="r"><x><from><col>1</col><row>2</row></from><a:blip r:embed="r1"/></x></d>', "xl/drawings/_rels/drawing1.xml.rels": REL, "xl/media/i.png": PNG,
    }
    e = read(box(parts), ".xlsx")
    assert e.parts == ["## Sheet: One\n\n| head\\|er |  | in line |\n| --- | --- | --- |\n|  |  |  |\n| rich text | 1.5 |  |"] and e.images[0].location == "Sheet One, near B3"


def test_docx_text_images_and_charts():
    doc = '<w:document xmlns:w="w" xmlns:a="a" xmlns:r="r" xmlns:c="c" xmlns:mc="mc"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t><w:t>world</w:t></w:r><mc:AlternateContent><mc:Choice><a:blip r:embed="r1"/></mc:Choice><mc:Fallback><a:blip r:embed="r9"/></mc:Fallback></mc:AlternateContent></w:p><w:p><c:chart r:id="c1"/></w:p></w:body></w:document>'
    parts = {
        "word/document.xml": doc, "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>', "word/media/i.png": PNG,
        "word/_rels/document.xml.rels": '<R xmlns="r"><Relationship Id="r1" Target="media/i.png"/><Relationship Id="c1" Target="charts/chart1.xml"/></R>',
        "word/charts/chart1.xml": '<c:x xmlns:c="c" xmlns:a="a"><a:t>Sales</a:t><c:ser><c:tx><c:v>North</c:v></c:tx><c:cat><c:v>Q1</c:v><c:v>Q2</c:v></c:cat><c:val><c:v>1</c:v><c:v>2</c:v></c:val></c:ser></c:x>',
        "word/charts/chart2.xml": '<c:x xmlns:c="c"/>',
    }
    e = read(box(parts), ".docx")
    assert e.parts[0].startswith("Part\n\nHello world\n\n## Embedded chart 1: Sales\nContext: Section: Part, paragraph 3") and "- North; categories: Q1, Q2; values: 1, 2" in e.parts[0]
    assert "Uncertain location" in e.parts[0] and any("1 chart(s)" in w for w in e.warnings)
    assert len(e.images) == 1 and e.images[0].location == "Section: Part, paragraph 2" and e.images[0].context == "Hello world"


def test_rtf():
    raw = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \u8364?uro\par {\b bold}\tab x\~y \{z\} \emdash{\pict\pngblip " + PNG.hex().encode() + rb"}}"
    e = read(raw, ".rtf")
    assert e.parts == ["Café €uro\nbold\tx y {z} —"] and e.images[0].data == PNG


def test_pdf():
    body = zlib.compress(rb"BT /F1 12 Tf (Hello \(world\)) Tj 0 -14 Td [(A) -20 (B)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Length 10 /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream endobj"
    assert read(pdf, ".pdf").parts == ["Hello (world)\nAB"]
    grey = zlib.compress(bytes(range(256)) * 16)
    pdf += b"\n2 0 obj <</Subtype /Image /Width 64 /Height 64 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode>>\nstream\n" + grey + b"\nendstream endobj"
    assert images.dimensions(read(pdf, ".pdf").images[0].data, "image/png") == (64, 64)
    assert formats.extract(b"%PDF-1.4 /Encrypt 5 0 R", ".pdf")[1] == "encrypted" and formats.extract(b"%PDF-1.4", ".pdf")[1] == "empty" and formats.extract(b"x", ".pdf")[1] == "extraction_failed"


def pdf_file(objects, trailer="/Root 1 0 R", packed=()):
    """A file of (number, head, stream or None); numbers in packed stand in an object stream."""
    out = b"%PDF-1.5\n"
    inner = [(n, head.encode()) for n, head, body in objects if n in packed]
    if inner:
        places, data = [], b""
        for n, head in inner:
            places.append(f"{n} {len(data)}")
            data += head + b" "
        first = " ".join(places).encode() + b" "
        objects = [*objects, (90, f"<</Type /ObjStm /N {len(inner)} /First {len(first)} /Filter /FlateDecode>>", first + data)]
    for n, head, body in objects:
        if n not in packed:
            coded = zlib.compress(body) if body is not None and "FlateDecode" in head else body
            out += f"{n} 0 obj {head}".encode() + (b"" if coded is None else b"\nstream\r\n" + coded + b"\nendstream") + b" endobj\n"
    return out + f"trailer <<{trailer}>>".encode()


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00E900660066> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<65E5> <672C>] endbfrange endcmap"


def test_pdf_pages_fonts_and_object_streams():
    objects = [
        (1, "<</Type /Catalog /Pages 2 0 R>>", None), (2, "<</Type /Pages /Kids [4 0 R 3 0 R] /Resources <</Font <</F1 7 0 R>> /XObject <</X 9 0 R /I 10 0 R>>>>>>", None),
        (3, "<</Type /Page /Contents 5 0 R>>", None), (4, "<</Type /Page /Contents [6 0 R 8 0 R] /Resources <</Font <</A 11 0 R>>>>>>", None),
        (5, "<</Filter /FlateDecode>>", b"BT /F1 9 Tf <00010002> Tj 0 -12 Td [<0010> -300 <00110012>] TJ 5 0 Td <00200021> Tj ET /X Do /I Do q BI /W 1 ID \xff(Tj)\x00 EI Q"),
        (6, "<</Length 99 0 R>>", b"BT /A 9 Tf 1 0 0 1 0 700 Tm (first \\(page\\)) Tj 1 0 0 1 50 700 Tm (same) Tj 1 0 0 1 0 680 Tm (line) Tj"), (8, "<<>>", b"(\\051 \\\ntwo) Tj ET"),
        (7, "<</Type /Font /Subtype /Type0 /ToUnicode 12 0 R>>", None), (12, "<</Filter [/ASCIIHexDecode /FlateDecode]>>", None), (9, "<</Subtype /Form /Filter /FlateDecode>>", b"BT /F1 9 Tf <0001> ' ET"),
        (10, "<</Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 1 <000000ff0000>] /Filter /FlateDecode>>", b"\0\1\1\0"), (11, "<</Subtype /Type1>>", None), (99, "31", None),
    ]
    objects = [(n, h, zlib.compress(CMAP).hex().encode() + b">") if n == 12 else (n, h, b) for n, h, b in objects]
    raw = pdf_file([o for o in objects if o[0] != 12], packed=(1, 2, 3, 7))
    raw = raw.replace(b"trailer", b"12 0 obj <</Filter [/ASCIIHexDecode /FlateDecode]>> stream\n" + objects[8][2] + b"\nendstream endobj trailer")
    e = read(raw, ".pdf")
    assert e.parts == ["first (page)same\nline) two\n\nHéff\na bc 日本\nH"] and e.images[0].location == "Page 2" and images.decode_png(e.images[0].data)[0, 1].tolist() == [255, 0, 0, 255]
    assert formats.extract(pdf_file(objects[:1], "/Root 1 0 R /Encrypt 3 0 R"), ".pdf")[1] == "encrypted"


def test_limits_are_parameters():
    page = zlib.compress(b"BT (" + b"x" * 5000 + b") Tj ET")
    raw = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + page + b"\nendstream endobj"
    assert len(read(raw, ".pdf").parts[0]) == 5000
    assert formats.extract(raw, ".pdf", formats.Limits(inflated=100))[1] == "empty"
    rows = "".join(f'<table:table-row><table:table-cell><text:p>{k}</text:p></table:table-cell></table:table-row>' for k in range(5003))
    short, whole = formats.extract(ods(rows), ".ods")[0], formats.extract(ods(rows), ".ods", formats.UNLIMITED)[0]
    assert "truncated to 5000 rows" in short.warnings[0] and whole.warnings == [] and whole.parts[0].endswith("| 5002 |")
    assert formats.extract(b"a,b", ".csv", readers={".csv": lambda data, _: formats.Extracted([data.decode().upper()], "csv")})[0].parts == ["A,B"]


@pytest.mark.parametrize("suffix", sorted(formats.READERS))
def test_broken_documents_are_rows_not_errors(suffix):
    for data in (b"", b"PK\x03\x04broken", b"\xff\xfe\x00", None):
        found, reason, _ = formats.extract(data, suffix)
        assert (found is None) != (reason is None)


def test_unknown_suffix():
    assert formats.extract(b"x", ".xyz")[1] == "extraction_failed"


# Images


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for channels in (1, 3, 4):
        px = rng.integers(0, 256, (9, 7, channels), dtype=np.uint8)
        out = images.decode_png(images.encode_png(7, 9, channels, px.tobytes()))
        assert (out[..., : min(3, channels)] == px[..., :3] if channels > 1 else out[..., :1] == px).all()


def test_verdicts():
    rng = np.random.default_rng(0)
    plain = images.encode_png(64, 64, 1, bytes([200]) * 4096)
    rgb = np.tile(np.array([[255, 0, 0]], np.uint8), (64 * 86, 1)).ravel()[: 64 * 64 * 4]
    packed = images.encode_png(64, 64, 4, rgb.tobytes())
    striped = np.repeat(rng.integers(0, 2, (64, 1), dtype=np.uint8) * 200, 64, axis=1)
    assert images.inspect(PNG, "image/png")[2] == "content"
    assert "uniform" in images.inspect(plain, "image/png")[3]
    assert images.inspect(packed, "image/png")[2] == "broken"
    assert "striping" in images.inspect(images.encode_png(64, 64, 1, striped.tobytes()), "image/png")[3]
    assert images.inspect(images.encode_png(10, 10, 1, bytes(100)), "image/png")[2] == "tiny"
    assert images.inspect(images.encode_png(200, 4, 1, bytes(800)), "image/png")[2] == "tiny"
    assert images.inspect(images.encode_png(500, 10, 1, bytes(5000)), "image/png")[3].startswith("extreme aspect ratio 50:1")
    assert images.inspect(b"\x89PNG\r\n\x1a\n" + bytes(8) + b"\0\0\0\x40\0\0\0\x40", "image/png")[2] == "broken" and images.inspect(b"x", "image/png")[2] == "broken"
    assert images.inspect(b"x" * 600, "image/tiff")[2] == "content" and images.inspect(b"x", "image/tiff")[3] == "only 1 bytes"


def test_neighbours_of_a_narrow_picture():
    """Of a row of six, the pairs (0, 1), (1, 2), (2, 3) are compared at one step as those with (0, 3), (1, 4), (2, 5) at three."""
    px = np.zeros((2, 6, 4), np.uint8)
    px[:, 0] = 100
    found = images.measure(px)
    assert abs(found["h1"] - 400 / 3) < 1e-9 and abs(found["h3"] - 400 / 3) < 1e-9
    px[:, :] = 0
    px[:, 5] = 100
    assert images.measure(px)["h1"] == 0 and images.measure(px)["h3"] > 0


@pytest.mark.parametrize(
    ("data", "media", "size"),
    [
        (b"GIF89a\x10\x00\x20\x00", "image/gif", (16, 32)), (b"BM" + bytes(16) + (100).to_bytes(4, "little") + (-50).to_bytes(4, "little", signed=True), "image/bmp", (100, 50)),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x30\x00\x40\x03", "image/jpeg", (64, 48)), (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\x3f\0\0\x1f\0\0", "image/webp", (64, 32)),
    ],
)
def test_dimensions(data, media, size):
    assert images.dimensions(data, media) == size


def test_inspected_frame(spark):
    rows = spark.createDataFrame([(1, bytearray(PNG), "image/png"), (2, None, "image/png"), (3, bytearray(b"x"), None)], "id int, data binary, media string")
    assert {r.id: r.verdict for r in images.inspected(rows, "id", "data", "media").collect()} == {1: "content", 2: "broken", 3: "tiny"}


# Files


def test_files(spark, tmp_path):
    for name in ("a.txt", "d/b.md", "d/._x", ".hidden", "d/e/Thumbs.db", "_low.txt"):
        files.write_text(str(tmp_path / name), name)
    assert files.walk(str(tmp_path)) == [".hidden", "_low.txt", "a.txt", "d/._x", "d/b.md", "d/e/Thumbs.db"]
    assert files.walk(str(tmp_path / "none")) == []
    read_back = files.read_texts(files.list_files(spark, str(tmp_path), lambda p, is_dir: p == "d")).collect()
    assert {r.relative_path: r.content for r in read_back} == {n: n for n in (".hidden", "_low.txt", "a.txt")}
    assert files.remove_junk(str(tmp_path)) == ["d/._x", "d/e/Thumbs.db"] and files.remove_empty_dirs(str(tmp_path)) == ["d/e"]


def test_extraction_frame(spark):
    rows = [(1, "a/x.html", bytearray(b"<p>hi</p>")), (2, "b.pdf", bytearray(b"%PDF /Encrypt 1 0 R")), (3, ".pdf", bytearray(b"")), (4, None, None)]
    found = {r.id: r for r in files.extract_documents(spark.createDataFrame(rows, "id int, path string, data binary"), "id", "path", "data").collect()}
    assert found[1].parts == ["hi"] and [found[k].reason for k in (2, 3, 4)] == ["encrypted", "extraction_failed", "io_failed"]
