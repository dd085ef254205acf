"""Text and embedded images of documents in many formats, from their bytes, with the standard library only.

Each reader takes the bytes and returns an ``Extracted``; it raises ``Failed`` with one of the reasons
``encrypted``, ``empty`` and ``extraction_failed``. Readers never raise anything else (see ``extract``).

Fixed values, as they are output that others read: the headings of records, sheets, slides and charts, the wording of locations,
and that of warnings.
"""

from __future__ import annotations

import base64
import binascii
import html
import io
import json
import math
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from grainfold.sources import pdf
from grainfold.sources.images import encode_png

@dataclass(frozen=True)
class Limits:
    """What of a document is read at most; what is left out is told by a warning. ``UNLIMITED`` leaves out nothing."""

    images: float = 200
    image_bytes: float = 8 * 1024 * 1024
    all_image_bytes: float = 96 * 1024 * 1024
    rows: float = 5000
    repeats: float = 256
    charts: float = 24
    chart_bytes: float = 2 * 1024 * 1024
    context: float = 1000
    cell_context: float = 500
    pdf_pixels: float = 16_000_000
    inflated: float = 256 * 1024 * 1024


UNLIMITED = Limits(*[math.inf] * 11)

# Records of one part and named lines, and the media types of embedded images by suffix.
RECORDS_A_PART, NAMED_LINES = 1000, 10
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
ONLY_IMAGES = "No extractable text; inspect the embedded images."


class Failed(Exception):
    def __init__(self, reason: str, detail: str) -> None:
        super().__init__(detail)
        self.reason = reason


@dataclass
class Image:
    name: str
    media: str
    data: bytes
    location: str | None = None
    context: str | None = None


@dataclass
class Extracted:
    parts: list[str]
    format: str
    warnings: list[str] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)


def bounded(images: list[Image], kind: str, warnings: list[str], limits: Limits) -> list[Image]:
    """Images within the limits; a single fault loses that image only."""
    out, total = [], 0
    for k, i in enumerate(images):
        if len(out) >= limits.images:
            warnings.append(f"{kind}: skipped {len(images) - k} embedded image(s) after the {limits.images}-image limit.")
            break
        if not i.media:
            warnings.append(f"{kind}: skipped embedded image {i.name} of an unsupported type.")
        elif not i.data:
            warnings.append(f"{kind}: embedded image {i.name} could not be read.")
        elif len(i.data) > limits.image_bytes:
            warnings.append(f"{kind}: skipped oversized embedded image {i.name}.")
        elif total + len(i.data) > limits.all_image_bytes:
            warnings.append(f"{kind}: skipped further embedded images after the {limits.all_image_bytes}-byte limit.")
            break
        else:
            total += len(i.data)
            out.append(i)
    return out


def finished(text: str, kind: str, warnings: list[str], images: list[Image], limits: Limits) -> Extracted:
    images = bounded(images, kind, warnings, limits)
    if not text.strip() and not images:
        raise Failed("empty", f"{kind} yielded no text or images.")
    return Extracted([text.strip() or ONLY_IMAGES], kind, warnings, images)


def cut_off(items: str | list, most: float) -> str | list:
    return items if len(items) <= most else items[: int(most)]


def decoded(encoded: str) -> bytes:
    try:
        return base64.b64decode(re.sub(r"\s+", "", encoded) + "===")
    except (binascii.Error, ValueError):
        return b""


# HTML


class Text(HTMLParser):
    """Block-aware text: headings in capitals, list items starred, link targets in parentheses, tables as rows."""

    BLOCKS = set("p div section article header footer main aside nav ul ol table tr figure figcaption blockquote pre form h1 h2 h3 h4 h5 h6 dl dt dd address fieldset hr".split())
    SILENT = {"script", "style", "head", "template", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = self.shout = self.pre = 0
        self.lists: list[int | None] = []
        self.hrefs: list[tuple[str, int]] = []
        self.images: list[Image] = []
        self.headings: list[tuple[int, str]] = []
        self.section = ""
        self.holder: list[list] = []  # open figures, paragraphs and sections: tag, text, images

    def newline(self, n: int) -> None:
        if self.out:
            self.out.append("\n" * n)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS:
            self.newline(1 if tag in ("tr", "dt", "dd") else 2)
        if re.fullmatch("h[1-6]", tag):
            self.shout += 1
            self.section = ""
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.newline(1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f" {self.lists[-1]}. ")
            else:
                self.out.append(" * ")
        elif tag == "br":
            self.newline(1)
        elif tag in ("td", "th"):
            self.out.append("   ")
        elif tag == "pre":
            self.pre += 1
        elif tag == "a":
            self.hrefs.append((given.get("href") or "", len(self.out)))
        elif tag == "img":
            self.image(given)
        if tag in ("figure", "p", "section"):
            self.holder.append([tag, [], []])

    def image(self, given: dict) -> None:
        m = re.match(r"data:(image/[a-z0-9.+-]+);base64,(.*)", given.get("src") or "", re.I | re.S)
        if not m:
            return
        media = m.group(1).lower()
        where = f"Section: {self.section}" if self.section else f"{self.holder[-1][0]} near image; section uncertain" if self.holder else None
        alt = (given.get("alt") or "").strip()
        image = Image(f"image.{media.split('/')[1]}", media if media in MEDIA.values() else "", decoded(m.group(2)), where, f"Image alt text: {alt}" if alt else None)
        self.images.append(image)
        if self.holder:
            self.holder[-1][2].append(image)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        if re.fullmatch("h[1-6]", tag):
            self.shout = max(0, self.shout - 1)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag == "a" and self.hrefs:
            href, at = self.hrefs.pop()
            label = "".join(self.out[at:]).strip()
            if href and not href.startswith("#") and href != label:
                self.out.append(f" ({href})" if label else f"({href})")
        if tag in ("figure", "p", "section") and self.holder and self.holder[-1][0] == tag:
            _, texts, images = self.holder.pop()
            around = re.sub(r"\s+", " ", "".join(texts)).strip()
            for i in images:
                i.context = " — ".join(x for x in (around, i.context) if x) or None
        if tag in self.BLOCKS:
            self.newline(1 if tag in ("tr", "dt", "dd") else 2)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
        for h in self.holder:
            h[1].append(data)
        if self.shout:
            self.section = (self.section + data).strip()
            data = data.upper()
        if data.strip() or (data and self.out and not self.out[-1].endswith(("\n", " "))):
            self.out.append(data)

    def text(self) -> str:
        joined = re.sub(r"[ \t]+\n", "\n", "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?! ?[*\d])", "\n", joined)).strip()


def read_html(data: bytes, limits: Limits) -> Extracted:
    parser = Text()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    return finished(parser.text(), "html", [], parser.images, limits)


# Line records and notebooks


def strict(text: str) -> object:
    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def read_jsonl(data: bytes, limits: Limits) -> Extracted:
    """Numbered records, a part for each thousand; the first bad lines are named."""
    records, bad = [], []
    for n, line in enumerate(re.split(r"\r?\n", data.decode("utf-8", "replace")), 1):
        if line.strip():
            try:
                records.append(f"## Record {len(records) + 1}\n\n{json.dumps(strict(line.strip()), indent=2, ensure_ascii=False)}")
            except (ValueError, RecursionError):
                bad.append(n)
    if not records:
        raise Failed("empty", "jsonl holds no valid record.")
    warnings = [f"jsonl: skipped {len(bad)} invalid line(s): {', '.join(map(str, bad[:NAMED_LINES]))}{', …' if len(bad) > NAMED_LINES else ''}"] if bad else []
    return Extracted(["\n\n".join(records[k : k + RECORDS_A_PART]) for k in range(0, len(records), RECORDS_A_PART)], "jsonl", warnings)


def joined(source: object) -> str:
    return source if isinstance(source, str) else "".join(x for x in source if isinstance(x, str)) if isinstance(source, list) else ""


def read_notebook(data: bytes, limits: Limits) -> Extracted:
    book = strict(data.decode("utf-8", "replace"))
    if not isinstance(book, dict):
        raise Failed("extraction_failed", "the root of the notebook is no object")
    meta = book.get("metadata") or {}
    language = (meta.get("language_info") or {}).get("name") or (meta.get("kernelspec") or {}).get("language") or ""
    chunks, images = [], []
    for n, cell in enumerate(book.get("cells") or [], 1):
        source = joined(cell.get("source")).strip()
        if source and cell.get("cell_type") == "code":
            mark = "`" * max(3, 1 + max(map(len, re.findall("`+", source)), default=0))
            source_shown = f"{mark}{language}\n{source}\n{mark}"
        else:
            source_shown = source
        if source_shown:
            chunks.append(source_shown)
        for output in cell.get("outputs") or []:
            for media, value in (output.get("data") or {}).items():
                if media.startswith("image/"):
                    images.append(Image(f"notebook-cell-{n}.{media.split('/')[1]}", media if media in MEDIA.values() else "", decoded(joined(value)), f"Cell {n}", cut_off(source, limits.cell_context) or None))
    return finished("\n\n".join(chunks), "ipynb", [], images, limits)


# Zip containers


def opened(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Failed("encrypted", "the container is encrypted")
    return z


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def element_text(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", " ".join(e.itertext())).strip()


def tagless(xml: str) -> str:
    """Text of markup that may not be well-formed."""
    xml = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", xml)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", xml))).strip()


def table_text(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships, as package paths."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in z.namelist():
        return {}
    found = {}
    for r in ET.fromstring(z.read(name)):
        target = r.get("Target") or ""
        if r.get("TargetMode") != "External":
            found[r.get("Id") or ""] = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
    return found


def container_images(z: zipfile.ZipFile, where: dict[str, tuple[str | None, str | None]], limits: Limits) -> list[Image]:
    """Every picture in the container, with location and context where known."""
    out = []
    for name in z.namelist():
        suffix = name.rpartition(".")[2].lower()
        if suffix in MEDIA:
            location, context = where.get(name, (None, None))
            try:
                data = z.read(name) if z.getinfo(name).file_size <= limits.image_bytes else b"\0" * (int(limits.image_bytes) + 1)
            except (zipfile.BadZipFile, zlib.error, RuntimeError):
                data = b""
            out.append(Image(posixpath.basename(name), MEDIA[suffix], data, location, context))
    return out


def numbered(z: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(pattern, n)))


def read_pptx(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    slides, where = [], {}
    for n, name in numbered(z, r"ppt/slides/slide(\d+)\.xml"):
        root = ET.fromstring(z.read(name))
        text = " ".join(e.text or "" for e in root.iter() if local(e.tag) == "t").strip()
        if text:
            slides.append(f"## Slide {n}\n\n{text}")
        targets = relationships(z, name)
        for e in root.iter():
            if local(e.tag) == "blip" and attribute(e, "embed") in targets:
                where[targets[attribute(e, "embed")]] = (f"Slide {n}", None)
    return finished("\n\n".join(slides), "pptx", [], container_images(z, where, limits), limits)


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_xlsx(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    names = z.namelist()
    shared = [element_join(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = relationships(z, "xl/workbook.xml")
    sheets, warnings, where = [], [], {}
    for sheet in (e for e in book.iter() if local(e.tag) == "sheet"):
        title, part = sheet.get("name") or "Sheet", targets.get(attribute(sheet, "id") or "", "")
        if part not in names:
            continue
        rows: list[list[str]] = []
        total = 0
        for row in (e for e in ET.fromstring(z.read(part)).iter() if local(e.tag) == "row"):
            number = int(row.get("r") or total + 1)
            total = max(total, number)
            if number > limits.rows:
                continue
            rows += [[] for _ in range(number - len(rows))]
            cells: list[str] = []
            for c in row:
                at = column_number(c.get("r") or "") or len(cells) + 1
                cells += [""] * (at - len(cells))
                cells[at - 1] = cell_text(c, shared)
            rows[number - 1] = cells
        if total > limits.rows:
            warnings.append(f'Sheet "{title}": truncated to {limits.rows} of {total} rows.')
        if text := table_text(rows):
            sheets.append(f"## Sheet: {title}\n\n{text}")
        for drawing in (t for t in relationships(z, part).values() if "/drawings/" in t and t in names):
            pictures = relationships(z, drawing)
            for anchor in ET.fromstring(z.read(drawing)):
                start = next((e for e in anchor if local(e.tag) == "from"), None)
                place = {local(e.tag): int(e.text or 0) for e in start} if start is not None else {}
                for e in anchor.iter():
                    if local(e.tag) == "blip" and attribute(e, "embed") in pictures:
                        where[pictures[attribute(e, "embed")]] = (f"Sheet {title}, near {column_name(place.get('col', 0) + 1)}{place.get('row', 0) + 1}", f"Worksheet: {title}")
    return finished("\n\n".join(sheets), "xlsx", warnings, container_images(z, where, limits), limits)


def element_join(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")


def cell_text(c: ET.Element, shared: list[str]) -> str:
    value = next((e.text or "" for e in c if local(e.tag) == "v"), "")
    kind = c.get("t")
    text = shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else element_join(c) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
    return text.replace("|", "\\|").replace("\n", " ").strip()


def office_content(z: zipfile.ZipFile) -> ET.Element | None:
    return ET.fromstring(z.read("content.xml")) if "content.xml" in z.namelist() else None


def picture_links(e: ET.Element) -> list[str]:
    return [posixpath.normpath(h) for x in e.iter() if (h := attribute(x, "href")) and h.rpartition(".")[2].lower() in MEDIA]


def read_odt(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    root = office_content(z)
    where: dict[str, tuple[str | None, str | None]] = {}
    heading, paragraph = "", 0
    for e in root.iter() if root is not None else []:
        if local(e.tag) == "h":
            heading = element_text(e) or heading
        elif local(e.tag) == "p":
            paragraph += 1
        if local(e.tag) in ("h", "p"):
            for link in picture_links(e):
                where[link] = (f"Section: {heading}" if heading else f"Paragraph {paragraph}; section uncertain", " — ".join(x for x in (heading, element_text(e)) if x) or None)
    return finished(element_text(root) if root is not None else "", "odt", [], container_images(z, where, limits), limits)


def repeats(e: ET.Element, name: str, limits: Limits) -> int:
    try:
        return min(limits.repeats, max(1, int(attribute(e, name) or 1)))
    except ValueError:
        return 1


def read_ods(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    root = office_content(z)
    sheets, warnings = [], []
    for n, t in enumerate((e for e in root.iter() if local(e.tag) == "table") if root is not None else [], 1):
        title = attribute(t, "name") or f"Sheet {n}"
        rows: list[list[str]] = []
        over = False
        for row in (e for e in t.iter() if local(e.tag) == "table-row"):
            cells: list[str] = []
            for c in row:
                if local(c.tag) in ("table-cell", "covered-table-cell"):
                    cells += [element_text(c).replace("|", "\\|")] * repeats(c, "number-columns-repeated", limits)
            while cells and not cells[-1]:
                cells.pop()
            copies = repeats(row, "number-rows-repeated", limits)
            over |= len(rows) + copies > limits.rows
            rows += [cells] * min(copies, limits.rows - len(rows))
        if over:
            warnings.append(f'Sheet "{title}": truncated to {limits.rows} rows.')
        while rows and not rows[-1]:
            rows.pop()
        if text := table_text(rows):
            sheets.append(f"## Sheet: {title}\n\n{text}")
    return finished("\n\n".join(sheets), "ods", warnings, container_images(z, {}, limits), limits)


def read_odp(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    root = office_content(z)
    slides, where = [], {}
    for n, page in enumerate((e for e in root.iter() if local(e.tag) == "page") if root is not None else [], 1):
        if text := element_text(page):
            slides.append(f"## Slide {n}\n\n{text}")
        where |= {link: (f"Slide {n}", None) for link in picture_links(page)}
    return finished("\n\n".join(slides), "odp", [], container_images(z, where, limits), limits)


def read_epub(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    pages = [n for n in z.namelist() if re.search(r"\.(x?html?|htm)$", n, re.I)]
    warnings: list[str] = []
    order: list[str] = []
    try:
        package = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if local(e.tag) == "rootfile")
        root = ET.fromstring(z.read(package))
        hrefs = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href") or ""))) for e in root.iter() if local(e.tag) == "item"}
        order = [hrefs[e.get("idref")] for e in root.iter() if local(e.tag) == "itemref" and hrefs.get(e.get("idref")) in pages]
    except (KeyError, StopIteration, ET.ParseError):
        pass
    if pages and not order:
        warnings.append("EPUB spine unreadable; used filename order for parts.")
        order = sorted(pages)
    where = {}
    for n in pages:
        chapter = posixpath.splitext(posixpath.basename(n))[0]
        for link in re.findall(r"(?:src|href)=[\"']([^\"'#]+)[\"']", z.read(n).decode("utf-8", "replace")):
            where[posixpath.normpath(posixpath.join(posixpath.dirname(n), link))] = (f"EPUB section {chapter}", None)
    return finished("\n\n".join(t for n in order if (t := tagless(z.read(n).decode("utf-8", "replace")))), "epub", warnings, container_images(z, where, limits), limits)


# Word documents


def word_text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        name = local(x.tag)
        out.append(x.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out)


def live(e: ET.Element):
    """The element and all below it; of alternatives only the first choice."""
    yield e
    chosen = local(e.tag) == "AlternateContent" and any(local(c.tag) == "Choice" for c in e)
    for c in e:
        if not (chosen and local(c.tag) == "Fallback"):
            yield from live(c)


def is_label(text: str) -> bool:
    """A short line that reads like the name of a section."""
    return len(text) <= 100 and not re.search(r"[.!?;:]$", text) and bool(re.search(r"\([^()]*\)$", text)) and 3 <= len(text.split()) <= 14


def read_docx(data: bytes, limits: Limits) -> Extracted:
    z = opened(data)
    names, warnings = z.namelist(), []
    styles = {}
    if "word/styles.xml" in names:
        for s in ET.fromstring(z.read("word/styles.xml")):
            if local(s.tag) == "style":
                styles[attribute(s, "styleId")] = next((attribute(n, "val") or "" for n in s if local(n.tag) == "name"), "")
    where: dict[str, tuple[str | None, str | None]] = {}
    charts: dict[str, tuple[str, str | None]] = {}
    texts: list[str] = []
    main = ["word/document.xml"] if "word/document.xml" in names else []
    for part in main + sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
        targets = relationships(z, part)
        heading, before, number = "", "", 0
        root = ET.fromstring(z.read(part))
        nested = {id(x) for p in root.iter() if local(p.tag) == "p" for x in p.iter() if x is not p and local(x.tag) == "p"}
        for p in (e for e in live(root) if local(e.tag) == "p" and id(e) not in nested):
            number += 1
            text = "".join(word_text(r) for r in [p]).strip()
            style = next((styles.get(attribute(s, "val"), attribute(s, "val") or "") for s in p.iter() if local(s.tag) == "pStyle"), "")
            if part in main:
                texts.append(text)
            if text and (re.match(r"(heading|title|überschrift)", style, re.I) or is_label(text)):
                heading = text
            place = "header or footer" if part not in main else f"Section: {heading}, paragraph {number}" if heading else f"Paragraph {number}; section uncertain"
            around = cut_off(re.sub(r"\s+", " ", text or before).strip(), limits.context) or None
            for e in live(p):
                key = attribute(e, "embed") if local(e.tag) == "blip" else attribute(e, "id") if local(e.tag) in ("imagedata", "chart") else None
                if key is None:
                    continue
                if local(e.tag) == "chart":
                    charts[targets.get(key, "")] = (place, around)
                elif key in targets and targets[key] in names:
                    where.setdefault(targets[key], (place, around))
                else:
                    warnings.append(f"DOCX: an image at {place} has no picture in the package.")
            before = text or before
    blocks = []
    found = numbered(z, r"word/charts/chart(\d+)\.xml")
    if len(found) > limits.charts:
        warnings.append(f"DOCX: chart workload has {len(found)} charts; only the first {limits.charts} will be inspected.")
    placed = [c for c in charts if c in names]
    lost = 0
    for n, name in sorted(cut_off(found, limits.charts), key=lambda x: (placed.index(x[1]) if x[1] in placed else len(placed), x[0])):
        if z.getinfo(name).file_size > limits.chart_bytes:
            warnings.append(f"DOCX: skipped oversized chart data in {name}.")
            continue
        lost += name not in charts
        blocks.append(chart_text(z.read(name), n, *charts.get(name, ("Uncertain location in document", None))))
    if lost:
        warnings.append(f"DOCX: {lost} chart(s) could not be associated with a surrounding document section; context is marked uncertain.")
    text = "\n\n".join(x for x in ("\n\n".join(t for t in texts if t), *blocks) if x)
    return finished(text, "docx", warnings, container_images(z, where, limits), limits)


def chart_text(xml: bytes, n: int, place: str, around: str | None) -> str:
    root = ET.fromstring(xml)
    title = " ".join(e.text or "" for e in root.iter() if local(e.tag) == "t").strip() or f"Chart {n}"
    values = lambda s, name: [v.text.strip() for e in s if local(e.tag) == name for v in e.iter() if local(v.tag) == "v" and (v.text or "").strip()]
    lines = [f"## Embedded chart {n}: {title}", f"Context: {place}"] + ([f"Surrounding text: {around}"] if around else [])
    series = [e for e in root.iter() if local(e.tag) == "ser"]
    for k, s in enumerate(series, 1):
        label, cats, vals = " ".join(values(s, "tx")) or f"Series {k}", values(s, "cat"), values(s, "val")
        lines.append(f"- {label}" + (f"; categories: {', '.join(cats)}" if cats else "") + (f"; values: {', '.join(vals)}" if vals else "; cached values unavailable (visual values uncertain)"))
    return "\n".join(lines if series else [*lines, "- Chart series or values are unreadable from the document data; do not infer them."])


# RTF

# Groups without text, and control words that stand for characters.
RTF_SILENT = set("fonttbl colortbl stylesheet info header footer footnote comment object fldinst filetbl listtable listoverridetable rsidtbl generator operator category title subject author manager company keywords annotation nonshppict themedata datastore listpicture userprops latentstyles".split())
RTF_SIGNS = {"par": "\n", "line": "\n", "page": "\n", "sect": "\n", "row": "\n", "nestrow": "\n", "cell": "\t", "nestcell": "\t", "tab": "\t", "emdash": "—", "endash": "—", "ldblquote": "“", "rdblquote": "”", "lquote": "‘", "rquote": "’", "bullet": "•"}
RTF_TOKEN = re.compile(r"\\([A-Za-z]+)(-?\d+)? ?|\\'([0-9A-Fa-f]{2})|\\([^A-Za-z'])|([{}])|([^\\{}]+)", re.S)


def read_rtf(data: bytes, limits: Limits) -> Extracted:
    out: list[str] = []
    stack: list[dict] = [{"silent": False, "pict": None, "fresh": False}]
    images: list[Image] = []
    eat = 0
    for m in RTF_TOKEN.finditer(data.decode("latin-1")):
        word, number, code, sign, brace, text = m.groups()
        top = stack[-1]
        if brace == "{":
            stack.append({"silent": top["silent"], "pict": None, "fresh": True})
            continue
        if brace == "}":
            if len(stack) > 1:
                closed = stack.pop()
                if closed["pict"] is not None:
                    digits = re.sub(r"[^0-9A-Fa-f]", "", "".join(closed["pict"]["hex"]))
                    if len(digits) >= 8 and len(digits) % 2 == 0:
                        media = closed["pict"]["media"]
                        images.append(Image(f"rtf-{len(images) + 1}", media, bytes.fromhex(digits)))
            continue
        if word:
            if top["fresh"] and word in RTF_SILENT:
                top["silent"] = True
            elif word == "pict":
                top["pict"], top["silent"] = {"hex": [], "media": ""}, True
            elif top["pict"] is not None and word in ("pngblip", "jpegblip"):
                top["pict"]["media"] = "image/" + word[:-4]
            elif not top["silent"] and word == "u" and number:
                out.append(chr(int(number) & 0xFFFF))
                eat = 1
            elif not top["silent"] and word in RTF_SIGNS:
                out.append(RTF_SIGNS[word])
        elif code and not top["silent"]:
            if eat:
                eat = 0
            else:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign:
            if sign == "*" and top["fresh"]:
                top["silent"] = True
                continue  # the group's word comes next
            if not top["silent"]:
                out.append({"~": "\u00a0"}.get(sign, sign if sign in "\\{}" else ""))
        elif text:
            if top["pict"] is not None:
                top["pict"]["hex"].append(text)
            elif not top["silent"]:
                text = text.replace("\r", "").replace("\n", "")
                out.append(text[eat:])
                eat = 0 if text else eat
        if not (text and not text.strip()):
            top["fresh"] = False
    joined_text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return finished(re.sub(r"\n{3,}", "\n\n", joined_text), "rtf", [], images, limits)


# PDF


def pdf_picture(doc: pdf.Document, s: pdf.Stream, name: str, place: str | None, context: str | None, limits: Limits) -> Image | None:
    """A picture of a page, with the text of the page as its context; None, with a warning, where its coding or layout isn't read."""
    coded = [doc.get(f) for f in doc.list_of(s.head.get("Filter"))]
    try:
        if coded and coded[-1] == "DCTDecode":
            return Image(f"{name}.jpg", "image/jpeg", doc.body(s, ("DCTDecode",)), place, context)
        w, h, bits = (doc.get(s.head.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
        if not isinstance(w, int) or not isinstance(h, int) or w * h > limits.pdf_pixels:
            doc.warnings.append("PDF: skipped an image with too many pixels.")
            return None
        body, space = doc.body(s), doc.get(s.head.get("ColorSpace"))
        kind = doc.get(space[0]) if isinstance(space, list) and space else space
        if kind == "ICCBased":
            kind = {1: "DeviceGray", 3: "DeviceRGB"}.get(doc.get(doc.dict_of(space[1]).get("N")))
        if kind == "Indexed" and bits == 8 and len(body) >= w * h:
            palette = doc.get(space[3])
            palette = doc.body(palette) if isinstance(palette, pdf.Stream) else palette
            width = 3 if doc.get(space[1]) == "DeviceRGB" else 1
            body, kind = b"".join(palette[width * c : width * (c + 1)] for c in body[: w * h]), "DeviceRGB" if width == 3 else "DeviceGray"
        channels = {"DeviceRGB": 3, "CalRGB": 3, "DeviceGray": 1, "CalGray": 1}.get(kind, 0)
        if channels and bits in (None, 8) and len(body) == w * h * channels and w * h:
            return Image(f"{name}.png", "image/png", encode_png(w, h, channels, body), place, context)
        doc.warnings.append("PDF: skipped an image whose pixels don't fit its layout.")
    except (pdf.Broken, zlib.error, ValueError, TypeError, IndexError) as e:
        doc.warnings.append(f"PDF: skipped an image that could not be read ({e}).")
    return None


def read_pdf(data: bytes, limits: Limits) -> Extracted:
    """Text of the pages in order, with the fonts' maps to Unicode, and their pictures."""
    if not data.startswith(b"%PDF"):
        raise Failed("extraction_failed", "no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
        raise Failed("encrypted", "the PDF is encrypted")
    doc, pages = pdf.shown(data, limits.inflated)
    if "Encrypt" in doc.trailer:
        raise Failed("encrypted", "the PDF is encrypted")
    images: list[Image] = []
    seen: set[int] = set()
    for n, page in enumerate(pages, 1):
        for s in page.pictures:
            if id(s) not in seen:
                seen.add(id(s))
                found = pdf_picture(doc, s, f"pdf-{len(seen)}", f"Page {n}", cut_off(page.text(), limits.context) or None, limits)
                images += [found] if found else []
    return finished("\n\n".join(t for p in pages if (t := p.text())), "pdf", doc.warnings, images, limits)


READERS = {
    ".pdf": read_pdf, ".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx, ".odt": read_odt, ".ods": read_ods, ".odp": read_odp, ".epub": read_epub,
    ".html": read_html, ".htm": read_html, ".rtf": read_rtf, ".jsonl": read_jsonl, ".ndjson": read_jsonl, ".ipynb": read_notebook,
}


#: From the bytes of a document and the limits to what is in it.
Read = Callable[[bytes, Limits], Extracted]


def extract(data: bytes | None, suffix: str, limits: Limits = Limits(), readers: dict[str, Read] | None = None) -> tuple[Extracted | None, str | None, str | None]:
    """(result, reason, detail): exactly one of result and reason is given. Further ``readers`` by suffix go before those here."""
    reader = ((readers or {}) | {k: v for k, v in READERS.items() if k not in (readers or {})}).get(suffix.lower())
    if reader is None or data is None:
        return None, "extraction_failed" if data is not None else "io_failed", f"no extractor for {suffix}" if data is not None else "no data"
    try:
        return reader(data, limits), None, None
    except Failed as e:
        return None, e.reason, str(e)
    except Exception as e:  # a broken file must never end a task
        return None, "extraction_failed", f"{type(e).__name__}: {e}"


__all__ = ["READERS", "Extracted", "Failed", "Image", "extract"]
