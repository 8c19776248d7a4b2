"""Office files to markdown, from their bytes, with the standard library's zip and XML readers."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(archive.read(name))
    except KeyError:
        return None


def _table(rows: list[list[str]]) -> str:
    """A markdown table; the first row is its head, short rows are filled up."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n" if width else ""


def _on(properties: ElementTree.Element | None, name: str) -> bool:
    found = properties.find(_W + name) if properties is not None else None
    return found is not None and found.get(_W + "val") not in ("0", "false")


def _runs(paragraph: ElementTree.Element) -> str:
    out = []
    for run in paragraph.iter(_W + "r"):
        text = "".join(t.text or "" for t in run.findall(_W + "t"))
        if text:
            p = run.find(_W + "rPr")
            mark = "**" * _on(p, "b") + "*" * _on(p, "i")
            out.append(f"{mark}{text}{mark}")
    return "".join(out).strip()


def docx(archive: zipfile.ZipFile) -> str:
    """Headings, list items, bold and italic runs, and tables."""
    root = _part(archive, "word/document.xml")
    if root is None:
        raise ValueError("No document.xml found")
    out = []
    for item in root.iter(_W + "body").__next__():
        if item.tag == _W + "tbl":
            rows = [[" ".join(filter(None, map(_runs, cell.iter(_W + "p")))).replace("|", "\\|") for cell in row.findall(_W + "tc")] for row in item.iter(_W + "tr")]
            out.append(_table([r for r in rows if r]) + "\n")
        elif item.tag == _W + "p" and (text := _runs(item)):
            style = item.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(_W + "val", "") if style is not None else ""
            if "heading" in name.lower():
                level = re.search(r"\d", name)
                out.append(f"{'#' * int(level[0] if level else 1)} {text}\n\n")
            else:
                out.append(f"- {text}\n" if "listparagraph" in name.lower() else f"{text}\n\n")
    return "".join(out) if "".join(out).strip() else "[Could not extract structured text from DOCX]"


def pptx(archive: zipfile.ZipFile) -> str:
    """Slides by number; of each the first paragraph is bold, the others are items."""
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    out = []
    for k, name in enumerate(names, 1):
        root = _part(archive, name)
        texts = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in root.iter(_A + "p")]
        texts = [t for t in texts if t]
        out.append(f"## Slide {k}\n\n" + (f"**{texts[0]}**\n\n" if texts else "") + "".join(f"- {t}\n" for t in texts[1:]) + "\n")
    return "".join(out) if out else "[Could not extract text from PPTX]"


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.findtext(_S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_S + "t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in ("str", "e"):
        return value if kind == "str" else f"ERR:{value}"
    number = float(value)
    return str(int(number)) if number == int(number) else f"{number:.2f}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(archive: zipfile.ZipFile) -> str:
    """A table for each sheet, with a heading if there are several; whole numbers without decimals, others with two."""
    strings = _part(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in strings.findall(_S + "si")] if strings is not None else []
    book, links = _part(archive, "xl/workbook.xml"), _part(archive, "xl/_rels/workbook.xml.rels")
    targets = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}
    sheets = [(s.get("name"), targets.get(s.get(_R + "id"), f"worksheets/sheet{k}.xml")) for k, s in enumerate(book.iter(_S + "sheet"), 1)]
    out = []
    for name, target in sheets:
        root = _part(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows = []
        for row in root.iter(_S + "row") if root is not None else ():
            cells: list[str] = []
            for k, c in enumerate(row.findall(_S + "c")):
                at = _column(c.get("r", "")) if c.get("r") else k
                cells += [""] * (at - len(cells)) + [_cell(c, shared).replace("|", "\\|")]
            rows.append(cells)
        if any(rows):
            out.append((f"## {name}\n\n" if len(sheets) > 1 else "") + _table(rows) + "\n")
    return "".join(out) if out else "[Could not extract data from spreadsheet]"


def odf(archive: zipfile.ZipFile) -> str:
    """The text of an OpenDocument file, its parts apart by blank lines."""
    try:
        xml = archive.read("content.xml").decode("utf-8", "replace")
    except KeyError:
        raise ValueError("No content.xml found") from None
    text = re.sub(r"<[^>]*>", " ", xml)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#13;", "\r"), ("&amp;", "&")):
        text = text.replace(name, sign)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return "\n\n".join(lines) if lines else "[Could not extract text from this file]"


READERS: dict[str, Callable[[zipfile.ZipFile], str]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odf, "odp": odf, "ods": odf}


def markdown(content: bytes, ext: str) -> tuple[str | None, str | None]:
    """(text, error) of a file's bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return READERS[ext](archive), None
    except Exception as e:  # a broken file is a row with an error, not a failed task
        return None, f"{type(e).__name__}: {e}"


# Images smaller than this, or beyond so many of a file, are left out.
LEAST_PIXELS, MOST_IMAGES = 100, 500


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(mime type, width, height) of PNG, GIF, BMP and JPEG data."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "image/gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return "image/bmp", w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "image/jpeg", w, h
            at += 2 + size
    return None


def images(content: bytes) -> list[dict]:
    """Embedded images: index from 1, mime, width, height, sha256 and the slide that shows each, if any."""
    found: list[dict] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            slides: dict[str, int] = {}
            for n in sorted(archive.namelist()):
                if m := re.fullmatch(r"ppt/slides/_rels/slide(\d+)\.xml\.rels", n):
                    for t in re.findall(rb'Target="\.\./media/([^"]+)"', archive.read(n)):
                        slides[t.decode()] = min(int(m[1]), slides.get(t.decode(), 1 << 30))
            for n in archive.namelist():
                if re.match(r"(word|ppt|xl)/media/", n) and len(found) < MOST_IMAGES:
                    data = archive.read(n)
                    size = image_size(data)
                    if size and min(size[1:]) >= LEAST_PIXELS:
                        found.append({"index": len(found) + 1, "mime": size[0], "width": size[1], "height": size[2], "sha256": hashlib.sha256(data).hexdigest(), "page": slides.get(n.rsplit("/", 1)[-1])})
    except (zipfile.BadZipFile, struct.error):
        pass
    return found
