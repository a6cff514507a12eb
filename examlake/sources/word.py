"""Word files (.docx) as lines, with automatic numbers, underlined blanks, tables and pictures; needs the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import POINTS

#: Fixed values of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
NAMESPACES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: The first bytes of files.
MAGIC = {"docx": b"PK\x03\x04", "doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "pdf": b"%PDF"}
LEFT, ABOVE = ">", "^"
BLANK, BLANKS = "____", re.compile(r"[_＿]{2,}")
SCHEMA = "path string, pos int, text string, page int, y double, x double, height double, number int, blanks int, source string, is_heading boolean, image boolean, ref string, cells array<string>, error string"


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _value(element: ElementTree.Element | None, name: str = "val") -> str | None:
    return None if element is None else element.get(W + name)


class _Numbering:
    """Formats of list levels, lists of styles and running counters."""

    def __init__(self, numbering: ElementTree.Element | None, styles: ElementTree.Element | None):
        self.formats: dict[tuple[str | None, str | None], str] = {}
        levels = {}
        for abstract in [] if numbering is None else numbering.iter(W + "abstractNum"):
            levels[_value(abstract, "abstractNumId")] = {_value(level, "ilvl"): _value(level.find(W + "numFmt")) or "decimal" for level in abstract.iter(W + "lvl")}
        for num in [] if numbering is None else numbering.iter(W + "num"):
            for level, form in levels.get(_value(num.find(W + "abstractNumId")), {}).items():
                self.formats[_value(num, "numId"), level] = form
        self.styles = {_value(s, "styleId"): s for s in ([] if styles is None else styles.iter(W + "style"))}
        self.seen: Counter = Counter()

    def name(self, style: str | None) -> str:
        return _value(self.styles[style].find(W + "name")) or "" if style in self.styles else ""

    def list_of(self, paragraph: ElementTree.Element, style: str | None) -> ElementTree.Element | None:
        own, walked = paragraph.find(f"{W}pPr/{W}numPr"), set()
        while own is None and style in self.styles and style not in walked:
            walked.add(style)
            own = self.styles[style].find(f"{W}pPr/{W}numPr")
            style = _value(self.styles[style].find(W + "basedOn"))
        return own

    def next(self, paragraph: ElementTree.Element, style: str | None) -> tuple[int | None, bool]:
        """The paragraph's automatic number, and whether it is printed."""
        entry = self.list_of(paragraph, style)
        number = None if entry is None else _value(entry.find(W + "numId"))
        if number in (None, "0"):
            return None, False
        level = _value(entry.find(W + "ilvl")) or "0"
        form = self.formats.get((number, level), "decimal")
        if form != "none" and not form.startswith("decimal"):
            return None, False
        self.seen[number, level] += 1
        return self.seen[number, level], form != "none"


def _run_text(run: ElementTree.Element) -> str:
    pieces = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n", "noBreakHyphen": lambda e: "-"}
    return "".join(pieces[e.tag.removeprefix(W)](e) for e in run if e.tag.removeprefix(W) in pieces)


def _to_fill(run: ElementTree.Element, text: str) -> bool:
    """Whether an underlined run is a place to write in: nothing, one sign or underscores stand on the line."""
    line = _value(run.find(f"{W}rPr/{W}u"))
    underlined = run.find(f"{W}rPr/{W}u") is not None and line != "none"
    return underlined and (len(text.strip()) < 2 or not re.sub(r"[\s_＿]", "", text))


def _paragraph_text(paragraph: ElementTree.Element) -> tuple[str, int]:
    """Text and number of blanks. Neighbouring places to write in are shown as one blank but count each."""
    shown, places = "", 0
    for run in paragraph.iter(W + "r"):
        text = _run_text(run)
        if not _to_fill(run, text):
            shown += text
            continue
        places += 1
        if not shown.rstrip().endswith(BLANK):
            shown += BLANK
        else:
            shown = shown.rstrip()
    return shown.strip(), max(places, len(BLANKS.findall(shown)))


def _cells(row: ElementTree.Element) -> list[str]:
    out = []
    for cell in row.findall(W + "tc"):
        merge, span = cell.find(f"{W}tcPr/{W}vMerge"), _value(cell.find(f"{W}tcPr/{W}gridSpan"))
        text = "\n".join(t for p in cell.findall(W + "p") if (t := _paragraph_text(p)[0]))
        out.append(ABOVE if merge is not None and _value(merge) in (None, "continue") else text)
        out += [LEFT] * (int(span or 1) - 1)
    return out


def _of_paragraph(element: ElementTree.Element, numbering: _Numbering, relations: dict[str | None, str | None]) -> Iterator[dict]:
    """The pictures of a paragraph, then its lines: soft breaks end a line, number and heading are those of the first."""
    style = _value(element.find(f"{W}pPr/{W}pStyle"))
    text, blanks = _paragraph_text(element)
    number, printed = numbering.next(element, style)
    if printed and text and not re.match(rf"\d+\s*[{POINTS}]", text):
        text = f"{number}. {text}"
    yield from ({"image": True, "ref": relations[picture.get(EMBED)]} for picture in element.iter(A_BLIP) if picture.get(EMBED) in relations)
    name = numbering.name(style)
    heading = name == "Title" or name.startswith("标题") or name.lower().startswith("heading")
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    for line in lines:
        first = line is lines[0]
        yield {"text": line, "number": number if first else None, "is_heading": heading and first, "blanks": blanks if len(lines) == 1 else len(BLANKS.findall(line))}


def _of_table(element: ElementTree.Element) -> Iterator[dict]:
    """A line for each row that has any text besides marks of merged cells."""
    for cells in map(_cells, element.findall(W + "tr")):
        words = [c.replace("\n", " ") for c in cells if c not in ("", LEFT, ABOVE)]
        if words:
            yield {"text": "  ".join(words), "cells": cells}


def docx_lines(content: bytes) -> list[dict]:
    """The lines of one file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _part(archive, "word/document.xml").find(W + "body")
        numbering = _Numbering(_part(archive, "word/numbering.xml"), _part(archive, "word/styles.xml"))
        found = _part(archive, "word/_rels/document.xml.rels")
        relations = {} if found is None else {r.get("Id"): r.get("Target") for r in found}
    out: list[dict] = []
    for element in body:
        for line in _of_paragraph(element, numbering, relations) if element.tag == W + "p" else _of_table(element) if element.tag == W + "tbl" else ():
            place = {"pos": len(out), "page": 1, "y": float(len(out)), "x": 10.0, "height": 1.0, "source": "docx"}
            out.append({"text": "", "number": None, "blanks": 0, "is_heading": False, "image": False, "ref": None, "cells": None} | line | place)
    return out


def kind_of(content: bytes) -> str | None:
    """What a file is by its first bytes: docx (a zip archive), doc (an OLE file), pdf; None otherwise."""
    return next((kind for kind, magic in MAGIC.items() if content.startswith(magic)), None)


def kind_column(content: str) -> Column:
    """The same of a binary column."""
    head = lambda n: F.hex(F.substring(F.col(content), 1, n))
    return F.coalesce(*[F.when(head(len(magic)) == magic.hex().upper(), kind) for kind, magic in MAGIC.items()])


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                kind = kind_of(content or b"")
                rows = docx_lines(content) if kind == "docx" else [{"error": f"{kind or 'unknown'} files are not read here"}]
            except (zipfile.BadZipFile, ElementTree.ParseError, AttributeError, KeyError) as problem:
                rows = [{"error": f"damaged file: {problem}"}]
            yield pa.RecordBatch.from_pylist([{"path": path} | r for r in rows], schema)


def word_lines(files: DataFrame) -> DataFrame:
    """Lines of files (path, content), for example of spark.read.format("binaryFile"). A file that can't be read gives one row with its error."""
    return files.select("path", "content").mapInArrow(_scanned, SCHEMA)
