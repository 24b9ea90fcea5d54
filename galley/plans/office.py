"""Office files made from tables, so that readers have whole files to read: bytes of workbooks and documents as columns."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    import pyarrow as pa

#: Files that a worker gives at once.
TOGETHER = 128


def _zipped(files: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return held.getvalue()


def workbook(rows: Sequence[Sequence[str]]) -> bytes:
    """A workbook with one sheet; every other cell is a shared string, empty ones are left out."""
    shared: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            if value and (r + c) % 2:
                cells.append(f'<c r="{chr(65 + c)}{r}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            elif value:
                cells.append(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    return _zipped({"xl/sharedStrings.xml": f"<sst {main}>{strings}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>"})


def word(paragraphs: Sequence[tuple[str, str]]) -> bytes:
    """A word document of (kind, text): headings, code, bold, numbered, bulleted, tables of one row (cells by bars), pictures, body."""
    parts = []
    for kind, text in paragraphs:
        run = f"<w:t>{escape(text)}</w:t>"
        if kind == "table":
            cells = "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in text.split("|"))
            parts.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
            continue
        style = f'<w:pStyle w:val="{kind}"/>' if kind.startswith("heading") else ""
        number = f'<w:numPr><w:numId w:val="{1 if kind == "numbered" else 2}"/></w:numPr>' if kind in ("numbered", "bullet") else ""
        format_ = {"bold": "<w:rPr><w:b/></w:rPr>", "code": '<w:rPr><w:rFonts w:ascii="Consolas"/></w:rPr>'}.get(kind, "")
        picture = '<w:r><w:drawing><a:blip r:embed="rId7"/></w:drawing></w:r>' if kind == "picture" else ""
        parts.append(f"<w:p><w:pPr>{style}{number}</w:pPr>{picture}<w:r>{format_}{run}</w:r></w:p>")
    spaces = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:r="urn:r"'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>' for k, f in ((5, "decimal"), (6, "bullet")))
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="6"/></w:num>'
    return _zipped({
        "word/document.xml": f"<w:document {spaces}><w:body>{''.join(parts)}</w:body></w:document>",
        "word/numbering.xml": f"<w:numbering {spaces}>{numbering}</w:numbering>",
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId7" Type="urn:rel/image" Target="media/one.png"/></Relationships>',
    })


def hwpx(paragraphs: Sequence[tuple[str, str]]) -> bytes:
    """A hwpx document of two sections, numbered so that their names sort the wrong way; the second holds the last paragraph."""

    def one(kind: str, text: str) -> str:
        run = f"<hp:run><hp:t>{escape(text)}</hp:t></hp:run>"
        if kind == "table":
            cells = "".join(f"<hp:tc><hp:p><hp:run><hp:t>{escape(c)}</hp:t></hp:run></hp:p></hp:tc>" for c in text.split("|"))
            return f"<hp:tbl><hp:tr>{cells}</hp:tr></hp:tbl>"
        if kind in ("header", "footNote"):
            return f"<hp:{kind}><hp:p>{run}</hp:p></hp:{kind}>"
        outline = f'<hp:paraPr outlineLevel="{int(kind[-1]) - 1}"/>' if kind.startswith("heading") else ""
        number = '<hp:numbering numFormat="DIGIT"/>' if kind == "numbered" else ""
        font = '<hp:fontRef faceNameRef="D2Coding"/>' if kind == "code" else ""
        return f"<hp:p>{outline}{number}{font}{run}</hp:p>"

    section = lambda some: f'<hs:sec xmlns:hs="urn:s" xmlns:hp="urn:p">{"".join(one(k, t) for k, t in some)}</hs:sec>'
    return _zipped({"Contents/section10.xml": section(paragraphs[-1:]), "Contents/section2.xml": section(paragraphs[:-1])})


def old_doc(text: str) -> bytes:
    """What a legacy document looks like to a scanner: UTF-16 text between bytes that are no text."""
    return b"\xd0\xcf\x11\xe0\x00\x00\x01\x00" + text.encode("utf-16-le") + b"\x00\x00\x07\x00"


MAKERS = {"xlsx": workbook, "docx": word, "hwpx": hwpx, "doc": old_doc}


def made(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (name, date, data) with content in place of data: cells or paragraphs for the makers, a text for 'doc'.

    A worker turns one row at a time into Python objects and gives ``TOGETHER`` files at once, whatever the size of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                contents = []
                for x in some.column("data"):
                    x = x.as_py()
                    contents.append(MAKERS[kind](x if isinstance(x, str) else [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in x]))
                yield pa.RecordBatch.from_arrays([some.column("name"), some.column("date"), pa.array(contents, pa.binary())], names=["name", "date", "content"])

    return rows.select("name", "date", "data").mapInArrow(run, "name string, date date, content binary")
