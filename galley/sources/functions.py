"""Readers of office files as table functions, so that SQL can call them.

After :func:`register`, ``SELECT ... FROM office_rows(TABLE(files) PARTITION BY (name), 'text')`` reads the files of any table with the columns
name and content. The second argument, a constant, says what is wanted, and the columns of the result follow from it:

* 'text': name, text, error, a row a file, as :func:`galley.sources.archives.documents`;
* 'elements': name and the columns of :data:`galley.sources.archives.ELEMENTS`, a row a paragraph or table;
* 'cells': name, line, cells, a row a line of a workbook's first sheet.

More readers are added to :data:`MODES`. The bytes are read where the rows are; with PARTITION BY the files of a key go to one task.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from galley.sources import archives

_BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError)


def _text(name: str, content: bytes) -> Iterator[tuple]:
    reader = archives.READERS.get(_ending(name))
    if reader is None:
        yield name, None, "unsupported format"
        return
    try:
        yield name, reader(content), None
    except _BROKEN as error:
        yield name, None, f"{type(error).__name__}: {error}"


def _elements(name: str, content: bytes) -> Iterator[tuple]:
    reader = {".docx": archives.docx_elements, ".hwpx": archives.hwpx_elements}.get(_ending(name))
    try:
        rows = reader(content) if reader else []
    except _BROKEN:
        return
    for row in rows:
        yield name, *row


def _cells(name: str, content: bytes) -> Iterator[tuple]:
    if _ending(name) != ".xlsx":
        return
    try:
        rows = archives.sheet_rows(content)
    except (*_BROKEN, ValueError):  # the last for a workbook without a sheet
        return
    for line, cells in enumerate(rows):
        yield name, line, cells


def _ending(name: str) -> str:
    return name[name.rfind(".") :].lower()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_STRING, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()
#: Types as objects, since no session is there to parse them where a call is analysed; the first are those of ``archives.ELEMENTS``.
_ELEMENTS = _struct(
    pos=_INT, style=_STRING, text=_STRING, numbered=_BOOL, bullet=_BOOL, font=_STRING, bold=_BOOL, drawing=_STRING, level=_INT, rows=T.ArrayType(T.ArrayType(_STRING)),
    runs=T.ArrayType(_struct(text=_STRING, bold=_BOOL, italic=_BOOL, font=_STRING)),
)
#: What can be asked for: the columns behind name, and the reader.
MODES = {"text": (_struct(text=_STRING, error=_STRING), _text), "elements": (_ELEMENTS, _elements), "cells": (_struct(line=_INT, cells=T.ArrayType(_STRING)), _cells)}


class OfficeRows:
    """The handler of ``office_rows``. Files that can't be read give no elements or cells, and an error as text; null names or contents give no rows."""

    @staticmethod
    def analyze(files: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("the first argument is a table, as in office_rows(TABLE(files), 'text')")
        absent = {"name", "content"} - {f.name for f in files.dataType}
        if absent:
            raise ValueError(f"the table lacks {', '.join(sorted(absent))}")
        if not what.isConstantExpression or what.value not in MODES:
            raise ValueError(f"the second argument is one of {', '.join(sorted(MODES))}")
        return AnalyzeResult(schema=T.StructType([T.StructField("name", _STRING), *MODES[what.value][0]]))

    def eval(self, file: Row, what: str) -> Iterator[tuple]:
        if file["name"] is not None and file["content"] is not None:
            yield from MODES[what][1](file["name"], bytes(file["content"]))


def register(spark: SparkSession) -> None:
    """Makes ``office_rows`` known to a session's SQL."""
    spark.udtf.register("office_rows", F.udtf(OfficeRows))
