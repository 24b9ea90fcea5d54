"""Readers of zipped office documents and of spreadsheets, as rows for Spark.

Files are scanned with ``binaryFile``; a task opens one file at a time with the standard library's zip and XML
readers and yields its rows, so a folder of files is read by as many tasks as it has splits.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import fixed

#: Names of columns by their logical meaning (fixed values), tried as they are, then as parts.
HEADERS = {
    "rank": ("순위", "rank"),
    "title": ("도서명", "상품명", "제목", "title"),
    "author": ("저자", "지은이", "author"),
    "publisher": ("출판사", "publisher"),
    "price": ("정가", "판매가", "가격", "price"),
}
POSITIONS = ("rank", "title", "author", "publisher", "price")


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, name, content of the files whose name matches a glob."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def dated(listing: DataFrame) -> DataFrame:
    """Files whose name begins with eight digits, with their date, in its order."""
    date = F.try_to_date(F.regexp_extract("name", r"^(\d{8})", 1), "yyyyMMdd")
    return listing.filter(F.col("name").rlike(r"^\d{8}")).withColumn("date", date).filter("date is not null")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as texts, by row and column."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter():
            if _local(row.tag) != "row":
                continue
            cells: dict[int, str] = {}
            for c in row:
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _texts(c)
                cells[at] = value
            out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        return out


def resolve_headers(header: Sequence[str], names: dict[str, tuple[str, ...]] = HEADERS) -> dict[str, int]:
    """Positions of logical columns: exact names first, then names that contain one. {} if no title is among them."""
    low = [h.strip().lower() for h in header]
    found = {}
    for logical, wanted in names.items():
        exact = [i for w in wanted for i, h in enumerate(low) if h == w]
        part = [i for w in wanted for i, h in enumerate(low) if w in h]
        if exact or part:
            found[logical] = (exact or part)[0]
    return found if "title" in found else {}


def ranked_items(rows: list[list[str]]) -> Iterator[tuple]:
    """rank, title, author, publisher, price of a sheet; by position where it has no header. Titles of one character go."""
    places = resolve_headers(rows[0]) if rows else {}
    body = rows[1:] if places else rows
    places = places or {c: i for i, c in enumerate(POSITIONS)}
    for row in body:
        get = lambda c: row[places[c]].strip() if c in places and places[c] < len(row) else ""
        if len(get("title")) < 2:
            continue
        try:
            rank = int(float(get("rank")))
        except ValueError:
            rank = 0
        yield rank, get("title"), get("author"), get("publisher"), get("price")


def spreadsheets(listing: DataFrame) -> DataFrame:
    """name, date, rank, title, author, publisher, price of every sheet in a listing of :func:`dated` files."""
    return _sheets(listing, ranked_items, "date date", "rank int, title string, author string, publisher string, price string")


#: Rows of a batch that a reader gives, and bytes of files (zipped, as they are) behind it.
ROWS, BYTES = 2000, 1 << 20


def in_batches(files: Iterable[tuple[int, Iterable[tuple]]]) -> Iterator[list[tuple]]:
    """The rows of files (size in bytes, rows), in order, in lists that end with a file or within it: what a worker holds doesn't grow with a batch."""
    out: list[tuple] = []
    held = 0
    for size, rows in files:
        for row in rows:
            out.append(row)
            if len(out) >= ROWS:
                yield out
                out, held = [], 0
        held += size
        if held >= BYTES and out:
            yield out
            out, held = [], 0
    if out:
        yield out


def _sheets(listing: DataFrame, parse, kept: str, schema: str) -> DataFrame:
    """name, the ``kept`` columns of the listing, and what ``parse`` makes of the rows of each file's first sheet."""
    columns = ["name", *(c.split()[0] for c in kept.split(",") if c.strip())]
    names = [*columns, *(c.split()[0] for c in schema.split(","))]

    def read(batches):
        import pandas as pd

        for batch in batches:
            files = zip(*(batch[c] for c in columns), batch["content"], strict=True)
            for out in in_batches((len(content), ((*held, *item) for item in parse(sheet_rows(bytes(content))))) for *held, content in files):
                yield pd.DataFrame(out, columns=names)

    return listing.select(*columns, "content").mapInPandas(read, ", ".join(x for x in ("name string", kept, schema) if x))


# Words in the headers of the dashboard's three tables; the last header with one names the column.
BESTSELLER_HEADERS = {
    "rank": ("순번", "순위"), "title": ("상품명", "제목", "도서"), "publisher": ("출판사",), "sales": ("세일즈", "sp", "포인트"),
    "year": ("출판일", "발행일", "출간일", "연도", "출간연도", "출판연도"), "author": ("저자", "작가", "지은이", "글쓴이"),
}
LECTURE_HEADERS = {"service": ("서비스",), "title": ("강의명", "제목", "강의"), "popularity": ("인기도", "수강생", "인기")}
PLANNED_HEADERS = {"category": ("카테고리", "분류"), "author": ("저자", "작가", "담당자"), "month": ("출간월", "출간일", "발행"), "status": ("진행", "상태")}
LECTURE_SERVICE = "강의플랫폼"
#: Rows that columns are known by where a sheet has no header.
SAMPLE = 21


def _by_header(header: Sequence[str], names: dict[str, tuple[str, ...]]) -> dict[str, int]:
    low = [h.lower() for h in header]
    return {logical: i for logical, words in names.items() for i, h in enumerate(low) if any(w in h for w in words)}


def columns_by_content(rows: Sequence[Sequence[str]], publishers: Sequence[str] = fixed.KNOWN_PUBLISHERS) -> dict[str, int]:
    """The columns of a bestseller list without a header, by at most ``SAMPLE`` of its rows.

    publisher: where known names stand most often, twice at least, in cells of 50 characters at most on average. rank:
    short numbers in half of the cells. sales: amounts in won in half. title: the longest of 5 to 100 characters
    that is none of these. author: the first other one of 2 to 30.
    """
    sample = list(rows[:SAMPLE])
    width = max(map(len, sample), default=0)
    cells = [[r[k] if k < len(r) else "" for r in sample] for k in range(width)]
    mean = [sum(map(len, c)) / len(c) for c in cells]
    share = lambda k, pattern: sum(bool(re.search(pattern, v)) for v in cells[k]) * 2 >= len(cells[k])
    found: dict[str, int] = {}
    named = [(sum(any(p in v for p in publishers) for v in cells[k]), -k) for k in range(width) if mean[k] <= 50]
    if named and max(named)[0] >= 2:
        found["publisher"] = -max(named)[1]
    for k in range(width):
        if k in found.values():
            continue
        if "rank" not in found and mean[k] < 4 and share(k, r"^\s*\d{1,3}\s*$"):
            found["rank"] = k
        elif "sales" not in found and share(k, r"[\d,]+원"):
            found["sales"] = k
    free = [k for k in range(width) if k not in found.values()]
    if titles := [k for k in free if 5 <= mean[k] <= 100]:
        found["title"] = max(titles, key=lambda k: (mean[k], -k))
    if authors := [k for k in free if k != found.get("title") and 2 <= mean[k] <= 30]:
        found["author"] = authors[0]
    return found


def bestseller_rows(rows: list[list[str]]) -> Iterator[tuple]:
    """rank, title, publisher, author, sales, year of a bestseller list; its place is the rank where it has none.

    Columns are found by header, else by content; a list without a title or publisher column gives no rows. The year is
    the first 20xx in its column, else in the title, else 0; sales are the digits of their cell, 0 without.
    """
    places = _by_header(rows[0], BESTSELLER_HEADERS) if rows else {}
    first = 1
    if "title" not in places or "publisher" not in places:
        places, first = columns_by_content(rows) | {k: v for k, v in places.items() if k in ("title", "publisher")}, 0
    if "title" not in places or "publisher" not in places:
        return
    for i, row in enumerate(rows[first:], first):
        get = lambda c: row[places[c]].strip() if c in places and places[c] < len(row) else ""
        if not get("title"):
            continue
        year = re.search(r"20\d{2}", get("year")) or re.search(r"20\d{2}", get("title"))
        rank = re.match(r"\d+", get("rank"))
        digits = re.sub(r"\D", "", get("sales"))
        yield int(rank[0]) if rank and int(rank[0]) else i, get("title"), get("publisher"), get("author"), int(digits or 0), int(year[0]) if year else 0


def lecture_rows(rows: list[list[str]]) -> Iterator[tuple]:
    """service, cat1, cat2, title, popularity of a list of lectures; the title is that of the narrow category where it has none."""
    header = [h.strip().lower() for h in rows[0]] if rows else []
    places = _by_header(header, LECTURE_HEADERS)
    for i, h in enumerate(header):
        if "전체 카테고리" in h or h == "cat1":
            places["cat1"] = i
        elif h == "cat2" or ("카테고리" in h and "전체" not in h):
            places["cat2"] = i
    name = places.get("title", places.get("cat2"))
    for row in rows[1:] if name is not None else ():
        get = lambda k: row[k].strip() if k is not None and k < len(row) else ""
        if get(name):
            service = get(places["service"]) if "service" in places else LECTURE_SERVICE
            yield service, get(places.get("cat1")), get(places.get("cat2")), get(name), int(re.sub(r"\D", "", get(places.get("popularity"))) or 0)


def planned_rows(rows: list[list[str]]) -> Iterator[tuple]:
    """title, category, team, author, month, status of a list of planned titles, months as 'yyyy년 mm월'."""
    header = [h.strip().lower() for h in rows[0]] if rows else []
    places = _by_header(header, PLANNED_HEADERS)
    for i, h in enumerate(header):
        if "도서명" in h or h == "제목" or "책제목" in h or ("제목" in h and "title" not in places):
            places["title"] = i
        if h == "팀" or "담당팀" in h or "팀명" in h:
            places["team"] = i
    for row in rows[1:] if "title" in places else ():
        get = lambda c: row[places[c]].strip() if c in places and places[c] < len(row) else ""
        if get("title"):
            yield get("title"), get("category"), get("team"), get("author"), re.sub(r"^(\d{4}년)(\d{2}월)$", r"\1 \2", get("month")), get("status")


def bestsellers(listing: DataFrame) -> DataFrame:
    """name and the columns of :func:`bestseller_rows` of every sheet in a listing (name, content)."""
    return _sheets(listing, bestseller_rows, "", "rank long, title string, publisher string, author string, sales long, year int")


def lectures(listing: DataFrame) -> DataFrame:
    """name and the columns of :func:`lecture_rows` of every sheet in a listing (name, content)."""
    return _sheets(listing, lecture_rows, "", "service string, cat1 string, cat2 string, title string, popularity long")


def planned(listing: DataFrame) -> DataFrame:
    """name and the columns of :func:`planned_rows` of every sheet in a listing (name, content)."""
    return _sheets(listing, planned_rows, "", "title string, category string, team string, author string, month string, status string")


def isbn_items(rows: list[list[str]]) -> Iterator[tuple]:
    """isbn, rank, title, author, publisher, price of a sheet with a column of ISBNs; rank 999 and price 0 where there is none.

    Quotes around ISBNs go, and rows without one, or with 'None' for one, too.
    """
    names = HEADERS | {"isbn": ("isbn", "isbn13")}
    places = resolve_headers(rows[0], names) if rows else {}
    whole = lambda text, otherwise: int(float(t)) if re.fullmatch(r"\d+(?:\.\d+)?", t := text.replace(",", "").removesuffix("원")) else otherwise
    for row in rows[1:] if "isbn" in places else ():
        get = lambda c: row[places[c]].strip() if c in places and places[c] < len(row) else ""
        isbn = get("isbn").strip("'\"` ")
        if isbn and isbn != "None":
            yield isbn, whole(get("rank"), 999), get("title"), get("author"), get("publisher"), whole(get("price"), 0)


def isbn_snapshots(listing: DataFrame) -> DataFrame:
    """name, date and the columns of :func:`isbn_items` of every sheet in a listing of :func:`dated` files."""
    return _sheets(listing, isbn_items, "date date", "isbn string, rank int, title string, author string, publisher string, price int")


def number(text: Column) -> Column:
    """The first run of digits and commas as an integer, null without."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"([\d,]*\d[\d,]*)", 1), ",", ""), F.lit("")).cast("long")


def docx_text(content: bytes) -> str:
    """The text of a word document: tabs, breaks and paragraphs as white space."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[str] = []
    for node in root.iter():
        kind = _local(node.tag)
        if kind == "p" and out:
            out.append("\n")
        elif kind == "t":
            out.append(node.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def hwpx_text(content: bytes) -> str:
    """The text of a hwpx document: sections in the order of their numbers, without headers, footers and notes."""
    skip = {"header", "footer", "footNote", "endNote"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sections = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        paragraphs: list[str] = []
        for name in sections:
            todo = [ElementTree.fromstring(z.read(name))]
            while todo:
                node = todo.pop()
                if _local(node.tag) in skip:
                    continue
                if _local(node.tag) == "t":
                    paragraphs[-1:] = [(paragraphs[-1] if paragraphs else "") + "".join(node.itertext())]
                    continue
                if _local(node.tag) == "p":
                    paragraphs.append("")
                todo += reversed(list(node))
    return "\n".join(p for p in paragraphs if p)


ELEMENTS = "pos int, style string, text string, numbered boolean, bullet boolean, font string, bold boolean, drawing string, level int, rows array<array<string>>, runs array<struct<text:string,bold:boolean,italic:boolean,font:string>>"


def _word(node: ElementTree.Element, name: str) -> str:
    """An attribute by its local name, '' without."""
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def docx_elements(content: bytes) -> list[tuple]:
    """The paragraphs and tables of a word document in order, as rows of ``ELEMENTS``.

    Numbered and bulleted paragraphs are told apart by the numbering they refer to (bullets where it isn't known);
    drawing is the target of a paragraph's picture; a paragraph without text or picture goes. Runs carry bold, italic
    and font; a table has its cells' texts in rows.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n)) if n in names else ElementTree.Element("none")
        body = next((n for n in read("word/document.xml") if _local(n.tag) == "body"), ())
        links = {_word(n, "Id"): _word(n, "Target") for n in read("word/_rels/document.xml.rels") if "image" in _word(n, "Type")}
        numbering = list(read("word/numbering.xml"))
    formats = {_word(n, "abstractNumId"): next((_word(f, "val") for f in n.iter() if _local(f.tag) == "numFmt"), "") for n in numbering if _local(n.tag) == "abstractNum"}
    kinds = {_word(n, "numId"): formats.get(next((_word(a, "val") for a in n if _local(a.tag) == "abstractNumId"), ""), "") for n in numbering if _local(n.tag) == "num"}
    out: list[tuple] = []
    for node in body:
        kind = _local(node.tag)
        if kind == "tbl":
            rows = [[_texts(c) for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]
            if rows:
                out.append((len(out), "table", "", False, False, "", False, None, None, rows, []))
            continue
        if kind != "p":
            continue
        first = lambda name, node=node: next((n for n in node.iter() if _local(n.tag) == name), None)
        style, number, blip = first("pStyle"), first("numPr"), first("blip")
        runs = []
        for r in node.iter():
            if _local(r.tag) != "r" or not (text := _texts(r)):
                continue
            on = lambda name, r=r: any(_local(n.tag) == name and _word(n, "val") not in ("0", "false") for n in r.iter())
            font = next((_word(n, "ascii") for n in r.iter() if _local(n.tag) == "rFonts"), "")
            runs.append({"text": text, "bold": on("b"), "italic": on("i"), "font": font})
        text = "".join(r["text"] for r in runs)
        picture = links.get(_word(blip, "embed")) if blip is not None else None
        if not text.strip() and not picture:
            continue
        ident = next((_word(n, "val") for n in number.iter() if _local(n.tag) == "numId"), "") if number is not None else ""
        decimal = number is not None and kinds.get(ident) == "decimal"
        fonts = " ".join(r["font"] for r in runs if r["font"])
        bold = bool(runs) and all(r["bold"] for r in runs)
        out.append((len(out), _word(style, "val") if style is not None else "", text, decimal, number is not None and not decimal, fonts, bold, picture, None, None, runs))
    return out


def hwpx_elements(content: bytes) -> list[tuple]:
    """The tables, pictures and paragraphs of a hwpx document, as rows of ``ELEMENTS``.

    Sections follow their numbers, without headers, footers and notes. level is the outline level from 1; paragraphs
    of level 1 to 4 have a heading style of that level. In a section tables come first, then pictures, then text.
    """
    skip = {"header", "footer", "footnote", "endnote"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        sections = [ElementTree.fromstring(z.read(n)) for n in names]
    out: list[tuple] = []
    for section in sections:
        tables, pictures, paragraphs = [], [], []
        todo = [section]
        while todo:
            node = todo.pop()
            kind = _local(node.tag)
            if kind.lower() in skip:
                continue
            if kind == "tbl":
                tables.append(node)
                continue
            if kind == "image":
                pictures.append(node)
            if kind == "p":
                paragraphs.append(node)
            todo += reversed(list(node))
        for t in tables:
            rows = [[_texts(c) for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]
            if rows:
                out.append((len(out), "table", "", False, False, "", False, None, None, rows, []))
        out += [(len(out) + i, "", "", False, False, "", False, _word(p, "binaryItemIDRef"), None, None, []) for i, p in enumerate(pictures)]
        for p in paragraphs:
            inner = {id(x) for t in p.iter() if _local(t.tag) == "tbl" for x in t.iter()}
            text = "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t" and id(x) not in inner)
            if not text.strip():
                continue
            outline = next((_word(n, "outlineLevel") for n in p.iter() if _word(n, "outlineLevel").isdigit()), "")
            level = int(outline) + 1 if outline else None
            style = next((_word(n, "styleIDRef") for n in p.iter() if _word(n, "styleIDRef")), "")
            if level is not None and level <= 4:
                style = f"Heading{level}"
            elif level is None and re.match(r"\d+\.\s|제?\s*\d+\s*절", text.strip()):
                style = "Heading2"
            number = next((n for n in p.iter() if _local(n.tag) == "numbering"), None)
            decimal = number is not None and bool(re.search("decimal|digit", _word(number, "numFormat"), re.I))
            fonts = " ".join(_word(n, "faceNameRef") for n in p.iter() if _local(n.tag) == "fontRef")
            out.append((len(out), style, text, decimal, number is not None and not decimal, fonts, False, None, level, None, [{"text": text, "bold": False, "italic": False, "font": fonts}]))
    return out


def elements(listing: DataFrame) -> DataFrame:
    """name and ``ELEMENTS`` of the .docx and .hwpx files in a listing (name, content); others give no rows."""

    def read(batches):
        import pandas as pd

        columns = ["name", *(c.split()[0] for c in ELEMENTS.split(", "))]
        def rows(name: str, content: bytes) -> Iterator[tuple]:
            reader = {".docx": docx_elements, ".hwpx": hwpx_elements}.get(name[name.rfind(".") :].lower())
            return ((name, *row) for row in (reader(bytes(content)) if reader else ()))

        for batch in batches:
            for out in in_batches((len(content), rows(name, content)) for name, content in zip(batch["name"], batch["content"], strict=True)):
                frame = pd.DataFrame(out, columns=columns)
                frame["level"] = frame["level"].astype("Int32")
                yield frame

    return listing.select("name", "content").mapInPandas(read, f"name string, {ELEMENTS}")


def doc_text(content: bytes) -> str:
    """What legacy .doc files show of Hangul: runs of ten UTF-16 characters or more, if they make up a hundred."""
    runs = [r for k in (0, 1) for r in re.findall(r"[가-힣ㄱ-ㅎㅏ-ㅣ\w\s.,!?()'\"-]{10,}", content[k:].decode("utf-16-le", "ignore")) if re.search("[가-힣]", r)]
    text = "\n".join(dict.fromkeys(r.strip() for r in runs))
    return text if len(text) >= 100 else ""


READERS = {".docx": docx_text, ".hwpx": hwpx_text, ".doc": doc_text}


def documents(listing: DataFrame) -> DataFrame:
    """name, text, error of office documents by their ending; .hwp and unknown ones give an error, not a text."""

    def one(name: str, content: bytes) -> tuple:
        reader = READERS.get(name[name.rfind(".") :].lower())
        if reader is None:
            return name, None, "unsupported format"
        try:
            return name, reader(bytes(content)), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
            return name, None, f"{type(error).__name__}: {error}"

    def read(batches):
        import pandas as pd

        for batch in batches:
            for out in in_batches((len(c or b""), [one(n, c)]) for n, c in zip(batch["name"], batch["content"], strict=True)):
                yield pd.DataFrame(out, columns=["name", "text", "error"])

    return listing.select("name", "content").mapInPandas(read, "name string, text string, error string")
