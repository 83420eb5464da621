"""Text and tables of uploaded files: workbooks, text documents, PDF and plain text, from their bytes.

Each function takes the bytes of one file. A file that can't be read gives no text (or no rows), never an error.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 100_000
_MAIN, _REL, _WORD = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(name: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", name).group(0):
        number = number * 26 + ord(c) - 64
    return number - 1


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text, row by row; empty cells are null."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")).get(f"{_REL}id")
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first].lstrip("/")
        sheet = ElementTree.fromstring(book.read(target if target in names else f"xl/{target}"))
        rows = []
        for row in sheet.iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for at, cell in enumerate(row.iter(f"{_MAIN}c")):
                place = _column(cell.get("r")) if cell.get("r") else at
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[place] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None:
                    cells[place] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, StopIteration):
        return []


def word_text(content: bytes) -> str:
    """The paragraphs of a text document, one to a line."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = rb"(\d+)\s+\d+\s+R"
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|/[^\s/<>\[\]()]+\s+[\d.]+\s+Tf\b|T\*|\bT[jJdD]\b|\bTm\b|'|\"|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _bytes_of(token: bytes) -> bytes:
    """The bytes of a string in parentheses or in hexadecimal digits."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    return re.sub(rb"\\(?:([0-7]{1,3})|(.))", lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPES.get(m[2], m[2]), token[1:-1], flags=re.S)


def _plain(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "ignore") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "ignore")


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Number, dictionary and inflated stream of every object, those in object streams too. Streams of other filters are None."""
    found: dict[int, tuple[bytes, bytes | None]] = {}
    for m in _OBJECT.finditer(content):
        number, body = int(m[1]), m[2]
        stream = _STREAM.search(body)
        head, raw = (body[: stream.start()], stream[1]) if stream else (body, None)
        if raw is not None and b"/FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw)  # an end that looks like a line end may be cut off
            except zlib.error:
                raw = None
        elif b"/Filter" in head:
            raw = None
        found[number] = (head, raw)
    for head, raw in list(found.values()):
        first = re.search(rb"/First\s+(\d+)", head)
        if raw is None or b"/ObjStm" not in head or not first:
            continue
        start = int(first[1])
        pairs = [int(x) for x in re.findall(rb"\d+", raw[:start])]
        places = [start + at for at in pairs[1::2]]
        for number, a, b in zip(pairs[::2], places, [*places[1:], len(raw)]):
            found.setdefault(number, (raw[a:b], None))
    return found


def _codes(cmap: bytes) -> dict[bytes, str]:
    """The characters of a font's codes, from its ToUnicode map: single codes and ranges."""
    text = lambda digits: bytes.fromhex(digits.decode()).decode("utf-16-be", "ignore")
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, shown in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(code.decode())] = text(shown)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, shown, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            listed, size = re.findall(rb"<([0-9A-Fa-f]+)>", several), len(low) // 2
            for k, code in enumerate(range(int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF) + 1)):
                if shown:
                    first = text(shown)
                    out[code.to_bytes(size, "big")] = first[:-1] + chr(ord(first[-1]) + k) if first else ""
                elif k < len(listed):
                    out[code.to_bytes(size, "big")] = text(listed[k])
    return out


def _decoded(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return _plain(raw)
    sizes, out, at = sorted({len(c) for c in codes}, reverse=True), [], 0
    while at < len(raw):
        size = next((k for k in sizes if raw[at : at + k] in codes), sizes[-1])
        out.append(codes.get(raw[at : at + size], ""))
        at += size
    return "".join(out)


def _fonts(objects: dict[int, tuple[bytes, bytes | None]]) -> dict[int, dict[bytes, dict[bytes, str]]]:
    """For each page stream, its fonts' codes by the font's name; resources may be the page's, its parent's, or objects of their own."""
    out: dict[int, dict[bytes, dict[bytes, str]]] = {}
    empty = (b"", None)
    for head, _ in objects.values():
        contents = re.search(rb"/Contents\s*(?:" + _REFERENCE + rb"|\[(.*?)\])", head, re.S)
        if not contents:
            continue
        holder, seen = head, 0
        while b"/Resources" not in holder and (up := re.search(rb"/Parent\s+" + _REFERENCE, holder)) and seen < 50:
            holder, seen = objects.get(int(up[1]), empty)[0], seen + 1
        if own := re.search(rb"/Resources\s+" + _REFERENCE, holder):
            holder = objects.get(int(own[1]), empty)[0]
        listed = re.search(rb"/Font\s*(?:" + _REFERENCE + rb"|<<(.*?)>>)", holder, re.S)
        named = objects.get(int(listed[1]), empty)[0] if listed and listed[1] else listed[2] if listed else b""
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REFERENCE, named):
            if to := re.search(rb"/ToUnicode\s+" + _REFERENCE, objects.get(int(number), empty)[0]):
                fonts[name] = _codes(objects.get(int(to[1]), empty)[1] or b"")
        for number in [contents[1]] if contents[1] else re.findall(_REFERENCE, contents[2]):
            out[int(number)] = fonts
    return out


def pdf_text(content: bytes) -> str:
    """What a PDF's page streams show, in their order; moves to another line are line ends. Codes of fonts with a ToUnicode map are read by it, and
    objects in object streams are found. Streams of other filters, and codes without such a map, give no text or that of Windows-1252; a file that
    isn't a PDF gives none."""
    if not content.startswith(b"%PDF"):
        return ""
    objects, out = _objects(content), []
    fonts = _fonts(objects)
    for number, (head, raw) in objects.items():
        if raw is None or b"BT" not in raw or b"begincmap" in raw or b"/ObjStm" in head:
            continue
        codes = None
        for token in _SHOWN.findall(raw):
            if token.endswith(b"Tf"):
                codes = fonts.get(number, {}).get(token[1:].split()[0])
            elif token[:1] in b"(<":
                out.append(_decoded(_bytes_of(token), codes))
            elif token in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"', b"ET") and out and out[-1] != "\n":
                out.append("\n")
    return "".join(out).strip("\n")


def text_of(name: str, content: bytes, most: int = MOST) -> str:
    """The first characters of an upload, read as its name's ending says."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "pdf":
        text = pdf_text(content)
    elif kind == "docx":
        text = word_text(content)
    elif kind in ("xlsx", "xlsm"):
        text = "\n".join(",".join(x or "" for x in row) for row in sheet_rows(content))
    else:
        text = content.decode("utf-8", "replace")
    return text[:most]


def uploads(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """path and text of all files in a folder."""
    return texts(spark.read.format("binaryFile").load(path).select("path", "content"), most)


def texts(files: DataFrame, most: int = MOST) -> DataFrame:
    """path and text of files given as path and content."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [text_of(p, bytes(c), most) for p, c in zip(frame["path"], frame["content"])]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def workbooks(files: DataFrame, names: list[str]) -> DataFrame:
    """path and the named columns of first sheets; the first row has the names, in any case; blank rows are dropped."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                head, *body = sheet_rows(bytes(content)) or [[]]
                at = {(x or "").strip().lower(): i for i, x in reversed(list(enumerate(head)))}
                for row in body:
                    values = [((row[at[n.lower()]] or "").strip() or None) if n.lower() in at and at[n.lower()] < len(row) else None for n in names]
                    if any(v is not None for v in values):
                        rows.append((path, *values))
            yield pd.DataFrame(rows, columns=["path", *names], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"`{n}` string" for n in names))


# Elements without main text, and those that have it.
DROPPED = ["script", "style", "nav", "footer", "header", "aside"]
MAIN = r"(?is)<main(?:\s[^>]*)?>(.*?)</main\s*>|<article(?:\s[^>]*)?>(.*?)</article\s*>"


def main_text(html: Column) -> Column:
    """A page's text: of its first main or article element, else of the whole; without menus and the like, blanks as one."""
    bare = html
    for tag in DROPPED:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    main = F.concat(F.regexp_extract(bare, MAIN, 1), F.regexp_extract(bare, MAIN, 2))
    body = F.when(main != "", main).otherwise(F.regexp_replace(bare, r"(?is)<title[^>]*>.*?</title>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))


# Hosts of others that companies keep their documents on.
FILE_HOSTS = r"ctfassets\.net|q4cdn\.com|s3\.amazonaws\.com"


def pdf_links(pages: DataFrame, key: str, url: str, html: str, topics: list[str], most_links: int = 20, most: int = 5) -> DataFrame:
    """key, link, year, n: PDF links on a page to its own site or to file hosts that name a topic, newest first."""
    from ..functions import urls
    from .sinks import numbered

    links = F.slice(F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']*\\.pdf[^\"']*)"), F.lit(1)), 1, most_links)
    rows = pages.select(key, F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+", 0).alias("site"), urls.host(url).alias("host"), F.posexplode(links).alias("pos", "href"))
    rows = rows.withColumn("link", F.when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.col("href")))
    own = urls.host("link").contains(F.regexp_replace("host", r"^www\.", "")) & (F.col("host") != "")
    rows = rows.where(F.col("link").rlike(r"(?i)\.pdf(\?|$)") & (own | urls.host("link").rlike(FILE_HOSTS)) & F.lower("link").rlike("|".join(topics)))
    year = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("link", F.lit(r"(20[12]\d)"), F.lit(1)), lambda y: y.cast("int"))), F.lit(0))
    return numbered(rows.select(key, "link", "pos", year.alias("year")), [key], [F.desc("year"), F.col("pos")], "n").where(F.col("n") <= most).select(key, "link", "year", "n")


# ---------------------------------------------------------------- writers, for round trips


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet of text cells."""
    from xml.sax.saxutils import escape

    letter = lambda i: chr(65 + i)
    cells = lambda n, row: "".join(f'<c r="{letter(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(row) if v is not None)
    sheet = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(f"<row r={chr(34)}{n}{chr(34)}>{cells(n, row)}</row>" for n, row in enumerate(rows, 1))}</sheetData></worksheet>'
    book = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/worksheets/sheet1.xml", sheet)):
            z.writestr(name, body)
    return out.getvalue()


def pdf(text: str) -> bytes:
    """A PDF of one page that shows the lines of a text; characters beyond Windows-1252 are written as UTF-16."""

    def shown(line: str) -> bytes:
        try:
            raw = line.encode("cp1252")
        except UnicodeEncodeError:
            raw = b"\xfe\xff" + line.encode("utf-16-be")
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", raw).replace(b"\r", b"\\r") + b") Tj T*"

    body = zlib.compress(b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"\n".join(shown(x) for x in text.split("\n")) + b"\nET")
    return b"%PDF-1.4\n1 0 obj\n<</Length " + str(len(body)).encode() + b" /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream\nendobj\ntrailer\n<<>>\n%%EOF"
