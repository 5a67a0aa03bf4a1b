"""Office packages (zip with XML) as tables, with the standard library only.

binaryFile gives (path, content); each file is read in a task of its own by mapInPandas. Caps on parts,
sizes, rows and cells keep a hostile file from filling memory; a broken file gives a row in `losses`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col

PARTS, PART_BYTES, RATIO = 10_000, 256 << 20, 200
#: The rows that a sheet can have, and how many cells of a book are read before it is refused (ValueError).
ROWS, CELLS = 1_048_576, 5_000_000


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def parts_of(data: bytes) -> dict[str, bytes]:
    """The parts of a package; raises ValueError over the caps."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > PARTS:
            raise ValueError(f"more than {PARTS} parts")
        for i in infos:
            total += i.file_size
            if total > PART_BYTES or i.file_size > RATIO * max(i.compress_size, 1024):
                raise ValueError(f"{i.filename} is too large when unpacked")
            out[i.filename] = z.read(i)
    return out


def package(parts: dict[str, bytes], first: str | None = None) -> bytes:
    """A zip of parts; `first` is stored uncompressed before the others (a mimetype)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts, key=lambda n: n != first):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, parts[name], zipfile.ZIP_STORED if name == first else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml(data: bytes) -> ET.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:4096]):
        raise ValueError("a document type in a package part")
    return ET.fromstring(data)


def attr(e: ET.Element, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e if local(x.tag) in names]


# XLSX


def address(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    return int(m[2]), sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(m[1].upper())))


def rels(parts: dict[str, bytes], of: str) -> dict[str, str]:
    folder, _, name = of.rpartition("/")
    data = parts.get(f"{folder}/_rels/{name}.rels".lstrip("/"))
    if data is None:
        return {}
    out = {}
    for r in xml(data):
        target = attr(r, "Target", "")
        out[attr(r, "Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/")
    return out


def string_of(e: ET.Element) -> str:
    """A shared or inline string: its text and runs, without phonetic hints."""
    out = []
    for x in e:
        if local(x.tag) == "t":
            out.append(x.text or "")
        elif local(x.tag) == "r":
            out += [t.text or "" for t in children(x, "t")]
    return "".join(out)


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    """(sheet, row, col, type, value, formula); shared strings resolved; formulas keep their cached value."""
    parts = parts_of(data)
    book = next((n for n in ("xl/workbook.xml",) if n in parts), None)
    if book is None:
        raise ValueError("no workbook")
    links, strings = rels(parts, book), []
    if "xl/sharedStrings.xml" in parts:
        strings = [string_of(e) for e in children(xml(parts["xl/sharedStrings.xml"]), "si")]
    total = 0
    for sheets in children(xml(parts[book]), "sheets"):
        for s in sheets:
            target = links.get(attr(s, "id"))
            if target not in parts:
                continue
            last = 0
            for rows in children(xml(parts[target]), "sheetData"):
                for r in rows:
                    last = int(attr(r, "r") or last + 1)
                    if last > ROWS:
                        raise ValueError(f"more than {ROWS} rows")
                    at = 0
                    for c in children(r, "c"):
                        at = address(attr(c, "r"))[1] if attr(c, "r") else at + 1
                        total += 1
                        if total > CELLS:
                            raise ValueError(f"more than {CELLS} cells")
                        kind = attr(c, "t", "n")
                        v = next((x.text or "" for x in children(c, "v")), None)
                        f = next((x.text for x in children(c, "f")), None)
                        if kind == "inlineStr":
                            v = "".join(string_of(x) for x in children(c, "is"))
                        elif kind == "s" and v is not None:
                            v = strings[int(v)] if int(v) < len(strings) else None
                        elif kind == "b" and v is not None:
                            v = "true" if v == "1" else "false"
                        if v is not None or f is not None:
                            yield attr(s, "name"), last, at, {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}.get(kind, "number"), v, f


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of plain values."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts: dict[str, str] = {}
    for n, (_, rows) in enumerate(sheets.items(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cs = []
            for c, v in enumerate(row, 1):
                ref = f"{letters(c)}{r}"
                if v is None or v == "":
                    continue
                if isinstance(v, bool):
                    cs.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, int | float):
                    cs.append(f'<c r="{ref}"><v>{v}</v></c>')
                else:
                    cs.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cs)}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    names = list(sheets)
    parts["xl/workbook.xml"] = f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(names, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(names) + 1)) + "</Relationships>"
    parts["_rels/.rels"] = f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    over = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{types}.worksheet+xml"/>' for n in range(1, len(names) + 1))
    parts["[Content_Types].xml"] = f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>{over}</Types>'
    return package({k: v.encode() for k, v in parts.items()})


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


# ODS


def ods_cells(data: bytes) -> Iterator[tuple]:
    """(sheet, row, col, type, value, formula); repeats that hold a value are expanded in full."""
    parts = parts_of(data)
    if "content.xml" not in parts:
        raise ValueError("no content")
    total = 0
    for t in xml(parts["content.xml"]).iter():
        if local(t.tag) != "table":
            continue
        row = 0
        for r in rows_of(t):
            times = int(attr(r, "number-rows-repeated", "1"))
            cells, at = [], 0
            for c in children(r, "table-cell", "covered-table-cell"):
                n = int(attr(c, "number-columns-repeated", "1"))
                kind = attr(c, "value-type")
                text = "\n".join(text_of(p) for p in children(c, "p", "h"))
                value = {"float": attr(c, "value"), "percentage": attr(c, "value"), "currency": attr(c, "value"), "date": attr(c, "date-value"), "time": attr(c, "time-value"), "boolean": attr(c, "boolean-value"), "string": attr(c, "string-value", text)}.get(kind, text or None)
                f = attr(c, "formula")
                if value not in (None, "") or f is not None:
                    cells += [(at + k, {"float": "number"}.get(kind, kind or "string"), value, f) for k in range(1, n + 1)]
                at += n
            for k in range(1, (times if cells else 0) + 1):
                for at_, kind, value, f in cells:
                    total += 1
                    if total > CELLS:
                        raise ValueError(f"more than {CELLS} cells")
                    yield attr(t, "name"), row + k, at_, kind, value, f
            row += times


def rows_of(t: ET.Element) -> Iterator[ET.Element]:
    for x in t:
        if local(x.tag) == "table-row":
            yield x
        elif local(x.tag) in ("table-header-rows", "table-rows", "table-row-group"):
            yield from rows_of(x)


def text_of(e: ET.Element) -> str:
    """The text of a paragraph: runs of spaces, tabs and line breaks as elements."""
    out = [e.text or ""]
    for x in e:
        name = local(x.tag)
        if name == "s":
            out.append(" " * int(attr(x, "c", "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("annotation", "note", "tracked-changes"):
            out.append(text_of(x))
        out.append(x.tail or "")
    return "".join(out)


ODS_TYPE = "application/vnd.oasis.opendocument.spreadsheet"


def ods_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A spreadsheet of plain values."""
    ns = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("table", "table"), ("text", "text"), ("manifest", "manifest")))

    def cell(v) -> str:
        if v is None or v == "":
            return "<table:table-cell/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"><text:p>{str(v).upper()}</text:p></table:table-cell>'
        if isinstance(v, int | float):
            return f'<table:table-cell office:value-type="float" office:value="{v}"><text:p>{v}</text:p></table:table-cell>'
        return '<table:table-cell office:value-type="string">' + "".join(f"<text:p>{escape(p)}</text:p>" for p in str(v).split("\n")) + "</table:table-cell>"

    body = "".join(f'<table:table table:name="{escape(n)}">' + "".join(f"<table:table-row>{''.join(map(cell, r)) or '<table:table-cell/>'}</table:table-row>" for r in rows) + "</table:table>" for n, rows in sheets.items())
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {ns} office:version="1.3"><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>'
    manifest = f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest {ns} manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="{ODS_TYPE}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return package({"mimetype": ODS_TYPE.encode(), "content.xml": content.encode(), "META-INF/manifest.xml": manifest.encode()}, "mimetype")


CELL = "file string, sheet string, row int, col int, type string, value string, formula string"


def cells(spark: SparkSession, path: str, kind: str, pattern: str | None = None) -> DataFrame:
    """(file, sheet, row, col, type, value, formula) of xlsx or ods files. Files that can't be read give one row of type `loss`, its value the reason."""
    read = {"xlsx": xlsx_cells, "ods": ods_cells}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    for c in read(bytes(data)):
                        rows.append((file, *c))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=NAMES)
                            rows = []
                except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows.append((file, None, None, None, "loss", f"{type(e).__name__}: {e}", None))
                yield pd.DataFrame(rows, columns=NAMES).astype({"row": "Int64", "col": "Int64"})

    return files(spark, path, pattern or f"*.{kind}").select("path", "content").mapInPandas(run, CELL)


NAMES = [x.split()[0] for x in CELL.split(", ")]


def split_losses(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, losses (file, code, detail))"""
    return found.filter("type <> 'loss'"), found.filter("type = 'loss'").select("file", F.lit("unreadable").alias("code"), F.col("value").alias("detail"))


def write_books(grid: DataFrame, key: str, kind: str = "ods") -> DataFrame:
    """(key, content): a workbook for each key from cells (key, sheet, row, col, value)."""
    make = {"ods": ods_bytes, "xlsx": xlsx_bytes}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list[list]] = {}
        for name, g in pdf.groupby("sheet", sort=True):
            rows = [[None] * int(g["col"].max()) for _ in range(int(g["row"].max()))]
            for r, c, v in zip(g["row"], g["col"], g["value"], strict=True):
                rows[int(r) - 1][int(c) - 1] = number_or_text(v)
            sheets[str(name)] = rows
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [make(sheets)]})

    return grid.groupBy(key).applyInPandas(run, grid.select(key, F.lit(b"").alias("content")).schema)


def number_or_text(v: str | None):
    if v is not None and re.fullmatch(r"-?(?:0|[1-9]\d{0,14})(?:\.\d+)?", v):
        return float(v) if "." in v else int(v)
    return v


def grid_text(found: DataFrame) -> DataFrame:
    """(file, sheet, text): tab between cells, newline between rows."""
    from millrace.operators.grid import grid_rows, whole

    lines = grid_rows(found.select("file", "sheet", "row", "col", "value"), ["file", "sheet"]).select("file", "sheet", "row", F.array_join("values", "\t").alias("line"))
    return whole(lines, ["file", "sheet"], "text", "\n")


# Text documents and slides


def docx_text(data: bytes) -> str:
    """Paragraphs by newline, cells by tab; deleted and moved-away runs are left out."""
    return "\n".join(docx_block(x) for b in children(xml(parts_of(data)["word/document.xml"]), "body") for x in b if local(x.tag) in ("p", "tbl", "sdt"))


def docx_block(e: ET.Element) -> str:
    if local(e.tag) == "tbl":
        return "\n".join("\t".join(" ".join(docx_block(b) for b in c if local(b.tag) in ("p", "tbl")) for c in children(r, "tc")) for r in children(e, "tr"))
    if local(e.tag) == "sdt":
        return "\n".join(docx_block(b) for c in children(e, "sdtContent") for b in c if local(b.tag) in ("p", "tbl", "sdt"))
    return "".join(docx_runs(e))


def docx_runs(e: ET.Element) -> Iterator[str]:
    for x in e:
        name = local(x.tag)
        if name in ("del", "moveFrom", "pPr", "rPr"):
            continue
        if name == "t":
            yield x.text or ""
        elif name == "tab":
            yield "\t"
        elif name in ("br", "cr"):
            yield "\n"
        else:
            yield from docx_runs(x)


def odt_text(data: bytes) -> str:
    out: list[str] = []

    def go(e: ET.Element) -> None:
        for x in e:
            name = local(x.tag)
            if name in ("p", "h"):
                out.append(text_of(x))
            elif name == "table-row":
                out.append("\t".join(" ".join(text_of(p) for p in c.iter() if local(p.tag) in ("p", "h")) for c in children(x, "table-cell")))
            elif name not in ("tracked-changes", "annotation", "forms"):
                go(x)

    for b in xml(parts_of(data)["content.xml"]).iter():
        if local(b.tag) == "body":
            go(b)
    return "\n".join(out)


def pptx_slides(data: bytes) -> list[dict]:
    parts = parts_of(data)
    names = sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
    out = []
    for n in names:
        title, body = "", []
        for sp in (x for x in xml(parts[n]).iter() if local(x.tag) == "sp"):
            kind = next((attr(x, "type", "body") for x in sp.iter() if local(x.tag) == "ph"), "body")
            texts = ["".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in sp.iter() if local(p.tag) == "p"]
            if kind in ("title", "ctrTitle") and not title:
                title = " ".join(t for t in texts if t)
            else:
                body += [t for t in texts if t]
        out.append({"title": title, "body": body})
    return out


def odp_slides(data: bytes) -> list[dict]:
    out = []
    for page in (x for x in xml(parts_of(data)["content.xml"]).iter() if local(x.tag) == "page"):
        title, body = "", []
        for frame in children(page, "frame", "custom-shape"):
            texts = [text_of(p) for p in frame.iter() if local(p.tag) == "p"]
            if attr(frame, "class") == "title" and not title:
                title = " ".join(t for t in texts if t)
            else:
                body += [t for t in texts if t]
        out.append({"title": title, "body": body})
    return out


def slides_text(slides: list[dict]) -> str:
    return "\n\n".join("\n".join(x for x in [s["title"], *s["body"]] if x) for s in slides)


TEXTS = {"docx": docx_text, "odt": odt_text, "pptx": lambda d: slides_text(pptx_slides(d)), "odp": lambda d: slides_text(odp_slides(d)), "text": lambda d: d.decode("utf-8", "replace"), "md": lambda d: d.decode("utf-8", "replace")}

# Detection

#: The family of each format.
FAMILY = {"pdf": "portable", "docx": "document", "odt": "document", "xlsx": "sheet", "ods": "sheet", "pptx": "slides", "odp": "slides", "md": "text", "text": "text", "legacy-doc": "legacy", "legacy-xls": "legacy", "legacy-ppt": "legacy", "legacy": "legacy", "encrypted": "encrypted", "unknown": "unknown"}
LEGACY = {"doc": "legacy-doc", "dot": "legacy-doc", "xls": "legacy-xls", "xlt": "legacy-xls", "ppt": "legacy-ppt", "pps": "legacy-ppt", "pot": "legacy-ppt"}
MARKDOWN = ("md", "markdown", "mdown", "mkd")
PLAIN = ("txt", "text", "csv", "tsv", "log", "ini", "cfg", "conf", "json", "xml", "yaml", "yml")


def detect_format(data: bytes, name: str = "") -> str:
    """By magic bytes, then by a package's parts, then by extension, then by whether the bytes are text."""
    ext = name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2][1:] else ""
    if b"%PDF-" in data[:1024]:
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                mime = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
        except (zipfile.BadZipFile, KeyError):
            return "unknown"
        for part, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(n.startswith(part) for n in names):
                return kind
        base = mime.removeprefix("application/vnd.oasis.opendocument.").removesuffix("-template")
        return {"text": "odt", "spreadsheet": "ods", "presentation": "odp"}.get(base, "unknown")
    if data[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        return "encrypted" if "EncryptionInfo".encode("utf-16-le") in data else LEGACY.get(ext, "legacy")
    if ext in MARKDOWN:
        return "md"
    if ext in PLAIN:
        return "text"
    head = data[:65536]
    if b"\0" in head:
        return "unknown"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return "unknown"
    return "text" if data else "unknown"


def detect(content: Column | str, name: Column | str) -> Column:
    """struct<format, family>"""
    kind = T.StructType([T.StructField("format", T.StringType()), T.StructField("family", T.StringType())])

    @F.pandas_udf(kind)
    def run(c: pd.Series, n: pd.Series) -> pd.DataFrame:
        formats = [detect_format(bytes(x or b""), y or "") for x, y in zip(c, n, strict=True)]
        return pd.DataFrame({"format": formats, "family": [FAMILY[f] for f in formats]})

    return run(col(content), col(name))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, loss) of all files below a path that have text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, data in zip(b["path"], b["content"], strict=True):
                data = bytes(data)
                kind = detect_format(data, file)
                try:
                    rows.append((file, kind, TEXTS[kind](data) if kind in TEXTS else None, None if kind in TEXTS else f"no text reader for {kind}"))
                except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows.append((file, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "loss"])

    return files(spark, path).select("path", "content").mapInPandas(run, "path string, format string, text string, loss string")


def slide_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, slide, n, kind, text): the title and the body lines of each slide of pptx and odp files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, data in zip(b["path"], b["content"], strict=True):
                data = bytes(data)
                read = {"pptx": pptx_slides, "odp": odp_slides}.get(detect_format(data, file))
                for k, s in enumerate(read(data) if read else [], 1):
                    lines = ([("title", s["title"])] if s["title"] else []) + [("paragraph", t) for t in s["body"]]
                    rows += [(file, k, n, kind, t) for n, (kind, t) in enumerate(lines, 1)]
            yield pd.DataFrame(rows, columns=["path", "slide", "n", "kind", "text"])

    return files(spark, path).select("path", "content").mapInPandas(run, "path string, slide int, n int, kind string, text string")


# XML


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_xml(df: DataFrame, path: str, root_tag: str, row_tag: str, mode: str = "errorifexists") -> None:
    df.write.format("xml").mode(mode).option("rootTag", root_tag).option("rowTag", row_tag).save(path)


def xml_text(c: Column | str, path: str) -> Column:
    return F.xpath_string(col(c), F.lit(path))


def xml_all(c: Column | str, path: str) -> Column:
    return F.xpath(col(c), F.lit(path))
