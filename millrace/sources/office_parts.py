"""Metadata of spreadsheets as rows: structured tables, conditional formats, comments, pivots, filters.

What the files state is read, not evaluated; `operators.validate` and `operators.stats` compile the
rules to columns.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.office import attr, children, files, local, parts_of, string_of, text_of, xml

PART = "file string, part string, kind string, name string, ref string, detail string"


def bare_attributes(e: ET.Element) -> dict[str, str]:
    return {local(k): v for k, v in e.attrib.items()}


def first(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e.iter() if local(x.tag) == name), None)


def table_part(root: ET.Element) -> Iterator[tuple]:
    """(kind, name, ref, detail) of a structured table: columns, totals and autofilter."""
    columns = [bare_attributes(c) for c in root.iter() if local(c.tag) == "tableColumn"]
    filtered = first(root, "autoFilter")
    detail = {
        "columns": [c.get("name") for c in columns], "totals": {c["name"]: c["totalsRowFunction"] for c in columns if "totalsRowFunction" in c},
        "autoFilter": None if filtered is None else {"ref": attr(filtered, "ref"), "columns": [{"colId": attr(f, "colId"), "criteria": [{local(x.tag): bare_attributes(x)} for x in f.iter() if x is not f]} for f in children(filtered, "filterColumn")]},
    }
    yield "table", attr(root, "displayName") or attr(root, "name"), attr(root, "ref"), detail


def sheet_part(root: ET.Element) -> Iterator[tuple]:
    """Conditional formats, merged ranges and the sheet's own autofilter."""
    for c in (x for x in root.iter() if local(x.tag) == "conditionalFormatting"):
        for r in children(c, "cfRule"):
            yield "conditionalFormat", attr(r, "type"), attr(c, "sqref"), bare_attributes(r) | {"formulas": [f.text or "" for f in children(r, "formula")]}
    for m in (x for x in root.iter() if local(x.tag) == "mergeCell"):
        yield "merge", None, attr(m, "ref"), {}
    for f in children(root, "autoFilter"):
        yield "autoFilter", None, attr(f, "ref"), {}


def comment_part(root: ET.Element) -> Iterator[tuple]:
    authors = [a.text or "" for x in root.iter() if local(x.tag) == "authors" for a in x]
    for c in (x for x in root.iter() if local(x.tag) == "comment"):
        who = int(attr(c, "authorId", "-1"))
        yield "comment", authors[who] if 0 <= who < len(authors) else None, attr(c, "ref"), {"text": "".join(string_of(t) for t in children(c, "text"))}


def pivot_part(root: ET.Element) -> Iterator[tuple]:
    """A pivot cache: where its data come from, its fields and their shared items."""
    source = first(root, "worksheetSource")
    fields = [{"name": attr(f, "name"), "items": [attr(i, "v") for s in children(f, "sharedItems") for i in s]} for f in root.iter() if local(f.tag) == "cacheField"]
    yield "pivotCache", attr(source, "sheet") if source is not None else None, attr(source, "ref") if source is not None else None, {"fields": fields}


def ods_part(root: ET.Element) -> Iterator[tuple]:
    """Database ranges with filters, sorts and subtotals; data pilots; annotations."""
    for r in (x for x in root.iter() if local(x.tag) == "database-range"):
        inner = [{local(x.tag): bare_attributes(x)} for x in r.iter() if local(x.tag) in ("filter-condition", "filter-set-item", "filter-and", "filter-or", "sort-by", "subtotal-rule", "subtotal-field", "database-source-sql")]
        yield "databaseRange", attr(r, "name"), attr(r, "target-range-address"), {"rules": inner}
    for p in (x for x in root.iter() if local(x.tag) == "data-pilot-table"):
        yield "dataPilot", attr(p, "name"), attr(p, "target-range-address"), {"fields": [bare_attributes(f) for f in p.iter() if local(f.tag) == "data-pilot-field"]}
    for a in (x for x in root.iter() if local(x.tag) == "annotation"):
        yield "comment", next((x.text for x in a if local(x.tag) == "creator"), None), None, {"text": "\n".join(text_of(p) for p in children(a, "p"))}


READERS = {"table": table_part, "worksheet": sheet_part, "comments": comment_part, "pivotCacheDefinition": pivot_part, "document-content": ods_part}


def rows_of(data: bytes) -> list[tuple]:
    out = []
    for name, content in sorted(parts_of(data).items()):
        if name.endswith(".xml"):
            root = xml(content)
            read = READERS.get(local(root.tag))
            out += [(name, kind, title, ref, json.dumps(detail, ensure_ascii=False)) for kind, title, ref, detail in (read(root) if read else ())]
    return out


def metadata(spark: SparkSession, path: str, pattern: str = "*.{xlsx,ods}") -> DataFrame:
    """PART rows of all spreadsheets below a path; unreadable files give one row of kind `loss`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(file, *r) for r in rows_of(bytes(data))]
                except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows.append((file, None, "loss", None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")])

    return files(spark, path, pattern).select("path", "content").mapInPandas(run, PART)
