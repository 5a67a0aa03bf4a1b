"""Markdown as block rows and as HTML: CommonMark's common constructs, GFM tables, tasks and strikethrough.

`blocks` gives (path, kind, level, info, text, tight); `render` HTML; `canonical` Markdown again. A
subset: nested lists and quotes, fenced and indented code, headings of both kinds, tables, HTML
blocks, reference links, emphasis by run length. Limits: DEPTH of nesting, NODES of blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.text import per_value

DEPTH, NODES, URL = 1000, 100_000, 8192
FENCES = {"---": "yaml", "+++": "toml", ";;;": "json"}

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?! )|( ?)(?=$)|( )(?= {4,}))")
UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
MARKUP = re.compile(r"^ {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[ \t/>]|$))")
DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Node:
    kind: str
    text: str = ""
    level: int = 0
    info: str = ""
    tight: bool = True
    children: list[Node] = field(default_factory=list)


def label_of(s: str) -> str:
    return " ".join(s.split()).casefold()


class Parser:
    def __init__(self):
        self.refs: dict[str, tuple[str, str]] = {}
        self.count = 0

    def node(self, *args, **more) -> Node:
        self.count += 1
        if self.count > NODES:
            raise ValueError(f"more than {NODES} blocks")
        return Node(*args, **more)

    def blocks(self, lines: list[str], depth: int = 0) -> list[Node]:
        if depth > DEPTH:
            raise ValueError(f"nested deeper than {DEPTH}")
        out: list[Node] = []
        k = 0
        while k < len(lines):
            line = lines[k]
            if not line.strip():
                k += 1
            elif re.match(r"^(?: {4}|\t)", line):
                k = self.indented(lines, k, out)
            elif m := FENCE.match(line):
                k = self.fenced(lines, k, m, out)
            elif m := HEADING.match(line):
                out.append(self.node("heading", (m[2] or "").strip(), len(m[1])))
                k += 1
            elif RULE.match(line):
                out.append(self.node("rule"))
                k += 1
            elif QUOTE.match(line):
                k = self.quote(lines, k, depth, out)
            elif ITEM.match(line):
                k = self.items(lines, k, depth, out)
            elif MARKUP.match(line):
                end = k
                while end < len(lines) and lines[end].strip():
                    end += 1
                out.append(self.node("html", "\n".join(lines[k:end])))
                k = end
            elif m := DEFINITION.match(line):
                self.refs.setdefault(label_of(m[1]), (m[2].strip("<>"), (m[3] or "")[1:-1]))
                k += 1
            elif k + 1 < len(lines) and "|" in line and DELIMITER.match(lines[k + 1]) and len(cells(line)) == len(cells(lines[k + 1])):
                k = self.table(lines, k, out)
            else:
                k = self.paragraph(lines, k, out)
        return out

    def indented(self, lines, k, out) -> int:
        body = []
        while k < len(lines) and (re.match(r"^(?: {4}|\t)", lines[k]) or not lines[k].strip()):
            body.append(re.sub(r"^(?: {4}|\t)", "", lines[k]))
            k += 1
        while body and not body[-1].strip():
            body.pop()
        out.append(self.node("code", "\n".join(body) + "\n"))
        return k

    def fenced(self, lines, k, m, out) -> int:
        close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        body, k = [], k + 1
        while k < len(lines) and not close.match(lines[k]):
            body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[k]))
            k += 1
        out.append(self.node("code", "".join(x + "\n" for x in body), info=m[3]))
        return k + 1

    def quote(self, lines, k, depth, out) -> int:
        body = []
        while k < len(lines) and (QUOTE.match(lines[k]) or (lines[k].strip() and body and body[-1].strip() and not starts_block(lines[k]))):
            body.append(QUOTE.sub("", lines[k], count=1))
            k += 1
        out.append(self.node("quote", children=self.blocks(body, depth + 1)))
        return k

    def items(self, lines, k, depth, out) -> int:
        first = ITEM.match(lines[k])[2]
        mark = first[-1]
        listed = self.node("list", info="ordered" if first[0].isdigit() else "bullet", level=int(first[:-1]) if first[0].isdigit() else 0)
        loose = False
        while k < len(lines) and (m := ITEM.match(lines[k])) and m[2][-1] == mark and not RULE.match(lines[k]):
            inset = len(m[1]) + len(m[2]) + len(m[3] or " ")
            body = [lines[k][m.end() :]]
            k += 1
            while k < len(lines):
                if not lines[k].strip():
                    body.append("")
                elif len(lines[k]) - len(lines[k].lstrip(" ")) >= inset:
                    body.append(lines[k][inset:])
                elif body[-1].strip() and not starts_block(lines[k]):
                    body.append(lines[k].lstrip())
                else:
                    break
                k += 1
            blank = 0
            while body and not body[-1].strip():
                body.pop()
                blank += 1
            more = k < len(lines) and ITEM.match(lines[k]) is not None and ITEM.match(lines[k])[2][-1] == mark
            item = self.node("item")
            if body and (t := re.match(r"^\[([ xX])\][ \t]+", body[0])):
                item.info, body[0] = "done" if t[1] != " " else "open", body[0][t.end() :]
            item.children = self.blocks(body, depth + 2)
            loose = loose or (blank and more) or any(not x.strip() for x in between_blocks(body))
            listed.children.append(item)
        listed.tight = not loose
        out.append(listed)
        return k

    def table(self, lines, k, out) -> int:
        aligns = ["center" if c.startswith(":") and c.endswith(":") else "left" if c.startswith(":") else "right" if c.endswith(":") else "" for c in cells(lines[k + 1])]
        t = self.node("table", info=",".join(aligns))
        rows, k = [lines[k]], k + 2
        while k < len(lines) and lines[k].strip() and not starts_block(lines[k]):
            rows.append(lines[k])
            k += 1
        for n, r in enumerate(rows):
            row = self.node("row", info="head" if n == 0 else "body")
            row.children = [self.node("cell", c, info=a) for c, a in zip((cells(r) + [""] * len(aligns))[: len(aligns)], aligns, strict=True)]
            t.children.append(row)
        out.append(t)
        return k

    def paragraph(self, lines, k, out) -> int:
        keep = lambda x: x.lstrip() if x.endswith("  ") else x.strip()
        body = [keep(lines[k])]
        k += 1
        while k < len(lines) and lines[k].strip():
            if m := UNDER.match(lines[k]):
                out.append(self.node("heading", "\n".join(body), 1 if m[1][0] == "=" else 2))
                return k + 1
            if starts_block(lines[k], in_paragraph=True):
                break
            body.append(keep(lines[k]))
            k += 1
        out.append(self.node("paragraph", "\n".join(body).rstrip()))
        return k


def between_blocks(body: list[str]) -> list[str]:
    """The lines of an item outside fenced code."""
    out, fence = [], ""
    for x in body:
        if (m := FENCE.match(x)) and not fence:
            fence = m[2]
        elif fence and x.strip().startswith(fence):
            fence = ""
        elif not fence:
            out.append(x)
    return out


def starts_block(line: str, in_paragraph: bool = False) -> bool:
    m = ITEM.match(line)
    item = m and not (in_paragraph and (not line[m.end() :].strip() or (m[2][0].isdigit() and m[2][:-1] != "1")))
    return bool(HEADING.match(line) or RULE.match(line) or FENCE.match(line) or QUOTE.match(line) or item or (MARKUP.match(line) and not in_paragraph))


def cells(line: str) -> list[str]:
    """The cells of a table row; an escaped bar is text."""
    body = line.strip().removeprefix("|")
    parts = re.split(r"(?<!\\)\|", body)
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.replace("\\|", "|").strip() for p in parts]


def parse(text: str) -> tuple[list[Node], dict[str, tuple[str, str]]]:
    p = Parser()
    nodes = p.blocks(text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�").expandtabs(4).split("\n"))
    return nodes, p.refs


# Inlines

ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>")
TAG = re.compile(r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z]+\s[^>]*)>", re.S)
TARGET = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")


def unescaped(s: str) -> str:
    return html.unescape(re.sub(rf"\\([{re.escape(ESCAPABLE)}])", r"\1", s))


def closing(text: str, at: int) -> int:
    """The bracket that closes the one at a place; -1 for none."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif c == "`" and (m := re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S).match(text, k)):
            k = m.end() - 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def href(url: str) -> str:
    if len(url) > URL:
        raise ValueError(f"a URL is longer than {URL}")
    from urllib.parse import quote

    return html.escape(quote(unescaped(url), safe="%/:=&?~#+!$,;'@()*[]_-."))


def inline(text: str, refs: dict[str, tuple[str, str]], depth: int = 0, links: bool = True) -> str:
    """HTML of inline text."""
    if depth > DEPTH:
        raise ValueError(f"nested deeper than {DEPTH}")
    out: list = []
    k = 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            if text[k + 1] == "\n":
                out.append("<br />\n")
            else:
                out.append(html.escape(text[k + 1], quote=True).replace("&#x27;", "'") if text[k + 1] in ESCAPABLE else "\\" + html.escape(text[k + 1]))
            k += 2
        elif c == "`" and (m := re.compile(r"(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S).match(text, k)):
            body = m[2].replace("\n", " ")
            body = body[1:-1] if body.strip() and body[0] == body[-1] == " " else body
            out.append(f"<code>{escaped(body)}</code>")
            k = m.end()
        elif c == "`":
            n = len(re.compile("`+").match(text, k)[0])
            out.append("`" * n)
            k += n
        elif c == "<" and (m := AUTOLINK.match(text, k)):
            mail = "mailto:" if ":" not in m[1] else ""
            out.append(f'<a href="{mail}{href(m[1])}">{escaped(m[1])}</a>')
            k = m.end()
        elif c == "<" and (m := TAG.match(text, k)):
            out.append(m[0])
            k = m.end()
        elif c in "![" and (found := bracketed(text, k, refs, depth, links)):
            out.append(found[0])
            k = found[1]
        elif c == "&" and (m := re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);").match(text, k)) and (html.unescape(m[0]) != m[0]):
            out.append(escaped(html.unescape(m[0])))
            k = m.end()
        elif c in "*_~":
            n = len(re.compile(re.escape(c) + "+").match(text, k)[0])
            before, after = text[k - 1] if k else " ", text[k + n] if k + n < len(text) else " "
            out.append(Run(c, n, *flanks(c, before, after)))
            k += n
        elif c == "\n":
            hard = bool(out) and isinstance(out[-1], str) and out[-1].endswith("  ")
            if out and isinstance(out[-1], str):
                out[-1] = out[-1].rstrip(" ")
            out.append("<br />\n" if hard else "\n")
            k += 1
        else:
            m = re.compile(r"[^\\`<!\[&*_~\n]+").match(text, k)
            out.append(escaped(m[0] if m else c))
            k = m.end() if m else k + 1
    return emphasised(out)


def escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def bracketed(text: str, k: int, refs, depth: int, links: bool) -> tuple[str, int] | None:
    """A link or an image at a place, and where it ends."""
    image = text[k] == "!"
    at = k + image
    if at >= len(text) or text[at] != "[" or (not image and not links) or (end := closing(text, at)) < 0:
        return None
    label, stop, target = text[at + 1 : end], end + 1, None
    if m := TARGET.match(text, end + 1):
        target, stop = (m[1].strip("<>") if m[1].startswith("<") else m[1], (m[2] or "")[1:-1]), m.end()
    elif text[end + 1 : end + 2] == "[" and (close := closing(text, end + 1)) > 0:
        name = text[end + 2 : close] or label
        target, stop = refs.get(label_of(name)), close + 1
    if target is None:
        target, stop = refs.get(label_of(label)), end + 1 + 2 * (text[end + 1 : end + 3] == "[]")
    if target is None:
        return None
    title = f' title="{escaped(unescaped(target[1]))}"' if target[1] else ""
    if image:
        alt = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r'<img [^>]*alt="([^"]*)"[^>]*>', r"\1", inline(label, refs, depth + 1))))
        return f'<img src="{href(target[0])}" alt="{escaped(alt)}"{title} />', stop
    return f'<a href="{href(target[0])}"{title}>{inline(label, refs, depth + 1, False)}</a>', stop


@dataclass
class Run:
    char: str
    n: int
    opens: bool
    closes: bool


def flanks(c: str, before: str, after: str) -> tuple[bool, bool]:
    mark = lambda x: unicodedata.category(x)[0] in "PS"
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    return (left, right) if c != "_" else (left and (not right or mark(before)), right and (not left or mark(after)))


def emphasised(parts: list) -> str:
    """Pairs the runs of * _ ~ from the inside out."""
    k = 0
    while k < len(parts):
        close = parts[k]
        if not (isinstance(close, Run) and close.closes and close.n):
            k += 1
            continue
        j = k - 1
        while j >= 0:
            o = parts[j]
            if isinstance(o, Run) and o.char == close.char and o.opens and o.n:
                odd = close.char != "~" and (o.closes or close.opens) and (o.n + close.n) % 3 == 0 and (o.n % 3 or close.n % 3)
                if not odd and not (close.char == "~" and (o.n != close.n or o.n > 2)):
                    break
            j -= 1
        if j < 0:
            k += 1
            continue
        o = parts[j]
        n = o.n if close.char == "~" else 2 if o.n > 1 and close.n > 1 else 1
        tag = "del" if close.char == "~" else "strong" if n == 2 else "em"
        inner = "".join(x.char * x.n if isinstance(x, Run) else x for x in parts[j + 1 : k])
        o.n -= n
        close.n -= n
        parts[j + 1 : k] = [f"<{tag}>{inner}</{tag}>"]
        k = j + 2
    return "".join(x.char * x.n if isinstance(x, Run) else x for x in parts)


# Output


def html_of(nodes: list[Node], refs, tight: bool = False) -> str:
    out: list[str] = []
    for n in nodes:
        if n.kind == "heading":
            out.append(f"<h{n.level}>{inline(n.text, refs)}</h{n.level}>\n")
        elif n.kind == "paragraph":
            out.append(inline(n.text, refs) + "\n" if tight else f"<p>{inline(n.text, refs)}</p>\n")
        elif n.kind == "rule":
            out.append("<hr />\n")
        elif n.kind == "code":
            info = f' class="language-{escaped(unescaped(n.info.split()[0]))}"' if n.info else ""
            out.append(f"<pre><code{info}>{escaped(n.text)}</code></pre>\n")
        elif n.kind == "html":
            out.append(n.text + "\n")
        elif n.kind == "quote":
            out.append(f"<blockquote>\n{html_of(n.children, refs)}</blockquote>\n")
        elif n.kind == "list":
            tag = "ol" if n.info == "ordered" else "ul"
            start = f' start="{n.level}"' if tag == "ol" and n.level != 1 else ""
            out.append(f"<{tag}{start}>\n{''.join(item_html(i, refs, n.tight) for i in n.children)}</{tag}>\n")
        elif n.kind == "table":
            rows = [f"<tr>\n{''.join(cell_html(c, r.info, refs) for c in r.children)}</tr>\n" for r in n.children]
            body = f"<tbody>\n{''.join(rows[1:])}</tbody>\n" if rows[1:] else ""
            out.append(f"<table>\n<thead>\n{rows[0]}</thead>\n{body}</table>\n")
    return "".join(out)


def item_html(n: Node, refs, tight: bool) -> str:
    box = {"done": '<input checked="" disabled="" type="checkbox"> ', "open": '<input disabled="" type="checkbox"> '}.get(n.info, "")
    body = html_of(n.children, refs, tight)
    if tight:
        lead = "\n" if n.children and n.children[0].kind != "paragraph" else ""
        return f"<li>{box}{lead}{body if len(n.children) > 1 or lead else body.rstrip(chr(10))}</li>\n"
    return f"<li>{box}\n{body}</li>\n" if n.children else "<li></li>\n"


def cell_html(n: Node, part: str, refs) -> str:
    tag = "th" if part == "head" else "td"
    align = f' align="{n.info}"' if n.info else ""
    return f"<{tag}{align}>{inline(n.text, refs)}</{tag}>\n"


def render(text: str) -> str:
    nodes, refs = parse(text)
    return html_of(nodes, refs)


def canonical(text: str) -> str:
    """The same document in one way of writing it."""
    nodes, refs = parse(text)
    body = markdown_of(nodes)
    tail = "".join(f'[{k}]: <{u}>{f" {chr(34)}{t}{chr(34)}" if t else ""}\n' for k, (u, t) in refs.items())
    return body + ("\n" if body and tail else "") + tail


def markdown_of(nodes: list[Node], tight: bool = False) -> str:
    out = []
    for n in nodes:
        if n.kind == "heading":
            out.append(f"{'#' * n.level} {' '.join(n.text.split())}".rstrip() + "\n")
        elif n.kind == "rule":
            out.append("---\n")
        elif n.kind == "code":
            ticks = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", n.text)), default=0))
            out.append(f"{ticks}{n.info}\n{n.text}{ticks}\n")
        elif n.kind == "quote":
            out.append("".join(f"> {x}".rstrip() + "\n" for x in markdown_of(n.children).rstrip("\n").split("\n")))
        elif n.kind == "list":
            parts = []
            for k, i in enumerate(n.children):
                mark = f"{n.level + k}. " if n.info == "ordered" else "- "
                box = {"done": "[x] ", "open": "[ ] "}.get(i.info, "")
                body = (box + markdown_of(i.children, n.tight)).rstrip("\n").split("\n")
                parts.append("\n".join([mark + body[0], *(" " * len(mark) + x if x else "" for x in body[1:])]) + "\n")
            out.append(("" if n.tight else "\n").join(parts))
        elif n.kind == "table":
            line = lambda cs: "| " + " | ".join(c.replace("|", "\\|") for c in cs) + " |\n"
            rule = [{"left": ":--", "right": "--:", "center": ":-:"}.get(a, "---") for a in n.info.split(",")]
            out.append(line([c.text for c in n.children[0].children]) + line(rule) + "".join(line([c.text for c in r.children]) for r in n.children[1:]))
        else:
            out.append(n.text + "\n")
    return ("" if tight else "\n").join(out)


# Columns

BLOCK = T.StructType([T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("info", T.StringType()), T.StructField("text", T.StringType())])
KINDS = frozenset("heading paragraph rule code html quote list item table row cell".split())


def rows_of(nodes: list[Node], path: tuple[int, ...] = ()) -> list[dict]:
    out = []
    for k, n in enumerate(nodes, 1):
        out.append({"path": [*path, k], "kind": n.kind, "level": n.level, "info": n.info, "text": n.text})
        out += rows_of(n.children, (*path, k))
    return out


def blocks_column(s: Column | str) -> Column:
    @F.udf(T.ArrayType(BLOCK), useArrow=True)
    def run(v):
        return None if v is None else rows_of(parse(v)[0])

    return run(col(s))


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, level, info, text): a row for each block, parents before children."""
    return df.select(key, F.inline(blocks_column(text)))


def render_html(s: Column | str) -> Column:
    return per_value(render, T.StringType())(col(s))


def render_markdown(s: Column | str) -> Column:
    return per_value(canonical, T.StringType())(col(s))


def frontmatter(s: Column | str) -> Column:
    """struct<lang, content, rest>: fenced by ---, +++ or ;;; at the very start; lang and content null without one."""
    c = F.regexp_replace(col(s), "^﻿", "")
    pattern = r"(?s)^(---|\+\+\+|;;;)[ \t]*\r?\n(?:(.*?)\r?\n)?\1[ \t]*(?:\r?\n|$)(.*)$"
    fence = F.regexp_extract(c, pattern, 1)
    lang = F.when(fence == "---", "yaml").when(fence == "+++", "toml").when(fence == ";;;", "json")
    return F.struct(lang.alias("lang"), F.when(fence != "", F.regexp_extract(c, pattern, 2)).alias("content"), F.when(fence != "", F.regexp_extract(c, pattern, 3)).otherwise(col(s)).alias("rest"))


def slug_of(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-") or "section"


def headings(block_rows: DataFrame, key: str) -> DataFrame:
    """(key, path, level, text, slug, anchor): anchors count repeats of a slug within a document: slug, slug-1, slug-2. Headings in table cells aren't headings."""
    h = block_rows.filter("kind = 'heading'").select(key, "path", "level", "text", per_value(slug_of, T.StringType())(F.col("text")).alias("slug"))
    n = F.row_number().over(W.partitionBy(key, "slug").orderBy("path")) - 1
    return h.withColumn("anchor", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))))


def toc(block_rows: DataFrame, key: str, low: int = 1, high: int = 6) -> DataFrame:
    """(key, toc): a nested Markdown list of the headings."""
    h = headings(block_rows, key).filter(F.col("level").between(low, high))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - low), F.lit("- ["), F.col("text"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    return h.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("_t")).select(key, F.array_join(F.transform("_t", lambda x: x["line"]), "\n").alias("toc"))


def losses(block_rows: DataFrame, key: str, kept: frozenset[str] = KINDS) -> DataFrame:
    """(key, code, detail): a ledger of blocks that a target has no form for."""
    return block_rows.filter(~F.col("kind").isin(*sorted(kept))).select(key, F.lit("unsupported-block").alias("code"), F.col("kind").alias("detail"))


# Extensions: passes over text outside code, by regular expressions

EXTENSIONS = {
    "highlight": (r"==([^=\n]+)==", "<mark>$1</mark>"),
    "superscript": (r"\^([^\s^]+)\^", "<sup>$1</sup>"),
    "subscript": (r"(?<!~)~([^\s~]+)~(?!~)", "<sub>$1</sub>"),
    "math_inline": (r"(?<![\\$])\$([^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])", '<span class="math">$1</span>'),
    "wikilinks": (r"\[\[([^\]|\n]+)(?:\|([^\]\n]+))?\]\]", "[$2]($1)"),
    "footnote_refs": (r"\[\^([^\]\s]+)\](?!:)", '<sup><a href="#fn-$1">$1</a></sup>'),
}
#: Short names of emoji.
EMOJI = {"smile": "😄", "heart": "❤️", "thumbsup": "👍", "+1": "👍", "thumbsdown": "👎", "-1": "👎", "tada": "🎉", "rocket": "🚀", "fire": "🔥", "warning": "⚠️", "bug": "🐛", "star": "⭐", "eyes": "👀", "check": "✔️", "x": "❌"}
ADMONITIONS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")


def extended(s: Column | str, names: list[str]) -> Column:
    """Text with the named extensions replaced. wikilinks without a title show their target."""
    c = col(s)
    for name in names:
        if name == "emoji":
            for short, sign in EMOJI.items():
                c = F.replace(c, F.lit(f":{short}:"), F.lit(sign))
            continue
        pattern, new = EXTENSIONS[name]
        c = F.regexp_replace(c, pattern, new)
        if name == "wikilinks":
            c = F.regexp_replace(c, r"\[\]\(([^)\n]+)\)", "[$1]($1)")
    return c


def admonitions(block_rows: DataFrame, key: str) -> DataFrame:
    """(key, path, type, text): quotes whose first paragraph begins with [!NOTE] and the like."""
    pattern = rf"(?is)^\[!({'|'.join(ADMONITIONS)})\]\s*(.*)$"
    inner = block_rows.filter((F.col("kind") == "paragraph") & (F.size("path") > 1) & F.col("text").rlike(pattern) & (F.element_at("path", -1) == 1))
    return inner.select(key, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.upper(F.regexp_extract("text", pattern, 1)).alias("type"), F.regexp_extract("text", pattern, 2).alias("text"))


def footnotes(s: Column | str) -> Column:
    """array<struct<label, text>> of footnote definitions."""
    found = F.regexp_extract_all(col(s), F.lit(r"(?m)^(\[\^[^\]\s]+\]:[^\n]*(?:\n {2,}[^\n]*)*)"), F.lit(1))
    return F.transform(found, lambda d: F.struct(F.regexp_extract(d, r"^\[\^([^\]\s]+)\]:", 1).alias("label"), F.regexp_replace(F.regexp_replace(d, r"^\[\^[^\]\s]+\]:\s*", ""), r"\n\s*", " ").alias("text")))


def mermaid(block_rows: DataFrame, key: str) -> DataFrame:
    return block_rows.filter("kind = 'code' and info = 'mermaid'").select(key, "path", F.col("text").alias("diagram"))


# Positioned text (pages of a fixed layout) to paragraphs


def paragraphs_of(pieces: pd.DataFrame, tolerance: float = 0.5, gap: float = 1.6, word_gap: float = 0.15) -> list[str]:
    """Pieces (text, x, y, x_end, font_size) of a page, y rising upward, to paragraphs: lines by baseline, words by gaps, paragraphs by line distance; a soft hyphen at a line's end joins."""
    lines: list[list] = []
    for p in pieces.sort_values(["y", "x"], ascending=[False, True]).itertuples():
        if lines and abs(lines[-1][0].y - p.y) <= tolerance * p.font_size:
            lines[-1].append(p)
        else:
            lines.append([p])
    out: list[str] = []
    last = None
    for line in lines:
        line.sort(key=lambda p: p.x)
        text = line[0].text
        for a, b in zip(line, line[1:], strict=False):
            apart = b.x - a.x_end > word_gap * b.font_size and not a.text.endswith(" ") and not b.text.startswith(" ")
            text += (" " if apart else "") + b.text
        same = last is not None and last.y - line[0].y <= gap * max(last.font_size, line[0].font_size) and abs(last.font_size - line[0].font_size) <= tolerance
        if same and out:
            out[-1] = out[-1].removesuffix("­") + text if out[-1].endswith("­") else f"{out[-1]} {text}"
        else:
            out.append(text)
        last = line[0]
    return out


def paragraph_groups(pieces: DataFrame, keys: list[str], **options) -> DataFrame:
    """(keys, n, text): the paragraphs of each page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = paragraphs_of(pdf, **options)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "n": range(1, len(found) + 1), "text": found})

    return pieces.groupBy(*keys).applyInPandas(run, pieces.select(*keys, F.lit(1).alias("n"), F.lit("").alias("text")).schema)


def line_breaks(s: Column | str, width: int) -> Column:
    """Greedy lines of at most `width` terminal columns; longer words stand alone."""
    from millrace.functions.text import width_of

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def run(v):
        if v is None:
            return None
        out, held = [], 0
        for w in v.split():
            n = width_of(w)
            if out and held + 1 + n <= width:
                out[-1] += " " + w
                held += 1 + n
            else:
                out.append(w)
                held = n
        return out

    return run(col(s))
