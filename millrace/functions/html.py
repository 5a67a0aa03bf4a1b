"""HTML: sanitising against an allow-list, safe URLs, text and links."""

from __future__ import annotations

import html
import re
from collections.abc import Collection
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.text import per_value

# What the sanitiser lets through.
TAGS = frozenset(
    "a abbr b blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp section small span strong sub summary sup table tbody td tfoot th thead tr u ul var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style iframe object embed noscript noembed noframes xmp plaintext textarea svg math template link meta head frame frameset".split())
ATTRIBUTES = {
    "*": "class id title dir lang tabindex", "a": "href name target rel", "img": "src alt width height loading", "td": "colspan rowspan align valign", "th": "colspan rowspan align valign scope",
    "col": "span", "colgroup": "span", "ol": "start type reversed", "li": "value", "q": "cite", "blockquote": "cite", "del": "cite datetime", "ins": "cite datetime", "details": "open",
}
URL_ATTRIBUTES = frozenset("href src cite action formaction srcset data".split())
SCHEMES = ("http", "https", "mailto", "tel", "ftp")
IMAGE_DATA = re.compile(r"(?i)^data:image/(?:png|jpe?g|gif|webp|avif|bmp);")


def safe_url(url: str, schemes: Collection[str] = SCHEMES, image_data: bool = False) -> bool:
    """A relative URL or one with an allowed scheme; white space and control characters don't hide a scheme."""
    bare = re.sub(r"[\x00-\x20\x7f-\x9f]+", "", html.unescape(url))
    if image_data and IMAGE_DATA.match(bare):
        return True
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", bare)
    return not m and not re.match(r"^[^/?#]*:", bare) if not m else m[1].lower() in schemes


class Cleaner(HTMLParser):
    """Writes the allowed tags and attributes; dangerous elements go with their content, others leave their text."""

    def __init__(self, tags: Collection[str], schemes: Collection[str], image_data: bool):
        super().__init__(convert_charrefs=False)
        self.tags, self.schemes, self.image_data = tags, schemes, image_data
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.inside:
            if tag == self.inside[-1]:
                self.inside.append(tag)
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.inside.append(tag)
                # its content is markup for this reader, whatever HTML says of it
                self.clear_cdata_mode()
            return
        if tag in self.tags:
            self.out.append(f"<{tag}{self.attributes(tag, attrs)}{' /' if tag in VOID else ''}>")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.inside and tag in self.tags and tag not in DROPPED:
            self.out.append(f"<{tag}{self.attributes(tag, attrs)} />")

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag == self.inside[-1]:
                self.inside.pop()
        elif tag in self.tags and tag not in VOID:
            self.out.append(f"</{tag}>")

    def attributes(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        allowed = f"{ATTRIBUTES['*']} {ATTRIBUTES.get(tag, '')}".split()
        kept: dict[str, str | None] = {}
        for name, value in attrs:
            image = self.image_data and (tag, name) == ("img", "src")
            if name in allowed and name not in kept and not (name in URL_ATTRIBUTES and not safe_url(value or "", self.schemes, image)):
                kept[name] = value
        if tag == "a" and kept.get("target") == "_blank" and re.match(r"(?i)^(?:https?:)?//", kept.get("href") or ""):
            kept["rel"] = " ".join(dict.fromkeys([*(kept.get("rel") or "").split(), "noopener", "noreferrer"]))
        return "".join(f" {n}" if v is None else f' {n}="{html.escape(v)}"' for n, v in kept.items())

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def sanitized(text: str, tags: Collection[str] = TAGS, schemes: Collection[str] = SCHEMES, image_data: bool = False) -> str:
    c = Cleaner(tags, schemes, image_data)
    c.feed(text.replace("\0", ""))
    c.close()
    return "".join(c.out)


def sanitize_html(s: Column | str, **options) -> Column:
    return per_value(lambda v: sanitized(v, **options), T.StringType())(col(s))


def is_safe_url(s: Column | str, schemes: Collection[str] = SCHEMES) -> Column:
    """The same rule as an expression, for values without character references."""
    bare = F.regexp_replace(col(s), r"[\x00-\x20\x7f-\x9f]+", "")
    return bare.rlike(rf"(?i)^(?:{'|'.join(schemes)}):") | ~bare.rlike(r"^[^/?#]*:")


class Reader(HTMLParser):
    BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.skip: list[str] = []
        self.where = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.skip.append(tag)
        self.where = tag if tag == "title" else self.where
        if tag in self.BLOCKS:
            self.parts.append("\n")
        if tag == "a":
            self.links.append((dict(attrs).get("href") or "", ""))

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        self.where = "" if tag == "title" else self.where
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.where == "title":
            self.title.append(data)
            return
        self.parts.append(data)
        if self.links and self.lasttag == "a":
            self.links[-1] = (self.links[-1][0], self.links[-1][1] + data)


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))])


def read_page(text: str) -> dict:
    r = Reader()
    r.feed(text)
    r.close()
    lines = (" ".join(x.split()) for x in "".join(r.parts).split("\n"))
    return {"title": " ".join("".join(r.title).split()), "text": "\n".join(x for x in lines if x), "links": [{"href": h, "text": " ".join(t.split())} for h, t in r.links]}


def page(s: Column | str) -> Column:
    """struct<title, text, links> of an HTML document."""

    @F.udf(PAGE, useArrow=True)
    def run(v):
        return None if v is None else read_page(v)

    return run(col(s))
