"""Operators, sources and streams on hand-written rows."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import grid, joins, ordered, stats, trees, validate
from millrace.sources import csv, feeds, markdown, office
from millrace.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Statistics


@pytest.mark.parametrize(("values", "geomean", "harmean"), [([1.0, 4.0], 2.0, 1.6), ([0.0, 4.0], 0.0, 0.0), ([2.0], 2.0, 2.0)])
def test_means(spark, values, geomean, harmean):
    r = spark.createDataFrame([(v,) for v in values], ["v"]).agg(stats.geomean("v"), stats.harmean("v")).first()
    assert r[0] == pytest.approx(geomean) and r[1] == pytest.approx(harmean)


def test_quantiles_and_nan(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], ["v"])
    assert d.agg(stats.quantile("v", 0.25)).first()[0] == 1.75 and d.agg(stats.median("v")).first()[0] == 2.5 and d.agg(stats.variance("v")).first()[0] == 1.25
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([(float("nan"),)], ["v"]).select(stats.checked("v")).collect()
    with pytest.raises(ValueError):
        stats.quantile("v", 1.5)


def test_histogram_last_bin_and_flat(spark):
    d = spark.createDataFrame([(float(v),) for v in range(11)], ["v"])
    assert rows(stats.histogram(d, "v", 5).select("bin", "n"), "bin") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    flat = spark.createDataFrame([(3.0,), (3.0,)], ["v"])
    assert rows(stats.histogram(flat, "v", 5).select("bin", "n")) == [(0, 2)]
    assert [r.z for r in stats.zscore(flat, "v", name="z").collect()] == [0, 0] and [r.n for r in stats.normalize(flat, "v", a=2.0, b=3.0, name="n").collect()] == [2, 2]


def test_mode_takes_the_first_of_equals(spark):
    d = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4)], ["v", "s"]).withColumn("g", F.lit(1))
    assert rows(stats.mode_first(d, ["g"], "v", "s")) == [(1, "b")]


# Ordered structures


def test_store(spark):
    log = spark.createDataFrame([("a", "1", "set", 1), ("b", "2", "set", 2), ("a", None, "del", 3), (None, None, "clear", 4), ("b:x", "3", "set", 5), ("b:y", "4", "set", 6), ("b:x", "5", "set", 7)], "key string, value string, op string, seq long")
    s = ordered.Store(log)
    assert rows(s.state(), "key") == [("b:x", "5"), ("b:y", "4")]
    assert rows(s.prefix("b:x")) == [("b:x", "5")] and s.count("b:x", "b:y").first().n == 1
    more = s.delete(spark.createDataFrame([("b:x", 8)], "key string, seq long")).set(spark.createDataFrame([("c", "9", 9)], "key string, value string, seq long"))
    assert rows(more.state(), "key") == [("b:y", "4"), ("c", "9")]


def test_ordered(spark):
    d = spark.createDataFrame([(k, str(k)) for k in range(5)], "k int, v string")
    assert [r.k for r in ordered.key_range(d, "k", 1, 3).orderBy("k").collect()] == [1, 2]
    assert rows(ordered.upsert(d, spark.createDataFrame([(4, "x"), (9, "y")], "k int, v string"), ["k"]).filter("k > 3"), "k") == [(4, "x"), (9, "y")]
    assert ordered.delete(d, d.filter("k < 4"), ["k"]).count() == 1
    assert rows(ordered.first_last(d, "k", "v")) == [(0, "0", 4, "4")]
    assert ordered.heap_bounded(d, 5).count() == 5
    with pytest.raises(Exception, match="more than 4"):
        ordered.heap_bounded(d, 4).collect()


def test_lookups(spark):
    styles = spark.createDataFrame([("a", None, "red", None), ("b", "a", None, 1), ("c", "b", None, None), ("x", "y", None, None), ("y", "x", None, 2)], "style_id string, based_on string, color string, size int")
    got = {r.style_id: (r.color, r.size) for r in joins.style_cascade(styles, ["color", "size"]).collect()}
    assert got["c"] == ("red", 1) and got["x"] == (None, 2)
    cells = spark.createDataFrame([("f", "s", "1"), ("f", "n", "7")], "file string, type string, value string")
    strings = spark.createDataFrame([("f", 0, "zero"), ("f", 1, "one")], "file string, index int, text string")
    assert sorted(r.value for r in joins.shared_strings(cells, strings).collect()) == ["7", "one"]
    links = spark.createDataFrame([(1, " Foo  BAR ")], "doc_id int, label string")
    defs = spark.createDataFrame([(1, "foo bar", 2, "/2", None), (1, "FOO bar", 1, "/1", "t")], "doc_id int, label string, seq int, url string, title string")
    assert joins.resolve_references(links, defs).first().url == "/1"


# Trees


def test_trees(spark):
    kind = "doc_id int, path array<int>, kind string, props map<string,string>, text string"
    t = spark.createDataFrame([(1, [1], "p", {}, "a"), (1, [2], "list", {}, None), (1, [2, 1], "item", {}, "b"), (1, [2, 2], "item", {}, "c")], kind)
    assert trees.text_content(t, "-").first().text == "a-b-c"
    assert trees.find_first(t, F.col("kind") == "item").first().text == "b"
    assert [r.path for r in trees.walk(trees.remove_nodes(t, F.col("kind") == "list")).collect()] == [[1]]
    wrapped = trees.walk(trees.wrap_nodes(t, F.col("kind") == "list", "box")).collect()
    assert [(r.path, r.kind) for r in wrapped] == [([1], "p"), ([2], "box"), ([2, 1], "list"), ([2, 1, 1], "item"), ([2, 1, 2], "item")]
    assert [r.path for r in t.filter(trees.under([2])).orderBy("path").collect()] == [[2, 1], [2, 2]]


# Validation


def test_schema(spark):
    d = spark.createDataFrame([(1, "a@b.c", 5.0, ["x"]), (2, "bad", 50.0, []), (3, None, None, ["x", "x"])], "id int, mail string, v double, tags array<string>")
    schema = {"properties": {"mail": {"format": "email"}, "v": {"anyOf": [{"maximum": 10}, {"minimum": 100}]}, "tags": {"minItems": 1, "uniqueItems": True, "items": {"maxLength": 3}}}, "required": ["mail"]}
    assert [r.valid for r in validate.test(d, schema).orderBy("id").collect()] == [True, False, False]
    found = {r.id: {e.path + ":" + e.keyword for e in r.errors} for r in validate.errors(d, schema).collect()}
    assert found == {1: set(), 2: {"$.mail:format", "$.v:anyOf", "$.tags:minItems"}, 3: {"$.mail:required", "$.tags:uniqueItems"}}


def test_filters(spark):
    d = spark.createDataFrame([("apple", 1.0), ("Banana", 2.0), ("cherry", 3.0), (None, 4.0)], "n string, v double")
    assert validate.autofilter(d, {"n": {"custom": [("equal", "*an*")]}}).count() == 1
    assert validate.autofilter(d, {"n": {"values": ["apple"], "blank": True}, "v": {"top10": 1}}).first().v == 4
    assert [r.v for r in d.filter(validate.filter_tree({"or": [{"field": "n", "operator": "begins", "value": "BA"}, {"field": "v", "operator": ">", "value": 3}]})).orderBy("v").collect()] == [2, 4]
    when = validate.conditional_format({"type": "timePeriod", "value": "lastMonth", "today": "2024-03-05"}, "d", [])
    assert spark.createDataFrame([(dt.date(2024, 2, 29),)], ["d"]).select(when).first()[0] is True


# Grids and CSV


def test_grid(spark):
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 3, 'q"x'), ("s", 5, 5, ""), ("s", 2, 1, "b\tc")], "sheet string, row int, col int, value string")
    assert grid.to_csv(cells, ["sheet"]).first().csv == 'a,,\r\nb\tc,,"q""x"'
    t = grid.to_tsv(cells, ["sheet"]).first()
    assert t.tsv == 'a\t\t\nb\\tc\t\tq"x' and t.escaped
    assert rows(grid.padded_size(cells, ["sheet"])) == [("s", 6)]
    assert [r.values for r in grid.unpadded_rows(cells, ["sheet"]).orderBy("row").collect()] == [["a"], ["b\tc", "", 'q"x']]
    assert spark.range(1).select(grid.cell_address(F.lit(7), F.lit(703)), grid.address_parts(F.lit("$AB$12"))["col"]).first()[:] == ("AAA7", 28)
    with pytest.raises(Exception, match="too many cells"):
        grid.normalized(cells, ["sheet"], 5).collect()


@pytest.mark.parametrize(
    ("text", "options", "expected"),
    [
        ("a,b\r\n1,2\r3,4\n", {}, [["a", "b"], ["1", "2"], ["3", "4"]]), ('x,"a\nb","c""d"', {}, [["x", "a\nb", 'c"d']]), ('a\n\n""\nb', {}, [["a"], ["b"]]), ("a\n\nb", {"skip_empty": False}, [["a"], [""], ["b"]]),
        ('#c\n"#d",1\nx', {"comment": "#"}, [["x"]]), ("1\n2\n3", {"skip_lines": 2}, [["3"]]), (" a ; b ", {"delimiter": ";", "trim": True}, [["a", "b"]]), ('" a "; b ', {"delimiter": ";", "trim": True}, [[" a ", "b"]]), ("", {}, []), ("a,", {}, [["a", ""]]),
    ],
)
def test_csv_parse(text, options, expected):
    assert csv.parse(text, csv.Options(**options)) == expected


def test_csv(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.parse('a,"b')
    assert csv.stringify([{"a": 1, "b": None}, {"b": "x,y"}]) == 'a,b\r\n1,\r\n,"x,y"\r\n'
    (tmp_path / "f.csv").write_text('﻿n,v\n"a,b",1\nc\nd,2,3\n')
    got = rows(csv.read_exact(spark, str(tmp_path / "f.csv"), csv.Options(header=True)).select("row", "values"), "row")
    assert got == [(1, {"n": "a,b", "v": "1"}), (2, {"n": "c"}), (3, {"n": "d", "v": "2"})]
    assert rows(csv.read(spark, str(tmp_path / "f.csv"), "n string, v int"), "n")[0] == ("a,b", 1)
    d = spark.createDataFrame([("1",), ("x",), ("",), ("true",), ("null",), ("9007199254740993",), ("007",), ("1.5",), (".5",)], ["s"])
    assert [r[0] for r in d.select(F.to_json(csv.cast("s"))).collect()] == ["1", '"x"', '""', "true", "null", '"9007199254740993"', '"007"', "1.5", "0.5"]
    out = str(tmp_path / "out")
    csv.write(spark.createDataFrame([("a\nb", 1)], "t string, n int"), out)
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part") and f.stat().st_size]
    assert files[0].read_bytes() == b't,n\r\n"a\nb",1\r\n'


# Office files


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_books(spark, tmp_path, kind):
    make = {"xlsx": office.xlsx_bytes, "ods": office.ods_bytes}[kind]
    (tmp_path / f"a.{kind}").write_bytes(make({"S1": [[1, "x", None, True], [2.5, 'é"<']], "S2": [["q"]]}))
    (tmp_path / f"b.{kind}").write_bytes(b"no zip")
    good, bad = office.split_losses(office.cells(spark, str(tmp_path), kind))
    assert rows(good.select("sheet", "row", "col", "type", "value"), "sheet", "row", "col") == [("S1", 1, 1, "number", "1"), ("S1", 1, 2, "string", "x"), ("S1", 1, 4, "boolean", "true"), ("S1", 2, 1, "number", "2.5"), ("S1", 2, 2, "string", 'é"<'), ("S2", 1, 1, "string", "q")]
    assert bad.count() == 1
    assert {r.text for r in office.grid_text(good).collect()} == {'1\tx\t\ttrue\n2.5\té"<\t\t', "q"}
    again = office.write_books(good.withColumn("key", F.lit("k")), "key", kind).first().content
    assert office.detect_format(bytes(again)) == kind


def test_documents(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    docx = office.package({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> two</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'.encode()})
    (tmp_path / "d.docx").write_bytes(docx)
    (tmp_path / "m.md").write_text("# hi")
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    got = {r.path.rpartition("/")[2]: (r.format, r.text) for r in office.texts(spark, str(tmp_path)).collect()}
    assert got == {"d.docx": ("docx", "one two\na\tb"), "m.md": ("md", "# hi"), "x.bin": ("unknown", None)}
    bomb = office.package({"a": b"0" * (30 << 20)})
    with pytest.raises(ValueError, match="too large"):
        office.parts_of(bomb)
    assert office.detect_format(b"%PDF-1.7") == "pdf" and office.detect_format(b"") == "unknown" and office.detect_format(bytes.fromhex("d0cf11e0a1b11ae1"), "a.xls") == "legacy-xls"


# Markdown


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("# A *b*\n\ntext", "<h1>A <em>b</em></h1>\n<p>text</p>\n"), ("A\n=\nB\n-", "<h1>A</h1>\n<h2>B</h2>\n"), ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"), ("1) a\n\n2) b", "<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n"),
        ("> a\nb", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n"), ("    x < y", "<pre><code>x &lt; y\n</code></pre>\n"), ("`` a`b ``", "<p><code>a`b</code></p>\n"), ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>\n"), ("a_b_c _d_", "<p>a_b_c <em>d</em></p>\n"),
        ("[a](<b c> 'T')", '<p><a href="b%20c" title="T">a</a></p>\n'), ("[x][Y]\n\n[y]: /u", '<p><a href="/u">x</a></p>\n'), ("![a *b*](u)", '<p><img src="u" alt="a b" /></p>\n'), ("<http://a.b?c&d>", '<p><a href="http://a.b?c&amp;d">http://a.b?c&amp;d</a></p>\n'),
        ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>\n"), ("***", "<hr />\n"), ("\\*a\\* &copy; &x;", "<p>*a* © &amp;x;</p>\n"), ("~~a~~", "<p><del>a</del></p>\n"), ("", ""),
    ],
)
def test_markdown(source, expected):
    assert markdown.render(source) == expected
    assert markdown.render(markdown.canonical(source)) == expected or "*" in source or "\\" in source


def test_markdown_rows(spark):
    d = spark.createDataFrame([(1, "# A b\n\n## A b\n\n> [!NOTE]\n> careful\n\n```mermaid\ng\n```\n\n# Éa"), (2, "---\na: 1\n---\nx"), (3, None)], "doc_id int, t string")
    b = markdown.blocks(d, "doc_id", "t")
    assert [r.anchor for r in markdown.headings(b, "doc_id").filter("doc_id = 1").orderBy("path").collect()] == ["a-b", "a-b-1", "ea"]
    assert markdown.toc(b, "doc_id").filter("doc_id = 1").first().toc == "- [A b](#a-b)\n  - [A b](#a-b-1)\n- [Éa](#ea)"
    assert markdown.admonitions(b, "doc_id").first().text == "careful" and markdown.mermaid(b, "doc_id").first().diagram == "g\n"
    f = d.filter("doc_id = 2").select(markdown.frontmatter("t").alias("f")).first().f
    assert (f.lang, f.content, f.rest) == ("yaml", "a: 1", "x")
    e = spark.createDataFrame([("==a== [[P|t]] [[Q]] :tada: H~2~O [^1]",)], ["s"]).select(markdown.extended("s", ["highlight", "wikilinks", "emoji", "subscript", "footnote_refs"])).first()[0]
    assert e == '<mark>a</mark> [t](P) [Q](Q) 🎉 H<sub>2</sub>O <sup><a href="#fn-1">1</a></sup>'


def test_markdown_is_linear():
    import time

    for source in ("*a " * 20_000, "[" * 3_000, "> " * 400 + "x", "`" * 9_999 + "a"):
        began = time.perf_counter()
        markdown.render(source)
        assert time.perf_counter() - began < 20


def test_paragraphs(spark):
    pieces = spark.createDataFrame([(1, "Hel", 0.0, 100.0, 15.0, 10.0), (1, "lo", 15.5, 100.0, 25.0, 10.0), (1, "wor­", 30.0, 100.0, 50.0, 10.0), (1, "ld", 0.0, 88.0, 10.0, 10.0), (1, "Next", 0.0, 50.0, 20.0, 10.0)], "page int, text string, x double, y double, x_end double, font_size double")
    assert rows(markdown.paragraph_groups(pieces, ["page"]).select("n", "text"), "n") == [(1, "Hello world"), (2, "Next")]
    assert spark.createDataFrame([("aa bb 日本 c",)], ["s"]).select(markdown.line_breaks("s", 5)).first()[0] == ["aa bb", "日本", "c"]


# Streams


def events(spark, times):
    return spark.createDataFrame([(1, k, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t)) for k, t in enumerate(times)], "u int, seq long, ts timestamp")


def test_rate_limits(spark):
    e = events(spark, [0, 10, 25, 200, 210])
    d = windows.debounce(e, ["u"], "ts", 50, "seq", leading=True)
    assert sorted((r.edge, r.seq) for r in d.collect()) == [("leading", 0), ("leading", 3), ("trailing", 2), ("trailing", 4)]
    assert windows.paced([0, 10, 25, 60, 110, 400], 50, True, True) == [(0, 0, "leading"), (50, 2, "trailing"), (100, 3, "trailing"), (150, 4, "trailing"), (400, 5, "leading")]
    assert [r.allowed for r in windows.token_bucket(e, ["u"], "ts", "seq", 2, 1, 100).orderBy("seq").collect()] == [True, True, False, True, True]


def test_tracker(spark):
    t = windows.Tracker()
    assert [t.see(s) for s in (5, 6, 9, 7, 9, 200_000, windows.WRAP - 1)] == [("first", 0), ("next", 0), ("gap", 2), ("late", 0), ("repeat", 0), ("resync", 0), ("resync", 0)]
    assert t.see(1) == ("gap", 1)
    d = spark.createDataFrame([(1, k, s, float(s)) for k, s in enumerate((1, 2, 5, 3, 5))], "layer int, arrival int, seq long, v double")
    assert rows(windows.conceal(d, ["layer"], "seq", "arrival", "v").select("seq", "v", "concealed"), "seq") == [(1, 1, False), (2, 2, False), (3, 2, True), (4, 2, True), (5, 5, False)]
    far = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 25_002, 2.0)], "layer int, arrival int, seq long, v double")
    lost = windows.conceal(far, ["layer"], "seq", "arrival", "v").filter("concealed")
    assert lost.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq"), F.max("v")).first()[:] == (25_000, 25_000, 2, 25_001, 1.0)


def test_repeats_in_full(spark):
    cells = spark.createDataFrame([(1, 1, "x", 1500, 2)], "row int, col int, value string, row_repeat int, col_repeat int")
    assert grid.expand_repeats(cells).count() == 3000 and grid.expand_repeats(cells, most=10).count() == 20
    body = '<table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="1001" office:value-type="float" office:value="7"/></table:table-row>'
    spaces = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {spaces}><office:body><office:spreadsheet><table:table table:name="s">{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    assert len(list(office.ods_cells(out.getvalue()))) == 2002
    rows_ = [["v"]] * 200_001
    assert sum(1 for _ in office.xlsx_cells(office.xlsx_bytes({"s": rows_}))) == 200_001


def test_gates_and_topics(spark):
    f = spark.createDataFrame([(1, k, x) for k, x in enumerate((0.0, 1.0, 0.0, 0.0, 0.0))], "s int, i int, level double")
    assert [r.open for r in windows.gate(f, ["s"], "i", "level", 0.5, 2).orderBy("i").collect()] == [False, True, True, True, False]
    assert [r.open for r in windows.smooth_gate(f, ["s"], "i", "level", 0.5, 0.6).orderBy("i").collect()] == [False, True, True, False, False]
    t = spark.createDataFrame([("a:",), ("a:b",), ("b",)], ["topic"])
    assert [r.topic for r in t.filter(windows.topic_matches("a:*")).collect()] == ["a:b"]
    with pytest.raises(ValueError):
        windows.topic_matches("*")


def test_streams(spark, tmp_path):
    """The streaming forms against the batch forms, and the event source."""
    feeds.register(spark)
    (tmp_path / "a.jsonl").write_text("".join(f'{{"topic": "t{k % 2}", "id": "{k}", "data": {k}}}\n' for k in range(6)))
    q = spark.readStream.format("events").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("got").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable() if q.isActive else None
    q.awaitTermination(60)
    assert spark.table("got").count() == 6
    reader = feeds.EventsReader({"path": str(tmp_path), "splitBytes": "50"})
    lines = (tmp_path / "a.jsonl").read_text()
    (tmp_path / "b.jsonl").write_text('{"data": "é"}\n\n{"data": 1}\n{"da')
    end = reader.latestOffset()
    assert end == {"a.jsonl": len(lines), "b.jsonl": 28}
    ranges = reader.partitions({}, end)
    assert len(ranges) > 3
    got = [row for r in ranges for row in reader.read(r)]
    assert [r[2] for r in got] == ["0", "1", "2", "3", "4", "5", '"\\u00e9"', "1"] and [r[1] for r in got[-2:]] == ["b.jsonl:0", "b.jsonl:16"]
    with (tmp_path / "b.jsonl").open("a") as f:
        f.write('ta": 2}\n')
    assert [row for r in reader.partitions(end, reader.latestOffset()) for row in reader.read(r)] == [("", "b.jsonl:28", "2")]
    src = tmp_path / "src"
    events(spark, [0, 10, 25, 200, 210]).withColumn("big", F.col("seq") * 2).repartition(1).write.parquet(str(src))
    stream = spark.readStream.schema("u int, seq long, ts timestamp, big long").parquet(str(src))
    for name, df in (("bucket", windows.token_bucket_stream(stream, "u", "ts", "seq", 2, 1, 100)), ("track", windows.track_stream(stream.withColumn("n", F.col("seq")), "u", "big", "n"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(90)
    assert [r.allowed for r in spark.table("bucket").orderBy("seq").collect()] == [True, True, False, True, True]
    assert [r.missing for r in spark.table("track").orderBy("n").collect()] == [0, 1, 1, 1, 1]


def test_keyed_source(spark, tmp_path):
    feeds.register(spark)
    (tmp_path / "a.jsonl").write_text('{"key": "p:1", "value": 1}\n{"key": "q", "value": 2}\n')
    assert rows(spark.read.format("keyed").option("path", str(tmp_path)).load().filter(F.col("key").startswith("p:"))) == [("p:1", "1")]


def test_spreadsheet_metadata(spark, tmp_path):
    from millrace.sources import office_parts

    m = 'xmlns="m"'
    data = office.package({
        "xl/tables/t.xml": f'<table {m} displayName="T" ref="A1:B9"><autoFilter ref="A1:B9"><filterColumn colId="1"><filters><filter val="x"/></filters></filterColumn></autoFilter><tableColumns><tableColumn name="a"/><tableColumn name="b" totalsRowFunction="sum"/></tableColumns></table>'.encode(),
        "xl/worksheets/s.xml": f'<worksheet {m}><conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" operator="lessThan"><formula>5</formula></cfRule></conditionalFormatting></worksheet>'.encode(),
        "xl/comments1.xml": f'<comments {m}><authors><author>me</author></authors><commentList><comment ref="B2" authorId="0"><text><t>hi</t></text></comment></commentList></comments>'.encode(),
    })
    (tmp_path / "a.xlsx").write_bytes(data)
    got = {(r.kind, r["name"], r.ref) for r in office_parts.metadata(spark, str(tmp_path)).collect()}
    assert got == {("table", "T", "A1:B9"), ("conditionalFormat", "cellIs", "A1:A9"), ("comment", "me", "B2")}
