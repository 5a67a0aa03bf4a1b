"""Functions on hand-written values."""

import datetime as dt
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import codecs, dates, html, numeric, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("value", "words"),
    [("fooBarBaz", ["foo", "Bar", "Baz"]), ("XMLHttpRequest", ["XML", "Http", "Request"]), ("a1b", ["a", "1", "b"]), ("foo_bar-baz qux", ["foo", "bar", "baz", "qux"]), ("", [])],
)
def test_split_words(spark, value, words):
    assert one(spark, text.split_words("s"), s=value) == words


def test_cases(spark):
    s = "XML http_request2Go"
    found = spark.createDataFrame([(s,)], ["s"]).select(*[f("s") for f in (text.camel_case, text.pascal_case, text.kebab_case, text.snake_case, text.constant_case, text.title_case)]).first()
    assert tuple(found) == ("xmlHttpRequest2Go", "XmlHttpRequest2Go", "xml-http-request-2-go", "xml_http_request_2_go", "XML_HTTP_REQUEST_2_GO", "Xml Http Request 2 Go")


def test_truncate_pad_slug_similarity(spark):
    assert one(spark, text.truncate("s", 11), s="hello wonderful world") == "hello…"
    assert one(spark, text.truncate("s", 50), s="short") == "short"
    assert one(spark, text.pad("s", 5, "*", "both"), s="ab") == "*ab**"
    assert one(spark, text.pad("s", 2), s="abc") == "abc"
    assert one(spark, text.slug("s"), s=" Éa  ça! ") == "ea-ca"
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 1
    assert one(spark, text.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, text.escape_regex("s"), s="a.b*c") == r"a\.b\*c"
    assert one(spark, text.format_text("s", {"n": F.lit(3)}), s="{n} of {m}") == "3 of {m}"


def test_unicode_entities_ansi(spark):
    assert one(spark, text.normalize_unicode("s", "NFC"), s="é") == "é"
    assert one(spark, F.size(text.graphemes("s")), s="é🇫🇷x") == 3
    assert one(spark, text.width("s"), s="日本á") == 5
    assert one(spark, text.decode_html("s"), s="&eacute;&#65;&amp;") == "éA&"
    assert one(spark, text.decode_xml(text.encode_xml("s")), s="<a & 'b'>") == "<a & 'b'>"
    assert one(spark, text.strip_ansi("s"), s="\x1b[31mred\x1b[0m!") == "red!"
    assert [e["kind"] for e in one(spark, text.ansi_events("s"), s="\x1b[1mx")] == ["csi", "text"]
    assert one(spark, text.compare(F.lit("a"), F.lit("B"), "UNICODE_CI")) == -1


@pytest.mark.parametrize(
    ("version", "wanted", "fits"),
    [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", "1.x", True), ("3.0.0", ">=1.0.0 <2.0.0 || >2.9.9", True), ("1.2.3", "1.0.0 - 2.0.0", True), ("x", "*", False)],
)
def test_semver_ranges(spark, version, wanted, fits):
    assert one(spark, text.semver_satisfies("s", wanted), s=version) is fits


def test_semver_order(spark):
    chain = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1"]
    for a, b in zip(chain, chain[1:], strict=False):
        assert one(spark, text.semver_compare(F.lit(a), F.lit(b))) == -1, (a, b)


def test_urls(spark):
    u = one(spark, text.url_parts("s"), s="https://a.example:8080/p/q?x=1&y=%20&x=2#f")
    assert (u.scheme, u.host, u.port, u.path, u.fragment) == ("https", "a.example", 8080, "/p/q", "f")
    assert one(spark, text.query_map("s"), s="https://a/?x=1&y=%20z&x=2&e") == {"y": " z", "x": "2", "e": ""}


def test_dates(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, dates.parse_iso("s"), s="2024-02-30T00:00:00") is None
    assert one(spark, dates.parse_iso("s").isNotNull(), s="2024-02-29T01:02:03+0200")
    assert one(spark, dates.add(t("2024-01-31 10:00:00"), 1, "months")) == dt.datetime(2024, 2, 29, 10)
    assert one(spark, dates.diff(t("2024-03-01 01:00:00"), t("2024-02-29 23:00:00"), "days")) == 0
    assert one(spark, dates.diff(t("2024-03-30 00:00:00"), t("2024-01-31 00:00:00"), "months")) == 1
    assert one(spark, dates.end_of(t("2024-02-10 01:00:00"), "months")) == dt.datetime(2024, 2, 29, 23, 59, 59, 999000)
    assert one(spark, dates.format_relative(t("2024-01-04 00:00:00"), t("2024-01-01 00:00:00"))) == "in 3 days"
    assert one(spark, dates.format_relative(t("2023-12-31 00:00:00"), t("2024-01-01 00:00:00"))) == "yesterday"
    assert one(spark, dates.excel_serial("n"), n=60) == dt.datetime(1900, 2, 28)
    assert one(spark, dates.excel_serial("n"), n=45292.5) == dt.datetime(2024, 1, 1, 12)
    assert one(spark, dates.offset_minutes(t("2024-07-01 00:00:00"), "Europe/Paris")) == 120


@pytest.mark.parametrize(("expression", "time", "hit"), [("0 0 13 * 5", "2024-09-13 00:00:00", True), ("0 0 13 * 5", "2024-09-20 00:00:00", True), ("0 0 13 * 5", "2024-09-21 00:00:00", False), ("*/20 1-3 * * *", "2024-01-01 02:40:00", True)])
def test_cron(spark, expression, time, hit):
    assert one(spark, dates.cron_match(F.lit(time).cast("timestamp"), expression)) is hit


def test_cron_errors():
    for bad in ("* * * *", "60 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            dates.cron_sets(bad)


@pytest.mark.parametrize(("n", "code", "shown"), [(1234.5, "#,##0.00", "1,234.50"), (-5.0, "0.0;(0.0)", "(5.0)"), (0.256, "0.0%", "25.6%"), (12345.0, "0.00E+00", "1.23E+04"), (7.0, "000", "007"), (1234567.0, "#,##0,", "1,235"), (1234567.0, "0,,.0", "1.2"), (0.5, "%0", "%50"), (0.5, "0%%", "5000%%"), (0.0, '0;-0;"none"', "none"), (45292.75, "yyyy-mm-dd hh:mm", "2024-01-01 18:00")])
def test_number_formats(spark, n, code, shown):
    assert one(spark, dates.format_code("n", code), n=n) == shown


@pytest.mark.parametrize(("n", "code", "shown"), [(1e17, "0", "100000000000000000"), (2.0**63 + 2.0**13, "#,##0.0", "9,223,372,036,854,784,000.0"), (4503599627370497.5, "0.0%", "450359962737049792.0%"), (0.125, "0.00", "0.13")])
def test_long_numbers(spark, n, code, shown):
    assert one(spark, dates.format_code("n", code), n=n) == shown


def test_number_formats_by_exact_value(spark, tmp_path):
    import duckdb

    from millrace.plans.queries import ORACLE_SQL, QUERIES

    values = [0.0, -0.0, 0.125, 0.375, 2.675, 0.045, 99999.995, 500.0, 1500.0, 0.0005, 1e15 + 0.25, 123456789012345.67, 4503599627370497.0, 6492104648617095.0, 1e17, 2.0**63, 1e19, 9e21, 5e-324, -3.0, None]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = {r[0]: tuple(map(str, r[2:])) for r in duck.execute(ORACLE_SQL["number_formats"]).fetchall()}
    assert {r[0]: tuple(r[2:]) for r in QUERIES["number_formats"](spark, str(tmp_path)).collect()} == want and len(want) == 19


def test_numbers(spark):
    assert int(one(spark, numeric.mod_pow(F.lit(3), F.lit(200), F.lit(13)))) == pow(3, 200, 13)
    assert int(one(spark, numeric.mod_inv(F.lit(3), F.lit(11)))) == 4
    assert one(spark, numeric.mod_inv(F.lit(2), F.lit(4))) is None
    assert one(spark, numeric.is_prime(F.lit(2**31 - 1))) is True
    assert one(spark, numeric.to_radix(F.lit(255), 16)) == "ff"
    assert one(spark, numeric.bezier([F.lit(0.0), F.lit(1.0), F.lit(1.0)], F.lit(0.5))) == pytest.approx(0.75)
    assert one(spark, numeric.catmull_rom(*map(F.lit, (0.0, 1.0, 2.0, 3.0)), F.lit(0.5))) == pytest.approx(1.5)
    assert one(spark, numeric.from_fixed(F.lit(1 << 15))) == 0.5
    for name in ("easeInQuad", "easeOutBounce", "easeInOutElastic", "easeInBack"):
        assert one(spark, numeric.ease(name, F.lit(0.0))) == pytest.approx(0, abs=1e-9) and one(spark, numeric.ease(name, F.lit(1.0))) == pytest.approx(1)


def test_geometry(spark):
    square = F.array(*[numeric.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert one(spark, numeric.polygon_area(square)) == 4 and one(spark, numeric.is_ccw(square)) is True
    assert one(spark, numeric.polygon_contains(square, numeric.point(F.lit(1), F.lit(1)))) is True
    p = lambda x, y: numeric.point(F.lit(x), F.lit(y))
    assert tuple(one(spark, numeric.lines_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)))) == (1, 1)
    line = F.array(*[p(x, y) for x, y in ((0, 0), (1, 0.01), (2, 0), (3, 5))])
    assert len(one(spark, numeric.simplify(line, 0.1))) == 3
    d = spark.createDataFrame([([[2.0, 0.0], [0.0, 4.0]],)], ["m"]).withColumn("i", numeric.invert("m"))
    assert d.select(numeric.matrix_multiply("m", "i").alias("v")).first().v == [[1, 0], [0, 1]]


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_binary_round_trips(data):
    assert codecs.lzw_decode(codecs.lzw_encode(data)) == data
    for low_first in (False, True):
        for early in (False, True):
            for some in (data, b"", b"a", bytes(range(256)) * 40):
                assert codecs.lzw_decode(codecs.lzw_encode(some, 12, low_first, early), 12, low_first, early) == some
    # the published example of PDF (high bits first, early)
    assert codecs.lzw_encode(bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66]), early=True).hex() == "800b6050220c0c8501"
    assert codecs.base58_back(codecs.base58_of(data).encode()) == data
    assert codecs.base32_back(codecs.base32_of(data).encode()) == data


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=40), lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(max_size=8), x, max_size=5), max_leaves=20)


@given(values)
@settings(max_examples=80, deadline=None)
def test_packed_values(v):
    assert codecs.whole(codecs.msgpack_encode(v), codecs.msgpack_value) == v
    assert codecs.whole(codecs.cbor_encode(v), codecs.cbor_value) == v


def test_known_bytes():
    assert codecs.msgpack_encode({"a": [1, -1, 1.5]}).hex() == "81a1619301ffcb3ff8000000000000"
    assert codecs.cbor_encode([1, -500, "a"]).hex() == "83013901f36161"
    assert codecs.whole(bytes.fromhex("9f0102ff"), codecs.cbor_value) == [1, 2]
    for bad in (b"\xc1", b"\x92\x01", b"\xa5ab", b"\x01\x02"):
        with pytest.raises(ValueError):
            codecs.whole(bad, codecs.msgpack_value)


def test_codec_columns(spark):
    assert one(spark, codecs.digest("s", "sha3_256"), s="abc") == hashlib.sha3_256(b"abc").hexdigest()
    assert one(spark, codecs.from_base64(codecs.to_base64("s", url=True, padded=False)), s="a?>b") == b"a?>b"
    assert one(spark, codecs.from_bits(codecs.to_bits(F.lit(b"\x05a")))) == b"\x05a"
    assert one(spark, codecs.aes_decrypt(codecs.aes_encrypt("s", F.lit("0123456789abcdef")), F.lit("0123456789abcdef")).cast("string"), s="x") == "x"
    r = one(spark, codecs.read_record(F.lit(b"\x00\x01\xff\x3f\x80\x00\x00"), [("a", "u16"), ("b", "i8"), ("c", "f32")]))
    assert (r.a, r.b, r.c) == (1, -1, 1.0)
    assert one(spark, codecs.write_record([F.lit(1), F.lit(-1)], ["u16", "i8"], little=True)) == b"\x01\x00\xff"
    parts = codecs.mime_parts(b'--x\r\nContent-Type: text/plain\r\n\r\nhi\r\n--x\r\nA: b\r\n c\r\n\r\n\r\n--x--', "x")
    assert [p["body"] for p in parts] == [b"hi", b""] and parts[1]["headers"]["a"] == "b c"
    assert json.loads(one(spark, codecs.msgpack_to_json(codecs.json_to_msgpack("s")), s='{"k":[1,null]}')) == {"k": [1, None]}


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ('<p onclick="x()">hi</p>', "<p>hi</p>"), ("a<script>alert(1)</script>b", "ab"), ('<a href="javascript:x">y</a>', "<a>y</a>"), ("<blink>t</blink>", "t"), ("<br>", "<br />"), ("<!-- c -->x", "x"),
        ('<a href="https://e.com" target="_blank">y</a>', '<a href="https://e.com" target="_blank" rel="noopener noreferrer">y</a>'), ('<img src="data:text/html,x">', "<img />"), ("<style>p{}", ""), ("", ""),
        ('<a href="java&#10;script:x">y</a>', "<a>y</a>"),
    ],
)
def test_sanitize(dirty, clean):
    assert html.sanitized(dirty) == clean
