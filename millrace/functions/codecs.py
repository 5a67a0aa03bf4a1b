"""Text and binary codecs, digests, compression and binary records.

What Spark has as an expression stays an expression; the rest are pandas UDFs over whole columns.
"""

from __future__ import annotations

import gzip
import hashlib
import hmac
import json
import struct
import zlib
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col

DEPTH = 64


def binary(function: Callable[[bytes], object], returns: T.DataType) -> Callable[[Column | str], Column]:
    """A pandas UDF over binary values. Null stays null; malformed input raises ValueError."""

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else function(bytes(v)))

    return lambda c: run(col(c).cast("binary"))


# Text forms


def to_hex(b) -> Column:
    return F.lower(F.hex(col(b)))


def from_hex(s) -> Column:
    return F.unhex(col(s))


def to_base64(b, url: bool = False, padded: bool = True) -> Column:
    text = F.translate(F.base64(col(b).cast("binary")), "\r\n", "")  # Spark breaks lines after 76 characters
    text = F.translate(text, "+/", "-_") if url else text
    return text if padded else F.rtrim(text, F.lit("="))


def from_base64(s) -> Column:
    """Either alphabet, with or without padding."""
    text = F.rtrim(F.translate(col(s), "-_", "+/"), F.lit("="))
    return F.unbase64(F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)))))


def base32_of(data: bytes) -> str:
    import base64

    return base64.b32encode(data).decode()


def base32_back(text: bytes) -> bytes:
    import base64

    clean = text.decode().upper().rstrip("=")
    return base64.b32decode(clean + "=" * (-len(clean) % 8))


to_base32 = binary(base32_of, T.StringType())
from_base32 = binary(base32_back, T.BinaryType())

#: Fixed value: the Bitcoin alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_of(data: bytes) -> str:
    n, out = int.from_bytes(data), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def base58_back(text: bytes) -> bytes:
    s, n = text.decode(), 0
    for c in s:
        if c not in BASE58:
            raise ValueError(f"base58: {c!r}")
        n = n * 58 + BASE58.index(c)
    return b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8)


to_base58 = binary(base58_of, T.StringType())
from_base58 = binary(base58_back, T.BinaryType())


def utf8_encode(s) -> Column:
    return F.encode(col(s), "utf-8")


def utf8_decode(b) -> Column:
    return F.decode(col(b), "utf-8")


def to_bits(b) -> Column:
    """'0' and '1' of each byte, first bit first."""
    digits = F.regexp_extract_all(F.hex(col(b)), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(digits, lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")


def from_bits(s) -> Column:
    octets = F.regexp_extract_all(col(s), F.lit("([01]{8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 2, 16), 2, "0")), ""))


def bytes_equal(a, b) -> Column:
    return col(a) == col(b)


def bytes_join(*parts) -> Column:
    return F.concat(*[col(p) for p in parts])


# Digests


def crc32(b) -> Column:
    return F.crc32(col(b).cast("binary"))


def sha2(b, bits: int = 256) -> Column:
    return F.sha2(col(b).cast("binary"), bits)


def adler32(b) -> Column:
    return binary(zlib.adler32, T.LongType())(b)


def digest(b, name: str) -> Column:
    """Hexadecimal digest by any algorithm of hashlib: sha512_224, sha512_256, sha3_256, blake2b, ..."""
    hashlib.new(name)
    return binary(lambda v: hashlib.new(name, v).hexdigest(), T.StringType())(b)


def hmac_hex(b, key: bytes, name: str = "sha256") -> Column:
    return binary(lambda v: hmac.new(key, v, name).hexdigest(), T.StringType())(b)


def hkdf_bytes(secret: bytes, salt: bytes, info: bytes, length: int, name: str = "sha256") -> bytes:
    """RFC 5869."""
    size = hashlib.new(name).digest_size
    if length > 255 * size:
        raise ValueError("hkdf: too long")
    key, block, out = hmac.new(salt or bytes(size), secret, name).digest(), b"", b""
    for n in range(1, -(-length // size) + 1):
        block = hmac.new(key, block + info + bytes([n]), name).digest()
        out += block
    return out[:length]


def hkdf(b, salt: bytes, info: bytes, length: int, name: str = "sha256") -> Column:
    return binary(lambda v: hkdf_bytes(v, salt, info, length, name), T.BinaryType())(b)


def pbkdf2(b, salt: bytes, rounds: int, length: int, name: str = "sha256") -> Column:
    return binary(lambda v: hashlib.pbkdf2_hmac(name, v, salt, rounds, length), T.BinaryType())(b)


def aes_encrypt(b, key, mode: str = "GCM") -> Column:
    return F.aes_encrypt(col(b), col(key), F.lit(mode))


def aes_decrypt(b, key, mode: str = "GCM") -> Column:
    return F.aes_decrypt(col(b), col(key), F.lit(mode))


def uuid4() -> Column:
    return F.uuid()


# Compression of values

gzip_value = binary(lambda v: gzip.compress(v, mtime=0), T.BinaryType())
gunzip_value = binary(gzip.decompress, T.BinaryType())
zlib_value = binary(zlib.compress, T.BinaryType())
unzlib_value = binary(zlib.decompress, T.BinaryType())


def lzw_encode(data: bytes, most: int = 12, low_first: bool = False, early: bool = False) -> bytes:
    """Variable-width codes of 9 to `most` bits; 256 clears the table, 257 ends.

    Bits go high first (as in TIFF and PDF) or low first (GIF); with `early` widths grow one code sooner (TIFF, PDF).
    """
    full, chunks = 1 << most, bytearray()
    # written bits not yet in chunks: the clear code, at first
    acc, bits, width, size = 256, 9, 9, 258
    table: dict[int, int] = {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = table.get(key)
        if longer is not None:
            prefix = longer
            continue
        acc, bits = (acc | prefix << bits if low_first else acc << width | prefix), bits + width
        if size < full:
            table[key] = size
            size += 1
            if size + early > 1 << width and width < most:
                width += 1
        else:
            acc, bits = (acc | 256 << bits if low_first else acc << width | 256), bits + width
            table, width, size = {}, 9, 258
        prefix = byte
        if bits >= 256:
            if low_first:
                chunks += (acc & ((1 << 256) - 1)).to_bytes(32, "little")
                acc, bits = acc >> 256, bits - 256
            else:
                bits -= 256
                chunks += (acc >> bits).to_bytes(32, "big")
                acc &= (1 << bits) - 1
    if prefix >= 0:
        acc, bits = (acc | prefix << bits if low_first else acc << width | prefix), bits + width
        size += size < full
        if size + early > 1 << width and width < most:
            width += 1
    acc, bits = (acc | 257 << bits if low_first else acc << width | 257), bits + width
    n = (bits + 7) // 8
    return bytes(chunks) + (acc.to_bytes(n, "little") if low_first else (acc << (8 * n - bits)).to_bytes(n, "big"))


def lzw_decode(data: bytes, most: int = 12, low_first: bool = False, early: bool = False) -> bytes:
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    full, table, out = 1 << most, single.copy(), []
    acc = bits = at = 0
    width, last = 9, b""
    while True:
        if bits < width:
            some = data[at : at + 32]
            at += 32
            acc = acc | int.from_bytes(some, "little") << bits if low_first else acc << 8 * len(some) | int.from_bytes(some, "big")
            bits += 8 * len(some)
            if bits < width:
                raise ValueError("lzw: no end code")
        bits -= width
        if low_first:
            code, acc = acc & ((1 << width) - 1), acc >> width
        else:
            code = acc >> bits
            acc &= (1 << bits) - 1
        size = len(table)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = single.copy(), 9, b""
            continue
        if code < size:
            entry = table[code]
        elif code == size and last:
            entry = last + last[:1]
        else:
            raise ValueError("lzw: broken code")
        out.append(entry)
        if last and size < full:
            table.append(last + entry[:1])
            size += 1
        # the writer is one entry ahead
        if size + 1 + early > 1 << width and width < most:
            width += 1
        last = entry


lzw_value = binary(lzw_encode, T.BinaryType())
unlzw_value = binary(lzw_decode, T.BinaryType())


# MessagePack and CBOR, by way of JSON text


def plain(v):
    """A decoded value as JSON has it; bytes as {"$hex": ...}, times in ISO form, extensions as {"$ext": [type, hex]}."""
    if isinstance(v, bytes):
        return {"$hex": v.hex()}
    if isinstance(v, datetime):
        return {"$time": v.isoformat()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k if isinstance(k, str) else json.dumps(plain(k)): plain(x) for k, x in v.items()}
    return v


def rich(v):
    if isinstance(v, list):
        return [rich(x) for x in v]
    if isinstance(v, dict):
        if set(v) == {"$hex"}:
            return bytes.fromhex(v["$hex"])
        if set(v) == {"$time"}:
            return datetime.fromisoformat(v["$time"])
        return {k: rich(x) for k, x in v.items()}
    return v


def sized(n: int, small: tuple[int, int] | None, codes: tuple, what: str) -> bytes:
    """The head of a string, binary, array or map of n parts."""
    if small and n <= small[1]:
        return bytes([small[0] | n])
    for code, form, top in codes:
        if n <= top:
            return bytes([code]) + struct.pack(form, n)
    raise ValueError(f"{what} is too long")


U8, U16, U32 = (">B", 0xFF), (">H", 0xFFFF), (">I", 0xFFFFFFFF)


def msgpack_encode(v, depth: int = 0) -> bytes:
    if depth > DEPTH:
        raise ValueError("msgpack: nested too deeply")
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return struct.pack(">b", v)
        forms = ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64)) if v >= 0 else ((0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0))
        for code, form, lo, hi in forms:
            if lo <= v < hi:
                return bytes([code]) + struct.pack(form, v)
        raise ValueError("msgpack: whole number out of range")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        data = v.encode()
        return sized(len(data), (0xA0, 31), ((0xD9, *U8), (0xDA, *U16), (0xDB, *U32)), "string") + data
    if isinstance(v, bytes):
        return sized(len(v), None, ((0xC4, *U8), (0xC5, *U16), (0xC6, *U32)), "binary") + v
    if isinstance(v, datetime):
        seconds, nanos = int(v.timestamp() // 1), v.microsecond * 1000
        if 0 <= seconds < 1 << 32 and not nanos:
            return b"\xd6\xff" + struct.pack(">I", seconds)
        if 0 <= seconds < 1 << 34:
            return b"\xd7\xff" + struct.pack(">Q", nanos << 34 | seconds)
        return b"\xc7\x0c\xff" + struct.pack(">Iq", nanos, seconds)
    if isinstance(v, list):
        return sized(len(v), (0x90, 15), ((0xDC, *U16), (0xDD, *U32)), "array") + b"".join(msgpack_encode(x, depth + 1) for x in v)
    if isinstance(v, dict):
        return sized(len(v), (0x80, 15), ((0xDE, *U16), (0xDF, *U32)), "map") + b"".join(msgpack_encode(k, depth + 1) + msgpack_encode(x, depth + 1) for k, x in v.items())
    raise TypeError(f"msgpack: {type(v).__name__}")


class Bytes:
    """A cursor over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("unexpected end of data")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]


NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def msgpack_value(b: Bytes, depth: int = 0):
    if depth > DEPTH:
        raise ValueError("msgpack: nested too deeply")
    code = b.number(">B")
    if code < 0x80:
        return code
    if code >= 0xE0:
        return code - 256
    if code in NUMBERS:
        return b.number(NUMBERS[code])
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code]
    forms = (">B", ">H", ">I")
    if 0xA0 <= code < 0xC0 or 0xD9 <= code <= 0xDB:
        return b.take(code & 31 if code < 0xC0 else b.number(forms[code - 0xD9])).decode()
    if 0xC4 <= code <= 0xC6:
        return b.take(b.number(forms[code - 0xC4]))
    if 0x90 <= code < 0xA0 or code in (0xDC, 0xDD):
        n = code & 15 if code < 0xA0 else b.number(forms[code - 0xDB])
        return [msgpack_value(b, depth + 1) for _ in range(n)]
    if 0x80 <= code < 0x90 or code in (0xDE, 0xDF):
        n = code & 15 if code < 0x90 else b.number(forms[code - 0xDD])
        return {k if isinstance(k := msgpack_value(b, depth + 1), str | int | float | bool | bytes) else str(k): msgpack_value(b, depth + 1) for _ in range(n)}
    if 0xC7 <= code <= 0xC9 or 0xD4 <= code <= 0xD8:
        n = b.number(forms[code - 0xC7]) if code <= 0xC9 else 1 << (code - 0xD4)
        kind, data = b.number(">b"), b.take(n)
        return timestamp(data) if kind == -1 else {"$ext": [kind, data.hex()]}
    raise ValueError(f"msgpack: code {code:#x}")


def timestamp(data: bytes) -> datetime:
    if len(data) == 4:
        seconds, nanos = struct.unpack(">I", data)[0], 0
    elif len(data) == 8:
        both = struct.unpack(">Q", data)[0]
        nanos, seconds = both >> 34, both & (1 << 34) - 1
    elif len(data) == 12:
        nanos, seconds = struct.unpack(">Iq", data)
    else:
        raise ValueError("msgpack: timestamp")
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds, microseconds=nanos // 1000)


def whole(data: bytes, read):
    b = Bytes(data)
    v = read(b)
    if b.at != len(data):
        raise ValueError("data after the value")
    return v


to_json_of = lambda v: json.dumps(plain(v), ensure_ascii=False)


def msgpack_to_json(b) -> Column:
    return binary(lambda v: to_json_of(whole(v, msgpack_value)), T.StringType())(b)


def json_to_msgpack(s) -> Column:
    return binary(lambda v: msgpack_encode(rich(json.loads(v))), T.BinaryType())(s)


def cbor_encode(v, depth: int = 0) -> bytes:
    if depth > DEPTH:
        raise ValueError("cbor: nested too deeply")

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        for k, (form, top) in enumerate((U8, U16, U32, (">Q", (1 << 64) - 1))):
            if n <= top:
                return bytes([major << 5 | 24 + k]) + struct.pack(form, n)
        raise ValueError("cbor: whole number out of range")

    if v is None or isinstance(v, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, datetime):
        return b"\xc1" + cbor_encode(v.timestamp(), depth + 1)
    if isinstance(v, bytes):
        return head(2, len(v)) + v
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(cbor_encode(x, depth + 1) for x in v)
    if isinstance(v, dict):
        return head(5, len(v)) + b"".join(cbor_encode(k, depth + 1) + cbor_encode(x, depth + 1) for k, x in v.items())
    raise TypeError(f"cbor: {type(v).__name__}")


_BREAK = object()


def cbor_value(b: Bytes, depth: int = 0, stop: bool = False):
    if depth > DEPTH:
        raise ValueError("cbor: nested too deeply")
    first = b.number(">B")
    major, low = first >> 5, first & 31
    if first == 0xFF and stop:
        return _BREAK
    if major == 7 and low >= 20:
        if low in (25, 26, 27):
            return b.number({25: ">e", 26: ">f", 27: ">d"}[low])
        if low in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[low]
        raise ValueError(f"cbor: code {first:#x}")
    n = low if low < 24 else b.number((">B", ">H", ">I", ">Q")[low - 24]) if low < 28 else None
    if n is None and (low != 31 or major in (0, 1, 6, 7)):
        raise ValueError(f"cbor: code {first:#x}")

    def until():
        while (x := cbor_value(b, depth + 1, True)) is not _BREAK:
            yield x

    if major == 0:
        return n
    if major == 1:
        return -1 - n
    if major in (2, 3):
        data = b.take(n) if n is not None else b"".join(x if isinstance(x, bytes) else x.encode() for x in until())
        return data if major == 2 else data.decode()
    if major == 4:
        return list(until()) if n is None else [cbor_value(b, depth + 1) for _ in range(n)]
    if major == 5:
        flat = list(until()) if n is None else [cbor_value(b, depth + 1) for _ in range(2 * n)]
        return dict(zip(flat[::2], flat[1::2], strict=True))
    inner = cbor_value(b, depth + 1)
    if n == 1:
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=inner)
    return datetime.fromisoformat(inner) if n == 0 else inner


def cbor_to_json(b) -> Column:
    return binary(lambda v: to_json_of(whole(v, cbor_value)), T.StringType())(b)


def json_to_cbor(s) -> Column:
    return binary(lambda v: cbor_encode(rich(json.loads(v))), T.BinaryType())(s)


# MIME

PART = T.StructType([T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.BinaryType())])


def mime_parts(data: bytes, boundary: str) -> list[dict]:
    """The parts of a multipart body."""
    mark, out = b"--" + boundary.encode(), []
    lines = (b"\r\n" + data).split(b"\r\n" + mark)
    for part in lines[1:]:
        if part.startswith(b"--"):
            return out
        head, _, body = part.lstrip(b" \t").removeprefix(b"\r\n").partition(b"\r\n\r\n")
        parsed = BytesParser().parsebytes(head + b"\r\n\r\n", headersonly=True)
        out.append({"headers": {k.lower(): " ".join(str(v).split()) for k, v in parsed.items()}, "body": body})
    raise ValueError("mime: no closing boundary")


def mime_decode(b, boundary: str) -> Column:
    @F.udf(T.ArrayType(PART), useArrow=True)
    def run(v):
        return None if v is None else mime_parts(bytes(v), boundary)

    return run(col(b))


# Binary records

FORMS = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "u64": "Q", "i64": "q", "f32": "f", "f64": "d"}


def record_type(fields: list[tuple[str, str]]) -> T.StructType:
    kind = lambda f: T.DoubleType() if f[0] == "f" else T.DecimalType(20, 0) if f == "u64" else T.LongType()
    return T.StructType([T.StructField(n, kind(f)) for n, f in fields])


def read_record(b, fields: list[tuple[str, str]], little: bool = False, offset: int = 0) -> Column:
    """Fields [(name, u8 ... f64)] of a binary value from an offset on; null if it is too short."""
    from decimal import Decimal

    form = ("<" if little else ">") + "".join(FORMS[f] for _, f in fields)
    size = struct.calcsize(form)

    @F.udf(record_type(fields), useArrow=True)
    def run(v):
        if v is None or len(v) < offset + size:
            return None
        values = struct.unpack_from(form, bytes(v), offset)
        return {n: Decimal(x) if f == "u64" else x for (n, f), x in zip(fields, values, strict=True)}

    return run(col(b))


def write_record(columns: list, forms: list[str], little: bool = False) -> Column:
    """Packs columns into a binary value; null if any is null."""
    form = ("<" if little else ">") + "".join(FORMS[f] for f in forms)

    @F.pandas_udf(T.BinaryType())
    def run(*series: pd.Series) -> pd.Series:
        pack = lambda row: None if any(x is None or x != x for x in row) else struct.pack(form, *(float(x) if f[0] == "f" else int(x) for x, f in zip(row, forms, strict=True)))
        return pd.Series([pack(r) for r in zip(*series, strict=True)], dtype=object)

    return run(*[col(c) for c in columns])
