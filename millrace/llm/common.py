"""What the operators share: tables, folds, whitespace tokens, lineage cuts and bounded samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word: a run without ASCII white space (space, tab, newline, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process (tests)."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir"):
        return base
    if not sc.getCheckpointDir() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for files of one run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def fold(n: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def share_of(key: Column, share: float, salt: int = 0) -> Column:
    """True for about this share of the keys: always the same ones."""
    top = 1 << 30
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(top)) < F.lit(int(min(1.0, share) * top))


def ascii_lower(data: bytes) -> bytes:
    """A-Z to a-z, all other bytes as they are (bytes.lower works on ASCII only)."""
    return data.lower()


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased (A-Z) words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_col(text: Column) -> Column:
    """The same words as a column of array<string>; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def chunks(texts: list[str | None], size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters, one text at least."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > size:
            yield start, k
            start, held = k, 0
        held += n + 1
    if held:
        yield start, len(texts)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default: texts are long. A setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches after which a reused worker gives its memory back to the system."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of another, whatever characters their names have."""
    return df.select([F.col(f"`{c.replace('`', '``')}`") for c in like.columns])


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def appended(docs: DataFrame, reads: list[str], new: T.StructType, make: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """docs with new columns, made within each batch; existing columns of those names are replaced.

    make() runs once in each task and returns a function of the lists of values of `reads`, which
    returns a list of values for each new column. All other columns pass through as Arrow has them,
    so no value is changed on the way. Batches are cut so that few megabytes of text are held at once.
    """
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in docs.columns if c.lower() not in names]
    quote = lambda c: F.col(f"`{c.replace('`', '``')}`")
    # by position within, as mapInArrow takes no names with dots
    inner = [f"c{k}" for k in range(len(kept))]
    d = docs.select([quote(c).alias(i) for c, i in zip(kept, inner, strict=True)] + [quote(c).alias(f"in{k}") for k, c in enumerate(reads)])
    out = T.StructType(d.schema.fields[: len(kept)] + [T.StructField(f"out{k}", f.dataType) for k, f in enumerate(new.fields)])
    arrow = to_arrow_schema(new)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for b in batches:
            values = [b.column(len(inner) + k).to_pylist() for k in range(len(reads))]
            for start, end in chunks(values[0]):
                made = function(*[v[start:end] for v in values])
                arrays = [pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)]
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(part.columns[: len(inner)] + arrays, names=out.names)

    return d.mapInArrow(released(run), out).toDF(*kept, *new.names)
