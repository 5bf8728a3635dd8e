"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import vitrina
from vitrina.session import checkpoint_dir, cut_lineage, passing_tables

__all__ = ["WORD", "checkpoint_dir", "cut_lineage", "fresh", "passing_tables", "perhaps_within", "read", "ship", "slices", "small_batches", "text_bytes", "without", "word_count"]

#: A word: a longest run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(vitrina.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="spark-package-")) / "vitrina_package.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(Path("vitrina") / file.relative_to(root)))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, none for null: what Python tasks need of it, without a decode."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _marked(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` beside a bit map of ``keys`` (a table of one column of longs), and whether the map holds ``column``.

    The map has a fixed size (2049 rows of 4 kB at most), hence the broadcast.
    """
    bits, bucket, key = fresh(rows, "key_bits"), fresh(rows, "key_bucket"), fresh(rows, "key_value")

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(1 << 26))

    maps = keys.toDF(key).select(place(key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.pmod(F.floor(byte / F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8 + 1).cast("int"))), F.lit(2)) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(column)) == F.col(bucket), "left"), hit


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose ``column`` (a long) is in ``gone``, a table of one column.

    A bit map tells most rows that they stay, so only the others, with their texts, are
    shuffled for the exact comparison.
    """
    key = fresh(rows, "gone_key")
    marked, hit = _marked(rows, column, gone)
    unsure = marked.filter(hit).select(*rows.columns)
    return marked.filter(~hit).select(*rows.columns).unionByName(
        unsure.join(gone.toDF(key), F.col(column) == F.col(key), "left_anti"))


def perhaps_within(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` (a long) is in ``keys``, a table of one column, and by chance a few others.

    For what an exact join with ``keys`` reads afterwards: other rows needn't be shuffled for it.
    """
    marked, hit = _marked(rows, column, keys)
    return marked.filter(hit).select(*rows.columns)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows per Arrow batch for what is run inside, where rows are wide; the session's setting returns after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


#: What a worker process keeps from one task for the next of its kind, by name.
KEPT: dict[str, object] = {}


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 23, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more than ``size`` bytes of data (one row at least).

    Batches come with a fixed number of rows; what a task builds from them stays bounded
    also where texts are long.  Of :data:`KEPT` only ``keeps`` stays: a worker process goes on to
    tasks of other kinds, which need the memory.
    """
    others = KEPT.keys() - {keeps}
    for name in others:
        del KEPT[name]
    if others:
        give_back()
    for batch in batches:
        rows = max(1, int(batch.num_rows * min(1.0, size / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        batch = None
    give_back()
