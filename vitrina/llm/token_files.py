"""Token ids in binary files: patched frame-of-reference blocks.

Ids are cut into blocks of 1024.  A block stores its minimum, the differences to it packed
at a width that fits a percentile of them, and for the few that don't fit an exception
list of position and high bits.  An index holds where each block starts, so any range of
ids is read without the rest of the file.

Layout of a file (little-endian)::

    "PFB1"
    block: packed differences (width * 128 bytes), exception positions (u2), exception high bits (u4)
    ...
    documents: id (i8), id is null (u1), number of ids (u8)          one array each
    index: block start (u8), minimum (u4), width (u1), exceptions (u2)   one array each
    documents (u8), blocks (u8), ids (u8), start of the document table (u8), "PFB1"

Inside a block value ``i`` lies in lane ``i % 32`` at place ``i // 32`` of that lane; a lane
is a run of ``width`` 32-bit words.

Edge cases: null and empty texts have only the end id; null ids come first; rows with the
same id are ordered by a hash of their text, and equal rows are alike.  Empty tables give
no files and an empty result.  Columns of any other name are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import checkpoint_dir, cut_lineage, slices
from vitrina.llm.encoding import TextEncoder

BLOCK = 1024
LANES = 32
MAGIC = b"PFB1"
_FLUSH = 256 * BLOCK


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), values.astype(np.uint64), side="right").astype(np.uint8)


def _shifts(width: int):
    for place in range(BLOCK // LANES):
        word, shift = divmod(place * width, 32)
        yield place, word, shift


def pack(low: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values below ``2 ** width`` to (blocks, width * 32) words."""
    values = low.reshape(-1, BLOCK // LANES, LANES).astype(np.uint32)
    out = np.zeros((len(values), width, LANES), np.uint32)
    for place, word, shift in _shifts(width) if width else ():
        out[:, word] |= values[:, place] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= values[:, place] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(-1, width, LANES) if width else words.reshape(len(words), 0, LANES)
    out = np.zeros((len(words), BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for place, word, shift in _shifts(width) if width else ():
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, place] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, minimum, width and number of exceptions of each block of ``ids``."""
    blocks = -(-len(ids) // BLOCK)
    values = np.full(blocks * BLOCK, ids[-1], np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    values = values - least[:, None]
    place = min(BLOCK - 1, max(0, int(np.ceil(percentile / 100 * BLOCK)) - 1))
    widths = _bits(np.partition(values, place, axis=1)[:, place])
    high = (values.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype("<u4")
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        low = values[own] & np.uint32((1 << int(width)) - 1)
        for i, words in zip(own, pack(low, int(width)).astype("<u4"), strict=True):
            packed[i] = words.tobytes()
    exceptions = (high > 0).sum(axis=1).astype(np.uint16)
    out = []
    for i in range(blocks):
        at = np.flatnonzero(high[i])
        out.append(packed[i] + at.astype("<u2").tobytes() + high[i, at].tobytes())
    return out, least, widths, exceptions


class TokenFileWriter:
    """Writes one file, block by block; holds a few blocks and 17 bytes per document."""

    def __init__(self, path: str, percentile: float):
        fs, place = _file_system(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.out, self.percentile = fs.open_output_stream(place), percentile
        self.out.write(MAGIC)
        self.at, self.held, self.waiting, self.ids = len(MAGIC), [], 0, 0
        self.docs: list[tuple[int, bool, int]] = []
        self.index: list[tuple[np.ndarray, ...]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.waiting += len(ids) // 4
        self.ids += len(ids) // 4
        if self.waiting >= _FLUSH:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        n = len(ids) if end else len(ids) // BLOCK * BLOCK
        if n:
            blocks, least, widths, exceptions = encode_blocks(ids[:n], self.percentile)
            sizes = np.array([len(b) for b in blocks], np.uint64)
            starts = np.uint64(self.at) + np.cumsum(sizes) - sizes
            self.index.append((starts, least, widths, exceptions))
            self.out.write(b"".join(blocks))
            self.at += int(sizes.sum())
        self.held, self.waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(True)
        ids, null, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        columns = [np.array(ids, "<i8"), np.array(null, "u1"), np.array(counts, "<u8")]
        blocks = 0
        for k, kind in enumerate(("<u8", "<u4", "u1", "<u2")):
            part = np.concatenate([x[k] for x in self.index]).astype(kind) if self.index else np.zeros(0, kind)
            blocks = len(part)
            columns.append(part)
        for column in columns:
            self.out.write(column.tobytes())
        self.out.write(np.array([len(self.docs), blocks, self.ids, self.at], "<u8").tobytes() + MAGIC)
        self.out.close()


class TokenFile:
    """Reads a file: ``docs`` (ids, null marks, numbers of ids), ``ids(first, n)`` any range of ids."""

    def __init__(self, path: str):
        fs, place = _file_system(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(36, size - 36)
        if bytes(tail[-4:]) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n_docs, n_blocks, self.n_ids, at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        table = self.file.read_at(size - 36 - at, at)
        self.end, columns, where = at, [], 0
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<u2", n_blocks)):
            columns.append(np.frombuffer(table, kind, n, where))
            where += n * np.dtype(kind).itemsize
        self.docs, (self.starts, self.least, self.widths, self.exceptions) = columns[:3], columns[3:]

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from position ``first``; only their blocks are read."""
        if n == 0:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-(first + n) // BLOCK)
        begin = int(self.starts[a])
        stop = int(self.starts[b]) if b < len(self.starts) else self.end
        data = np.frombuffer(self.file.read_at(stop - begin, begin), "u1")
        offsets = self.starts[a:b].astype(np.int64) - begin
        out = np.empty((b - a, BLOCK), np.uint32)
        for width in np.unique(self.widths[a:b]):
            own = np.flatnonzero(self.widths[a:b] == width)
            size = int(width) * BLOCK // 8
            raw = data[offsets[own][:, None] + np.arange(size)] if size else np.zeros((len(own), 0), "u1")
            out[own] = unpack(np.ascontiguousarray(raw).view("<u4"), int(width))
        for i in np.flatnonzero(self.exceptions[a:b]):
            k, width = int(self.exceptions[a + i]), int(self.widths[a + i])
            at = int(offsets[i]) + width * BLOCK // 8
            places = np.frombuffer(data[at:at + 2 * k].tobytes(), "<u2")
            out[i, places] |= np.frombuffer(data[at + 2 * k:at + 6 * k].tobytes(), "<u4") << np.uint32(width)
        out += self.least[a:b, None]
        return out.reshape(-1)[first - a * BLOCK:first - a * BLOCK + n]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, int]]:
        """(id, number of ids, crc32 of the ids) of each document, decoded a bounded run of blocks at a time."""
        begin, held, at = 0, np.zeros(0, np.uint32), 0
        for doc_id, null, n in zip(*self.docs, strict=True):
            crc, left = 0, int(n)
            while left:
                if at == len(held):
                    held = self.ids(begin, min(ids_at_once, self.n_ids - begin)).astype("<u4")
                    begin, at = begin + len(held), 0
                take = min(left, len(held) - at)
                crc = zlib.crc32(held[at:at + take].tobytes(), crc)
                at, left = at + take, left - take
            yield None if null else int(doc_id), int(n), crc


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, spaces_join: bool = True,
                      percentile: float = 90.0, folder: str | None = None) -> DataFrame:
    """Encode ``doc_id, text`` into files in ascending order of id; one row per file:
    ``path, part, n_docs, n_ids, first_id`` (ids in all files before).

    One range shuffle of the texts.  Each task writes its range to a file of a fresh name
    and reports it; files of tasks that were lost are never named by a row.
    """
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    out = pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = TextEncoder.of(vocabulary, spaces_join), None
        part = TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.pfb"
        for batch in slices(batches, keeps=TextEncoder.kept_as(vocabulary, spaces_join)):
            writer = writer or TokenFileWriter(path, percentile)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "part": part, "n_docs": len(writer.docs), "n_ids": writer.ids}], schema=out)

    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    files = cut_lineage(
        ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
        .mapInArrow(run, "path string, part int, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; a task reads whole files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["first_id"], []
                for doc_id, n, crc in TokenFile(row["path"]).documents():
                    rows.append((doc_id, start, n, crc))
                    start += n
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        files.select("path", "first_id").repartition(tasks)
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
