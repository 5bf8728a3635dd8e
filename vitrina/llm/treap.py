"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are cut into blocks.  The grid of a block has a row per term (by falling
document frequency) and a column per document (by rising length); a cell holds the impact of
the term in the document.  The grid is kept as a quadtree: per non-empty square, level by
level, four bits say which quarters are non-empty (children are found by counting bits) and a
number the largest impact inside, stored as its distance from the parent's.  A search
descends the row paths of all terms of an item together: a range of documents holds one
square per term, its bound is the weighted sum of their maxima, and ranges are opened by
falling bound until none can reach the tenth best score.  At single documents the bound is
the score, so results are exact.

Three passes: token counts of the corpus (N and L), the blocks, written as a table, and the
search.  Weights come from document frequencies that the blocks state per term.  Items are
searched in portions of at most ``portion`` item terms, which reach the tasks as part of
their function; the blocks are read once per portion.

Edge cases: null and empty texts have no terms and are in no result.  Items without known
terms have no rows.  Rows of ``items`` that share an id (or have none) are one item with the
terms of all of them.  Repeated rows and equal ids of documents are documents of their own;
a null ``doc_id`` ranks after others of equal score.  A block is closed at ``block_docs``
documents or ``block_terms`` terms with repeats, so one very long text is a block of its own; its
tokens are taken in pieces.  Empty tables give an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import cut_lineage, slices, small_batches, text_bytes

#: A term: a longest run of ASCII letters and digits and of all other characters from U+0080 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text to lower case and all that is in no term to blanks; bytes from 0x80 on belong to terms.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20
BLOCK_DOCS, BLOCK_TERMS, PORTION = 1 << 14, 1 << 21, 100_000
#: Ranges of documents opened at a time.
OPENED = 48
#: Per set of non-empty quarters and quarter: how many children stand before it, or none.
_BEFORE = np.array([[bin(mask & ((1 << q) - 1)).count("1") if mask >> q & 1 else -1 for q in range(4)] for mask in range(16)], np.int32)
_BITS = np.array([bin(mask).count("1") for mask in range(16)], np.int8)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded length."""
    start, end = 0, len(text)
    while start < end:
        piece = text[start:start + _PIECE].translate(_BYTES)
        # A piece ends where no term goes on; a term longer than a piece is taken whole.
        while start + len(piece) < end and (cut := piece.rfind(b" ")) < 0:
            piece += text[start + len(piece):start + len(piece) + _PIECE].translate(_BYTES)
        if start + len(piece) < end:
            piece = piece[:cut + 1]
        yield piece.split()
        start += len(piece)


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score but for its weight: saturated frequency, in integers."""
    m = 100 - 90 + (90 * lengths * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Treap:
    """A K2-treap: ``side`` levels, and per level the quarters (``masks``) and maxima (``tops``) of its squares.

    Squares of all levels are numbered through, level by level in Morton order, from 1; 0 stands for an empty square.
    """

    def __init__(self, side: int, masks: np.ndarray, tops: np.ndarray):
        self.side = side
        self.masks = np.concatenate([np.zeros(1, np.uint8), masks])
        self.tops = np.concatenate([np.zeros(1, np.int32), tops])
        # Children follow in order: the first child of a square comes after the root and all children of squares before.
        counts = _BITS[self.masks]
        self.first = 2 + np.cumsum(counts, dtype=np.int32) - counts

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> "Treap":
        side = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.uint64)
        for bit in range(side):
            code |= ((rows.astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit + 1)
            code |= ((columns.astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int32)
        masks, tops = [np.zeros(len(code), np.uint8)], [top]
        for _ in range(side):
            parent = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(code) else np.zeros(0, np.int64)
            quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(quarter, starts) if len(code) else quarter)
            top = np.maximum.reduceat(top, starts) if len(code) else top
            tops.append(top)
            code = parent[starts]
        return cls(side, np.concatenate(masks[::-1]), np.concatenate(tops[::-1]))

    def to_bytes(self) -> bytes:
        """Masks, then distances of maxima from those of the parents, compressed."""
        above = np.repeat(self.tops[1:], _BITS[self.masks[1:]])
        gaps = np.concatenate([-self.tops[1:2], above - self.tops[2:]])
        head = np.array([self.side, len(gaps)], "<i8").tobytes()
        return head + pa.compress(self.masks[1:].tobytes() + gaps.astype("<i4").tobytes(), codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Treap":
        side, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
        raw = pa.decompress(data[16:], decompressed_size=5 * n, codec="zstd", asbytes=True)
        masks, gaps = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i4", n, offset=n)
        out = cls(side, masks, np.zeros(n, np.int32))
        tops, start, size = out.tops, 1, min(1, n)
        tops[1:2] = -gaps[:1]
        for _ in range(side):
            kids = _BITS[out.masks[start:start + size]]
            below = int(kids.sum())
            tops[start + size:start + size + below] = np.repeat(tops[start:start + size], kids) - gaps[start + size - 1:start + size - 1 + below]
            start, size = start + size, below
        return out

    def search(self, rows: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of at least the ``k`` best columns for the weighted ``rows``, all of them with ``least`` or more."""
        side = self.side
        squares = np.ones((1, len(rows)), np.int64)
        bound, level, column = np.array([int(weights.sum()) * int(self.tops[1])]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            if len(bound) > OPENED:
                best = np.argpartition(-bound, OPENED)
                now, later = best[:OPENED], best[OPENED:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            open_, at = squares[now], level[now]
            row_bit = (rows[None, :] >> (side - 1 - at)[:, None]) & 1
            mask, first = self.masks[open_], self.first[open_]
            made = []
            for half in (0, 1):
                before = _BEFORE[mask, 2 * row_bit + half]
                child = np.where(before < 0, 0, first + before)
                made.append((child, self.tops[child].astype(np.int64) @ weights, at + 1, 2 * column[now] + half))
            child, total, deep, place = (np.concatenate([a, b]) for a, b in zip(*made, strict=True))
            alive = total >= max(1, least)
            ends = alive & (deep == side)
            if ends.any():
                columns, scores = np.concatenate([columns, place[ends]]), np.concatenate([scores, total[ends]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    columns, scores = columns[scores >= least], scores[scores >= least]
            alive &= (deep < side) & (total >= least)
            later = later[bound[later] >= least]
            squares = np.concatenate([squares[later], child[alive]])
            bound, level, column = (
                np.concatenate([old[later], new[alive]]) for old, new in ((bound, total), (level, deep), (column, place)))
        return columns, scores


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, documents with at least one term, and L, all terms with repeats."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return int(row["docs"]), int(row["terms"])


INDEX = "terms array<binary>, df array<int>, doc_ids array<long>, treap binary"


def build_index(docs: DataFrame, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per block: its terms in row order with their document frequencies, its ids in column order, its treap."""
    out = pa.schema([("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("treap", pa.binary())])

    def block(words: dict[bytes, int], ids: list, sizes: list[int], cells: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        cell, tf = np.concatenate(cells), np.concatenate(counts)
        term, doc, length = cell & 0xFFFFFFFF, cell >> 32, np.array(sizes, np.int64)
        df = np.bincount(term, minlength=len(words))
        by_df, by_length = np.argsort(-df, kind="stable"), np.argsort(length, kind="stable")
        row, column = np.empty(len(df), np.int64), np.empty(len(length), np.int64)
        row[by_df], column[by_length] = np.arange(len(df)), np.arange(len(length))
        treap = Treap.build(row[term], column[doc], impacts(tf, length[doc], n_docs, n_terms))
        names = list(words)
        return pa.RecordBatch.from_arrays([
            pa.array([[names[i] for i in by_df.tolist()]], out.field(0).type), pa.array([df[by_df].astype(np.int32)], out.field(1).type),
            pa.array([[ids[i] for i in by_length.tolist()]], out.field(2).type), pa.array([treap.to_bytes()], pa.binary())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty():
            return defaultdict(itertools.count().__next__), [], [], [], []

        words, ids, sizes, cells, counts = empty()
        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = [np.array(list(map(words.__getitem__, found)), np.int64) for found in terms(text.as_py()) if found]
                if not parts:
                    continue
                numbers, tf = np.unique(np.concatenate(parts), return_counts=True)
                cells.append(numbers | len(ids) << 32)
                counts.append(tf)
                sizes.append(int(tf.sum()))
                ids.append(doc_id)
                held += sizes[-1]
                if len(ids) >= block_docs or held >= block_terms:
                    yield block(words, ids, sizes, cells, counts)
                    words, ids, sizes, cells, counts = empty()
                    held = 0
        if ids:
            yield block(words, ids, sizes, cells, counts)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame, item_id: str) -> DataFrame:
    """``item_id, term``: the distinct terms of each item."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    found = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0)))
    return items.select(F.col(item_id).alias("item_id"), found.alias("term")).select("item_id", F.col("term").cast("binary").alias("term")).distinct()


def term_weights(index: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """``item_id, term, weight`` for the item terms that occur in a document and weigh something."""
    stated = index.select(F.explode(F.arrays_zip("terms", "df")).alias("s")).select(F.col("s.terms").alias("term"), F.col("s.df").alias("df"))
    found = stated.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return wanted.join(found.select("term", weight.alias("weight")), "term").filter("weight > 0").select("item_id", "term", "weight")


def search_index(index: DataFrame, weighted: DataFrame, k: int = 10, portion: int = PORTION) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    weighted = cut_lineage(weighted)
    portions = max(1, -(-weighted.count() // portion))
    place = F.pmod(F.xxhash64("item_id"), F.lit(portions))
    found = None
    for number in range(portions):
        # An item's terms stay together; hence the portions differ in size by about one item.
        mine = defaultdict(dict)
        for r in weighted.filter(place == number).collect():
            mine[r["item_id"]][bytes(r["term"])] = r["weight"]
        part = _search_portion(index, dict(mine), k, weighted.schema["item_id"].dataType.simpleString())
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_portion(index: DataFrame, items: dict, k: int, kind: str) -> DataFrame:
    """The ``k`` best documents per item of what each task reads; a task's k-th best score spares later blocks work."""
    every = sorted({term for words in items.values() for term in words})
    number = {term: i for i, term in enumerate(every)}
    asked = [
        (item, np.array([number[t] for t in words], np.int64), np.array(list(words.values()), np.int64)) for item, words in items.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        known = pa.array(every, pa.binary())
        for batch in batches:
            for b in range(batch.num_rows):
                row_of = np.full(len(every), -1, np.int64)
                at = pc.index_in(known, value_set=batch.column(0)[b].values)
                filled = at.is_valid().to_numpy(zero_copy_only=False)
                row_of[filled] = at.drop_null().to_numpy(zero_copy_only=False)
                doc_ids = batch.column(1)[b].as_py()
                treap = Treap.from_bytes(batch.column(2)[b].as_py())
                for slot, (_, words, weights) in enumerate(asked):
                    rows = row_of[words]
                    here = rows >= 0
                    if not here.any():
                        continue
                    least = best[slot][-1][0] if len(best[slot]) >= k else 1
                    columns, scores = treap.search(rows[here], weights[here], least, k)
                    if len(columns):
                        best[slot] += [(s, doc_ids[c]) for c, s in zip(columns.tolist(), scores.tolist(), strict=True)]
                        best[slot] = sorted(best[slot], key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
        found = [(asked[slot][0], doc_id, score) for slot, rows in enumerate(best) for score, doc_id in rows]
        if found:
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item_id", "doc_id", "score"])

    return index.select("terms", "doc_ids", "treap").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", k: int = 10, block_docs: int = BLOCK_DOCS,
                  block_terms: int = BLOCK_TERMS, portion: int = PORTION) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs`` with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs)
    with small_batches(spark):
        index = cut_lineage(build_index(docs, n_docs, n_terms, block_docs, block_terms))
    weighted = term_weights(index, item_terms(items, item_id), n_docs)
    with small_batches(spark, 1):
        return cut_lineage(search_index(index, weighted, k, portion))
