"""Removal of byte strings that occur elsewhere, by a sparse suffix sort.

A byte goes if it lies in a string of ``length`` bytes that starts at two places or more.
Texts are bytes; strings never cross texts.

Every window of ``length`` bytes has an anchor: the position of the smallest hash among its
``gram``-byte strings, the leftmost of equals.  The anchor depends on the window's content
only, so equal windows have equal anchors at equal distances, and a window can only repeat
if its anchor's string does.  Anchors stand about fifty bytes apart.

1. Anchors are counted by the hash of their string; those that occur once are dropped.
2. Around each other anchor the bytes that its windows can reach are cut out.  Anchors with
   equal surroundings in one task settle each other, and one of them goes on.
3. Anchors with the same string meet.  They are sorted twice, by what follows and by what
   precedes, in a merge sort that compares suffixes through prefix polynomial hashes: a
   binary search finds the common extension of two in a logarithmic number of steps.
   The extensions of neighbours are then checked against the bytes; should a hash have
   lied, the bytes decide.  Runs of long extensions in both orders give the windows that
   are equal.
4. Strings with very many anchors are dealt over groups.  Windows that found no equal in
   their group meet once more by a 128-bit hash of the window.

Copies of whole texts are represented by one of them until the end.

Edge cases: null and empty texts, and texts below ``length`` bytes, lose nothing.  Of equal
texts of ``length`` bytes or more nothing is left.  Rows with one id but different texts are
documents of their own, as are rows without id; they are told apart by a 64-bit hash of id and
text.  Empty tables give an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut_lineage, slices, text_bytes

LENGTH, GRAM = 200, 100
_SLICE = 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BITS = 1 << 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of ``data``, hashes of their strings, first and last window of each."""
    windows, reach = len(data) - length + 1, length - gram + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, _U), none, none
    n = len(data)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_INVERSE, n), dtype=_U)])
    hashes = _mix((sums[gram:] - sums[:n - gram + 1]) * _powers(_BASE, n - gram + 1))
    bits = max(1, int(len(hashes) - 1).bit_length())
    value = (hashes >> _U(bits) << _U(bits)) | np.arange(len(hashes), dtype=_U)
    least, width = value, 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    at = (least & _U((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], hashes[at[first]], first, last


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id, node, sha, text``; node: 64-bit hash of id and text."""
    text = text_bytes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "sha", F.sha2("text", 256)).withColumn("node", F.xxhash64("doc_id", "sha"))


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``node, keys, places``: packed hashes (8 bytes) and positions (4 bytes) of each text's anchors."""
    out = pa.schema([("node", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(np.frombuffer(t, np.uint8), length, gram) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[1].tobytes() for f in found], pa.binary()),
                pa.array([f[0].astype("<u4").tobytes() for f in found], pa.binary())], schema=out)

    return docs.select("node", "text").mapInArrow(run, "node long, keys binary, places binary")


_BLOCK = pa.schema([("slot", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary()), ("at", pa.binary()), ("places", pa.binary())])


def _dealt(keys: np.ndarray, nodes: np.ndarray, places: np.ndarray, slots: int, width: int = 1) -> list[dict]:
    """Blocks of keys (``width`` numbers each), one per slot."""
    lead = keys if width == 1 else keys[:, 0]
    slot = (lead >> _U(32)) % _U(slots)
    order = np.argsort(slot, kind="stable")
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    rows = []
    for own in np.split(order, cuts) if len(order) else ():
        used, short = np.unique(nodes[own], return_inverse=True)
        rows.append({"slot": int(slot[own[0]]), "keys": keys[own].astype("<u8").tobytes(), "nodes": used.astype("<i8").tobytes(),
                     "at": short.astype("<u4").tobytes(), "places": places[own].astype("<u4").tobytes()})
    return rows


def _undealt(table: pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in table["keys"].to_pylist()])
    nodes = np.concatenate([np.frombuffer(n, "<i8")[np.frombuffer(a, "<u4")] for n, a in zip(
        table["nodes"].to_pylist(), table["at"].to_pylist(), strict=True)])
    places = np.concatenate([np.frombuffer(p, "<u4") for p in table["places"].to_pylist()])
    return keys.reshape(-1, width) if width > 1 else keys, nodes, places


def _shared_anchors(packed: DataFrame, slots: int) -> DataFrame:
    """``node, place, times``: anchors whose string occurs ``times`` >= 2 times."""
    out = pa.schema([("node", pa.int64()), ("place", pa.int64()), ("times", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 22):
            keys = [np.frombuffer(k, "<u8") for k in batch.column(1).to_pylist()]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            places = np.concatenate([np.frombuffer(p, "<u4") for p in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_pylist(_dealt(np.concatenate(keys), nodes, places, slots), schema=_BLOCK)

    def gather(table: pa.Table) -> pa.Table:
        keys, nodes, places = _undealt(table)
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        own = n[at] > 1
        return pa.table([nodes[own], places[own].astype(np.int64), n[at[own]]], schema=out)

    return packed.mapInArrow(deal, "slot long, keys binary, nodes binary, at binary, places binary").groupBy("slot").applyInArrow(
        gather, "node long, place long, times long")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes and few others: a bit map of fixed size (8 MB) goes to
    the tasks, so that other texts aren't shuffled."""
    place = F.pmod(F.xxhash64("node"), F.lit(_BITS))
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros(_BITS // 8 + 8192, np.uint8)
    for row in maps:  # at most 2049 rows of 4 kB
        at = (row["bucket"] - 1) * 4096 if row["bucket"] > 0 else _BITS // 8
        bits[at:at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    out = pa.schema([("node", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, bit = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.where(bucket > 0, (bucket - 1) * 4096, _BITS // 8) + bit // 8
            chosen = batch.filter(pa.array((shared.value[at] >> (bit % 8).astype(np.uint8)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(3)], schema=out)

    placed = docs.withColumn("place", place).select(
        "node", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"), "text")
    return placed.mapInArrow(run, "node long, text binary")


_AROUND = ("kind int, node long, begin long, end long, slot long, grp long, hot boolean, place long, first long, last long, "
           "settled boolean, lead int, bytes binary")


def _around(rows: DataFrame, length: int, gram: int, slots: int, hot: int) -> DataFrame:
    """Of ``node, text, found (place, times)``: kind 1 are anchors with their surroundings, kind 0
    byte ranges that are settled because the same surroundings occur again in the task."""
    out = pa.schema([
        ("kind", pa.int32()), ("node", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("slot", pa.int64()),
        ("grp", pa.int64()), ("hot", pa.bool_()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
        ("settled", pa.bool_()), ("lead", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SLICE):
            rows, same = [], {}
            for node, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, keys, first, last = anchors(np.frombuffer(text, np.uint8), length, gram)
                times = {f["place"]: f["times"] for f in found}
                for place, key, a, b in zip(places.tolist(), keys.tolist(), first.tolist(), last.tolist(), strict=True):
                    n = times.get(place)
                    if n is None:
                        continue
                    around = text[a:b + length]
                    # Equal surroundings, cut at the same distances: the windows are equal one by one.
                    known = same.get((key, place - a, around))
                    if known is not None:
                        for k in (known, None):
                            if k is None or not k["settled"]:
                                s, e = (a, b) if k is None else (k["first"], k["last"])
                                rows.append({"kind": 0, "node": node if k is None else k["node"], "begin": s, "end": e + length})
                        known["settled"] = True
                        continue
                    parts = -(-n // hot)
                    group = key if parts == 1 else xxhash.xxh3_64_intdigest(b"%d %d" % (key, node % parts))
                    row = {"kind": 1, "node": node, "slot": (group >> 32) % slots, "grp": group - (1 << 64) if group >> 63 else group,
                           "hot": parts > 1, "place": place, "first": a, "last": b, "settled": False, "lead": place - a, "bytes": around}
                    same[key, place - a, around] = row
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return rows.mapInArrow(run, _AROUND)


class Suffixes:
    """Rows of bytes with prefix polynomial hashes: common extensions by binary search."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes
        n, width = data.shape
        self.sums = np.zeros((n, width + 1), _U)
        np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, width), axis=1, out=self.sums[:, 1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows ``x`` and ``y``: the longest whose hashes agree."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        while (low < high).any():
            middle = (low + high + 1) // 2
            agree = self.sums[x, middle] == self.sums[y, middle]
            low, high = np.where(agree, middle, low), np.where(agree, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether row ``x`` sorts before row ``y`` (or is equal to it)."""
        n = self.extension(x, y)
        end_x, end_y = n == self.sizes[x], n == self.sizes[y]
        at = np.minimum(n, self.data.shape[1] - 1)
        return np.where(end_x | end_y, np.where(end_x & end_y, or_equal, end_x), self.data[x, at] < self.data[y, at])

    def sort(self, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Merge sort inside each group of rows ``begin .. begin + count``; all groups at once."""
        order = np.arange(len(self.data))
        group = np.repeat(np.arange(len(begins)), counts)
        begin, count = begins[group], counts[group]
        width = 1
        while width < counts.max(initial=0):
            at = np.flatnonzero(count > width)
            inside = at - begin[at]
            run = inside // width
            low = np.minimum((run ^ 1) * width, count[at])
            high = np.minimum(low + width, count[at])
            start = low.copy()
            right = run % 2 == 1  # of equals those of the left run stay first
            while (low < high).any():
                busy = np.flatnonzero(low < high)
                middle = (low[busy] + high[busy]) // 2
                other, own = order[begin[at[busy]] + middle], order[at[busy]]
                before = self.less(other, own, right[busy])
                low[busy] = np.where(before, middle + 1, low[busy])
                high[busy] = np.where(before, high[busy], middle)
            target = begin[at] + (run // 2) * 2 * width + inside % width + low - start
            moved = order.copy()
            moved[target] = order[at]
            order, width = moved, 2 * width
        return order

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common extension of each row with the one before in ``order``, from the bytes; whether the hashes agreed."""
        a, b = order[:-1], order[1:]
        high = np.minimum(self.sizes[a], self.sizes[b])
        differ = self.data[a] != self.data[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.data.shape[1])
        exact = np.minimum(first, high)
        return np.concatenate([[0], exact]), bool((exact == self.extension(a, b)).all())


def _order(suffixes: Suffixes, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = suffixes.sort(begins, counts)
    shared, agreed = suffixes.neighbours(order)
    if not agreed:  # a collision: sort the bytes themselves
        rows = [suffixes.data[i, :suffixes.sizes[i]].tobytes() for i in range(len(order))]
        order = np.concatenate([np.array(sorted(range(b, b + c), key=rows.__getitem__), np.int64) for b, c in zip(begins, counts, strict=True)])
        shared, _ = suffixes.neighbours(order)
    shared[begins] = -1
    return order, shared


def equal_windows(groups: np.ndarray, rows: list[bytes], leads: np.ndarray, lasts: np.ndarray,
                  length: int, gram: int) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Per distance of the anchor: the rows with such a window, whether another row of the group
    has it too, and whether the row is the first to have it.

    ``rows``: bytes from a row's first window to the end of its last; ``leads``: distance of
    the anchor from the start; ``lasts``: its distance in the last window.  Sorted by group.
    """
    n, most = len(rows), length - gram
    sizes = np.array([len(r) for r in rows])
    flat = np.frombuffer(b"".join(rows), np.uint8)
    offset = np.cumsum(sizes) - sizes
    after_size = sizes - leads
    after, before = np.zeros((n, length), np.uint8), np.zeros((n, most), np.uint8)
    for k in range(length):
        own = after_size > k
        after[own, k] = flat[offset[own] + leads[own] + k]
    for k in range(most):
        own = leads > k
        before[own, k] = flat[offset[own] + leads[own] - 1 - k]
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    counts = np.diff(np.concatenate([begins, [n]]))
    after_order, after_shared = _order(Suffixes(after, np.minimum(after_size, length)), begins, counts)
    before_order, before_shared = _order(Suffixes(before, np.minimum(leads, most)), begins, counts)
    after_class, before_class = np.empty(n, np.int64), np.empty(n, np.int64)
    out = []
    for distance in range(most + 1):
        own = np.flatnonzero((leads >= distance) & (lasts <= distance))
        if not len(own):
            continue
        after_class[after_order] = np.cumsum(after_shared < length - distance)
        before_class[before_order] = np.cumsum(before_shared < distance)
        _, firsts, at, times = np.unique(
            after_class[own] * (n + 1) + before_class[own], return_index=True, return_inverse=True, return_counts=True)
        leader = np.zeros(len(own), bool)
        leader[firsts] = True
        out.append((own, distance, times[at] > 1, leader))
    return out


_FOUND = pa.schema([("node", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), *list(_BLOCK)])


def _ranges(nodes: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows as byte ranges."""
    order = np.lexsort((starts, nodes))
    nodes, starts = nodes[order], starts[order]
    new = np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (starts[1:] > starts[:-1] + 1)]) if len(nodes) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(nodes) else new
    return {"node": nodes[new], "begin": starts[new], "end": starts[last] + length}


def _meet(table: pa.Table, length: int, gram: int, slots: int, rows_at_once: int = 8192) -> pa.Table:
    """Settle all anchors of a slot; unsettled windows of hot strings go on as blocks of window hashes."""
    order = np.argsort(table["grp"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    groups = table["grp"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.concatenate([begins[1:], [len(groups)]])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    open_rows: list[dict] = []
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + rows_at_once, side="right")))
        part = table.slice(begins[at], ends[to - 1] - begins[at])
        at = to
        node, place, first = (part[c].to_numpy() for c in ("node", "place", "first"))
        leads, lasts = part["lead"].to_numpy().astype(np.int64), place - part["last"].to_numpy()
        hot, rows = part["hot"].to_numpy(zero_copy_only=False), part["bytes"].to_pylist()
        settled = part["settled"].to_numpy(zero_copy_only=False)
        keys, owners, starts = [], [], []
        for own, distance, repeated, leader in equal_windows(part["grp"].to_numpy(), rows, leads, lasts, length, gram):
            start = place[own] - distance
            new = repeated & ~settled[own]
            done.append((node[own[new]], start[new]))
            # Of a hot string, one row for each different window meets the other groups.
            away = leader & hot[own]
            for i, s in zip(own[away].tolist(), start[away].tolist(), strict=True):
                window = rows[i][s - first[i]:s - first[i] + length]
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(window), "<u8"))
                owners.append(node[i])
                starts.append(s)
        if keys:
            open_rows += _dealt(np.array(keys, _U), np.array(owners, np.int64), np.array(starts, np.int64), slots, 2)
    found = _ranges(*(np.concatenate(x) for x in zip(*done, strict=True)), length) if done else {}
    found = [dict(zip(found, x, strict=True)) for x in zip(*(v.tolist() for v in found.values()), strict=True)]
    return pa.Table.from_pylist(found + open_rows, schema=_FOUND)


def _meet_again(table: pa.Table, length: int) -> pa.Table:
    """Windows of hot strings that meet by their hash."""
    keys, nodes, starts = _undealt(table, 2)
    _, at, times = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
    own = times[at.reshape(-1)] > 1
    found = _ranges(nodes[own], starts[own].astype(np.int64), length)
    return pa.table([found["node"], found["begin"], found["end"]], schema=pa.schema(list(_FOUND)[:3]))


def _kept(rows: DataFrame) -> DataFrame:
    """Of ``node, text, ranges``: ``node, n_removed, n_spans, kept, kept_sha256, spans``."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    out = pa.schema([("node", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for node, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans: list[list[int]] = []
                for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append({"node": node, "n_removed": len(text) - len(kept), "n_spans": len(spans),
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept,
                             "spans": [{"begin": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return rows.mapInArrow(run, "node long, n_removed long, n_spans long, kept_sha256 string, "
                                "spans array<struct<begin:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 1000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``: one row per document.

    Strings with more than ``hot`` anchors are dealt over groups of about that size.
    ``kept`` are the remaining bytes where something was removed, else null (all of the text).
    """
    ours = _documents(docs)
    every = cut_lineage(ours.select("doc_id", "node", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    classes = cut_lineage(every.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.min("node").alias("node")))
    slots = max(64, int(every.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] / 5e7))
    packed = _anchor_rows(ours.filter(F.octet_length("text") >= length), length, gram).join(classes.select("node"), "node", "left_semi")
    shared = cut_lineage(_shared_anchors(packed, slots))
    texts = cut_lineage(_texts_of(ours, shared.select("node")).join(
        shared.groupBy("node").agg(F.collect_list(F.struct("place", "times")).alias("found")), "node"))
    around = cut_lineage(_around(texts, length, gram, slots, hot))
    met = cut_lineage(around.filter("kind = 1").select(
        "node", "slot", "grp", "hot", "place", "first", "last", "settled", "lead", "bytes").groupBy("slot").applyInArrow(
        lambda t: _meet(t, length, gram, slots),
        "node long, begin long, end long, slot long, keys binary, nodes binary, at binary, places binary"))
    again = met.filter("keys is not null").select("slot", "keys", "nodes", "at", "places").groupBy("slot").applyInArrow(
        lambda t: _meet_again(t, length), "node long, begin long, end long")
    ranges = around.filter("kind = 0").select("node", "begin", "end").unionByName(
        met.filter("keys is null").select("node", "begin", "end")).unionByName(again)
    single = classes.filter("copies = 1").select("node")
    kept = _kept(texts.select("node", "text").join(single, "node", "left_semi").join(
        ranges.groupBy("node").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "node"))
    copies = classes.filter("copies > 1").select("sha", "copies")
    nothing = F.sha2(F.lit(b""), 256)
    whole = F.col("copies").isNotNull()
    return every.join(copies, "sha", "left").join(kept, "node", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(
            F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>"))).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
