"""N-gram Jaccard self-join: which texts are near-duplicates, exactly, and their groups.

A size-aware heavy-light join.  Texts become sets of hashed word shingles, equal sets one
class.  Sets up to a boundary are light: every subset that a partner could share (few
elements may be missing) is enumerated as a key.  Larger sets are heavy: they are looked
up in inverted lists.  A list of one shingle would hold every text with a widespread
passage, so lists are kept per part of a set: the hash space is cut into more parts than
two similar sets can have differences, hence at least one part agrees as a whole, and its
content is the list's key.  How many parts that takes depends on the size, so sizes are
banded and a set enters the bands of all possible partners.  The boundary between light
and heavy is where the keys of all sets together are fewest.

No pairs of a list are written out.  Every list has a hub, its member with most company.
First every set is compared with one hub only, that with most company among its lists'.
Lists whose members these links join into one group are done.  In the others, hub and
members are compared; members that are similar to the hub or already in its group
need no comparison among themselves.  The others are compared with those of the star
that have about as many shingles, in tiles of bounded size.

Every set has a sketch: as many bits as it has elements, or up to twice as many; an
element flips one.  Bits that differ between two sketches come from elements that one set
lacks, so they bound the similarity from above.  Sketches, a 24th to a 48th of a large set in bytes,
go to all comparisons; sets only to those that the bound leaves possible.  There they are
compared exactly, in tiles as matrix products, which hand on only links that join something
new.  Groups are found by spreading the smallest id along the links.

Edge cases: null texts and texts without words have no shingles and are linked with
nothing.  Texts with fewer words than a shingle are one shingle as a whole.  Rows with the
same id are one node.  A row without id gets a component only from rows with ids.  Empty
tables give an empty result.  Only ``doc_id`` and ``text`` are read.  Shingles are told
apart by 64-bit hashes, and where sets are compared by 48 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut_lineage, perhaps_within, slices, small_batches, text_bytes, without

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_NO_ID = 1 << 62
_REMEMBERED = 150_000
_BAND = 1.35
_BITS = 1 << 26
#: Most sets of a tile's two sides, and most elements in them.
_TILE_ASKING, _TILE_ALL = 512, 4096
_ASKING_ELEMENTS, _ALL_ELEMENTS = 150_000, 600_000
_U = np.uint64
#: An odd factor per place of a word in a shingle.
_FACTORS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, _U))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, or of all words if they are fewer."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, _U)
    codes = np.fromiter(map(_WORDS.__getitem__, found), _U, len(found))
    n = len(codes) - words + 1
    width = max(1, n)
    out = np.full(width, min(len(codes), words), _U)
    for k in range(min(words, len(codes))):
        out += codes[k:k + width] * _FACTORS[k]
    return np.unique(_mix(out))


def packed_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: what travels to be compared."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of elements per bucket; 64 buckets, or the first power of two from the set's size on."""
    buckets = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    at = ((hashes >> _U(16)) & _U(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, words: int) -> np.ndarray:
    """A sketch as 64-bit numbers, brought to ``words`` of them: the sketch that so many buckets give."""
    out = np.frombuffer(data, "<u8")
    while len(out) > words:
        out = out[:len(out) // 2] ^ out[len(out) // 2:]
    return out


def possible(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of sketches ``a`` (one per row, broadcast against ``b``) may be of similar sets.

    Sets that differ in more than (100 - p) / (100 + p) of their sizes' sum aren't similar, and they
    differ in one element at least per bit that differs.
    """
    differ = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    for k in range(a.shape[-1]):
        differ += np.bitwise_count(a[..., k] ^ b[..., k])
    return (100 + percent) * np.maximum(differ, np.abs(size_a - size_b)) <= (100 - percent) * (size_a + size_b)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


class Scheme:
    """Which keys a set of a given size has, for similarity of ``percent`` hundredths."""

    def __init__(self, percent: int, boundary: int):
        self.percent, self.boundary = percent, boundary
        self.bands: list[tuple[int, int]] = []
        self.cuts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

    def missing(self, size: int) -> int:
        """Elements of a set that a similar one may lack."""
        return size * (100 - self.percent) // 100

    def subsets(self, size: int) -> int:
        return sum(comb(size, j) for j in range(self.missing(size) + 1))

    def bands_of(self, size: int) -> list[tuple[int, int]]:
        """(first size, first size beyond) of the bands in which a partner may be the larger set."""
        while not self.bands or self.bands[-1][0] * self.percent <= 100 * size:
            low = self.bands[-1][1] if self.bands else self.boundary + 1
            self.bands.append((low, max(low + 1, int(low * _BAND))))
        return [b for b in self.bands if b[0] * self.percent <= 100 * size < 100 * b[1]]

    def parts(self, band: tuple[int, int]) -> tuple[int, int]:
        """Number of parts, and how many of them may be empty in a set without harm."""
        differences = 2 * (band[1] - 1) * (100 - self.percent) // (100 + self.percent)
        spare = -(-(differences + 1) // 10) + 2
        return differences + 1 + spare, spare

    def cut(self, band: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Borders of a band's parts in hash space, a number that tells each part apart, spare parts."""
        if band not in self.cuts:
            parts, spare = self.parts(band)
            edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(_U)
            self.cuts[band] = edges, _mix(np.arange(parts, dtype=_U) + _U(band[0] << 20)), spare
        return self.cuts[band]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        size = len(hashes)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(hashes + _U(1)))])
        out = []
        if 0 < size <= self.boundary:
            out.append(self._subset_keys(np.diff(sums), sums[-1]))
        for band in self.bands_of(size) if size else ():
            edges, salt, spare = self.cut(band)
            at = np.concatenate([[0], np.searchsorted(hashes, edges), [size]])
            empty = at[1:] == at[:-1]
            own = _mix(sums[at[1:]] - sums[at[:-1]] + salt)
            out.append(own[~empty] if empty.sum() <= spare else own)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)

    def _subset_keys(self, mixed: np.ndarray, total: np.uint64) -> np.ndarray:
        """Keys of the subsets that lack up to ``missing`` elements: the sum without theirs."""
        level, last, out = np.array([total], _U), np.array([-1]), [np.array([total], _U)]
        n = len(mixed)
        for _ in range(self.missing(n)):
            level = np.concatenate([level[last < i] - mixed[i] for i in range(n)])
            last = np.concatenate([np.full((last < i).sum(), i) for i in range(n)])
            out.append(level)
        return _mix(np.concatenate(out) ^ _U(0x5851F42D4C957F2D))

    @classmethod
    def by_cost(cls, percent: int, sizes: dict[int, int], largest: int = 24) -> "Scheme":
        """The boundary with the fewest keys; ``sizes``: sets per size, up to twice ``largest``."""
        def cost(boundary: int) -> int:
            scheme = cls(percent, boundary)
            return sum(n * ((scheme.subsets(s) if s <= boundary else 0) + sum(
                scheme.parts(b)[0] for b in scheme.bands_of(s))) for s, n in sizes.items())

        return cls(percent, min(range(largest + 1), key=lambda b: (cost(b), b)))


def _texts(docs: DataFrame) -> DataFrame:
    """``node, text, doc_id``: rows of an id are one node, rows without id one per text, in a far corner of the numbers."""
    doc_id = F.col("doc_id").cast("long")
    node = F.coalesce(doc_id, F.lit(_NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    return docs.select(node.alias("node"), text_bytes().alias("text"), doc_id.alias("doc_id"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, doc_id, n_shingles, key``: size and 128-bit hash of each row's set."""
    out = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_key, sets), pa.binary())], schema=out)

    return texts.mapInArrow(run, "node long, doc_id long, n_shingles long, key binary")


def _lists(texts: DataFrame, words: int, scheme: Scheme, slots: int) -> DataFrame:
    """``list, node``: the members of every key that two nodes or more share.

    Keys travel in blocks: a task sorts the keys of many sets into slots, and each slot is
    put together elsewhere.  A slot has some hundred thousand keys, whatever the input.
    """
    blocks = pa.schema([("slot", pa.int64()), ("keys", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary())])
    out = pa.schema([("list", pa.int64()), ("node", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 22):
            nodes = batch.column(0).to_numpy()
            own = [scheme.keys(shingles(t, words)) for t in batch.column(1).to_pylist()]
            keys, at = np.concatenate(own), np.repeat(np.arange(len(own), dtype="<u4"), [len(k) for k in own])
            slot = (keys >> _U(32)) % _U(slots)
            order = np.argsort(slot, kind="stable")
            keys, at, slot = keys[order], at[order], slot[order]
            cuts = np.flatnonzero(np.diff(slot)) + 1
            rows = []
            for k, a in zip(np.split(keys, cuts), np.split(at, cuts), strict=True) if len(keys) else ():
                used, short = np.unique(a, return_inverse=True)
                rows.append({"slot": int(k[0] >> _U(32)) % slots, "keys": k.tobytes(),
                             "at": short.astype("<u4").tobytes() if len(used) > 65536 else short.astype("<u2").tobytes(),
                             "nodes": nodes[used].astype("<i8").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=blocks)

    def gather(table: pa.Table) -> pa.Table:
        keys, nodes = [], []
        for k, a, n in zip(*(table[c].to_pylist() for c in ("keys", "at", "nodes")), strict=True):
            keys.append(np.frombuffer(k, "<u8"))
            wide = len(a) == 4 * len(keys[-1])
            nodes.append(np.frombuffer(n, "<i8")[np.frombuffer(a, "<u4" if wide else "<u2")])
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, nodes = keys[shared], nodes[order][shared]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        if len(keys):
            keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
            keys, nodes = keys[keep], nodes[keep]
            _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            keys, nodes = keys[n[at] > 1], nodes[n[at] > 1]
        return pa.table([keys.view(np.int64), nodes], schema=out)

    return texts.mapInArrow(deal, "slot long, keys binary, at binary, nodes binary").groupBy("slot").applyInArrow(
        gather, "list long, node long")


def _members(lists: DataFrame) -> DataFrame:
    """``list, n, hub, company, node``: each list's members beside its hub, the member that shares most lists with most others.

    ``n``: members of the list, the hub included; ``company``: that of the hub.
    """
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"))
    sized = lists.join(sizes, "list")
    company = sized.groupBy("node").agg(F.sum(F.col("n") - 1).alias("company"))
    ranked = cut_lineage(sized.join(company, "node"))
    hubs = ranked.groupBy("list").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("best")).select(
        "list", (-F.col("best.minus")).alias("hub"), F.col("best.company").alias("company"))
    return ranked.drop("company").join(hubs, "list").filter("node <> hub").select("list", "n", "hub", "company", "node")


def _first_hubs(members: DataFrame) -> DataFrame:
    """``hub, node``: of each node's hubs that with most company.  A hub has more than its node, so the edges make no circle."""
    best = F.max(F.struct("company", (-F.col("hub")).alias("minus"))).alias("best")
    return members.groupBy("node").agg(best).select((-F.col("best.minus")).alias("hub"), "node")


def _open_stars(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``hub, node, meets, apart``: the stars of the lists that hold more than one of ``groups`` (``node, component``).

    ``meets``: whether such a list holds a third member, so that the node may have links beside
    that with the hub; ``apart``: whether the node's group isn't the hub's.
    """
    def group(name: str) -> DataFrame:
        return groups.select(F.col("node").alias(name), F.col("component").alias(f"group_of_{name}"))

    edges = members.select("hub", "node").distinct()
    named = edges.join(group("node"), "node", "left").join(group("hub"), "hub", "left")
    apart = cut_lineage(named.filter(
        F.coalesce("group_of_node", "node") != F.coalesce("group_of_hub", "hub")).select("hub", "node"))
    edge = F.xxhash64("hub", "node").alias("edge")
    mixed = cut_lineage(perhaps_within(members.select("list", "hub", "node", edge), "edge", apart.select(edge)).join(
        apart, ["hub", "node"], "left_semi").select("list").distinct())
    stars = perhaps_within(members, "list", mixed).join(mixed, "list", "left_semi").groupBy("hub", "node").agg(
        F.max(F.col("n") > 2).alias("meets"))
    return stars.join(apart.withColumn("found", F.lit(True)), ["hub", "node"], "left").select(
        "hub", "node", "meets", F.col("found").isNotNull().alias("apart"))


def _bit_map(nodes: DataFrame) -> np.ndarray:
    """Bit map of fixed size (8 MB) of a table of one column, ``node``."""
    place = F.pmod(F.xxhash64("node"), F.lit(_BITS))
    maps = nodes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros(_BITS // 8 + 8192, np.uint8)
    for row in maps:  # at most 2049 rows of 4 kB
        at = (row["bucket"] - 1) * 4096 if row["bucket"] > 0 else _BITS // 8
        bits[at:at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def _candidate_sets(texts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``node, size, bits, hashes``: the sets of the nodes and hubs of lists, and of few others.

    These go to the tasks as a bit map of fixed size, so only their sets
    are written; what the map lets through by chance is dropped by the joins that follow.
    """
    shared = texts.sparkSession.sparkContext.broadcast(
        _bit_map(members.select("node").unionByName(members.select(F.col("hub").alias("node")))))
    out = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        for batch in slices(batches):
            bucket, bit = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at, mask = np.where(bucket > 0, (bucket - 1) * 4096, _BITS // 8) + bit // 8, np.uint8(1) << (bit % 8).astype(np.uint8)
            chosen = batch.filter(pa.array((every[at] & mask) > 0))
            own = [shingles(t, words) for t in chosen.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                chosen.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(map(sketch, own), pa.binary()),
                pa.array(map(packed_set, own), pa.binary())], schema=out)

    place = F.pmod(F.xxhash64("node"), F.lit(_BITS))
    placed = texts.withColumn("place", place).select(
        "node", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"), "text")
    return placed.mapInArrow(run, "node long, size long, bits binary, hashes binary")


def _edge_ends(stars: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Star edges with ``columns`` of the hub's row of ``sets`` (named ``hub_...``) and of the node's.

    Merge joins at every size: a set travels twice, once to its hubs; sets outside the stars don't.
    """
    of_hub = perhaps_within(sets.select("node", *columns), "node", stars.select("hub")).select(
        F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in columns))
    of_node = perhaps_within(sets.select("node", *columns), "node", stars.select("node"))
    members = stars.select("hub", "node").hint("merge").join(of_node, "node")
    return of_hub.hint("merge").join(members, "hub").select("hub", "node", *(f"hub_{c}" for c in columns), *columns)


def _linked(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``hub, node``: the star edges whose two sets are similar."""
    out = pa.schema([("hub", pa.int64()), ("node", pa.int64())])

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m = (batch.column(k).to_numpy() for k in (2, 4))
            keep = []
            for a, b, x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), n, m, strict=True):
                words = min(len(a), len(b)) // 8
                keep.append(bool(possible(folded(a, words), x, folded(b, words), y, percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 25):
            keep = []
            for a, b in zip(*(map(unpacked_set, batch.column(k).to_pylist()) for k in (2, 3)), strict=True):
                common = int(np.isin(a, b, assume_unique=True).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=out).filter(pa.array(keep, pa.bool_()))

    left = cut_lineage(_edge_ends(stars, sets, "size", "bits").mapInArrow(by_sketch, "hub long, node long"))
    return _edge_ends(left, sets, "hashes").mapInArrow(by_set, "hub long, node long")


def _spanning(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """The pairs that join what no earlier pair has joined."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Links between the asking and the other nodes of a tile: their sets as a matrix of the shared elements."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    asks = table["asks"].to_numpy()
    nodes, sets = table["node"].to_numpy(), [unpacked_set(x) for x in table["hashes"].to_pylist()]
    sides = [np.flatnonzero(asks), np.flatnonzero(~asks)]
    if not len(sides[0]) or not len(sides[1]):
        return schema.empty_table()
    elements = [np.concatenate([sets[i] for i in side]) for side in sides]
    columns = np.intersect1d(*elements)
    sizes = [np.array([len(sets[i]) for i in side]) for side in sides]
    entries = []
    for side, found, n in zip(sides, elements, sizes, strict=True):
        at = np.searchsorted(columns, found)
        own = columns[np.minimum(at, max(0, len(columns) - 1))] == found if len(columns) else np.zeros(len(found), bool)
        entries.append((np.repeat(np.arange(len(side)), n)[own], at[own]))
    common, width = np.zeros((len(sides[0]), len(sides[1])), np.float32), 2048
    for start in range(0, len(columns), width):
        blocks = []
        for side, (row, at) in zip(sides, entries, strict=True):
            block, own = np.zeros((len(side), width), np.float32), (at >= start) & (at < start + width)
            block[row[own], at[own] - start] = 1
            blocks.append(block)
        common += blocks[0] @ blocks[1].T
    common = np.rint(common).astype(np.int64)
    linked = (common > 0) & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common))
    names, at = np.unique(nodes, return_inverse=True)
    i, j = np.nonzero(linked)
    found = _spanning([(at[sides[0][i]], at[sides[1][j]])], len(names))
    return pa.table([pa.array([int(names[x]) for x, _ in found], pa.int64()), pa.array([int(names[y]) for _, y in found], pa.int64())], schema=schema)


def _sketch_tile(table: pa.Table, percent: int) -> pa.Table:
    """The rows of a tile that may be similar to one of the other side that isn't in their group."""
    asks, sizes, group = (table[c].to_numpy() for c in ("asks", "size", "group"))
    bits = table["bits"].to_pylist()
    width = np.array([len(b) // 8 for b in bits])
    keep = np.zeros(len(bits), bool)
    # Sketches come in powers of two: each pair of widths is compared at the smaller.
    for wide_a in np.unique(width[asks]):
        for wide_b in np.unique(width[~asks]):
            words = int(min(wide_a, wide_b))
            i, j = np.flatnonzero(asks & (width == wide_a)), np.flatnonzero(~asks & (width == wide_b))
            b = np.stack([folded(bits[x], words) for x in j])
            for part in np.array_split(i, -(-len(i) // 64)):
                a = np.stack([folded(bits[x], words) for x in part])
                near = possible(a[:, None], sizes[part, None], b[None], sizes[None, j], percent) & (group[part, None] != group[None, j])
                keep[part] |= near.any(1)
                keep[j] |= near.any(0)
    return table.select(["hub", "ring", "i", "j", "node", "asks"]).filter(pa.array(keep))


def _rest(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links inside the stars that don't touch the hub; ``stars`` (``hub, node, group, asks``) holds the nodes
    that may have links there.

    Nodes that are neither linked with the hub nor of its group ask.  Sets of
    similar sizes only can be similar, so asking nodes visit their own ring of sizes and the rings beside it,
    where the others stay.  Tiles are blocks of asking nodes against blocks of others,
    bounded in sets and in elements, so that few large or many small sets fill one alike.
    Sketches go to the tiles first; then the sets of the nodes that may have a link in a tile.
    """
    # Rings are wider than the ratio of similar sizes by far more than a double's error.
    ring = F.floor(F.ln("size") / (np.log(100 / percent) + 1e-6)).cast("int")
    wanted = perhaps_within(sets.select("node", "size", "bits"), "node", stars.select("node"))
    every = cut_lineage(stars.hint("merge").join(wanted, "node").withColumn("ring", ring))
    beside = F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)
    # A ring that holds the asking node only has no one to ask.
    asks = every.filter("asks").select("hub", "node", "group", "size", "bits", F.col("ring").alias("own"), F.explode(beside).alias("ring"))

    def blocks(sets: int, elements: int) -> Column:
        return F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("size") / elements))

    met = every.groupBy("hub", "ring").agg(F.count("*").alias("n"), blocks(_TILE_ALL, _ALL_ELEMENTS).alias("all"))
    asks = asks.join(met, ["hub", "ring"]).filter((F.col("n") > 1) | (F.col("ring") != F.col("own")))
    asked = asks.groupBy("hub", "ring").agg(blocks(_TILE_ASKING, _ASKING_ELEMENTS).alias("asking"))
    place = F.xxhash64("node")
    asking = asks.join(asked, ["hub", "ring"]).withColumn("i", F.pmod(place, "asking")).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    others = every.join(met, ["hub", "ring"]).join(asked, ["hub", "ring"]).withColumn("j", F.pmod(place, "all")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)))
    tile = ["hub", "ring", "i", "j"]
    columns = [*tile, "node", "group", "size", "bits"]
    sketched = asking.select(*columns, F.lit(True).alias("asks")).unionByName(others.select(*columns, F.lit(False).alias("asks")))
    placed = cut_lineage(sketched.groupBy(*tile).applyInArrow(
        lambda t: _sketch_tile(t, percent), "hub long, ring int, i long, j long, node long, asks boolean"))
    return placed.hint("merge").join(perhaps_within(sets.select("node", "hashes"), "node", placed.select("node")), "node").groupBy(
        *tile).applyInArrow(lambda t: _tile(t, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: smallest node reachable along ``a, b`` links.

    Every round takes the smallest label among the neighbours and then that label's own
    label, so chains shrink by half and more; rounds end when nothing changes.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b").groupBy("a").agg(
            F.min("of_b").alias("of_b")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.least("label", "of_b").alias("lower"), F.col("label").alias("before"))
        step = lower.join(labels.select(F.col("node").alias("lower"), F.col("label").alias("of_lower")), "lower", "left").select(
            "node", F.least("lower", "of_lower").alias("label"), "before")
        step = cut_lineage(step)
        if step.filter("label <> before").limit(1).count() == 0:
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document, groups by similarity of ``percent`` hundredths."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    texts = _texts(docs)
    every = cut_lineage(shingle_sets(texts, words))
    classes = cut_lineage(every.filter("n_shingles > 0").groupBy("key").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n")))
    largest = 24
    histogram = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= 2 * largest).groupBy("n").count().collect()}
    scheme = Scheme.by_cost(percent, histogram, largest)
    volume = classes.agg(F.coalesce(F.sum(F.col("n") * 0.4 + 10), F.lit(0.0))).first()[0]
    # Copies are spared: only the texts of each class's smallest node, and of few others, have keys.
    copies = cut_lineage(every.select("node").join(classes.select("node"), "node", "left_anti").distinct())
    single = without(texts.select("node", "text"), "node", copies)
    lists = cut_lineage(_lists(single, words, scheme, max(64, int(volume / 4e5))))
    members = cut_lineage(_members(lists))
    sets = _candidate_sets(single, members, words)
    repeated = every.join(classes.select("node"), "node", "left_semi").groupBy("node").count().filter("count > 1")
    if repeated.limit(1).count():  # rows with the same id: their sets are wanted once
        sets = sets.distinct()
    sets = cut_lineage(sets)
    hubs = cut_lineage(_first_hubs(members))
    first = cut_lineage(_linked(hubs, sets, percent))
    groups = components(first.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    stars = cut_lineage(_open_stars(members, groups))
    later = cut_lineage(_linked(cut_lineage(stars.join(hubs, ["hub", "node"], "left_anti")), sets, percent))
    near = first.unionByName(later)
    grouped = groups.select("node", F.col("component").alias("group"))
    meeting = stars.filter("meets").join(near.withColumn("near", F.lit(True)), ["hub", "node"], "left").join(grouped, "node", "left").select(
        "hub", "node", F.coalesce("group", "node").alias("group"), (F.col("near").isNull() & F.col("apart")).alias("asks"))
    links = near.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(_rest(cut_lineage(meeting), sets, percent))
    # A group's name is its smallest id; nodes of rows without id have none.
    grouped = classes.join(components(links), "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = grouped.select("key", "component").join(names, "component").select("key", "component_id")
    return every.join(of_class, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
