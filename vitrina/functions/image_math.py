"""Arithmetic on decoded image values: hashes, layout, canvas geometry, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET = 2000
PADDING = 0.05
WHITE_MIN_FRACTION = 0.60
TRANSPARENT_COMPOSITE = 0.15


def _let(value: Column, body):
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _bits(flags: Column) -> Column:
    """Array of booleans → 64-bit integer, element i on bit i."""
    shifted = F.transform(
        flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint"))
    )
    return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def _doubles(px: Column) -> Column:
    return px.cast("array<double>")


def average_hash(px: Column) -> Column:
    """Bit i is set when pixel i is at least the mean (64 luminance values)."""
    values = _doubles(px)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return _let(mean, lambda m: _bits(F.transform(values, lambda p: p >= m)))


def difference_hash(px: Column, n: int = 8) -> Column:
    """Bit ``row*n+col`` is set when a pixel is brighter than its right neighbour;
    ``px`` is row-major with ``n + 1`` columns."""
    values = _doubles(px)
    width = n + 1
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(n * n - 1)),
        lambda k: F.get(values, (F.floor(k / n) * width + k % n).cast("int"))
        > F.get(values, (F.floor(k / n) * width + k % n + 1).cast("int")),
    )
    return _bits(flags)


def cosine_basis(side: int, n: int = 8) -> list[list[float]]:
    """First ``n`` rows of the DCT-II basis for a ``side``-point signal."""
    return [[math.cos((math.pi / side) * (x + 0.5) * u) for x in range(side)] for u in range(n)]


def dct_hash(px: Column, side: int = 32, n: int = 8) -> Column:
    """Low-frequency ``n×n`` block of the 2-D DCT; bit set above the median without DC."""
    values = _doubles(px)
    basis = F.array(*[F.array(*[F.lit(c) for c in row]) for row in cosine_basis(side, n)])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    # by_frequency[v][r]: row r projected on frequency v
    by_frequency = F.transform(
        basis,
        lambda c: F.transform(
            F.sequence(F.lit(0), F.lit(side - 1)), lambda r: dot(F.slice(values, r * side + 1, side), c)
        ),
    )
    block = _let(
        by_frequency,
        lambda bf: F.flatten(F.transform(basis, lambda cu: F.transform(bf, lambda row: dot(row, cu)))),
    )
    median_rank = (n * n - 1) // 2 + 1
    return _let(
        block,
        lambda vals: _let(
            F.element_at(F.array_sort(F.slice(vals, 2, n * n - 1)), median_rank),
            lambda med: _bits(F.transform(vals, lambda v: v > med)),
        ),
    )


def layout(width: Column, height: Column, white_ratio: Column, bbox_w: Column, bbox_h: Column,
           force_padding: Column) -> Column:
    """Layout decision as ``struct<decision, use_padding, cropped>``.

    ``force_padding`` is null (decide), true or false.
    """
    white = white_ratio >= WHITE_MIN_FRACTION
    fill_w, fill_h = bbox_w / width, bbox_h / height
    removed = ((width - bbox_w) + (height - bbox_h)) / (width + height)
    tight = (removed <= 0.03) & (white_ratio >= 0.95)
    decision = (
        F.when(force_padding.isNotNull() & force_padding, "forced-padding")
        .when(force_padding.isNotNull() & white, "forced-crop")
        .when(force_padding.isNotNull(), "forced-none")
        .when(~white, "no-padding")
        .when((fill_w > 0.85) & (fill_h > 0.85) & ~tight, "fills-frame")
        .when((fill_w >= 0.98) & ~tight, "fills-width")
        .when(tight, "tight-product-shot")
        .otherwise("padding")
    )
    return F.struct(
        decision.alias("decision"),
        decision.isin("padding", "tight-product-shot", "forced-padding").alias("use_padding"),
        decision.isin("padding", "tight-product-shot", "forced-padding", "fills-width", "forced-crop").alias("cropped"),
    )


def canvas(width: Column, height: Column, use_padding: Column, target: int = TARGET) -> Column:
    """Fit into the box (90 % of the canvas with padding): ``struct<new_w,new_h,off_x,off_y>``."""
    box = F.when(use_padding, F.lit(int(target * (1 - 2 * PADDING)))).otherwise(F.lit(target)).cast("double")
    ratio = width.cast("double") / height
    new_w = F.when(ratio >= 1, box).otherwise(F.floor(box * ratio)).cast("bigint")
    new_h = F.when(ratio >= 1, F.floor(box / ratio)).otherwise(box).cast("bigint")
    return F.struct(
        new_w.alias("new_w"), new_h.alias("new_h"),
        F.floor((target - new_w) / 2).cast("bigint").alias("off_x"),
        F.floor((target - new_h) / 2).cast("bigint").alias("off_y"),
    )


def transparency_treatment(transparent_ratio: Column) -> Column:
    return F.when(transparent_ratio > TRANSPARENT_COMPOSITE, "composite").otherwise("blur-fill")


def tiles(width: Column, height: Column, tile: int = 256, overlap: int = 16, scale: int = 2) -> Column:
    """Tile plan as ``array<struct>``: source window, useful crop and output offset."""

    def count(side: Column) -> Column:
        return F.floor((side + (tile - 1)) / tile).cast("int")

    def one(tx: Column, ty: Column) -> Column:
        x1, y1 = F.greatest(F.lit(0), tx * tile - overlap), F.greatest(F.lit(0), ty * tile - overlap)
        x2, y2 = F.least(width, (tx + 1) * tile + overlap), F.least(height, (ty + 1) * tile + overlap)
        cw = (F.least(width, (tx + 1) * tile) - tx * tile) * scale
        ch = (F.least(height, (ty + 1) * tile) - ty * tile) * scale
        return F.struct(
            tx.alias("tx"), ty.alias("ty"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
            ((tx * tile - x1) * scale).alias("crop_x"), ((ty * tile - y1) * scale).alias("crop_y"),
            cw.alias("crop_w"), ch.alias("crop_h"),
            (tx * tile * scale).alias("out_x"), (ty * tile * scale).alias("out_y"),
        )

    rows = F.sequence(F.lit(0), count(height) - 1)
    cols = F.sequence(F.lit(0), count(width) - 1)
    return F.flatten(F.transform(rows, lambda ty: F.transform(cols, lambda tx: one(tx, ty))))
