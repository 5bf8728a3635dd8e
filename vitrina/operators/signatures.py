"""Image signatures: hashes and serialisable features of decoded pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina import schemas
from vitrina.functions import image_math as IM


def with_hashes(pictures: DataFrame, side: int = 32, average: str = "thumb8", difference: str = "thumb9x8",
                square: str = "thumb32") -> DataFrame:
    """Add ``ahash``, ``dhash`` and ``dct`` from luminance thumbnails held as arrays."""
    return pictures.select(
        "*", IM.average_hash(F.col(average)).alias("ahash"), IM.difference_hash(F.col(difference)).alias("dhash"),
        IM.dct_hash(F.col(square), side).alias("dct"),
    )


def vector_feature(vector: Column) -> Column:
    """Feature of a normalised embedding; null stays null."""
    return F.when(
        vector.isNotNull(),
        F.struct(F.lit("clip").alias("b"), vector.cast("array<float>").alias("vec"),
                 F.lit(None).cast("array<bigint>").alias("hash")),
    ).cast(schemas.FEATURE)


def hash_feature(ahash: Column, dhash: Column, dct: Column) -> Column:
    """Feature of a hash triple; null when one of them is missing."""
    return F.when(
        ahash.isNotNull() & dhash.isNotNull() & dct.isNotNull(),
        F.struct(F.lit("hash").alias("b"), F.lit(None).cast("array<float>").alias("vec"),
                 F.array(ahash, dhash, dct).alias("hash")),
    ).cast(schemas.FEATURE)
