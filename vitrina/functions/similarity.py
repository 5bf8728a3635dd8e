"""Similarity measures on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina import lexicon as lx


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard_from_counts(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard from the intersection size and both set sizes; 0 when either is empty."""
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / (size_a + size_b - shared)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays without duplicates; 0 when either is empty."""
    return jaccard_from_counts(overlap(a, b), F.size(a), F.size(b))


def enough_overlap(title: Column, name: Column) -> Column:
    """At least two shared tokens when the title has three or more, else one.
    A title without usable tokens confirms nothing."""
    need = F.when(F.size(title) >= 3, 2).otherwise(1)
    return (F.size(title) > 0) & (overlap(title, name) >= need)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def multi_hash_similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of ``[average, difference, dct]`` hash triples, floor 0."""
    distance = (
        0.2 * hamming(a[0], b[0]) + 0.3 * hamming(a[1], b[1]) + 0.5 * hamming(a[2], b[2])
    )
    return F.greatest(F.lit(0.0), 1.0 - distance / 64.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of normalised vectors: dot product clamped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b)))


def feature_similarity(a: Column, b: Column) -> Column:
    """Similarity of two image features; 0 when one is missing or the backends differ."""
    same = a["b"] == b["b"]
    return (
        F.when(same & (a["b"] == "clip"), cosine(a["vec"], b["vec"]))
        .when(same & (a["b"] == "hash"), multi_hash_similarity(a["hash"], b["hash"]))
        .otherwise(F.lit(0.0))
    )


def stage_factor(title_stage: Column, cand_stage: Column, cand_has_kitten: Column, factor: float = 0.5) -> Column:
    """Multiplier for a life-stage mismatch."""
    young_without_mark = (title_stage == "junior") & ~cand_has_kitten
    clash = (title_stage != "") & (cand_stage != "") & (title_stage != cand_stage)
    return F.when(young_without_mark | clash, F.lit(factor)).otherwise(F.lit(1.0))


def similarity_band(similarity: Column, backend: Column) -> Column:
    """``same`` / ``different`` / ``uncertain`` by the backend's thresholds."""
    strong = F.when(backend == "clip", lx.IMAGE_BANDS["clip"][0]).otherwise(lx.IMAGE_BANDS["hash"][0])
    weak = F.when(backend == "clip", lx.IMAGE_BANDS["clip"][1]).otherwise(lx.IMAGE_BANDS["hash"][1])
    return F.when(similarity >= strong, "same").when(similarity <= weak, "different").otherwise("uncertain")


def species_compatible(a: Column, b: Column) -> Column:
    """Incompatible only when both species are known and differ."""
    return (a == "") | (b == "") | (a == b)


def species_asymmetric(title: Column, candidate: Column) -> Column:
    """A dog title needs an explicit dog candidate; nothing else may take one."""
    return F.when(title == "dog", candidate == "dog").otherwise(candidate != "dog")
