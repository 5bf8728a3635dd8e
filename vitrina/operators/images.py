"""Image analytics on decoded values held in tables.

``images``: ``product_id, idx, hash bigint, nbytes, area`` for de-duplication;
``pixels``: ``image_id, x, y, r, g, b, a`` for measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions import image_math as IM
from vitrina.functions import predicates as P
from vitrina.functions import similarity as M
from vitrina.functions import text as T
from vitrina.operators import filters
from vitrina.session import cut_lineage

#: Distinct hashes a product may have for its groups to be folded in one row.
#: Larger products go through the distributed rounds, which give the same result.
FOLD_LIMIT = 256

#: Pictures of a product that one fold of the rounds may take.
MAX_BLOCK = 16384

#: Differing bits up to which two pictures are the same.
SAME_PICTURE = 8


# --- near-duplicates ---------------------------------------------------------

def _distinct_pictures(images: DataFrame) -> DataFrame:
    """One row per (product, hash): first position and the best copy.

    Equal hashes always share a leader, so copies collapse before any grouping.
    The best copy has most bytes, then largest area, then the earliest position.
    """
    return (
        images.where(F.col("hash").isNotNull())
        .groupBy("product_id", "hash")
        .agg(
            F.min("idx").alias("first_idx"),
            F.count(F.lit(1)).alias("copies"),
            F.max(F.struct("nbytes", "area", (-F.col("idx")).alias("neg"))).alias("best"),
        )
    )


def _close(leaders: Column, h: Column) -> Column:
    return F.filter(leaders, lambda g: F.bit_count(g["hash"].bitwiseXOR(h)) <= SAME_PICTURE)


def _fold(pics: Column) -> Column:
    """Leaders (``idx, hash``) among ordered pictures of one product."""
    empty = F.array().cast("array<struct<idx:bigint,hash:bigint>>")
    return F.aggregate(
        pics, empty,
        lambda acc, p: F.when(F.size(_close(acc, p["hash"])) > 0, acc).otherwise(
            F.concat(acc, F.array(F.struct(p["first_idx"].cast("bigint").alias("idx"), p["hash"].alias("hash"))))
        ),
    )


def _fold_leaders(pictures: DataFrame) -> DataFrame:
    """``pictures`` with ``leader_idx`` by one fold per product (few distinct hashes)."""
    rows = F.struct("first_idx", "hash", "copies", "best")
    ordered = F.sort_array(F.collect_list(rows))
    folded = pictures.groupBy("product_id").agg(ordered.alias("pics")).withColumn("leaders", _fold(F.col("pics")))
    return folded.select("product_id", "leaders", F.explode("pics").alias("p")).select(
        "product_id", "p.*", _close(F.col("leaders"), F.col("p.hash"))[0]["idx"].alias("leader_idx")
    )


def _close_leaders(pictures: DataFrame, leaders: DataFrame) -> DataFrame:
    """``product_id, first_idx, leader_idx``: the first of many ``leaders`` (``product_id, idx, hash``) within the limit.

    Three bands of 22, 21 and 21 bits: within 8 differing bits one band differs in at
    most 2.  Pictures are stored under their band values, a leader probes all values up
    to 2 bits away.
    """
    bands = ((0, 22), (22, 21), (43, 21))

    def value(lo: int, width: int) -> Column:
        shifted = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(lo))
        return shifted.bitwiseAND(F.lit((1 << width) - 1))

    def flips(width: int) -> list[int]:
        one = [1 << i for i in range(width)]
        return [0, *one, *[one[i] | one[j] for i in range(width) for j in range(i)]]

    stored, probes = None, None
    for band, (lo, width) in enumerate(bands):
        s = pictures.select("product_id", F.lit(band).alias("band"), value(lo, width).alias("v"), "first_idx", "hash")
        masks = F.array(*[F.lit(m).cast("bigint") for m in flips(width)])
        p = leaders.select("product_id", F.lit(band).alias("band"), value(lo, width).alias("v0"),
                           F.col("idx").alias("leader_idx"), F.col("hash").alias("lh"), F.explode(masks).alias("m"))
        p = p.select("product_id", "band", F.col("v0").bitwiseXOR(F.col("m")).alias("v"), "leader_idx", "lh")
        stored = s if stored is None else stored.unionByName(s)
        probes = p if probes is None else probes.unionByName(p)
    return (
        stored.join(probes, ["product_id", "band", "v"])
        .where(M.hamming(F.col("hash"), F.col("lh")) <= SAME_PICTURE)
        .groupBy("product_id", "first_idx").agg(F.min("leader_idx").alias("leader_idx"))
    )


def _leaders_in_rounds(pictures: DataFrame, block: int = FOLD_LIMIT, few: int = FOLD_LIMIT) -> DataFrame:
    """The same leaders for products of any size, by rounds over blocks of their open pictures.

    The earliest open pictures of a product are close to no leader before them, so a fold
    over them finds the next leaders.  All pictures close to these are settled; the others
    stay open.  Pictures meet leaders only, never each other: in place while a product has a
    ``few`` of them in a round, else by bands.  Blocks grow, so far-apart pictures don't take a round each.
    """
    open_, settled = pictures, None
    while True:
        nth = F.row_number().over(Window.partitionBy("product_id").orderBy("first_idx"))
        ordered = F.sort_array(F.collect_list(F.struct("first_idx", "hash")))
        leaders = cut_lineage(
            open_.select("product_id", "first_idx", "hash").withColumn("nth", nth).where(F.col("nth") <= block)
            .groupBy("product_id").agg(ordered.alias("pics")).select("product_id", _fold(F.col("pics")).alias("leaders"))
        )
        if leaders.isEmpty():
            return settled
        short = leaders.where(F.size("leaders") <= few)
        first = F.get(_close(F.col("leaders"), F.col("hash")), F.lit(0))["idx"]
        judged = open_.join(short, "product_id").withColumn("leader_idx", first).drop("leaders")
        many = leaders.where(F.size("leaders") > few)
        if not many.isEmpty():
            rest = open_.join(many.select("product_id"), "product_id", "left_semi")
            found = _close_leaders(rest, many.select("product_id", F.inline("leaders")))
            judged = judged.unionByName(rest.join(found, ["product_id", "first_idx"], "left"))
        judged = cut_lineage(judged)
        done = judged.where("leader_idx IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        open_ = judged.where("leader_idx IS NULL").drop("leader_idx")
        block = min(4 * block, MAX_BLOCK)


def dedupe_images(images: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Leader clustering of each product's pictures in order of appearance.

    A picture joins the first group whose leader differs in at most
    :data:`SAME_PICTURE` bits, else it leads a new group.  Returns ``product_id,
    slot`` (earliest position of the group), ``kept_idx`` (most bytes, then largest
    area, then earliest) and ``members``.  Undecodable pictures (null hash) are left out.
    """
    pictures = cut_lineage(_distinct_pictures(images))
    sizes = pictures.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_hashes"))
    large = cut_lineage(sizes.where(F.col("n_hashes") > fold_limit).select("product_id"))
    if large.isEmpty():
        led = _fold_leaders(pictures)
    else:
        led = _fold_leaders(pictures.join(large, "product_id", "left_anti")).unionByName(
            _leaders_in_rounds(pictures.join(large, "product_id", "left_semi")))
    return (
        led.groupBy("product_id", "leader_idx")
        .agg(F.min("first_idx").alias("slot"), F.max("best").alias("best"), F.sum("copies").alias("members"))
        .select("product_id", "slot", (-F.col("best.neg")).alias("kept_idx"), "members")
    )


# --- pixel measurements ------------------------------------------------------

def white_corner_ratio(pixels: DataFrame, sizes: DataFrame, white: int = 245) -> DataFrame:
    """Share of white pixels in the four corner patches: ``image_id, white_ratio``.

    Patches are 5 % of the smaller side, at least 20 pixels, every second pixel.
    ``sizes``: ``image_id, width, height``.  A pixel lying in several patches counts
    once per patch.
    """
    w, h = F.col("width"), F.col("height")
    patch = F.greatest(F.lit(20), F.floor(F.least(w, h) * F.lit(0.05)).cast("int"))

    def inside(v: Column, start: Column) -> Column:
        offset = v - start
        return (offset >= 0) & (offset < patch) & (offset % 2 == 0)

    left, right = inside(F.col("x"), F.lit(0)), inside(F.col("x"), w - patch)
    top, bottom = inside(F.col("y"), F.lit(0)), inside(F.col("y"), h - patch)
    hits = (left.cast("int") + right.cast("int")) * (top.cast("int") + bottom.cast("int"))
    is_white = (F.col("r") >= white) & (F.col("g") >= white) & (F.col("b") >= white)
    return (
        pixels.join(sizes, "image_id")
        .withColumn("hits", hits).where("hits > 0")
        .groupBy("image_id")
        .agg((F.sum(F.when(is_white, F.col("hits")).otherwise(0)) / F.sum("hits")).alias("white_ratio"))
    )


def content_box(pixels: DataFrame, threshold: int = 15) -> DataFrame:
    """Bounding box of pixels differing from white: ``image_id, x1, y1, x2, y2`` (exclusive end)."""
    differs = (
        (255 - F.col("r") >= threshold) | (255 - F.col("g") >= threshold) | (255 - F.col("b") >= threshold)
    )
    return pixels.where(differs).groupBy("image_id").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2")
    )


def transparency(pixels: DataFrame) -> DataFrame:
    """``image_id, transparent_ratio, treatment``."""
    return (
        pixels.groupBy("image_id")
        .agg(F.avg(F.when(F.col("a") < 128, 1.0).otherwise(0.0)).alias("transparent_ratio"))
        .withColumn("treatment", IM.transparency_treatment(F.col("transparent_ratio")))
    )


def corner_colour(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Background colour: integer mean of the four corner pixels."""
    corner = ((F.col("x") == 0) | (F.col("x") == F.col("width") - 1)) & (
        (F.col("y") == 0) | (F.col("y") == F.col("height") - 1)
    )
    mean = lambda c: F.expr(f"sum({c}) div count(1)").alias(c)
    return pixels.join(sizes, "image_id").where(corner).groupBy("image_id").agg(mean("r"), mean("g"), mean("b"))


def plan_layout(measures: DataFrame) -> DataFrame:
    """Layout decision and canvas geometry of measured images.

    ``measures``: ``image_id, width, height, white_ratio, bbox_w, bbox_h,
    force_padding``.  An image without content box keeps its full size.
    """
    bw, bh = F.coalesce("bbox_w", "width"), F.coalesce("bbox_h", "height")
    lay = IM.layout(F.col("width"), F.col("height"), F.col("white_ratio"), bw, bh, F.col("force_padding"))
    out = measures.withColumn("bw", bw).withColumn("bh", bh).withColumn("lay", lay)
    cw = F.when(F.col("lay.cropped"), F.col("bw")).otherwise(F.col("width"))
    ch = F.when(F.col("lay.cropped"), F.col("bh")).otherwise(F.col("height"))
    return out.withColumn("cv", IM.canvas(cw, ch, F.col("lay.use_padding"))).select(
        "image_id", "lay.decision", "lay.use_padding", "lay.cropped", "cv.new_w", "cv.new_h", "cv.off_x", "cv.off_y"
    )


def tile_plan(images: DataFrame, tile: int = 256, overlap: int = 16, scale: int = 2) -> DataFrame:
    """One row per tile of each image (``image_id, width, height``)."""
    return images.select(
        "image_id", F.explode(IM.tiles(F.col("width"), F.col("height"), tile, overlap, scale)).alias("t")
    ).select("image_id", "t.*")


# --- per product -------------------------------------------------------------

def audit_images(products: DataFrame, images: DataFrame) -> DataFrame:
    """``product_id, n_images, state, issues``: OK, needs work, or no image.

    ``images``: ``product_id, position, src, width, height, format``.  Issues of all
    images are joined with ``|`` in position order.
    """
    described = F.array_join(
        F.transform(F.map_entries("found"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", "
    )
    per_image = images.withColumn("found", P.image_issues(F.col("src"), F.col("width"), F.col("height"), F.col("format")))
    per_product = per_image.withColumn("issue", F.when(F.size("found") > 0, described)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count("issue").alias("n_issues"),
        F.expr("listagg(issue, '|') within group (order by coalesce(position, 999), src)").alias("issues"),
    )
    return products.select("product_id").join(per_product, "product_id", "left").select(
        "product_id",
        F.coalesce("n_images", F.lit(0)).alias("n_images"),
        F.when(F.col("n_images").isNull(), "no_image").when(F.col("n_issues") > 0, "needs_work").otherwise("ok").alias("state"),
        F.coalesce("issues", F.lit("")).alias("issues"),
    )


def optimisation_scan(products: DataFrame, images: DataFrame) -> DataFrame:
    """``product_id, to_process, already_ok, no_images``."""
    ok = P.is_optimized(F.col("src"), F.col("width"), F.col("height"))
    counts = images.groupBy("product_id").agg(
        F.count_if(~ok).alias("to_process"), F.count_if(ok).alias("already_ok")
    )
    zero = F.lit(0).cast("bigint")
    return products.select("product_id").join(counts, "product_id", "left").select(
        "product_id",
        F.coalesce("to_process", zero).alias("to_process"),
        F.coalesce("already_ok", zero).alias("already_ok"),
        F.col("to_process").isNull().alias("no_images"),
    )


def attach_feature(entries: DataFrame, features: DataFrame, first: int = 3) -> DataFrame:
    """First usable feature among each entry's leading images: ``handle, pos, feature``."""
    usable = (
        features.where(F.col("feature").isNotNull() & (F.col("pos") <= first))
        .groupBy("handle")
        .agg(F.min(F.struct("pos", "feature")).alias("w"))
    )
    return entries.select("handle").join(usable, "handle", "left").select("handle", "w.pos", "w.feature")


def assign_variant_images(variants: DataFrame, images: DataFrame) -> DataFrame:
    """Picture of each variant by overlap with the text read off it.

    ``variants``: ``product_id, variant_id, title``; ``images``: ``product_id,
    image_id, position, raw_text``.  Best Jaccard, then the earliest position; no
    overlap leaves the variant unassigned.  Variants meet the pictures of their product.
    """
    v = variants.select("product_id", "variant_id", T.variant_tokens(F.col("title")).alias("tv"))
    i = images.select("product_id", "image_id", F.coalesce("position", F.lit(999)).alias("position"),
                      T.variant_tokens(F.col("raw_text")).alias("ti"))
    # The planner takes variants for as few bytes as the rows they are unfolded from: without the hint it may broadcast them.
    best = (
        i.join(v.hint("merge"), "product_id")
        .withColumn("shared", F.size(F.array_intersect("tv", "ti")))
        .where("shared > 0")
        .withColumn("score", M.jaccard_from_counts(F.col("shared"), F.size("tv"), F.size("ti")))
        .groupBy("variant_id")
        .agg(F.max(F.struct("score", (-F.col("position")).alias("neg"), (-F.col("image_id")).alias("neg_id"))).alias("w"))
    )
    return variants.select("variant_id").join(best.hint("merge"), "variant_id", "left").select(
        "variant_id", (-F.col("w.neg_id")).alias("image_id"), (-F.col("w.neg")).alias("image_pos"),
        F.coalesce("w.score", F.lit(0.0)).alias("score"),
    )


# --- galleries ---------------------------------------------------------------

def filter_gallery_by_code(images: DataFrame) -> DataFrame:
    """Keep the gallery pictures that carry the product's code.

    ``images``: ``product_id, ord, url, barcode``.  The code is read from the first
    URL's file name, else the barcode when it names a file; pictures on the same host
    must carry it, other hosts are kept; without a code all are kept.
    """
    from vitrina.functions import urls as U

    code_in = F.regexp_extract("url", r"/(\d{13})(?:_\d+)?\.[a-zA-Z]", 1)
    bar = F.coalesce("barcode", F.lit(""))

    def carries(code: Column) -> Column:
        return (F.length(code) > 0) & F.regexp_like(
            F.col("url"), F.concat(F.lit("/"), code, F.lit(r"(?:_\d+)?\.[a-zA-Z]"))
        )

    named = F.when((F.length(bar) >= 8) & carries(bar), bar)
    lead = images.groupBy("product_id").agg(
        F.min(F.struct("ord", code_in.alias("code"), U.host_of(F.col("url")).alias("host"))).alias("f"),
        F.max(named).alias("named"),
    ).select(
        "product_id", F.col("f.host").alias("host"),
        F.coalesce(F.nullif("f.code", F.lit("")), "named", F.lit("")).alias("code"),
    )
    keep = (F.col("code") == "") | (U.host_of(F.col("url")) != F.col("host")) | carries(F.col("code"))
    return images.join(lead, "product_id").where(keep).drop("host", "code")


def filter_by_keys(images: DataFrame) -> DataFrame:
    """Pictures whose URL contains the product's code or reference (case-insensitive);
    products without either keep all, products none of whose pictures match keep none."""
    low = F.lower("url")
    code, ref = F.lower(F.coalesce("barcode", F.lit(""))), F.lower(F.coalesce("reference", F.lit("")))
    hit = ((code != "") & F.contains(low, code)) | ((ref != "") & F.contains(low, ref))
    return images.where(hit | ((code == "") & (ref == "")))


def gallery_positions(images: DataFrame) -> DataFrame:
    """Dense position of each picture in its gallery (1-based, missing order last)."""
    ordered = images.withColumn("_at", F.coalesce(F.col("ord").cast("bigint"), F.lit((1 << 63) - 1)))
    return filters.rank_within(ordered, ["product_id"], ["_at", "url"], "position").drop("_at")
