"""Merging duplicate products into variants: propose, expand, apply, verify.

``products``: ``product_id, title, option_name``.  ``variants``: ``product_id,
variant_id, option1, price, sku, barcode, weight, weight_unit, ord``.  A merge plan
has one row per group (see ``schemas.MERGE_PLAN``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import text as T
from vitrina.functions import urls as U

OPTION_NAME = "Tamaño"
DEFAULT_OPTION = "Title"


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def duplicate_groups(products: DataFrame, vendor_prefix: str = lx.VENDOR_PREFIX) -> DataFrame:
    """Products sharing a base title: ``base_title, first_id, n_products`` (two or more)."""
    return (
        products.groupBy(T.base_title(F.col("title"), vendor_prefix).alias("base_title"))
        .agg(F.min("product_id").alias("first_id"), F.count(F.lit(1)).alias("n_products"))
        .where("n_products > 1")
    )


def group_members(products: DataFrame, vendor_prefix: str = lx.VENDOR_PREFIX) -> DataFrame:
    """``base_title, product_id`` of every product in a duplicate group."""
    keyed = products.select(T.base_title(F.col("title"), vendor_prefix).alias("base_title"), "product_id")
    return keyed.join(duplicate_groups(products, vendor_prefix).select("base_title"), "base_title", "left_semi")


def propose_groups(products: DataFrame, vendor_prefix: str = lx.VENDOR_PREFIX, threshold: float = 0.80) -> DataFrame:
    """Candidate merges from both detectors: ``reason, first_id, other_id, n_pairs``.

    Equal base titles give one row per group, near-identical token sets one row per
    pair of sets; rows proposing the same pair of representatives appear once.
    """
    from vitrina.operators.matching import similar_products

    same = (
        products.groupBy(T.base_title(F.col("title"), vendor_prefix).alias("k"))
        .agg(F.min("product_id").alias("first_id"), F.max("product_id").alias("other_id"),
             F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit("base_title").alias("reason"), "first_id", "other_id", F.expr("n * (n - 1) div 2").alias("n_pairs"))
    )
    near = similar_products(products, threshold).where("a <> b").select(
        F.lit("similar").alias("reason"), F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("other_id"),
        "n_pairs",
    )
    return (
        same.unionByName(near)
        .groupBy("first_id", "other_id")
        .agg(F.min(F.struct("reason", "n_pairs")).alias("w"))
        .select("w.reason", "first_id", "other_id", "w.n_pairs")
    )


# --- plan expansion ----------------------------------------------------------

def expand_plan(plan: DataFrame) -> DataFrame:
    """Ordered operations of a merge plan: ``group, seq, op, target_id, field, value``."""
    renames = _filled(F.col("keep_size")) & F.col("keep_var_id").isNotNull()

    def op(name: str, target: Column, field: Column | str, value: Column) -> Column:
        field = F.lit(field) if isinstance(field, str) else field
        return F.struct(F.lit(name).alias("op"), target.cast("bigint").alias("target_id"), field.alias("field"),
                        value.cast("string").alias("value"))

    lead = F.when(
        renames,
        F.array(
            op("update_product", F.col("keep_id"), "title", F.col("title")),
            op("update_product", F.col("keep_id"), "option", F.lit(OPTION_NAME)),
            op("update_variant", F.col("keep_var_id"), "option1", F.col("keep_size")),
        ),
    ).otherwise(F.array(op("update_product", F.col("keep_id"), "title", F.col("title"))))
    adds = F.transform("absorb", lambda a: op("add_variant", F.col("keep_id"), "option1", a["size"]))
    deletes = F.transform(
        F.array_distinct(F.transform("absorb", lambda a: a["product_id"])),
        lambda p: op("delete_product", p, "id", p),
    )
    return plan.select("group", F.posexplode(F.concat(lead, adds, deletes)).alias("seq", "o")).select(
        "group", "seq", "o.op", "o.target_id", "o.field", "o.value"
    )


def absorbed_variants(plan: DataFrame) -> DataFrame:
    """Variants to add to the kept product: ``group, keep_id, source_id, option1, price, sku``."""
    return plan.select("group", "keep_id", F.explode("absorb").alias("a")).select(
        "group", "keep_id", F.col("a.product_id").alias("source_id"), F.col("a.size").alias("option1"), "a.price", "a.sku"
    )


def deletions(plan: DataFrame) -> DataFrame:
    """Absorbed products to delete, once each: ``product_id``."""
    return plan.select(F.explode("absorb.product_id").alias("product_id")).distinct()


def variant_payload(variants: DataFrame, option1: Column) -> DataFrame:
    """Copy of a variant for re-creation, with the store's defaults for missing fields."""
    def field(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    return variants.select(
        "product_id", "variant_id", option1.alias("option1"), field("price", "0.00"), "compare_at_price",
        field("sku", ""), field("weight", 0.0), field("weight_unit", "kg"), field("inventory_policy", "deny"),
        field("requires_shipping", True), field("taxable", True),
    )


# --- groups from title fragments ---------------------------------------------

def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(T.strip_accents(c), r"[^a-z0-9]+", " ")), F.lit(" "))


def _rules(rules: DataFrame, *columns: str) -> Column:
    """A configuration table (tens of rows) as one literal array."""
    return rules.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r")).scalar()


def groups_from_fragments(products: DataFrame, fragments: DataFrame) -> DataFrame:
    """Members of configured groups: ``group, seq, product_id, label, role``.

    ``fragments``: ``group, seq, fragment, label``, a configuration table.  For each
    fragment the first product (by id) whose title contains it as whole words; groups
    with fewer than two members are left out; the first member is the base.
    """
    matched = (
        products.select("product_id", _padded(F.col("title")).alias("t"))
        .withColumn("rules", _rules(fragments, "group", "seq", "fragment", "label"))
        .select("product_id", F.explode(F.filter("rules", lambda r: F.contains(F.col("t"), _padded(r["fragment"])))).alias("r"))
        .groupBy("r.group", "r.seq", "r.label")
        .agg(F.min("product_id").alias("product_id"))
    )
    size = matched.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("base_seq")).where("n >= 2")
    return matched.join(size, "group").select(
        "group", "seq", "product_id", "label",
        F.when(F.col("seq") == F.col("base_seq"), "base").otherwise("absorb").alias("role"),
    )


def reasoned_deletions(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Products to delete with the first reason that applies: ``product_id, seq, reason``.

    ``rules``: ``seq, kind ('contains'|'equals'), pattern, reason``, a configuration table.
    """
    low = F.lower(F.trim("title"))
    hit = F.filter(
        "rules",
        lambda r: F.when(r["kind"] == "equals", low == F.lower(r["pattern"])).otherwise(
            F.contains(low, F.lower(r["pattern"]))
        ),
    )
    return (
        products.withColumn("rules", _rules(rules, "seq", "kind", "pattern", "reason"))
        .select("product_id", F.try_element_at(hit, F.lit(1)).alias("r"))
        .where("r is not null")
        .groupBy("product_id")
        .agg(F.min(F.struct("r.seq", "r.reason")).alias("w"))
        .select("product_id", "w.seq", "w.reason")
    )


# --- merges with images ------------------------------------------------------

def first_variants(variants: DataFrame) -> DataFrame:
    """Each product's first variant."""
    rest = [c for c in variants.columns if c not in ("product_id", "ord")]
    return variants.groupBy("product_id").agg(F.min(F.struct("ord", *rest)).alias("v")).select("product_id", "v.*")


def merge_variants(members: DataFrame, variants: DataFrame) -> DataFrame:
    """Variant rows of merged products: ``base_id, source_id, role, option1, price, barcode,
    sku, weight, weight_unit``.

    ``members``: ``base_id, source_id, label, role``.  A missing SKU falls back to the
    barcode, a missing weight to 0 kg.
    """
    v = first_variants(variants)
    return members.join(v.withColumnRenamed("product_id", "source_id"), "source_id").select(
        "base_id", "source_id", "role", F.col("label").alias("option1"), "price", "barcode",
        F.coalesce(F.nullif("sku", F.lit("")), F.col("barcode")).alias("sku"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce(F.nullif("weight_unit", F.lit("")), F.lit("kg")).alias("weight_unit"),
    )


def merge_images(members: DataFrame, images: DataFrame) -> DataFrame:
    """Image work of a merge: ``base_id, source_id, option1, op, image_id, src, alt``.

    The base's first image is assigned to its own variant; all images of an absorbed
    product are copied (query string dropped) and assigned to the new variant.
    """
    i = images.withColumnRenamed("product_id", "source_id")
    copies = members.where("role = 'absorb'").join(i, "source_id").select(
        "base_id", "source_id", F.col("label").alias("option1"), F.lit("copy").alias("op"), "image_id",
        U.without_query(F.col("src")).alias("src"), F.coalesce("alt", F.lit("")).alias("alt"),
    )
    first = i.groupBy("source_id").agg(
        F.min(F.struct(F.coalesce("position", F.lit(999)).alias("p"), "image_id", "src", "alt")).alias("w")
    )
    own = members.where("role = 'base'").join(first, "source_id").select(
        "base_id", "source_id", F.col("label").alias("option1"), F.lit("assign").alias("op"), "w.image_id", "w.src",
        F.coalesce("w.alt", F.lit("")).alias("alt"),
    )
    return copies.unionByName(own)


def option_branch(products: DataFrame, option: str = "Peso") -> DataFrame:
    """How a product receives a further variant: ``product_id, action, option_name``.

    The default option is converted, any other option takes the variant directly.
    """
    is_default = F.coalesce("option_name", F.lit(DEFAULT_OPTION)) == DEFAULT_OPTION
    return products.select(
        "product_id", F.when(is_default, "convert").otherwise("add").alias("action"),
        F.when(is_default, option).otherwise(F.col("option_name")).alias("option_name"),
    )


# --- apply and verify --------------------------------------------------------

def apply_plan(products: DataFrame, variants: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The product and variant tables after the plan."""
    gone = deletions(plan)
    keep = plan.select(F.col("keep_id").alias("product_id"), F.col("title").alias("new_title"), "keep_size", "keep_var_id")
    renames = _filled(F.col("keep_size")) & F.col("keep_var_id").isNotNull()
    new_products = (
        products.join(gone, "product_id", "left_anti")
        .join(keep, "product_id", "left")
        .select(
            "product_id", F.coalesce("new_title", "title").alias("title"),
            F.when(renames, OPTION_NAME).otherwise(F.col("option_name")).alias("option_name"),
        )
    )
    relabel = plan.where(renames).select(F.col("keep_var_id").alias("variant_id"), "keep_size")
    kept = (
        variants.join(gone, "product_id", "left_anti")
        .join(relabel, "variant_id", "left")
        .select("product_id", "variant_id", F.coalesce("keep_size", "option1").alias("option1"), "price", "sku")
    )
    added = plan.select("keep_id", F.explode("absorb").alias("a")).select(
        F.col("keep_id").alias("product_id"), F.col("a.variant_id").alias("variant_id"), F.col("a.size").alias("option1"),
        F.col("a.price").alias("price"), F.col("a.sku").alias("sku"),
    )
    return new_products, kept.unionByName(added)


def verify_plan(checks: DataFrame, products: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per check: ``group, check, status, detail``.

    ``checks``: ``group, keep_id, title, sizes array, absorbed array``.  The kept product
    exists (FAIL), has the expected title (WARN) and at least the expected sizes (FAIL);
    absorbed products are gone (FAIL).
    """
    wanted = checks.select("group", "keep_id", F.col("title").alias("want"), "sizes")
    found = wanted.join(products.select(F.col("product_id").alias("keep_id"), "title"), "keep_id", "left")
    exists = F.col("title").isNotNull()
    head = found.select(
        "group",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("exists").alias("check"), F.when(exists, "OK").otherwise("FAIL").alias("status"),
                             F.col("keep_id").cast("string").alias("detail")),
                    F.when(
                        exists,
                        F.struct(F.lit("title").alias("check"),
                                 F.when(F.col("title") == F.col("want"), "OK").otherwise("WARN").alias("status"),
                                 F.col("title").alias("detail")),
                    ),
                )
            )
        ).alias("c"),
    ).select("group", "c.check", "c.status", "c.detail")
    lacking = (
        found.where(exists).select("group", "keep_id", F.explode(F.array_distinct("sizes")).alias("option1"))
        .join(variants.select(F.col("product_id").alias("keep_id"), "option1"), ["keep_id", "option1"], "left_anti")
        .groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("option1")), "|").alias("lacking"))
    )
    sizes = found.where(exists).select("group").join(lacking, "group", "left").select(
        "group", F.lit("sizes").alias("check"), F.when(F.col("lacking").isNull(), "OK").otherwise("FAIL").alias("status"),
        F.coalesce("lacking", F.lit("")).alias("detail"),
    )
    absorbed = (
        checks.select("group", F.explode("absorbed").alias("product_id"))
        .join(products.select("product_id", F.lit(True).alias("still")), "product_id", "left")
        .select("group", F.lit("absorbed_gone").alias("check"),
                F.when(F.col("still"), "FAIL").otherwise("OK").alias("status"),
                F.col("product_id").cast("string").alias("detail"))
    )
    return head.unionByName(sizes).unionByName(absorbed)


def verification_status(rows: DataFrame) -> DataFrame:
    """Roll-up per group: the worst of its checks."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return rows.groupBy("group").agg(
        F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), (worst + 1).cast("int")).alias("status"),
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") != "OK").alias("problems"),
    )


def checks_of(plan: DataFrame) -> DataFrame:
    """The verification table a plan implies."""
    return plan.select(
        "group", "keep_id", "title",
        F.array_compact(F.concat(F.array("keep_size"), F.col("absorb.size"))).alias("sizes"),
        F.array_distinct("absorb.product_id").alias("absorbed"),
    )


def plan_from_groups(members: DataFrame, variants: DataFrame, titles: DataFrame) -> DataFrame:
    """A merge plan from group members: ``members`` = ``group, seq, product_id, label, role``.

    ``titles``: ``group, title``.  The member lists are bounded by the configured labels
    of a group.
    """
    v = first_variants(variants).select("product_id", "variant_id", "price", "sku")
    m = members.join(v, "product_id")
    base = m.where("role = 'base'").select(
        "group", F.col("product_id").alias("keep_id"), F.col("label").alias("keep_size"), F.col("variant_id").alias("keep_var_id")
    )
    absorb = (
        m.where("role = 'absorb'").groupBy("group")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "product_id", "variant_id", "label", "price", "sku"))).alias("a"))
        .select("group", F.transform("a", lambda a: F.struct(
            a["product_id"].alias("product_id"), a["variant_id"].alias("variant_id"), a["label"].alias("size"),
            a["price"].alias("price"), a["sku"].alias("sku"))).alias("absorb"))
    )
    return base.join(absorb, "group").join(titles, "group").select(
        "group", "keep_id", "title", "keep_size", "keep_var_id", "absorb"
    )
