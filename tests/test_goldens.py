"""Worked examples: one case per rule that a copy of the rule could get wrong."""

import pytest
from pyspark.sql import functions as F

from vitrina import lexicon as lx
from vitrina.functions import image_math as IM
from vitrina.functions import predicates as P
from vitrina.functions import similarity as M
from vitrina.functions import text as T
from vitrina.functions import urls as U
from vitrina.operators import cascade, hits, images, matching
from vitrina.sources import readers


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def text(spark, fn, value):
    return one(spark, fn(F.col("v")), v=value)


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (T.size_free_key, "FARMINA ND OCEAN PERRO MINI BACALAO 2.5 KG", "ocean-perro-mini-bacalao"),
        (T.unit_join_slug, "ARTERO ACONDICIONADOR FLASH 300 ML (NDR)", "artero-acondicionador-flash-300ml"),
        (T.weight_grams, "CANINE SNACK POLLO 16X35GR", 35),
        (T.weight_grams, "snack-de-ave-50gr", 50),
        (T.weight_grams, "sin peso", None),
        (U.name_from_slug, "https://m.example.com/484-pollo-&-granada-cachorro-lata-.html", "pollo & granada cachorro lata"),
        (T.normalize_text, "CHAMPÚ Straße ø 5%", "champu stra e   5 "),
        (T.title_slug, "CHAMPÚ Straße ø 5%", "champu-strae-5"),
        (T.vendor_slug, "Alpha Spirit & Co.", "alpha_spirit_co"),
        (T.base_title, "ALPHA SPIRIT NERVIO DE TORO 4X12UD XL 2,5KG", "nervio de toro 4x12ud"),
        (U.norm_url, "HTTPS://www.Example.com/a/?x=1#y", "example.com/a"),
        (U.norm_url, "", ""),
        (T.form_bucket, "CANINE SNACK SEMI-HUMEDO LATA", "snack"),
        (T.form_bucket, "CANINE SEMI-HUMEDO LATA", "semiwet"),
        (T.species_of, "calibra-premium-can-with-beef", ""),
        (T.species_of, "calibra-dog-premium-can-with-beef", "dog"),
        (T.species_of, "perro y gato", ""),
        (T.sub_brand, "AD CANINE PUPPY", "advance"),
        (T.sub_brand, "ADVANCE VET FELINE", "advance_vet"),
        (U.image_extension, "https://x.example.com/a.jpeg?v=1", "jpg"),
        (U.image_extension, "https://x.example.com/a.tiff", "jpg"),
    ],
)
def test_text_goldens(spark, fn, value, want):
    assert text(spark, fn, value) == want


def test_glued_units_drop_the_unit_not_the_number(spark):
    p = lx.PROFILES["marketplace"]
    assert set(text(spark, lambda c: T.title_tokens(c, p), "Champu 250ml")) == {"champu", "250"}


def test_stemmer_lengths(spark):
    tokens = F.array(*[F.lit(w) for w in ("gatos", "mes", "eyes", "classes", "gas", "perros", "atunes")])
    assert set(one(spark, T.stem_tokens(tokens))) == {"gato", "mes", "eye", "class", "gas", "perro", "atun"}


def test_empty_never_matches(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, M.jaccard(empty, empty)) == 0.0
    assert one(spark, M.jaccard(empty, F.array(F.lit("a")))) == 0.0


def test_dog_cardiac_scores_half(spark):
    a = T.tokenize_separators(T.vet_preprocess(F.lit("DOG CARDIAC")), lx.STOP_VETLIFE, False)
    b = T.tokenize_separators(T.vet_preprocess(F.lit("cardiac Cardiac")), lx.STOP_VETLIFE, False)
    assert one(spark, M.jaccard(a, b)) == 0.5


def test_wild_prairie_is_accepted(spark):
    products = spark.createDataFrame([(1, "ACANA FELINE ADULT WILD PRAIRIE")], "product_id bigint, title string")
    catalog = spark.createDataFrame([("eu-aca-wild-prairie-new-cat", 0, "Wild Prairie")], "handle string, ord bigint, name string")
    row = matching.match_best(products, catalog, lx.PROFILES["acana"]).first()
    assert row["handle"] == "eu-aca-wild-prairie-new-cat" and row["score"] >= 0.20


def test_species_rules(spark):
    assert one(spark, M.species_asymmetric(F.lit("dog"), F.lit(""))) is False
    assert one(spark, M.species_asymmetric(F.lit(""), F.lit("dog"))) is False
    assert one(spark, M.species_compatible(F.lit("dog"), F.lit(""))) is True
    assert one(spark, M.species_compatible(F.lit("dog"), F.lit("cat"))) is False


def test_title_without_tokens_confirms_nothing(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, M.enough_overlap(empty, F.array(F.lit("a")))) is False
    three = F.array(F.lit("perfume"), F.lit("violet"), F.lit("90ml"))
    assert one(spark, M.enough_overlap(three, F.array(F.lit("perfume"), F.lit("classic")))) is False


@pytest.mark.parametrize(
    "w, h, white, bw, bh, force, want",
    [
        (2000, 2000, 0.75, 1876, 1859, None, ("fills-frame", False, False)),
        (2000, 2000, 1.00, 938, 1838, None, ("padding", True, True)),
        (2000, 2000, 1.00, 1990, 1990, None, ("tight-product-shot", True, True)),
        (1000, 1188, 0.80, 1000, 900, None, ("fills-width", False, True)),
        (1000, 1000, 0.20, 500, 500, None, ("no-padding", False, False)),
        (1000, 1000, 0.20, 500, 500, True, ("forced-padding", True, True)),
        (1000, 1000, 0.90, 500, 500, False, ("forced-crop", False, True)),
        (1000, 1000, 0.20, 500, 500, False, ("forced-none", False, False)),
    ],
)
def test_layout(spark, w, h, white, bw, bh, force, want):
    r = one(spark, IM.layout(F.lit(w), F.lit(h), F.lit(white), F.lit(bw), F.lit(bh), F.lit(force).cast("boolean")))
    assert (r["decision"], r["use_padding"], r["cropped"]) == want


def test_canvas_uses_1800_with_padding(spark):
    r = one(spark, IM.canvas(F.lit(938), F.lit(1838), F.lit(True)))
    assert (r["new_w"], r["new_h"], r["off_x"], r["off_y"]) == (918, 1800, 541, 100)


def test_low_resolution_is_rejected(spark):
    assert one(spark, P.high_res(F.lit(227), F.lit(168))) is False
    assert one(spark, P.high_res(F.lit(None).cast("int"), F.lit(900))) is False


def test_larger_file_is_kept_in_the_earlier_slot(spark):
    rows = [(1, 0, 0b1011, 96_000, 1280 * 1280), (1, 1, 0b1000, 222_000, 2000 * 2828), (1, 2, -1, 10, 10), (1, 3, None, 9, 9)]
    df = spark.createDataFrame(rows, "product_id bigint, idx bigint, hash bigint, nbytes bigint, area bigint")
    got = sorted(tuple(r) for r in images.dedupe_images(df).select("slot", "kept_idx", "members").collect())
    assert got == [(0, 1, 2), (2, 2, 1)]


def test_leading_zero_of_a_barcode_survives(spark, tmp_path):
    doc = '{"id":1,"title":"T","variants":[{"id":2,"barcode":"064992281342","price":"27.50"}]}'
    (tmp_path / "p.json").write_text(f"[{doc}]")
    v = readers.flatten_variants(readers.read_products(spark, str(tmp_path / "p.json"))).first()
    assert v["barcode"] == "064992281342" and str(v["price"]) == "27.50"


def test_cached_resolution_is_never_a_candidate(spark):
    doc = '{"_site":"es","real-one":{"name":"Chicken","handle":"real-one"},"pescado-y-salmon":{"name":"PESCADO Y SALMON","url":"u"}}'
    from vitrina.operators import filters

    entries = readers.parse_catalog_map(spark.createDataFrame([(doc,)], "value string"), "uk")
    assert [r["handle"] for r in entries.orderBy("ord").collect()] == ["real-one", "pescado-y-salmon"]
    real = filters.real_catalog(entries.withColumn("handle", F.col("entry_handle")))
    assert [r["handle"] for r in real.collect()] == ["real-one"]


def test_stale_catalog_is_rejected(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id":1,"title":"T","handle":"h","image_url":"u"}]')
    with pytest.raises(readers.StaleCatalog):
        readers.read_catalog_list(spark, str(tmp_path / "c.json"))


def test_ties_keep_the_first_entry_or_the_greatest_handle(spark):
    products = spark.createDataFrame([(1, "dog chicken")], "product_id bigint, title string")
    catalog = spark.createDataFrame([("b", 0, "Dog Chicken"), ("c", 1, "Dog Chicken"), ("a", 2, "Dog Chicken")],
                                    "handle string, ord bigint, name string")
    first = matching.match_best(products, catalog, lx.PROFILES["acana"], ("name",)).first()
    greatest = matching.match_best(products, catalog, lx.PROFILES["applaws_uk"], ("name",)).first()
    assert (first["handle"], greatest["handle"]) == ("b", "c")


def test_early_stop_ignores_a_later_better_hit(spark):
    h = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.86), (1, 3, "c", 1.0)], "product_id bigint, rank bigint, url string, score double")
    assert hits.best_with_early_stop(h, 0.34).first()["url"] == "b"


def test_block_fallback_both_ways(spark):
    products = spark.createDataFrame([(1, "CANINE SNACK POLLO"), (2, "FELINE POLLO LATA")], "product_id bigint, title string")
    with_snack = spark.createDataFrame([("snack-dog", 0, "Snack chicken"), ("dry-dog", 1, "chicken canine dry")], "handle string, ord bigint, name string")
    without = with_snack.where("handle <> 'snack-dog'")
    p = lx.PROFILES["alpha_spirit"]
    assert {r["product_id"]: r["handle"] for r in matching.match_blocked(products, with_snack, p).collect()}[1] == "snack-dog"
    assert {r["product_id"]: r["handle"] for r in matching.match_blocked(products, without, p).collect()}[1] == "dry-dog"


@pytest.mark.parametrize("photo, feature, gate_ok", [("same", True, True), ("other", True, False), (None, True, True), ("same", False, True)])
def test_image_gate_four_ways(spark, photo, feature, gate_ok):
    from vitrina.operators import signatures

    products = spark.createDataFrame([(1, "calibra dog chicken")], "product_id bigint, title string")
    catalog = spark.createDataFrame([("dog-chicken", 0, "Dog Chicken")], "handle string, ord bigint, name string")
    vec = {"same": [1.0, 0.0], "other": [0.0, 1.0]}
    ph = spark.createDataFrame([(1, 1, vec[photo])] if photo else [], "product_id bigint, pos int, v array<float>")
    ft = spark.createDataFrame([("dog-chicken", [1.0, 0.0])] if feature else [], "handle string, v array<float>")
    f = signatures.vector_feature(F.col("v")).alias("feature")
    r = matching.match_image_tiebreak(products, catalog, ph.select("product_id", "pos", f), ft.select("handle", f),
                                      lx.PROFILES["calibra"], gate=0.60).first()
    assert r["accepted"] is gate_ok


def test_unknown_override_falls_through(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id bigint")
    over = spark.createDataFrame([(1, "gone"), (2, "here")], "product_id bigint, handle string")
    catalog = spark.createDataFrame([("here",)], "handle string")
    m = cascade.match_override(products, over, catalog)
    out = cascade.cascade(products, [("override", m)])
    assert {r["product_id"]: r["method"] for r in out.collect()} == {1: "none", 2: "override"}


def test_profile_table_is_complete(spark):
    t = lx.profile_table(spark)
    assert t.count() == len(lx.PROFILES) and t.where("accept <= 0").isEmpty()
    tables = lx.lexicon_tables(spark)
    assert tables["syn"].where("profile = 'calibra' AND token = 'pollo'").first()["syn"] == "chicken"
