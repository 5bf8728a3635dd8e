"""Properties: the index equals brute force, plans are idempotent, streams equal batches."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators import images, matching, provenance, simjoin, unify
from vitrina.plans import bindings as B
from vitrina.plans import unify_queries as UQ
from vitrina.plans.registry import Tables
from vitrina.streaming import incremental

from conftest import TESTDATA


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def _random_sets(seed, n, vocabulary, hot_share=0.7):
    """Skewed sets: a few words occur in most of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        size = rng.randint(1, 7)
        out.append(frozenset(w if rng.random() > hot_share else words[rng.randint(0, 9)] for w in rng.sample(words, size)))
    return sorted(set(out), key=sorted)


@pytest.fixture(scope="module")
def skewed(spark):
    q, e = _random_sets(1, 300, 60), _random_sets(2, 200, 60)
    dq = spark.createDataFrame([(i, sorted(s), i % 2) for i, s in enumerate(q)], "qid bigint, tokens array<string>, guards int")
    de = spark.createDataFrame([(-i, sorted(s), i % 3) for i, s in enumerate(e)], "pref bigint, tokens array<string>, guards int")
    return q, e, dq.cache(), de.cache()


def _guard_py(i, j):
    return i % 2 == 0 or j % 3 != 1


def _guard(a, b):
    return (a == 0) | (b != 1)


@pytest.mark.parametrize("accept", [0.12, 0.45, 0.75])
def test_filters_lose_no_pair(spark, accept):
    """Long sets of a long-tailed vocabulary, so that most tokens are ranked or beyond the prefix."""
    rng = random.Random(accept)

    def sets(n):
        return sorted({frozenset(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 40))) for _ in range(n)}, key=sorted)

    e = sets(250)
    q = sorted({frozenset(list(x)[: max(1, len(x) - rng.randint(0, 6))]) | {f"w{rng.randint(0, 399)}"} for x in e} | set(sets(60)), key=sorted)
    dq = spark.createDataFrame([(i, sorted(s), 0) for i, s in enumerate(q)], "qid bigint, tokens array<string>, guards int")
    de = spark.createDataFrame([(-i, sorted(s), 0) for i, s in enumerate(e)], "pref bigint, tokens array<string>, guards int")
    want = {(i, -j, round(_jaccard(a, b), 9)) for i, a in enumerate(q) for j, b in enumerate(e) if _jaccard(a, b) >= accept - 1e-9}
    got = simjoin.top_matches(dq, de, accept, 1000)
    assert {(r["qid"], r["pref"], round(r["score"], 9)) for r in got.collect()} == want
    ix = simjoin._Index(dq, de, accept, None, None)
    # At low thresholds the tokens beyond the prefix are the hot ones; above, pairs are verified.
    assert accept < 0.4 or ix.candidate_pairs().where("rest > 0").count() > 0


@pytest.mark.parametrize("accept,guarded,pairs", [(0.10, False, None), (0.10, True, 0), (0.34, False, 0), (0.34, True, None)])
def test_best_matches_equal_brute_force(skewed, accept, guarded, pairs, monkeypatch):
    """In one step, and with ``pairs`` of 0 step by step."""
    q, e, dq, de = skewed
    if pairs is not None:
        monkeypatch.setattr(simjoin, "LADDER_PAIRS", pairs)
    want = {}
    for i, a in enumerate(q):
        pairs = [(_jaccard(a, b), -j) for j, b in enumerate(e) if not guarded or _guard_py(i, j)]
        s, p = max(pairs)
        if s >= accept - 1e-9:
            want[i] = (round(s, 9), p)
    got = simjoin.best_matches(dq, de, accept, _guard if guarded else None)
    rows = {r["qid"]: (round(r["score"], 9), r["pref"]) for r in got.collect()}
    assert rows == want


def test_top_matches_equal_brute_force(skewed):
    q, e, dq, de = skewed
    want = set()
    for i, a in enumerate(q):
        ranked = sorted(((_jaccard(a, b), -j) for j, b in enumerate(e)), reverse=True)
        want |= {(i, p, k) for k, (s, p) in enumerate([x for x in ranked if x[0] >= 0.1 - 1e-9][:5], 1)}
    got = {(r["qid"], r["pref"], r["rank"]) for r in simjoin.top_matches(dq, de, 0.1, 5).collect()}
    assert got == want


@pytest.mark.parametrize("short,guarded", [(8, True), (4, False)])
def test_top_matches_by_subsets_equal_brute_force(skewed, short, guarded, monkeypatch):
    """Short sets by subsets, longer ones by the index."""
    q, e, dq, de = skewed
    monkeypatch.setattr(simjoin, "LADDER_PAIRS", 0)
    monkeypatch.setattr(simjoin, "SUBSET_TOKENS", short)
    want = set()
    for i, a in enumerate(q):
        ranked = sorted(((_jaccard(a, b), -j) for j, b in enumerate(e) if not guarded or _guard_py(i, j)), reverse=True)
        want |= {(i, p, k) for k, (s, p) in enumerate([x for x in ranked if x[0] >= 0.2 - 1e-9][:3], 1)}
    got = {(r["qid"], r["pref"], r["rank"]) for r in simjoin.top_matches(dq, de, 0.2, 3, _guard if guarded else None).collect()}
    assert got == want


def test_rows_of_subsets_grow_with_the_sets(spark):
    """Sets that all share two words: a query meets the best entries of each subset, not all of them."""
    def sets(n, key, sign):
        rows = [(sign * i, ["all", "both", f"a{i}", f"b{i}"], 0) for i in range(n)]
        return spark.createDataFrame(rows, f"{key} bigint, tokens array<string>, guards int")

    pairs = simjoin._subset_matches(sets(300, "qid", 1), sets(300, "pref", -1), 0.3, 2, None, None)
    assert pairs.count() < 300 * 11 * 2


def test_near_best_equal_brute_force(skewed):
    q, e, dq, de = skewed
    want = set()
    for i, a in enumerate(q):
        scores = [(_jaccard(a, b), -j) for j, b in enumerate(e)]
        top = max(scores)[0]
        if top >= 0.2 - 1e-9:
            want |= {(i, p) for s, p in scores if s >= top - 0.08 - 1e-9}
    got = {(r["qid"], r["pref"]) for r in simjoin.near_best_matches(dq, de, 0.2, 0.08).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_sets_equal_brute_force(spark, threshold):
    s = _random_sets(3, 400, 40)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(s)], "set_id bigint, tokens array<string>")
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if _jaccard(s[i], s[j]) >= threshold - 1e-9}
    assert {(r["a"], r["b"]) for r in simjoin.similar_sets(df, threshold).collect()} == want


def test_copies_do_not_multiply_pairs(spark):
    """A third of all products being copies adds members, not rows."""
    titles = ["perro mini pollo fresco rico"] * 500 + [f"gato {i} pato salmon atun" for i in range(1000)]
    products = spark.createDataFrame(list(enumerate(titles)), "product_id bigint, title string")
    out = matching.similar_products(products, 0.8)
    copies = out.where("a = b").collect()
    assert [(r["n_a"], r["n_pairs"]) for r in copies] == [(500, 500 * 499 // 2)]
    assert matching.similar_members(products).where("set_id = 0").count() == 500


def _pictures(seed, products, per_product):
    rng = random.Random(seed)
    rows = []
    for p in range(products):
        centres = [rng.getrandbits(64) for _ in range(max(1, per_product // 6))]
        for i in range(per_product):
            h = rng.choice(centres)
            for _ in range(rng.randint(0, 6)):
                h ^= 1 << rng.randint(0, 63)
            rows.append((p, i, h - (1 << 64) if h >= 1 << 63 else h, rng.randint(1, 50), rng.randint(1, 9)))
    return rows


def _leader_clusters(rows):
    out = []
    for p in {r[0] for r in rows}:
        leaders, members = [], {}
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            hit = next((g for g in leaders if bin((g[2] ^ r[2]) & (1 << 64) - 1).count("1") <= 8), None)
            if hit is None:
                leaders.append(r)
                hit = r
            members.setdefault(hit[1], []).append(r)
        for m in members.values():
            best = max(m, key=lambda r: (r[3], r[4], -r[1]))
            out.append((p, min(r[1] for r in m), best[1], len(m)))
    return sorted(out)


@pytest.mark.parametrize("limit", [256, 5])
def test_dedupe_equals_sequential_clustering(spark, limit):
    rows = _pictures(5, 4, 40) + [(9, i, 77, i, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "product_id bigint, idx bigint, hash bigint, nbytes bigint, area bigint")
    got = images.dedupe_images(df, fold_limit=limit)
    assert sorted(tuple(r) for r in got.select("product_id", "slot", "kept_idx", "members").collect()) == _leader_clusters(rows)


def test_dedupe_rounds_compare_pictures_with_leaders_only(spark, monkeypatch):
    """Tables written between the rounds never exceed the pictures; few and many leaders alike."""
    rng = random.Random(8)
    rows = _pictures(7, 2, 60) + [(9, i, rng.getrandbits(16), i % 7, 1) for i in range(700)]
    df = spark.createDataFrame(rows, "product_id bigint, idx bigint, hash bigint, nbytes bigint, area bigint")
    written, cut = [], images.cut_lineage

    def counted(table):
        out = cut(table)
        written.append(out.count())
        return out

    monkeypatch.setattr(images, "cut_lineage", counted)
    got = images.dedupe_images(df, fold_limit=0)
    assert sorted(tuple(r) for r in got.select("product_id", "slot", "kept_idx", "members").collect()) == _leader_clusters(rows)
    assert max(written) <= len(rows)
    pictures = images._distinct_pictures(df)
    few = images._leaders_in_rounds(pictures, block=5, few=1).select("product_id", "hash", "leader_idx")
    assert sorted(few.collect()) == sorted(images._fold_leaders(pictures).select("product_id", "hash", "leader_idx").collect())


def test_dedupe_is_idempotent_on_its_leaders(spark):
    rows = _pictures(6, 3, 30)
    df = spark.createDataFrame(rows, "product_id bigint, idx bigint, hash bigint, nbytes bigint, area bigint")
    first = images.dedupe_images(df).select("product_id", F.col("slot").alias("idx"))
    kept = df.join(first, ["product_id", "idx"])
    assert images.dedupe_images(kept).count() == kept.count()


def test_rank_of_a_busy_key_spans_partitions(spark):
    """A third of all rows in one key: ranks are exact though no task sees the whole key."""
    from vitrina.operators import filters

    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.34 else rng.randint(2, 400), rng.randint(0, 5), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "product_id bigint, at int, image_id bigint").repartition(4)
    got = {r["image_id"]: r["rank"] for r in filters.rank_within(df, ["product_id"], ["at", "image_id"]).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        for k, r in enumerate(sorted(r for r in rows if r[0] == p), 1):
            want[r[2]] = k
    assert got == want


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, f"{TESTDATA}/sf0.001")


def test_applied_plan_verifies(tables):
    plan = UQ.plan(tables)
    products, variants = unify.apply_plan(*UQ.shop(tables), plan)
    rows = unify.verify_plan(unify.checks_of(plan), products, variants)
    assert rows.where("status <> 'OK'").isEmpty() and not rows.isEmpty()


def test_second_run_adds_nothing(tables):
    p = B.products(tables).select("product_id")
    registry = provenance.extend_registry(p.limit(0), p)
    assert provenance.pending(p, registry).isEmpty()
    again = provenance.extend_registry(registry, p)
    assert again.exceptAll(registry).isEmpty() and registry.exceptAll(again).isEmpty()


@pytest.mark.parametrize("bucket", [1, 7, 1000, 1 << 40])
def test_history_does_not_depend_on_buckets(tables, bucket):
    w = B.writes(tables)
    want = {(r["product_id"], r["seq"]) for r in provenance.history_changes(w).collect()}
    assert {(r["product_id"], r["seq"]) for r in provenance.history_changes(w, bucket=bucket).collect()} == want


def _streamed_log(spark, folder, parts, lateness=None):
    """The log of a stream whose micro-batches are ``parts``, each a list of (product_id, seq, url)."""
    schema = "product_id bigint, seq bigint, url string"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = str(folder / "out")
    incremental.drain(incremental.history_log(stream, lateness), out, str(folder / "state")).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("order,lateness", [("sorted", None), ("shuffled", None), ("reversed", None), ("shuffled", 10**9), ("sorted", 0)])
def test_stream_equals_batch_in_any_order(spark, tables, tmp_path, order, lateness):
    w = B.writes(tables).where("seq < 1050")
    rows = [(r["product_id"], r["seq"], r["url"]) for r in w.orderBy("seq").collect()]
    if order == "shuffled":
        random.Random(5).shuffle(rows)
    elif order == "reversed":
        rows.reverse()
    log = _streamed_log(spark, tmp_path, [rows[i::4] if order == "shuffled" else rows[i * 263:(i + 1) * 263] for i in range(4)], lateness)
    got = incremental.history_of_log(log).collect()
    assert {(r["product_id"], r["seq"], r["url"]) for r in got} == {
        (r["product_id"], r["seq"], r["url"]) for r in provenance.history_changes(w).collect()}
    assert order != "reversed" or not log.where("change < 0").isEmpty()


def test_rows_beyond_the_lateness_are_logged(spark, tmp_path):
    parts = [[(1, 10, "a"), (1, 20, "b"), (2, 5, None)], [(1, 12, "c"), (1, 20, "b"), (1, 30, "b")], [(1, 28, "a"), (1, 3, "z")]]
    log = {tuple(r) for r in _streamed_log(spark, tmp_path, parts, 9).collect()}
    assert log == {(1, 10, "a", 1), (1, 20, "b", 1), (1, 12, "c", 1), (1, 28, "a", 1), (1, 30, "b", 1), (1, 3, "z", 0)}


def test_registry_stream_respects_earlier_runs(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "product_id bigint").write.parquet(str(tmp_path / "r" / "batch=-1"))
    spark.createDataFrame([(2,), (3,), (3,)], "product_id bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("product_id bigint").parquet(str(tmp_path / "in"))
    incremental.register_products(stream, str(tmp_path / "r"), str(tmp_path / "s")).awaitTermination()
    assert sorted(r["product_id"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [1, 2, 3]


def test_resolution_is_a_function(tables):
    from vitrina.plans.cascade_queries import resolve

    r = resolve(tables)
    assert r.count() == r.select("product_id").distinct().count() == B.products(tables).count()


def test_no_plan_is_a_cross_product(tables):
    """No registered query joins without an equality."""
    from vitrina.plans import QUERIES

    for name in ("j01_match_best", "j08_block_fallback", "j11_top_candidates", "u06_fragment_groups", "u11_reasoned_deletions", "j31_result_links"):
        df = QUERIES[name](tables.spark, tables.folder)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Join Inner\n" not in plan, name


def test_similar_sets_by_sketches_equal_brute_force(spark):
    """Sketches end pairs where they arise and lose none, sets longer than a sketch's bits included."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    base = [set(rng.sample(words, n)) for n in (1, 5, 9, 40, 300, 700) for _ in range(4)]
    sets = base + [(b - set(rng.sample(sorted(b), len(b) // 9))) | set(rng.sample(words, len(b) // 12)) for b in base for _ in range(3)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "set_id bigint, tokens array<string>")
    got = simjoin.similar_sets(df, 0.8)
    assert "bit_count" in got._jdf.queryExecution().analyzed().toString()
    want = {(i, j, round(_jaccard(a, b), 9)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and _jaccard(a, b) >= 0.8 - 1e-9}
    assert want and {(r["a"], r["b"], round(r["score"], 9)) for r in got.collect()} == want


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    """A file of 4 MB may be hundreds of MB in the driver."""
    rows = spark.range(450_000).withColumn("h", F.xxhash64("id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    joined = table.join(table.withColumnRenamed("h", "g"), "id")
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_variant_images_broadcast_nothing(spark):
    """Variants unfolded from few bytes aren't sent through the driver; repeated pictures count once."""
    v = spark.createDataFrame([(1, 10, "rojo 5kg"), (1, 11, "azul 2kg"), (2, 20, "verde")], "product_id bigint, variant_id bigint, title string")
    i = spark.createDataFrame([(1, 7, 2, "saco rojo 5 kg"), (1, 7, 2, "saco rojo 5 kg"), (1, 6, 2, "saco rojo 5 kg"), (1, 5, None, "azul"), (2, 8, 1, None)],
                              "product_id bigint, image_id bigint, position int, raw_text string")
    got = images.assign_variant_images(v, i)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["variant_id"]: (r["image_id"], r["image_pos"]) for r in got.collect()}
    assert rows == {10: (6, 2), 11: (5, 999), 20: (None, None)}


def test_image_run_rounds_bytes_as_its_sql(spark, tmp_path):
    """Two copies whose prices differ by a fraction: the SQL rounds it, so the dearer one is kept."""
    duckdb = pytest.importorskip("duckdb")
    from vitrina.plans import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT 1::BIGINT AS o_orderkey, 'O' AS o_orderstatus) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"""COPY (SELECT 1::BIGINT AS l_orderkey, k::BIGINT AS l_partkey, k::BIGINT AS l_suppkey, 2 AS l_linenumber, q::DOUBLE AS l_quantity,
        price::DOUBLE AS l_extendedprice, 'A' AS l_returnflag, 'F' AS l_linestatus FROM (VALUES (5, 33, 100.19), (6, 18, 100.85), (7, 40, 100.5)) v(k, q, price))
        TO '{tmp_path}/lineitem.parquet'""")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = QUERIES["r02_image_run"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['r02_image_run']})").fetchall()
    assert [tuple(r) for r in got.collect()] == want == [(1, 1, "https://cdn.example.com/6-6.jpg", "match", 3)]
