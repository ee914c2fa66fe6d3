import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.operators import batch_search as B, drift, ivf
from shelfmark.operators.search import project_fields, semantic_search
from shelfmark.sources import buckets, tables

DIM, N = 70, 300


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    made = rng.normal(size=(N, DIM)).astype(np.float32)
    made[10] = made[11] = made[12]  # copies, to tie
    return made


@pytest.fixture(scope="module")
def embeddings(spark, points):
    rows = [(f"K{i:03d}", [float(x) for x in v], int(i % 3)) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "parent_asin string, embedding array<float>, category int")
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def products(spark):
    rows = [(f"K{i:03d}", f"title {i}", float(i) if i % 4 else None, 1.0 + i % 5, i % 2) for i in range(N - 1)]
    return spark.createDataFrame(
        rows, "parent_asin string, title string, price double, average_rating double, rating_number int"
    ).withColumns({"store": F.lit("s"), "main_category": F.lit("c")})


def brute(points, query, k, oversample):
    query = np.asarray(query, np.float64)
    ham = ((points > 0) != (query > 0)).sum(axis=1)
    first = sorted(range(len(points)), key=lambda i: (ham[i], i))[: k * oversample]
    p = points.astype(np.float64)
    dist = {i: 1 - p[i] @ query / np.linalg.norm(p[i]) / np.linalg.norm(query) for i in first}
    return sorted(first, key=lambda i: (round(dist[i], 12), i))[:k], dist


def test_bits_and_hamming(spark, embeddings, points):
    local = V.pack_bits_local(points[0])
    got = embeddings.filter("parent_asin = 'K000'").select(V.pack_bits("embedding", DIM).alias("b")).first().b
    assert got == local and len(got) == 2
    other = F.array(*[F.lit(x).cast("bigint") for x in V.pack_bits_local(points[1])])
    found = embeddings.filter("parent_asin = 'K000'").select(
        V.hamming(V.pack_bits("embedding", DIM), other, 2).alias("h")
    ).first().h
    assert found == int(((points[0] > 0) != (points[1] > 0)).sum())


def test_zero_vector(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(V.cosine_distance(zero, zero).alias("d"), V.l2_normalize(zero).alias("n")).first()
    assert math.isnan(row.d) and row.n == [0.0, 0.0]


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("lookup", ["join", "keys"])
def test_two_stage_search(spark, embeddings, products, points, stored, lookup):
    corpus = embeddings.withColumn("bits", V.pack_bits("embedding", DIM)) if stored else embeddings
    query = [float(x) for x in points[12] + 0.01]
    want, dist = brute(points, query, 6, 3)
    found = semantic_search(corpus, products, query, dim=DIM, top_k=6, oversample=3, lookup=lookup).collect()
    assert [r.parent_asin for r in found] == [f"K{i:03d}" for i in want if i < N - 1]
    assert found[0]._distance == pytest.approx(dist[want[0]], abs=1e-9)


def test_query_as_table_and_filters(spark, embeddings, products, points):
    asked = embeddings.filter("parent_asin = 'K020'").select("embedding")
    everything = {r.parent_asin: r for r in semantic_search(embeddings, products, asked, dim=DIM, top_k=20).collect()}
    kept = semantic_search(
        embeddings, products, asked, dim=DIM, top_k=20, max_price=150.0, min_rating=2.0, only_in_stock=True
    ).collect()
    ok = [k for k, r in everything.items() if r.price is not None and r.price <= 150 and r.average_rating >= 2]
    assert {r.parent_asin for r in kept} <= set(ok)
    pre = semantic_search(
        embeddings, products, asked, dim=DIM, top_k=20, max_price=150.0, filter_mode="pre"
    ).collect()
    assert len(pre) == 20 and all(r.price <= 150 for r in pre)


def test_plan_is_a_top_k(spark, embeddings, products, capsys):
    asked = embeddings.filter("parent_asin = 'K020'").select("embedding")
    semantic_search(embeddings, products, asked, dim=DIM).explain()
    plan = capsys.readouterr().out
    assert plan.count("TakeOrderedAndProject") == 3
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan


def test_projection():
    assert project_fields(["title", "title"]) == ["parent_asin", "title"]
    assert project_fields(None)[0] == "parent_asin"
    with pytest.raises(ValueError, match="videos"):
        project_fields(["videos"])
    with pytest.raises(ValueError):
        semantic_search(None, None, [1.0], top_k=51)


@pytest.mark.parametrize("block_queries", [4096, 3, 1])
def test_batch_search_in_blocks(spark, embeddings, points, block_queries):
    asked = embeddings.filter("parent_asin < 'K008'").select(
        F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector")
    )
    found = B.semantic_search_batch(
        embeddings.repartition(5), asked, dim=DIM, top_k=4, oversample=5, block_queries=block_queries
    ).collect()
    for q in range(8):
        want, _ = brute(points, points[q], 4, 5)
        got = [r.parent_asin for r in sorted(found, key=lambda r: r._rank) if r.query_id == f"K{q:03d}"]
        assert got == [f"K{i:03d}" for i in want]


def test_blocks_are_bounded_and_hold_every_query_once(spark):
    asked = spark.range(23).select(F.col("id").alias("query_id")).repartition(3)
    numbered, blocks = B._numbered_blocks(asked, 4)
    sizes = {r["_block"]: r["count"] for r in numbered.groupBy("_block").count().collect()}
    assert set(sizes) == set(range(blocks)) and max(sizes.values()) <= 4 and sum(sizes.values()) == 23
    assert B._numbered_blocks(asked.limit(0), 4)[1] == 0


def test_blocks_are_as_few_as_hold_the_queries(spark):
    asked = spark.range(0, 10, 1, 5).select(F.col("id").alias("query_id"))
    numbered, blocks = B._numbered_blocks(asked, 4)
    assert blocks == 3 and numbered.groupBy("_block").count().orderBy("_block").collect() == [(0, 4), (1, 4), (2, 2)]
    assert not any("/_block=" in f for f in numbered.inputFiles())


def test_rows_without_a_vector_take_no_part_in_batch_search(spark, embeddings):
    first = embeddings.orderBy("parent_asin").limit(30)
    odd = first.withColumn("embedding", F.when(F.substring("parent_asin", 4, 1) != "7", F.col("embedding")))
    asked = odd.filter("parent_asin < 'K009'").select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    found = B.semantic_search_batch(odd, asked, dim=DIM, top_k=27, oversample=1).collect()
    names = {r.parent_asin for r in odd.filter("embedding IS NOT NULL").collect()}
    assert len(names) == 27 and {r.query_id for r in found} == {f"K00{i}" for i in range(9) if i != 7}
    assert all({r.parent_asin for r in found if r.query_id == q} == names for q in {r.query_id for r in found})


def test_batch_search_of_a_corpus_with_empty_parts(spark, embeddings):
    few = embeddings.filter("parent_asin < 'K003'").repartition(64, "parent_asin")
    assert few.withColumn("p", F.spark_partition_id()).select("p").distinct().count() <= 3
    asked = few.select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    found = B.semantic_search_batch(few, asked, dim=DIM, top_k=3, oversample=1).collect()
    assert {(r.query_id, r.parent_asin) for r in found} == {(f"K00{a}", f"K00{b}") for a in range(3) for b in range(3)}
    assert B.exact_search_batch(few, asked, top_k=3).count() == 9


def test_ivf_cells_that_probes_or_rows_are_missing_from(spark, embeddings, tmp_path, monkeypatch):
    """Two rows and two probes dealt to many cells by hash: most hold one side only."""
    monkeypatch.setattr(ivf, "CELL_ROWS", 1)
    monkeypatch.setattr(ivf, "CELL_PROBES", 1)
    few = embeddings.filter("parent_asin < 'K006'").select("parent_asin", "embedding")
    lists = embeddings.filter("parent_asin = 'K000'").select(F.lit(0).alias("list_id"), F.col("embedding").alias("centroid"))
    ivf.write_lists(ivf.assign_lists(few, lists), str(tmp_path / "lists"))
    asked = few.select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.ivf_search_batch(spark, str(tmp_path / "lists"), lists, asked, top_k=6).collect()
    assert len({(r.query_id, r.parent_asin) for r in found}) == len(found) == 36


@pytest.mark.parametrize("mode", ["post", "pre"])
def test_batch_search_with_products_is_the_single_search_for_each(spark, embeddings, products, mode):
    asked = embeddings.filter("parent_asin < 'K004'").select(
        F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector")
    )
    limits = dict(dim=DIM, top_k=8, oversample=3, max_price=150.0, min_rating=1.5, fields=["title", "price"], filter_mode=mode)
    found = B.semantic_search_batch(embeddings, asked, products, block_queries=3, **limits)
    assert found.columns == ["query_id", "parent_asin", "title", "price", "_distance", "_rank"]
    rows = found.collect()
    for q in [f"K{i:03d}" for i in range(4)]:
        one = embeddings.filter(F.col("parent_asin") == q).select("embedding")
        want = [tuple(r) for r in semantic_search(embeddings, products, one, **limits).collect()]
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r._rank)
        assert [(r.parent_asin, r.title, r.price) for r in got] == [w[:3] for w in want] and want
        assert [r._distance for r in got] == pytest.approx([w[3] for w in want])
    with pytest.raises(ValueError):
        B.semantic_search_batch(embeddings, asked, products, filter_mode="both")


@pytest.fixture()
def stored(spark, embeddings, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path), buckets=16)
    store.merge("vectors", buckets.VECTORS, buckets.vector_rows(embeddings, DIM), tables.upsert)
    return store.read("vectors", buckets.VECTORS)


@pytest.mark.parametrize("lookup", ["join", "keys"])
@pytest.mark.parametrize("mode", ["post", "pre"])
def test_stored_vectors_give_the_same_hits(spark, embeddings, products, points, stored, lookup, mode):
    query = [float(x) for x in points[12] + 0.01]
    limits = dict(dim=DIM, top_k=6, oversample=3, max_price=180.0, lookup=lookup, filter_mode=mode)
    want = semantic_search(embeddings, products, query, **limits).collect()
    assert semantic_search(stored, products, query, **limits).collect() == want and want


def test_stage_two_reads_the_buckets_of_its_candidates_only(spark, products, points, stored, capsys):
    found = semantic_search(stored, products, [float(x) for x in points[3]], dim=DIM, top_k=1, oversample=2)
    found.explain("formatted")
    plan = capsys.readouterr().out
    scans = [s for s in plan.split("\n\n") if "Scan parquet" in s and "ReadSchema" in s]
    first = [s for s in scans if "bits:array<bigint>" in s]
    second = [s for s in scans if "embedding:array<float>" in s]
    assert first and second
    assert all("embedding" not in s.split("ReadSchema")[1] for s in first)  # stage 1 reads no vectors
    for s in second:
        assert "PartitionFilters" in s and "dynamicpruning" in s and "bits" not in s.split("ReadSchema")[1]


def test_recall_is_one_when_the_window_covers_the_corpus(spark, embeddings):
    asked = B.category_centers(embeddings)
    exact = B.exact_search_batch(embeddings, asked, top_k=5)
    found = B.semantic_search_batch(embeddings, asked, dim=DIM, top_k=5, oversample=-(-N // 5))
    assert {r.recall for r in B.recall_at_k(exact, found).collect()} == {1.0}


def test_no_queries(spark, embeddings):
    none = embeddings.limit(0).select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    assert B.semantic_search_batch(embeddings, none, dim=DIM).count() == 0


def test_ivf(spark, embeddings, points, tmp_path):
    lists = ivf.fit_centroids(embeddings, lists=4, max_iter=5)
    assigned = ivf.assign_lists(embeddings, lists)
    path = str(tmp_path / "lists")
    ivf.write_lists(assigned, path, rows_per_part=40)
    query = [float(x) for x in points[3]]
    all_lists = ivf.ivf_search(spark, path, lists, query, probes=4, top_k=5).collect()
    want, _ = brute(points, query, 5, N)
    assert [r.parent_asin for r in all_lists] == [f"K{i:03d}" for i in want]
    one = ivf.ivf_search(spark, path, lists, query, probes=1, top_k=5)
    assert len({r.list_id for r in one.collect()}) == 1


@pytest.mark.parametrize("probes, block_probes", [(4, 4096), (2, 4096), (2, 3), (1, 1)])
def test_ivf_for_many_queries(spark, embeddings, points, tmp_path, probes, block_probes):
    lists = ivf.fit_centroids(embeddings, lists=4, max_iter=5)
    assigned = ivf.assign_lists(embeddings, lists)
    path = str(tmp_path / "lists")
    ivf.write_lists(assigned, path, rows_per_part=30)
    parts = spark.read.parquet(path).groupBy("list_id").agg(F.max("part").alias("p"), F.count("*").alias("n")).collect()
    assert all(r.p == -(-r.n // 30) - 1 for r in parts)
    asked = embeddings.filter("parent_asin < 'K010'").select(
        F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector")
    )
    found = ivf.ivf_search_batch(spark, path, lists, asked, probes=probes, top_k=5, block_probes=block_probes).collect()
    for q in range(10):
        one = ivf.ivf_search(spark, path, lists, [float(x) for x in points[q]], probes=probes, top_k=5).collect() if q < 3 else None
        got = sorted((r for r in found if r.query_id == f"K{q:03d}"), key=lambda r: r._rank)
        assert len({r.list_id for r in got}) <= probes and [r._rank for r in got] == list(range(1, len(got) + 1))
        if one is not None:
            assert [(r.parent_asin, r.list_id) for r in got] == [(r.parent_asin, r.list_id) for r in one]
            assert [r._distance for r in got] == pytest.approx([r._distance for r in one])
        if probes == 4:
            want, _ = brute(points, points[q], 5, N)
            assert [r.parent_asin for r in got] == [f"K{i:03d}" for i in want]
    none = ivf.ivf_search_batch(spark, path, lists, asked.limit(0), probes=probes)
    assert none.collect() == [] and none.columns == ["query_id", "parent_asin", "_distance", "list_id", "_rank"]


def test_probed_lists_are_met_in_one_job_whatever_the_block(spark, embeddings, tmp_path, monkeypatch):
    lists = ivf.fit_centroids(embeddings, lists=4, max_iter=5)
    path = str(tmp_path / "lists")
    ivf.write_lists(ivf.assign_lists(embeddings, lists), path, rows_per_part=30)
    asked = embeddings.select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))

    def jobs(count, tag):
        spark.sparkContext.setJobGroup(tag, tag)
        found = ivf.ivf_search_batch(spark, path, lists, asked.limit(count), probes=2, top_k=5, block_probes=4)
        made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return made, found.orderBy("query_id", "_rank").collect()

    few, _ = jobs(4, "few")
    many, want = jobs(N, "many")
    assert many <= few + 4 and len(want) == 5 * N  # 4 probes a block would make about 150 blocks
    monkeypatch.setattr(ivf, "CELL_ROWS", 17)
    monkeypatch.setattr(ivf, "CELL_PROBES", 23)
    _, got = jobs(N, "cells")
    plain = lambda rows: [(r.query_id, r.parent_asin, r.list_id, r._rank) for r in rows]
    assert plain(got) == plain(want) and [r._distance for r in got] == pytest.approx([r._distance for r in want], abs=1e-12)


def test_probe_blocks():
    assert ivf._probe_blocks([(1, 3), (2, 5), (3, 1)], 4) == [[(1, 0, 1)], [(2, 0, 2)], [(2, 1, 2), (3, 0, 1)]]
    assert ivf._probe_blocks([(7, 2), (9, 2)], 4) == [[(7, 0, 1), (9, 0, 1)]]


def test_recall_of_probed_lists_on_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 32))
    rows = [(f"V{i:04d}", (middles[i % 12] + 0.35 * rng.normal(size=32)).tolist()) for i in range(1200)]
    e = spark.createDataFrame(rows, "parent_asin string, embedding array<float>").repartition(4)
    lists = ivf.fit_centroids(e, lists=12, max_iter=10)
    path = str(tmp_path / "lists")
    ivf.write_lists(ivf.assign_lists(e, lists), path)
    asked = e.filter("parent_asin like '%7'").select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.ivf_search_batch(spark, path, lists, asked, probes=3, top_k=10)
    recall = B.recall_at_k(B.exact_search_batch(e, asked, top_k=10), found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9  # at 3 of 12 lists


def test_drift(spark, embeddings):
    scaled = embeddings.withColumn("embedding", V.l2_normalize(F.col("embedding")))
    same = {r.js_divergence for r in drift.embedding_drift(scaled, scaled).collect()}
    assert max(same) < 1e-12
    far = scaled.withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.95).cast("float")))
    moved = drift.embedding_drift(far, scaled).collect()
    assert all(r.js_divergence > 0.99 for r in moved)


def test_vanished_category_diverges_fully(spark, embeddings):
    whole = embeddings.withColumn("category", (F.length("parent_asin") * 0 + F.substring("parent_asin", 4, 1).cast("int")))
    got = {r.category: r.js_divergence for r in drift.embedding_drift(whole.filter("category <> 3"), whole).collect()}
    assert len(got) == 10 and got[3] == 1.0 and got[4] < 1e-12


def test_ivf_without_vectors(spark, embeddings, tmp_path):
    odd = embeddings.limit(2).withColumns({
        "parent_asin": F.concat(F.lit("odd"), "parent_asin"),
        "embedding": F.when(F.col("parent_asin") == "K000", F.transform("embedding", lambda x: x * 0)),
    })
    both = embeddings.unionByName(odd)
    lists = ivf.fit_centroids(both, lists=4, max_iter=5)
    path = str(tmp_path / "lists")
    ivf.write_lists(ivf.assign_lists(both, lists), path, rows_per_part=40)
    want = both.filter("embedding is not null").count()
    assert spark.read.parquet(path).count() == want


def test_half_and_text(spark):
    df = spark.createDataFrame([([0.1, -2.5, 70000.0],), (None,)], "v array<float>")
    half = [r[0] for r in df.select(V.to_half("v")).collect()]
    assert half[0][0] == float(np.float16(np.float32(0.1))) and math.isinf(half[0][2]) and half[1] is None
    text = df.select(V.vector_text(F.col("v"))).first()[0]
    assert text == "[0.100000,-2.500000,70000.000000]"
    assert spark.range(1).select(V.parse_vector(F.lit(text))).first()[0] == pytest.approx([0.1, -2.5, 70000.0])


def test_vector_text_rounds_halves_to_even(spark):
    values = [k / 128 for k in range(-9, 10)] + [-0.0703125, 3.2890625, -1e-8, 0.1, 1e-7, 5e-7, 12345.0078125]
    values += np.random.default_rng(4).normal(size=200).astype(np.float32).tolist()
    df = spark.createDataFrame([(values,)], "v array<float>")
    want = "[" + ",".join(f"{float(np.float32(x)):.6f}" for x in values) + "]"
    assert df.select(V.vector_text(F.col("v"))).first()[0] == want


def test_best_rows_are_the_smallest_and_ties_go_by_key():
    keys = np.array(["b", "a", "d", "c"], object)
    assert B._best(keys, np.array([1.0, 1.0, 0.5, 2.0]), 2).tolist() == [2, 1]
    assert B._best(keys, np.array([1.0, 1.0, 1.0, 1.0]), 3).tolist() == [1, 0, 3]
    assert B._best(keys[:1], np.array([3.0]), 5).tolist() == [0]
    assert B._best(keys[:0], np.array([]), 5).tolist() == []
