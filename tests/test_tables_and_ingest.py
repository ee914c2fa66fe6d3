import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import models, tracking
from shelfmark.plans import ingest
from shelfmark.session import spread
from shelfmark.sources import buckets, jsonl, seed, tables
from shelfmark.streaming import ingest as stream_ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_upsert_policy(spark):
    shape = "parent_asin string, title string, store string, seq int"
    old = spark.createDataFrame([("A", "a", "s", 0), ("B", "b", None, 0), ("C", "c", "s", 0)], shape).drop("seq")
    new = spark.createDataFrame(
        [("B", "b2", "new", 2), ("B", "b1", "x", 1), ("D", "d1", "first", 1), ("D", "d2", "second", 2), ("C", None, "z", 1)],
        shape,
    )
    got = rows(tables.upsert_products(old, new, ["seq"]))
    assert got == [("A", "a", "s"), ("B", "b2", None), ("C", None, "s"), ("D", "d2", "first")]
    again = tables.upsert_products(tables.upsert_products(old, new, ["seq"]), new, ["seq"])
    assert rows(again) == got


def test_insert_if_absent_and_cascade(spark):
    old = spark.createDataFrame([("A", 1)], "parent_asin string, v int")
    new = spark.createDataFrame([("A", 2), ("B", 3)], "parent_asin string, v int")
    assert rows(tables.insert_if_absent(old, new)) == [("A", 1), ("B", 3)]
    left, = tables.delete_cascade(old, new)
    assert rows(left) == [("B", 3)]


def test_failed_version_is_not_read(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path))
    schema = "parent_asin string, v int"
    assert store.read("t", schema).count() == 0
    store.replace("t", spark.createDataFrame([("A", 1)], schema))
    (tmp_path / "t" / "v=2").mkdir()  # left behind by a write that did not finish
    assert store.version("t") == 1 and rows(store.read("t", schema)) == [("A", 1)]
    store.replace("t", spark.createDataFrame([("A", 2)], schema))
    assert store.version("t") == 3 and rows(store.read("t", schema)) == [("A", 2)]


def test_new_ids(spark):
    old = spark.createDataFrame([(41,)], "id long")
    ids = [r.id for r in tables.with_new_ids(spark.range(100).repartition(7).select("id"), old, "id").collect()]
    assert len(set(ids)) == 100 and min(ids) > 41


PRODUCT_LINES = [
    '{"parent_asin": "P1", "title": "<b>One</b> &amp; only", "price": "$1,234.50", "average_rating": 4.26, '
    '"rating_number": 7, "features": ["<i>f1</i>", "", "f2"], "details": {"k": 1}, "store": "s1"}',
    "",
    "{broken",
    '{"parent_asin": "", "title": "no key"}',
    '{"title": "no key either"}',
    '{"parent_asin": "P2", "title": null, "price": null, "features": "not a list", "average_rating": "bad"}',
    "   ",
    '{"parent_asin": "P1", "title": "One again", "store": "s2", "price": 12}',
]
REVIEW_LINES = [
    '{"parent_asin": "P1", "user_id": "u1", "rating": 5.0, "text": "good", "timestamp": 1588615855070, '
    '"helpful_vote": 2, "verified_purchase": true}',
    '{"parent_asin": "P1", "user_id": "u2", "rating": 0, "text": "zero"}',
    '{"parent_asin": "P2", "user_id": "u2", "rating": 6, "text": "six"}',
    '{"parent_asin": "P2", "user_id": "u3", "rating": 1.5, "text": null, "timestamp": "2020-01-01T00:00:00Z"}',
    '{"parent_asin": "P2", "user_id": "", "rating": 3}',
    '{"parent_asin": "P2", "user_id": "u4", "rating": null}',
    '{"parent_asin": "PX", "user_id": "u5", "rating": 3, "text": "unknown product"}',
    "nonsense",
]


@pytest.fixture
def inputs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "meta.jsonl").write_text("\n".join(PRODUCT_LINES) + "\n")
    with gzip.open(folder / "reviews.jsonl.gz", "wt") as fh:
        fh.write("\n".join(REVIEW_LINES))
    return str(folder / "meta.jsonl"), str(folder / "reviews.jsonl")


def test_reader(spark, inputs):
    raw = jsonl.read_jsonl(spark, inputs[0], schemas.RAW_PRODUCT_FIELDS).cache()
    assert jsonl.unreadable(raw).count() == 1
    good = jsonl.readable(raw)
    assert good.count() == 5
    first = good.orderBy("_source").first()
    assert json.loads(first.details) == {"k": 1} and first.average_rating == "4.26"
    sizes = {r.path: r.length for r in jsonl.check_inputs(spark, inputs).collect()}
    assert all(sizes[p] > 0 for p in inputs)
    with pytest.raises(FileNotFoundError, match="a.jsonl.*b.jsonl"):
        folder = inputs[0].rsplit("/", 1)[0]
        jsonl.check_inputs(spark, [f"{folder}/a.jsonl", f"{folder}/b.jsonl", inputs[0]])


def test_one_form_of_a_file_is_read(spark, inputs, tmp_path):
    meta, reviews = inputs
    for path, text in ((f"{meta}.bak", PRODUCT_LINES), (f"{reviews}.bak", REVIEW_LINES)):
        with open(path, "w") as fh:
            fh.write("\n".join(text))
    with gzip.open(f"{meta}.gz", "wt") as fh:
        fh.write("\n".join(PRODUCT_LINES))
    found = {r.path: r.found for r in jsonl.check_inputs(spark, inputs).collect()}
    assert found == {meta: meta, reviews: f"{reviews}.gz"}
    store = tables.TableStore(spark, str(tmp_path / "store"))
    for batch in ("w1", "w2"):  # the same files again, under another name
        ingest.ingest(spark, store, *inputs, batch=batch, encoder=ingest.default_encoder(64), drop_repeats=True)
    assert store.read_appended("reviews", schemas.REVIEWS).count() == 2
    with pytest.raises(FileNotFoundError, match="no_folder/a.jsonl.*no_folder/b.jsonl"):
        jsonl.check_inputs(spark, [str(tmp_path / "no_folder/a.jsonl"), str(tmp_path / "no_folder/b.jsonl")])


def test_lines_and_files_agree(spark, inputs):
    from_file = jsonl.readable(jsonl.read_jsonl(spark, inputs[0], schemas.RAW_PRODUCT_FIELDS)).drop("_source")
    lines = spark.createDataFrame([(x,) for x in PRODUCT_LINES], "line string")
    from_lines = jsonl.readable(jsonl.parse_lines(lines, schemas.RAW_PRODUCT_FIELDS))
    columns = ["parent_asin", "title", "price", "features", "details"]

    def values(df):
        # A file keeps the spacing inside nested JSON, a parsed column does not.
        return sorted(str(tuple(r)).replace(", ", ",").replace(": ", ":") for r in df.select(*columns).collect())

    assert values(from_file) == values(from_lines)


def test_whole_ingest_twice(spark, inputs, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "store"))

    def score(df):
        return df.withColumn("sentiment_label", F.lit("POSITIVE")).withColumn("sentiment_score", F.lit(0.98765))

    for _ in range(2):
        counts = ingest.ingest(
            spark, store, *inputs, batch="w1", encoder=ingest.default_encoder(64), score=score, run_id="r"
        ).first()
        assert tuple(counts) == (2, 2, 2, 2, 1, 2, 1, 2)
    run = store.read_appended("runs", schemas.RUNS).collect()
    assert len(run) == 1 and run[0].metrics["total_embed"] == 2 and run[0].metrics["embedding_dim"] == 64
    products = {r.parent_asin: r for r in store.read("products", schemas.PRODUCTS).collect()}
    one = products["P1"]
    assert (one.title, one.store, str(one.price), one.price_raw) == ("One again", "s1", "12.00", "12")
    assert products["P2"].features == [] and products["P2"].average_rating is None
    got = {r.user_id: r for r in store.read_appended("reviews", schemas.REVIEWS).collect()}
    assert set(got) == {"u1", "u3"} and got["u1"].timestamp_raw == 1588615855070
    assert got["u1"].sentiment_label == "positive" and str(got["u1"].sentiment_score) == "0.9877"
    assert got["u3"].reviewed_at.isoformat() == "2020-01-01T00:00:00" and got["u3"].timestamp_raw is None
    vectors = store.read("embeddings", schemas.EMBEDDINGS).collect()
    assert all(len(v.embedding) == 64 and len(v.bits) == 1 and v.run_id == "r" for v in vectors)


def test_a_failed_repeat_of_a_batch_keeps_the_rows_of_the_first(spark, tmp_path):
    store, schema = tables.TableStore(spark, str(tmp_path)), "parent_asin string, v int"
    store.append("t", spark.createDataFrame([("A", 1)], schema), "w1")
    store.append("t", spark.createDataFrame([("B", 2)], schema), "w2")
    (tmp_path / "t" / "batch=w1" / "v=2").mkdir()  # a repeat that did not finish
    (tmp_path / "t" / "batch=w3" / "v=1").mkdir(parents=True)  # a batch that did not finish
    assert rows(store.read_appended("t", schema)) == [("A", 1), ("B", 2)] and store.batches("t") == ["w1", "w2"]
    store.append("t", spark.createDataFrame([("A", 9)], schema), "w1")
    assert rows(store.read_appended("t", schema)) == [("A", 9), ("B", 2)]
    assert rows(store.read_appended("t", schema, without="w1")) == [("B", 2)]


@pytest.fixture
def keyed(spark, tmp_path):
    return buckets.BucketStore(spark, str(tmp_path / "keyed"), buckets=8)


SHAPE = "parent_asin string, v int"


def files(tmp_path, name):
    return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "keyed" / name / "data").rglob("*.parquet")}


def test_a_merge_rewrites_the_buckets_of_its_batch_only(spark, keyed, tmp_path):
    old = spark.createDataFrame([(f"K{i}", i) for i in range(200)], SHAPE)
    assert keyed.merge("t", SHAPE, old, tables.upsert) == 1
    before = files(tmp_path, "t")
    new = spark.createDataFrame([("K7", -7), ("K7x", 1)], SHAPE)
    touched = {r[0] for r in new.select(buckets.bucket_of("parent_asin", 8)).collect()}
    assert keyed.merge("t", SHAPE, new, tables.upsert) == 2
    after = files(tmp_path, "t")
    assert before.items() <= after.items() and len(after) - len(before) == len(touched) <= 2
    got = dict(rows(keyed.read("t", SHAPE), "parent_asin", "v"))
    assert got == {f"K{i}": i for i in range(200)} | {"K7": -7, "K7x": 1}
    assert dict(rows(keyed.read("t", SHAPE, version=1), "parent_asin", "v"))["K7"] == 7  # the version before
    one = keyed.read("t", SHAPE, buckets=[min(touched)])
    assert {r.bucket for r in one.select("bucket").distinct().collect()} == {min(touched)}


def test_unfinished_merges_and_repeated_batches(spark, keyed, tmp_path):
    keyed.merge("t", SHAPE, spark.createDataFrame([("A", 1)], SHAPE), tables.upsert, "b1")
    (tmp_path / "keyed" / "t" / "data" / "store_version=2" / "bucket=0").mkdir(parents=True)  # its manifest is missing
    (tmp_path / "keyed" / "t" / "manifest" / "store_version=2").mkdir()
    assert keyed.versions("t") == [1] and rows(keyed.read("t", SHAPE), "parent_asin", "v") == [("A", 1)]
    add = lambda old, new: old.unionByName(new)  # noqa: E731  not repeatable by itself
    assert keyed.merge("t", SHAPE, spark.createDataFrame([("A", 2)], SHAPE), add, "b2") == 3
    assert keyed.merge("t", SHAPE, spark.createDataFrame([("A", 2)], SHAPE), add, "b2") == 3
    assert rows(keyed.read("t", SHAPE), "parent_asin", "v") == [("A", 1), ("A", 2)]
    assert keyed.merge("t", SHAPE, spark.createDataFrame([], SHAPE), add, "b3") == 3
    with pytest.raises(ValueError, match="8 buckets"):
        buckets.BucketStore(spark, keyed.root, buckets=4).read("t", SHAPE)
    assert keyed.read("none", SHAPE).columns == ["parent_asin", "v", "bucket"]


def test_emptied_buckets_and_retention(spark, keyed, tmp_path):
    keyed.merge("t", SHAPE, spark.createDataFrame([(f"K{i}", i) for i in range(50)], SHAPE), tables.upsert)
    for i in range(3):
        keyed.merge("t", SHAPE, spark.createDataFrame([("K1", 100 + i)], SHAPE), tables.upsert)
    gone = spark.createDataFrame([(f"K{i}", 0) for i in range(50)], SHAPE)
    kept = dict(rows(keyed.read("t", SHAPE), "parent_asin", "v"))
    assert keyed.vacuum("t", keep=2) == 2 and keyed.versions("t") == [3, 4]  # two former states of one bucket
    assert dict(rows(keyed.read("t", SHAPE), "parent_asin", "v")) == kept and kept["K1"] == 102
    assert dict(rows(keyed.read("t", SHAPE, version=3), "parent_asin", "v"))["K1"] == 101
    keyed.merge("t", SHAPE, gone, lambda old, new: tables.delete_cascade(new, old)[0])
    assert keyed.read("t", SHAPE).count() == 0
    keyed.vacuum("t", keep=1)
    assert not files(tmp_path, "t")


def test_stream_ingest_of_new_files(spark, tmp_path, keyed):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"parent_asin": "A", "title": "a1"}\n{"parent_asin": "A", "title": "a2"}\n')
    stream_ingest.ingest_product_files(spark, str(folder), keyed, str(tmp_path / "offsets"))
    (folder / "2.jsonl").write_text('{"parent_asin": "A", "title": "a3"}\n{"parent_asin": "B", "title": "b"}\n{bad\n')
    stream_ingest.ingest_product_files(spark, str(folder), keyed, str(tmp_path / "offsets"))
    got = {r.parent_asin: r.title for r in keyed.read("products", schemas.PRODUCTS).collect()}
    assert got == {"A": "a3", "B": "b"} and keyed.versions("products") == [1, 2]

    encoder = ingest.default_encoder(64)
    stream_ingest.ingest_embeddings(spark, str(folder), keyed, encoder, str(tmp_path / "e"), "r1")
    (folder / "3.jsonl").write_text('{"parent_asin": "A", "title": "a3"}\n{"parent_asin": "new", "title": "not loaded"}\n')
    stream_ingest.ingest_embeddings(spark, str(folder), keyed, encoder, str(tmp_path / "e"), "r2")
    vectors = {r.parent_asin: r for r in keyed.read("embeddings", schemas.EMBEDDINGS).collect()}
    assert {k: v.run_id for k, v in vectors.items()} == {"A": "r2", "B": "r1"} and len(vectors["A"].bits) == 1


def test_stream_ingest_of_reviews_is_repeatable(spark, tmp_path, keyed):
    folder, store = tmp_path / "arrivals", tables.TableStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    products = spark.createDataFrame([("P1", "one"), ("P2", "two")], "parent_asin string, title string")
    keyed.merge("products", schemas.PRODUCTS, products, tables.upsert_products)
    (folder / "1.jsonl").write_text("\n".join(REVIEW_LINES))

    def run(offsets):
        stream_ingest.ingest_review_files(spark, str(folder), store, keyed, str(tmp_path / offsets))
        counts = sorted(map(tuple, store.read_appended("reviews_counts", stream_ingest.COUNTS).collect()))
        kept = store.read_appended("reviews", stream_ingest.STREAMED_REVIEWS).collect()
        return counts, sorted((r.review_id, r.user_id) for r in kept)

    first = run("offsets")
    assert first[0] == [("000000000", 1, 2, 2, 1, 2)]
    assert [u for _, u in first[1]] == ["u1", "u3"]
    assert run("others") == first  # the same batch again, as after a lost checkpoint
    (folder / "2.jsonl").write_text(REVIEW_LINES[0].replace("u1", "u9"))
    counts, kept = run("offsets")
    assert counts == [*first[0], ("000000001", 0, 0, 0, 0, 1)] and len(kept) == 3 and len(dict(kept)) == 3


def test_encoder_and_user_models(spark):
    df = spark.createDataFrame([("a", "red mug"), ("b", "red mug"), ("c", None)], "parent_asin string, t string")
    got = {r.parent_asin: r.embedding for r in models.hashing_encoder(df, "t", 32).collect()}
    assert got["a"] == got["b"] and abs(np.linalg.norm(got["a"]) - 1) < 1e-5 and set(got["c"]) == {0.0}

    def make_encoder():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return predict

    mine = models.encode_with(df.filter("t is not null"), "t", make_encoder).collect()
    assert [r.embedding for r in mine] == [[7.0, 1.0]] * 2

    def make_scorer():
        def predict(texts):
            return np.array([[0.25, 0.75] if "red" in t else [0.9, 0.1] for t in texts], dtype=np.float32)

        return predict

    scored = {r.parent_asin: (r.sentiment_label, r.sentiment_score) for r in models.score_with(df, "t", make_scorer).collect()}
    assert scored == {"a": ("positive", 0.75), "b": ("positive", 0.75), "c": (None, None)}

    def make_generator():
        def predict(prompts):
            return np.array([f"{p} Summary: done " for p in prompts], dtype=object)

        return predict

    made = models.generate_with(df.filter("t is not null"), "t", make_generator).collect()
    assert [r.summary for r in made] == ["done", "done"]


def test_default_sentiment(spark):
    good, bad = "great lovely excellent", "awful broken terrible"
    train = spark.createDataFrame([(good, 1), (bad, 0)] * 10, "text string, label int")
    model = models.train_sentiment(train)
    df = spark.createDataFrame([(1, "lovely great"), (2, "terrible"), (3, None)], "i int, text string")
    got = {r.i: (r.sentiment_label, r.sentiment_score) for r in models.score_sentiment(df, model).collect()}
    assert got[1][0] == "positive" and got[2][0] == "negative" and got[3] == (None, None)
    assert 0.5 <= got[1][1] <= 1


def test_seed_catalogue(spark):
    p, r, e = seed.seed_products(spark), seed.seed_reviews(spark), seed.seed_embeddings(spark, dim=16)
    assert (p.count(), r.count(), e.count()) == (10, 30, 10)
    assert tables.known_keys(r, p).count() == 30
    assert all(abs(np.linalg.norm(v.embedding) - 1) < 1e-5 for v in e.collect())
    assert rows(r) == rows(seed.seed_reviews(spark))


def test_runs(spark):
    batches = spark.createDataFrame([("r", 500, 2.0, 384), ("r", 100, 1.0, 384), ("z", 0, 0.0, 384)],
                                    "run_id string, items int, elapsed_s double, dim int")
    got = {r.run_id: tuple(r)[1:] for r in tracking.embedding_run_metrics(batches).collect()}
    assert got == {"r": (600, 3000.0, 5.0, 384), "z": (0, 0.0, 0.0, 384)}


def test_spread_deals_rows_out_only_if_asked(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one, None) is one
    assert spread(one, 4).rdd.getNumPartitions() == 4 and spread(one, 4).count() == 100
