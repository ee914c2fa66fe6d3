import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import catalog, metrics, ranking, rolling
from shelfmark.plans import context


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group and one time."""
    rng = random.Random(3)
    rows = [("hot", 100, i, rng.randint(0, 50)) for i in range(2000)]
    rows += [(rng.choice("abc"), rng.randint(0, 200), 2000 + i, rng.randint(0, 50)) for i in range(4000)]
    rows += [("one", 5, 9999, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(6).cache()
    return rows, df


def by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_rank_within(skewed):
    rows, df = skewed
    got = {r.id: r._rank for r in ranking.rank_within(df, ["g"], ["t", "id"]).collect()}
    want = {r[2]: i for g in by_group(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_a_null_group_is_ranked_too(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, t int")
    got = {(r.g, r.t): r._rank for r in ranking.rank_within(df, ["g"], ["t"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 5): 0}


def test_rolling_equals_brute_force(skewed):
    rows, df = skewed
    got = {
        r.id: (r.p50, r.p95, round(r.mean, 9), r.samples)
        for r in rolling.rolling_stats(df, ["g"], ["t", "id"], "v", window=20, segment=64).collect()
    }
    want = {}
    for g in by_group(rows).values():
        for i, r in enumerate(g):
            s = sorted(x[3] for x in g[max(0, i - 19) : i + 1])
            n = len(s)
            want[r[2]] = (s[n // 2], s[min(int(n * 0.95), n - 1)], round(sum(s) / n, 9), n)
    assert got == want


def test_latency_summary_is_the_last_rolling_row(skewed):
    rows, df = skewed
    full = rolling.rolling_stats(df, ["g"], ["t", "id"], "v", window=30, segment=64).collect()
    last = {g: rs[-1][2] for g, rs in by_group(rows).items()}
    want = {r.g: (r.p50, r.p95, round(r.mean, 9)) for r in full if r.id == last[r.g]}
    got = rolling.latency_summary(df, ["g"], ["t", "id"], "v", window=30).collect()
    assert {r.g: (r.p50, r.p95, round(r.mean, 9)) for r in got} == want


def test_exact_quantiles(skewed):
    rows, df = skewed
    values = sorted(r[3] for r in rows)
    got = ranking.exact_quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert got.a == values[0] and got.d == values[-1] and got.c == statistics.median(values)
    place = 0.37 * (len(values) - 1)
    low = values[int(place)]
    assert got.b == pytest.approx(low + (values[int(place) + 1] - low) * (place % 1))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert ranking.exact_quantiles(df, "v", {"m": 0.5}).first().m is None


def test_counter_with_resets(skewed):
    rows, df = skewed
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    got = metrics.counter_increase(timed, ["g"], ["ts", "id"], "v", "1 hour").collect()
    want = {}
    for name, g in by_group(rows).items():
        for i, r in enumerate(g):
            before = g[i - 1][3] if i else r[3]
            grown = r[3] if r[3] < before else r[3] - before
            want[name, r[1] // 60] = want.get((name, r[1] // 60), 0) + grown
    assert {(r.g, int(r.slot_start.timestamp()) // 3600): r.increase for r in got} == want


def test_last_by(skewed):
    rows, df = skewed
    got = {r.g: r.id for r in ranking.last_by(df, ["g"], ["t", "id"]).collect()}
    assert got == {g: rs[-1][2] for g, rs in by_group(rows).items()}


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("A", "Red mug", "Kitchen", "Shop_1", 4.5, 3, 10.0), ("B", "The red plates", "Kitchen", "Shop 2", None, 0, None),
        ("C", "Plate rack", "Garden", "shop%3", 4.5, 1, 30.0), ("D", None, "Garden", "Other", 1.0, 9, 20.0),
    ]
    return spark.createDataFrame(
        rows,
        "parent_asin string, title string, main_category string, store string, average_rating double,"
        " rating_number int, price double",
    )


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (1, "A", 5.0, 3, "2020-01-01", "r1"), (2, "A", 4.5, 3, None, "r2"), (3, "A", 1.0, None, "2020-01-02", "r3"),
        (4, "C", 3.0, 9, "2020-01-03", None), (5, "Z", 3.0, 9, "2020-01-03", "r5"), (6, "C", 2.5, 9, "2020-01-03", "r6"),
    ]
    df = spark.createDataFrame(
        rows, "review_id int, parent_asin string, rating double, helpful_vote int, at string, review_text string"
    )
    return df.withColumns(
        {
            "reviewed_at": F.col("at").cast("timestamp"), "user_id": F.lit("u"), "title": F.lit("t"),
            "verified_purchase": F.col("review_id") != 2,
            "sentiment_label": F.when(F.col("rating") >= 3, "positive").otherwise("negative"),
            "sentiment_score": F.lit(0.5),
        }
    ).drop("at")


def keys(df):
    return [r.parent_asin for r in df.collect()]


def test_listing(products):
    assert keys(catalog.list_products(products)) == ["A", "C", "D", "B"]
    assert keys(catalog.list_products(products, limit=2, offset=1)) == ["C", "D"]
    assert keys(catalog.list_products(products, main_category="GARD", max_price=25.0)) == ["D"]
    assert keys(catalog.list_products(products, store="shop_")) == ["A", "C", "B"]
    assert keys(catalog.list_products(products, store="")) == ["A", "C", "D", "B"]
    with pytest.raises(ValueError):
        catalog.list_products(products, limit=201)


def test_keywords(products):
    assert keys(catalog.keyword_search(products, "the plate")) == ["C", "B"]
    assert keys(catalog.keyword_search(products, "red plate")) == ["B"]
    assert keys(catalog.keyword_search(products, "plate", stemming=False)) == ["C"]
    assert keys(catalog.keyword_search(products, "the and of")) == []
    assert keys(catalog.keyword_search(products, "plate", max_price=100.0)) == ["C"]


def test_stored_terms_give_the_same_hits_without_python(products, capsys):
    made = products.withColumn("title_terms", text.title_terms("title"))
    stored = products.sparkSession.createDataFrame(made.collect(), made.schema)
    for asked in ("the plate", "red plates", "and the of", "plating reds", "nothing"):
        want = keys(catalog.keyword_search(products, asked))
        assert keys(catalog.keyword_search(stored, asked)) == want
    assert keys(catalog.keyword_search(stored, "plate", stemming=False)) == ["C"]
    catalog.keyword_search(stored, "red plates").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "title_terms" in plan


def test_reviews_put_unknown_votes_and_dates_first(reviews):
    got = [r.review_id for r in catalog.list_reviews(reviews, "A").collect()]
    assert got == [3, 2, 1]
    assert [r.review_id for r in catalog.list_reviews(reviews, "A", verified_only=True, min_rating=2.0).collect()] == [1]
    assert [r.review_id for r in catalog.list_reviews(reviews, "A", sentiment="negative").collect()] == [3]
    with pytest.raises(ValueError):
        catalog.list_reviews(reviews, "A", sentiment="mixed")


def test_detail(products, reviews):
    found = catalog.product_detail(products, reviews, "A", review_limit=2).first()
    assert [r.review_id for r in found.reviews] == [3, 2] and found.reviews[0].reviewed_at == "2020-01-02 00:00:00"
    assert catalog.product_detail(products, reviews, "B").first().reviews == []
    assert catalog.product_detail(products, reviews, "missing").count() == 0
    assert "reviews" not in catalog.product_detail(products, reviews, "A", include_reviews=False).columns


def test_summary(products, reviews):
    row = catalog.metrics_summary(products, reviews, products.select("parent_asin").limit(3)).first()
    assert (row.total_products, row.total_reviews, row.total_embeddings) == (4, 6, 3)
    assert float(row.avg_rating) == 3.33
    assert [(s.rating, s.review_count) for s in row.rating_distribution] == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1)]
    assert (row.price_summary.min_price, row.price_summary.median_price) == (10.0, 20.0)


def test_context(products, reviews):
    found = context.collected(context.review_context(products, reviews)).first().texts
    assert found == ["r3", "r6", "r1", "r2"]
    hits = products.select(F.lit("q").alias("query_id"), "parent_asin")
    assert context.review_context_batch(hits, reviews, limit=3).first().texts == ["r3", "r6", "r1"]
    empty = context.with_prompt(context.collected(context.review_context(products.limit(0), reviews))).first()
    assert empty.texts == [] and empty.prompt.startswith("No reviews")
