"""The n-gram Jaccard join and the top-k join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import ngram_join, topk_join
from pyspark.sql import functions as F


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """Smallest id reachable, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j][1])
            if both and 100 * both >= 80 * len(s | sets[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)


def _text(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n))


def _edited(rng, text, share):
    return " ".join(f"e{rng.randint(0, 9999)}" if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("large", [2, 4, 32])
def test_groups_of_near_copies_of_all_sizes(spark, monkeypatch, large):
    """Small bounds make large regions, common shingles and the second comparison necessary."""
    monkeypatch.setattr(ngram_join, "LARGE_REGION", large)
    rng = random.Random(large)
    line, rows = _text(rng, 30), []
    for size in (1, 2, 5, 40):
        base = _text(rng, 120)
        rows += [_edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04])) for _ in range(size)]
    rows += [f"{_text(rng, 40)} {line} {_text(rng, 20)}" for _ in range(40)]
    chain = _text(rng, 100).split(" ")
    for i in range(12):  # each near the one before it, the ends far apart
        chain[i * 8] = f"c{i}"
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    check(spark, [(7 * i + 1, t) for i, t in enumerate(rows)])


@pytest.mark.parametrize("cell, links", [(4096, 20_000), (32, 50)])
def test_a_region_of_many_different_near_copies(spark, monkeypatch, cell, links):
    """Pairwise different, some linked in chains, some beyond the radius of all others, one very long pair."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "TASK_LINKS", links)
    rng = random.Random(cell)
    base = _text(rng, 90)
    rows = [_edited(rng, base, rng.choice([0.005, 0.02, 0.05, 0.08])) for _ in range(700)]
    rows += [_text(rng, 5000)]
    rows += [_edited(rng, rows[-1], 0.02), _edited(rng, rows[-1], 0.3)]
    check(spark, [(3 * i + 5, t) for i, t in enumerate(rows)])


def test_links_by_way_of_rows_without_an_id(spark):
    rng = random.Random(9)
    words = _text(rng, 200).split(" ")

    def moved(*places):
        return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))

    near = [(1, moved()), (None, moved(50, 60, 70, 80)), (3, moved(50, 60, 70, 80, 90, 100, 110, 120))]
    check(spark, near)
    check(spark, near + [(None, "another text of some words that stands alone here")] * 2)
    check(spark, [(None, t) for _, t in near])


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_LINKS", 7)
    rng = random.Random(4)
    names = [rng.randint(-(2**62), 2**62) for _ in range(130)]
    pairs = [(names[i], names[i + 1]) for i in range(100) if i % 40 != 39] + [(names[110], x) for x in names[111:130]]
    rng.shuffle(pairs)
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()))
    want = {}
    for group in (names[:40], names[40:80], names[80:101], names[110:]):
        want |= {x: min(group) for x in group}
    assert got == want
    none = ngram_join.components(spark.createDataFrame([(1, 1)], "a long, b long"))
    assert none.collect() == []


def test_odd_rows(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    check(spark, rows)
    assert ngram_join.near_duplicates(small.filter("false")).count() == 0
    check(spark, [(1, None), (2, ""), (3, " ")])


def test_words_longer_than_a_chunk(monkeypatch):
    data = [("x" * 100 + " " + "y" * 70 + " b c d e", "p q r s t u v")]
    want = [len(s) for s in map(shingles, data[0])]
    monkeypatch.setattr(ngram_join, "_CHUNK", 64)
    got = ngram_join.shingle_sets(list(data[0]))
    assert [len(s) for s in got] == want


def best(rows, k, scale=1024):
    def scaled(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(scale * float(x))) for x in v]

    known = [(i, scaled(v)) for i, v in rows if i is not None]
    known = [(i, v) for i, v in known if v is not None]
    out = []
    for q, v in {i: v for i, v in reversed(known) if i % 5 == 0}.items():
        scores = sorted(
            (-sum(a * b for a, b in zip(v, x)), i) for i, x in known if i != q and len(x) == len(v)
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("cells", [(1024, 8192), (3, 7)])
def test_best_k_with_ties_and_odd_vectors(spark, monkeypatch, cells):
    monkeypatch.setattr(topk_join, "CELL_QUERIES", cells[0])
    monkeypatch.setattr(topk_join, "CELL_ROWS", cells[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(150)]
    rows += [(150 + i, list(rows[i][1])) for i in range(20)]  # ties
    rows += [(200, None), (205, []), (210, [1.0, None, 1.0]), (215, [float("nan")] * 6), (220, [float("inf")] * 6)]
    rows += [(225, [1.0, 2.0]), (226, [2.0, 1.0]), (None, [1.0] * 6), (230, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk_join.top_k(table, F.col("vec_id") % 5 == 0, 4).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == best(rows, 4)


def test_repeated_query_ids_lose_no_neighbours(spark):
    rows = [(5, [100.0, 0.0])] * 30 + [(i, [0.0, 100.0]) for i in (6, 7, 8, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_join.top_k(table, F.col("vec_id") == 5, 4, 1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 6, 0), (2, 7, 0), (3, 8, 0), (4, 9, 0)]
    # of different vectors under the query's id the smallest is asked
    more = spark.createDataFrame([(5, [0.0, 100.0])], table.schema).union(table)
    got = topk_join.top_k(more.repartition(3), F.col("vec_id") == 5, 4, 1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(i + 1, 6 + i, 10_000) for i in range(4)]


def test_vectors_too_long_for_a_product_take_no_part(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [1e6, 0.0]), (5, [-1e6, 1.0]), (10, [0.5, 0.5]), (11, [-1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_join.top_k(table, F.col("vec_id") % 5 == 0, 4).collect()
    kept = [r for r in rows if r[0] in (2, 5, 10)]
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == best(kept, 4)


def test_products_beyond_doubles_are_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(2**30), 2**30, 3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_join.top_k(table, F.col("vec_id") % 5 == 0, 4, 1).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == best(rows, 4, 1)


def test_groups_that_need_the_same_rows_are_solved_together(monkeypatch):
    monkeypatch.setattr(topk_join, "CELL_QUERIES", 10)
    sizes = np.array([4, 5, 3, 2])
    shared = np.array([[90, 80, 0, 90], [80, 100, 0, 70], [0, 0, 50, 0], [90, 70, 0, 95.0]])
    # 1 leads; 0 needs mostly the same, 3 would be one query too many; 2 needs other rows
    assert topk_join._together(sizes, shared) == [[1, 0], [2], [3]]


def test_clustered_vectors_are_pruned_and_right(spark, monkeypatch):
    monkeypatch.setattr(topk_join, "CELL_QUERIES", 8)
    monkeypatch.setattr(topk_join, "CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(6, 5)) * 20
    rows = [(i, [float(x) for x in middles[i % 6] + rng.normal(size=5)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_join.top_k(table, F.col("vec_id") % 5 == 0, 3).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == best(rows, 3)


def test_no_vectors_no_rows(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_join.top_k(table, F.lit(True)).count() == 0
