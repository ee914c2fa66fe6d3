"""Fill-in-the-middle against the token pattern, the three containers, and exact round trips."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import fill_in_middle as fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, rate=50, spm_rate=80):
    t = text or ""
    units = TOKEN.findall(t)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def ends(text):
    return [0, *np.cumsum([len(u) for u in TOKEN.findall(text)]).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x1c é😀", max_size=80))
def test_boundaries_are_those_of_the_pattern(text):
    found = fim.BoundarySet(text)
    assert [found.select(u) for u in range(found.n + 1)] == ends(text)


@pytest.mark.parametrize("shift", [-2, -1, 0, 1, 2])
def test_boundaries_around_the_ends_of_spans(shift):
    rng = random.Random(shift)
    for tail in ("", " ", "  x", "x", "x y ", " " * 70_000, "y" * 140_000, "é" * 70_000 + " \n"):
        size, text = fim.SPAN + shift, ""
        while len(text) < size:
            text += rng.choice(["a", "bb ", " ", "\n", "é"]) * rng.randint(1, 9)
        text = text[:size] + tail
        found = fim.BoundarySet(text)
        want = ends(text)
        assert found.n == len(want) - 1
        for u in [0, 1, found.n - 1, found.n, *rng.sample(range(found.n + 1), 200)]:
            assert found.select(u) == want[u]


@pytest.mark.parametrize(
    "places, kind",
    [
        (np.arange(0, 65_536, 40), fim.ArrayContainer), (np.arange(0, 65_536, 2), fim.BitmapContainer),
        (np.arange(65_536), fim.RunContainer), (np.array([0]), fim.ArrayContainer),
        (np.concatenate([np.arange(100, 9_000), np.arange(60_000, 65_536)]), fim.RunContainer),
        (np.sort(np.random.default_rng(0).permutation(65_536)[:9_000]), fim.BitmapContainer),
    ],
)
def test_containers(places, kind):
    assert isinstance(fim.container(places), kind)
    for other in fim.KINDS:  # any of them selects the same places
        held = other(places)
        for k in {0, len(places) // 3, len(places) // 2, len(places) - 1}:
            assert held.select(k) == places[k]


def test_rows_of_all_kinds(spark, small):
    extra = [(100 + i, f" w{i}\t<b> é😀 " + "tail of it\n" * (i % 7), "s") for i in range(60)]
    extra += [(200, "a <P> b", "s"), (201, "x<S>y", "s"), (202, "<M>", "s"), (203, "<P <S <M P> S> M> <", "s"), (204, "<S", "s")]
    extra += [(300 + i, "S> x <P y <M", "s") for i in range(30)]
    docs = small.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    docs = docs.withColumn("fim", F.lit("old")).withColumn("form", F.lit("older"))
    made = fim.fill_in_middle(docs, rate=90).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form")))
    rows = made.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for r in rows:
        assert tuple(r["fim"]) == brute(r["doc_id"], r["text"], rate=90)
        assert r["back"] == (r["text"] or "") and r["form"] == "older"
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark, small):
    assert fim.fill_in_middle(small.limit(0)).collect() == []
