"""Fingerprints against a plain recomputation, byte by byte and window by window."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fingerprints as fp


def windows(data):
    data = data.ljust(fp.WINDOW, b"\0") if data else b""
    return [data[i : i + fp.WINDOW] for i in range(len(data) - fp.WINDOW + 1)]


def entropy(window):
    total = sum(int(np.rint(fp._UNIT * c * math.log2(c))) for c in Counter(window).values())
    return fp.ENTROPIES - fp.ENTROPIES * total // int(fp._UNIT * fp.WINDOW * math.log2(fp.WINDOW))


def brute_ranks(texts):
    counts = Counter(entropy(w) for t in texts for w in windows(t))
    order = sorted(range(fp.ENTROPIES + 1), key=lambda e: (e < fp.LEAST_ENTROPY, counts[e], e))
    return counts, {e: i for i, e in enumerate(order)}


def brute_features(data, ranks):
    some = windows(data)
    told = [ranks[entropy(w)] for w in some]
    points = Counter()
    for i in range(len(told)):
        part = told[i : i + fp.AMONG]
        points[i + part.index(min(part))] += 1
    chosen = [i for i in range(len(some)) if points[i] >= fp.POINTS]
    if some and not chosen:
        chosen = [max(range(len(some)), key=lambda i: (points[i], -i))]
    return list(dict.fromkeys(some[i] for i in chosen))


def brute_hash(window):
    m, h = (1 << 64) - 1, 0
    for i in range(0, fp.WINDOW, 8):
        h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(window[i : i + 8], "little") + 1) & m
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & m
        h ^= h >> 32
    return h


def brute_digest(data, ranks):
    """A list of (features, set of bits)."""
    out, found = [], brute_features(data, ranks)
    for i in range(0, len(found), fp.FILTER_FEATURES):
        part = [brute_hash(w) for w in found[i : i + fp.FILTER_FEATURES]]
        out.append((len(part), {(h >> 11 * k) % fp.FILTER_BITS for h in part for k in range(fp.HASHES)}))
    return out


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def score(f, g):
        (n, x), (m, y) = f, g
        p = 1 - 1 / fp.FILTER_BITS
        chance = fp.FILTER_BITS * (1 - p ** (5 * n) - p ** (5 * m) + p ** (5 * (n + m)))
        most = min(len(x), len(y))
        cutoff = chance + fp.CUTOFF * max(most - chance, 0)
        if most <= cutoff:
            return float(len(x & y) >= most)
        return min(max((len(x & y) - cutoff) / (most - cutoff), 0.0), 1.0)

    total = lambda d: sum(n for n, _ in d)
    if (len(a), total(a)) > (len(b), total(b)):
        a, b = b, a
    ways = [(a, b)] + ([(b, a)] if (len(a), total(a)) == (len(b), total(b)) else [])
    return [sum(n * max(score((n, x), g) for g in d) for n, x in c) / total(c) for c, d in ways]


def parsed(text):
    d = fp.Digest.parse(text)
    return [(int(n), set(np.flatnonzero(np.unpackbits(f)).tolist())) for n, f in zip(d.counts, d.filters)]


def sample_texts(rng):
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "漢字", "==", "\n", "12345", "aaaa"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 120))) for _ in range(25)]
    return texts + ["", "x", "short text", "a" * 31, "a" * 32, "ab" * 300, " " * 500, "=" * 90 + texts[0] + "=" * 90]


def test_features_of_texts_of_all_kinds():
    texts = [t.encode() for t in sample_texts(random.Random(1))]
    counts, ranks = brute_ranks(texts)
    found = fp.entropy_counts(texts)
    assert {e: int(n) for e, n in enumerate(found) if n} == counts
    table = fp.ranks_of(found)
    assert dict(enumerate(table.tolist())) == ranks
    for t, hashes in zip(texts, fp.features(texts, table)):
        assert hashes.tolist() == [brute_hash(w) for w in brute_features(t, ranks)]


@pytest.mark.parametrize("span", [64, 100, 1000])
def test_spans_change_nothing(monkeypatch, span):
    texts = [t.encode() for t in sample_texts(random.Random(2))] + [b"a" * 5000, b"ab cd " * 700]
    whole = fp.entropy_counts(texts), fp.features(texts, fp.ranks_of(fp.entropy_counts(texts)))
    monkeypatch.setattr(fp, "_SPAN", span)
    counts = fp.entropy_counts(texts)
    assert (counts == whole[0]).all()
    for a, b in zip(fp.features(texts, fp.ranks_of(counts)), whole[1]):
        assert a.tolist() == b.tolist()


def test_digests_and_likeness():
    rng = random.Random(3)
    texts = [t.encode() for t in sample_texts(rng)]
    texts += [" ".join(str(rng.randint(0, 9999)) for _ in range(4000)).encode()]  # several filters
    texts += [texts[-1][5000:] + texts[0], texts[-1][:9000]]
    _, ranks = brute_ranks(texts)
    made = fp.digests(texts, np.array([ranks[e] for e in range(fp.ENTROPIES + 1)], np.uint16))
    plain = [brute_digest(t, ranks) for t in texts]
    for d, p in zip(made, plain):
        assert parsed(str(d)) == p and str(fp.Digest.parse(str(d))) == str(d)
        assert d.likeness(d) == 1.0
    assert max(len(p) for p in plain) > 3
    for i in range(len(texts)):
        for j in range(i):
            got = made[i].likeness(made[j])
            assert got == pytest.approx(made[j].likeness(made[i]))
            want = brute_likeness(plain[i], plain[j])
            assert any(got == pytest.approx(w) for w in (want if isinstance(want, list) else [want]))


def check(spark, rows, parts):
    """All rows of ``neighbours`` recomputed; the number of pieces must not matter."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame([(d, t, "old", 1.5) for d, t in rows], "doc_id long, text string, edited string, near_next double")
        got = fp.neighbours(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = {t or "" for _, t in rows}
    _, ranks = brute_ranks([(t or "").encode() for _, t in rows])
    digest = {t: brute_digest(t.encode(), ranks) for t in texts}
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())
    order = sorted(rows, key=key)
    want = Counter()
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        want[doc_id, len(text), text[: len(text) - half] + other[:half], text, other] += 1
    table = np.array([ranks[e] for e in range(fp.ENTROPIES + 1)], np.uint16)
    again = Counter()
    for (doc_id, n, edited, text, other), copies in want.items():
        a, e, b = fp.digests([text.encode(), edited.encode(), other.encode()], table)
        assert parsed(str(a)) == digest[text]
        assert str(e) == str(fp.digests([edited.encode()], table)[0])
        again[doc_id, n, edited, str(a), str(e), round(a.likeness(e), 9), round(a.likeness(b), 9)] += copies
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == again
    return got


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_neighbours(spark, parts):
    texts = sample_texts(random.Random(4))
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (1, None), (2, "😀é漢" * 40)]
    rows += [(6, texts[2])] * 5 + [(7, texts[3])] * 3 + [(9, texts[9] + " other")]  # repeated rows and ids
    check(spark, rows, parts)


def test_a_hot_id_is_cut_by_hashes(spark):
    rng = random.Random(5)
    rows = [(5, f"text {i} " + "w " * rng.randint(0, 9)) for i in range(60)] + [(i, f"other {i}") for i in range(12)]
    rows += [(None, f"none {i}") for i in range(40)] + [(11, "the last one")] * 30
    check(spark, rows, 9)
    bounds = np.array([2, 5, 5, 5, 5, 8])
    hashes = [hashlib.sha256(t.encode()).hexdigest()[:32] for _, t in rows[:60]]
    pieces = fp._pieces(bounds, np.full(60, 5), hashes)
    assert set(pieces.tolist()) == {2, 3, 4, 5}
    order = np.argsort(hashes)
    assert (np.diff(pieces[order]) >= 0).all()
    assert fp._pieces(bounds, np.array([1, 2, 4, 6, 8]), ["f" * 32] * 5).tolist() == [0, 1, 1, 5, 6]


def test_lone_and_no_documents(spark, small):
    assert fp.neighbours(small.limit(0)).collect() == []
    assert [r["near_next"] for r in check(spark, [(1, "a lone document " * 9)], 3)] == [1.0]
    check(spark, [(None, None)], 3)


def test_columns(spark, small):
    docs = small.select("doc_id", "text").filter("doc_id <> 8 or doc_id is null")
    ranks = fp.survey(docs).ranks
    told = docs.withColumn("f", fp.fingerprint(F.col("text"), ranks)).withColumn("l", fp.likeness("f", "f"))
    rows = {r["doc_id"]: r for r in told.collect()}
    assert rows[1]["f"] == rows[2]["f"] != "" and rows[3]["f"] == rows[4]["f"] == ""
    assert all(r["l"] == 1.0 for r in rows.values())


def test_half_edited_texts_are_nearer_than_others(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(rng.randint(60, 600))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fp.neighbours(docs).collect()
    assert min(r["near_edited"] for r in got) > max(r["near_next"] for r in got)
