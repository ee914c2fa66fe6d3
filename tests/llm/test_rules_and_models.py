"""Quality rules, license and secret scans, mixing, the classifier and the pipeline on small and odd tables."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import license_scans, mixing, oracles, quality_classifier, quality_rules, secret_scans

PROSE = "The river ran past the old mill and nobody had seen it so high before that year. "


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_in_sql(small, sql, got):
    con = duckdb.connect()
    con.register("documents", small.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)
    assert plain(want.fetchall()) == plain(got.select(*names).collect())


def test_rules_agree_with_sql_on_odd_rows(small):
    got = quality_rules.measure(small).select("doc_id", "quality.*")
    same_in_sql(small, oracles.all_sql()["op3_quality_rules"], got)


def test_windows_of_very_long_texts_take_the_other_path(small, monkeypatch):
    names = ("doc_id", "quality.n_words", "quality.n_repeat_words")
    want = rows_of(quality_rules.measure(small).select(*names))
    monkeypatch.setattr(quality_rules, "_PLACE", 5)
    assert rows_of(quality_rules.measure(small).select(*names)) == want


def test_bad_lines_go_and_bad_documents_too(spark):
    good = " ".join(f"word{i}" if i % 9 else f"end{i}." for i in range(1, 73)) + "."
    other = good.replace("word", "other")
    texts = {
        1: good + "\nHome | About | Contact | Shop | Help\nAll rights reserved.\n\n" + other,
        2: "Home | Shop | Help | Cart\n" * 40,
        3: " ".join(f"w{i}###" for i in range(200)),
        4: "too short.",
    }
    docs = spark.createDataFrame([(i, t, "x", 1, "kept") for i, t in texts.items()], "doc_id long, text string, clean_text string, n_chars long, kept string")
    got = quality_rules.clean_documents(docs).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0].asDict().keys() == set(docs.columns)
    assert got[0]["text"] == good + "\n\n" + other and got[0]["n_chars"] == len(got[0]["text"])


def test_licenses_agree_with_sql_on_odd_rows(spark, small):
    more = spark.createDataFrame(
        [(50, "x. Released under the MIT License. " * 2), (51, "licensed under cc by nc 4"), (52, "GENERAL PUBLIC LICENSE"),
         (53, "under license the released mit"), (54, "THİS mit LICENSE Kelvin K")], "doc_id long, text string"
    ).withColumn("source", F.lit("z"))
    docs = small.select("doc_id", "text", "source").union(more)
    got = license_scans.scan(docs.withColumn("labels", F.lit("x")))
    same_in_sql(docs, oracles.all_sql()["op4_license_scans"], got)
    found = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert found[50] == "mit" and found[51] == "cc-by-nc" and found[52] == "gpl" and found[53] == "mit" and found[1] == ""
    assert license_scans.scan(docs.filter("false")).count() == 0


def test_wrapped_licenses(spark):
    import textwrap

    notices = [(label, textwrap.wrap(text, 40)) for label, text in license_scans.TEMPLATES if len(text) > 100]
    rows = [(i, "Copyright.\n\n" + ("\n" + mark).join(lines) + "\n\nEnd") for i, (_, lines) in enumerate(notices) for mark in ("", " * ")]
    shuffled = "granted hereby permission\n" + "one two three " * 30 + "\nsoftware the in deal to restriction without"
    apart = "released now\n" + "word " * 20 + "under\n" + "word " * 20 + "the mit\n" + "word " * 20 + "license"
    broken = "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files, to deal"
    rows += [(50, shuffled), (51, apart), (52, broken), (53, "x\nReleased under\nthe MIT"), (54, None)]
    got = license_scans.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in got.collect()}
    for i, (label, _) in enumerate(notices):
        assert found[i][0].split(",")[0] in (label, "gpl") and label in found[i][0] and found[i][1] >= 0.8
    assert [found[i] for i in (50, 51, 52, 53, 54)] == [("", 0.0), ("", 0.0), ("", 0.0), ("mit", 0.8), ("", 0.0)]


def test_base_secrets():
    text = 'my Password = "abcdefgh1" x; secret:short token=ABCDEFGH/x+ ' + "AKIA" + "B" * 12 + " " + "0f" * 16 + " AKIA12"
    spans = secret_scans.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [
        ("assign", 'Password = "abcdefgh1'), ("assign", "token=ABCDEFGH/x+"),
        ("access", "AKIA" + "B" * 12), ("hex", "0f" * 16),
    ]
    assert secret_scans.base_spans("ſecret=abcdefgh1 to\u212aen=abcdefgh1") == []  # letters are ASCII


def test_field_learns_contexts_and_leaves_numbers_alone():
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{PROSE} token = \"{key(40)}\" then {PROSE}" for _ in range(60)]
    texts += [f"{PROSE} call +1 555-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)} or 10.{rng.randint(0, 99)}.4.{rng.randint(0, 99)} {PROSE}" for _ in range(60)]
    texts += [f"write to someone{rng.randint(1, 99)}@example.com or 4{rng.randint(10**14, 10**15 - 1)}" for _ in range(60)]
    field = secret_scans.fit_field(texts)
    hidden = key(30) + "G"  # no pattern matches it
    text = f"{PROSE} token \"{hidden}\" and {PROSE}"
    assert secret_scans.base_spans(text) == []
    assert [text[a:b] for _, a, b in field.spans(text)] == [hidden]
    for clean in (PROSE, "call 555-1234-5678 now", "mail someone7@example.com", "at 10.2.4.77 the", "4111222233334444"):
        assert field.spans(clean) == []


def test_field_finds_secrets_without_digits():
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    texts = [f"{PROSE} token = \"{letters(24)}\" then {PROSE}" for _ in range(60)]
    texts += [f"{PROSE} token = \"{letters(6)}-{letters(6)}-{letters(8)}\" then {PROSE}" for _ in range(60)]
    texts += [f"{PROSE} a comfortable neighbourhood with extraordinary, well-known gardens {PROSE}" for _ in range(120)]
    field = secret_scans.fit_field(texts)
    for hidden in (letters(20), "correct-horse-battery-staple", "AbCdEfGh/IjKlMnOp"):
        text = f"{PROSE} token \"{hidden}\" and {PROSE}"
        assert secret_scans.base_spans(text) == []
        assert [text[a:b] for _, a, b in field.spans(text)] == [hidden]
    for clean in (PROSE, "a comfortable neighbourhood, well-known", "the password manager"):
        assert field.spans(clean) == []


def test_runs_give_the_best_path_of_the_whole_text():
    rng = np.random.default_rng(6)
    text = "abcdefgh 12345678 no name_of_it=ZYXWVUTS, longer-token\n........ 8765abcd x@y.example end"
    runs = secret_scans._runs(text)
    assert [([text[a:b] for a, b in run], closed) for run, closed in runs] == [
        (["abcdefgh", "12345678"], True), (["name_of_it", "ZYXWVUTS", "longer-token", "8765abcd", "x@y.example"], True)
    ]
    facts = secret_scans._facts(text)
    rows = [[secret_scans._features(text, a, b, facts) for a, b in run] for run, _ in runs]
    for _ in range(20):
        weights = {f: rng.normal(size=3) for run in rows for r in run for f in r}
        field = secret_scans.Field(weights, rng.normal(size=(3, 3)) + secret_scans._BARRED)
        want = []
        for (run, _), features in zip(runs, rows):
            e, paths = field.emissions(features), [[]]
            for _ in run:
                paths = [[*p, t] for p in paths for t in range(3)]
            value = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(field.steps[x, y] for x, y in zip([0, *p], [*p, 0]))  # noqa: E731, B023
            for (a, b), tag in zip(run, max(paths, key=value)):
                if tag == 2:
                    want[-1] = ("crf", want[-1][1], b)
                elif tag:
                    want.append(("crf", a, b))
        assert field.spans(text) == want


def test_sample_looks_at_the_spans_and_counts_copies_once(spark):
    far = "call 555-123-45678 😀😀 " + PROSE * 20
    secrets = ["0f" * 16, "token = 'abcdefgh1'", "AKIA" + "B" * 12, "ab12" * 100]
    texts = [f"{far}{s} {PROSE}" for s in secrets] + ["nothing-but letters here"] * 3 + [PROSE * 9 + "at 2024-01-02T03"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", *texts[:1] * 50])], "doc_id long, text string")
    got = secret_scans.sample_texts(docs.repartition(3), size=5)
    assert len(got) == 6
    for s in secrets:
        assert sum(s in w for w in got[:4]) == 1
    assert all(any(len(w) > 280 and w in t for t in texts) for w in got[:4]) and all(secret_scans.base_spans(w) for w in got[:4])
    assert sorted("2024-01-02T03" in w for w in got[4:]) == [False, True]


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(6)]
    field = secret_scans.Field({n: rng.normal(size=3) for n in names}, rng.normal(size=(3, 3)) + secret_scans._BARRED)
    for n in (1, 2, 5):
        rows = [[names[rng.integers(6)], names[rng.integers(6)]] for _ in range(n)]
        e = field.emissions(rows)

        def value(path):
            before = [0, *path[:-1]]
            return sum(e[i, t] + field.steps[b, t] for i, (b, t) in enumerate(zip(before, path)))

        paths = [[]]
        for _ in range(n):
            paths = [[*p, t] for p in paths for t in range(3)]
        assert value(field.tags(rows)) == pytest.approx(max(map(value, paths)))


def test_secrets_in_odd_rows(spark, small):
    field = secret_scans.fit(small)
    assert field.weights == {} and secret_scans.fit(small.filter("false")).weights == {}
    docs = small.union(spark.createDataFrame([(60, "😀 token=abcdefgh12 😀", "a", 1, "", "")], small.schema))
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", secret_scans.find_secrets(F.col("text"), field).alias("s")).collect()}
    assert [tuple(x) for x in found.pop(60)] == [("assign", 2, 18)] and not any(found.values())
    clean = {r["doc_id"]: r["text"] for r in secret_scans.redact(docs, field).collect()}
    assert clean[60] == "😀 [SECRET] 😀" and clean[3] is None and clean[4] == ""


def test_mixing_agrees_with_sql_and_keeps_odd_rows(small):
    got = mixing.draws(small)
    renamed = {f"draws_{a}": b for a, b in (("tokens", "n_tokens"), ("block", "block"), ("epoch", "epoch"), ("start", "start"))}
    out = got.withColumnsRenamed(renamed).select("doc_id", "source", "draws", *renamed.values())
    same_in_sql(small, oracles.all_sql()["op5_mixing"], out)
    assert out.filter("draws < 1").count() == 0
    assert set(mixing.mix(small).columns) == set(small.columns)
    assert mixing.mix(small.filter("false")).count() == 0


def test_weights_meet_limits_and_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def shares(df):
        n = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        return {s: x / sum(n.values()) for s, x in n.items()}

    drawn = mixing.draws(docs, target_entropy=0.9, repeat_limit=50.0)
    got = shares(drawn.select("source", (F.col("draws") * F.col("draws_tokens")).alias("n")))
    assert -sum(p * math.log(p) for p in got.values()) == pytest.approx(0.9 * math.log(6), abs=0.02)
    limited = mixing.draws(docs, target_entropy=1.0, repeat_limit=1.5)
    most = limited.groupBy("source").agg((F.sum(F.col("draws") * F.col("draws_tokens")) / F.sum("draws_tokens")).alias("r"))
    assert most.agg(F.max("r")).collect()[0][0] <= 1.55
    small_budget = mixing.draws(docs, budget=2000)
    total = small_budget.agg(F.sum(F.col("draws") * F.col("draws_tokens"))).collect()[0][0]
    assert 2000 <= total <= 2000 + 6 * 7


def test_every_epoch_has_an_order_of_blocks_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else None, "x", 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, draws_tokens string, draws_epoch int")
    options = {"target_entropy": 1.0, "repeat_limit": 50.0}
    drawn = mixing.draws(docs, **options)
    assert len(set(drawn.columns)) == len(drawn.columns)
    tokens = {r["doc_id"]: (r["draws_tokens"], r["draws_block"], r["draws"], r["draws_epoch"], r["draws_start"]) for r in drawn.collect()}
    copies = mixing.mix(docs, "epoch", "order", **options).collect()
    assert Counter(r["doc_id"] for r in copies) == {i: t[2] for i, t in tokens.items()}
    orders = {}
    for source in ("big", None):
        own = sorted((r for r in copies if r["source"] == source), key=lambda r: (r["epoch"], r["order"]))
        reached, starts = 0, {}
        for r in own:  # walk through the copies as the permutations have them
            starts.setdefault((tokens[r["doc_id"]][1], r["epoch"]), reached)
            reached += tokens[r["doc_id"]][0]
            order = orders.setdefault((source, r["epoch"]), [])
            if tokens[r["doc_id"]][1] not in order:
                order.append(tokens[r["doc_id"]][1])
        for r in own:
            _, block, _, epoch, start = tokens[r["doc_id"]]
            assert starts[block, epoch] == start
    first, second = orders[None, 0], orders[None, 1]
    assert len(first) > 2 and sorted(first) == sorted(second) and first != second


def test_fit_is_the_ridge_solution_of_all_rows(spark):
    """The sums of the tasks against a least-squares fit of the stacked rows, and the steps against min-max means."""
    rng = np.random.default_rng(4)
    stats = rng.normal(size=(300, len(quality_classifier.NAMES)))
    y = (stats[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y)], "stats array<double>, y double")
    model = quality_classifier.fit(rows.repartition(7))
    z = quality_classifier.fourier((stats - stats.mean(axis=0)) / stats.std(axis=0))
    free = np.sqrt(quality_classifier.RIDGE * len(y) / quality_classifier.N_FOURIER) * np.eye(z.shape[1])
    free[-1, -1] = 0.0
    want = np.linalg.lstsq(np.vstack([z, free]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    bins = np.rint(np.clip(z @ want, 0, 1) / quality_classifier.BIN).astype(int)
    at = np.unique(bins)
    total = np.array([y[bins == b].sum() for b in at])
    count = np.array([(bins == b).sum() for b in at])
    mean = lambda i, j: total[i:j + 1].sum() / count[i:j + 1].sum()
    closest = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    assert np.allclose(np.interp(at * quality_classifier.BIN, model.steps_at, model.steps), closest, atol=1e-6)


def test_rising_steps_are_the_closest():
    at, steps = quality_classifier.rising_steps(np.arange(5.0), np.array([0.0, 0.6, 0.2, 0.9, 0.8]), np.array([1, 1, 3, 2, 2.0]))
    assert list(np.interp(np.arange(5.0), at, steps)) == pytest.approx([0, 0.3, 0.3, 0.85, 0.85])


def test_classifier_learns_from_what_is_not_held_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(600):
        good = rng.random() < 0.6
        words = [word() for _ in range(rng.randint(30, 200))]
        rows.append((i, " ".join(words) + "." if good else "### ".join(words), int(good), 0.5))
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id long, text string, score double")
    held = F.col("doc_id") % 3 == 1
    lies = [(i, y if i % 3 != 1 else 1 - y) for i, _, y, _ in rows]  # what is held out isn't learnt
    labels = spark.createDataFrame([*lies, (5, None), (9999, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels, held).collect()}
    assert len(got) == 600 and all(got[i]["held_out"] == (i % 3 == 1) for i in got)
    right = [got[i]["predicted"] == y for i, _, y, _ in rows if i % 3 == 1]
    assert sum(right) / len(right) >= 0.95


def test_classifier_on_odd_rows_and_without_labels(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_classifier.classify(small, none).collect()
    assert len(got) == 12 and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality_classifier.classify(small, one).collect())
    both = spark.createDataFrame([(1, 1), (6, 0), (6, 0), (3, None)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.classify(small, both).collect())
    assert quality_classifier.classify(small.filter("false"), both).count() == 0


def test_pipeline_does_what_its_stages_say(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 999)}" for _ in range(n)) + "."
    base = text(120)
    rows = [
        (1, base, "en", "a"), (2, base.replace("1", "1", 1), "en", "a"), (3, base[:-1] + " more.", "en", "b"),
        (4, text(80) + " token=abcdefgh1234 " + text(10), "en", "b"), (5, "short.", "en", "b"), (6, None, "en", "a"),
        (7, "x### " * 300, "en", "a"), (8, text(90), None, None), (8, "", "en", "a"),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 4, 8}
    assert all("abcdefgh1234" not in r["text"] for r in got) and any("[SECRET]" in r["text"] for r in got)
    assert Counter(r["doc_id"] for r in got)[8] >= 1 and all(len(r["ids"]) == r["n_tokens"] for r in got)
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 999)}" for _ in range(n))
    base, clean, other, third = text(120), text(100), text(90), text(80)
    rows = [
        (1, base, "a"), (5, base + " more", "a"), (5, clean, "b"), (7, other, "a"), (7, third, "b"), (7, third, "b"),
        (8, clean + " x", "a"), (9, "", "a"), (9, other + " y", "a"), (9, None, "a"), (None, base, "c"),
        (2, third.upper() + " z", "d"), (2, third + " z", "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_each(spark, docs.repartition(4), "")
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got.collect())
    assert kept == sorted([(0, base), (1, base), (5, clean), (7, other), (2, third + " z"), (9, "")])


@pytest.mark.parametrize("blanks", ["", " " * 30, "\t" * 400, ")" * 40 + " " * 40])
def test_lines_close_however_long_their_end_is(spark, blanks):
    words = "nine words stand in this line and then it".split()
    text = "\n".join(" ".join(f"{w}{i}" for w in words) + f" here.{blanks}" for i in range(12))
    docs = spark.createDataFrame([(1, text), (2, text.replace("here.", "here")), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in quality_rules.measure(docs).collect()}
    assert (got[1]["kept"], got[1]["kept_words"]) == (True, 120) and got[1]["n_lines_kept"] == 12
    assert (got[2]["kept"], got[2]["kept_words"]) == (False, 0) and not got[3]["kept"]
