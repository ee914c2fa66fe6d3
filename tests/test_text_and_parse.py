import pytest
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from shelfmark.functions import parse, text as T
from shelfmark.functions.stemmer import stem


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean_text_edges(spark):
    given = [
        None, "", "<b>x</b>", "&lt;b&gt;", "&amp;lt;", "a   b", "a\x00\x07b\x1fc", " \t\r\n ",
        "a<br/>b &copy &#233; &notit; &hearts;", "1 < 2 and 3 > 2",
    ]
    assert column(spark, given, T.clean_text("x")) == [
        None, "", "x", "<b>", "&lt;", "a b", "abc", "", "a b © é ¬it; ♥", "1 2",
    ]


def test_clean_list(spark):
    got = column(
        spark, [None, [], ["<b></b>", " a ", None, "&amp;"]], T.clean_list("x"), "array<string>"
    )
    assert got == [[], [], ["a", "None", "&"]]


def test_product_text(spark):
    rows = [("T", ["a", "", "b"], "k"), (None, [], "k"), ("", None, None), ("x" * 600, ["y"], "k")]
    df = spark.createDataFrame(rows, "t string, f array<string>, k string")
    got = [r[0] for r in df.select(T.product_text(F.col("t"), F.col("f"), F.col("k"))).collect()]
    assert got == ["T a b", "k", "", "x" * 512]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, None), ("", None), ("None", None), ("$1,234.50", "1234.50"), ("from $10", "10.00"),
        ("$10 - $20", "10.00"), ("free", None), ("-5", "5.00"), ("19.999", "20.00"), ("12.", "12.00"),
    ],
)
def test_price(spark, raw, want):
    got = column(spark, [raw], parse.parse_price(F.col("x")))[0]
    assert got == (Decimal(want) if want else None)


def test_time(spark):
    given = [
        "1588615855070", "1588615855070.0", "2020-01-01T00:00:00Z", "2020-01-01T02:00:00+02:00",
        "2020-01-01", "yesterday", None, "99999999999999999999",
    ]
    new_year = datetime(2020, 1, 1)
    got = column(spark, given, parse.parse_time(F.col("x")))
    assert got[0] == datetime(2020, 5, 4, 18, 10, 55, 70000) and got[1] == got[0]
    assert got[2:] == [new_year, new_year, new_year, None, None, None]
    raw = column(spark, given, parse.epoch_ms(F.col("x")))
    assert raw[:3] == [1588615855070, 1588615855070, None]


def test_defaults(spark):
    assert column(spark, ["3", None, "x", "2.0"], parse.whole(F.col("x"))) == [3, 0, 0, 2]
    assert column(spark, ["true", "false", None, "?"], parse.flag(F.col("x"))) == [True, False, False, False]


# Published examples of the stemming rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "hopping": "hop",
    "hoping": "hope", "happily": "happili", "relational": "relat", "conditional": "condit",
    "generalization": "general", "consistency": "consist", "knack": "knack", "dying": "die", "skies": "sky",
    "running": "run", "deliveries": "deliveri", "controlling": "control", "electricity": "electr", "by": "by",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    got = column(spark, [list(STEMS), None, []], T.stems(F.col("x")), "array<string>")
    assert got == [list(STEMS.values()), None, []]


def test_query_terms():
    assert T.query_terms("The cards of THE cards", True) == ["card"]
    assert T.query_terms("to be or not to be", True) == []


def test_prompt_and_tokens(spark):
    df = spark.createDataFrame([([f"r{i}" for i in range(12)],), ([],)], "t array<string>")
    full, none = [r[0] for r in df.select(T.prompt(F.col("t"))).collect()]
    assert "1. r0\n2. r1\n" in full and "10. r9\n" in full and "r10" not in full
    assert full.endswith("Summary:") and none == T.NO_REVIEWS
    assert [r[0] for r in df.select(T.input_tokens(F.col("t"))).collect()] == [6, 0]
    assert column(spark, ["a  b\nc", " ", None], T.output_tokens(F.col("x"))) == [3, 0, 0]
    assert column(spark, ["Summary: a Summary:  b \n", "plain "], T.summary_of(F.col("x"))) == ["b", "plain "]
