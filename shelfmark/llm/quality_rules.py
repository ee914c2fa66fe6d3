"""Quality rules: line-first cleaning, with built-in SQL functions only.

Every line is judged by itself (closing punctuation, navigation, runs of marks, boilerplate); lines
that fail are removed, and a document that loses too many of its words with them is rejected. Whole
documents are also counted: words, symbols, repeated lines and words inside repeated 3-word windows.

All of it happens inside a row, so there is no shuffle and no hot group. A null text counts as one
without words; an empty or blank one has no words, fails the base rule and is rejected. Repeated rows
are judged separately and alike. Extra columns are left alone; the result goes into one struct column
whose name the caller chooses (a column of that name is replaced).

Repeated windows are found by sorting hashes and then confirmed by comparing the words themselves.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

#: A line closes like a sentence: a full stop or its like, then closing quotes or brackets.
STOPS, CLOSERS = ".!?:;\u2026\u3002\uff01\uff1f", "\"'\u2019\u201d\u00bb)]"
#: Separators of menus and bread crumbs.
SEPARATOR = r"[|>\x{00bb}\x{203a}\x{2022}\x{00b7}]"
#: Runs of marks that prose does not have.
MARKS = r"[#*$%&|<>]{2,}|[!?]{2,}"
#: Phrases of page furniture, looked for in short lines only: a long paragraph may well mention one.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "skip to content", "click here to", "our newsletter",
)
BOILERPLATE_WORDS = 30
#: A line of so many words is a paragraph, even if its last sentence is cut off.
PARAGRAPH_WORDS = 20

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: At least this percentage of the words must be left after the failing lines are gone.
MIN_KEPT_PERCENT = 50

#: A window's place takes so many low bits of a sorted number, its hash the others.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_TRIMMED))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def line_passes(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words is worth keeping. The cheapest tests stand first."""
    lower = F.lower(line)
    # blanks first, then what may follow a stop: the same as a pattern at the line's end, however long that is
    bare = F.rtrim(F.rtrim(line, F.lit(_TRIMMED)), F.lit(CLOSERS))
    closed = F.contains(F.lit(STOPS), F.right(bare, F.lit(1))) & (bare != "")
    furniture = reduce(or_, (F.contains(lower, F.lit(x)) for x in BOILERPLATE))
    return (
        ((n >= PARAGRAPH_WORDS) | closed)
        & (F.regexp_count(line, F.lit(SEPARATOR)) * 4 < n)
        & (F.regexp_count(line, F.lit(MARKS)) * 5 < n)
        & ((n > BOILERPLATE_WORDS) | ~furniture)
    )


def _window_hash(words: Column, w: Column, i: Column) -> Column:
    return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))


def _sorted_windows(words: Column, packed: bool) -> Column:
    """The 3-word windows by hash, then place. Packed, both share one number, and plain numbers sort
    many times faster than structs; a text too long for the packed place gets structs."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    if packed:
        return F.sort_array(
            F.transform(
                starts,
                lambda w, i: _window_hash(words, w, i)
                .bitwiseAND(F.lit(~_PLACE))
                .bitwiseOR(i.cast("long")),
            )
        )
    return F.sort_array(
        F.transform(starts, lambda w, i: F.struct(_window_hash(words, w, i).alias("h"), i.alias("i")))
    )


def _repeat_places(words: Column, windows: Column, packed: bool) -> Column:
    """Places of the windows found twice or more, in order: neighbours of equal hash and equal words."""
    if packed:
        place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
        alike = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~_PLACE)) == 0
    else:
        place = lambda x: x["i"]
        alike = lambda x, y: x["h"] == y["h"]

    def pair(x: Column, k: Column) -> Column:
        after = F.get(windows, k + 1)
        return F.when(alike(x, after), F.array(place(x), place(after)))

    def same(p: Column) -> Column:
        i, j = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return reduce(and_, (F.get(words, i + k) == F.get(words, j + k) for k in range(3)))

    pairs = F.filter(F.transform(windows, pair), lambda p: F.coalesce(same(p), F.lit(False)))
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _covered(places: Column) -> Column:
    """Words inside windows at the given ordered places: each adds the words after the place before."""
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(3), i - s["at"])).alias("n")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, into: str = "quality", text: str = "text") -> DataFrame:
    """``docs`` with a struct column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_lines_kept, kept_words, base_failed, kept, clean_text.

    ``clean_text`` is the text without its failing lines (lines without words stay); it is null where
    the document is rejected.
    """
    own = f"__{into}_"
    body = F.coalesce(F.col(text), F.lit(""))
    words, windows, lines, m = (F.col(own + x) for x in ("words", "windows", "lines", "m"))
    short = F.size(words) <= _PLACE
    step = docs.withColumn(own + "words", words_of(F.col(text)))
    step = step.withColumn(own + "windows", F.when(short, _sorted_windows(words, True)))
    step = step.withColumn(own + "long_windows", F.when(~short, _sorted_windows(words, False)))
    step = step.withColumn(
        own + "places",
        F.when(short, _repeat_places(words, windows, True)).otherwise(
            _repeat_places(words, F.col(own + "long_windows"), False)
        ),
    )

    def judged(line: Column) -> Column:
        return F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n"))

    step = step.withColumn(
        own + "lines",
        F.transform(
            F.transform(F.split(body, "\n", -1), judged),
            lambda l: F.struct(l["line"], l["n"], line_passes(l["line"], l["n"]).alias("ok")),
        ),
    )
    full = F.filter(lines, lambda l: l["n"] > 0)
    step = step.withColumn(
        own + "m",
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda l: l["line"]))))
            .cast("long").alias("n_dup_lines"),
            _covered(F.col(own + "places")).alias("n_repeat_words"),
            F.size(full).cast("long").alias("n_lines"),
            F.size(F.filter(full, lambda l: l["ok"])).cast("long").alias("n_lines_kept"),
            F.aggregate(
                full, F.lit(0).cast("long"), lambda s, l: s + F.when(l["ok"], l["n"]).otherwise(0)
            ).alias("kept_words"),
        ),
    )
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    kept = ~failed & (m["kept_words"] * 100 >= m["n_words"] * MIN_KEPT_PERCENT)
    clean = F.array_join(
        F.transform(F.filter(lines, lambda l: (l["n"] == 0) | l["ok"]), lambda l: l["line"]), "\n"
    )
    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_lines_kept kept_words"
    ).split()
    out = F.struct(
        *(m[x].alias(x) for x in names),
        failed.alias("base_failed"),
        kept.alias("kept"),
        F.when(kept, clean).alias("clean_text"),
    )
    return step.withColumn(into, out).drop(
        *(own + x for x in ("words", "windows", "long_windows", "places", "lines", "m"))
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with ``text`` cut to its passing lines and ``n_chars`` to match."""
    columns = docs.columns
    # exploded, so that the filter stays above: pushed down, it would repeat all that it is made of
    judged = measure(docs, "__rules").select(*columns, F.explode(F.array("__rules")).alias("__kept"))
    kept = judged.filter(F.col("__kept.kept"))
    kept = kept.withColumn("text", F.col("__kept.clean_text"))
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*columns)
