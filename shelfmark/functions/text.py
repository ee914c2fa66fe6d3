"""Text column expressions: cleaning, product text, tokens, stems, prompts."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from shelfmark import settings
from shelfmark.functions.stemmer import stem

# Markup, control characters (tab, LF and CR stay), any Unicode white space.
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACE = r"(?U)\s+"

# Stop words of the English text-search configuration.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)

# The summary prompt and the reply when there is nothing to summarise.
SUMMARY_PROMPT = """You are a concise product review analyst.
Given the following customer reviews for a product, write a short pros/cons summary.
 
Reviews:
{reviews}
 
Respond in this format:
Pros:
- <point>
Cons:
- <point>
 
Summary:"""
NO_REVIEWS = "No reviews available for this product"


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references in one pass.

    Only rows holding an ampersand travel to Python; the others stay in the JVM.
    """
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_text(text: Column | str) -> Column:
    """Strip tags, decode entities, drop control characters, collapse white space.

    Tags go first, so escaped markup survives as text. Null and '' pass through.
    """
    t = F.col(text) if isinstance(text, str) else text
    decoded = decode_entities(F.regexp_replace(t, TAG, " "))
    return F.trim(F.regexp_replace(F.regexp_replace(decoded, CONTROL, ""), SPACE, " "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_list(items: pd.Series) -> pd.Series:
    return items.map(
        lambda xs: None if xs is None else [None if x is None else html.unescape(x) for x in xs]
    )


def clean_list(items: Column | str) -> Column:
    """Clean every element and drop the empty ones; a null list gives ``[]``."""
    xs = F.col(items) if isinstance(items, str) else items
    # Python prints a missing element as the word None, and cleaning keeps it.
    texts = F.transform(xs, lambda x: F.regexp_replace(F.coalesce(x, F.lit("None")), TAG, " "))
    marked = F.when(F.exists(texts, lambda x: F.contains(x, F.lit("&"))), texts)
    decoded = F.coalesce(_unescape_list(marked), texts)
    cleaned = F.transform(
        decoded, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, CONTROL, ""), SPACE, " "))
    )
    return F.coalesce(F.filter(cleaned, lambda x: x != ""), F.array().cast("array<string>"))


def product_text(
    title: Column, features: Column, key: Column, max_chars: int = settings.PRODUCT_TEXT_CHARS
) -> Column:
    """Title and non-empty features as the text to embed; the key, then '', as fallback."""
    parts = F.filter(
        F.concat(F.array(title), F.coalesce(features, F.array().cast("array<string>"))),
        lambda x: x.isNotNull() & (x != ""),
    )
    joined = F.trim(F.array_join(parts, " "))
    return F.coalesce(F.nullif(F.substring(joined, 1, max_chars), F.lit("")), key, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}  # words of one task; titles repeat a small vocabulary

    def of(word: str) -> str:
        if word not in known:
            known[word] = stem(word)
        return known[word]

    for words in batches:
        yield words.map(lambda ws: None if ws is None else [of(w) for w in ws])
        if len(known) > 100_000:
            known.clear()


def title_terms(title: Column | str) -> Column:
    """The distinct stems of a title, to be stored beside it for keyword search."""
    return F.array_distinct(stems(tokens(F.col(title) if isinstance(title, str) else title)))


def query_terms(query: str, stemming: bool) -> list[str]:
    """Distinct terms of a keyword query, without stop words."""
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    kept = [w for w in words if w not in STOP_WORDS]
    return list(dict.fromkeys(stem(w) if stemming else w for w in kept))


def prompt(texts: Column, max_reviews: int = settings.PROMPT_REVIEWS) -> Column:
    """Numbered review lines inside the summary template; a fixed message without reviews."""
    lines = F.transform(
        F.slice(texts, 1, max_reviews),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x),
    )
    head, tail = SUMMARY_PROMPT.split("{reviews}")
    filled = F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit(tail))
    return F.when(F.size(texts) > 0, filled).otherwise(F.lit(NO_REVIEWS))


def summary_of(generated: Column) -> Column:
    """The part after the last ``Summary:`` marker, trimmed; all of it without a marker."""
    after = F.regexp_replace(F.substring_index(generated, "Summary:", -1), r"(?U)^\s+|\s+$", "")
    return F.when(F.contains(generated, F.lit("Summary:")), after).otherwise(generated)


def input_tokens(texts: Column) -> Column:
    """A quarter of the characters handed to the generator, rounded down."""
    chars = F.aggregate(texts, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return F.floor(chars / settings.CHARS_PER_TOKEN)


def output_tokens(text: Column) -> Column:
    """White-space separated words; 0 for blank or missing text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")
    return F.size(words)
