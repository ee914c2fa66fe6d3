"""Fill-in-the-middle: cut texts at two token boundaries and write their parts in another order.

A token is a word with the white space before it, or white space at the end of the text. The places behind
which a text may be cut are a set of whole numbers in the manner of a Roaring bitmap: the text is read in spans of
65,536 code points, and each span's boundaries are held in the smallest of three containers,

* an array of 16-bit places,
* a bitmap of 8 KB with running counts of bits,
* runs of places that follow each other, with running lengths.

Cumulative cardinalities of the containers lead a search for the u-th boundary to its container, and a local
select inside it gives the offset; both cuts of a text are looked up that way. So a text's boundaries cost two bytes
a token at most, and no list of tokens is made. Texts are independent, so there is no shuffle; memory is bounded by
a batch of texts and the longest text.

The form of a document follows from four numbers taken from the sha256 of ``seed:doc_id``: a text stays plain at
rate 1 - ``rate``, or if it is empty or holds one of the marks; others become prefix-suffix-middle (psm) or, with
``spm_rate``, suffix-prefix-middle (spm). As the marks aren't in the text and share no end with their beginnings,
``restored`` gives the text back exactly.

A null text counts as an empty one and stays plain with n = 0. A null doc_id is hashed as an empty one. Rows that
repeat get equal answers. The result is one struct column of the caller's name; other columns are left alone, and one
of that name is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a span, so that a place inside it has 16 bits.
SPAN = 1 << 16
#: Rates are in percent.
RATE, SPM_RATE = 50, 80


class ArrayContainer:
    """Places as they are."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    @staticmethod
    def cost(places: np.ndarray, runs: int) -> int:
        return 2 * len(places)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """A bit per place, and the number of bits before each word of 64."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def cost(places: np.ndarray, runs: int) -> int:
        return SPAN // 8

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - int(self.before[word])])


class RunContainer:
    """First places of runs, and the number of places before each run."""

    def __init__(self, places: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
        self.starts = places[first].astype(np.uint16)
        self.before = first.astype(np.uint16)  # at most 65,535 places come before a run

    @staticmethod
    def cost(places: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


KINDS = (ArrayContainer, BitmapContainer, RunContainer)


def container(places: np.ndarray):
    """The smallest container of the sorted places of a span; the first of equals."""
    runs = int((np.diff(places) != 1).sum()) + 1
    return min(KINDS, key=lambda kind: kind.cost(places, runs))(places)


class BoundarySet:
    """The last code points of a text's tokens."""

    def __init__(self, text: str):
        self.spans: list[int] = []
        self.containers: list = []
        self.upto: list[int] = []  # cumulative cardinalities
        self.n = 0
        for start in range(0, len(text), SPAN):
            places = self._ends(text[start : start + SPAN + 1], start + SPAN >= len(text))
            if len(places):
                self.n += len(places)
                self.spans.append(start)
                self.containers.append(container(places))
                self.upto.append(self.n)

    @staticmethod
    def _ends(part: str, last: bool) -> np.ndarray:
        """Places in a span that end a token; ``part`` has one more code point than the span, if there is one."""
        if part.isascii():
            code = np.frombuffer(part.encode("ascii"), np.uint8)
        else:  # lone surrogates can't come from a table, but must not end the job
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        white = (code == 32) | ((code >= 9) & (code <= 13))
        following = np.append(white[1:], True)
        ends = ~white & following
        if last:
            ends[-1] = True  # of a word, or of the white space behind the last one
        return np.flatnonzero(ends[:SPAN] if last else ends[:-1])

    def select(self, u: int) -> int:
        """The code points of the first ``u`` tokens."""
        if u == 0:
            return 0
        at = bisect_right(self.upto, u - 1)
        before = self.upto[at - 1] if at else 0
        return self.spans[at] + self.containers[at].select(u - 1 - before) + 1


def cut(text: str, h1: int, h2: int, h3: int, h4: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle, and the output."""
    boundaries = BoundarySet(text)
    n = boundaries.n
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = boundaries.select(low), boundaries.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, text: str = "text",
    doc_id: str = "doc_id", into: str = "fim",
) -> DataFrame:
    """``docs`` with a struct ``into`` of n, form, prefix_chars, middle_chars and output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def transformed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *h in batches:
            rows = [cut(x or "", *hs, rate, spm_rate) for x, *hs in zip(texts, *h)]
            frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(into, transformed(F.col(text).cast("string"), *numbers))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first = F.substring_index(body, MIDDLE, 1)  # both marked parts; the middle holds no mark
    middle = F.substr(body, F.char_length(first) + len(MIDDLE) + 1)
    left = F.when(form == "psm", F.substring_index(first, SUFFIX, 1)).otherwise(F.substring_index(first, PREFIX, 1))
    right = F.substr(first, F.char_length(left) + F.char_length(inner) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(
        F.concat(right, middle, left)
    )
