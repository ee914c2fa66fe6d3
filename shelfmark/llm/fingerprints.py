"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

1. Every window of 32 bytes of a text has an entropy, on a scale of 1,000. Windows are ranked by how rare their entropy
   is among all windows of all documents; windows below a least entropy (blanks, rules, fill characters) come last.
2. Of 32 windows that follow each other, the rarest, leftmost one gets a point. Windows with 8 points or more are
   the text's features; they depend on nothing farther away than some 60 bytes, so an edit changes features near it.
3. Distinct features, in the order of their first occurrence, go into Bloom filters of 2,048 bits with five bits a feature;
   a filter that holds 160 is closed and the next one opened.
4. Likeness compares each filter of the smaller digest with its best match in the other: common bits, less those to be
   expected by chance and 0.3 of the rest, in proportion to the most that are possible, averaged over features.

Entropies are whole numbers from sums of steps: a byte that enters a window adds what its count there says, one that
leaves takes it back, and both counts come from 31 shifted comparisons of whole arrays. Long texts go through in
overlapping spans with the same result, so memory is bounded by a batch and the longest text.

``neighbours`` also compares each document with the next one by doc_id. Documents are dealt to pieces of the order of
(doc_id, sha256 of the text), whose bounds come from the ids; an id that takes up several pieces is cut by its
texts' hashes. Texts are shuffled once. Equal rows are counted in their task and sent once, so a repeated row
isn't hot. The first document of each piece is also sent to the piece before, the very first to the last.

A null text counts as an empty one; it has no features and an empty fingerprint. Shorter texts than a window are filled
with null bytes; texts without a window of 8 points have their best, leftmost one as feature. Two empty digests have
likeness 1, an empty one and another 0, equal ones 1. Rows of one doc_id follow each other by the sha256 of
their texts, so the next of a repeated row is its equal, but for the last of them; a null doc_id counts as the least.
A lone document is its own next. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 32
#: Windows that one point is given among, and the points of a feature.
AMONG, POINTS = 32, 8
ENTROPIES, LEAST_ENTROPY = 1000, 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Share of the possible common bits that counts as chance, besides those expected.
CUTOFF = 0.3
_SPAN = 1 << 17  # bytes that are looked at together
_PLACE_BITS = 18
_NONE = 1023  # the rank of a place where no window starts
_UNIT = 1 << 16

_COUNTS = np.arange(WINDOW + 2, dtype=np.float64)
_TOTALS = np.rint(_UNIT * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
#: What one more equal byte adds, by the number of those there: c log c is summed up so, and less is more entropy.
_STEPS = np.diff(_TOTALS).astype(np.int32)
_MOST = int(_TOTALS[WINDOW])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts), np.cumsum(lengths) - lengths, lengths


def _entropies(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, part by part, and their entropies. Each part has a window at least."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, min(WINDOW, n)):
        equal = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += equal
        after[: n - k] += equal
    change = np.zeros(n, np.int64)
    change[1 : n - WINDOW + 1] = _STEPS[before[WINDOW:]] - _STEPS[after[: n - WINDOW]]
    reached = np.cumsum(change)
    first = data[starts[:, None] + np.arange(WINDOW)]
    seen = np.tril(first[:, :, None] == first[:, None, :], -1).sum(axis=2)
    base = _STEPS[seen].sum(axis=1) - reached[starts]
    places = np.ones(n, np.bool_)
    ends = starts + lengths
    places[(ends[:, None] - np.arange(1, WINDOW)).ravel()] = False
    at = np.flatnonzero(places)
    total = reached[at] + np.repeat(base, lengths - WINDOW + 1)
    return at, ENTROPIES - ENTROPIES * total // _MOST


def _points(at: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """How often each place has the least rank, leftmost, of the windows from any place on."""
    none = np.uint32(_NONE << _PLACE_BITS)
    key = np.full(n + AMONG, none, np.uint32)
    key[at] = (ranks.astype(np.uint32) << np.uint32(_PLACE_BITS)) | at.astype(np.uint32)
    width = 1
    while width < AMONG:
        key[:-width] = np.minimum(key[:-width], key[width:])
        width *= 2
    return np.bincount((key[at] & np.uint32((1 << _PLACE_BITS) - 1)).astype(np.int64), minlength=n)


def _spans(texts: list[bytes]) -> Iterator[list[tuple[int, np.ndarray, int, int]]]:
    """Groups of (text, bytes, first place, end of places) of some ``_SPAN`` bytes. The places of a text's
    spans don't overlap; their bytes do, by as much as windows and points reach."""
    group, held = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8)
        for a in range(0, len(data) - WINDOW + 1, _SPAN):
            b = min(a + _SPAN, len(data) - WINDOW + 1)
            left, right = max(a - AMONG + 1, 0), min(b + AMONG + WINDOW - 2, len(data))
            group.append((i, data[left:right], a - left, b - left))
            held += right - left
            if held >= _SPAN // 2:
                yield group
                group, held = [], 0
    if group:
        yield group


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """The number of windows of each entropy."""
    counts = np.zeros(ENTROPIES + 1, np.int64)
    for group in _spans(texts):
        data, starts, lengths = _joined([g[1] for g in group])
        at, entropies = _entropies(data, starts, lengths)
        inside = np.zeros(len(data), np.bool_)
        for s, (_, _, a, b) in zip(starts.tolist(), group):
            inside[s + a : s + b] = True
        counts += np.bincount(entropies[inside[at]], minlength=ENTROPIES + 1)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy: the rarest first, of equal ones the smaller; those below the least last of all."""
    entropies = np.arange(ENTROPIES + 1)
    order = np.lexsort((entropies, counts, entropies < LEAST_ENTROPY))
    ranks = np.empty(ENTROPIES + 1, np.uint16)
    ranks[order] = np.arange(ENTROPIES + 1)
    return ranks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for column in np.ascontiguousarray(windows).view("<u8").T:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return h


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The distinct feature hashes of each text, in the order of their first occurrence."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    best: list[tuple[int, np.ndarray] | None] = [None] * len(texts)
    for group in _spans(texts):
        data, starts, lengths = _joined([g[1] for g in group])
        at, entropies = _entropies(data, starts, lengths)
        points = _points(at, ranks[entropies], len(data))
        inside = np.zeros(len(data), np.bool_)
        for s, (_, _, a, b) in zip(starts.tolist(), group):
            inside[s + a : s + b] = True
        chosen = np.flatnonzero((points >= POINTS) & inside)
        hashes = _hashes(data[chosen[:, None] + np.arange(WINDOW)])
        firsts = np.searchsorted(chosen, starts).tolist() + [len(chosen)]
        for s, (i, _, a, b), p, q in zip(starts.tolist(), group, firsts, firsts[1:]):
            if q > p:
                found[i].append(hashes[p:q])
            elif not found[i]:
                k = s + a + int(points[s + a : s + b].argmax())
                if best[i] is None or points[k] > best[i][0]:
                    best[i] = (int(points[k]), data[k : k + WINDOW].copy())
    out = []
    for some, other in zip(found, best):
        if some:
            every = np.concatenate(some)
            out.append(every[np.sort(np.unique(every, return_index=True)[1])])
        else:
            out.append(np.zeros(0, np.uint64) if other is None else _hashes(other[1][None, :]))
    return out


@dataclass
class Digest:
    """Chained Bloom filters, a row each, and the number of features in each."""

    filters: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> "Digest":
        n = -(-len(hashes) // FILTER_FEATURES)
        bits = np.zeros(n * FILTER_BITS, np.uint8)
        start = np.arange(len(hashes)) // FILTER_FEATURES * FILTER_BITS
        for k in range(HASHES):
            bits[start + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        counts = np.full(n, FILTER_FEATURES, np.int64)
        if n:
            counts[-1] = len(hashes) - (n - 1) * FILTER_FEATURES
        return cls(np.packbits(bits).reshape(n, FILTER_BITS // 8), counts)

    def __str__(self) -> str:
        return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts, self.filters))

    @classmethod
    def parse(cls, text: str) -> "Digest":
        parts = [p.split(":") for p in text.split(",")] if text else []
        filters = np.frombuffer(b"".join(base64.b64decode(p[1]) for p in parts), np.uint8)
        return cls(filters.reshape(-1, FILTER_BITS // 8), np.array([int(p[0]) for p in parts], np.int64))

    def _size(self) -> tuple:
        return len(self.counts), int(self.counts.sum()), self.filters.tobytes()

    def likeness(self, other: "Digest") -> float:
        if not len(self.counts) or not len(other.counts):
            return float(len(self.counts) == len(other.counts))
        small, large = (self, other) if self._size() <= other._size() else (other, self)
        x, y = small.filters.view(np.uint64), large.filters.view(np.uint64)
        own, bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
        clear = 1.0 - 1.0 / FILTER_BITS
        total = 0.0
        for f, n, k in zip(x, own, small.counts):
            common = np.bitwise_count(f & y).sum(axis=1, dtype=np.int64)
            m = HASHES * large.counts
            chance = FILTER_BITS * (1 - clear ** (HASHES * k) - clear**m + clear ** (HASHES * k + m))
            most = np.minimum(n, bits)
            cutoff = chance + CUTOFF * np.maximum(most - chance, 0.0)
            share = np.where(most > cutoff, (common - cutoff) / np.maximum(most - cutoff, 1e-9), common >= most)
            total += float(k) * min(max(float(share.max()), 0.0), 1.0)
        return total / float(small.counts.sum())


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    return [Digest.of(h) for h in features(texts, ranks)]


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def fingerprint(text: Column, ranks: np.ndarray) -> Column:
    """The digest of a text as a string: features and base64 of each filter."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        out, some, held = [], [], 0
        for x in texts:  # some texts at a time
            some.append(_utf8(x))
            held += len(some[-1])
            if held >= 8 * _SPAN:
                out += map(str, digests(some, ranks))
                some, held = [], 0
        return pd.Series(out + [*map(str, digests(some, ranks))], dtype="object")

    return told(text)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; null if one is null."""

    @F.pandas_udf("double")
    def told(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else Digest.parse(x).likeness(Digest.parse(y)) for x, y in zip(xs, ys)],
            dtype="float64",
        )

    return told(a, b)


_LEAST_ID = -(1 << 63)


@dataclass
class Order:
    """The pieces of the order by (doc_id, hash): bounds of ids, the first key of each piece, and the ranks."""

    bounds: np.ndarray
    ranks: np.ndarray
    leads: dict[tuple[int, str], int]  # a piece's first key: the piece before

    def pieces(self, ids: np.ndarray, hashes: list[str]) -> np.ndarray:
        return _pieces(self.bounds, ids, hashes)


def _pieces(bounds: np.ndarray, ids: np.ndarray, hashes: list[str]) -> np.ndarray:
    """Bounds start pieces; an id that is several bounds has as many pieces, by hash."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = np.array([int(h[:8], 16) for h in hashes], np.int64)
    return np.where(high > low, low + 1 + (share * (high - low) >> 32), high).astype(np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[str], list[bytes]]]:
    """doc_ids, ids in the order (a null is the least), text hashes and texts, some at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            doc_ids = part.column(0).to_pylist()
            texts = [_utf8(x.as_py()) for x in part.column(1)]
            ids = np.array([_LEAST_ID if x is None else x for x in doc_ids], np.int64)
            yield doc_ids, ids, [hashlib.sha256(t).hexdigest()[:32] for t in texts], texts


def survey(docs: DataFrame) -> Order:
    """Rarity of entropies and the pieces of the order, from all documents; two jobs, the first on ids only."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID))
    shares = [i / parts for i in range(1, parts)] or [1.0]
    told = docs.agg(F.percentile_approx(ids, shares, max(10_000, 10 * parts)).alias("b")).collect()[0]["b"]
    bounds = np.array(told or [], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ENTROPIES + 1, np.int64)
        least: dict[int, tuple[int, str]] = {}
        for _, at, hashes, texts in _rows(batches):
            counts += entropy_counts(texts)
            for piece, *key in zip(_pieces(bounds, at, hashes).tolist(), at.tolist(), hashes):
                if piece not in least or tuple(key) < least[piece]:
                    least[piece] = tuple(key)
        held = np.flatnonzero(counts)
        n, m = len(held), len(least)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held.tolist() + [None] * m, pa.int32()), pa.array([None] * n + list(least), pa.int32()),
                pa.array(counts[held].tolist() + [None] * m, pa.int64()),
                pa.array([None] * n + [k[0] for k in least.values()], pa.int64()),
                pa.array([None] * n + [k[1] for k in least.values()], pa.string()),
            ],
            names=["entropy", "piece", "n", "at", "hash"],
        )

    told = _texts(docs).mapInArrow(count, "entropy int, piece int, n long, at long, hash string")
    first = F.min(F.struct("at", "hash")).alias("first")
    counts, firsts = np.zeros(ENTROPIES + 1, np.int64), {}
    for r in told.groupBy("entropy", "piece").agg(F.sum("n").alias("n"), first).collect():  # 1,001 and the pieces
        if r["entropy"] is not None:
            counts[r["entropy"]] = r["n"]
        else:
            firsts[r["piece"]] = tuple(r["first"])
    used = sorted(firsts)
    return Order(bounds, ranks_of(counts), {firsts[p]: used[i - 1] for i, p in enumerate(used)})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _dealt(docs: DataFrame, order: Order) -> DataFrame:
    """Texts to their pieces: equal rows of a task once, with a row of their further number; leads twice."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
            names = "piece lead at doc_id hash text copies".split()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for doc_ids, ids, hashes, texts in _rows(batches):
            rows = []
            for piece, at, doc_id, h, text in zip(order.pieces(ids, hashes).tolist(), ids.tolist(), doc_ids, hashes, texts):
                key = (piece, at, doc_id, h)
                if key in seen:
                    seen[key] += 1
                    continue
                seen[key] = 0
                rows.append((piece, False, at, doc_id, h, text, 1))
                if (at, h) in order.leads:
                    rows.append((order.leads[at, h], True, at, doc_id, h, text, 1))
            yield made(rows)
        yield made([(p, False, at, doc_id, h, None, n) for (p, at, doc_id, h), n in seen.items() if n])

    kind = "piece int, lead boolean, at long, doc_id long, hash string, text binary, copies long"
    return _texts(docs).mapInArrow(deal, kind)


_NEIGHBOURS = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def neighbours(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """Per row ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``edited`` is the text with its last half replaced by the beginning of the next document's.
    """
    order = order or survey(docs)
    ranks = order.ranks

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
            """``rows`` and the row after each, as doc_id, text, copies and digest."""
            out, edits = [], []
            for (doc_id, text, copies, digest), (_, other, _, after) in zip(rows, nexts):
                half = len(text) // 2
                for following, near, n in ((text, digest, copies - 1), (other, after, 1)):
                    if n:
                        edits.append(text[: len(text) - half] + following[:half])
                        out.append((doc_id, len(text), digest, digest.likeness(near), n))
            again = digests([_utf8(e) for e in edits], ranks)
            columns = [[] for _ in range(7)]
            for (doc_id, n_chars, digest, near, n), edit, changed in zip(out, edits, again):
                row = (doc_id, n_chars, edit, str(digest), str(changed), digest.likeness(changed), near)
                for column, value in zip(columns, row):
                    column.extend([value] * n)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = "doc_id n_chars edited fingerprint edited_fingerprint near_edited near_next".split()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def digested(rows: list[tuple]) -> list[tuple]:
            told = digests([r[1] for r in rows], ranks)
            return [(r[0], r[1].decode("utf-8"), r[2], d) for r, d in zip(rows, told)]

        waiting: list[tuple] = []  # the last row with its digest, whose next isn't known yet
        rows: list[list] = []  # doc_id, text, copies
        last, held = None, 0
        for batch in batches:
            piece, lead, at, doc_id, hashed, _, copies = (c.to_pylist() if i != 5 else None for i, c in enumerate(batch.columns))
            for i, text in enumerate(batch.column(5)):
                key = (piece[i], lead[i], at[i], doc_id[i], hashed[i])
                if key == last:  # one row a task, and one of the further number; a lead has one of each task
                    if not lead[i]:
                        rows[-1][2] += copies[i]
                        if rows[-1][1] is None:
                            rows[-1][1] = text.as_py()
                    continue
                if held >= 4 * _SPAN or lead[i]:  # a lead ends its piece
                    done = waiting + digested(rows)
                    if lead[i]:
                        yield made(done, done[1:] + digested([(None, text.as_py(), 1)]))
                        waiting = []
                    else:
                        yield made(done[:-1], done[1:])
                        waiting = done[-1:]
                    rows, held = [], 0
                last = key
                if not lead[i]:
                    rows.append([doc_id[i], text.as_py(), copies[i]])
                    held += len(rows[-1][1] or b"")

    parts = max(len(order.bounds) + 1, 1)
    pieces = _dealt(docs, order).repartitionById(parts, F.col("piece"))
    return pieces.sortWithinPartitions("piece", "lead", "at", "doc_id", "hash").mapInArrow(compare, _NEIGHBOURS)
