"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The distance 1 - similarity is a metric, and the join is by pivots and windows, exactly:

1. Pivots of the first level are single shingles. A set is at distance 1 - 1/n from its own shingles and at
   1 from all others, so its home is the first of its shingles in one order for all, and the triangle
   inequality bounds the window around it: a set within the radius can lack at most n - ceil(0.8 n) of them,
   so each set visits the regions of that many shingles and one more. (Documents as pivots of this level
   don't part anything: nearly all texts are at distance 1 from each other.)
2. Regions of shingles that many texts share (common lines and passages) would be large and full of
   unlike texts. They are counted first, and such shingles put last in the order, so sets visit others instead.
   A fixed-size bit table says which are last. A shingle that shares its bit with one of them is last too; the
   order stays one for all, so this costs nothing but a slightly longer walk.
3. Small regions compare all their sets. In large ones, which now are groups of near copies, one document is
   the pivot, all others are measured against it, and sets within the radius of it are one component. Then the
   region is joined again: only sets outside its largest component are still compared, with sets of other
   components that are within the windows of size and of shingle counts in 64 classes.
4. Pairs left are verified on whole sets, which are read again from the texts for the documents concerned:
   first one pair for each document, then those that would join different components. Before that, parities
   of shingle counts, two bits a shingle, leave few pairs that aren't links.

Equal sets are one node, so copies never meet each other in a region. Shingles and sets are known by 64-bit
hashes. Components come from links by repeated contraction in tables; nothing per document is ever collected.

A null text or one without words has an empty set, no links and itself as component. A row without a doc_id links as
others do and has the component of its links; if none of them has an id, null. Rows that repeat with
their doc_id are copies of each other if their texts are equal; if not, they are separate documents that share
an id. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import materialize, scratch_path

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Regions of more sets are large.
LARGE_REGION = 32
#: Bits of the tables of common shingles and of documents to read again: 2 MB each, whatever the input.
TABLE_BITS = 24
CLASSES = 64
#: Bounds of a cell of a large region, and links that a task contracts by itself.
CELL, TASK_LINKS = 4096, 20_000
_CHUNK = 1 << 19

_ODD = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, np.bool_)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and powers of a number and of its inverse modulo 2^64."""
    letters = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
    powers = [np.full(size, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 2**64))]
    for p in powers:
        p[:1] = 1
    return letters, np.cumprod(powers[0]), np.cumprod(powers[1])


def _cut(data: bytes, at: int) -> int:
    """Where the chunk that starts at ``at`` ends: behind white space, or where a longer word ends."""
    stop = at + _CHUNK
    if stop >= len(data):
        return len(data)
    white = np.flatnonzero(_WHITE[np.frombuffer(data, np.uint8, _CHUNK, at)])
    if len(white):
        return at + int(white[-1]) + 1
    found = re.compile(rb"[\x20\x09-\x0D]").search(data, stop)
    return found.end() if found else len(data)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all words, by sums over the bytes of each word; one pass without a loop
    over words."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        stop = _cut(data, at)
        part = np.frombuffer(data, np.uint8, stop - at, at)
        letters, powers, inverses = _powers(max(_CHUNK, len(part)))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[part], [True]])))
        first, end = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[part] * powers[: len(part)])])
        length = (end - first).astype(np.uint64)
        hashes.append(_mixed((sums[end] - sums[first]) * inverses[first] + length))
        starts.append(first + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    datas = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    offsets = np.cumsum([0, *(len(d) + 1 for d in datas)])
    words, starts = _word_hashes(b"\n".join(datas))
    firsts = np.searchsorted(starts, offsets)
    chain = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        chain = _mixed(chain * np.uint64(_ODD) + words[k : k + len(chain)])
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(chain[a : b - WORDS + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                short = _mixed(short * np.uint64(_ODD) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, some million characters at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= _CHUNK:
                yield ids, shingle_sets(texts)
                ids, texts, held = [], [], 0
        if ids:
            yield ids, shingle_sets(texts)


def visits(n: int) -> int:
    """Regions that a set of ``n`` shingles visits."""
    return n - -(-PERCENT * n // 100) + 1


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _bits(slots: np.ndarray) -> bytes:
    table = np.zeros(1 << TABLE_BITS, np.bool_)
    table[slots] = True
    return np.packbits(table).tobytes()


@lru_cache(maxsize=1)
def _table(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.bool_)


def _slots_of(column) -> DataFrame:
    """The table slot of a long, as ``_slot`` has it for the unsigned value."""
    return F.shiftrightunsigned(column, 64 - TABLE_BITS).cast("int")


def _common(docs: DataFrame) -> bytes:
    """Table of the shingles that more than ``LARGE_REGION`` texts would visit in plain order."""

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _in_chunks(batches):
            some = [s[: visits(len(s))] for s in sets if len(s)]
            if some:
                column = pa.array(np.concatenate(some).view(np.int64))
                yield pa.RecordBatch.from_arrays([column], names=["s"])

    counts = docs.mapInArrow(visited, "s long").groupBy("s").count()
    slots = counts.filter(F.col("count") > LARGE_REGION).select(_slots_of(F.col("s")).alias("slot")).distinct()
    return _bits(slots.toPandas()["slot"].to_numpy(np.int64))


def _fingerprint(s: np.ndarray) -> int:
    total = np.full(1, len(s), np.uint64) * np.uint64(_ODD) + _mixed(s ^ np.uint64(_ODD)).sum(dtype=np.uint64)
    return int(_mixed(total).view(np.int64)[0])


def _parities(s: np.ndarray) -> bytes:
    """Bits that say whether an odd number of shingles falls to them: about two bits for a shingle.

    Two sets differ in at least as many shingles as bits, and hardly more if they are alike.
    """
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parities for fewer bits: a shingle's place is the low bits of its hash."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _apart(x: bytes | np.ndarray, y: bytes | np.ndarray) -> int:
    """Shingles that two sets differ in, at least, by their parities."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    return int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum())


def with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of each row's set as ``node``."""

    @F.pandas_udf("long")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            # some texts at a time, as many as make a chunk
            parts, some, held = [], [], 0
            for t in texts:
                some.append(t)
                held += len(t or "")
                if held >= _CHUNK:
                    parts += map(_fingerprint, shingle_sets(some))
                    some, held = [], 0
            yield pd.Series(parts + [*map(_fingerprint, shingle_sets(some))], dtype="int64")

    return docs.withColumn("node", told(F.col("text").cast("string")))


def _sets(docs: DataFrame, path: str) -> DataFrame:
    """Per row: set size, node (its set's hash), shingle counts by class and parities."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _in_chunks(batches):
            classes = [
                np.minimum(np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255)
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.int64()),
                    pa.array([c.astype(np.uint8).tobytes() for c in classes], pa.binary()),
                    pa.array([_parities(s) for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "node", "classes", "parities"],
            )

    kind = "doc_id long, n long, node long, classes binary, parities binary"
    docs.mapInArrow(read, kind).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _visiting(docs: DataFrame, common: bytes) -> DataFrame:
    """``s, node, n`` for each region that a set visits. Written nowhere: it is as large as a fifth of
    all shingles, and the texts are sooner read once more."""
    bits = docs.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _table(bits.value)
        for _, sets in _in_chunks(batches):
            chosen: dict[int, tuple[np.ndarray, int]] = {}  # of copies that stand together, one visits
            for s in sets:
                if len(s) and (node := _fingerprint(s)) not in chosen:
                    late = last[_slot(s)]
                    k = visits(len(s))
                    early = s[~late][:k]
                    more = s[late][: k - len(early)]
                    chosen[node] = (np.concatenate([early, more]), len(s))
            if chosen:
                k = [len(v) for v, _ in chosen.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([v for v, _ in chosen.values()]).view(np.int64)),
                        pa.array(np.repeat(np.fromiter(chosen, np.int64, len(chosen)), k)),
                        pa.array(np.repeat(np.array([n for _, n in chosen.values()], np.int64), k)),
                    ],
                    names=["s", "node", "n"],
                )

    return docs.mapInArrow(read, "s long, node long, n long")


def _close_sizes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT


_MEETING = "large boolean, s long, a long, b long, n long"


def _meetings(visiting: DataFrame, path: str) -> DataFrame:
    """From each region: pairs of sets to compare, and the members of large regions (b null).

    A small region gives all pairs of close sizes, a large one those of its pivot, the smallest node.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)

        def regions(rows: np.ndarray) -> pa.RecordBatch | None:
            s, node, n = rows
            fresh = np.ones(len(s), np.bool_)
            fresh[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
            s, node, n = s[fresh], node[fresh], n[fresh]
            firsts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([firsts, [len(s)]]))
            left, right = [], []
            for m in np.unique(sizes[(sizes > 1) & (sizes <= LARGE_REGION)]):
                i, j = np.triu_indices(int(m), 1)
                at = firsts[sizes == m]
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
            big = sizes > LARGE_REGION
            inside = np.repeat(big, sizes)
            pivot = np.repeat(firsts, sizes)[inside]
            members = np.flatnonzero(inside)
            left.append(pivot[pivot != members])
            right.append(members[pivot != members])
            a, b = np.concatenate(left), np.concatenate(right)
            close = _close_sizes(n[a], n[b])
            a, b = a[close], b[close]
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
            k, zero = pairs.shape[1], np.zeros(pairs.shape[1], np.int64)
            if not k + len(members):
                return None
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([False, True], [k, len(members)])),
                    pa.array(np.concatenate([zero, s[members]])),
                    pa.array(np.concatenate([pairs[0], node[members]])),
                    pa.array(np.concatenate([pairs[1], members * 0]), mask=np.repeat([False, True], [k, len(members)])),
                    pa.array(np.concatenate([zero, n[members]])),
                ],
                names=["large", "s", "a", "b", "n"],
            )

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            rows = np.concatenate([rest, rows], axis=1)
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last region may go on
            rest = rows[:, cut:]
            if cut and (out := regions(rows[:, :cut])) is not None:
                yield out
        if rest.shape[1] and (out := regions(rest)) is not None:
            yield out

    spark = visiting.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = visiting.repartition(parts, "s").sortWithinPartitions("s", "node").mapInArrow(meet, _MEETING)
    met.write.parquet(path)
    return spark.read.parquet(path)


def _far(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether shingle counts by class differ more than sets within the radius can."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return apart * (100 + PERCENT) > (n + m) * (100 - PERCENT)


def _class_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CLASSES)


def _within_windows(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose counts by class are close enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            near = ~_far(_class_matrix(batch.column(4)), _class_matrix(batch.column(5)), n, m)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("classes").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("classes").alias("y"))
    told = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y")
    return told.mapInArrow(keep, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose parities are close enough; few others than those within the radius are left."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - PERCENT)
            near = np.zeros(batch.num_rows, np.bool_)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                near[i] = _apart(x.as_buffer(), y.as_buffer()) * (100 + PERCENT) <= most[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(i).to_numpy()[near]) for i in (0, 1)], names=["a", "b"]
            )

    wanted = sets.select("node", "n", "parities").join(_ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    x = wanted.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("parities").alias("x"))
    y = wanted.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parities").alias("y"))
    told = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y")
    return told.mapInArrow(keep, "a long, b long")


def _whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted nodes, from the text of one document of each.

    A table of bits says which documents to look at in the scan, so texts don't travel. Documents that share
    a bit with a wanted one come along; the joins leave them out. Of each hash 48 bits are enough to compare
    two sets, whose sizes are known.
    """
    spark = docs.sparkSession
    first = nodes.join(wanted, "node").select("node", F.col("doc").alias("doc_id"))
    slots = first.select(_slots_of(F.xxhash64("doc_id")).alias("slot")).distinct()
    bits = spark.sparkContext.broadcast(_bits(slots.toPandas()["slot"].to_numpy(np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(bits.value)

        def looked_at():
            for batch in batches:
                yield batch.filter(pa.array(table[batch.column(2).to_numpy()]))

        for _, sets in _in_chunks(looked_at()):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_fingerprint(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "shingles"],
            )

    # documents without an id share a slot, which is looked at where a wanted node has no other document
    with_slot = docs.select("doc_id", "text", _slots_of(F.xxhash64("doc_id")).alias("slot"))
    return with_slot.mapInArrow(read, "node long, shingles binary").dropDuplicates(["node"])


def _unpacked(data: pa.Scalar) -> np.ndarray:
    six = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).view(np.uint64).ravel()


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs within the radius, by whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            mask = np.array(near, np.bool_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(i).to_numpy()[mask]) for i in (0, 1)], names=["a", "b"]
            )

    x = whole.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = whole.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each node with the smallest one that it is linked to within the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for i in range(0, len(stars), 100_000):
        u, v = zip(*stars[i : i + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node: the smallest node of its component.

    Links are turned round by turn to the smallest node known near either end, until all end at roots. Each
    round first contracts the links of every task, then halves the longest way by plain grouped minima. The
    number of tasks follows from the number of links.
    """
    spark = links.sparkSession
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = min(-(-edges.count() // TASK_LINKS) or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    before = None
    while True:
        edges = materialize(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
        # every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")).coalesce(tasks)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.union(low.filter("low < u").select("u", F.col("low").alias("v")))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        # every smaller neighbour of a node, and the node, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("low")).coalesce(tasks)
        small = large.join(least, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.union(least.select("u", F.col("low").alias("v"))).coalesce(tasks)
        edges = materialize(small.distinct().coalesce(tasks))
        told = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).collect()[0]
        if told == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = told


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    x = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    y = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    told = pairs.join(x, "a", "left").join(y, "b", "left")
    return told.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


class _Parities:
    """Parities of many sets, by their size, to be compared with those of one."""

    def __init__(self, parities: list[bytes]):
        sizes = np.fromiter(map(len, parities), np.int64, len(parities))
        self.sizes, self.place, self.rows = sizes, np.zeros(len(parities), np.int64), {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            self.place[at] = np.arange(len(at))
            self.rows[size, size] = np.frombuffer(b"".join(parities[i] for i in at), np.uint8).reshape(-1, size)

    def _folded(self, size: int, to: int) -> np.ndarray:
        if (size, to) not in self.rows:
            rows = self.rows[size, size]
            self.rows[size, to] = np.bitwise_xor.reduce(rows.reshape(len(rows), -1, to), axis=1)
        return self.rows[size, to]

    def apart(self, one: bytes, some: np.ndarray) -> np.ndarray:
        """Shingles that the set differs in, at least, from each of ``some``."""
        out = np.zeros(len(some), np.int64)
        own = np.frombuffer(one, np.uint8)
        for size in np.unique(self.sizes[some]).tolist():
            to = min(size, len(own))
            at = np.flatnonzero(self.sizes[some] == size)
            rows = self._folded(size, to)[self.place[some[at]]]
            out[at] = np.bitwise_count(rows ^ _folded(own, to)).sum(axis=1)
        return out


def _cell_pairs(asked: pa.Table, others: pa.Table, closest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of one of ``asked`` with one of ``others`` that are of different components and within all windows."""
    node, n, root = (others.column(c).to_numpy() for c in ("node", "n", "root"))
    classes = _class_matrix(others.column("classes"))
    parities = _Parities(others.column("parities").to_pylist())
    own = _class_matrix(asked.column("classes"))
    for i, (x, m, r, bits) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("node", "n", "root", "parities")))):
        some = np.flatnonzero((root != r) & _close_sizes(n, np.int64(m)))
        some = some[~_far(classes[some], own[i : i + 1], n[some], np.int64(m))]
        if closest and len(some):
            some = some[[np.abs(classes[some].astype(np.int16) - own[i]).sum(axis=1).argmin()]]
        some = some[parities.apart(bits, some) * (100 + PERCENT) <= (n[some] + m) * (100 - PERCENT)]
        if len(some):
            low, high = np.minimum(node[some], x), np.maximum(node[some], x)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _across(members: DataFrame, roots: DataFrame, sets: DataFrame, closest: bool) -> DataFrame:
    """Pairs left in large regions: sets outside the largest component of their region with the closest by
    counts, or with all, of those of other components that are within the windows and alike in parities.

    Regions of one component have none. The others are cut into cells of at most about ``CELL`` sets outside the
    largest component and as many of all, so no task holds a region.
    """
    told = materialize(members.join(roots, "node", "left").select("s", "node", "n", F.coalesce("root", "node").alias("root")))
    kinds = told.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    regions = kinds.groupBy("s").agg(
        F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main")
    ).filter("size > most")
    cut = lambda column: F.ceil(column / F.lit(CELL)).cast("int")
    placed = told.join(
        regions.select("s", "main", cut(F.col("size")).alias("down"), cut(F.col("size") - F.col("most")).alias("across")), "s"
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    known = sets.select("node", "classes", "parities")
    known = known.join(placed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    placed = materialize(placed.join(known, "node"))
    of = ["s", "node", "n", "root", "classes", "parities"]
    cells = placed.select(*of, F.lit(False).alias("asked"), slot(F.col("down")).alias("i"), upto(F.col("across")).alias("j")).union(
        placed.filter("root <> main").select(*of, F.lit(True), upto(F.col("down")), slot(F.col("across")))
    )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def pairs() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            asked = np.asarray(table.column("asked").to_pylist(), np.bool_)
            if asked.any() and not asked.all():
                yield from _cell_pairs(table.filter(pa.array(asked)), table.filter(pa.array(~asked)), closest)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("s", "i", "j")])
            fresh = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            edges = [0, *fresh.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                key = tuple(cell[:, a].tolist())
                if held and key != last:
                    yield from pairs()
                    held.clear()
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from pairs()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "s", "i", "j").sortWithinPartitions("s", "i", "j")
    return dealt.mapInArrow(rest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row; the smallest doc_id reachable by links.

    Runs jobs at once; its tables go to the shared scratch folder.
    """
    return linked_sets(docs).select("doc_id", "n_shingles", "component_id")


def linked_sets(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, node, root``.

    ``node`` is the hash of the row's set. ``root`` is the smallest node of its component, null for an empty
    set; it tells components apart that have a reused doc_id as their smallest.
    """
    spark: SparkSession = docs.sparkSession
    at = scratch_path(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = _sets(docs, f"{at}/sets")
    sets.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("classes").alias("classes")
    ).write.parquet(f"{at}/nodes")
    nodes = spark.read.parquet(f"{at}/nodes")
    met = _meetings(_visiting(docs, _common(docs)), f"{at}/meetings")
    members = met.filter("large").select("s", F.col("a").alias("node"), "n").distinct()
    close = materialize(_within_windows(met.filter("not large").select("a", "b").distinct(), nodes))
    _alike(close, sets).write.parquet(f"{at}/pairs")
    pairs = spark.read.parquet(f"{at}/pairs")
    # whole sets are heavy: first one pair for each node, the smallest partner; that joins most groups
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(_verified(first, _whole_sets(docs, nodes, _ends(first))))
    # then only pairs that would join different components, and those left in large regions
    roots = materialize(components(links))
    large = bool(members.take(1))
    if large:  # most of what is left in large regions joins by its closest neighbour
        closest = materialize(_across(members, roots, sets, True))
        links = materialize(links.union(_verified(closest, _whole_sets(docs, nodes, _ends(closest)))))
        roots = materialize(components(links))
    rest = _between(pairs, roots)
    if large:
        rest = rest.union(_across(members, roots, sets, False)).distinct()
    rest = materialize(rest)
    if rest.take(1):
        links = links.union(_verified(rest, _whole_sets(docs, nodes, _ends(rest))))
    roots = components(links)
    # the smallest document of a component, then of each node
    named = nodes.select("node", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    of_node = named.select("node", "root").join(smallest, "root").select("node", "root", "component")
    return sets.select("doc_id", "n", "node").join(of_node, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        "node",
        "root",
    )
