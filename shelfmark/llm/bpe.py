"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Tasks split their documents into pre-tokens, block by block. A block numbers its distinct words by how often
   they occur in it, keeps the numbers of each document's words, and cuts the word list into buckets by a hash of the word.
2. The lists are shuffled by bucket, so all occurrences of a word from all blocks meet in one task, which
   encodes each distinct word once.
3. The ids go back to their blocks, and each document's ids are put together by position; where wanted, they
   are decoded by the token-byte table in the same pass.

A block sends a word once however often it occurs in it, so frequent words cost one entry per block
and no bucket is hot. Lists travel packed, a row per block and bucket. Numbers by frequency are mostly small, so they
are stored byte by byte of equal weight and take little more than their entropy. The blocks are a table bucketed
by block, so the documents themselves are written once and never shuffled; the table is complete before
anything reads it, and a lost executor only repeats reads. A block is closed at a number of words and at a number
of bytes, and documents are put together some at a time; so memory is bounded by a block, by a bucket's distinct
words, and by the longest text, which is a block of its own if it is longer.

Every input row gives one output row; an empty table gives none. A null text counts as an empty one: no ids and no
bytes. Rows that repeat, with their doc_id or without, are encoded each by itself. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.pretokens import encode_piece, read_ranks, split
from shelfmark.session import scratch_path

#: A block is closed when it holds so many pre-tokens or bytes; a longer document is a block of its own.
BLOCK_WORDS, BLOCK_BYTES = 800_000, 6_000_000
#: Words of documents that are put together at once.
RANGE_WORDS = 100_000
_PARTS = "block long, bucket int, doc_ids binary, lengths binary, numbers binary, buckets binary, words binary, n_words int"


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(array.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones, and so on: the higher ones are nearly all zero."""
    return _pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    """Words behind their lengths; a pre-token may hold any byte."""
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    planes = np.ascontiguousarray(lengths.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=6).compress(planes.tobytes() + b"".join(words))


def _unpack_words(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    lengths = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    ends = (np.cumsum(lengths, dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return read_ranks(data)


class _Words(dict):
    """Places of words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _block_rows(ids: list, places: list[np.ndarray], words: _Words, buckets: int) -> pa.RecordBatch:
    """One row with the documents (bucket -1) and one per bucket that holds words. Words of a bucket stand in the order of
    their numbers, so the buckets of all numbers are enough to find a number's place in its bucket."""
    lengths = np.fromiter(map(len, places), np.uint32, len(places))
    flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
    often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.uint32)
    number[often] = np.arange(len(words), dtype=np.uint32)
    given = list(words)
    plain = [given[i].encode("utf-8") for i in often.tolist()]
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in plain), np.int32, len(plain))
    order = np.argsort(bucket, kind="stable")
    block = uuid.uuid4().int & (1 << 62) - 1
    doc_ids = np.array([-1 if x is None else x for x in ids], np.int64)
    missing = np.array([x is None for x in ids], np.uint8)
    names = [x.split()[0] for x in _PARTS.split(", ")]
    rows = [
        (
            block, -1, _pack(doc_ids) + missing.tobytes(), _pack(lengths),
            _pack_numbers(number[flat]), _pack_numbers(bucket), None, len(ids),
        )
    ]
    firsts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        inside = order[firsts[b] : firsts[b + 1]].tolist()
        if inside:
            rows.append((block, b, None, None, None, None, _pack_words([plain[i] for i in inside]), len(inside)))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _to_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, words, n, size = [], [], _Words(), 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                pieces = split(text)
                ids.append(doc_id)
                places.append(np.fromiter(map(words.__getitem__, pieces), np.uint32, len(pieces)))
                n, size = n + len(pieces), size + len(text)
                if n >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield _block_rows(ids, places, words, buckets)
                    ids, places, words, n, size = [], [], _Words(), 0, 0
        if ids:
            yield _block_rows(ids, places, words, buckets)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PARTS)


def _encode_words(lists: DataFrame, data) -> DataFrame:
    """Ids for the word lists of a bucket: packed counts per word, then the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(data.value)
        done: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            out = []
            for block, bucket, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last:  # rows come sorted by bucket
                    done, last = {}, bucket
                found = []
                for w in _unpack_words(words, n):
                    ids = done.get(w)
                    if ids is None:
                        ids = done[w] = encode_piece(w, ranks)
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
                out.append((block, bucket, n, _pack_numbers(np.concatenate([counts, flat]))))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()),
                ],
                names=["block", "bucket", "n_words", "ids"],
            )

    return lists.mapInArrow(encode, "block long, bucket int, n_words int, ids binary")


def _documents(block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: doc_ids, which of them are null, the ids of all, and where each one's end."""
    n = block["n_docs"]
    raw = block["doc_ids"]
    doc_ids, missing = _unpack(raw[: len(raw) - n], np.int64), np.frombuffer(raw, np.uint8, n, len(raw) - n)
    lengths, numbers = _unpack(block["lengths"], np.uint32), _unpack_numbers(block["numbers"])
    bucket = _unpack_numbers(block["buckets"])
    counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for part in sorted(block["parts"] or [], key=lambda p: p["bucket"]):
        values = _unpack_numbers(part["ids"])
        counts.append(values[: part["n_words"]])
        ids.append(values[part["n_words"] :])
    counts, ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids)
    if len(counts) != len(bucket):
        raise RuntimeError("a block misses some of its words")
    starts = np.cumsum(counts) - counts
    place = np.empty(len(bucket), np.int64)  # of a number in the lists of all buckets, one behind the other
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    starts, counts = starts[place], counts[place]
    word_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    a = 0
    while a < n:
        b = int(np.searchsorted(word_ends, word_ends[a] + RANGE_WORDS, "right")) - 1
        b = min(max(b, a + 1), n)
        some = numbers[word_ends[a] : word_ends[b]]
        per_word = counts[some]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[some] - ends + per_word, per_word) + np.arange(total)
        id_ends = np.concatenate([[0], ends])[word_ends[a : b + 1] - word_ends[a]]
        yield doc_ids[a:b], missing[a:b], ids[at].astype(np.int32), id_ends
        a = b


@lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(data).items()}


def encode(docs: DataFrame, path: str, into: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of each text, by the ranks of the file at ``path``.

    With ``into``, a column of that name holds the bytes that the ids decode to. Runs a job at once: the one that
    writes the blocks.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bpe_{uuid.uuid4().hex}"
    (
        _to_blocks(docs, parts)
        .write.format("parquet")
        .option("path", scratch_path(spark, name))
        .option("compression", "none")  # packed already
        .bucketBy(parts, "block")
        .saveAsTable(name)
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay, and the plan knows them
    lists = table.filter("bucket >= 0").select("block", "bucket", "words", "n_words")
    coded = _encode_words(lists.repartition(parts, "bucket").sortWithinPartitions("bucket"), data)
    ids = coded.groupBy("block").agg(F.collect_list(F.struct("bucket", "n_words", "ids")).alias("parts"))
    blocks = table.filter("bucket < 0").select(
        "block", "doc_ids", "lengths", "numbers", "buckets", F.col("n_words").alias("n_docs")
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                for doc_ids, missing, values, ends in _documents(block):
                    columns = [
                        pa.array(doc_ids, pa.int64(), mask=missing == 1),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                    ]
                    if into:
                        table = _token_bytes(data.value)
                        tokens, at = values.tolist(), ends.tolist()
                        columns.append(
                            pa.array([b"".join(map(table.__getitem__, tokens[a:b])) for a, b in zip(at, at[1:])], pa.binary())
                        )
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", into][: len(columns)])

    kind = "doc_id long, ids array<int>" + (f", `{into}` binary" if into else "")
    return blocks.join(ids, "block", "left").mapInArrow(assemble, kind)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids, looked up in the vocabulary's token-byte table, which is
    sent to all tasks. Null ids give null; an id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def join_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _token_bytes(data.value)
        for series in batches:
            yield pd.Series(
                [None if x is None else b"".join(map(table.__getitem__, x.tolist())) for x in series]
            )

    return encoded.withColumn(into, join_bytes(F.col(ids)))
