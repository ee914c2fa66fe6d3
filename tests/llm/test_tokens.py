"""Token counts and byte-level BPE against the public libraries."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

from shelfmark.llm import bpe, token_counts  # noqa: E402
from shelfmark.llm.pretokens import PrefixCounter, encode_piece, read_ranks, split  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

PARTS = [
    "a", "b", " ", "  ", "\n", "'", "ll", "'re", "s", "1", "23", "!", "#", "the", " The", "é", "漢", "😀", "\xa0",
    "<|endoftext|>", "<|end", "\t", "ing", "ß", "𝕏", "\U0001e5d0", "́", "don't", "   x", "_", "-----", "\r\n", "\x1c",
]


def _read(name):
    with open(P.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(_read("byte_bpe_50k.tiktoken")), special_tokens={}
    )


def _n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_its_own_encoding(library):
    counter, rng = PrefixCounter(_read("byte_bpe_50k.json")), random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert list(counter.counts(text)) == [_n(library, text[: i + 1]) for i in range(len(text))], repr(text)


def test_split_knows_every_code_point_as_the_library_does(encoding, library):
    pre = library.pre_tokenizer
    for c in map(chr, [*range(0, 0x3000, 7), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x10D40, 0x10D90)]):
        text = f"a{c}1{c} {c}.{c}{c} b"
        assert split(text) == [text[i:j] for _, (i, j) in pre.pre_tokenize_str(text)], hex(ord(c))


def test_pieces_encode_as_the_library_does(encoding):
    ranks, rng = read_ranks(_read("byte_bpe_50k.tiktoken")), random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert [i for p in split(text) for i in encode_piece(p.encode(), ranks)] == encoding.encode_ordinary(text)
    assert encode_piece(b"ab" * 5000, ranks) == encoding.encode_ordinary("ab" * 5000)


def test_truncation_takes_the_longest_prefix_that_fits(library, small, spark):
    got = small.select(
        "doc_id", "text", token_counts.token_counts(spark, F.col("text"), P.path("byte_bpe_50k.json"), 7).alias("t")
    ).collect()
    assert len(got) == 12
    for r in got:
        text = r["text"] or ""
        assert r["t"]["n_tokens"] == _n(library, text) and r["t"]["n_bytes"] == len(text.encode())
        assert r["t"]["over_limit"] == (r["t"]["n_tokens"] > 7)
        if len(text) < 500:
            fitting = [i for i in range(len(text) + 1) if _n(library, text[:i]) <= 7]
            assert r["t"]["fit_chars"] == max(fitting)


def test_encoding_and_decoding_of_odd_rows(small, spark, encoding):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(small, path), path).collect()
    want = [(r["doc_id"], encoding.encode_ordinary(r["text"] or ""), r["text"] or "") for r in small.collect()]
    plain = lambda rows: sorted(rows, key=repr)
    assert plain((r["doc_id"], list(r["ids"]), bytes(r["decoded"]).decode()) for r in got) == plain(want)


def test_blocks_may_be_small_and_tables_empty(small, spark, encoding, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(small.filter("doc_id < 8"), path).collect()}
    want = {r["doc_id"]: encoding.encode_ordinary(r["text"] or "") for r in small.filter("doc_id < 8").collect()}
    assert got == want
    assert bpe.encode(small.filter("false"), path).count() == 0


def test_digests_are_those_of_the_query(spark, encoding):
    from shelfmark.llm import queries

    got = queries.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    told = lambda data: hashlib.sha256(data.encode()).hexdigest()
    want = []
    for r in docs:
        ids = encoding.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), told(" ".join(map(str, ids))), told(r["text"] or "")))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("words, size, some", [(1, 10**9, 1), (10**9, 40, 7), (500, 10**9, 20)])
def test_blocks_and_ranges_change_nothing(small, spark, encoding, monkeypatch, words, size, some):
    for name, value in (("BLOCK_WORDS", words), ("BLOCK_BYTES", size), ("RANGE_WORDS", some)):
        monkeypatch.setattr(bpe, name, value)
    docs = small.filter("doc_id is null or doc_id <> 8").unionByName(small.limit(2)).repartition(2)
    got = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), into="text").collect()
    want = [(r["doc_id"], encoding.encode_ordinary(r["text"] or ""), r["text"] or "") for r in docs.collect()]
    plain = lambda rows: sorted(rows, key=repr)
    assert plain((r["doc_id"], list(r["ids"]), bytes(r["text"]).decode()) for r in got) == plain(want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bpe_")]
