import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from segstat.llm import byte_bpe, bytescan
from segstat.llm.queries import op11_byte_bpe, tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary(path):
    return byte_bpe.load(path)


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encoded(vocabulary, texts):
    ids, counts = vocabulary.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_random_texts_match_the_library(vocabulary, library):
    rng = random.Random(5)
    signs = "ab's'tre vell dm  \n\t　é1½日🎉.,-! \x1c'\x85RELl"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["", " ", "  ", "'", "'s", " 's", "''s", "'re", "'r", "a'", "x'llama", "\n's", "<|endoftext|>", "I'm 'dog' they'Re"]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_kind_of_character(vocabulary, library):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} " for c in [*range(0, 0xD800, 7), *range(0xE000, 0x30000, 11), *range(0xE0000, 0x110000, 997)]]
    assert encoded(vocabulary, texts) == library.encode_ordinary_batch(texts, num_threads=2)


def test_very_long_pretokens(vocabulary, library):
    rng = random.Random(2)
    texts = ["a" * 5000, "".join(rng.choice("abcdefgh") for _ in range(120_000)), " " * 3000 + "x", "x" * 4096 + "'s"]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    found = byte_bpe.PerfectHash(values)
    assert sorted(found.find(values).tolist()) == list(range(len(values)))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([3, 3], np.uint64))
    assert len(byte_bpe.PerfectHash(np.zeros(0, np.uint64)).find(values)) == len(values)


def test_unknown_ids_and_thin_vocabularies_are_errors(vocabulary):
    for ids in ([50256], [-1]):
        with pytest.raises(ValueError):
            vocabulary.decode(np.array(ids))
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0})


def test_equal_ranges():
    a, b = np.frombuffer(b"abcdefghijklmnop", np.uint8), np.frombuffer(b"xabcdefghijkLmnop", np.uint8)
    starts, lengths = np.array([0, 0, 0, 12, 3]), np.array([11, 12, 0, 4, 9])
    assert bytescan.same_bytes(a, starts, b, starts + 1, lengths).tolist() == [True, False, True, True, False]


def test_table_round_trip(spark, path, library, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(900, None, "en", "s", 0), (None, "a", None, None, None), (901, "", "en", "s", 0), (901, "", "en", "s", 0)], docs.schema)
    table = docs.unionByName(odd).selectExpr("*", "'mine' AS ids", "7 AS n_tokens", "1 AS decoded", "2 AS _kept", "3 AS _text")
    found = byte_bpe.decode(byte_bpe.encode(table, path), path)
    assert sorted(found.columns) == sorted(table.columns)
    rows = found.collect()
    assert len(rows) == table.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] * 4 == len(r["ids"]) and bytes(r["decoded"]) == (r["text"] or "").encode() and r["_kept"] == 2
    assert byte_bpe.decode(byte_bpe.encode(table.limit(0), path), path).collect() == []


def test_query_matches_the_library(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op11_byte_bpe(spark, small).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
