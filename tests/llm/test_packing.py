import random
import zlib

import numpy as np
import pytest

from segstat.llm import packing
from segstat.llm.queries import tokenizer_path


def check_layout(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_words_are_encoded_as_whole_texts(monkeypatch):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcÀÉ',.’sStIİΣß 1½\ńé<|endoftext|>日ª ") for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["", "it's.", "don't,", "a.,", "É.", "<|endoftext|>."]
    monkeypatch.setattr(packing, "_CACHE_WORDS", 300)
    packing._tokenizers.clear()
    for i in range(0, len(texts), 100):
        for t, ids in zip(texts[i:i + 100], packing.token_bytes(texts[i:i + 100], path)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    packing._tokenizers.clear()


def test_documents(spark, small):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "a b"), (902, "a b"), (None, "c"), (903, "long words " * 9000)], "doc_id long, text string")
    docs = docs.unionByName(odd).selectExpr("*", "'x' AS piece", "7 AS offset", "1 AS uid")
    length = 512
    found = packing.pack_documents(docs, path, ["doc_id", "piece", "offset"], length=length, shard_pieces=40).collect()
    want = []
    for r in docs.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], k, k * length, len(c), zlib.crc32(np.array(c, "<u4").tobytes()))
                 for k, c in enumerate(ids[i:i + length] for i in range(0, len(ids), length))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found], key=key) == sorted(want, key=key)
    total = sum(w[3] for w in want)
    assert check_layout(found, length) <= -(-total // length) + 2
    assert packing.pack_documents(docs.limit(0), path, ["doc_id"]).collect() == []


def test_many_shards_lose_nothing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 7, 40, 99, 100, rng.randrange(1, 101)]) for _ in range(700)]
    cut = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "uid long, length long")
    found = packing.pack(cut, 100, 60).collect()
    assert sorted(r["uid"] for r in found) == list(range(700))
    whole = packing.best_fit(sizes, 100, [], sorted(range(700), key=sizes.__getitem__, reverse=True))
    assert check_layout(found, 100) <= len(whole) + 3


@pytest.mark.parametrize("seed", range(5))
def test_genetic_steps_keep_every_item(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(80)]
    a, b = (packing.start(sizes, 60, rng, noise) for noise in (0.0, 0.4))
    for bins in (a, b, packing.crossover(sizes, 60, a, b, rng), packing.mutate(sizes, 60, a, rng), *packing.evolve(sizes, 60, [a, b, b], 10, rng)):
        assert sorted(i for x in bins for i in x) == list(range(80)) and all(sum(sizes[i] for i in x) <= 60 for x in bins)
        assert packing._decode(packing._encode(bins, 80)) == [sorted(x) for x in bins]
    assert len(packing.evolve(sizes, 60, [a, b], 20, rng)[0]) <= len(a)
