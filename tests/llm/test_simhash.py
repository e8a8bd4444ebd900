import random
import re

import numpy as np
import pytest
import xxhash

from segstat.llm import simhash_ball
from segstat.llm.components import components


def brute_print(text, shingle=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, ids, radius=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b\tC  d e É f g", "word " * 500])
def test_fingerprint(text):
    assert simhash_ball.fingerprint((text or "").encode()) == brute_print(text)


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("radius", [4, 5, 3, 1, 0])
def test_links_find_every_class(spark, hot, radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(12):                       # chains and balls around a few centres, and hot halves
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints.append(centre)
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 3)))
    low = rng.getrandbits(32)
    prints += [low | rng.getrandbits(32) << 32 for _ in range(30)]
    prints = list(dict.fromkeys(prints))
    rows = [(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(prints)]
    edges = simhash_ball.links(spark.createDataFrame(rows, "fingerprint long, rep long"), radius, hot)
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_classes(prints, list(range(len(prints))), radius)


def test_documents_with_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(120)
    odd = [(1000, None), (1001, ""), (1002, "ONE two"), (1003, "one TWO"), (1003, "one TWO"), (None, "one two"), (999, " \t ")]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [r for r in both.collect()]
    found = simhash_ball.near_duplicates(both.selectExpr("*", "1 AS fingerprint", "'x' AS rep")).collect()
    assert len(found) == len(rows)
    named = sorted({(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None}, key=lambda r: r[0])
    want = dict(zip([i for i, _ in named], brute_classes([brute_print(t) for _, t in named], [i for i, _ in named])))
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in found)
    assert want[1000] == want[1001] == 999
    assert simhash_ball.near_duplicates(both.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(50, 90)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
