import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from segstat.llm import bytescan, lexical_nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Every score of every document."""
    cut = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    cut = [(i, ts) for i, ts in cut if ts]
    n, length = len(cut), sum(len(ts) for _, ts in cut)
    df = {}
    for _, ts in cut:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for at, (i, ts) in enumerate(cut):
            m = 100 - 75 + (75 * len(ts) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 8 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in df)
            if score > 0:
                scored.append((-score, i is not None, i or 0, at))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int").repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, query int")
    rows = lexical_nra.search(d, b, **options).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


def corpus(seed, n, words="the and of cat Dog é日 x1 É rare odd one two three four five six seven".split()):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(int(rng.paretovariate(1)) * 3))) for i in range(n)]


@pytest.mark.parametrize("segment,block_terms", [(10**6, 10**6), (150, 40)])
def test_equals_every_score(spark, segment, block_terms):
    docs = corpus(1, 300) + [(500, None), (501, ""), (502, "?!"), (None, "the cat"), (3, "the cat"), (3, "the cat"), (600, "long " * 40_000 + "rare")]
    items = [(i, t) for i, t in corpus(2, 12)] + [(7, "the the cat"), (7, "the the cat"), (None, "rare odd"), (40, None), (41, "unknownword"), (42, "ÉÉ é日 DOG")]
    assert found(spark, docs, items, segment=segment, block_terms=block_terms) == plain(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(i, f"other{i}") for i in range(1000, 1900)]
    items = [(1, "same words"), (2, "other1500 here")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, "a")], [(1, None)]) == []


def test_reads_stop_before_the_end_of_the_lists():
    """A clear winner is settled without reading long lists to the end."""
    rng = np.random.default_rng(1)
    docs, size = 50_000, 40_000
    owners = np.concatenate([rng.permutation(docs)[:size] for _ in range(3)])
    terms = np.repeat(np.arange(3), size)
    impacts = rng.integers(1, 1000, 3 * size)
    impacts[[5, size + 5, 2 * size + 5]] = 10**6
    owners[[5, size + 5, 2 * size + 5]] = 17
    keep = np.ones(3 * size, bool)
    for t in range(3):
        same = np.flatnonzero((owners == 17) & (terms == t))
        keep[same[same != t * size + 5]] = False
    reader = lexical_nra.Reader(docs, terms[keep], owners[keep], impacts[keep])
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return super().__getitem__(key)

    reader.owners = reader.owners.view(Counted)
    top, scores = reader.top([(0, 1), (1, 1), (2, 1)], 1, 1)
    assert top.tolist() == [17] and scores.tolist() == [3 * 10**6] and sum(reads) < size


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bytescan.Scan, "hashes", lambda self, starts, ends: np.full(len(starts), 9, np.uint64))
    terms = lexical_nra.Terms([b"one", b"two", b"six"])
    scan, starts, ends = lexical_nra._scan(pa.array(["two ten One six"]))
    assert terms.find(scan, starts, ends).tolist() == [1, -1, 0, 2]
