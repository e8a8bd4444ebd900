import hashlib
import random

import numpy as np
import pytest

from segstat.llm import suffix_dedup
from segstat.llm.anchors import window_minimum
from segstat.llm.suffix_sort import classes_at, common_prefix, sort_group, sorted_classes


def test_window_minimum():
    values = np.random.default_rng(0).integers(0, 50, 203).astype(np.uint64)
    for width in (1, 2, 7, 64, 203, 204):
        assert window_minimum(values, width).tolist() == [values[i:i + width].min() for i in range(len(values) - width + 1)]


def strings(rng, n):
    base = bytes(rng.choice(b"ab") for _ in range(60))
    out = []
    for _ in range(n):
        x = bytearray(base[:rng.randrange(61)])
        if x and rng.random() < 0.7:
            x[rng.randrange(len(x))] = rng.choice(b"abc")
        out.append(bytes(x))
    return out


@pytest.mark.parametrize("shallow", [0, 4, 16, 100])
def test_sorting_and_classes(shallow):
    rng = random.Random(shallow)
    for _ in range(150):
        s = strings(rng, rng.randrange(1, 25))
        assert sort_group(s, list(range(len(s))), shallow) == sorted(range(len(s)), key=s.__getitem__)
        groups = np.sort(np.array([rng.randrange(3) for _ in s]))
        order, prefix = sorted_classes(s, groups, shallow)
        for length in (1, 5, 30):
            at = classes_at(order, prefix, length)
            for i in range(len(s)):
                for j in range(i):
                    if len(s[i]) >= length and len(s[j]) >= length:
                        assert (at[i] == at[j]) == (groups[i] == groups[j] and common_prefix(s[i], s[j]) >= length)


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(100, 100_000), (40, 100_000), (40, 3)])
def test_every_repeated_byte_goes(spark, length, hot):
    rng = random.Random(5)
    blocks = ["".join(rng.choice("ab ") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(blocks) if rng.random() < 0.8 else rng.choice("abcé\n") for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(300, "a" * 500), (301, "a" * 230), (302, None), (303, ""), (304, "é" * 300), (305, "abc" * 100), (306, "xabc" * 2 + "abc" * 70)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_bytes int, key string").repartition(5)
    found = suffix_dedup.dedup_stretches(docs, ["doc_id", "n_bytes", "key"], length=length, hot=hot)
    assert found.columns == ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()} == brute(rows, length)


def test_equal_rows_and_missing_ids(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(360))
    rows = [(5, text), (5, text), (None, text[:150]), (6, text)]
    found = suffix_dedup.dedup_stretches(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], length=100, with_text=True).collect()
    by_id = sorted((r["doc_id"] or 0, bytes(r["kept_bytes"]).decode()) for r in found)
    assert by_id[0] == (0, text[:150]) and by_id[1] == by_id[2] == (5, text[150:]) and by_id[3] == (6, "")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup_stretches(empty, ["doc_id"]).collect() == []
