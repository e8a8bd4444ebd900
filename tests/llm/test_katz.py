import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from segstat.llm import katz
from segstat.llm.bytescan import U, mix

TEXTS = ["the cat sat on the mat", "The cat sat", "a b a b a b c", "", None, "x", "the the the the", "cat sat on  the\tmat and ate",
         "é É the mat", "on the mat the cat sat on the mat"]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</end>"]


def hashes(words):
    found, _, _ = katz._tokens(pa.array([" ".join(words)]))
    return dict(zip(words, found[:-1])) | {"</end>": katz.END, "<begin>": katz.BEGIN}


def brute(rows, buckets):
    """The model by dictionaries; only the bucket of a pair is taken from the operator."""
    docs = [(i, tokens(t), i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    uni = Counter(w for _, ws, out in docs if not out for w in ws)
    total, types = sum(uni.values()), len(uni)
    code = hashes(sorted({w for _, ws, _ in docs for w in ws} - {"</end>"}))
    pairs, contexts = Counter(), Counter()
    for _, ws, out in docs:
        if not out:
            for v, w in zip(["<begin>", *ws], ws):
                pairs[v, w] += 1
                contexts[v] += 1
    n_r = np.bincount(np.minimum(list(uni.values()) or [0], katz.TOP + 2), minlength=katz.TOP + 3).astype(float)
    n_r[0] = 0
    small = katz.discounted(n_r)
    disc = lambda s, r: float(katz.apply_discount(s, np.array([r]))[0])
    p1 = {w: disc(small, c) / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if total else 1.0
    frequent = {w for w, c in uni.items() if c * katz.FREQUENT >= total} | {"</end>"}

    def bucket(v, w):
        with np.errstate(over="ignore"):
            return int((mix(np.array([code[w] + U(3) * code[v]]))[0] if w in frequent else code[w]) % U(buckets))

    classes = defaultdict(list)
    for (v, w), c in pairs.items():
        classes[bucket(v, w)].append(c)
    smalls = {b: katz.discounted(np.bincount(np.minimum(c, katz.TOP + 2), minlength=katz.TOP + 3).astype(float)) for b, c in classes.items()}
    after = defaultdict(dict)
    for (v, w), c in pairs.items():
        after[v][w] = disc(smalls[bucket(v, w)], c) / contexts[v]

    def probability(v, w):
        if w in after[v]:
            return after[v][w]
        alpha = (1 - sum(after[v].values())) / (1 - sum(p1[x] for x in after[v])) if after[v] else 1.0
        return alpha * p1.get(w, unknown)

    for v in list(after):                # the words and the unknown word make up one
        assert math.isclose(sum(probability(v, w) for w in [*uni, None]), 1.0, rel_tol=1e-9)
    out = []
    for i, ws, held in docs:
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in ws)
        out.append((i, held, len(ws), sum(w in uni for w in ws), total, base,
                    sum(math.log10(probability(v, w)) for v, w in zip(["<begin>", *ws], ws))))
    return out


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:5] == b[:5], (a, b)
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9), (a, b)


@pytest.mark.parametrize("frequent", [1000, 8])
def test_matches_dictionaries(spark, monkeypatch, frequent):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else (TEXTS[i % len(TEXTS)] or "") + f" w{i % 5} w{i % 11}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(katz.score(docs, buckets=5).collect(), brute(rows, 5))


def test_repeated_rows_missing_ids_and_extra_columns(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a c"), (None, None), (9, "b b b")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, score int, slab string").repartition(2)
    same(katz.score(docs, buckets=3).collect(), brute(rows, 3))


def test_no_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in katz.score(docs).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert katz.score(docs.limit(0)).collect() == []


def test_pooled_discounts_do_not_depend_on_buckets(spark, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else (TEXTS[i % len(TEXTS)] or "") + f" w{i % 5} w{i % 11}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = brute(rows, 1)               # one bucket holds all pairs
    assert any(abs(a[6] - b[6]) > 0.01 for a, b in zip(whole, brute(rows, 5)))
    for buckets in (1, 5, 64):
        same(katz.score(docs, buckets=buckets, pooled=True).collect(), whole)
    monkeypatch.setattr(katz, "FREQUENT", 8)
    same(katz.score(docs, buckets=7, pooled=True).collect(), brute(rows, 1))


def test_query_pools_discounts(spark, small):
    from segstat.llm.queries import op3_katz_backoff
    from segstat.llm.tables import read
    found = op3_katz_backoff(spark, small).collect()
    same(found, [tuple(r) for r in katz.score(read(spark, small, "documents"), buckets=3, pooled=True).collect()])
