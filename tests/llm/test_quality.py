import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segstat.llm import boosted_quality, quality_rules
from segstat.llm.bytescan import scan
from segstat.llm.textstats import base_counts

ODD = ["", " ", "a", "a\n", "\n", "a\n\na\n a", "é é é é é", "x y z x y z", "# | <b>\n# | <b>\n", "a b c\n" * 400, "日本 語 " * 50]


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, repeats = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    windows, marked = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(marked)


def test_counts_match_plain_loops(spark, small):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + ["", "\n\n"]
    counts = base_counts(scan(pa.array(texts)))
    assert [tuple(int(counts[c][i]) for c in quality_rules.BASE) for i in range(len(texts))] == [brute(t) for t in texts]


def tables(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")


def test_rules_on_labelled_rows(spark, small):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels, keep=["doc_id"]).collect()}
    for r in docs.collect():
        f = found[r["doc_id"]]
        want = brute(r["text"])
        assert tuple(f[c] for c in quality_rules.BASE) == want
        assert f["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (f["kept"] and f["base_failed"])
    labelled = {r["doc_id"]: r["quality"] for r in labels.collect()}
    passed = [(found[i]["kept"], q) for i, q in labelled.items() if not found[i]["base_failed"]]
    assert np.mean([k == (q == 1) for k, q in passed]) > 0.97


def test_rules_defined_cases(spark):
    good = "plain words stand in this sentence and more follow until there are enough of them to pass the first rule " * 1
    rows = [(1, None, "x", 3), (None, good, "y", None), (2, "", "z", 1), (3, good * 300, "x", 2), (3, good * 300, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    found = quality_rules.quality_rules(docs, labels)
    assert found.columns[:2] == ["doc_id", "text"] and len(found.columns) == len(set(found.columns)) and found.count() == 5
    by_words = sorted((r["n_words"], r["base_failed"], r["kept"]) for r in found.collect())
    assert by_words[0] == by_words[1] == (0, True, False) and by_words[-1] == by_words[-2]
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).collect() == []


def test_calibration_follows_the_share():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margin - 1)))).astype(float)
    slope, shift = quality_rules._platt(margin, y)
    assert slope == pytest.approx(2, abs=0.2) and shift == pytest.approx(-1, abs=0.2)


def test_trees_separate_held_out_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    found = {r["doc_id"]: r for r in boosted_quality.score_quality(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    held = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 20 and np.mean([p == q for p, q in held]) > 0.95


def test_flat_traversal_matches_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosted_quality.grow(x, y, trees=8, depth=3)
    for row, margin in zip(x[:50], model.margin(x)[:50]):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + int(row[feature[k]] > threshold[k])
            total += leaf[k - len(feature)]
        assert total == pytest.approx(margin)
    assert np.mean((model.score(x) > 0.5) == (y == 1)) > 0.9


def test_trees_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "a b", 1.0), (2, "", 2.0), (2, "", 2.0), (3, "x " * 50_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None)], "doc_id long, quality int")
    found = boosted_quality.score_quality(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 5
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert boosted_quality.score_quality(docs.limit(0), labels.limit(0)).collect() == []


def test_counts_do_not_trust_hashes(monkeypatch):
    """With a hash that only knows lengths, the bytes still decide."""
    from segstat.llm.bytescan import Scan
    monkeypatch.setattr(Scan, "hashes", lambda self, starts, ends: (ends - starts).astype(np.uint64))
    texts = ODD + ["aa bb cc dd ee ff aa bb cc", "abc\nabd\nabc\nxyz", "one two six one two ten one two six"] * 2
    counts = base_counts(scan(pa.array(texts)))
    assert [tuple(int(counts[c][i]) for c in quality_rules.BASE) for i in range(len(texts))] == [brute(t) for t in texts]


def test_a_repeated_id_teaches_once(spark):
    docs = spark.range(20_000).selectExpr("CAST(1 AS bigint) AS doc_id", "concat('text ', id % 7) AS text").unionByName(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(r["_id"] for r in quality_rules.labelled_sample(docs, labels, 10).collect()) == [1, 2]
    found = boosted_quality.score_quality(docs, labels)
    assert found.count() == 20_001
