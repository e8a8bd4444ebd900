import math
import random

import pytest
from pyspark.sql import functions as F

from segstat.llm import hard_negatives


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (anchor, label, v) in enumerate(own):
        if not is_anchor(anchor):
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), i is not None, i or 0, k) for k, (i, _, w) in enumerate(own) if k != at)
        name = lambda r: own[r[3]][0]
        for p in [r for r in ranked if own[r[3]][1] == label][:positives]:
            fit = [n for n in ranked if own[n[3]][1] != label and low * -p[0] <= 100 * -n[0] <= high * -p[0]]
            out += [(anchor, name(p), r + 1, name(n), -p[0], -n[0]) for r, n in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, mod, parts=3, **options):
    table = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, uid int, score int").repartition(parts)
    found = hard_negatives.mine(table, F.col("vec_id") % mod == 0, **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(seed, n, dim=6, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 1.0]) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 3)])
def test_equals_all_pairs(spark, monkeypatch, blocks):
    """Coarse components make many ties and zero scores."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    rows = vectors(1, 150) + [(7001, [0.1, None], 1), (7002, None, 1), (7003, [float("nan")], 1), (7004, [float("inf"), 1.0], 1), (7005, [1.0], None),
                              (None, [1.0] * 6, 1), (7010, [], 0), (7020, [0.5, 0.5], 2), (7030, [0.5] * 9, 2)]
    assert mined(spark, rows, 10) == plain(rows, lambda i: i is not None and i % 10 == 0)


def test_repeated_rows_and_one_common_vector(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(120)] + [(0, [0.5, 0.25], 0), (0, [0.5, 0.25], 0), (5, [0.25, 0.25], 1)]
    rows += [(200 + i, [0.25 + i / 512, 0.0], i % 2) for i in range(60)]
    assert mined(spark, rows, 40) == plain(rows, lambda i: i % 40 == 0)


def test_zero_scores_before_and_after_their_positive(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [0.0, 0.5], 0), (3, [0.0, 0.25], 1), (4, [-1.0, 0.0], 0)]
    want = plain(rows, lambda i: i == 0)
    assert [r[1:4] for r in want] == [(2, 1, 1), (2, 2, 3)] and mined(spark, rows, 100) == want


def test_other_limits(spark):
    rows = vectors(3, 90, labels=2)
    options = {"positives": 2, "negatives": 3, "low": 0, "high": 100}
    assert mined(spark, rows, 9, **options) == plain(rows, lambda i: i % 9 == 0, **options)
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.lit(True), high=110)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2 ** 20 + i), 3.0], i % 2) for i in range(40)]
    assert mined(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, vectors(1, 3), 1000)[:0] == [] and mined(spark, [(1, [0.5], 0), (2, [0.5], 0)], 100) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
