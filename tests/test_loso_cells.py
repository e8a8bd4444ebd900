"""Leave-one-site-out fits read counts of equal rows, however many rows there are."""
import numpy as np

from segstat.operators import joint_logistic as J, models as T


def test_counted_rows_fit_as_repeated_ones(spark):
    points = [([0.1, None], 1, 3), ([0.4, 2.0], 0, 5), ([0.9, 1.0], 1, 4), ([0.2, 7.0], 0, 2), ([0.7, 3.0], 1, 1)]
    schema = "x array<double>, target int, use array<int>, weight array<bigint>"
    counted = spark.createDataFrame([(x, y, [0, 1], [n, 1]) for x, y, n in points], schema)
    repeated = spark.createDataFrame([(x, y, [0], [1]) for x, y, n in points for _ in range(n)] + [(x, y, [1], [1]) for x, y, _ in points], schema)
    for a, b in zip(J.fit(counted, [[0, 1], [0, 1]], weight="weight"), J.fit(repeated, [[0, 1], [0, 1]])):
        assert (a.rows, a.positives) == (b.rows, b.positives) and np.allclose(a.fill, b.fill)
        assert np.allclose([*a.weights, a.intercept], [*b.weights, b.intercept], atol=1e-9)


def test_fits_read_distinct_values_not_rows(spark, monkeypatch):
    rows = [(r, c, c % 3, (c + r) % 2, r % 4 / 4) for c in range(60) for r in range(30)]
    read, fit = [], J.fit
    monkeypatch.setattr(J, "fit", lambda frame, *a, **k: read.append(frame.count()) or fit(frame, *a, **k))
    _, plan = T.loso_scores(spark.createDataFrame(rows, "record_id bigint, cluster_id bigint, site int, target int, m1 double"), ["m1"])
    assert plan.where("status = 'ok'").count() == 3
    assert len(read) == 2 and max(read) <= 3 * 2 * 4
