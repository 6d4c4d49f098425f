import numpy as np
import pandas as pd
import pytest

from tokenmill.operators import profile


def _lens(spark, values):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "doc_id long, len long")


def test_length_summary_matches_pandas(spark):
    rng = np.random.default_rng(0)
    vals = rng.integers(0, 500, 301).tolist() + [4000, 5000]
    r = profile.length_summary(_lens(spark, vals)).collect()[0]
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    assert r.range == s.max() - s.min()
    assert r.mean == round(s.mean()) and r.std == round(s.std())
    assert (r.median, r.q1, r.q3, r.iqr) == (s.median(), q1, q3, iqr)
    assert r.n_outliers == int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())
    assert r.band_hi2 == r.mean + 2 * r.std


@pytest.mark.parametrize("vals", [[7, 7, 7], [5], list(range(0, 1000, 3)) + [999], [1, 2, 2, 3, 10, 10]])
def test_histogram_matches_numpy(spark, vals):
    h = sorted(profile.length_histogram(_lens(spark, vals)).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(vals, bins=100)
    assert [r.n for r in h] == counts.tolist()
    assert np.allclose([r.lo for r in h], edges[:-1])


def test_footprint_truncates_gib(spark):
    df = spark.createDataFrame([("é" * 10, [1, 2, 3])], "text string, ids array<int>")
    r = profile.corpus_footprint(df).collect()[0]
    assert (r.text_bytes, r.id_bytes, r.text_gib) == (20, 12, 0)


def test_epoch_metrics_weighted(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 0, 3.0, 1.0), (1, 1, 5.0, 1.0)], "run int, epoch int, v double, w double")
    got = {r.epoch: r.v for r in profile.epoch_metrics(df, ["v"], weight="w").collect()}
    assert got == {0: (1.0 * 2 + 3.0) / 3, 1: 5.0}
