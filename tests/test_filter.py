"""The filter on the mean before p values are adjusted, and the histogram by number of bins."""
import numpy as np
import pandas as pd
import pytest

from quadrat.operators import abundance as A
from quadrat.operators import summary as S
from quadrat.session import cut_lineage


def test_smoothing_keeps_lines_and_resists_outliers():
    x = np.linspace(0, 0.95, 50)
    assert np.allclose(A.smoothed(x, 3 * x + 1), 3 * x + 1)
    y = 100 - 40 * (x - 0.4) ** 2
    bent = y.copy()
    bent[20] += 500
    assert np.abs(A.smoothed(x, bent) - y).max() < 3


def test_chosen_cut():
    theta = np.linspace(0, 0.95, 50)
    assert A.chosen_cut(theta, np.full(50, 10)) == 0
    rising = np.round(60 - 50 * np.abs(theta - 0.5)).astype(int)
    k = A.chosen_cut(theta, rising)
    assert 0 < k < 30 and rising[k] >= rising.max() - 4


def adjusted(p):
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    return out


def test_filter_equals_trying_every_cut(spark):
    rng = np.random.default_rng(11)
    frames = []
    for contrast, n in (("a", 400), ("b", 60)):
        mean = np.round(rng.gamma(0.6, 30, n), 3)
        mean[: n // 10] = 0
        p = np.where((mean > 20) & (rng.random(n) < 0.5), rng.random(n) * 1e-3, rng.random(n))
        frames.append(pd.DataFrame({"contrast": contrast, "taxon_id": [f"{contrast}{i}" for i in range(n)], "base_mean": mean, "p": p}))
    results = cut_lineage(spark.createDataFrame(pd.concat(frames)))
    got = A.independent_filter(results).toPandas().set_index("taxon_id")["padj"]
    assert len(got) == 460
    for frame in frames:
        mean, p = frame["base_mean"].to_numpy(), frame["p"].to_numpy()
        theta = np.linspace((mean == 0).mean(), 0.95, 50)
        cuts = np.quantile(mean, theta)
        wins = np.array([(adjusted(p[mean >= c]) < 0.05).sum() for c in cuts])
        cut = cuts[A.chosen_cut(theta, wins)]
        want = np.full(len(p), np.nan)
        want[mean >= cut] = adjusted(p[mean >= cut])
        assert np.allclose(got[frame["taxon_id"]].to_numpy(float), want, equal_nan=True)


def test_histogram_by_number_of_bins(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=500)
    rows = [("g", float(v)) for v in x] + [("one", 3.0)] * 4 + [("g", None)]
    got = S.histogram_bins(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 10).collect()
    assert [(r.bin_low, r.bin_high, r.n) for r in got if r.g == "one"] == [(3.0, 3.0, 4)]
    w = (x.max() - x.min()) / 9
    counts = np.histogram(x, x.min() + (np.arange(11) - 0.5) * w)[0]
    found = {round((r.bin_low - x.min()) / w + 0.5): r.n for r in got if r.g == "g"}
    assert found == {k: c for k, c in enumerate(counts) if c}
    with pytest.raises(ValueError):
        S.histogram_bins(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 1)


def test_coefficients_equal_least_squares(spark):
    from quadrat.operators import models as M

    rng = np.random.default_rng(13)
    a, b = rng.choice(list("xyz"), 90, p=[0.5, 0.3, 0.2]), rng.choice(list("uv"), 90)
    y = rng.normal(size=90) + (a == "y") * 2 - (b == "v") * (a == "z")
    df = spark.createDataFrame([(p, q, float(v)) for p, q, v in zip(a, b, y)] + [("other", "u", 99.0)], "a string, b string, y double")
    levels = {"a": ["x", "y", "z"], "b": ["u", "v"]}
    x = np.array([np.ones(90), a == "y", a == "z", b == "v"], float).T
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / 86)
    got = sorted(M.coefficients(df, [], ["a", "b"], "y", levels, [["a"], ["b"]]).collect(), key=lambda r: r.place)
    assert [r.term for r in got] == ["(Intercept)", "a[y]", "a[z]", "b[v]"]
    assert np.allclose([r.estimate for r in got], beta) and np.allclose([r.se for r in got], se) and all(0 <= r.p <= 1 for r in got)
    full = M.coefficients(df.where("NOT (a = 'z' AND b = 'v')"), [], ["a", "b"], "y", levels).collect()
    assert [r.term for r in full if r.estimate is None] == ["a[z]:b[v]"]  # an empty cell
