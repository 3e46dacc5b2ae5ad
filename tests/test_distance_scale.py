"""Distances whose blocks are packed small, added in narrow numbers, and reduced or set beside each other without a pair being written."""
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import monotone
from quadrat.operators import community as K
from quadrat.operators import permutation as P
from quadrat.plans.registry import Tables, rounded

rng = np.random.default_rng(11)


def cells_of(spark, m, kind="double"):
    rows = [(int(i), f"t{j}", m[i, j].item()) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, f"sample_id long, taxon_id string, count {kind}")


def bray(x, y):
    return abs(x - y).sum() / (x + y).sum()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Paths of the tables that ``community`` stores, and a function that gives their bytes."""
    paths, keep = [], K.stored

    def stored(*args):
        out = keep(*args)
        paths.append(Path(out.stored_at.removeprefix("file:")))
        return out

    monkeypatch.setattr(K, "stored", stored)
    return lambda: sum(f.stat().st_size for p in paths for f in p.rglob("*.parquet"))


def test_tables_between_steps_are_small_beside_the_input(spark, written):
    vectors = spark.range(2000).select("id", F.array(*[F.rand(k).cast("float") for k in range(64)]).alias("v"))
    long = vectors.select("id", F.posexplode("v").alias("axis", "x"))
    K.euclidean(long, "id", "axis", "x")
    assert written() < 3 * 4 * 64 * 2000  # input has 4 bytes per number


@pytest.mark.parametrize("scale", [1, 600, 10 ** 8, 0.37])
def test_narrow_sums_are_exact(spark, scale):
    m = rng.integers(1, 200, (9, 40)) * float(scale)
    m[0] *= 1000  # its values are above every other sample's total
    for r in K.bray_curtis(cells_of(spark, m)).collect():
        assert r.d == pytest.approx(bray(m[r.id_a], m[r.id_b]), abs=1e-12)


def test_repeated_cells_add_up_and_null_taxa_are_one(spark):
    rows = [(1, "a", 2.0), (1, "a", 1.0), (1, None, 4.0), (2, "a", 3.0), (2, None, 1.0), (2, "c", None), (3, "c", 5.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "sample_id long, taxon_id string, count double").repartition(5)
    got = {(r.id_a, r.id_b): r.d for r in K.bray_curtis(df).collect()}
    assert len(got) == 6 and got[1, 2] == pytest.approx(1 - 2 * 4 / 11) and got[1, 3] == 1
    empty = spark.createDataFrame([(1, 5, 0.0), (2, 6, 0.0), (3, 5, 1.0)], "sample_id long, taxon_id long, count double")
    assert {r[:2]: r.d for r in K.bray_curtis(empty).collect()} == {(1, 2): None, (1, 3): 1.0, (2, 3): 1.0}


def test_line_items_are_shuffled_once_for_the_join_and_once_for_the_sum(spark):
    t = Tables(spark, "none")
    t.__dict__.update(parts=5, part=spark.createDataFrame([(1, "b", "x"), (2, "b", "x"), (3, "c", "y")], "p_partkey long, p_brand string, p_type string"),
                      lineitem=spark.createDataFrame([(7, 1, 2.0), (7, 2, 3.0), (8, 3, 4.0), (8, 3, 1.0), (9, 4, 1.0)], "l_suppkey long, l_partkey long, l_quantity double"))
    counts = t.counts()
    assert sorted(map(tuple, counts.collect())) == [(7, "b_x", 5), (8, "c_y", 5)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_rounding_equals_sparks(spark):
    values = [0.0, -0.0, 1 / 1024, 3 / 1024, -1 / 1024, 0.5, 2.5e-9, 1.0000000005, 123456789.123456789, 1e30, -7e-10, math.pi, float("nan"), float("inf"), None]
    values += [float(v) for v in rng.random(3000)] + [(2 * int(k) + 1) / 2 ** 11 for k in rng.integers(0, 1000, 300)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = rounded(df.withColumn("e", F.col("d")), 9, "e").select("d", "e", (F.round("d", 9) + F.lit(0.0)).alias("want")).collect()
    assert "round(" in plan_of(rounded(df, 9, "d")) and "rint(" in plan_of(rounded(df, 9, "d")).lower()
    assert all(repr(r.e) == repr(r.want) for r in got)


def test_two_sets_side_by_side_write_no_pairs(spark):
    m, w = rng.poisson(3, (14, 8)) + 1.0, rng.random((16, 3)) + 1
    first = K.bray_curtis(cells_of(spark, m))
    second = K.euclidean(cells_of(spark, np.vstack([np.zeros((2, 3)), w[2:]])))  # samples 2 to 15
    joined = K.dist_pairs_join(first, second)
    assert "Join Inner, (id_a" not in plan_of(joined) and "CartesianProduct" in plan_of(joined)
    rows = joined.collect()
    assert joined.columns == ["id_a", "id_b", "d1", "d2"] and len(rows) == 12 * 11 // 2
    for r in rows:
        assert r.d1 == pytest.approx(bray(m[r.id_a], m[r.id_b])) and r.d2 == pytest.approx(np.linalg.norm(w[r.id_a] - w[r.id_b]))


@pytest.mark.parametrize("block", [5, 1024])
def test_mantel_of_cells_equals_mantel_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    m, w = rng.poisson(3, (14, 8)) + 1.0, rng.random((15, 3)) * 10 + 1
    w[1:] += 1e6  # gaps are small beside the points themselves
    w[3] = w[4]
    first, second = K.bray_curtis(cells_of(spark, m)), K.euclidean(cells_of(spark, w))
    with monkeypatch.context() as held:
        held.setattr(P, "_stripes", None)  # matrices of pairs
        got = P.mantel(first, second, perms=49).first()
    want = P.mantel(first.select("*"), second.select("*"), perms=49).first()
    assert got.r == pytest.approx(want.r, abs=1e-10) and (got.p, got.n_pairs) == (want.p, want.n_pairs) and got.n_pairs == 91
    none = K.bray_curtis(spark.createDataFrame([(k, "a", float(k > 2)) for k in range(1, 6)], "sample_id long, taxon_id string, count double"))
    with pytest.raises(Exception, match="need both distances"):
        P.mantel(none, second, perms=9).collect()


@pytest.mark.parametrize("cells", [1, 3])
def test_tile_sums_of_labels(cells):
    squares, low, high = rng.random((7, 5)), rng.integers(0, cells, (11, 7)), rng.integers(0, cells, (11, 5))
    got = P._tile_sums(squares, low.astype(np.uint8), high.astype(np.uint8), cells)
    for k in range(11):
        for a in range(cells):
            for b in range(cells):
                assert got[k, a, b] == pytest.approx(squares[np.ix_(low[k] == a, high[k] == b)].sum())


def test_labels_are_packed_in_less_than_a_byte(spark):
    n, perms = 300, 99
    samples = spark.range(n).select(F.lit(0).alias("set"), F.col("id").alias("_no"), F.lit(n).cast("long").alias("_n"), (F.col("id") % 2).cast("int").alias("_cell"))
    rows = P._label_blocks(samples, perms, 1, 128).collect()
    assert len(rows) == 3 and sum(len(r.labels) for r in rows) < n * (perms + 1)
    found = np.concatenate([P.released(r.labels).reshape(perms + 1, 128) for r in sorted(rows, key=lambda r: r.block)], axis=1)[:, :n]
    assert (found[0] == np.arange(n) % 2).all() and (found.sum(axis=1) == n // 2).all()


def test_bins_of_ordered_values(spark, monkeypatch):
    monkeypatch.setattr(monotone, "_located", None)  # no value looks up its bin
    x, y = rng.integers(0, 50, 500) / 10, rng.random(500)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    edges, wanted = np.array([-np.inf, 0.5, 1.0, 1.01, 3.0, 4.9, 7.0]), np.array([True, True, False, True, True, True, True])
    got = monotone.count_bins(rows, edges, wanted)
    cell = np.searchsorted(edges, x, "right") - 1
    assert sorted(got["bin"]) == [0, 1, 3, 4, 5]  # bin 2 is not wanted, the last one is empty
    for k, *values in zip(*(got[c] for c in ("bin", "w", "s", "lo", "hi"))):
        here = cell == k
        assert values == pytest.approx([here.sum(), y[here].sum(), x[here].min(), x[here].max()])
    seen = wanted[cell]
    assert got["low"].min() == y[seen].min() and got["high"].max() == y[seen].max()
