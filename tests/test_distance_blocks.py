"""Distances whose blocks meet in a Cartesian product, and operators that reduce them without writing a pair."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import community as K
from quadrat.operators import permutation as P

rng = np.random.default_rng(5)


def cells_of(spark, m, kind="double"):
    rows = [(int(i), f"t{j}" if j else None, m[i, j].item()) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, f"sample_id long, taxon_id string, count {kind}")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("share", [0.03, 0.9])
def test_sparse_and_dense_tiles(spark, share):
    m = rng.integers(1, 9, (30, 90)) * (rng.random((30, 90)) < share)
    m[m.sum(1) == 0, 1] = 1
    df = cells_of(spark, m.astype(float))  # one taxon has no name
    for sizes in ((None, 16_384), (7, 3)):
        bray = K.bray_curtis(df, block_samples=sizes[0], chunk_taxa=sizes[1]).collect()
        euclid = {r[:2]: r.d for r in K.euclidean(df, block_samples=sizes[0], chunk_taxa=sizes[1]).collect()}
        assert len(bray) == len(euclid) == 435
        for r in bray:
            x, y = m[r.id_a].astype(float), m[r.id_b].astype(float)
            assert r.id_a < r.id_b and r.d == pytest.approx(abs(x - y).sum() / (x + y).sum(), abs=1e-12)
            assert euclid[r[:2]] == pytest.approx(np.linalg.norm(x - y))


def test_a_block_is_not_sent_once_for_every_other_block(spark):
    df = spark.range(400).select(F.col("id").alias("sample_id"), F.explode(F.array(*[F.lit(f"t{k}") for k in range(5)])).alias("taxon_id"),
                                 (F.col("id") % 7 + 1).alias("count"))
    for pairs in (K.bray_curtis(df, block_samples=10), K.euclidean(df, block_samples=10)):
        plan = plan_of(pairs)
        assert "CartesianProduct" in plan and "Generate" not in plan and pairs.count() == 400 * 399 // 2


def test_permutation_tests_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 6)
    m = rng.poisson(3, (14, 8)) + 1.0
    design = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(14)], "sample_id long, g string")
    pairs = K.bray_curtis(cells_of(spark, m))
    got = P.permanova(pairs, design, ["g"], 9)
    assert "CartesianProduct" in plan_of(got) and "FlatMapCoGroups" not in plan_of(got)
    d = np.array([[abs(x - y).sum() / (x + y).sum() for y in m] for x in m]) ** 2
    total, within = d.sum() / 28, sum(d[k::2, k::2].sum() / 14 for k in (0, 1))
    rows = {r.term: r for r in got.collect()}
    assert rows["g"].pseudo_f == pytest.approx((total - within) / (within / 12)) and rows["Total"].ss == pytest.approx(total)
    more = design.union(spark.createDataFrame([(77, "a")], design.schema))
    with pytest.raises(Exception, match="need one known distance"):
        P.permanova(pairs, more, ["g"], 9).collect()


def test_pair_sets_are_not_broadcast(spark):
    df = cells_of(spark, rng.poisson(3, (12, 8)) + 1.0)
    joined = K.dist_pairs_join(K.bray_curtis(df), K.euclidean(df))
    assert "BroadcastHashJoin" not in plan_of(joined) and joined.count() == 66
