"""Operators against brute force on small tables, and properties that must hold."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions import tails
from quadrat.functions.grouping import exact_quantiles, number_keys, rank_cells
from quadrat.functions.semantics import mean_of, reference_first, se_of
from quadrat.operators import abundance as A
from quadrat.operators import change as C
from quadrat.operators import community as K
from quadrat.operators import hypothesis as H
from quadrat.operators import models as M
from quadrat.operators import ordination as O
from quadrat.operators import permutation as P
from quadrat.operators import summary as S
from quadrat.operators import wrangle as W
from quadrat.plans import registry
from quadrat.session import cut_lineage
from quadrat.sources.tables import clean_keys, scan_tsv, write_tsv

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds most rows and many copies of one value.
    g = np.where(np.arange(3000) < 2400, "hot", np.where(np.arange(3000) % 2 == 0, "a", "b"))
    x = np.round(rng.gamma(2, 3, 3000), 1)
    x[:900] = 4.0
    return pd.DataFrame({"g": g, "x": x, "k": np.array(["u", "v", "w"])[rng.integers(0, 3, 3000)]})


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows).repartition(4).cache()


@pytest.mark.parametrize("hot_rows", [10, 500_000])
def test_ranks_and_quantiles_do_not_depend_on_the_split(frame, rows, hot_rows):
    got = S.average_ranks(frame, ["g"], "x", hot_rows=hot_rows).toPandas()
    assert len(got) == len(rows)
    want = got.groupby("g")["x"].rank()
    assert np.allclose(got["avg_rank"], want)
    q = exact_quantiles(frame, ["g"], "x", {"a": 0.25, "b": 0.9}, hot_rows).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert np.allclose(q.loc[g, ["a", "b"]].astype(float), part["x"].quantile([0.25, 0.9]))
    if hot_rows == 10:
        assert rank_cells(frame, ["g"], "x", hot_rows=10).agg(F.max("_range")).first()[0] > 0
    whole = S.average_ranks(frame, [], "x", hot_rows=hot_rows).toPandas()
    assert np.allclose(whole["avg_rank"], whole["x"].rank())


@pytest.mark.parametrize("hot_rows", [10, 500_000])
def test_benjamini_hochberg(spark, hot_rows):
    p = np.round(rng.uniform(0, 1, 600) ** 2, 3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(600), "g": ["a"] * 400 + ["b"] * 200, "p": p}))
    got = H.p_adjust(df, ["g"], "p", hot_rows=hot_rows).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("p")
        m = len(part)
        want = np.minimum.accumulate((part["p"] * m / np.arange(1, m + 1)).to_numpy()[::-1])[::-1].clip(max=1)
        order = pd.Series(want, index=part["p"].to_numpy()).groupby(level=0).min()
        assert np.allclose(part["padj"], order.loc[part["p"]])
        assert (part["padj"] >= part["p"] - 1e-12).all() and part["padj"].is_monotonic_increasing


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), (None, 1.0)], "g string, x double")
    got = {r["g"]: r["share"] for r in S.share_of_total(df.filter("x > 0"), ["g"], "x").collect() if r["x"] == 3.0 or r["g"]}
    assert got == {"a": 1.0, None: 0.75}


def test_missing_values_follow_na_rm(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    r = df.agg(mean_of("x").alias("m"), mean_of("x", True).alias("mr"), se_of("x", True).alias("s")).first()
    assert r["m"] is None and r["mr"] == 2.0 and r["s"] == pytest.approx(math.sqrt(2 / 3))
    assert reference_first(["HI", "LO", "NO"], "NO") == ["NO", "HI", "LO"]


def test_percent_change_zero_baseline_and_missing_unit(spark):
    df = spark.createDataFrame([(1, "PRE", 0.0), (1, "24H", 2.0), (2, "24H", 5.0)], "u int, t string, v double")
    got = {r["u"]: r["v"] for r in C.percent_change(df, ["u"], "t", ["PRE", "24H"], "PRE", ["v"]).collect()}
    assert got[1] == pytest.approx((2 - 1e-6) / 1e-6 * 100) and got[2] is None


def test_reader_copes_with_marks_and_keys(spark, tmp_path):
    raw = tmp_path / "lookup.txt"
    raw.write_bytes("﻿Plot\tBlock\r\n 1 \t2\r\nPlot\tB\r\n3\tNULL\r\n".encode())
    kept = clean_keys(scan_tsv(spark, str(raw), "Plot string, Block string"), "Plot").collect()
    assert [(r["Plot"], r["Block"]) for r in kept] == [(1, "2"), (3, None)]


def test_reshape_round_trip(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(5)], "id int, a double, b double")
    long = W.unpivot(df, ["id"], ["a", "b"])
    assert sorted(W.pivot(long, ["id"], "param", ["a", "b"], ["value"]).collect()) == sorted(df.collect())
    full = W.complete_samples(df, spark.range(8).select(F.col("id").cast("int")), "id", ["a", "b"])
    assert full.count() == 8 and full.filter("a IS NULL").count() == 0
    numbers = [r["n"] for r in number_keys(long, "id", "n").collect()]
    assert sorted(numbers) == [1, 2, 3, 4, 5]


# --- tests and models ---------------------------------------------------------------------------------------------

def test_tail_probabilities():
    assert tails.t_sf_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.studentised_range_sf(3.314493, 3) == pytest.approx(0.05, abs=1e-6)
    # Two means: the range is sqrt(2) times |t|.
    for df in (3, 10, 200):
        assert tails.studentised_range_sf(2.5 * math.sqrt(2), 2, df) == pytest.approx(tails.t_sf_two_sided(2.5, df), abs=1e-8)
    assert tails.studentised_range_sf(tails.studentised_range_quantile(0.05, 4, 12), 4, 12) == pytest.approx(0.05, abs=1e-9)
    assert tails.rank_sum_p(0, 3, 3, 0, True) == pytest.approx(0.1)
    assert tails.rank_sum_p(2, 4, 6, 0, True) == pytest.approx(2 * 4 / 210)


def test_shapiro_known_values(spark):
    # A published example: weights of eleven men.
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("m", float(v)) for v in x] + [("c", 1.0)] * 5 + [("two", 1.0), ("two", 2.0)], "g string, x double")
    got = {r["g"]: r for r in H.shapiro(df, ["g"], "x").collect()}
    assert got["m"]["w"] == pytest.approx(0.79, abs=0.005) and got["m"]["p"] == pytest.approx(0.007, abs=0.001)
    assert got["c"]["w"] is None and got["two"]["w"] is None and got["two"]["n"] == 2


@pytest.mark.parametrize("hot_rows", [10, 500_000])
def test_rank_tests(frame, rows, hot_rows):
    got = {r["g"]: r for r in H.kruskal_wallis(frame, ["g"], "k", ["u", "v", "w"], "x", hot_rows=hot_rows).collect()}
    two = {r["g"]: r for r in H.wilcoxon_rank_sum(frame, ["g"], "k", ["u", "v"], "x", exact=False, hot_rows=hot_rows).collect()}
    for g, part in rows.groupby("g"):
        r = part["x"].rank()
        n = len(part)
        h = 12 / (n * (n + 1)) * sum(r[part["k"] == k].sum() ** 2 / (part["k"] == k).sum() for k in "uvw") - 3 * (n + 1)
        t = part["x"].value_counts()
        h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
        assert got[g]["h"] == pytest.approx(h) and got[g]["p"] == pytest.approx(math.exp(-h / 2))
        uv = part[part["k"].isin(["u", "v"])]
        r, n1 = uv["x"].rank(), (uv["k"] == "u").sum()
        assert two[g]["w"] == pytest.approx(r[uv["k"] == "u"].sum() - n1 * (n1 + 1) / 2)


def test_sequential_sums_of_squares_unbalanced(spark):
    n = 200
    pdf = pd.DataFrame({"a": np.array(list("xyz"))[rng.integers(0, 3, n)], "b": np.array(list("pq"))[rng.integers(0, 2, n)], "y": rng.normal(size=n)})
    pdf["y"] += (pdf["a"] == "x") * 1.5
    got = {r["term"]: r for r in M.anova(spark.createDataFrame(pdf).withColumn("m", F.lit(1)), ["m"], ["a", "b"], "y").collect()}

    def rss(columns):
        x = np.column_stack([np.ones(n), *columns]).astype(float)
        fit = x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
        return ((pdf["y"] - fit) ** 2).sum()

    a = [pdf["a"] == v for v in "xy"]
    b = [pdf["b"] == "p"]
    models = [[], a, a + b, a + b + [i & b[0] for i in a]]
    left = [rss(m) for m in models]
    for term, before, after, df in zip(("a", "b", "a:b"), left, left[1:], (2, 1, 2)):
        assert got[term]["df"] == df and got[term]["ss"] == pytest.approx(before - after)
        assert got[term]["fstat"] == pytest.approx((before - after) / df / (left[-1] / (n - 6)))
    swapped = M.emmeans_pairwise(spark.createDataFrame(pdf).withColumn("m", F.lit(1)), ["m"], "a", "b", ["z", "y", "x"], "y").collect()
    straight = M.emmeans_pairwise(spark.createDataFrame(pdf).withColumn("m", F.lit(1)), ["m"], "a", "b", ["x", "y", "z"], "y").collect()
    flip = {(r["b"], frozenset(r["contrast"].split(" - "))): r["estimate"] for r in swapped}
    for r in straight:
        assert flip[r["b"], frozenset(r["contrast"].split(" - "))] == pytest.approx(-r["estimate"])


# --- communities --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def community(spark):
    m = rng.poisson(1.2, (23, 40)) * rng.integers(1, 9, (23, 40))
    m[3] = m[4]
    m[5, :20] = 0
    m[6, 20:] = 0
    cells = [(f"s{i:02d}", f"t{j}", int(m[i, j])) for i in range(23) for j in range(40) if m[i, j]]
    df = cut_lineage(spark.createDataFrame(cells, "sample_id string, taxon_id string, count long"))
    design = spark.createDataFrame([(f"s{i:02d}", "abc"[i % 3], "pq"[(i // 3) % 2]) for i in range(23)], "sample_id string, a string, b string")
    return m, df, design


@pytest.mark.parametrize("sizes", [(64, 16_384), (5, 7)])
def test_distances_do_not_depend_on_tiles(community, sizes):
    m, df, _ = community
    bray = {(r["id_a"], r["id_b"]): r["d"] for r in K.bray_curtis(df, block_samples=sizes[0], chunk_taxa=sizes[1]).collect()}
    euclid = {(r["id_a"], r["id_b"]): r["d"] for r in K.euclidean(df, block_samples=sizes[0], chunk_taxa=sizes[1]).collect()}
    assert len(bray) == len(euclid) == 23 * 22 // 2
    for i, j in itertools.combinations(range(23), 2):
        x, y = m[i].astype(float), m[j].astype(float)
        key = (f"s{i:02d}", f"s{j:02d}")
        assert bray[key] == pytest.approx(abs(x - y).sum() / (x + y).sum(), abs=1e-12)
        assert euclid[key] == pytest.approx(np.linalg.norm(x - y))
    assert bray["s03", "s04"] == 0 and all(0 <= d <= 1 for d in bray.values()) and bray["s05", "s06"] == 1


def test_permanova_of_one_variable_is_the_f_test(spark, community):
    _, _, design = community
    y = rng.normal(size=23)
    values = spark.createDataFrame([(f"s{i:02d}", "v", float(v)) for i, v in enumerate(y)], "sample_id string, taxon_id string, count double")
    pairs = cut_lineage(K.euclidean(values))
    got = {r["term"]: r for r in P.permanova(pairs, design, ["a", "b"], perms=19).collect()}
    data = design.join(values, "sample_id").withColumn("m", F.lit(1))
    want = {r["term"]: r for r in M.anova(data, ["m"], ["a", "b"], "count").collect()}
    for term, w in want.items():
        assert got[term]["pseudo_f"] == pytest.approx(w["fstat"]) and got[term]["ss"] == pytest.approx(w["ss"])
        assert 1 / 20 <= got[term]["p"] <= 1
    parts = sum(got[t]["ss"] for t in ("a", "b", "a:b", "Residual"))
    assert parts == pytest.approx(got["Total"]["ss"])


def test_ordination(spark, community):
    flat = spark.createDataFrame([(f"s{i:02d}", k, float(v)) for i in range(9) for k, v in (("x", i % 3), ("y", i // 3))],
                                 "sample_id string, taxon_id string, count double")
    pairs = cut_lineage(K.euclidean(flat))
    found = cut_lineage(O.ordinate_nmds(pairs, starts=4))
    coords = found.select("sample_id", "axis1", "axis2")
    assert coords.count() == 9 and 1 <= found.first()["same"] <= 4
    points = O.shepard(pairs, coords).toPandas().sort_values("d")
    assert points.groupby("d")["fit"].first().is_monotonic_increasing
    assert O.stress(O.shepard(pairs, coords)).first()["stress"] == pytest.approx(found.first()["stress"], abs=1e-9) and found.first()["stress"] < 0.3
    site = flat.groupBy("sample_id").pivot("taxon_id", ["x", "y"]).agg(F.max("count")).withColumnsRenamed({"x": "axis1", "y": "axis2"})
    env = site.select("sample_id", (F.col("axis1") * 3 + 1).alias("v"))
    fit = O.envfit_vectors(site, env, ["v"], 19).first()
    assert fit["r2"] == pytest.approx(1) and fit["axis1"] == pytest.approx(1) and abs(fit["axis2"]) < 1e-9


def test_dispersion_and_wald_find_the_changed_taxa(spark):
    n, taxa = 24, 60
    base = rng.uniform(20, 200, taxa)
    effect = np.where(np.arange(taxa) < 6, 8.0, 1.0)
    cells, design = [], []
    for i in range(n):
        group = "ctl" if i < n // 2 else "trt"
        depth = rng.uniform(0.5, 2)
        design.append((f"s{i}", group))
        mu = base * depth * (effect if group == "trt" else 1)
        y = rng.negative_binomial(10, 10 / (10 + mu))
        cells += [(f"s{i}", f"t{j:02d}", int(v)) for j, v in enumerate(y) if v]
    counts = cut_lineage(spark.createDataFrame(cells, "sample_id string, taxon_id string, count long"))
    samples = spark.createDataFrame(design, "sample_id string, g string")
    factors = cut_lineage(A.size_factors(counts, samples))
    disp = A.dispersion(counts, samples, factors, "g", ["ctl", "trt"])
    assert 0.05 < disp.agg(F.expr("median(dispersion)")).first()[0] < 0.2
    res = cut_lineage(A.nb_wald(counts, samples, factors, "g", ["ctl", "trt"], "ctl", disp))
    assert res.count() == taxa
    adjusted = A.independent_filter(res)
    hits = {r["taxon_id"] for r in adjusted.filter("padj < 0.001").collect()}
    assert {f"t{j:02d}" for j in range(6)} <= hits and len(hits) <= 8
    row = res.filter("taxon_id = 't00'").first()
    assert row["contrast"] == "g_trt_vs_ctl" and row["log2_fold_change"] == pytest.approx(3, abs=0.8)
    assert row["stat"] == pytest.approx(row["log2_fold_change"] / row["lfc_se"])


def test_text_comes_back_as_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "NA", 2.5), (2, None, None), (3, "x y", -1.0)], "a int, b string, c double")
    write_tsv(df, str(tmp_path / "t"))
    assert sorted(scan_tsv(spark, str(tmp_path / "t"), "a int, b string, c double").collect(), key=str) == sorted(df.collect(), key=str)


def test_reader_refuses_other_headers_and_bad_cells(spark, tmp_path):
    (tmp_path / "swapped.txt").write_text("b\ta\n1\t2\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_tsv(spark, str(tmp_path / "swapped.txt"), "a int, b int").collect()
    (tmp_path / "bad.txt").write_text("a\tb\n1\tx\n")
    with pytest.raises(Exception):
        scan_tsv(spark, str(tmp_path / "bad.txt"), "a int, b int").collect()
    assert scan_tsv(spark, str(tmp_path / "bad.txt"), "a int, b int", mode="PERMISSIVE").collect() == [(1, None)]


def test_separator_is_no_pattern(spark):
    df = spark.createDataFrame([("a.b|c",)], "k string")
    assert W.split_key(df, "k", {1: "x", 2: "y"}, ".").select("x", "y").collect() == [("a", "b|c")]
    assert W.split_key(df, "k", {2: "y", 3: "z"}, "|").select("y", "z").collect() == [("c", None)]


def test_pivot_refuses_several_values(spark):
    df = spark.createDataFrame([(1, "p", 1.0), (1, "p", 3.0), (1, "q", 5.0)], "id int, name string, v double")
    with pytest.raises(Exception, match="several values"):
        W.pivot(df, ["id"], "name", ["p", "q"], ["v"]).collect()
    assert W.pivot(df, ["id"], "name", ["p", "q"], ["v"], combine=F.avg).collect() == [(1, 2.0, 5.0)]


def test_equal_values_keep_a_bin(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4 + [("b", 1.0), ("b", 2.0)], "g string, x double")
    got = S.histogram_sturges(df, ["g"], "x")
    assert got.filter("g = 'a'").collect() == [("a", 5.0, 5.0, 4)] and got.filter("g = 'b'").agg(F.sum("n")).first()[0] == 2


@pytest.mark.parametrize("chunk", [1, 100])
def test_samples_without_values_form_no_pairs(spark, chunk):
    df = spark.createDataFrame([("s1", "x", 1), ("s1", "y", 2), ("s2", "y", 4), ("s3", "x", None)], "sample_id string, taxon_id string, count long")
    got = K.bray_curtis(df, chunk_taxa=chunk).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [("s1", "s2")]


def test_ranges_do_not_follow_a_dominant_value(spark):
    df = spark.range(40_000).select(F.when(F.col("id") < 38_000, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert rank_cells(df, [], "x", hot_rows=100).select("_range").distinct().count() > 500


def test_roll_up_in_more_partitions(spark, monkeypatch, tmp_path):
    rows = [(s % 7 if s % 11 else None, s % 13 if s % 17 else None, float(s)) for s in range(300)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"B{p % 3}" if p % 5 else None, f"T{p % 2}") for p in [*range(13), 4]], "p_partkey long, p_brand string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    found = []
    for task_rows in (500_000, 25):
        monkeypatch.setattr(registry, "TASK_ROWS", task_rows)
        t = registry.Tables(spark, str(tmp_path))
        taxonomy = t.part.selectExpr("p_partkey AS taxon_id", "p_type AS phylum", "p_brand AS genus")
        assert t.parts == (None if task_rows > 300 else 12)
        out = K.tax_glom(t.part_counts(), taxonomy, "genus", ["phylum", "genus"], parts=t.parts)
        sizes = t.part_counts().rdd.getNumPartitions()
        found.append([sorted(map(str, df.collect())) for df in (out, t.part_counts(), t.counts())])
    assert sizes == 12 and found[0] == found[1] and found[0][0]
