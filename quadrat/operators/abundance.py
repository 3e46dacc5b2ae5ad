"""Differential abundance of counts: size factors, dispersions, negative-binomial Wald tests.

The design is one factor of samples. Taxa are hashed into buckets of bounded size; every bucket meets the (small) sample
table in a cogroup, so neither the driver nor a broadcast ever holds it, and a taxon brings at most one row per sample.
Estimates follow the published method (per-taxon dispersion, trend over the mean, shrinkage to the trend); parity with
any one implementation of it is not claimed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.grouping import attach, exact_quantiles, rank_cells
from quadrat.functions.semantics import reference_first
from quadrat.functions.tails import p_two_sided_normal
from quadrat.operators.hypothesis import p_adjust
from quadrat.session import cut_lineage

CELLS_PER_BUCKET = 2_000_000  # dense taxon x sample cells of one task
MIN_DISPERSION = 1e-8
MIN_MU = 0.5


def size_factors(counts: DataFrame, samples: DataFrame, sample: str = "sample_id", taxon: str = "taxon_id",
                 count: str = "count") -> DataFrame:
    """Median over taxa of count / geometric mean; only taxa found in every sample enter."""
    total = samples.select(F.count_distinct(sample)).scalar()
    logs = _combined(counts, sample, taxon, count).filter(F.col(count) > 0).withColumn("_log", F.log(F.col(count).cast("double")))
    geo = logs.groupBy(taxon).agg(F.avg("_log").alias("_geo"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == total)
    ratios = logs.join(geo.select(taxon, "_geo"), taxon).select(sample, (F.col("_log") - F.col("_geo")).alias("_r"))
    return exact_quantiles(ratios, [sample], "_r", {"_m": 0.5}).select(sample, F.exp("_m").alias("size_factor"))


def base_mean(counts: DataFrame, factors: DataFrame, sample: str = "sample_id", taxon: str = "taxon_id",
              count: str = "count") -> DataFrame:
    """Mean normalised count per taxon over all samples, absent cells being 0."""
    n = factors.select(F.count(F.lit(1))).scalar()
    rows = attach(counts, factors, [sample], "inner")
    return rows.groupBy(taxon).agg((F.sum(F.col(count) / F.col("size_factor")) / n).alias("base_mean"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive arrays: shifted above 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def _group_means(y, s, group, levels, alpha, rounds: int = 25):
    """Maximum-likelihood mean level of every taxon (rows) in every group for a given dispersion."""
    q = np.empty((len(y), levels))
    for g in range(levels):
        at = group == g
        yg, sg = y[:, at], s[at][None, :]
        b = np.log(np.maximum((yg / sg).mean(axis=1), 1e-10))
        for _ in range(rounds):
            mu = np.maximum(np.exp(b)[:, None] * sg, 1e-12)
            w = 1 + alpha[:, None] * mu
            score, info = ((yg - mu) / w).sum(axis=1), (mu / w).sum(axis=1)
            b = b + np.clip(score / np.maximum(info, 1e-12), -2, 2)
        q[:, g] = np.exp(b)
    return q


def _profile(log_alpha, y, mu, group, levels, prior=None):
    """Adjusted profile log-likelihood of the log dispersion, one value per taxon."""
    a = np.exp(log_alpha)[:, None]
    size = 1 / a
    like = (_lgamma(y + size) - _lgamma(size) - y * np.log1p(size / mu) - size * np.log1p(a * mu)).sum(axis=1)
    w = mu / (1 + a * mu)
    for g in range(levels):
        like -= 0.5 * np.log(w[:, group == g].sum(axis=1))
    if prior is not None:
        centre, variance = prior
        like -= (log_alpha - centre) ** 2 / (2 * variance)
    return like


def _best_dispersion(y, mu, group, levels, upper, prior=None):
    grid = np.linspace(math.log(MIN_DISPERSION), math.log(upper), 30)
    values = np.stack([_profile(np.full(len(y), v), y, mu, group, levels, prior) for v in grid], axis=1)
    top = values.argmax(axis=1)
    low, high = grid[np.maximum(top - 1, 0)], grid[np.minimum(top + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = _profile(left, y, mu, group, levels, prior) > _profile(right, y, mu, group, levels, prior)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return np.exp((low + high) / 2)


def _by_bucket(cells: DataFrame, design: DataFrame, fields: str, per_taxa, sample: str, taxon: str, count: str,
               carried: Sequence[str] = ()) -> DataFrame:
    """Run ``per_taxa(names, y, s, group, carried)`` on dense blocks of taxa (rows) by samples (columns)."""
    sizes = cells.agg(F.approx_count_distinct(taxon)).first()[0]
    n = design.count()
    buckets = max(1, math.ceil(sizes * n / CELLS_PER_BUCKET), min(sizes, cells.sparkSession.sparkContext.defaultParallelism))
    left = cells.withColumn("_bucket", F.pmod(F.xxhash64(taxon), F.lit(buckets)).cast("int"))
    right = design.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    schema = T.StructType([cells.schema[taxon], *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({c: [] for c in names})
        samples = samples.sort_values(sample, ignore_index=True)
        column = pd.Series(samples.index, index=samples[sample])
        codes, taxa = pd.factorize(pdf[taxon])
        y = np.zeros((len(taxa), len(samples)))
        place = column.reindex(pdf[sample]).to_numpy()
        there = ~np.isnan(place.astype(float))
        np.add.at(y, (codes[there], place[there].astype(int)), pdf[count].to_numpy(float)[there])
        extra = {c: pdf.groupby(codes)[c].first().to_numpy(float) for c in carried}
        s, group = samples["size_factor"].to_numpy(float), samples["_group"].to_numpy(int)
        return pd.DataFrame(per_taxa(taxa, y, s, group, extra), columns=names)

    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInPandas(run, schema)


def _combined(counts: DataFrame, sample: str, taxon: str, count: str) -> DataFrame:
    """One row per sample and taxon, so that a taxon brings no more rows than there are samples."""
    return counts.groupBy(sample, taxon).agg(F.sum(count).alias(count))


def _coded_design(samples: DataFrame, factors: DataFrame, group: str, levels: Sequence[str], sample: str) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(group)) - 1
    return (samples.select(sample, code.cast("int").alias("_group")).filter("_group >= 0")
            .join(factors, sample).select(sample, "size_factor", "_group"))


def dispersion(counts: DataFrame, samples: DataFrame, factors: DataFrame, group: str, levels: Sequence[str],
               sample: str = "sample_id", taxon: str = "taxon_id", count: str = "count") -> DataFrame:
    """Per taxon: mean, own dispersion, trend value, shrunken (final) dispersion. The result is checkpointed."""
    k = len(levels)
    design = cut_lineage(_coded_design(samples, factors, group, levels, sample))
    cells = _combined(counts, sample, taxon, count)
    n = design.count()

    def own(taxa, y, s, g, _):
        mean = (y / s).mean(axis=1)
        keep = mean > 0
        y, names, mean = y[keep], np.asarray(taxa)[keep], mean[keep]
        start = np.full(len(y), 0.1)
        for _ in range(2):
            mu = np.maximum(_group_means(y, s, g, k, start)[:, g] * s, MIN_MU)
            start = _best_dispersion(y, mu, g, k, max(10.0, len(s)))
        return {taxon: names, "base_mean": mean, "disp_own": start}

    first = cut_lineage(_by_bucket(cells, design, "base_mean double, disp_own double", own, sample, taxon, count))
    a0, a1 = _trend(first)
    trended = first.withColumn("disp_trend", F.lit(a0) + F.lit(a1) / F.col("base_mean"))
    off = F.log("disp_own") - F.log("disp_trend")
    useful = trended.filter(F.col("disp_own") > 100 * MIN_DISPERSION).select(off.alias("_off"))
    middle = exact_quantiles(useful, [], "_off", {"m": 0.5}).first()
    spread = 0.25
    if middle is not None and middle["m"] is not None:
        away = exact_quantiles(useful.select(F.abs(F.col("_off") - middle["m"]).alias("_a")), [], "_a", {"m": 0.5}).first()["m"]
        spread = (1.4826 * away) ** 2
    prior = max(spread - _trigamma(max(n - k, 1) / 2), 0.25)

    def shrink(taxa, y, s, g, extra):
        mu = np.maximum(_group_means(y, s, g, k, extra["disp_own"])[:, g] * s, MIN_MU)
        fit = np.log(extra["disp_trend"])
        final = _best_dispersion(y, mu, g, k, max(10.0, len(s)), (fit, prior))
        # A taxon far above the trend keeps its own estimate.
        far = np.log(extra["disp_own"]) > fit + 2 * math.sqrt(spread)
        return {taxon: np.asarray(taxa), "dispersion": np.where(far, extra["disp_own"], final)}

    again = attach(cells, trended.select(taxon, "disp_own", "disp_trend"), [taxon], "inner")
    last = _by_bucket(again, design, "dispersion double", shrink, sample, taxon, count, ["disp_own", "disp_trend"])
    return cut_lineage(trended.join(last, taxon))


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    return total + 1 / x + r / 2 + (1 / x) * r * (1 / 6 - r * (1 / 30 - r / 42))


def _trend(own: DataFrame, rounds: int = 12) -> tuple[float, float]:
    """Gamma regression of dispersion on 1/mean with identity link: one aggregate of five sums per round."""
    rows = own.filter(F.col("disp_own") > 100 * MIN_DISPERSION).select((1 / F.col("base_mean")).alias("x"), F.col("disp_own").alias("d"))
    a0, a1 = 0.1, 1.0
    for _ in range(rounds):
        mu = F.lit(a0) + F.lit(a1) * F.col("x")
        w = 1 / (mu * mu)
        sums = rows.filter((F.col("d") / mu).between(1e-4, 15.0)).agg(
            F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") ** 2), F.sum(w * F.col("d")), F.sum(w * F.col("x") * F.col("d")),
            F.count(F.lit(1))).first()
        if not sums[5]:
            break
        s, sx, sxx, sd, sxd = sums[:5]
        det = s * sxx - sx * sx
        if det <= 1e-12 * s * sxx:
            new = (sd / s, 0.0)
        else:
            new = ((sd * sxx - sxd * sx) / det, (s * sxd - sx * sd) / det)
        new = (max(new[0], MIN_DISPERSION), max(new[1], 0.0))
        done = abs(new[0] - a0) < 1e-8 * a0 and abs(new[1] - a1) < 1e-8 * max(a1, 1e-8)
        a0, a1 = new
        if done:
            break
    return a0, a1


def nb_wald(counts: DataFrame, samples: DataFrame, factors: DataFrame, group: str, levels: Sequence[str], reference: str,
            dispersions: DataFrame | None = None, sample: str = "sample_id", taxon: str = "taxon_id",
            count: str = "count") -> DataFrame:
    """Wald test of every level against the reference: one row per taxon and contrast ``<group>_<level>_vs_<reference>``.

    Columns: base_mean, log2_fold_change, lfc_se, stat, p.
    """
    levels = reference_first(levels, reference)
    k = len(levels)
    if dispersions is None:
        dispersions = dispersion(counts, samples, factors, group, levels, sample, taxon, count)
    design = _coded_design(samples, factors, group, levels, sample)
    cells = attach(_combined(counts, sample, taxon, count), dispersions.select(taxon, "base_mean", "dispersion"), [taxon], "inner")

    def test(taxa, y, s, g, extra):
        alpha = extra["dispersion"]
        q = _group_means(y, s, g, k, alpha)
        mu = np.maximum(q[:, g] * s, MIN_MU)
        w = mu / (1 + alpha[:, None] * mu)
        # A mean level below the floor is not distinguishable from it.
        q = np.stack([np.maximum(q[:, j], MIN_MU / s[g == j].mean()) for j in range(k)], axis=1)
        info = np.stack([w[:, g == j].sum(axis=1) for j in range(k)], axis=1)
        parts = []
        for j in range(1, k):
            lfc = np.log2(q[:, j] / q[:, 0])
            se = np.sqrt(1 / info[:, j] + 1 / info[:, 0]) / math.log(2)
            parts.append(pd.DataFrame({taxon: np.asarray(taxa), "contrast": f"{group}_{levels[j]}_vs_{levels[0]}",
                                       "base_mean": extra["base_mean"], "log2_fold_change": lfc, "lfc_se": se, "stat": lfc / se}))
        return pd.concat(parts, ignore_index=True)

    out = _by_bucket(cells, design, "contrast string, base_mean double, log2_fold_change double, lfc_se double, stat double",
                     test, sample, taxon, count, ["base_mean", "dispersion"])
    return out.withColumn("p", p_two_sided_normal("stat"))


def select_contrast(results: DataFrame, name: str) -> DataFrame:
    return results.filter(F.col("contrast") == name)


def smoothed(x: np.ndarray, y: np.ndarray, share: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines through ``share`` of the points around each x (increasing), with ``rounds`` robust reweightings."""
    n = len(x)
    near = min(max(int(share * n + 1e-7), 2), n)
    distance = np.abs(x[:, None] - x[None, :])
    reach = np.sort(distance, axis=1)[:, near - 1]
    close = np.clip(distance / np.maximum(reach, 1e-300)[:, None], 0, 1)
    weights, robust = (1 - close ** 3) ** 3, np.ones(n)
    fit = np.zeros(n)
    for turn in range(rounds + 1):
        for i in range(n):
            w = weights[i] * robust
            w = w / max(w.sum(), 1e-300)
            middle = w @ x
            spread = w @ (x - middle) ** 2
            slope = (w @ ((x - middle) * y)) / spread if spread > 1e-12 * (x[-1] - x[0]) ** 2 else 0.0
            fit[i] = w @ y + slope * (x[i] - middle)
        off = np.abs(y - fit)
        scale = 6 * np.median(off)
        if turn == rounds or scale < 1e-7 * np.abs(off).mean() or scale == 0:
            break
        robust = np.clip(1 - (off / scale) ** 2, 0, None) ** 2
    return fit


def chosen_cut(theta: np.ndarray, rejections: np.ndarray) -> int:
    """The first cut whose rejections come within one residual's root mean square of the smoothed curve's top; none (0) where no
    cut has more than ten rejections."""
    if rejections.max(initial=0) <= 10:
        return 0
    curve = smoothed(theta, rejections.astype(float))
    some = rejections > 0
    least = curve.max() - math.sqrt(np.mean((rejections[some] - curve[some]) ** 2))
    above = np.flatnonzero(rejections > least)
    return int(above[0]) if len(above) else 0


def independent_filter(results: DataFrame, alpha: float = 0.05, steps: int = 50, p: str = "p") -> DataFrame:
    """Adjusted p values with a filter on the mean: ``padj`` is NULL below the chosen mean.

    Per contrast ``steps`` cuts are tried, quantiles of the mean from the share of zero means to 0.95 (to 1 if that share is as
    large), and ``chosen_cut`` picks one from the smoothed curve of their rejections. ``results`` should be a written or checkpointed table.
    """
    # The share of zero means differs by contrast, so quantiles are read off the ranks instead of fixed probabilities.
    cells = rank_cells(results, ["contrast"], "base_mean")
    low = results.groupBy("contrast").agg((F.count_if(F.col("base_mean") == 0) / F.count("base_mean")).alias("_low"))
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    top = F.when(F.col("_low") < 0.95, 0.95).otherwise(1.0)
    tries = low.select("contrast", "_low", step).withColumn("theta", F.col("_low") + (top - F.col("_low")) * F.col("step") / (steps - 1)).drop("_low")
    placed = attach(cells.select("contrast", "base_mean", "before", "ties", "size"), tries.groupBy("contrast").agg(
        F.collect_list(F.struct("step", "theta")).alias("_t")), ["contrast"])
    # The cut lies between two order statistics: each cell gives its share of the cuts that fall on or beside it.
    at = placed.select("contrast", "base_mean", "before", "ties", "size", F.explode("_t").alias("t")).withColumn("_h", (F.col("size") - 1) * F.col("t.theta"))

    def on(place):
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("ties")), F.col("base_mean")))

    cuts = at.groupBy("contrast", F.col("t.step").alias("step"), F.col("t.theta").alias("theta")).agg(
        on(F.floor("_h")).alias("_a"), on(F.ceil("_h")).alias("_b"), F.max(F.col("_h") - F.floor("_h")).alias("_w"))
    cuts = cuts.select("contrast", "step", "theta", (F.col("_a") + F.col("_w") * (F.col("_b") - F.col("_a"))).alias("cut"))
    trial = results.select("contrast", "base_mean", p).join(cuts, "contrast").filter(F.col("base_mean") >= F.col("cut"))
    tried = p_adjust(trial, ["contrast", "step"], p, "BH", "padj")
    wins = tried.groupBy("contrast", "step").agg(F.count_if(F.col("padj") < alpha).alias("n"))
    curve = cuts.join(wins, ["contrast", "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        k = chosen_cut(pdf["theta"].to_numpy(float), pdf["n"].to_numpy())
        return pd.DataFrame({"contrast": [pdf["contrast"].iloc[0]], "cut": [float(pdf["cut"].iloc[k])]})

    best = curve.groupBy("contrast").applyInPandas(pick, T.StructType([results.schema["contrast"], T.StructField("cut", T.DoubleType())]))
    kept = cut_lineage(results.join(best, "contrast"))
    passed = p_adjust(kept.filter(F.col("base_mean") >= F.col("cut")), ["contrast"], p, "BH", "padj")
    low = kept.filter(F.col("base_mean") < F.col("cut")).withColumn("padj", F.lit(None).cast("double"))
    return passed.unionByName(low).drop("cut")


def significant_taxa(results: DataFrame, taxonomy: DataFrame, alpha: float = 0.05, taxon: str = "taxon_id") -> DataFrame:
    """Rows with padj < alpha, their taxonomy, ordered by fold change."""
    return results.filter(F.col("padj") < alpha).join(taxonomy, taxon, "left").orderBy("log2_fold_change", taxon)
