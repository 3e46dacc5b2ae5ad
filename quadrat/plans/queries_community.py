"""Queries for community tables, distances, permutation tests, ordination and differential abundance."""

from pyspark.sql import functions as F

from quadrat.functions.exchange import moved_sql
from quadrat.operators import abundance as A
from quadrat.operators import community as K
from quadrat.operators import ordination as O
from quadrat.operators import permutation as P
from quadrat.plans.registry import query, rounded
from quadrat.session import cut_lineage

REGIONS = ["0", "1", "2", "3", "4"]
RANKS = ["kingdom", "phylum", "genus"]
PERMS = 999


@query("SELECT sample_id, 'goods' AS kingdom, p_type AS phylum, CAST(sum(count) AS BIGINT) AS count FROM part_counts JOIN part ON p_partkey = taxon_id GROUP BY 1, 2, 3",
       "part_counts")
def tax_glom_phylum(t):
    return K.tax_glom(t.counts(), t.taxonomy(), "phylum", RANKS, parts=t.parts)


@query("""SELECT sample_id, 'goods' AS kingdom, p_type AS phylum, p_brand AS genus, CAST(sum(count) AS BIGINT) AS count FROM part_counts JOIN part ON p_partkey = taxon_id
WHERE p_brand <> 'Brand#7' GROUP BY ALL""", "part_counts")
def tax_glom_genus_without_unassigned(t):
    taxonomy = t.part.select(F.col("p_partkey").alias("taxon_id"), F.lit("goods").alias("kingdom"), F.col("p_type").alias("phylum"),
                             F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("genus"))
    return K.tax_glom(t.part_counts(), taxonomy, "genus", RANKS, parts=t.parts)


@query("SELECT sample_id, taxon_id, count FROM counts WHERE sample_id IN (SELECT sample_id FROM samples WHERE half = 'odd')", "counts samples")
def subset_samples(t):
    return K.subset_samples(t.counts(), t.samples(), F.col("half") == "odd")[0]


@query("SELECT taxon_id, CAST(sum(count) AS BIGINT) AS total FROM part_counts GROUP BY 1", "part_counts")
def taxa_sums(t):
    return K.taxa_sums(t.part_counts())


@query("""SELECT sample_id, taxon_id, count FROM counts WHERE taxon_id IN (SELECT taxon_id FROM counts GROUP BY 1 ORDER BY sum(count) DESC, taxon_id LIMIT 10)""", "counts")
def top_taxa(t):
    return K.top_taxa(t.counts(), 10)


def _long_sites(t):
    return t.site_variables().unpivot(["sample_id"], ["qty", "disc", "tax", "price"], "variable", "value")


_LONG = "+long AS (UNPIVOT site_variables ON qty, disc, tax, price INTO NAME variable VALUE value) "


@query("SELECT sample_id, taxon_id, count, round(count / sum(count) OVER (PARTITION BY sample_id), 12) AS share FROM part_counts", "part_counts")
def standardize_sample_total(t):
    return rounded(K.standardize(t.part_counts(), "total", 1), 12, "share")


@query(_LONG + "SELECT sample_id, variable, round(value / sum(value) OVER (PARTITION BY variable), 12) AS share FROM long", "site_variables")
def standardize_variable_total(t):
    return rounded(K.standardize(_long_sites(t), "total", 2, variable="variable", value="value").drop("value"), 12, "share")


@query(_LONG + "SELECT sample_id, variable, round(value / max(value) OVER (PARTITION BY variable), 12) AS share FROM long", "site_variables")
def standardize_variable_max(t):
    return rounded(K.standardize(_long_sites(t), "max", 2, variable="variable", value="value").drop("value"), 12, "share")


_BRAY = """+tot AS (SELECT sample_id, sum(count) AS s FROM {c} GROUP BY 1),
least_sums AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, sum(least(a.count, b.count)) AS m FROM {c} a JOIN {c} b ON a.taxon_id = b.taxon_id AND a.sample_id < b.sample_id GROUP BY 1, 2),
dist AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, greatest(1 - 2 * coalesce(CAST(m AS DOUBLE), 0) / (a.s + b.s), 0) AS d FROM tot a JOIN tot b ON a.sample_id < b.sample_id
 LEFT JOIN least_sums l ON l.id_a = a.sample_id AND l.id_b = b.sample_id)
"""
_BRAY_TAXA = _BRAY.replace("{c}", "counts")


@query(_BRAY_TAXA + "SELECT id_a, id_b, round(d, 9) AS d FROM dist", "counts")
def bray_curtis(t):
    return rounded(K.bray_curtis(t.counts()), 9, "d")


@query(_BRAY.replace("{c}", "part_counts") + "SELECT id_a, id_b, round(d, 9) AS d FROM dist", "part_counts")
def bray_curtis_sparse(t):
    return rounded(K.bray_curtis(t.part_counts()), 9, "d")


_EUCLID = """+w AS (SELECT sample_id, qty / sum(qty) OVER () AS q, disc / sum(disc) OVER () AS d, tax / sum(tax) OVER () AS x, price / sum(price) OVER () AS p FROM site_variables),
edist AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, sqrt(pow(a.q - b.q, 2) + pow(a.d - b.d, 2) + pow(a.x - b.x, 2) + pow(a.p - b.p, 2)) AS d FROM w a JOIN w b ON a.sample_id < b.sample_id)
"""


def _site_distance(t):
    return K.euclidean(K.standardize(_long_sites(t), "total", 2, variable="variable", value="value"), variable="variable", value="share")


@query(_EUCLID + "SELECT id_a, id_b, round(d, 9) AS d FROM edist", "site_variables")
def euclidean(t):
    return rounded(_site_distance(t), 9, "d")


@query("""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def euclidean_embeddings(t):
    long = t.embeddings.select("vec_id", F.posexplode("embedding").alias("axis", "x"))
    return rounded(K.euclidean(long.withColumn("x", F.col("x").cast("double")), "vec_id", "axis", "x"), 7, "d")


@query(_BRAY_TAXA + _EUCLID.replace("+w", ", w") + """SELECT b.id_a, b.id_b, round(b.d, 9) AS d1, round(e.d, 9) AS d2 FROM dist b JOIN edist e ON e.id_a = b.id_a AND e.id_b = b.id_b""",
       "counts site_variables")
def paired_distances(t):
    return rounded(K.dist_pairs_join(K.bray_curtis(t.counts()), _site_distance(t)), 9, "d1", "d2")


_PERM = """, numbered AS (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1 AS no, count(*) OVER () AS n FROM samples),
""" + moved_sql("numbered", "", PERMS)


@query(_BRAY_TAXA + _PERM + """, lab AS (SELECT perm, h.sample_id, s.region AS g FROM moved m JOIN numbered h ON h.no = m.place JOIN samples s ON s.sample_id = m.sample_id),
n AS (SELECT region AS g, count(*) AS n FROM samples GROUP BY 1), size_of AS (SELECT sum(n) AS n, count(*) AS k FROM n), sst AS (SELECT sum(d * d) AS s FROM dist),
w AS (SELECT s.perm, sum(s.d2 / n.n) AS ssw FROM (SELECT a.perm, a.g, sum(d * d) AS d2 FROM dist JOIN lab a ON a.sample_id = id_a JOIN lab b ON b.sample_id = id_b AND b.perm = a.perm AND b.g = a.g GROUP BY 1, 2) s
 JOIN n ON n.g = s.g GROUP BY 1),
f AS (SELECT perm, sst.s / n AS ss_t, ssw, ((sst.s / n - ssw) / (k - 1)) / (ssw / (n - k)) AS f FROM w, size_of, sst)
SELECT 'region' AS term, round(ss_t - ssw, 7) AS ss, round(1 - ssw / ss_t, 7) AS r2, round(f, 6) AS pseudo_f,
(1.0 + (SELECT count(*) FROM f x WHERE x.perm > 0 AND x.f >= f.f - 1e-9 * greatest(abs(f.f), 1))) / 1000.0 AS p FROM f WHERE perm = 0""", "counts samples")
def permanova_one_way(t):
    out = P.permanova(K.bray_curtis(t.counts()), t.samples(), ["region"], PERMS).filter("term = 'region'")
    return rounded(rounded(out.select("term", "ss", "r2", "pseudo_f", "p"), 7, "ss", "r2"), 6, "pseudo_f")


_LEVEL_PAIRS = """, lv AS (SELECT x.region || ' vs ' || y.region AS pair, x.region AS l1, y.region AS l2 FROM (SELECT DISTINCT region FROM samples) x JOIN (SELECT DISTINCT region FROM samples) y ON x.region < y.region),
part_of AS (SELECT pair, sample_id, region, half FROM samples JOIN lv ON region = l1 OR region = l2)"""
_ONE_SET = ", part_of AS (SELECT 'all' AS pair, sample_id, region, half FROM samples)"
#: Region, half within region and their interaction for each set: two levels of half, so its part is one projection.
_TERMS = """, numbered AS (SELECT pair, sample_id, row_number() OVER (PARTITION BY pair ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1 AS no, count(*) OVER (PARTITION BY pair) AS n FROM part_of),
""" + moved_sql("numbered", "pair, ", PERMS) + """,
told AS (SELECT pair, sample_id, region AS g, half AS h, count(*) OVER (PARTITION BY pair, region) AS ng, count(*) OVER (PARTITION BY pair, region, half) AS nc,
 CAST(half = 'even' AS INTEGER) - avg(CAST(half = 'even' AS INTEGER)) OVER (PARTITION BY pair, region) AS v FROM part_of),
lab AS (SELECT m.pair, m.perm, n.sample_id, t.g, t.h, t.ng, t.nc, t.v FROM moved m JOIN numbered n ON n.pair = m.pair AND n.no = m.place JOIN told t ON t.pair = m.pair AND t.sample_id = m.sample_id),
base AS (SELECT pair, count(*) AS n, sum(v * v) AS vv, count(DISTINCT g) AS kg, count(DISTINCT g || h) AS kc FROM told GROUP BY 1),
s AS (SELECT a.pair, a.perm, sum(d * d) AS t, sum(CASE WHEN a.g = b.g THEN d * d / a.ng ELSE 0 END) AS w1,
 sum(CASE WHEN a.g = b.g AND a.h = b.h THEN d * d / a.nc ELSE 0 END) AS w2, -sum(a.v * b.v * d * d) AS q
 FROM dist JOIN lab a ON a.sample_id = id_a JOIN lab b ON b.sample_id = id_b AND b.pair = a.pair AND b.perm = a.perm GROUP BY 1, 2),
parts AS (SELECT s.pair, perm, t / n AS tt, t / n - w1 AS ss0, q / vv AS ss1, w1 - w2 - q / vv AS ss2, w2 AS res, kg - 1 AS df0, 1 AS df1, kc - kg - 1 AS df2, n - kc AS dfr FROM s JOIN base ON base.pair = s.pair),
f AS (SELECT pair, perm, unnest([0, 1, 2]) AS place, unnest(['region', 'half', 'region:half']) AS term, unnest([df0, df1, df2]) AS df, unnest([ss0, ss1, ss2]) AS ss, tt,
 unnest([ss0 / df0, ss1 / df1, ss2 / df2]) / (res / dfr) AS f FROM parts),
p AS (SELECT o.pair, o.place, o.term, max(o.df) AS df, max(o.ss) AS ss, max(o.ss / o.tt) AS r2, max(o.f) AS f,
 (1.0 + count(*) FILTER (x.f >= o.f - 1e-9 * greatest(abs(o.f), 1))) / 1000.0 AS p FROM f o JOIN f x ON x.pair = o.pair AND x.place = o.place AND x.perm > 0 WHERE o.perm = 0 GROUP BY ALL)
"""


@query(_BRAY_TAXA + _ONE_SET + _TERMS + """SELECT term, CAST(df AS DOUBLE) AS df, round(ss, 7) AS ss, round(r2, 7) AS r2, round(f, 6) AS pseudo_f, p FROM p
UNION ALL SELECT 'Residual', dfr, round(res, 7), round(res / tt, 7), NULL, NULL FROM parts WHERE perm = 0
UNION ALL SELECT 'Total', df0 + df1 + df2 + dfr, round(tt, 7), 1.0, NULL, NULL FROM parts WHERE perm = 0""", "counts samples")
def permanova_two_factors(t):
    out = P.permanova(K.bray_curtis(t.counts()), t.samples(), ["region", "half"], PERMS).drop("place")
    return rounded(rounded(out, 7, "ss", "r2"), 6, "pseudo_f")


@query(_BRAY_TAXA + _LEVEL_PAIRS + _TERMS + """SELECT pair, term, CAST(df AS DOUBLE) AS df, round(ss, 7) AS ss, round(r2, 7) AS r2, round(f, 6) AS pseudo_f, p,
round(least(p * (SELECT count(DISTINCT pair) FROM p), 1.0), 9) AS p_adjusted FROM p""", "counts samples")
def pairwise_permanova_two_factors(t):
    out = P.pairwise_terms(K.bray_curtis(t.counts()), t.samples(), "region", REGIONS, ["half"], PERMS).filter("place < 3").drop("place")
    return rounded(rounded(rounded(out, 7, "ss", "r2"), 6, "pseudo_f"), 9, "p_adjusted")


_PAIRWISE = _BRAY_TAXA + _LEVEL_PAIRS + _TERMS[:_TERMS.index("base AS")] + """
n AS (SELECT pair, count(*) AS n FROM part_of GROUP BY 1),
s AS (SELECT a.pair, a.perm, sum(d * d) AS t, sum(CASE WHEN a.g = b.g THEN d * d / a.ng ELSE 0 END) AS w
 FROM dist JOIN lab a ON a.sample_id = id_a JOIN lab b ON b.sample_id = id_b AND b.pair = a.pair AND b.perm = a.perm GROUP BY 1, 2),
f AS (SELECT s.pair, perm, t / n AS tt, w, (t / n - w) / (w / (n - 2)) AS f FROM s JOIN n ON n.pair = s.pair),
p AS (SELECT o.pair, round(max(o.tt - o.w), 7) AS ss, round(max(1 - o.w / o.tt), 7) AS r2, round(max(o.f), 6) AS pseudo_f,
 (1.0 + count(*) FILTER (x.f >= o.f - 1e-9 * greatest(abs(o.f), 1))) / 1000.0 AS p FROM f o JOIN f x ON x.pair = o.pair AND x.perm > 0 WHERE o.perm = 0 GROUP BY 1)
SELECT pair, ss, r2, pseudo_f, p, round(least(p * (SELECT count(*) FROM p), 1.0), 9) AS p_adjusted FROM p"""


@query(_PAIRWISE, "counts samples")
def pairwise_permanova(t):
    out = P.pairwise_permanova(K.bray_curtis(t.counts()), t.samples(), "region", REGIONS, PERMS)
    return rounded(rounded(rounded(out, 7, "ss", "r2"), 6, "pseudo_f"), 9, "p_adjusted")


_MANTEL = _BRAY_TAXA + _EUCLID.replace("+w", ", w") + """, samples AS (SELECT DISTINCT sample_id FROM counts)
""" + _PERM + """, both_d AS ({both}),
lab AS (SELECT perm, m.sample_id, h.sample_id AS source FROM moved m JOIN numbered h ON h.no = m.place),
mom AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(regr_sxx(x, y) * regr_syy(x, y)) AS sc FROM both_d),
r AS (SELECT a.perm, sum(p.x * q.y) AS xy FROM both_d p JOIN lab a ON a.sample_id = p.id_a JOIN lab b ON b.sample_id = p.id_b AND b.perm = a.perm
 JOIN both_d q ON q.id_a = least(a.source, b.source) AND q.id_b = greatest(a.source, b.source) GROUP BY 1),
c AS (SELECT perm, (xy - n * mx * my) / sc AS r, n FROM r, mom)
SELECT round(r, 8) AS r, (1.0 + (SELECT count(*) FROM c x WHERE x.perm > 0 AND x.r >= c.r - 1e-9)) / 1000.0 AS p, n AS n_pairs FROM c WHERE perm = 0"""
_BOTH = "SELECT b.id_a, b.id_b, b.d AS x, e.d AS y FROM dist b JOIN edist e ON e.id_a = b.id_a AND e.id_b = b.id_b"
_BOTH_RANKED = """SELECT id_a, id_b, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y
FROM (SELECT b.id_a, b.id_b, round(b.d, 10) AS x, round(e.d, 12) AS y FROM dist b JOIN edist e ON e.id_a = b.id_a AND e.id_b = b.id_b)"""


@query(_MANTEL.replace("{both}", _BOTH), "counts site_variables")
def mantel_pearson(t):
    return rounded(P.mantel(K.bray_curtis(t.counts()), _site_distance(t), "pearson", PERMS), 8, "r")


@query(_MANTEL.replace("{both}", _BOTH_RANKED), "counts site_variables")
def mantel_spearman(t):
    # Distances are rounded so that equal ones tie in every engine.
    first, second = rounded(K.bray_curtis(t.counts()), 10, "d"), rounded(_site_distance(t), 12, "d")
    return rounded(P.mantel(first, second, "spearman", PERMS), 8, "r")


def _coords(t):
    """Coordinates of the samples: two of their variables, as the check needs the same ones in both engines."""
    return t.site_variables().select("sample_id", (F.col("disc") * 100).alias("axis1"), (F.col("tax") * 100).alias("axis2"))


_COORDS = "+coords AS (SELECT sample_id, disc * 100 AS axis1, tax * 100 AS axis2 FROM site_variables) "


@query(_COORDS + _PERM + """, sites AS (SELECT c.sample_id, axis1, axis2, qty, price, s_acctbal FROM coords c JOIN site_variables v ON v.sample_id = c.sample_id JOIN samples s ON s.sample_id = c.sample_id),
long AS (UNPIVOT sites ON qty, price, s_acctbal INTO NAME variable VALUE v),
x AS (SELECT m.perm, l.variable, c.axis1, c.axis2, l.v FROM moved m JOIN numbered h ON h.no = m.place JOIN coords c ON c.sample_id = h.sample_id JOIN long l ON l.sample_id = m.sample_id),
s AS (SELECT perm, variable, var_pop(axis1) AS a, var_pop(axis2) AS b, covar_pop(axis1, axis2) AS c, covar_pop(axis1, v) AS u, covar_pop(axis2, v) AS w, var_pop(v) AS vv FROM x GROUP BY 1, 2),
q AS (SELECT perm, variable, (u * b - w * c) / (a * b - c * c) AS b1, (w * a - u * c) / (a * b - c * c) AS b2, u, w, vv FROM s),
f AS (SELECT perm, variable, b1 / sqrt(b1 * b1 + b2 * b2) AS axis1, b2 / sqrt(b1 * b1 + b2 * b2) AS axis2, (b1 * u + b2 * w) / vv AS r2 FROM q)
SELECT o.variable, round(max(o.r2), 8) AS r2, round(max(o.axis1), 6) AS axis1, round(max(o.axis2), 6) AS axis2, (1.0 + count(*) FILTER (x.r2 >= o.r2 - 1e-9)) / 1000.0 AS p,
round(max(o.axis1 * sqrt(o.r2)), 6) AS arrow1, round(max(o.axis2 * sqrt(o.r2)), 6) AS arrow2 FROM f o JOIN f x ON x.variable = o.variable AND x.perm > 0 WHERE o.perm = 0 GROUP BY 1""",
       "site_variables samples")
def envfit_vectors(t):
    env = t.site_variables().select("sample_id", "qty", "price").join(t.samples().select("sample_id", "s_acctbal"), "sample_id")
    out = O.envfit_vectors(_coords(t), env, ["qty", "price", "s_acctbal"], PERMS)
    return rounded(rounded(out, 8, "r2"), 6, "axis1", "axis2", "arrow1", "arrow2")


@query(_COORDS + _PERM + """, lab AS (SELECT perm, h.sample_id, s.region AS g FROM moved m JOIN numbered h ON h.no = m.place JOIN samples s ON s.sample_id = m.sample_id),
i AS (SELECT perm, g, (var_pop(axis1) + var_pop(axis2)) * count(*) AS ss FROM lab JOIN coords c ON c.sample_id = lab.sample_id GROUP BY 1, 2),
tt AS (SELECT (var_pop(axis1) + var_pop(axis2)) * count(*) AS t FROM coords), f AS (SELECT perm, 1 - sum(ss) / max(t) AS r2 FROM i, tt GROUP BY 1)
SELECT 'region' AS factor, round(r2, 8) AS r2, (1.0 + (SELECT count(*) FROM f x WHERE x.perm > 0 AND x.r2 >= f.r2 - 1e-9)) / 1000.0 AS p FROM f WHERE perm = 0""", "site_variables samples")
def envfit_factors(t):
    return rounded(O.envfit_factors(_coords(t), t.samples(), "region", PERMS), 8, "r2")


@query(_COORDS + "SELECT region, round(avg(axis1), 8) AS axis1, round(avg(axis2), 8) AS axis2, count(*) AS n FROM coords JOIN samples USING (sample_id) GROUP BY 1",
       "site_variables samples")
def factor_centroids(t):
    return rounded(O.factor_centroids(_coords(t), t.samples(), "region"), 8, "axis1", "axis2")


@query(_COORDS + """, s AS (SELECT region, avg(axis1) AS m1, avg(axis2) AS m2, var_samp(axis1) AS a, var_samp(axis2) AS b, covar_samp(axis1, axis2) AS c FROM coords JOIN samples USING (sample_id) GROUP BY 1),
k AS (SELECT *, unnest(range(0, 101)) AS point FROM s)
SELECT region, CAST(point AS INTEGER) AS point, round(m1 + sqrt(a) * cos(point * 2 * pi() / 100), 6) AS x,
round(m2 + c / sqrt(a) * cos(point * 2 * pi() / 100) + sqrt(greatest(b - c * c / a, 0)) * sin(point * 2 * pi() / 100), 6) AS y FROM k""", "site_variables samples")
def group_ellipses(t):
    return rounded(O.group_ellipses(_coords(t), t.samples(), "region"), 6, "x", "y")


@query(_COORDS + "SELECT sample_id, round(axis1, 9) AS axis1, round(axis2, 9) AS axis2, region, half FROM coords LEFT JOIN samples USING (sample_id)", "site_variables samples")
def ordination_scores(t):
    return rounded(O.ordination_scores(_coords(t), t.samples().select("sample_id", "region", "half")), 9, "axis1", "axis2")


def _nation_counts(t):
    """Counts per nation, for the iterative ordination."""
    by_nation = t.counts().join(t.supplier.select(F.col("s_suppkey").alias("sample_id"), "s_nationkey"), "sample_id")
    return by_nation.groupBy(F.col("s_nationkey").alias("sample_id"), "taxon_id").agg(F.sum("count").alias("count"))


@query()
def nmds_of_nations(t):
    return O.ordinate_nmds(cut_lineage(K.bray_curtis(_nation_counts(t))))


@query(_BRAY_TAXA + _COORDS.replace("+coords", ", coords") + """, pts AS (SELECT id_a, id_b, round(dist.d, 9) AS d, sqrt((a.axis1 - b.axis1) ** 2 + (a.axis2 - b.axis2) ** 2) AS o
 FROM dist JOIN coords a ON a.sample_id = id_a JOIN coords b ON b.sample_id = id_b),
cell AS (SELECT d, sum(o) AS s, count(*) AS w, row_number() OVER (ORDER BY d) AS i FROM pts GROUP BY d),
cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM cell),
ab AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
low AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ab),
fits AS (SELECT i, max(v) AS fit FROM low GROUP BY i)
SELECT id_a, id_b, pts.d, round(o, 8) AS ord_d, round(fit, 8) AS fit FROM pts JOIN cell ON cell.d = pts.d JOIN fits ON fits.i = cell.i""", "counts site_variables")
def shepard_points(t):
    return rounded(O.shepard(rounded(K.bray_curtis(t.counts()), 9, "d"), _coords(t)), 8, "ord_d", "fit")


_SIZE = """+ns AS (SELECT count(DISTINCT sample_id) AS n FROM counts), geo AS (SELECT taxon_id, avg(ln(count)) AS g FROM counts WHERE count > 0 GROUP BY 1 HAVING count(*) = (SELECT n FROM ns)),
sf AS (SELECT sample_id, exp(quantile_cont(ln(count) - g, 0.5)) AS size_factor FROM counts JOIN geo USING (taxon_id) WHERE count > 0 GROUP BY 1)
"""


def _size_factors(t):
    return A.size_factors(t.counts(), t.counts().select("sample_id").distinct())


@query(_SIZE + "SELECT sample_id, round(size_factor, 8) AS size_factor FROM sf", "counts")
def size_factors(t):
    return rounded(_size_factors(t), 8, "size_factor")


@query(_SIZE + "SELECT taxon_id, round(sum(count / size_factor) / (SELECT n FROM ns), 6) AS base_mean FROM counts JOIN sf USING (sample_id) GROUP BY 1", "counts")
def base_mean(t):
    return rounded(A.base_mean(t.counts(), _size_factors(t)), 6, "base_mean")


def _wald(t):
    factors = cut_lineage(_size_factors(t))
    return A.nb_wald(t.counts(), t.samples(), factors, "region", REGIONS, "0")


@query()
def dispersion_estimates(t):
    return A.dispersion(t.counts(), t.samples(), cut_lineage(_size_factors(t)), "region", REGIONS)


@query()
def nb_wald_contrasts(t):
    return _wald(t)


@query()
def nb_wald_selected_contrast(t):
    return A.select_contrast(_wald(t), "region_3_vs_0")


@query()
def significant_taxa(t):
    results = A.independent_filter(cut_lineage(_wald(t)), alpha=0.5)
    return A.significant_taxa(results, t.taxonomy(), alpha=0.5)
