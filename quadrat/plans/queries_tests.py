"""Queries for grouped tests, models and p value adjustment."""

from pyspark.sql import functions as F

from quadrat.functions.tails import normal_quantile_sql
from quadrat.operators import hypothesis as H
from quadrat.operators import models as M
from quadrat.plans.quadrature import f_tail, normal_tail, range_tail, t_tail
from quadrat.plans.registry import query, rounded
from quadrat.plans.study import TIMES, change_with_baseline

UNIT = ["unit", "param", "treatment"]
LEVELS = ["HI", "LO", "NO"]

_W = f"""WITH s AS (SELECT user_id, event_type, value AS x, row_number() OVER w AS i, count(*) OVER g AS n FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value), g AS (PARTITION BY user_id, event_type)),
m AS (SELECT *, {normal_quantile_sql("((i - 0.375) / (n + 0.25))")} AS m FROM s),
a AS (SELECT user_id, event_type, max(n) AS n, var_samp(x) AS v, sum(m * x) AS mx, sum(m * m) AS mm, max(m) AS mn,
 max(CASE WHEN i = n - 1 THEN m END) AS mo, max(CASE WHEN i = n THEN x END) - max(CASE WHEN i = 1 THEN x END) AS d1,
 max(CASE WHEN i = n - 1 THEN x END) - max(CASE WHEN i = 2 THEN x END) AS d2 FROM m GROUP BY 1, 2),
b AS (SELECT *, mn / sqrt(mm) + 0.221157 / sqrt(n) - 0.147981 / n - 2.071190 / pow(sqrt(n), 3) + 4.434685 / pow(sqrt(n), 4) - 2.706056 / pow(sqrt(n), 5) AS an,
 mo / sqrt(mm) + 0.042981 / sqrt(n) - 0.293762 / n - 1.752461 / pow(sqrt(n), 3) + 5.682633 / pow(sqrt(n), 4) - 3.582633 / pow(sqrt(n), 5) AS ao FROM a WHERE n >= 3 AND v > 0),
c AS (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) * d1
 WHEN n > 5 THEN (mx - mn * d1 - mo * d2) / sqrt((mm - 2 * mn * mn - 2 * mo * mo) / (1 - 2 * an * an - 2 * ao * ao)) + an * d1 + ao * d2
 ELSE (mx - mn * d1) / sqrt((mm - 2 * mn * mn) / (1 - 2 * an * an)) + an * d1 END AS line FROM b)
SELECT a.user_id, a.event_type, a.n, round(least(line * line / ((c.n - 1) * c.v), 1), 6) AS w FROM a
LEFT JOIN c ON c.user_id = a.user_id AND c.event_type = a.event_type"""


@query(_W)
def shapiro_statistic(t):
    return rounded(H.shapiro(t.events, ["user_id", "event_type"], "value", p_value=False), 6, "w")


@query(_W.replace("user_id, event_type, value AS x", "l_returnflag, l_extendedprice AS x").replace("user_id, event_type", "l_returnflag").replace("FROM events", "FROM lineitem")
       .replace("ORDER BY value", "ORDER BY l_extendedprice").replace("GROUP BY 1, 2", "GROUP BY 1").replace("a.user_id, a.event_type", "a.l_returnflag")
       .replace("c.user_id = a.user_id AND c.event_type = a.event_type", "c.l_returnflag = a.l_returnflag"))
def shapiro_whole_lineitem(t):
    return rounded(H.shapiro(t.lineitem, ["l_returnflag"], "l_extendedprice", p_value=False), 6, "w")


_SHAPIRO_Z = """SELECT *, CASE WHEN n <= 11 THEN (-ln(-2.273 + 0.459 * n - ln(1 - w)) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
 ELSE (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * pow(ln(n), 2) + 0.0038915 * pow(ln(n), 3))) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * pow(ln(n), 2)) END AS z FROM w"""


@query("WITH w AS (" + _W.replace("round(least(line * line / ((c.n - 1) * c.v), 1), 6) AS w", "least(line * line / ((c.n - 1) * c.v), 1) AS w") + "), z AS (" + _SHAPIRO_Z + f""")
SELECT user_id, event_type, n, round(w, 6) AS w, round(CASE WHEN n = 3 THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0) WHEN n <= 5000 THEN {normal_tail('z')} END, 5) AS p FROM z""")
def shapiro_with_p(t):
    return rounded(rounded(H.shapiro(t.events, ["user_id", "event_type"], "value"), 6, "w"), 5, "p")


@query(f"""+r AS (SELECT treatment, value, row_number() OVER (PARTITION BY treatment ORDER BY value) AS i, count(*) OVER (PARTITION BY treatment) AS n FROM measures),
p AS (SELECT *, CASE WHEN n <= 10 THEN (i - 0.375) / (n + 0.25) ELSE (i - 0.5) / n END AS p FROM r)
SELECT treatment, round({normal_quantile_sql("p")}, 7) + 0.0 AS theoretical, round(value, 9) AS sample FROM p""", "measures")
def qq_points(t):
    return rounded(rounded(H.qq_points(t.measures(), ["treatment"], "value"), 7, "theoretical"), 9, "sample")


@query("""SELECT event_type, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.3489795003921634, 6) AS slope,
round((quantile_cont(value, 0.75) + quantile_cont(value, 0.25)) / 2, 6) AS intercept FROM events GROUP BY 1""")
def qq_line(t):
    return rounded(H.qq_line(t.events, ["event_type"], "value"), 6, "slope", "intercept")


_T = """WITH s AS (SELECT l_linestatus, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2,
count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2,
var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1)
SELECT l_linestatus, n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 7) + 0.0 AS t,
round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM s"""


@query(_T)
def welch_t_statistic(t):
    out = H.t_test_welch(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "R"], "l_extendedprice", p_value=False)
    return rounded(rounded(out, 4, "mean1", "mean2", "df"), 7, "t")


@query(f"WITH q AS ({_T}) SELECT *, round({t_tail('t', 'df')}, 5) AS p FROM q")
def welch_t_with_p(t):
    out = H.t_test_welch(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "R"], "l_extendedprice")
    return rounded(rounded(rounded(out, 4, "mean1", "mean2", "df"), 7, "t"), 5, "p")


_RANKS = """WITH r AS (SELECT l_linestatus AS g, l_returnflag AS k, rank() OVER w + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2 AS r,
count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) AS t, count(*) OVER (PARTITION BY l_linestatus) AS n
FROM lineitem{where} WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_extendedprice))
"""


_RANK_SUM = _RANKS.replace("{where}", " WHERE l_returnflag IN ('A', 'R')") + """SELECT g AS l_linestatus, count(*) FILTER (k = 'A') AS n1, count(*) FILTER (k = 'R') AS n2,
round(sum(r) FILTER (k = 'A') - count(*) FILTER (k = 'A') * (count(*) FILTER (k = 'A') + 1) / 2, 1) AS w, round(sum(t * t - 1.0::DOUBLE), 1) AS tie_term FROM r GROUP BY 1"""


@query(_RANK_SUM)
def wilcoxon_statistic(t):
    out = H.wilcoxon_rank_sum(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "R"], "l_extendedprice", p_value=False)
    return rounded(out, 1, "w", "tie_term")


@query(f"""WITH q AS ({_RANK_SUM}), z AS (SELECT *, (abs(w - n1 * n2 / 2.0) - CASE WHEN w = n1 * n2 / 2.0 THEN 0 ELSE 0.5 END)
 / sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - tie_term / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM q)
SELECT l_linestatus, n1, n2, w, tie_term, 'normal' AS method, round(2 * {normal_tail('z')}, 5) AS p FROM z""")
def wilcoxon_with_p(t):
    out = H.wilcoxon_rank_sum(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "R"], "l_extendedprice", exact=False)
    return rounded(rounded(out, 1, "w", "tie_term"), 5, "p")


@query("""+r AS (SELECT param, time, treatment, rank() OVER (PARTITION BY param, time ORDER BY value) + (count(*) OVER (PARTITION BY param, time, value) - 1) / 2 AS r,
count(*) OVER (PARTITION BY param, time, value) AS t, count(*) OVER (PARTITION BY param, time) AS n FROM rounded_measures),
g AS (SELECT param, time, treatment, n, sum(r) AS rs, count(*) AS k FROM r GROUP BY ALL), c AS (SELECT param, time, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY ALL),
h AS (SELECT g.param, g.time, n, (12.0::DOUBLE / (n * (n + 1.0::DOUBLE)) * sum(rs * rs / k) - 3 * (n + 1)) / (1 - max(ties) / (n::DOUBLE * n * n - n)) AS h
FROM g JOIN c ON c.param = g.param AND c.time = g.time GROUP BY g.param, g.time, n)
SELECT param, time, n, round(h, 6) AS h, CAST(2 AS INTEGER) AS df, round(exp(-h / 2), 6) AS p FROM h""", "rounded_measures")
def kruskal_by_time(t):
    m = t.measures().withColumn("value", F.round("value", 9))
    return rounded(H.kruskal_wallis(m, ["param", "time"], "treatment", LEVELS, "value"), 6, "h", "p")


@query(_RANKS.replace("{where}", "") + """, g AS (SELECT g, k, n, sum(r) AS rs, count(*) AS c FROM r GROUP BY ALL), c AS (SELECT g, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY 1)
SELECT g.g AS l_linestatus, n, round((12.0::DOUBLE / (n * (n + 1.0::DOUBLE)) * sum(rs * rs / c) - 3 * (n + 1)) / (1 - max(ties) / (n::DOUBLE * n * n - n)), 4) AS h, CAST(2 AS INTEGER) AS df
FROM g JOIN c ON c.g = g.g GROUP BY g.g, n""")
def kruskal_whole_lineitem(t):
    return rounded(H.kruskal_wallis(t.lineitem, ["l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_extendedprice", p_value=False), 4, "h")


_CELLS = """+cells AS (SELECT param, "Time", treatment, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM pooled_change GROUP BY 1, 2, 3),
f AS (SELECT param, sum(ss) AS rss, sum(n) - count(*) AS dfr, sum(n) AS n FROM cells GROUP BY 1)
"""


@query(_CELLS + """, tot AS (SELECT param, var_pop(value) * count(*) AS null_ss FROM pooled_change GROUP BY 1)
SELECT f.param, round(rss, 2) AS deviance, round(null_ss, 2) AS null_deviance, round(null_ss - rss, 2) AS diff, CAST(n - 1 AS BIGINT) AS df_null,
CAST(dfr AS BIGINT) AS df_residual, round(rss / dfr, 4) AS sigma2 FROM f JOIN tot ON tot.param = f.param""", "pooled_change")
def linear_model_fit(t):
    out = M.linear_model(change_with_baseline(t.measures(36), UNIT), ["param"], ["Time", "treatment"], "value")
    return rounded(rounded(out, 2, "deviance", "null_deviance", "diff"), 4, "sigma2")


_BALANCED = """+g AS (SELECT param, avg(value) AS m FROM pooled_change GROUP BY 1),
e AS (SELECT param, term, sum(n * (m - gm) * (m - gm)) AS ss, count(*) - 1 AS df FROM (
 SELECT p.param, 'Time' AS term, p."Time" AS l, count(*) AS n, avg(value) AS m, max(g.m) AS gm FROM pooled_change p JOIN g ON g.param = p.param GROUP BY 1, 2, 3
 UNION ALL SELECT p.param, 'treatment', p.treatment, count(*), avg(value), max(g.m) FROM pooled_change p JOIN g ON g.param = p.param GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT p.param, p."Time", p.treatment, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss, max(g.m) AS gm FROM pooled_change p JOIN g ON g.param = p.param GROUP BY 1, 2, 3),
f AS (SELECT param, sum(ss) AS rss, sum(n) - count(*) AS dfr, sum(n * (m - gm) * (m - gm)) AS ssm FROM c GROUP BY 1),
x AS (SELECT param, term, ss, df FROM e UNION ALL
 SELECT f.param, 'Time:treatment', ssm - sum(ss), max(CASE WHEN term = 'Time' THEN df END) * max(CASE WHEN term = 'treatment' THEN df END) FROM f JOIN e ON e.param = f.param GROUP BY f.param, ssm)
SELECT x.param, term, CAST(df AS BIGINT) AS df, round(ss, 2) AS ss, round(ss / df / (rss / dfr), 6) AS fstat FROM x JOIN f ON f.param = x.param"""


@query(_BALANCED, "pooled_change")
def anova_balanced(t):
    out = M.anova(change_with_baseline(t.measures(36), UNIT), ["param"], ["Time", "treatment"], "value").drop("pval")
    return rounded(rounded(out, 2, "ss"), 6, "fstat")


@query(_BALANCED.replace("SELECT x.param, term,", ", q AS (SELECT x.param, term, dfr,") + f") SELECT param, term, df, ss, fstat, round({f_tail('fstat', 'df', 'dfr')}, 5) AS pval FROM q", "pooled_change")
def anova_balanced_with_p(t):
    out = M.anova(change_with_baseline(t.measures(36), UNIT), ["param"], ["Time", "treatment"], "value")
    return rounded(rounded(rounded(out, 2, "ss"), 6, "fstat"), 5, "pval")


@query("""WITH l AS (SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS y, p_type AS g FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT g, a, b, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM l GROUP BY 1, 2, 3),
t AS (SELECT g, sum(n) AS n, sum(n * m) / sum(n) AS m, sum(ss) AS rss, count(*) AS k FROM c GROUP BY 1),
a AS (SELECT c.g, a, sum(c.n) AS n, sum(c.n * c.m) / sum(c.n) AS m, max(t.m) AS gm, count(*) AS k,
 max(CASE WHEN b = 'F' THEN c.n END) AS nf, max(CASE WHEN b = 'O' THEN c.n END) AS no, max(CASE WHEN b = 'F' THEN c.m END) AS mf, max(CASE WHEN b = 'O' THEN c.m END) AS mo
 FROM c JOIN t ON t.g = c.g GROUP BY c.g, a),
s AS (SELECT g, sum(n * (m - gm) * (m - gm)) AS ss_a, count(*) - 1 AS df_a, pow(sum(nf * no / n * (mo - mf)), 2) / sum(nf * no / n) AS ss_b FROM a GROUP BY 1),
m AS (SELECT c.g, sum(c.n * (c.m - t.m) * (c.m - t.m)) AS ssm FROM c JOIN t ON t.g = c.g GROUP BY 1),
x AS (SELECT g, 'l_returnflag' AS term, ss_a AS ss, df_a AS df FROM s UNION ALL SELECT g, 'l_linestatus', ss_b, 1 FROM s
 UNION ALL SELECT s.g, 'l_returnflag:l_linestatus', ssm - ss_a - ss_b, df_a FROM s JOIN m ON m.g = s.g)
SELECT x.g AS p_type, term, CAST(df AS BIGINT) AS df, round(ss, 4) AS ss, round(ss / df / (rss / (n - k)), 6) AS fstat FROM x JOIN t ON t.g = x.g""")
def anova_unbalanced_lineitem(t):
    lines = t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    out = M.anova(lines, ["p_type"], ["l_returnflag", "l_linestatus"], "l_quantity").drop("pval")
    return rounded(rounded(out, 4, "ss"), 6, "fstat")


@query()
def anova_with_p(t):
    return M.anova(change_with_baseline(t.measures(), UNIT), ["param"], ["Time", "treatment"], "value")


@query("""+c AS (SELECT param, "Time", treatment, avg(value) AS fitted FROM pooled_change GROUP BY 1, 2, 3)
SELECT p.unit, p.param, p.treatment, p."Time", round(fitted, 4) AS fitted, round(value - fitted, 4) + 0.0 AS residual
FROM pooled_change p JOIN c ON c.param = p.param AND c."Time" = p."Time" AND c.treatment = p.treatment""", "pooled_change")
def model_residuals(t):
    out = M.residuals(change_with_baseline(t.measures(36), UNIT), ["param"], ["Time", "treatment"], "value")
    return rounded(out, 4, "fitted", "residual").drop("value")


_CONTRASTS = _CELLS + """, o AS (SELECT *, CASE "Time" WHEN 'diff_1WK' THEN 1 WHEN 'diff_24H' THEN 2 WHEN 'diff_4WK' THEN 3 ELSE 4 END AS o FROM cells)
SELECT a.param, a.treatment, a."Time" || ' - ' || b."Time" AS contrast, round(a.m - b.m, 4) + 0.0 AS estimate, round(sqrt(rss / dfr * (1.0 / a.n + 1.0 / b.n)), 4) AS se,
CAST('inf' AS DOUBLE) AS df, round((a.m - b.m) / sqrt(rss / dfr * (1.0 / a.n + 1.0 / b.n)), 6) + 0.0 AS ratio
FROM o a JOIN o b ON b.param = a.param AND b.treatment = a.treatment AND a.o < b.o JOIN f ON f.param = a.param"""


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS ss FROM orders GROUP BY 1, 2),
e AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2, sum(n) - count(*) AS dfr FROM c), r AS (SELECT n AS n0, m AS m0 FROM c WHERE a = 'F' AND b = '1-URGENT'),
k AS (SELECT '(Intercept)' AS term, m0 AS estimate, 1.0 / n0 AS v FROM r
 UNION ALL SELECT 'o_orderstatus[' || a || ']', m - m0, 1.0 / n + 1.0 / n0 FROM c, r WHERE a <> 'F' AND b = '1-URGENT'
 UNION ALL SELECT 'o_orderpriority[' || b || ']', m - m0, 1.0 / n + 1.0 / n0 FROM c, r WHERE a = 'F' AND b <> '1-URGENT'
 UNION ALL SELECT 'o_orderstatus[' || c.a || ']:o_orderpriority[' || c.b || ']', c.m - x.m - y.m + m0, 1.0 / c.n + 1.0 / x.n + 1.0 / y.n + 1.0 / n0
  FROM c JOIN c x ON x.a = c.a AND x.b = '1-URGENT' JOIN c y ON y.a = 'F' AND y.b = c.b, r WHERE c.a <> 'F' AND c.b <> '1-URGENT')
SELECT term, round(estimate, 3) AS estimate, round(sqrt(v * s2), 3) AS se, round(estimate / sqrt(v * s2), 6) AS t, round({t_tail('estimate / sqrt(v * s2)', 'dfr')}, 5) AS p FROM k, e""")
def coefficient_table(t):
    out = M.coefficients(t.orders, [], ["o_orderstatus", "o_orderpriority"], "o_totalprice", {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": _PRIORITIES})
    return rounded(rounded(rounded(out, 3, "estimate", "se"), 6, "t"), 5, "p").drop("place")


@query(_CONTRASTS, "pooled_change")
def emmeans_contrasts(t):
    times = ["diff_1WK", "diff_24H", "diff_4WK", "PRE"]
    out = M.emmeans_pairwise(change_with_baseline(t.measures(36), UNIT), ["param"], "Time", "treatment", times, "value", p_value=False)
    return rounded(rounded(out, 4, "estimate", "se"), 6, "ratio")


@query(_CONTRASTS.replace("SELECT a.param, a.treatment,", ", q AS (SELECT a.param, a.treatment, (a.m - b.m) / sqrt(rss / dfr * (1.0 / a.n + 1.0 / b.n)) AS whole,")
       + f") SELECT * EXCLUDE whole, round({range_tail('abs(whole) * sqrt(2)', 4)}, 5) AS p FROM q", "pooled_change")
def emmeans_pooled_with_p(t):
    times = ["diff_1WK", "diff_24H", "diff_4WK", "PRE"]
    out = M.emmeans_pairwise(change_with_baseline(t.measures(36), UNIT), ["param"], "Time", "treatment", times, "value")
    return rounded(rounded(rounded(out, 4, "estimate", "se"), 6, "ratio"), 5, "p")


@query()
def emmeans_contrasts_with_p(t):
    data = change_with_baseline(t.measures(), UNIT)
    return M.emmeans_pairwise(data, ["param"], "treatment", "Time", LEVELS, "value")


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS ss FROM orders GROUP BY 1, 2),
e AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2, sum(n) - count(*) AS dfr FROM c), m AS (SELECT o_orderstatus AS l, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1)
SELECT b.l || '-' || a.l AS contrast, round(b.m - a.m, 3) AS diff, round(sqrt(s2 / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS se, CAST(dfr AS BIGINT) AS df
FROM m a JOIN m b ON a.l < b.l JOIN e ON true""")
def tukey_differences(t):
    out = M.tukey_hsd(t.orders, [], ["o_orderstatus", "o_orderpriority"], "o_totalprice", "o_orderstatus", ["F", "O", "P"], p_value=False)
    return rounded(rounded(out, 3, "diff"), 4, "se")


@query()
def tukey_intervals(t):
    return M.tukey_hsd(t.orders, [], ["o_orderstatus", "o_orderpriority"], "o_totalprice", "o_orderpriority",
                       ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


_REG = """WITH s AS (SELECT l_suppkey, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1) """


_SLOPES = _REG + """SELECT l_suppkey, CAST(n AS BIGINT) AS n, round(b, 5) AS slope, round(a, 3) AS intercept, round(r2, 7) AS r2, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) + 0.0 AS t FROM s"""


@query(_SLOPES)
def simple_regression(t):
    out = H.simple_regression(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", p_value=False)
    return rounded(rounded(rounded(out, 5, "slope", "t"), 3, "intercept"), 7, "r2")


@query("WITH q AS (" + _SLOPES.replace(" AS t FROM s", " AS t, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS whole FROM s") + f") SELECT * EXCLUDE whole, round({t_tail('whole', '(n - 2)')}, 5) AS p FROM q")
def simple_regression_with_p(t):
    out = H.simple_regression(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(rounded(rounded(rounded(out, 5, "slope", "t"), 3, "intercept"), 7, "r2"), 5, "p")


@query()
def regression_band(t):
    return H.regression_band(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")


# The adjustment queries take a share as the p value: every engine agrees on it to the last digit.
_P = "WITH p AS (SELECT o_orderkey, o_orderpriority AS g, round(o_totalprice, -2) / 10000000 AS p FROM orders) "


def _p_values(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.round("o_totalprice", -2) / 10000000).alias("p"))


@query(_P + """, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY g) AS m FROM p)
SELECT o_orderkey, g, p, round(least(min(p * m / (m - k + 1)) OVER (PARTITION BY g ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0), 9) AS padj FROM r""")
def adjust_benjamini_hochberg(t):
    return rounded(H.p_adjust(_p_values(t), ["g"], "p", "BH"), 9, "padj")


@query(_P + "SELECT o_orderkey, g, p, round(least(p * count(*) OVER (PARTITION BY g), 1.0), 9) AS padj FROM p")
def adjust_bonferroni(t):
    return rounded(H.p_adjust(_p_values(t), ["g"], "p", "bonferroni"), 9, "padj")


@query(_P + "SELECT o_orderkey, p, CASE WHEN p <= 0.01 THEN 'sig' ELSE 'not sig' END AS significant FROM p")
def significance_flag(t):
    return H.significance_flag(_p_values(t).drop("g"), "p", 0.01)
