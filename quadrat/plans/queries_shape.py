"""Queries for scans, projections, reshaping, lookups, change and summaries."""

from pyspark.sql import functions as F

from quadrat.functions.semantics import natural_log, shifted_log
from quadrat.operators import change as C
from quadrat.operators import summary as S
from quadrat.operators import wrangle as W
from quadrat.plans.registry import query, rounded
from quadrat.plans.study import TIMES, change_summary, change_with_baseline
from quadrat.session import shared_folder
from quadrat.sources.tables import clean_keys, scan_parquet, scan_tsv, write_parquet, write_tsv

UNIT = ["unit", "param", "treatment"]
PARAMS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, o_totalprice FROM orders")
def text_written_and_read(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), "o_totalprice")
    path = shared_folder(t.spark, "text")
    write_tsv(df, path)
    return scan_tsv(t.spark, path, df.schema)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2")
def parquet_written_and_read(t):
    path = shared_folder(t.spark, "tables")
    write_parquet(t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice"), f"{path}/lines.parquet")
    return scan_parquet(t.spark, path, "lines").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT l_suppkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_discount > 0.05 GROUP BY l_suppkey")
def scan_filtered_lines(t):
    return t.lineitem.filter("l_discount > 0.05").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"))


@query(r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"k"\s*:\s*"?([^",}]*)', 1) AS INTEGER) AS k FROM events
WHERE TRY_CAST(regexp_extract(props, '"k"\s*:\s*"?([^",}]*)', 1) AS INTEGER) IS NOT NULL""")
def clean_lookup_keys(t):
    return clean_keys(t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), "k")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(t):
    return W.drop_columns(t.orders, "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("SELECT c_custkey AS customer, c_acctbal AS balance, c_nationkey FROM customer")
def rename_columns(t):
    return W.rename(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), customer="c_custkey", balance="c_acctbal")


@query("SELECT p_partkey, 'fungi_' || regexp_replace(p_brand, '^Brand#', '') AS p_brand FROM part")
def prefix_taxon_names(t):
    return W.prefix_names(t.part.select("p_partkey", "p_brand"), "p_brand", "fungi_", "^Brand#")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000""")
def filter_rows(t):
    kept = W.keep_values(t.orders, "o_orderstatus", ["F"], negate=True)
    return W.keep_values(kept, "o_orderpriority", ["1-URGENT", "2-HIGH"]).filter("o_totalprice >= 100000").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("SELECT p_partkey, p_type FROM part WHERE contains('ECONOMY and SMALL goods', p_type)")
def filter_found_in_constant(t):
    return W.keep_found_in(t.part.select("p_partkey", "p_type"), "p_type", "ECONOMY and SMALL goods")


@query("SELECT event_id, round(ln(value - 10), 6) AS ln_value FROM events WHERE value > 10")
def filter_non_null(t):
    logged = t.events.select("event_id", natural_log(F.col("value") - 10).alias("ln_value"))
    return rounded(W.keep_complete(logged, "ln_value"), 6, "ln_value")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer")
def split_composite_key(t):
    return W.split_key(t.customer.select("c_custkey", "c_name"), "c_name", {1: "kind", 2: "number"}, "#").drop("c_name")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'middle' END AS band,
o_totalprice / 1000 + 1 AS thousands FROM orders""")
def derive_and_case(t):
    band = W.case_when([(F.col("o_totalprice") > 400000, F.lit("high")), (F.col("o_totalprice") > 200000, F.lit("middle"))])
    return t.orders.select("o_orderkey", band.alias("band"), (F.col("o_totalprice") / 1000 + 1).alias("thousands"))


@query("""SELECT CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'signup' THEN 'JOIN' ELSE event_type END AS event_type,
count(*) AS n FROM events GROUP BY 1""")
def recode_levels(t):
    return W.recode(t.events, "event_type", {"purchase": "BUY", "signup": "JOIN"}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS BIGINT) AS ord,
count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY ord NULLS FIRST, 1""")
def ordered_levels(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return W.order_levels(counts, "o_orderpriority", ["5-LOW", "2-HIGH", "1-URGENT"]).withColumn(
        "ord", F.col("ord").cast("long")).orderBy("ord", "o_orderpriority")


@query("""+long AS (UNPIVOT site_variables ON qty, disc, tax, price INTO NAME param VALUE value)
SELECT sample_id, param, round(value, 9) AS value FROM long""", "site_variables")
def unpivot_site_variables(t):
    return rounded(W.unpivot(t.site_variables(), ["sample_id"], ["qty", "disc", "tax", "price"]), 9, "value")


@query("""SELECT unit, param, treatment, round(max(CASE WHEN time = 'PRE' THEN value END), 9) AS "T_PRE",
round(max(CASE WHEN time = '24H' THEN value END), 9) AS "T_24H", round(max(CASE WHEN time = '1WK' THEN value END), 9) AS "T_1WK",
round(max(CASE WHEN time = '4WK' THEN value END), 9) AS "T_4WK" FROM measures GROUP BY 1, 2, 3""", "measures")
def pivot_times(t):
    wide = W.pivot(t.measures(), UNIT, "time", TIMES, ["value"], prefix="T_")
    return rounded(wide, 9, *[f"T_{x}" for x in TIMES])


@query("""+s AS (SELECT treatment, param, avg(value) AS mean, sqrt(var_samp(value) / count(*)) AS se FROM measures GROUP BY 1, 2)
SELECT treatment, """ + ", ".join(f"round(max(CASE WHEN param = '{p}' THEN {v} END), 9) AS {v}_{p}" for v in ("mean", "se") for p in PARAMS) + """
FROM s GROUP BY 1""", "measures")
def pivot_two_values(t):
    stats = S.mean_se(t.measures(), ["treatment", "param"], {"value": ""})
    wide = W.pivot(stats, ["treatment"], "param", PARAMS, ["mean", "se"])
    return rounded(wide, 9, *[f"{v}_{p}" for v in ("mean", "se") for p in PARAMS])


@query("""SELECT unit, param, treatment, "Time", round(value, 4) AS value FROM pooled_change""", "pooled_change")
def change_with_constant_baseline(t):
    return rounded(change_with_baseline(t.measures(36), UNIT), 4, "value")


@query("""+d AS (SELECT DISTINCT taxon_id FROM counts)
SELECT taxon_id, 'ASV' || row_number() OVER (ORDER BY md5(taxon_id), taxon_id) AS asv FROM d""", "counts")
def surrogate_taxon_ids(t):
    return W.surrogate_ids(t.counts(), "taxon_id", "asv")


@query("""SELECT p_partkey, coalesce(q, 0.0) AS qty FROM part LEFT JOIN
(SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) ON l_partkey = p_partkey""")
def complete_missing_samples(t):
    some = t.lineitem.filter("l_discount >= 0.1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"))
    return W.complete_samples(some, t.part, "p_partkey", ["qty"])


@query("""SELECT unit, param, treatment, "diffTimeSeries", round(value, 4) AS value FROM change""", "change")
def percent_change(t):
    out = C.percent_change(t.measures(), UNIT, "time", TIMES, "PRE", ["value"])
    return rounded(out.filter("value IS NOT NULL"), 4, "value")


@query("""SELECT treatment, param, "diffTimeSeries", round(avg(value), 4) AS mean, round(sqrt(var_samp(value) / count(*)), 4) AS se
FROM change GROUP BY 1, 2, 3""", "change")
def percent_change_summary(t):
    return rounded(change_summary(t.measures(), UNIT, ["treatment", "param"]), 4, "mean", "se")


@query("""SELECT unit, param, "Time", round(ln(1 + (value + 101)), 6) AS logvalue FROM pooled_change""", "pooled_change")
def shifted_log_change(t):
    out = change_with_baseline(t.measures(36), UNIT)
    return rounded(out.select("unit", "param", "Time", shifted_log("value").alias("logvalue")), 6, "logvalue")


@query("SELECT unit, time, " + ", ".join(f"round(max(CASE WHEN param = '{p}' THEN ln(value) END), 6) AS ln{p}" for p in PARAMS)
       + " FROM measures GROUP BY 1, 2", "measures")
def log_wide(t):
    out = C.log_wide(t.measures(), ["unit", "time"], "param", "value", PARAMS)
    return rounded(out, 6, *[f"ln{p}" for p in PARAMS])


@query("""+w AS (SELECT unit, param, treatment, max(CASE WHEN time = '24H' THEN value END) AS a, max(CASE WHEN time = '4WK' THEN value END) AS b FROM measures GROUP BY 1, 2, 3)
SELECT unit, param, treatment, round(b - a, 9) AS recov, round((b - a) / 28, 9) AS recovday FROM w""", "measures")
def recovery_rate(t):
    return rounded(C.recovery(t.measures(), UNIT, "time", "value", "24H", "4WK", 28), 9, "recov", "recovday")


@query("""+w AS (SELECT unit, param, treatment, max(CASE WHEN time = 'PRE' THEN value END) AS a, max(CASE WHEN time = '24H' THEN value END) AS b FROM measures GROUP BY 1, 2, 3),
u AS (SELECT treatment, param, (b - a) / a * 100 AS ut FROM w)
SELECT treatment, param, round(avg(ut), 4) AS avg, round(sqrt(var_samp(ut) / count(*)), 4) AS se, count(ut) AS n FROM u GROUP BY 1, 2""", "measures")
def utilisation(t):
    return rounded(C.utilisation(t.measures(), UNIT, ["treatment", "param"], "time", "value", "PRE", "24H"), 4, "avg", "se")


@query("""SELECT m.unit, m.param, m.treatment, m.time, round(m.value, 9) AS value, round(b.value, 9) AS "T_PRE"
FROM measures m LEFT JOIN measures b ON b.unit = m.unit AND b.param = m.param AND b.time = 'PRE' WHERE m.time <> 'PRE'""", "measures")
def baseline_as_covariate(t):
    return rounded(C.baseline_covariate(t.measures(), UNIT, "time", "value", "PRE"), 9, "value", "T_PRE")


@query("""+w AS (SELECT unit, time, max(CASE WHEN param = 'click' THEN value END) AS a, max(CASE WHEN param = 'view' THEN value END) AS b,
max(CASE WHEN param = 'signup' THEN value END) AS c, max(CASE WHEN param = 'error' THEN value END) AS d, max(CASE WHEN param = 'purchase' THEN value END) AS p
FROM pooled GROUP BY 1, 2)
SELECT unit, time, round(a + b, 9) AS "Ccycl", round(c + d, 9) AS "Ncycl", round((a + b) / (c + d), 9) AS "CNrat", round((a + b + 1) / (p + 1), 9) AS "CP",
round((c + d + 1) / (p + 1), 9) AS "NP", round((a + b) / p, 9) AS "CDOC", round((c + d) / a, 9) AS "NDON", round((a + b) / p / ((c + d) / a), 9) AS "CdocNdon" FROM w""", "pooled")
def composite_ratios(t):
    wide = W.pivot(t.measures(36), ["unit", "time"], "param", ["click", "view", "signup", "error", "purchase"], ["value"])
    out = C.composite_ratios(wide, ["click", "view"], ["signup", "error"], "purchase", "purchase", "click")
    names = ["Ccycl", "Ncycl", "CNrat", "CP", "NP", "CDOC", "NDON", "CdocNdon"]
    return rounded(out.select("unit", "time", *names), 9, *names)


@query("""SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def lookup_chain(t):
    out = W.lookup(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    out = W.lookup(out, t.nation, {"c_nationkey": "n_nationkey"})
    return W.lookup(out, t.region, {"n_regionkey": "r_regionkey"}).select("o_orderkey", "n_name", "r_name")


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, r.returned FROM lineitem l LEFT JOIN
(SELECT l_partkey, l_suppkey, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r
ON r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey""")
def lookup_compound_key(t):
    keys = ["l_partkey", "l_suppkey"]
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("returned"))
    return W.lookup(t.lineitem.select("l_orderkey", "l_linenumber", *keys), back, keys)


@query("""+w AS (SELECT unit, treatment, time, avg(value) AS overall FROM measures GROUP BY 1, 2, 3)
SELECT m.unit, m.treatment, m.time, m.param, round(m.value, 9) AS value, round(w.overall, 9) AS overall
FROM measures m JOIN w ON w.unit = m.unit AND w.treatment = m.treatment AND w.time = m.time""", "measures")
def inner_join_several_keys(t):
    keys = ["unit", "treatment", "time"]
    overall = t.measures().groupBy(*keys).agg(F.avg("value").alias("overall"))
    return rounded(t.measures().join(overall, keys), 9, "value", "overall")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return W.keep_matching(t.customer.select("c_custkey", "c_mktsegment"), big, ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(t):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return W.keep_unmatched(t.customer.select("c_custkey", "c_mktsegment"), big, ["c_custkey"])


@query("""SELECT s.sample_id, region, half, s_acctbal, round(qty, 6) AS qty, round(price, 3) AS price FROM samples s
JOIN site_variables v ON v.sample_id = s.sample_id""", "samples site_variables")
def keyed_column_bind(t):
    return rounded(rounded(W.bind_columns(t.samples(), t.site_variables().select("sample_id", "qty", "price"), "sample_id"), 6, "qty"), 3, "price")


@query("""SELECT treatment, time, param, round(avg(value), 3) AS mean, round(sqrt(var_samp(value) / count(*)), 3) AS se FROM measures GROUP BY 1, 2, 3""", "measures")
def group_mean_se(t):
    return rounded(S.mean_se(t.measures(), ["treatment", "time", "param"], {"value": ""}), 3, "mean", "se")


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS sd FROM lineitem GROUP BY 1, 2""")
def group_mean_sd(t):
    return rounded(S.mean_sd(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), 3, "mean", "sd")


@query("""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median,
round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr FROM lineitem GROUP BY 1, 2""")
def group_median_iqr(t):
    return rounded(S.median_iqr(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4, "median", "iqr")


_BOX = """WITH q AS (SELECT event_type, count(value) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q1, median(value) AS median,
quantile_cont(value, 0.75) AS q3, max(value) AS max FROM events GROUP BY 1),
f AS (SELECT e.*, q1 - 1.5 * (q3 - q1) <= value AND value <= q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
"""


@query(_BOX + """, w AS (SELECT event_type, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY 1)
SELECT event_type, n, round(min, 5) AS min, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, round(max, 5) AS max,
round(whisker_low, 5) AS whisker_low, round(whisker_high, 5) AS whisker_high, outliers FROM q JOIN w USING (event_type)""")
def box_summary(t):
    return rounded(S.box_summary(t.events, ["event_type"], "value"), 5, "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


@query(_BOX + "SELECT event_id, event_type, value FROM f WHERE NOT inside")
def box_outliers(t):
    return S.box_outliers(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")


@query("SELECT l_returnflag, ceil(l_quantity / 5 - 0.5) * 5 + 0.0 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_fixed_width(t):
    return S.histogram(t.lineitem, ["l_returnflag"], "l_quantity", 5)


@query("""WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 29 AS w FROM lineitem GROUP BY 1),
i AS (SELECT l_returnflag, lo, w, ceil((l_extendedprice - lo) / w + 0.5) - 1 AS i FROM lineitem JOIN s USING (l_returnflag))
SELECT l_returnflag, round(lo + (i - 0.5) * w, 6) AS bin_low, round(lo + (i + 0.5) * w, 6) AS bin_high, count(*) AS n FROM i GROUP BY ALL""")
def histogram_thirty_bins(t):
    return rounded(S.histogram_bins(t.lineitem, ["l_returnflag"], "l_extendedprice"), 6, "bin_low", "bin_high")


@query("""WITH s AS (SELECT p_type, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1),
r AS (SELECT *, (hi - lo) / ceil(log2(n) + 1) AS raw FROM s), b AS (SELECT *, pow(10.0, floor(log10(raw))) AS base FROM r WHERE raw > 0),
w AS (SELECT *, base * CASE WHEN raw / base < 1.4 THEN 1.0 WHEN raw / base < 2.8 THEN 2.0 WHEN raw / base < 7.0 THEN 5.0 ELSE 10.0 END AS width FROM b),
i AS (SELECT p_type, width, greatest(ceil(p_retailprice / width) - 1, floor(lo / width)) AS i FROM part JOIN w USING (p_type))
SELECT p_type, round(i * width, 6) AS bin_low, round((i + 1) * width, 6) AS bin_high, count(*) AS n FROM i GROUP BY ALL
UNION ALL SELECT p_type, round(lo, 6), round(hi, 6), n FROM s WHERE lo = hi""")
def histogram_sturges(t):
    return rounded(S.histogram_sturges(t.part, ["p_type"], "p_retailprice"), 6, "bin_low", "bin_high")


@query("SELECT p_brand, max(l_extendedprice) AS max_price FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1")
def group_max_ranked(t):
    lines = t.lineitem.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("price"))
    return S.group_max_ranked(lines.join(t.part, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "price", "max_price")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_levels(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("""SELECT o_orderkey, o_orderpriority, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice, -3)) - 1) / 2 AS avg_rank
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY round(o_totalprice, -3))""")
def average_ranks(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.round("o_totalprice", -3).alias("v"))
    return S.average_ranks(rows, ["o_orderpriority"], "v").drop("v")


@query("SELECT sample_id, taxon_id, round(count / sum(count) OVER (PARTITION BY sample_id), 12) AS share FROM counts", "counts")
def share_of_total(t):
    return rounded(S.share_of_total(t.counts(), ["sample_id"], "count").drop("count"), 12, "share")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_rows(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("""+best AS (SELECT taxon_id, sum(count) AS total FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT region, taxon_id, CAST(sum(count) AS BIGINT) AS abundance FROM counts JOIN samples USING (sample_id) WHERE taxon_id IN (SELECT taxon_id FROM best) GROUP BY 1, 2""", "counts samples")
def top_taxa_by_group(t):
    from quadrat.operators.community import top_taxa_by_group as top
    return top(t.counts(), t.samples(), "region", 10)


@query("""SELECT 'orders' AS source, o_orderpriority AS name, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*), round(avg(value), 4) FROM events GROUP BY 2""")
def stack_results(t):
    def counted(df, name, value):
        return df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return rounded(W.stack_rows({"orders": counted(t.orders, "o_orderpriority", "o_totalprice"),
                                 "events": counted(t.events, "event_type", "value")}, "source"), 4, "mean")


@query("""SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 INTERSECT
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 49""")
def intersect_results(t):
    def parts(flag):
        return t.lineitem.filter((F.col("l_returnflag") == flag) & (F.col("l_quantity") >= 49)).select("l_partkey").distinct()
    return W.keep_matching(parts("R"), parts("A"), ["l_partkey"])
