"""Counts, profiles, quantiles, histograms, contingency and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..features import encode
from ..operators import dedupe, groups, order
from ..stats import errors, tests
from .base import query, round_columns, rounded
from .filings import PRIORITIES


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2")
def tag_counts(t):
    return groups.count_by(t.part, ["p_type", "p_brand"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t):
    return groups.value_counts(t.events, "event_type")


@query("""SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, count(DISTINCT o_orderpriority || o_orderstatus) AS kinds FROM orders""")
def distinct_counts(t):
    return t.orders.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"),
                        F.count_distinct(F.concat("o_orderpriority", "o_orderstatus")).alias("kinds"))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def distinct_per_group(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS mean_discount, min(l_shipdate) AS first_ship,
max(l_quantity) AS max_quantity, count(*) AS n FROM lineitem GROUP BY 1""")
def group_aggregates(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        rounded(F.sum("l_extendedprice"), 2).alias("total"), rounded(F.avg("l_discount")).alias("mean_discount"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("max_quantity"), F.count("*").alias("n"))


@query("""SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.1), 6) AS q10, round(quantile_cont(c_acctbal, 0.5), 6) AS q50,
round(quantile_cont(c_acctbal, 0.999), 6) AS q999 FROM customer GROUP BY 1""")
def segment_quantiles(t):
    probs = {"q10": 0.1, "q50": 0.5, "q999": 0.999}
    return round_columns(order.exact_quantiles(t.customer, "c_acctbal", probs, ["c_mktsegment"]), probs)


@query("""SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem""")
def price_quartiles(t):
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return round_columns(order.exact_quantiles(t.lineitem, "l_extendedprice", probs), probs)


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.9) AS hi, quantile_cont(c_custkey, 0.5) AS mid FROM customer GROUP BY 1)
SELECT c_custkey, c.c_mktsegment FROM customer c JOIN q ON c.c_mktsegment = q.c_mktsegment WHERE c_acctbal <= hi AND c_custkey >= mid""")
def within_segment_quantile(t):
    """Rows up to a group's 90th percentile on one column and from its median on another."""
    hi = order.exact_quantiles(t.customer, "c_acctbal", {"hi": 0.9}, ["c_mktsegment"])
    mid = order.exact_quantiles(t.customer, "c_custkey", {"mid": 0.5}, ["c_mktsegment"])
    limits = hi.join(mid, "c_mktsegment")
    return t.customer.join(limits, "c_mktsegment").where("c_acctbal <= hi and c_custkey >= mid").select("c_custkey", "c_mktsegment")


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS min,
CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90 FROM lineitem"""


@query(" UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def describe_columns(t):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = groups.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], probs)
    return round_columns(out, ["mean", "sd", *probs])


@query("""SELECT l_returnflag, floor(l_extendedprice / 5000) * 5000 AS bin_start, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def price_histogram(t):
    return groups.histogram(t.lineitem, "l_extendedprice", 5000.0, ["l_returnflag"]).withColumn("bin_start", F.col("bin_start").cast("double"))


@query("""SELECT CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 11 WHEN c_acctbal = 9000 THEN 10
ELSE floor(c_acctbal / 900) + 1 END AS INTEGER) AS bin, count(*) AS n FROM customer GROUP BY 1""")
def balance_bins(t):
    return groups.histogram_edges(t.customer, "c_acctbal", 0.0, 9000.0, 10)


def _profile_sql(c: str, numeric: bool) -> str:
    d = f"CAST({c} AS DOUBLE)"
    m = f"(SELECT avg({c}) FROM orders)"
    stats = (f"round(avg({d}), 4) AS mean, round(avg(pow({d} - {m}, 3)) / pow(stddev_pop({d}), 3), 4) AS skewness, "
             f"round(avg(pow({d} - {m}, 4)) / pow(stddev_pop({d}), 4) - 3, 4) AS kurtosis, min({d}) AS min, max({d}) AS max") if numeric else (
        "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS skewness, CAST(NULL AS DOUBLE) AS kurtosis, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
    return (f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing, {stats}, count(DISTINCT {c}) AS n_distinct FROM orders")


@query(" UNION ALL ".join(_profile_sql(c, c in ("o_custkey", "o_totalprice")) for c in ("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")))
def column_profile(t):
    out = groups.profile(t.orders, ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    return round_columns(out, ["mean", "skewness", "kurtosis"], 4)


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem""")
def column_correlations(t):
    return round_columns(groups.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]), ["r"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab(t):
    return groups.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT conv_id, string_agg(role || ':' || text, ' | ' ORDER BY turn) AS dialogue, part FROM (SELECT *,
CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS INTEGER) AS part FROM conversations) GROUP BY conv_id, part""")
def concat_group(t):
    turns = t.conversations.withColumn("line", F.concat("role", F.lit(":"), "text"))
    return groups.concat_group(turns, ["conv_id"], "line", ["turn"], 3, " | ", "dialogue")


@query("""SELECT p_type, count(*) AS n, arg_min(p_name, p_partkey) AS example FROM part GROUP BY 1""")
def items_with_example(t):
    return groups.items_with_example(t.part, "p_type", "p_name", ["p_partkey"])


@query("""WITH top AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 100)
SELECT CASE WHEN l_partkey IN (SELECT l_partkey FROM top) THEN CAST(l_partkey AS VARCHAR) ELSE 'Other' END AS level, count(*) AS n,
round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def lump_top_n(t):
    lumped = groups.lump_top_n(t.lineitem, "l_partkey", 100, out="level")
    return lumped.groupBy("level").agg(F.count("*").alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT count(DISTINCT CASE WHEN label <> 3 THEN label END) AS n_clusters, round(avg(CASE WHEN label <> 3 THEN 1.0 ELSE 0.0 END), 6) AS share_clustered FROM embeddings""")
def cluster_coverage(t):
    return round_columns(groups.cluster_coverage(t.embeddings, "label", 3), ["share_clustered"])


@query("""SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 0) AS debits, count(*) FILTER (c_acctbal < 0) AS credits,
round(count(*) FILTER (c_acctbal < 0) / count(*) FILTER (c_acctbal >= 0), 6) AS ratio FROM customer GROUP BY 1""")
def debit_credit(t):
    counts = groups.conditional_counts(t.customer, {"debits": F.col("c_acctbal") >= 0, "credits": F.col("c_acctbal") < 0}, ["c_mktsegment"])
    return counts.withColumn("ratio", rounded(F.try_divide("credits", "debits")))


@query("""SELECT o_orderkey, o_custkey, CAST(max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS INTEGER) AS has_urgent FROM orders""")
def flag_entities(t):
    return groups.flag_any(t.orders, ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH"], "has_urgent").select("o_orderkey", "o_custkey", "has_urgent")


ONE_HOT_ERR = ", ".join(f"pow((CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) - (1.0 / 5), 2) AS p{p[0]}" for p in PRIORITIES)


@query(f"""WITH e AS (SELECT o_orderkey, {ONE_HOT_ERR}, pow(o_totalprice / 500000 - 0.5, 2) AS price FROM orders)
SELECT o_orderkey, 'priority' AS field, round(greatest(p1, p2, p3, p4, p5), 6) AS error FROM e UNION ALL SELECT o_orderkey, 'price', round(price, 6) FROM e""")
def explain_by_field(t):
    """Squared errors of one-hot columns count once per field."""
    cols = [f"p{p[0]}" for p in PRIORITIES]
    scored = t.orders.select("o_orderkey", *[F.when(F.col("o_orderpriority") == p, 1.0).otherwise(0.0).alias(c) for p, c in zip(PRIORITIES, cols)],
                             *[F.lit(0.2).alias(c + "_out") for c in cols], (F.col("o_totalprice") / 500000).alias("price"), F.lit(0.5).alias("price_out"))
    mapping = t.spark.createDataFrame([(c, "priority") for c in cols] + [("price", "price")], "column string, field string")
    return round_columns(errors.explain_errors(scored, ["o_orderkey"], [*cols, "price"], mapping), ["error"])


@query("""SELECT quality, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY 1""")
def confusion(t):
    return errors.confusion(t.labels, "quality", "toxic", [0, 1])


@query("""SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS acc_toxic, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc_one,
round(avg(CASE WHEN quality = toxic AND quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc_all FROM labels""")
def accuracies(t):
    rows = t.labels.withColumn("one", F.lit(1))
    out = errors.accuracy(rows, [("toxic", "quality", "toxic"), ("one", "quality", "one")])
    return round_columns(out, ["acc_toxic", "acc_one", "acc_all"])


@query("""WITH c AS (SELECT quality, toxic, count(*)::DOUBLE AS o FROM labels GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT a.quality, b.toxic, coalesce(o, 0) AS o, r * s / n AS e, n FROM (SELECT quality, sum(o) AS r FROM c GROUP BY 1) a,
(SELECT toxic, sum(o) AS s FROM c GROUP BY 1) b, n LEFT JOIN c ON c.quality = a.quality AND c.toxic = b.toxic),
x AS (SELECT max(n) AS n, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS chi2 FROM g)
SELECT CAST(n AS BIGINT) AS n, CAST(2 AS BIGINT) AS r, CAST(2 AS BIGINT) AS k, round(chi2, 6) AS chi2,
round(sqrt(greatest(0, chi2 / n - 1 / (n - 1)) / (2 - 1 / (n - 1) - 1)), 6) AS cramers_v FROM x""")
def cramers_v(t):
    return round_columns(tests.cramers_v(t.labels, "quality", "toxic"), ["chi2", "cramers_v"])


@query("""WITH c AS (SELECT lang, source, count(*)::DOUBLE AS o FROM documents GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT coalesce(o, 0) AS o, r * s / n AS e, n FROM (SELECT lang, sum(o) AS r FROM c GROUP BY 1) a CROSS JOIN
(SELECT source, sum(o) AS s FROM c GROUP BY 1) b CROSS JOIN n LEFT JOIN c ON c.lang = a.lang AND c.source = b.source),
x AS (SELECT max(n) AS n, sum(pow(o - e, 2) / e) AS chi2, (SELECT count(DISTINCT lang) FROM c) AS r, (SELECT count(DISTINCT source) FROM c) AS k FROM g)
SELECT CAST(n AS BIGINT) AS n, r, k, round(chi2, 6) AS chi2, round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) /
least(k - pow(k - 1, 2) / (n - 1) - 1, r - pow(r - 1, 2) / (n - 1) - 1)), 6) AS cramers_v FROM x""")
def cramers_v_wide(t):
    return round_columns(tests.cramers_v(t.documents, "lang", "source"), ["chi2", "cramers_v"])


# p by Simpson's rule over the angle of the t distribution's density
@query("""WITH g AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0,
var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v0 FROM (SELECT l_returnflag = 'A' AS f, l_extendedprice AS v FROM lineitem)),
s AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM g),
h AS (SELECT *, atan(abs(t) / sqrt(df)) AS lo, (pi() / 2 - atan(abs(t) / sqrt(df))) / 40000 AS step FROM s),
i AS (SELECT sum((CASE WHEN k IN (0, 40000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(lo + k * step), 0), df - 1)) * max(step) / 3 AS area
FROM h, range(0, 40001) r(k))
SELECT n1 AS n_true, n0 AS n_false, round(m1, 6) AS mean_true, round(m0, 6) AS mean_false, round(t, 6) AS t, round(df, 4) AS df,
round(2 * area * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()), 6) AS p FROM h, i""")
def welch(t):
    out = tests.welch_t(t.lineitem.withColumn("f", F.col("l_returnflag") == "A"), "l_extendedprice", "f")
    return round_columns(out, ["mean_true", "mean_false", "t", "p"]).withColumn("df", F.round("df", 4))


@query("""WITH s AS (SELECT o_totalprice AS x, avg(o_totalprice) OVER () AS m, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi,
rank() OVER (ORDER BY o_totalprice) - 1 AS below, count(*) OVER (ORDER BY o_totalprice) AS upto, count(*) OVER () AS n FROM orders)
SELECT 'uniform' AS distribution, round(max(greatest(abs((x - lo) / (hi - lo) - below / n), abs(upto / n - (x - lo) / (hi - lo)))), 6) AS d FROM s
UNION ALL SELECT 'expon', round(max(greatest(abs(1 - exp(-(x - lo) / (m - lo)) - below / n), abs(upto / n - (1 - exp(-(x - lo) / (m - lo)))))), 6) FROM s""")
def distribution_distance(t):
    out = tests.best_distribution(t.orders, ["o_totalprice"]).where(F.col("distribution").isin("uniform", "expon"))
    return out.select("distribution", rounded("d").alias("d"))


@query()
def best_distributions(t):
    return tests.best_distribution(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


@query()
def yeo_johnson_powers(t):
    return tests.fit_yeo_johnson(t.customer, "c_acctbal", ["c_mktsegment"])


YJ = "CASE WHEN c_acctbal / 1000 >= 0 THEN (pow(c_acctbal / 1000 + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal / 1000, 1.5) - 1) / 1.5 END"


@query(f"SELECT c_custkey, round({YJ}, 6) AS y FROM customer")
def yeo_johnson_values(t):
    return t.customer.select("c_custkey", rounded(tests.yeo_johnson(F.col("c_acctbal") / 1000, 0.5)).alias("y"))


@query("SELECT label, dense_rank() OVER (ORDER BY label) AS code, count(*) AS n FROM embeddings GROUP BY label")
def level_codes(t):
    coded = t.embeddings.withColumn("code", F.col("label"))
    counts = coded.groupBy("label", "code").agg(F.count("*").alias("n"))
    return encode.encode_levels(counts, encode.fit_levels(coded, ["code"]), ["code"])


@query("""SELECT l_returnflag, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 2 AS INTEGER) AS priority FROM lineitem GROUP BY 1
QUALIFY priority >= 0""")
def priority_skipping_first(t):
    return dedupe.priority_from_counts(t.lineitem, "l_returnflag", skip=1).select("l_returnflag", F.col("priority").cast("int"))
