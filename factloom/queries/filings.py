"""Facts in long form (line items as tagged facts) to wide, encoded and split reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..features import encode, scale, split
from ..functions.amounts import case_map, fix_sign, is_currency, to_signed, unit_method
from ..functions.dates import yyyymmdd
from ..functions.keys import make_key, split_prefix
from ..operators import dedupe, filters, groups, joins, reshape, sparsity
from ..plans import filings as plan
from .base import Tables, query, round_columns, rounded

# line items read as facts: report = order, tag = part group, unit by return flag
TAGS = [f"Tag{i}" for i in range(8)]
CURRENCIES = ["EUR", "GBP"]
UNITS = {"A": "USD", "N": "EUR", "R": "GBP"}
VERSIONS = ["us-gaap/2018", "ifrs/2017", "dei", "other"]

FACTS = """facts AS (SELECT l_orderkey AS report, 'Tag' || CAST(l_partkey % 8 AS VARCHAR) AS tag,
  CASE WHEN l_linenumber = 7 THEN 'shares' WHEN l_returnflag = 'A' THEN 'USD' WHEN l_returnflag = 'N' THEN 'EUR' ELSE 'GBP' END AS uom,
  CASE l_suppkey % 4 WHEN 0 THEN 'us-gaap/2018' WHEN 1 THEN 'ifrs/2017' WHEN 2 THEN 'dei' ELSE 'other' END AS version,
  CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ddate, l_linenumber AS qtrs, l_extendedprice AS value,
  l_partkey, l_suppkey, l_tax FROM lineitem)"""
RATES = """rates AS (SELECT ddate // 100 AS month, uom, avg(l_tax) + 0.5 AS rate FROM facts
  WHERE uom IN ('EUR', 'GBP') GROUP BY 1, 2)"""
UNIT_SEQ = """unit_seq AS (SELECT uom, row_number() OVER (ORDER BY n DESC, uom) - 1 AS priority
  FROM (SELECT uom, count(*) AS n FROM facts WHERE regexp_matches(uom, '^[A-Z]{3}$') GROUP BY 1))"""
DEDUPED = f"""{FACTS}, {UNIT_SEQ}, ranked AS (SELECT f.*, coalesce(u.priority, (SELECT count(*) FROM unit_seq)) AS uom_seq,
  split_part(version, '/', 1) AS standard FROM facts f LEFT JOIN unit_seq u USING (uom)),
  by_unit AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY report, tag
    ORDER BY uom_seq, CASE standard WHEN 'us-gaap' THEN 1 WHEN 'ifrs' THEN 2 WHEN 'dei' THEN 3 ELSE 4 END,
             uom, standard, ddate, qtrs, value) = 1),
  deduped AS (SELECT report, tag, uom, standard AS version, ddate, qtrs, value FROM by_unit)"""


def facts(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("report"),
        F.concat(F.lit("Tag"), (F.col("l_partkey") % 8).cast("string")).alias("tag"),
        F.when(F.col("l_linenumber") == 7, "shares").otherwise(case_map("l_returnflag", UNITS)).alias("uom"),
        case_map(F.col("l_suppkey") % 4, dict(enumerate(VERSIONS))).alias("version"),
        yyyymmdd("l_shipdate").alias("ddate"), F.col("l_linenumber").alias("qtrs"),
        F.col("l_extendedprice").alias("value"), "l_partkey", "l_suppkey", "l_tax")


def deduped(t: Tables) -> DataFrame:
    return plan.dedupe_facts(facts(t).withColumn("report_ref", F.col("report")))


def rates(t: Tables) -> DataFrame:
    wide = (facts(t).withColumn("YearMonth", F.floor(F.col("ddate") / 100).cast("int"))
            .groupBy("YearMonth").pivot("uom", CURRENCIES).agg(F.avg("l_tax") + 0.5))
    return joins.unpivot_rates(wide)


@query(f"""WITH {DEDUPED}, {RATES}, converted AS (
  SELECT report, tag, CASE WHEN d.uom IN ('USD', 'shares') THEN value ELSE value / rate END AS value_usd
  FROM deduped d LEFT JOIN rates r ON r.month = d.ddate // 100 AND r.uom = d.uom
  WHERE ddate > 19991231 AND ddate < 20190801)
SELECT report, {', '.join(f"round(avg(value_usd) FILTER (tag = '{t}'), 4) AS {t}" for t in TAGS)}
FROM converted GROUP BY report HAVING {' AND '.join(f"avg(value_usd) FILTER (tag = '{t}') IS NOT NULL" for t in TAGS[:2])}""")
def filings_wide(t):
    """Facts deduplicated, converted, pivoted and kept where two tags are complete."""
    wide = plan.wide_filings(deduped(t), rates(t), TAGS, CURRENCIES, ["report_ref"])
    full = filters.complete_rows(wide, TAGS[:2])
    return round_columns(full.withColumnRenamed("report_ref", "report"), TAGS, 4)


@query(f"WITH {DEDUPED} SELECT report, tag, uom, version, ddate, qtrs, value FROM deduped")
def dedupe_priority(t):
    return deduped(t).select("report", "tag", "uom", "version", "ddate", "qtrs", "value")


@query(f"WITH {FACTS}, {UNIT_SEQ} SELECT uom, CAST(priority AS INTEGER) AS priority FROM unit_seq")
def unit_priority(t):
    return dedupe.priority_from_counts(facts(t), "uom", is_currency("uom")).select("uom", F.col("priority").cast("int"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1""")
def dedupe_keep_first(t):
    first = dedupe.dedupe_first(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_audit(t):
    return dedupe.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1
HAVING count(DISTINCT l_returnflag) > 1""")
def ambiguous_tags(t):
    return dedupe.ambiguous_groups(t.lineitem, ["l_orderkey"], "l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)""")
def drop_ambiguous(t):
    mixed = dedupe.ambiguous_groups(t.lineitem, ["l_orderkey"], "l_returnflag")
    return dedupe.drop_groups(t.lineitem, mixed, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {FACTS}, usable AS (SELECT * FROM facts WHERE lower(uom) NOT LIKE '%stock%' AND lower(tag) NOT LIKE '%share%')
SELECT tag, count(*) AS n FROM usable WHERE tag NOT IN (SELECT tag FROM facts GROUP BY tag
  HAVING count(DISTINCT CASE WHEN regexp_matches(uom, '^[A-Z]{{3}}$') THEN 'Currency' ELSE uom END) > 2)
GROUP BY 1 ORDER BY n DESC, tag LIMIT 5""")
def top_tags(t):
    base = facts(t)
    usable = filters.exclude_containing(filters.exclude_containing(base, "uom", "stock"), "tag", "share")
    mixed = dedupe.ambiguous_groups(base.withColumn("m", unit_method("uom")), ["tag"], "m").where("n_values > 2")
    return groups.top_n(usable.join(mixed, "tag", "left_anti"), "tag", 5)


@query(f"""WITH {FACTS}, {RATES} SELECT report, tag, f.uom AS uom, ddate, qtrs, l_suppkey, value,
  round(CASE WHEN f.uom IN ('USD', 'shares') THEN value ELSE value / rate END, 6) AS value_usd
FROM facts f LEFT JOIN rates r ON r.month = f.ddate // 100 AND r.uom = f.uom""")
def fx_convert(t):
    dated = facts(t).withColumn("month", F.floor(F.col("ddate") / 100).cast("int"))
    return round_columns(joins.convert_currency(dated, rates(t)), ["value_usd"]).select(
        "report", "tag", "uom", "ddate", "qtrs", "l_suppkey", "value", "value_usd")


@query(f"WITH {FACTS}, {RATES} SELECT month, uom AS currency, round(rate, 12) AS rate FROM rates")
def fx_rates_long(t):
    return round_columns(rates(t), ["rate"], 12)


PIVOT = {f"{f}{s}": (f, s) for f in "ANR" for s in "FO"}


@query("SELECT l_suppkey, " + ", ".join(
    f"round(avg(l_extendedprice) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}'), 6) AS {k}" for k, (f, s) in PIVOT.items())
    + " FROM lineitem GROUP BY 1")
def pivot_wide(t):
    long = t.lineitem.withColumn("k", F.concat("l_returnflag", "l_linestatus"))
    return round_columns(reshape.pivot_facts(long, ["l_suppkey"], "k", "l_extendedprice", list(PIVOT)), PIVOT)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CELLS = {f"p{p[0]}{s}": (p, s) for p in PRIORITIES for s in "FOP"}
ORDER_WIDE = "wide AS (SELECT o_custkey, " + ", ".join(
    f"avg(o_totalprice) FILTER (o_orderpriority = '{p}' AND o_orderstatus = '{s}') AS {k}" for k, (p, s) in CELLS.items()
) + " FROM orders GROUP BY 1)"
FILLED = " + ".join(f"(CASE WHEN {k} IS NULL THEN 0 ELSE 1 END)" for k in CELLS)


def order_wide(t: Tables) -> DataFrame:
    """Customer x (priority, status): 15 columns with natural gaps."""
    key = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    return reshape.pivot_facts(t.orders.withColumn("k", key), ["o_custkey"], "k", "o_totalprice", list(CELLS))


@query(f"WITH {ORDER_WIDE} SELECT o_custkey, CAST({FILLED} AS INTEGER) AS filled FROM wide")
def completeness_rows(t):
    return sparsity.completeness_rows(order_wide(t), list(CELLS)).select("o_custkey", "filled")


@query(f"WITH {ORDER_WIDE}" + " UNION ALL ".join(
    f" SELECT '{k}' AS \"column\", count({k}) AS filled, round(count({k}) / count(*), 6) AS share FROM wide" for k in CELLS))
def completeness_columns(t):
    return round_columns(sparsity.completeness_columns(order_wide(t), list(CELLS)), ["share"])


@query(f"""WITH {ORDER_WIDE}, f AS (SELECT {FILLED} AS n FROM wide) SELECT round(quantile_cont(n, 0.25) / 15, 6) AS q25,
round(quantile_cont(n, 0.5) / 15, 6) AS q50, round(quantile_cont(n, 0.75) / 15, 6) AS q75, round(max(n) / 15, 6) AS q100 FROM f""")
def completeness_quartiles(t):
    return round_columns(sparsity.completeness_quartiles(order_wide(t), list(CELLS)), ["q25", "q50", "q75", "q100"])


@query(f"""WITH {ORDER_WIDE}, long AS (UNPIVOT wide ON {', '.join(CELLS)} INTO NAME k VALUE v),
kept AS (SELECT k FROM long GROUP BY k HAVING count(*) > 5),
cells AS (SELECT * FROM long WHERE k IN (SELECT k FROM kept)),
ok AS (SELECT o_custkey FROM cells GROUP BY 1 HAVING count(*) > 6)
SELECT o_custkey, k, round(v, 6) AS v FROM cells WHERE o_custkey IN (SELECT o_custkey FROM ok)""")
def sparsity_reduced(t):
    slim = sparsity.reduce_sparsity(order_wide(t), list(CELLS), 5, 6)
    long = reshape.gather(slim, ["o_custkey"], [c for c in slim.columns if c != "o_custkey"], "k", "v")
    return round_columns(long.where("v is not null"), ["v"])


@query(f"""WITH {ORDER_WIDE}, m AS (SELECT CAST({' + '.join(f"(CASE WHEN {k} IS NULL THEN 0 ELSE {1 << i} END)" for i, k in enumerate(CELLS))}
AS BIGINT) AS mask FROM wide) SELECT mask, count(*) AS n FROM m GROUP BY 1""")
def fill_patterns(t):
    return sparsity.pattern_counts(order_wide(t), list(CELLS)).select(F.col("masks")[0].alias("mask"), "n")


MASK = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE {1 << i} END)" for i, c in enumerate(CELLS))
NAMES = "[" + ", ".join(f"'{c}'" for c in CELLS) + "]"


# columns in turn: one stays if enough of the rows that are complete so far are complete on it as well
@query(f"""WITH RECURSIVE {ORDER_WIDE}, p AS (SELECT {MASK} AS mask, count(*) AS n FROM wide GROUP BY 1),
g AS (SELECT 1 AS i, 1 AS m, 1 AS qty, (SELECT sum(n) FROM p WHERE mask & 1 = 1) AS rows, true AS kept
UNION ALL SELECT i + 1, CASE WHEN r >= 0.6 * rows THEN m | (1 << i) ELSE m END, CASE WHEN r >= 0.6 * rows THEN qty + 1 ELSE qty END,
  CASE WHEN r >= 0.6 * rows THEN r ELSE rows END, r >= 0.6 * rows
FROM (SELECT g.*, (SELECT coalesce(sum(n), 0) FROM p WHERE mask & (m | (1 << i)) = (m | (1 << i))) AS r FROM g WHERE i < {len(CELLS)}))
SELECT CAST(qty AS INTEGER) AS column_qty, {NAMES}[i] AS "column", CAST(rows AS BIGINT) AS complete_rows FROM g WHERE kept""")
def greedy_columns(t):
    return sparsity.greedy_complete_columns(order_wide(t), list(CELLS), 0.6)


def _subset_sql(ks) -> str:
    """The best subset of the 15 columns for each size, by counting all of them."""
    bits = " + ".join(f"((m >> {i}) & 1)" for i in range(len(CELLS)))
    early = " + ".join(f"(((m >> {i}) & 1) << {len(CELLS) - 1 - i})" for i in range(len(CELLS)))
    return f"""WITH {ORDER_WIDE}, p AS (SELECT {MASK} AS mask, count(*) AS n FROM wide GROUP BY 1),
c AS (SELECT m, {bits} AS k FROM range(1, {1 << len(CELLS)}) r(m) WHERE {bits} IN ({', '.join(map(str, ks))})),
s AS (SELECT m, k, coalesce(sum(n) FILTER ((mask & m) = m), 0) AS n FROM c, p GROUP BY m, k)
SELECT CAST(k AS INTEGER) AS column_qty, array_to_string(list_filter({NAMES}, lambda x: (m >> (list_position({NAMES}, x) - 1)) & 1 = 1), ',') AS columns,
CAST(n AS BIGINT) AS complete_rows FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, {early} DESC) = 1"""


def _best(t, ks):
    best = sparsity.best_column_subset(order_wide(t), list(CELLS), ks)
    return best.select("column_qty", F.array_join("column_list", ",").alias("columns"), "complete_rows")


@query(_subset_sql([3]))
def best_columns(t):
    """The 3 columns with the most complete rows."""
    return _best(t, [3])


@query(_subset_sql([5, 6, 7, 8, 9, 10]))
def best_columns_sampled(t):
    """The best 5 to 10 columns; exact, without trying all subsets."""
    return _best(t, [5, 6, 7, 8, 9, 10])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ddate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '2000-08-01'""")
def plausible_dates(t):
    dated = t.lineitem.withColumn("ddate", yyyymmdd("l_shipdate"))
    return filters.filter_period(dated, "ddate", 19961231, 20000801).select("l_orderkey", "l_linenumber", "l_partkey", "ddate")


@query(f"""WITH {FACTS} SELECT tag, uom, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(uom, '^[A-Z]{{3}}$') THEN 1 ELSE 0 END) AS BIGINT)
AS n_currency FROM facts WHERE uom IN ('EUR', 'USD') OR NOT regexp_matches(uom, '^[A-Z]{{3}}$') GROUP BY 1, 2""")
def convertible_units(t):
    kept = facts(t).where(filters.convertible("uom", ["EUR"]))
    return kept.groupBy("tag", "uom").agg(F.count("*").alias("n"), F.count_if(is_currency("uom")).alias("n_currency"))


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) NOT LIKE '%ring%'""")
def names_without_word(t):
    return filters.exclude_containing(t.part, "p_name", "RING").select("p_partkey", "p_name")


@query(f"""WITH {FACTS} SELECT coalesce(CAST(report AS VARCHAR), 'nan') || '_' || tag || '_' || CAST(ddate AS VARCHAR) AS report_ref,
split_part(version, '/', 1) AS standard, count(*) AS n FROM facts GROUP BY 1, 2""")
def composite_keys(t):
    prefix, rest = split_prefix("version", "/")
    keyed = facts(t).select(make_key(["report", "tag", "ddate"]).alias("report_ref"), F.coalesce(prefix, rest).alias("standard"))
    return keyed.groupBy("report_ref", "standard").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS fixed,
CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS segment_code,
CASE WHEN c_acctbal >= 0 THEN 1 ELSE -1 END AS signed FROM customer""")
def case_and_sign(t):
    c = t.customer
    return c.select("c_custkey", fix_sign("c_acctbal", F.col("c_mktsegment") == "BUILDING").alias("fixed"),
                    case_map("c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}, 9).alias("segment_code"),
                    to_signed((F.col("c_acctbal") >= 0).cast("int")).alias("signed"))


@query("""SELECT p_type AS item, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total_value
FROM lineitem JOIN (SELECT p_partkey, p_type, p_brand FROM part) ON l_partkey = p_partkey GROUP BY 1, 2""")
def map_to_groups(t):
    mapping = t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("item_mapped"))
    brands = t.part.select("p_partkey", "p_brand")
    mapped = joins.map_items(t.lineitem.withColumn("item", F.col("l_partkey")), mapping)
    return (mapped.join(brands, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("item", "p_brand").agg(F.count("*").alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("total_value")))


@query("""SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def left_enrich(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", "o_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_entities(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_entities(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def nation_customers(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return (places.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers")))


@query("""SELECT o_orderkey, o_totalprice AS o_totalprice_x, c_nationkey, s.total AS o_totalprice_y FROM orders
JOIN (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) s
ON o_custkey = s.c_custkey""".replace("s.total AS", "round(s.total, 2) AS"))
def join_with_suffixes(t):
    totals = t.orders.groupBy("o_custkey").agg(rounded(F.sum("o_totalprice"), 2).alias("o_totalprice"))
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    both = joins.join_suffixed(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), totals.join(customers, "o_custkey"), "o_custkey")
    return both.select("o_orderkey", "o_totalprice_x", "c_nationkey", "o_totalprice_y")


@query("""SELECT d.doc_id, n_chars, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def bind_by_key(t):
    return joins.zip_by_key(t.documents.select("doc_id", "n_chars", "lang"), t.labels, "doc_id")


# --- encoding -------------------------------------------------------------------------------------

ENC = """e AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS c_acctbal_ispos, abs(c_acctbal) AS v FROM customer)"""


@query(f"""WITH {ORDER_WIDE}, w AS (SELECT o_custkey, {', '.join(f'p1{s} - 250000 AS p1{s}' for s in 'FOP')} FROM wide)
SELECT o_custkey, {', '.join(f"round(coalesce(abs(p1{s}), 0), 6) AS p1{s}, CASE WHEN p1{s} >= 0 THEN 1 ELSE 0 END AS p1{s}_ispos, CASE WHEN p1{s} IS NULL THEN 0 ELSE 1 END AS p1{s}_notna" for s in 'FOP')} FROM w""")
def indicator_encoding(t):
    cols = ["p1F", "p1O", "p1P"]
    wide = filters.map_columns(order_wide(t).select("o_custkey", *cols), cols, lambda c: c - 250000)
    return round_columns(encode.apply_cat(wide, cols), cols)


@query(f"""WITH {ENC}, p AS (SELECT avg(ln(1 + v)) AS m, stddev_pop(ln(1 + v)) AS s FROM e)
SELECT c_custkey, round((ln(1 + v) - m) / s, 6) AS c_acctbal, c_acctbal_ispos FROM e, p""")
def encode_scale(t):
    signed = encode.split_sign(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return round_columns(scale.log_standardise(signed, ["c_acctbal"])[0], ["c_acctbal"])


@query(f"""WITH {ENC} SELECT 'c_acctbal' AS "column", round(avg(ln(1 + v)), 6) AS mean, round(stddev_pop(ln(1 + v)), 6) AS sd FROM e""")
def scale_parameters(t):
    signed = encode.split_sign(t.customer, ["c_acctbal"])
    return round_columns(scale.fit_standard(signed, ["c_acctbal"], log=True), ["mean", "sd"])


@query("SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def decode_scaled(t):
    """Encode, then decode: the original values come back."""
    signed = encode.apply_cat(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    scaled, params = scale.log_standardise(signed, ["c_acctbal"])
    return round_columns(scale.un_log_scale(scaled, params), ["c_acctbal"], 4).select("c_custkey", "c_acctbal")


@query("""SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice, round((p_size - slo) / (shi - slo), 6) AS p_size
FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_size) AS slo, max(p_size) AS shi FROM part)""")
def minmax(t):
    limits = scale.fit_minmax(t.part, ["p_retailprice", "p_size"])
    return round_columns(scale.minmax_scale(t.part, limits), ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice", "p_size")


@query("SELECT p_partkey, round(p_retailprice, 4) AS p_retailprice FROM part")
def minmax_inverse(t):
    limits = scale.fit_minmax(t.part, ["p_retailprice"])
    back = scale.minmax_unscale(scale.minmax_scale(t.part, limits), limits)
    return round_columns(back, ["p_retailprice"], 4).select("p_partkey", "p_retailprice")


@query("""SELECT 'o_orderpriority' AS "column", o_orderpriority AS level, dense_rank() OVER (ORDER BY o_orderpriority) AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL
SELECT 'o_orderstatus', o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def factor_levels(t):
    return encode.fit_levels(t.orders, ["o_orderpriority", "o_orderstatus"])


@query("""SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS o_orderpriority FROM orders""")
def factor_codes(t):
    levels = encode.fit_levels(t.orders, ["o_orderpriority"])
    return encode.encode_levels(t.orders.select("o_orderkey", "o_orderpriority"), levels, ["o_orderpriority"])


@query("SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders")
def one_hot_columns(t):
    names = encode.level_names(encode.fit_levels(t.orders, ["o_orderpriority"]), ["o_orderpriority"])["o_orderpriority"]
    return encode.one_hot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", names)


@query("""SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def decode_orders(t):
    """Records encoded for a model (one-hot, logged, min-max) and decoded again."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.log1p("o_totalprice").alias("o_totalprice"),
                           F.unix_date(F.to_date("o_orderdate")).alias("day"))
    names = encode.level_names(encode.fit_levels(rows, ["o_orderpriority"]), ["o_orderpriority"])
    limits = scale.fit_minmax(rows, ["o_totalprice", "day"])
    encoded = encode.one_hot(scale.minmax_scale(rows, limits), "o_orderpriority", names["o_orderpriority"])
    return encode.decode_records(encoded, names, limits, logged=["o_totalprice"], dates=["day"])


# --- splits ---------------------------------------------------------------------------------------

def _u(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def _h(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15))::BIGINT)"


def _label(u: str) -> str:
    return f"CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.85 THEN 'valid' ELSE 'test' END"


@query(f"SELECT o_orderkey, {_label(_u('o_orderkey'))} AS split FROM orders")
def split_rows(t):
    return split.split_random(t.orders, "o_orderkey", (0.7, 0.15, 0.15)).select("o_orderkey", "split")


@query(f"""SELECT {_label(_u('o_custkey', 3))} AS split, count(*) AS n, count(DISTINCT o_custkey) AS customers,
round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def split_by_entity(t):
    return (split.split_by_group(t.orders, "o_custkey", (0.7, 0.15, 0.15), 3).groupBy("split")
            .agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), rounded(F.sum("o_totalprice"), 2).alias("total")))


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.67) THEN 'train'
WHEN rn <= floor(n * 0.67) + floor((n - floor(n * 0.67)) * 0.67) THEN 'valid' ELSE 'test' END AS split FROM r""")
def split_exact_nested(t):
    return split.split_exact(t.orders, "o_orderkey", 0.67).select("o_orderkey", "split")


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey', 5)}, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, CASE WHEN rn <= 400 THEN 'test' WHEN rn <= 600 THEN 'valid' ELSE 'train' END AS split FROM r""")
def split_fixed_counts(t):
    return split.split_counts(t.orders, "o_orderkey", 400, 200, 5).select("o_orderkey", "split")


