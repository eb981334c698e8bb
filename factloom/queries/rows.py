"""Row filters, samples, orders, sets, scalar functions and source-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..functions.keys import account_digits, parse_report_ref
from ..operators import filters, groups, order, reshape, sampling, sets
from ..sources.files import parse_array_cols, period_grid
from .base import query, round_columns, rounded
from .filings import _h, _u


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000
AND o_totalprice <= 400000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_rows(t):
    return t.orders.where((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 100000) & (F.col("o_totalprice") <= 400000)
                          & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT s_suppkey AS supplier, s_acctbal AS balance, s_nationkey FROM supplier""")
def select_rename(t):
    return (t.supplier.withColumnsRenamed({"s_suppkey": "supplier", "s_acctbal": "balance"}).drop("s_name")
            .select("supplier", "balance", "s_nationkey"))


@query("SELECT l_orderkey, l_partkey, l_discount + 0 AS l_discount, l_tax, l_extendedprice FROM lineitem")
def columns_by_name(t):
    l = t.lineitem
    wanted = [*filters.columns_like(l, suffix="key", exclude=["l_suppkey"]), *filters.columns_like(l, prefix="l_d"),
              *filters.columns_like(l, suffix="tax"), *filters.columns_like(l, suffix="price")]
    return l.select(*wanted)


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0) AS value,
coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE user_id END, -1) AS user_id,
CASE WHEN trim(CASE WHEN event_type = 'view' THEN '   ' ELSE event_type END) = '' THEN 'XX' ELSE event_type END AS event_type FROM events""")
def fill_missing(t):
    holes = t.events.select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "view", "   ").otherwise(F.col("event_type")).alias("event_type"))
    return holes.fillna(0.0, ["value"]).fillna(-1, ["user_id"]).withColumn("event_type", amounts.blank_to("event_type"))


@query("""SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi,
quantile_cont(user_id, 0.05) AS ulo, quantile_cont(user_id, 0.95) AS uhi FROM events)
WHERE value BETWEEN lo AND hi AND user_id BETWEEN ulo AND uhi""")
def trim_outliers(t):
    return filters.between_quantiles(t.events, ["value", "user_id"], 0.05, 0.95).select("event_id", "value")


@query(f"""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_h('event_id', 7)}, event_id) <= 20""")
def sample_per_group(t):
    return sampling.sample_n(t.events, 20, "event_id", 7, ["event_type"]).select("event_id", "event_type")


@query(f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 QUALIFY row_number() OVER (ORDER BY {_h('o_orderkey', 2)}, o_orderkey) <= 1500""")
def sample_rows(t):
    return sampling.sample_n(t.orders, 1500, "o_orderkey", 2, where="o_totalprice > 50000").select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey FROM orders WHERE {_h('o_orderkey', 4)} < {int(0.2 * (1 << 60))}")
def sample_by_share(t):
    return sampling.sample_share(t.orders, 0.2, "o_orderkey", 4).select("o_orderkey")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_h('c_custkey', 1)}, c_custkey) AS place FROM customer")
def random_order(t):
    return order.hash_rank(t.customer, "c_custkey", 1, out="place").select("c_custkey", F.col("place").cast("bigint"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def shuffled(t):
    return sampling.shuffle(t.customer, "c_custkey", 9).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS sequence FROM orders WHERE o_orderstatus = 'F'""")
def row_sequence(t):
    numbered = sampling.with_sequence(t.orders.where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), F.asc("o_orderkey")])
    return numbered.select("o_orderkey", "sequence")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100""")
def sorted_report(t):
    return t.orders.orderBy(F.desc("o_orderpriority"), F.asc("o_totalprice"), F.asc("o_orderkey")).limit(100).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem""")
def distinct_rows(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("""SELECT * FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) < 1998 UNION
SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1997)""")
def union_history(t):
    o = t.orders.select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    return sets.union_distinct(o.where("y < 1998").drop("y"), o.where("y >= 1997").drop("y"))


@query("""SELECT o_orderkey, o_totalprice, 'current' AS part FROM orders WHERE year(o_orderdate) >= 1999 UNION ALL
SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE year(o_orderdate) < 2000""")
def union_all_history(t):
    current = t.orders.where(F.year("o_orderdate") >= 1999).select("o_orderkey", "o_totalprice", F.lit("current").alias("part"))
    return sets.union_all(current, t.orders.where(F.year("o_orderdate") < 2000).select("o_orderkey", "o_totalprice"))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE NOT ({_u('o_orderkey')} < 0.7)")
def complement(t):
    from ..features.split import split_random
    chosen = split_random(t.orders, "o_orderkey", (0.7, 0.15, 0.15)).where("split = 'train'")
    return sets.except_keys(t.orders, chosen, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, month(o_orderdate) AS o_mth, day(o_orderdate) AS o_dom, dayofweek(o_orderdate) + 1 AS o_dow,
year(o_orderdate) * 100 + month(o_orderdate) AS ym, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days,
round(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 30.436875) AS months FROM orders""".replace(
    "month(o_orderdate) AS o_mth", "CAST(month(o_orderdate) AS INTEGER) AS o_mth").replace(
    "day(o_orderdate) AS o_dom", "CAST(day(o_orderdate) AS INTEGER) AS o_dom").replace(
    "dayofweek(o_orderdate) + 1 AS o_dow", "CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_dow").replace(
    "year(o_orderdate) * 100 + month(o_orderdate) AS ym", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym").replace(
    "CAST(o_orderdate AS DATE)) AS days", "CAST(o_orderdate AS DATE))::INTEGER AS days").replace(
    "/ 30.436875) AS months", "/ 30.436875)::INTEGER AS months"))
def date_fields(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in dates.date_parts("o_orderdate", "o").items()],
                           dates.year_month("o_orderdate").alias("ym"), dates.epoch_days("o_orderdate").alias("days"),
                           dates.epoch_months("o_orderdate").alias("months"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(try_strptime(CASE WHEN l_linenumber = 1 THEN '20011345'
ELSE strftime(l_shipdate, '%Y%m%d') END, '%Y%m%d') AS DATE) AS ship_day,
CAST(round(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30.436875) AS INTEGER) AS months,
CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS delay
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def parsed_dates(t):
    text = F.when(F.col("l_linenumber") == 1, "20011345").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    both = t.lineitem.withColumn("text", text).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", dates.parse_yyyymmdd("text").alias("ship_day"),
                       dates.duration_months("o_orderdate", "l_shipdate").alias("months"),
                       F.datediff("l_shipdate", "o_orderdate").alias("delay"))


@query("""SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number, CAST(ts AS DATE) AS day FROM events""")
def day_numbers(t):
    numbered = t.events.select("event_id", dates.epoch_days("ts").alias("day_number"))
    return numbered.withColumn("day", dates.from_epoch_days("day_number"))


@query("""WITH k AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_nan_' || strftime(o_orderdate, '%Y%m%d') || '_0' AS ref FROM orders)
SELECT o_orderkey, split_part(ref, '_', 1) AS entity, CAST(strptime(split_part(ref, '_', 3), '%Y%m%d') AS DATE) AS report_date FROM k""")
def parse_references(t):
    from ..functions.keys import make_key
    ref = t.orders.select("o_orderkey", make_key(["o_custkey", F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(0)]).alias("ref"))
    return ref.select("o_orderkey", *[c.alias(n) for n, c in parse_report_ref("ref").items()])


@query("""WITH a AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS acc FROM part)
SELECT p_partkey, """ + ", ".join(f"substr(acc, {i}, 1) AS account_digit{i}" for i in range(1, 7)) + ", right(acc, 1) AS account_digit7 FROM a")
def account_positions(t):
    padded = t.part.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("acc"))
    return padded.select("p_partkey", *[c.alias(n) for n, c in account_digits("acc").items()])


@query("""WITH a AS (SELECT item_id, concat(item_id, 'a', item_id % 7, '.5 x') AS txt FROM benchmark)
SELECT item_id, TRY_CAST(array_to_string(regexp_extract_all(txt, '\\d+\\.\\d+|\\d+'), '') AS DOUBLE) * 1000 * -1 AS amount FROM a""")
def dirty_amounts(t):
    text = F.concat(F.col("item_id").cast("string"), F.lit("a"), (F.col("item_id") % 7).cast("string"), F.lit(".5 x"))
    return t.benchmark.select("item_id", amounts.parse_amount(text, F.lit("3"), F.lit("-")).alias("amount"))


@query("""SELECT doc_id, coalesce(TRY_CAST(array_to_string(regexp_extract_all(text, '\\d+\\.\\d+|\\d+'), '') AS DOUBLE), 0) >= 1 AS has_number,
len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '' AND TRY_CAST(x AS DOUBLE) IS NOT NULL)) AS numeric_words FROM documents""")
def numbers_in_text(t):
    return t.documents.select("doc_id", (F.coalesce(amounts.parse_amount("text"), F.lit(0.0)) >= 1).alias("has_number"),
                              F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: (x != "") & amounts.is_numeric(x)))
                              .cast("bigint").alias("numeric_words"))


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(embedding[i]::VARCHAR::DOUBLE, 10) AS x FROM embeddings, range(1, 65) r(i)""")
def array_text_round_trip(t):
    """Arrays written as text and read back."""
    text = t.embeddings.select("vec_id", F.to_json("embedding").alias("v"))
    return (parse_array_cols(text, ["v"], "double").select("vec_id", F.posexplode("v").alias("pos", "x"))
            .withColumn("x", F.round("x", 10)))


@query("""WITH g AS (SELECT y, q FROM range(1995, 2002) a(y), range(1, 5) b(q)), o AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q,
count(*) AS n FROM orders GROUP BY 1, 2) SELECT concat(g.y, 'q', g.q) AS name, CAST(g.y AS INTEGER) AS year, coalesce(n, 0) AS n FROM g LEFT JOIN o USING (y, q)""")
def period_coverage(t):
    """Reports per quarter on a complete grid of periods."""
    grid = period_grid(t.spark, 1995, 2001, ["q1", "q2", "q3", "q4"])
    counts = t.orders.groupBy(F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    return grid.join(counts, "name", "left").select("name", "year", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT concat('run', c_nationkey) AS run, c_nationkey, round(avg(c_acctbal), 6) AS metric FROM customer
WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2 ORDER BY metric, run LIMIT 1""")
def pick_best_run(t):
    runs = (t.customer.where("c_mktsegment <> 'BUILDING'").groupBy("c_nationkey").agg(rounded(F.avg("c_acctbal")).alias("metric"))
            .withColumn("run", F.concat(F.lit("run"), F.col("c_nationkey").cast("string"))))
    return groups.best_run(runs, "metric", "run")


@query("""SELECT p_partkey, attribute, value FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part)
UNPIVOT (value FOR attribute IN (p_name, p_brand, p_type))""")
def melt(t):
    return reshape.gather(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), ["p_partkey"], ["p_name", "p_brand", "p_type"], "attribute", "value")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("""SELECT user_id, """ + ", ".join(
    f"CAST(coalesce(max(value) FILTER (event_type = '{e}'), -1) AS DOUBLE) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY 1")
def spread_fill(t):
    return reshape.spread(t.events, ["user_id"], "event_type", "value", list(EVENT_TYPES), -1.0)


@query("""SELECT doc_id, CASE quality WHEN 1 THEN 10 WHEN 0 THEN 11 END AS quality, CASE toxic WHEN 1 THEN 10 WHEN 0 THEN 11 END AS toxic FROM labels""")
def recode_labels(t):
    return filters.recode(t.labels, ["quality", "toxic"], {1: 10, 0: 11})


@query("""SELECT o_orderkey, round(o_totalprice / 1000, 6) AS o_totalprice, round(ln(1 + o_totalprice), 6) AS logged,
round(exp(ln(1 + o_totalprice)) - 1, 4) AS back FROM orders""")
def log_and_back(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.log1p("o_totalprice").alias("logged"))
    o = o.withColumn("back", F.round(F.expm1("logged"), 4))
    return round_columns(filters.map_columns(o, ["o_totalprice"], lambda c: c / 1000), ["o_totalprice", "logged"])
