"""Orders as reports of customers: sequence, interval, run, window and growth operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, order, sequences as seq
from ..stats import rankings
from .base import query, round_columns, rounded

GAPS = """g AS (SELECT o_custkey, o_orderkey, o_orderdate,
  CAST(round(coalesce(date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE), 0) / 30.436875) AS INTEGER) AS back,
  CAST(round(coalesce(date_diff('day', o_orderdate::DATE, lead(o_orderdate::DATE) OVER w), 0) / 30.436875) AS INTEGER) AS ahead
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN back = 0 THEN ahead ELSE back END AS interval_months FROM g)"""
RUNS = GAPS + """, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  - row_number() OVER (PARTITION BY o_custkey, interval_months ORDER BY o_orderdate, o_orderkey) AS island FROM i),
r AS (SELECT o_custkey, o_orderkey, o_orderdate, interval_months,
  row_number() OVER (PARTITION BY o_custkey, interval_months, island ORDER BY o_orderdate, o_orderkey) AS run FROM n)"""
WINDOWS = """s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders),
w AS (SELECT a.o_custkey, a.sequence AS sequence_grp, CAST(b.sequence - a.sequence + 1 AS INTEGER) AS step, b.o_orderkey, b.o_totalprice
  FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.sequence BETWEEN a.sequence AND a.sequence + 3
  WHERE a.sequence + 3 <= (SELECT max(sequence) FROM s c WHERE c.o_custkey = a.o_custkey))"""
KEY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]


def _intervals(t):
    return seq.with_interval_months(t.orders.select("o_custkey", *ORDER), KEY, "o_orderdate", ["o_orderkey"])


def _runs(t):
    return seq.with_run_number(_intervals(t), KEY, "interval_months", ORDER)


def _windows(t):
    return seq.sliding_sequences(t.orders, KEY, ORDER, ["o_orderkey", "o_totalprice"], 4)


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders""")
def entity_sequence(t):
    return seq.with_entity_sequence(t.orders, KEY, ORDER).select("o_custkey", "o_orderkey", "sequence")


@query("""SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS o_totalprice_lag, lead(o_totalprice) OVER w AS o_totalprice_lead
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead(t):
    return seq.with_lag_lead(t.orders, KEY, ORDER, "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice_lag", "o_totalprice_lead")


@query("""WITH d AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS n
FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) SELECT o.o_custkey, o_orderkey,
o_orderpriority || CASE n WHEN 1 THEN '_curr' ELSE '_prev' END AS item FROM orders o JOIN d ON o.o_custkey = d.o_custkey
AND o.o_orderdate = d.o_orderdate WHERE n <= 2""")
def current_previous(t):
    items = t.orders.withColumn("item", F.col("o_orderpriority"))
    return seq.tag_current_previous(items, KEY, "o_orderdate", "item").select("o_custkey", "o_orderkey", "item")


@query(f"WITH {GAPS} SELECT o_custkey, o_orderkey, interval_months FROM i")
def intervals(t):
    return _intervals(t).select("o_custkey", "o_orderkey", "interval_months")


@query(f"WITH {RUNS} SELECT o_custkey, o_orderkey, interval_months, run FROM r")
def runs(t):
    return _runs(t).select("o_custkey", "o_orderkey", "interval_months", "run")


@query(f"""WITH {GAPS} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, interval_months
ORDER BY o_orderdate, o_orderkey) AS run FROM i""")
def runs_without_breaks(t):
    return seq.with_run_number(_intervals(t), KEY, "interval_months", ORDER, islands=False).select("o_custkey", "o_orderkey", "run")


@query(f"WITH {RUNS} SELECT interval_months, count(DISTINCT o_custkey) AS entities FROM r WHERE run >= 2 GROUP BY 1")
def entities_by_interval(t):
    long = seq.entities_with_min_sequence(_runs(t), KEY, "interval_months", 2)
    return long.groupBy("interval_months").agg(F.count_distinct("o_custkey").alias("entities"))


@query(f"""WITH {RUNS}, m AS (SELECT o_custkey, interval_months, max(run) AS max_run FROM r GROUP BY 1, 2 HAVING max(run) >= 2)
SELECT r.o_custkey, o_orderkey, run, max_run FROM r JOIN m ON r.o_custkey = m.o_custkey AND r.interval_months = m.interval_months
WHERE r.interval_months = 3""")
def rows_with_min_run(t):
    return seq.rows_with_min_sequence(_runs(t), KEY, "interval_months", 2, 3).select("o_custkey", "o_orderkey", "run", "max_run")


@query("""SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_date FROM orders""")
def attach_extremes(t):
    both = groups.attach_aggregates(t.orders, KEY, {"top": F.max("o_totalprice"), "first_date": F.min("o_orderdate")})
    return both.select("o_orderkey", "top", "first_date")


@query(f"WITH {WINDOWS} SELECT * FROM w")
def sliding_windows(t):
    return _windows(t)


@query(f"""WITH {WINDOWS}, e AS (SELECT o_custkey, sequence_grp, max(o_totalprice) FILTER (step = 1) AS a, max(o_totalprice) FILTER (step = 4) AS b FROM w GROUP BY 1, 2)
SELECT w.o_custkey, w.sequence_grp, step, a AS o_totalprice_start, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a END, 6) AS growth
FROM w JOIN e ON w.o_custkey = e.o_custkey AND w.sequence_grp = e.sequence_grp""")
def window_growth(t):
    return round_columns(seq.window_growth(_windows(t), ["o_custkey", "sequence_grp"], "o_totalprice"), ["growth"]).select(
        "o_custkey", "sequence_grp", "step", "o_totalprice_start", "growth")


@query(f"""WITH {WINDOWS}, e AS (SELECT o_custkey, sequence_grp, max(o_totalprice) FILTER (step = 1) AS a, max(o_totalprice) FILTER (step = 4) AS b FROM w GROUP BY 1, 2),
g AS (SELECT o_custkey, sequence_grp, ln(1 + least(greatest((b - a) / a, -0.5), 0.5) + 0.5) AS s FROM e)
SELECT o_custkey, sequence_grp, round(s / (SELECT max(s) FROM g) * 255) AS growth_255 FROM g""")
def growth_scale(t):
    one = seq.window_growth(_windows(t), ["o_custkey", "sequence_grp"], "o_totalprice").where("step = 1")
    return seq.scale_to_byte(one, "growth").select("o_custkey", "sequence_grp", "growth_255")


@query(f"""WITH {WINDOWS}, e AS (SELECT o_custkey, sequence_grp, max(o_totalprice) FILTER (step = 1) AS a, max(o_totalprice) FILTER (step = 4) AS b FROM w GROUP BY 1, 2)
SELECT CASE WHEN (b - a) / a > 0.1 AND (b - a) / a < 0.2 THEN 'growing' ELSE 'shrinking' END AS kind, o_custkey, sequence_grp FROM e
WHERE ((b - a) / a > 0.1 AND (b - a) / a < 0.2) OR ((b - a) / a < -0.1 AND (b - a) / a > -0.2)""")
def growth_samples(t):
    """Windows growing, and shrinking, by 10 to 20 percent."""
    one = seq.window_growth(_windows(t), ["o_custkey", "sequence_grp"], "o_totalprice").where("step = 1")
    g = F.col("growth")
    kind = F.when((g > 0.1) & (g < 0.2), "growing").when((g < -0.1) & (g > -0.2), "shrinking")
    return one.select(kind.alias("kind"), "o_custkey", "sequence_grp").where("kind is not null")


@query("""SELECT o_custkey, o_orderkey, CAST(sequence AS INTEGER) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence,
count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 4 AND sequence <= 4""")
def first_reports(t):
    return seq.first_n(t.orders, KEY, ORDER, 4).select("o_custkey", "o_orderkey", "sequence")


@query(f"""WITH {WINDOWS} SELECT o_custkey, sequence_grp, step, o_totalprice, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM w""")
def sequence_tensor(t):
    """Windows as arrays of steps x features, and back to rows."""
    tensors = seq.to_sequences(_windows(t), ["o_custkey", "sequence_grp"], "step", ["o_totalprice", "o_orderkey"])
    return seq.from_sequences(tensors, ["o_custkey", "sequence_grp"], ["o_totalprice", "o_orderkey"])


@query("""SELECT o_custkey, o_orderkey, a AS place_a, b AS place_b, a = b AS agrees FROM (
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders)""")
def order_agreement(t):
    both = seq.order_agreement(t.orders, KEY, ORDER, ["o_totalprice", "o_orderkey"])
    return both.select("o_custkey", "o_orderkey", "place_a", "place_b", "agrees")


@query("""SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS running FROM (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month,
count(*) AS n FROM orders GROUP BY 1)""")
def cumulative_counts(t):
    from ..streaming.ingest import counts_by_month
    return order.running_total(counts_by_month(t.orders, "o_orderdate"), ["month"], "n")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def cumulative_sum(t):
    return order.running_total(t.orders, ORDER, "o_totalprice").select("o_orderkey", rounded("running", 2).alias("running"))


@query("""SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS place FROM orders""")
def average_rank(t):
    return order.average_rank(t.orders, "o_custkey", "place").select("o_orderkey", "place")


@query("""SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 12""")
def top_per_group(t):
    return groups.top_n_per_group(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select(
        "o_orderpriority", "o_orderkey", "rank")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""")
def best_per_entity(t):
    return groups.best_per_group(t.orders, KEY, "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def _rank_sql(table: str, group: str, x: str, y: str) -> str:
    key = f"{group} AS g, " if group else "0 AS g, "
    return f"""WITH r AS (SELECT {key}{x} AS x, {y} AS y, row_number() OVER () AS i FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM r),
s AS (SELECT g, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY g),
p AS (SELECT a.g, count(*) AS pairs, count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty,
  count(*) FILTER ((a.x < b.x AND a.y < b.y) OR (a.x > b.x AND a.y > b.y)) AS c,
  count(*) FILTER ((a.x < b.x AND a.y > b.y) OR (a.x > b.x AND a.y < b.y)) AS d FROM r a JOIN r b ON a.g = b.g AND a.i < b.i GROUP BY 1)
SELECT {'s.g AS ' + group + ', ' if group else ''}n, coalesce(c, 0)::DOUBLE AS concordant, coalesce(d, 0)::DOUBLE AS discordant,
CASE WHEN pairs > tx AND pairs > ty THEN round((c - d) / (sqrt(pairs - tx) * sqrt(pairs - ty)), 6) END AS tau_b,
CASE WHEN pairs > tx AND pairs > ty THEN round(rho, 6) END AS rho FROM s LEFT JOIN p ON s.g = p.g"""


def _rank_agreement(df, x, y, by):
    out = rankings.rank_correlation(df, x, y, by)
    return out.select(*by, "n", *[F.col(c).cast("double").alias(c) for c in ("concordant", "discordant")],
                      *[F.round(c, 6).alias(c) for c in ("tau_b", "rho")])


@query(_rank_sql("lineitem", "l_suppkey", "l_quantity", "l_extendedprice"))
def rank_agreement(t):
    """How far quantity and price order the lines of each supplier alike."""
    return _rank_agreement(t.lineitem, "l_quantity", "l_extendedprice", ["l_suppkey"])


@query(_rank_sql("orders", "", "o_orderdate", "o_totalprice"))
def rank_agreement_all(t):
    """Whether later orders are dearer, over the whole table."""
    return _rank_agreement(t.orders, "o_orderdate", "o_totalprice", [])
