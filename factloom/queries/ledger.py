"""Orders and line items as a ledger: references, encoding, injected rows, errors and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..features import inject
from ..functions.keys import uniform
from ..plans import ledger as plan
from ..session import cut_lineage
from ..stats import errors, tests
from .base import Tables, query, round_columns, rounded
from .filings import _u

LEDGER = """led AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS account_no, CAST(o_orderdate AS DATE) AS trans_date,
CAST(o_orderdate AS DATE) + CAST(o_orderkey % 33 - 2 AS INTEGER) AS system_date, substr(o_orderpriority, 3, 1) || CAST(o_orderkey AS VARCHAR) AS document_ref,
o_totalprice - 250000 AS bc_trans_value, o_orderstatus AS trans_type, CASE WHEN o_orderpriority = '5-LOW' THEN '   ' ELSE substr(o_orderpriority, 3, 2) END AS operator,
o_orderkey FROM orders)"""
REFS = """cur_c AS (SELECT trans_date, document_ref, CASE WHEN trans_type = 'P' THEN 'X' || account_no ELSE ' ' || account_no END AS account_no FROM led),
cust AS (SELECT trans_date, document_ref, max(coalesce(TRY_CAST(trim(account_no) AS BIGINT), 0)) AS cust_ref FROM cur_c GROUP BY 1, 2),
supp AS (SELECT trans_date, document_ref, max(l_suppkey) AS supp_ref FROM led JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def ledger(t: Tables):
    """Orders as ledger lines."""
    o, day, pr = t.orders, F.to_date("o_orderdate"), F.col("o_orderpriority")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("account_no"), day.alias("trans_date"),
        F.date_add(day, (F.col("o_orderkey") % 33 - 2).cast("int")).alias("system_date"),
        F.concat(F.substring(pr, 3, 1), F.col("o_orderkey").cast("string")).alias("document_ref"),
        (F.col("o_totalprice") - 250000).alias("bc_trans_value"), F.col("o_orderstatus").alias("trans_type"),
        F.when(pr == "5-LOW", "   ").otherwise(F.substring(pr, 3, 2)).alias("operator"), "o_orderkey")


def _references(t: Tables):
    led = ledger(t)
    text = F.when(F.col("trans_type") == "P", F.concat(F.lit("X"), "account_no")).otherwise(F.concat(F.lit(" "), "account_no"))
    c = led.withColumn("account_no", text)
    old, new = F.year("trans_date") < 1999, F.year("trans_date") >= 1998  # the two overlap by a year
    customers = plan.account_references(c.where(new), c.where(old), "document_ref", "cust_ref")
    s = (led.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
         .withColumn("account_no", F.col("l_suppkey").cast("string")))
    suppliers = plan.account_references(s.where(new), s.where(old), "document_ref", "supp_ref")
    return customers, suppliers


def _rows(t: Tables):
    led = ledger(t).drop("o_orderkey")
    customers, suppliers = _references(t)
    recent = F.year("trans_date") >= 1999
    return plan.ledger_rows(led.where(recent), led.where(~recent), customers, suppliers)


PARTS = ", ".join(f"CAST({f}({c}) AS INTEGER) AS {c}_{n}" if f != "dayofweek" else f"CAST(dayofweek({c}) + 1 AS INTEGER) AS {c}_{n}"
                  for c in ("trans_date", "system_date") for f, n in (("month", "mth"), ("day", "dom"), ("dayofweek", "dow")))


@query(f"""WITH {LEDGER}, {REFS} SELECT {', '.join(f'substr(account_no, {i}, 1) AS account_digit{i}' for i in range(1, 7))}, right(account_no, 1) AS account_digit7,
trans_date, system_date, {PARTS}, CAST(date_diff('day', trans_date, system_date) AS INTEGER) AS posting_delay, left(document_ref, 1) AS document_ref_l1,
bc_trans_value, trans_type, CASE WHEN trim(operator) = '' THEN 'XX' ELSE operator END AS operator, coalesce(cust_ref, -1) AS cust_ref,
coalesce(supp_ref, -1) AS supp_ref, document_ref FROM led LEFT JOIN supp USING (trans_date, document_ref) LEFT JOIN cust USING (trans_date, document_ref)""")
def ledger_rows(t):
    return _rows(t)


@query(f"WITH {LEDGER}, {REFS} SELECT trans_date, document_ref, cust_ref FROM cust")
def account_references(t):
    return _references(t)[0]


@query(f"""WITH {LEDGER} SELECT o_orderkey, round((ln(1 + abs(bc_trans_value)) - lo) / (hi - lo), 6) AS bc_trans_value, CASE WHEN bc_trans_value >= 0 THEN 1 ELSE 0 END AS is_debit,
{', '.join(f"CASE WHEN trans_type = '{s}' THEN 1 ELSE 0 END AS trans_type_{s}" for s in 'FOP')}
FROM led, (SELECT min(ln(1 + abs(bc_trans_value))) AS lo, max(ln(1 + abs(bc_trans_value))) AS hi FROM led)""")
def ledger_encoded(t):
    rows = ledger(t).select("o_orderkey", "bc_trans_value", "trans_type")
    out, _, _ = plan.prepare_ledger(rows, ["trans_type"], [], "bc_trans_value")
    return round_columns(out, ["bc_trans_value"])


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((abs(l_quantity - 25) + abs(l_discount - 0.05) * (1 + abs((CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END) - 0.5))) / 2, 6) AS error FROM lineitem""")
def reconstruction_error(t):
    """Errors against a constant reconstruction; the discount's counts more where its sign flag is wrong."""
    rows = t.lineitem.withColumns({
        "l_quantity_out": F.lit(25.0), "l_discount_out": F.lit(0.05),
        "l_discount_ispos": (F.col("l_tax") >= 0.04).cast("int"), "l_discount_ispos_out": F.lit(0.5)})
    out = errors.recon_error(rows, ["l_quantity"], ["l_discount"])
    return round_columns(out, ["error"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error")


def _injected(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return inject.inject_uniform_rows(rows, 1000, {"l_quantity": (0, 100, 0), "l_extendedprice": (0, 200000, 2), "l_discount": (0, 1, 2), "l_tax": (0, 1, 2)}, 20181208)


INJECTED = f"""r AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, false AS is_random FROM lineitem UNION ALL
SELECT round({_u('i', 20181208)} * 100, 0), round({_u('i', 20181209)} * 200000, 2), round({_u('i', 20181210)}, 2), round({_u('i', 20181211)}, 2), true FROM range(0, 1000) q(i))"""
SQ = "(pow(l_quantity / 50 - 0.5, 2) + pow(l_extendedprice / 100000 - 0.5, 2) + pow(l_discount * 10 - 0.5, 2) + pow(l_tax * 12.5 - 0.5, 2)) / 4"


def _scaled(t: Tables):
    cols = {"l_quantity": 1 / 50, "l_extendedprice": 1 / 100000, "l_discount": 10.0, "l_tax": 12.5}
    rows = _injected(t)
    scaled = rows.withColumns({c: F.col(c) * F.lit(f) if f > 1 else F.col(c) / F.lit(round(1 / f)) for c, f in cols.items()})
    return errors.squared_error(scaled.withColumns({f"{c}_out": F.lit(0.5) for c in cols}), list(cols))


@query(f"WITH {INJECTED} SELECT is_random, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price, round(max(l_tax), 6) AS tax FROM r GROUP BY 1")
def injected_rows(t):
    return _injected(t).groupBy("is_random").agg(F.count("*").alias("n"), rounded(F.avg("l_quantity")).alias("quantity"),
                                                 rounded(F.avg("l_extendedprice"), 4).alias("price"), rounded(F.max("l_tax")).alias("tax"))


@query(f"WITH {INJECTED} SELECT is_random, count(*) AS n, round(avg({SQ}), 6) AS mean_error FROM r GROUP BY 1")
def errors_by_flag(t):
    return round_columns(errors.error_by_flag(_scaled(t), "is_random"), ["mean_error"])


@query(f"""WITH {INJECTED}, e AS (SELECT is_random AS f, {SQ} AS v FROM r), g AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0,
avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0, var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v0 FROM e)
SELECT n1 AS n_true, n0 AS n_false, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t, true AS found FROM g""")
def injected_test(t):
    """Injected rows must score higher than real ones."""
    out = tests.welch_t(_scaled(t), "error", "is_random")
    return out.select("n_true", "n_false", F.round("t", 5).alias("t"), ((F.col("t") > 0) & (F.col("p") < 0.001)).alias("found"))


@query("""SELECT o_orderkey, round(pow(o_totalprice / 500000 - 0.5, 2), 9) AS error FROM orders WHERE o_orderstatus <> 'P'
ORDER BY round(pow(o_totalprice / 500000 - 0.5, 2), 9) DESC, o_orderkey LIMIT 100""")
def top_anomalies(t):
    scored = t.orders.withColumn("error", F.round(F.pow(F.col("o_totalprice") / 500000 - 0.5, F.lit(2.0)), 9)).withColumn("fake", F.col("o_orderstatus") == "P")
    return errors.top_anomalies(scored, 100, "error", "o_orderkey", "fake").select("o_orderkey", "error")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow(l_quantity / 50 - 0.5, 2), 6) AS quantity, round(pow(l_discount * 10 - 0.5, 2), 6) AS discount,
round(greatest(pow(l_tax * 12.5 - 0.5, 2), pow(l_extendedprice / 100000 - 0.5, 2)), 6) AS money FROM lineitem),
l AS (UNPIVOT e ON quantity, discount, money INTO NAME f VALUE v), r AS (SELECT *, list_sort([{'e': -quantity, 'f': 'quantity'}, {'e': -discount, 'f': 'discount'}, {'e': -money, 'f': 'money'}]) AS s FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s[1].f AS field_1, -s[1].e AS error_1, s[2].f AS field_2, -s[2].e AS error_2 FROM r""".replace(
    "l AS (UNPIVOT e ON quantity, discount, money INTO NAME f VALUE v), ", ""))
def top_fields(t):
    sq = {"q": F.col("l_quantity") / 50, "d": F.col("l_discount") * 10, "t": F.col("l_tax") * 12.5, "p": F.col("l_extendedprice") / 100000}
    rows = t.lineitem.withColumns({k: F.round(F.pow(v - 0.5, F.lit(2.0)), 6) for k, v in sq.items()})
    return errors.top_fields_per_row(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                     {"quantity": ["q"], "discount": ["d"], "money": ["t", "p"]}, 2)


@query(f"""SELECT o_orderkey, CASE WHEN {_u('o_orderkey', 1)} < 0.05 THEN 1 - y ELSE y END AS flipped,
round(CASE WHEN y = 1 THEN 0.7 + {_u('o_orderkey', 2)} * 0.5 ELSE y END, 9) AS smooth FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)""")
def label_noise(t):
    y = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("flipped"), (F.col("o_orderstatus") == "F").cast("int").alias("smooth"))
    noisy = inject.smooth_labels(inject.flip_labels(y, "flipped", "o_orderkey", 0.05, 1), "smooth", "o_orderkey", seed=2)
    return noisy.withColumn("smooth", rounded("smooth", 9))


@query("""SELECT 'l_quantity' AS field, count(*) AS n, round(sum(l_discount + l_tax), 4) AS rest FROM lineitem UNION ALL
SELECT 'l_discount', count(*), round(sum(l_quantity + l_tax), 4) FROM lineitem UNION ALL SELECT 'l_tax', count(*), round(sum(l_quantity + l_discount), 4) FROM lineitem""")
def leave_one_out(t):
    """Per field the table without it."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    parts = inject.leave_one_out(t.lineitem.select(*cols), cols)
    out = None
    for field, df in parts.items():
        total = sum((F.col(c) for c in df.columns), F.lit(0.0))
        row = df.agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("rest")).select(F.lit(field).alias("field"), "n", "rest")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def fake_rows(t):
    """Rows from truncated normals fitted to the line items: their range and mean."""
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    fake = inject.fake_truncated_normal(t.lineitem, cols, 10_000)
    return fake.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


@query()
def ledger_anomalies(t):
    """The ledger encoded, reconstructed by a linear model, and the fields that explain each error."""
    rows = _rows(t).select("document_ref", "trans_type", "operator", "document_ref_l1", "account_digit7", "bc_trans_value", "posting_delay")
    factors, numbers = ["trans_type", "operator", "document_ref_l1", "account_digit7"], ["posting_delay", "bc_trans_value"]
    # levels, limits and the model are fitted in several passes: read the joined rows once
    encoded, levels, _ = plan.prepare_ledger(cut_lineage(rows), factors, ["posting_delay"], "bc_trans_value")
    return plan.score_ledger(encoded, levels, numbers, "document_ref", 8)[1]


@query(f"SELECT o_orderkey, round({_u('o_orderkey', 11)}, 9) AS u FROM orders")
def hash_uniform(t):
    return t.orders.select("o_orderkey", rounded(uniform("o_orderkey", 11), 9).alias("u"))


