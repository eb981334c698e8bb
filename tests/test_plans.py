from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions.amounts import parse_amount
from factloom.functions.markup import elements, nested_elements, plain_text
from factloom.operators import dedupe
from factloom.plans import documents, filings, ledger, text


def doc(fact, unit="GBP", context="c1", extra=""):
    return f"""<html><body>{fact}<ix:resources>
<xbrli:unit id="{unit}"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>
<xbrli:context id="{context}"><xbrli:entity><xbrldi:explicitMember dimension="d">uk:Director1</xbrldi:explicitMember></xbrli:entity>
<xbrli:period><xbrli:startDate>2017-01-01</xbrli:startDate>
<xbrli:endDate>2017-12-31</xbrli:endDate></xbrli:period></xbrli:context>{extra}</ix:resources></body></html>"""


FACT = '<ix:nonFraction name="uk:{0}" contextRef="{1}" unitRef=" GBP " scale="3" sign="-" format="x">1,2<b>34</b>.5</ix:nonFraction>'


@pytest.fixture(scope="module")
def docs(spark):
    instant = '<xbrli:context id="c2"><xbrli:period><xbrli:instant>2016-12-31</xbrli:instant></xbrli:period></xbrli:context>'
    return spark.createDataFrame([
        ("SO1", "20180131", doc(FACT.format("OperatingProfitLoss", "c1") + FACT.format("Cash", "c2"), extra=instant)),
        ("SO2", "20180131", "<html><p>nothing</p></html>"),
        ("SO3", "20180131", doc(FACT.format("Cash", "missing"))),
        ("SO4", "20180131", doc('<ix:nonfraction name="Cash" contextref="c1">7</ix:nonfraction>')),
        ("SO5", "20180131", "<ix:nonFraction name='a' <broken"), ("SO6", "20180131", None)], "crn string, report_date string, html string")


def test_document_status(docs):
    got = {r.crn: r.status for r in documents.parse_documents(docs).collect()}
    assert got == {"SO1": "ok", "SO2": "no data", "SO3": "parse error", "SO4": "ok", "SO5": "no data", "SO6": "no data"}


def test_facts(docs):
    rows = {(r.crn, r.item): r for r in documents.extract_facts(docs).collect()}
    assert set(rows) == {("SO1", "OperatingProfitLoss"), ("SO1", "Cash"), ("SO4", "Cash")}
    r = rows["SO1", "OperatingProfitLoss"]
    assert (r.value, r.standard, r.units, r.units_measure, r.context, r.period_open, r.period_close, r.reportincludespl) == (
        -1234500.0, "uk", "GBP", "iso4217:GBP", "Director1", "20170101", "20171231", 1)
    r = rows["SO1", "Cash"]
    assert (r.context, r.period_open, r.period_close, r.reportincludespl) == ("None", "", "20161231", 1)
    r = rows["SO4", "Cash"]
    assert (r.value, r.standard, r.units, r.reportincludespl) == (7.0, None, None, 0)


def test_reports(spark, docs):
    facts = documents.extract_facts(docs)
    mapping = spark.createDataFrame([("OperatingProfitLoss", "Profit"), ("Cash", "Cash")], "item string, item_mapped string")
    wide = documents.wide_reports(documents.prepare_reports(facts, mapping), ["Profit_curr", "Cash_prev", "Cash_curr"])
    got = {r.report_ref: r for r in wide.collect()}
    r = got["SO1_20180131"]
    assert (r.Profit_curr, r.Cash_prev, r.Cash_curr, r.max_close, r.duration) == (-1234500.0, -1234500.0, None, 576, 12)


def test_filings(spark):
    facts = spark.createDataFrame([
        ("a1", "Cash", "us-gaap/2018", None, 20180331, 0, "USD", 10.0), ("a1", "Cash", "us-gaap/2018", None, 20180331, 0, "EUR", 99.0),
        ("a1", "Debt", "us-gaap/2018", None, 20180331, 0, "EUR", 6.0), ("a2", "Cash", "ifrs/2017", "sub", 20180630, 0, "EUR", 4.0),
        ("a2", "Cash", "dei", "sub", 20180630, 0, "EUR", 5.0), ("a3", "Cash", "us-gaap", None, 19981231, 0, "USD", 1.0),
        ("zz", "Cash", "us-gaap", None, 20180331, 0, "USD", 1.0), ("a1", "SharesOut", "dei", None, 20180331, 0, "shares", 5.0)],
        "adsh string, tag string, version string, coreg string, ddate int, qtrs int, uom string, value double")
    subs = spark.createDataFrame([("a1", 11, 100, 20180331, "Q1"), ("a2", 22, 200, 20180630, "Q2"), ("a3", 33, None, 19981231, "Q4")],
                                 "adsh string, cik bigint, sic int, period int, fp string")
    joined = filings.join_submissions(facts, subs)
    assert {r.report_ref for r in joined.collect()} == {"11_nan_20180331_0", "22_sub_20180630_0", "33_nan_19981231_0", "nan_nan_20180331_0"}
    one = filings.dedupe_facts(joined)
    kept = {(r.report_ref, r.tag): (r.uom, r.version, r.value) for r in one.collect()}
    assert kept["22_sub_20180630_0", "Cash"] == ("EUR", "ifrs", 4.0)  # equal units: the preferred standard
    assert len(kept) == 6
    many = spark.createDataFrame([(f"{chr(65 + i // 26)}{chr(65 + i % 26)}X",) for i in range(60) for _ in range(60 - i)], "uom string")
    ranks = {r.uom: r.priority for r in dedupe.priority_from_counts(many, "uom").collect()}
    assert [ranks[f"{chr(65 + i // 26)}{chr(65 + i % 26)}X"] for i in range(60)] == list(range(60))  # all values are ranked
    first = filings.dedupe_facts(spark.createDataFrame(
        [("r", "T", "dei/2014", 1, 0, "USD", 1.0), ("r", "T", "us-gaap/2018", 2, 0, "USD", 2.0)],
        "report_ref string, tag string, version string, ddate int, qtrs int, uom string, value double")).first()
    assert (first.version, first.value) == ("us-gaap", 2.0)
    tags = [r.tag for r in filings.popular_tags(one, 5).collect()]
    assert tags == ["Cash", "Debt"]
    rates = spark.createDataFrame([(201803, "EUR", 2.0), (201806, "EUR", 4.0)], "month int, currency string, rate double")
    wide = {r.report_ref: r for r in filings.wide_filings(one, rates, ["Cash", "Debt"], ["EUR"]).collect()}
    assert set(wide) == {"11_nan_20180331_0", "22_sub_20180630_0"}  # no sic, or too old: left out
    assert wide["22_sub_20180630_0"].Cash == 1.0 and wide["22_sub_20180630_0"].Debt is None
    a = wide["11_nan_20180331_0"]
    assert a.Debt == 3.0


def test_encoded_filings(spark):
    df = spark.range(400).select(F.concat(F.lit("r"), "id").alias("ref"), (F.col("id") % 40).alias("cik"), (F.col("id") - 200.0).alias("a"),
                                 F.when(F.col("id") % 10 > 0, F.col("id") * 2.0).alias("b"))
    enc, params = filings.encode_filings(df, ["a", "b"], "cik", (0.6, 0.2, 0.2))
    assert enc.count() == 360 and params.count() == 2
    assert enc.groupBy("cik").agg(F.count_distinct("split").alias("k")).where("k > 1").isEmpty()
    r = enc.agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9


def test_ledger(spark):
    cols = "account_no string, trans_date date, system_date date, document_ref string, bc_trans_value double, trans_type string, operator string"
    d = date(2018, 3, 4)
    cur = spark.createDataFrame([("1234567", d, date(2018, 3, 2), "A1", -5.0, "SI", "   "), ("7654321", d, d, "B2", 9.0, "PI", "JD")], cols)
    hist = spark.createDataFrame([("1111111", d, d, "C3", 1.0, "SI", None)], cols)
    refs = "trans_date date, trans_ref string, account_no string"
    cust = ledger.account_references(spark.createDataFrame([(d, "A1", " 42"), (d, "A1", "x9"), (d, "A1", "42")], refs),
                                     spark.createDataFrame([(d, "A1", "7"), (d, "Q", "bad")], refs), "trans_ref", "cust_ref")
    assert {(r.document_ref, r.cust_ref) for r in cust.collect()} == {("A1", 42), ("Q", 0)}
    supp = cust.where("document_ref = 'none'").withColumnRenamed("cust_ref", "supp_ref")
    rows = {r.document_ref: r for r in ledger.ledger_rows(cur, hist, cust, supp).collect()}
    a = rows["A1"]
    assert (a.account_digit1, a.account_digit7, a.posting_delay, a.operator, a.cust_ref, a.supp_ref, a.trans_date_dow, a.document_ref_l1) == (
        "1", "7", -2, "XX", 42, -1, 1, "A")
    assert rows["C3"].operator is None and rows["B2"].cust_ref == -1


def test_ledger_scoring_finds_odd_rows(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"),
                                 F.when(F.col("id") % 2 == 0, 10.0).otherwise(-500.0).alias("v"), (F.col("id") % 2).cast("double").alias("n"))
    odd = spark.createDataFrame([("odd", "a", 300.0, 1.0)], df.schema)
    enc, levels, limits = ledger.prepare_ledger(df.unionByName(odd), ["t"], ["n"], "v")
    scored, fields = ledger.score_ledger(enc, levels, ["n", "v"], "key", 1)
    assert levels == {"t": ["a", "b"]} and limits.count() == 2
    assert scored.orderBy(F.desc("error")).first().key == "odd"
    assert fields.where("key = 'odd'").first().field_1 in ("n", "v", "t", "is_debit")


def test_keyword_text(spark):
    df = spark.createDataFrame([("q1", "He said the big dog wanted food, and the small cat really wanted some more milk. Nobody else Wanted a thing here. Short wanted one."),
                                ("q2", "no capital wanted here at all"), ("q3", None)], "id string, text string")
    s = text.keyword_sentences(df, "id", "text", ["wanted"]).orderBy("sentence_ref").collect()
    assert [(r.id, r.sentence_ref) for r in s] == [("q1", 0), ("q1", 1)]
    c = text.keyword_clauses(df, "id", "text", ["wanted"]).orderBy("sentence_ref", "clause_ref").collect()
    assert [(r.sentence_ref, r.clause_ref) for r in c] == [(0, 0), (0, 1), (1, -1)]
    assert c[1].text == "and the small cat really wanted some more milk"


def test_cause_effect(spark):
    df = spark.createDataFrame([("a", "I like to eat ice cream because it is very sweet indeed. Because one two three four five. "
                                      "It is too hot outside now therefore we all stay at home. Short because x.")], "id string, text string")
    got = text.cause_effect(df, "id", "text", {"because": True, "therefore": False}).orderBy("searchword").collect()
    assert [(r.searchword, r.incidence, r.effect.strip(), r.cause.strip()) for r in got] == [
        ("because", 0, "I like to eat ice cream", "it is very sweet indeed"),
        ("therefore", 0, "we all stay at home", "It is too hot outside now")]


def test_crop_and_positions(spark):
    df = spark.createDataFrame([(i, list(range(i))) for i in range(1, 21)], "id int, t array<int>")
    assert sorted(r.id for r in text.crop_by_length(df, "t", 10, 0.9).collect()) == list(range(10, 19))
    assert text.with_searchwords(df, "t", [15, 0]).where("size(positions) = 2").count() == 5


def test_character_references(spark):
    cases = {"&#163;1,234": "£1,234", "&#xA3;1,234": "£1,234", "a&amp;nbsp;b": "a&nbsp;b", "&amp;#163;": "&#163;", "x&unknown;y": "xy",
             "&#8364; &euro;": "€ €", "&#1114112;&#xD800;z": "z", "&#x1F600;": "\U0001F600", "plain <b>text</b>": "plain text", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", plain_text("t").alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases
    amounts = spark.createDataFrame([("&#163;1,234",), ("&#xA3;1,234",)], "t string").select(
        parse_amount(plain_text("t"), F.lit("0"), F.lit(None).cast("string")).alias("v")).collect()
    assert [r.v for r in amounts] == [1234.0, 1234.0]


def test_nested_elements(spark):
    html = '<x id="1">a<X id="2">b<x id="3">c</x></x>d</x><x id="4"/><x id="5">e < f</x><x id="6">open'
    got = spark.createDataFrame([(html,), ("none",)], "h string").select(nested_elements("h", "x").alias("e")).collect()
    assert sorted((e.attrs, e.inner) for e in got[0].e)[:5] == [
        ('<X id="2"', "bc"), ('<x id="1"', "abcd"), ('<x id="3"', "c"), ('<x id="4"/', ""), ('<x id="5"', "e < f")]
    assert got[1].e == []


def test_hidden_and_nested_facts(spark):
    def fact(name, text):
        return f'<ix:nonFraction name="uk:{name}" contextRef="c" unitRef="u" scale="0">{text}</ix:nonFraction>'
    html = (f"<!-- {fact('Hidden', '1')} --><script>{fact('Scripted', '2')}</script>" + fact("Outer", "4" + fact("Inner", "&#163;2"))
            + '<xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>'
            + '<xbrli:unit id="u"><xbrli:measure>second</xbrli:measure></xbrli:unit>'
            + '<xbrli:context id="c"><xbrli:period><xbrli:instant>2018-01-31</xbrli:instant></xbrli:period></xbrli:context>')
    docs = spark.createDataFrame([("C1", "20180131", html)], "crn string, report_date string, html string")
    got = {r.item: (r.value, r.units_measure) for r in documents.extract_facts(docs).collect()}
    assert got == {"Outer": (42.0, "iso4217:GBP"), "Inner": (2.0, "iso4217:GBP")}
