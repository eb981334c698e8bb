import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import amounts, dates, keys, markup, text as tx, vectors as vx


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(x):
    return F.lit(x)


def test_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2, "b:c:d")], "x int, y int, t string")
    prefix, rest = keys.split_prefix("t")
    got = df.select(keys.make_key(["x", "y"]).alias("k"), prefix.alias("p"), rest.alias("r")).collect()
    assert [tuple(r) for r in got] == [("1_nan", None, "a"), ("nan_2", "b", "c:d")]
    ref = keys.parse_report_ref(lit("12345_nan_20180331_0"))
    r = one(spark, e=ref["entity"], d=ref["report_date"])
    assert (r.e, r.d) == ("12345", date(2018, 3, 31))
    digits = one(spark, **keys.account_digits(lit("1234567")))
    assert list(digits) == list("1234567")


def test_uniform_is_repeatable_and_even(spark):
    df = spark.range(20_000).withColumn("u", keys.uniform("id", 3))
    assert df.collect() == df.repartition(7).orderBy("id").collect()
    stats = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and stats[1] >= 0 and stats[2] < 1


@pytest.mark.parametrize("value, scale, sign, want", [
    ("1,234.5", None, None, 1234.5), ("(12) 3", None, None, 123.0), ("", None, None, 0.0), ("-", "3", None, 0.0),
    ("7", "3", "-", -7000.0), ("5", "0", " - ", -5.0), ("1.5 2.3", None, None, None), (None, None, None, 0.0)])
def test_parse_amount(spark, value, scale, sign, want):
    v, s, g = (F.lit(x).cast("string") for x in (value, scale, sign))
    assert one(spark, v=amounts.parse_amount(v, s, g)).v == want


def test_amount_strict_and_units(spark):
    r = one(spark, a=amounts.parse_amount(lit("none"), strict=True), c=amounts.is_currency(lit("USD")), d=amounts.is_currency(lit("shares")),
            m=amounts.unit_method(lit("EUR")), n=amounts.is_numeric(lit(" 12 ")), o=amounts.is_numeric(lit("1x")),
            z=amounts.safe_divide(lit(1.0), lit(0.0)), b=amounts.blank_to(lit("   ")), k=amounts.case_map(lit("q"), {"a": 1}, 9))
    assert tuple(r) == (None, True, False, "Currency", True, False, None, "XX", 9)


def test_normal_functions(spark):
    from statistics import NormalDist
    std = NormalDist()
    df = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999)], "p double")
    for p, z, c in df.select("p", amounts.normal_quantile("p"), amounts.normal_cdf(amounts.normal_quantile("p"))).collect():
        assert abs(z - std.inv_cdf(p)) < 1e-6
        assert abs(c - p) < 1e-6


def test_dates(spark):
    opened, closed = dates.period_bounds(lit("2017-01-01\n2017-12-31"))
    instant = dates.period_bounds(lit(" 2017-12-31 "))
    r = one(spark, bad=dates.parse_yyyymmdd(lit("20171399")), good=dates.parse_yyyymmdd(lit(20171231)), o=opened, c=closed, io=instant[0], ic=instant[1],
            m=dates.duration_months(lit(date(2017, 1, 1)), lit(date(2018, 1, 1))), e=dates.epoch_months(lit(date(1971, 1, 1))),
            ym=dates.year_month(lit(date(2018, 3, 1))), back=dates.from_epoch_days(dates.epoch_days(lit(date(2001, 2, 3)))))
    assert tuple(r) == (None, date(2017, 12, 31), "20170101", "20171231", "", "20171231", 12, 12, 201803, date(2001, 2, 3))
    sunday = one(spark, **dates.date_parts(lit(date(2024, 1, 7)), "d"))
    assert tuple(sunday) == (1, 7, 1)


def test_sentences_and_clauses(spark):
    body = "\n_START_SECTION_\nTitle here. He wants e.g. a big red house. No such word in here at all. I Want it."
    r = one(spark, s=tx.sentences(tx.strip_markers(lit(body))))
    assert r.s == ["Title here", "He wants eg a big red house", "No such word in here at all", "I Want it"]
    sentence = "She said one thing, but they really wanted a very small boat, and left"
    r = one(spark, c=tx.clauses_with_keyword(lit(sentence), ["wanted"]), w=tx.clauses_with_keyword(lit(sentence), ["absent"]),
            single=tx.clauses_with_keyword(lit("only one clause with wanted"), ["wanted"]))
    assert [(x.clause_ref, x.text) for x in r.c] == [(1, "but they really wanted a very small boat")]
    assert [(x.clause_ref, x.text) for x in r.w] == [(-1, sentence)]
    assert [x.clause_ref for x in r.single] == [-1]


def test_keywords(spark):
    r = one(spark, a=tx.first_keyword(lit("I wish and want"), ["want", "wish"]), b=tx.first_keyword(lit("wanting"), ["want"]),
            c=tx.contains_keyword(lit("They WANT it"), ["want"]), d=tx.contains_keyword(lit("éwant"), ["want"]),
            p=tx.keyword_positions(lit("a want"), ["want", "no"]))
    assert tuple(r) == ("want", None, True, False, [2, -1])


def test_tokens(spark):
    r = one(spark, c=tx.clean_tokens(lit("<b>Hello</b>, World 42x  it's")), w=tx.join_wordpieces(F.array(*map(lit, ["[CLS]", "want", "##ed", "x", "[SEP]"]))),
            p=tx.token_positions(F.array(*map(lit, [5, 7, 5])), [7, 5, 9]), pad=tx.pad_tokens(F.array(*map(lit, [1, 2, 3])), 5),
            long=tx.pad_tokens(F.array(*map(lit, [1, 2, 3])), 2), m=tx.padding_mask(F.array(*map(lit, [4, 0]))), ascii=tx.ascii_only(lit("añb")))
    assert (r.c, r.w.strip(), r.p, r.pad, r.long, r.m, r.ascii) == (["hello", "world", "x", "it", "s"], "wanted x", [1, 0], [1, 2, 0, 0, 3], [1, 2, 3], [0, 1], "ab")
    given, wanted = tx.teacher_pairs(F.array(*map(lit, [1, 2, 3])))
    r = one(spark, g=given, w=wanted, l=tx.lookahead_mask(F.array(*map(lit, [1, 2]))), e=tx.lookahead_mask(F.array().cast("array<int>")))
    assert (r.g, r.w, r.l, r.e) == ([1, 2], [2, 3], [1, 0], [])


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    a, b = vec(1, 0, 2), vec(2, 1, 0)
    r = one(spark, d=vx.dot(a, b), c=vx.cosine_similarity(a, b), e=vx.euclidean(a, b), m=vx.manhattan(a, b), z=vx.cosine_similarity(a, vec(0, 0, 0)),
            same=vx.three_cos_mul(a, b, a, b))
    assert (r.d, r.m, r.z) == (2.0, 4.0, None)
    assert math.isclose(r.c, 2 / 5) and math.isclose(r.e, math.sqrt(6)) and abs(r.same) < 1e-5
    layers = F.array(vec(1, 1), vec(2, 2), vec(3, 3), vec(9, 9))
    r = one(spark, s=vx.sum_last(layers, 2), all=vx.sum_last(layers, 9), m=vx.mean_vectors(layers, 1, 1), e=vx.element_at_vec(layers, 1),
            none=vx.mean_vectors(layers, 3, 3), p=vx.interpolation_point(a, b, F.lit(0.5)))
    assert (r.s, r["all"], r.m, r.e, r.none, r.p) == ([12, 12], [15, 15], [2.5, 2.5], [2, 2], None, [1.5, 0.5, 1.0])


def test_dct_weights_match_definition(spark):
    n = 4
    for k in range(3):
        got = [r[0] for r in spark.range(n).orderBy("id").select(vx.dct_weight("id", F.lit(n), k)).collect()]
        scale = math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n)
        assert all(math.isclose(g, scale * math.cos(math.pi * k * (2 * i + 1) / (2 * n)), abs_tol=1e-12) for i, g in enumerate(got))


def test_markup(spark):
    html = "<p class='x' HREF = \"u?a=1\">a <b>bold</b> &amp; more</p><P/>\n<pre>no</pre><p>second</p >"
    r = spark.createDataFrame([(html,)], "h string").select(markup.elements("h", "p").alias("e")).first().e
    assert [x.inner for x in r] == ["a <b>bold</b> &amp; more", "", "second"]
    r = one(spark, h=markup.attribute(lit(r[0].attrs), "href"), c=markup.attribute(lit(r[0].attrs), "class"), n=markup.attribute(lit(r[0].attrs), "ref"),
            t=markup.plain_text(lit(r[0].inner)))
    assert tuple(r) == ("u?a=1", "x", None, "a bold & more")


def test_markup_short_ways_give_the_same(spark):
    """Texts without references, documents without nesting and every kind of hidden part."""
    texts = ["plain", "a <b>c</b>", "x\x01y", "&amp;lt; &lt;p&gt; &#65;", "&nope; z", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(markup.plain_text("t").alias("p")).collect()
    assert [r.p for r in rows] == ["plain", "a c", "x&y", "&lt; <p> A", " z", None]
    pages = ["a<!-- <p> -->b", "a<SCRIPT x>1<!--</script >b", "a<style>x</style>b", "a<styles>b", "a<!b", "<!-->c-->d"]
    rows = spark.createDataFrame([(t,) for t in pages], "t string").select(markup.visible("t").alias("v")).collect()
    assert [r.v for r in rows] == ["ab", "ab", "ab", "a<styles>b", "a<!b", "d"]
    nests = ["<x a='1'>p</x><x/>", "<x>a<x>b</x>c</x>", "none", "</x>", None]
    rows = spark.createDataFrame([(t,) for t in nests], "t string").select(markup.nested_elements("t", "x").alias("e")).collect()
    assert [None if r.e is None else [e.inner for e in r.e] for r in rows] == [["p", ""], ["b", "abc"], [], [], None]


def test_elements_of_hostile_markup(spark):
    """Unclosed, self-closed, nested and half-written tags, against a plain regular expression and a stack."""
    rng = random.Random(11)
    bits = ["<t>", "</t>", "<T a='1'>", "</t >", "<t/>", '<t b="/"/>', "<t x<t y>", "</t", "<tt>", "<", ">", "/>", "x", "</ t>", "<b>", "</b>", "<t a='</'/>", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, h string")

    def cut(match):
        head, rest = match.split(">", 1)
        return head, rest[:rest.rindex("</")] if "</" in rest else ""

    def innermost(text):
        return re.findall(r"(?is)<t\b[^>]*?(?:/>|>[^<]*(?:<(?!/?t\b)[^<]*)*</t\s*>)", text)

    def nested(text):
        depth = levels = 0
        for mark in re.findall(r"(?is)</t\s*>|<t\b[^>]*>", text):
            if mark.startswith("</"):
                depth = max(depth - 1, 0)
            else:
                levels = max(levels, depth + 1)
                depth += not mark.endswith("/>")
        found = []
        for _ in range(levels):
            found += innermost(text)
            text = re.sub(r"(?is)<t\b[^>]*?(?:/>|>([^<]*(?:<(?!/?t\b)[^<]*)*)</t\s*>)", lambda m: m[1] or "", text)
        return found if levels > 1 else innermost(texts[i])
    for r in df.select("i", markup.elements("h", "t").alias("e"), markup.nested_elements("h", "t").alias("n")).collect():
        i = r.i
        assert [tuple(x) for x in r.e] == [cut(m) for m in re.findall(r"(?is)<t\b[^>]*?(?:/>|>.*?</t\s*>)", texts[i])], texts[i]
        assert [tuple(x) for x in r.n] == [cut(m) for m in nested(texts[i])], texts[i]


def test_a_pattern_is_searched_once_per_text(spark):
    """The text of a unit, a period and a member is found by one search each, not one per place that uses it."""
    from factloom.plans import documents
    df = spark.createDataFrame([("<xbrli:unit id='u'><xbrli:measure>a&amp;b</xbrli:measure></xbrli:unit>",)], "html string")
    parsed = documents.parse_documents(df)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"</{tag}\\s*>") for tag in ("measure", "period", "explicitmember")] == [1, 1, 1]  # 7 each before
    assert parsed.first().units[0].units_measure == "a&b"
