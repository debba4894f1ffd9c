"""Golden tables of the scalar functions."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from factweave.functions import numbers as N
from factweave.functions import periods as P
from factweave.functions import strings as S


def rows(spark, data, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


QUANTITIES = [
    ("1,23,456", None, None, 123456.0, False), ("1,234,567", None, None, 1234567.0, False), ("0.9", None, None, 0.9, False), ("8,142 Cr", None, None, 8.142e10, False), ("1.4 Mn", None, None, 1.4e6, False),
    ("2.8 Bn", None, None, 2.8e9, False), ("5 lakh", None, None, 5e5, False), ("2.8 lakh crore", None, None, 2.8e12, False), ("5 thousand crore", None, None, 5e10, False), ("(452) Cr", None, None, -4.52e9, False),
    ("(6.3%)", None, None, -6.3, True), ("781 bps", None, None, 7.81, True), ("Nil", None, None, None, None), ("-", None, None, None, None), ("N/A", None, None, None, None), ("", None, None, None, None), ("  ", None, None, None, None),
    ("6", "billion", "per cent", 6.0, True), ("₹1.5 lakh", "lakh crore", None, 1.5e12, False), ("8,142 Cr", "million", None, 8.142e10, False), ("-5%", None, None, -5.0, True), (None, None, None, None, None), ("2 yrs", None, None, 2.0, False),
]


def test_parse_quantity(spark):
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(QUANTITIES)], "i int, raw string, s string, u string, want double, pct boolean")
    for r in df.select("raw", "want", "pct", N.parse_quantity(F.col("raw"), F.col("s"), F.col("u")).alias("q")).collect():
        if r.want is None:
            assert r.q is None, r
        else:
            assert math.isclose(r.q.normalized, r.want), r
            assert r.q.is_percent == r.pct, r


def test_intervals_and_bounds(spark):
    data = [("8,142 Cr", 8141.5e7, 8142.5e7, None), (">33,200", 33200.0, math.inf, "greater_than"), ("over 33,250", 33250.0, math.inf, "greater_than"), ("at least 100", 100.0, math.inf, "at_least"), ("less than 5", -math.inf, 5.0, "less_than"), ("approximately 90", 85.5, 94.5, "about"), ("overall 5", 4.5, 5.5, None)]
    for r in spark.createDataFrame(data, "raw string, lo double, hi double, bound string").withColumn("q", N.parse_quantity(F.col("raw"))).collect():
        assert (r.q.lo, r.q.hi, r.q.bound) == (r.lo, r.hi, r.bound), r


def test_truncation_digits_and_imprecision(spark):
    pairs = [("lakh", "lakh crore", True), ("crore", "lakh crore", True), ("thousand", "thousand crore", True), ("million", "cr", False), ("cr", "crore", False), ("crore", "crore", False), (None, "crore", False)]
    assert all(a == b for a, b in rows(spark, pairs, "a string, b string, w boolean", w=F.col("w"), g=N.truncates(F.col("a"), F.col("b"))))
    digits = [("1", 1), ("8", 1), ("0.5", 1), ("1.0", 2), ("20", 2), ("740", 3), ("8,142", 4), ("81,415.38", 7), ("0", 1), ("none", 0)]
    assert all(a == b for a, b in rows(spark, digits, "a string, w int", w=F.col("w"), g=N.written_digits(F.col("a"))))
    coarse = [("1 billion", "740 million", True), ("8", "8", False), ("5", "5.00", False), ("5", "5.2", True), ("over 1 billion", "740 million", False)]
    assert all(a == b for a, b in rows(spark, coarse, "a string, b string, w boolean", w=F.col("w"), g=N.rests_on_imprecision(N.parse_quantity(F.col("a")), N.parse_quantity(F.col("b")))))


def test_scale_after_figure_and_currency(spark):
    data = [
        ("5,444", "Total cash balance: Rs 5,444 Cr", "cr"), ("622", "the outlay is 622 INR crores.", "crores"), ("622", "Trade payables 622", None), ("6", "USD 602.6 billion, growth of 6 per cent", None), ("(217)", "Adjusted EBITDA (217) Cr", "cr"), ("5", "a provision of 125 crore", None),
    ]
    assert all(a == b for a, b in rows(spark, data, "f string, t string, w string", w=F.col("w"), g=N.scale_after_figure(F.col("f"), F.col("t"))))
    units = [("₹", "INR"), ("Rs.", "INR"), ("INR", "INR"), ("Indian Rupees", "INR"), ("Rupees in million", "INR"), ("US$", "USD"), ("US dollars", "USD"), ("Tons", "Tons"), ("K", None), ("million", None), ("lakh metric tonnes", "lakh metric tonnes"), (None, None)]
    assert all(a == b for a, b in rows(spark, units, "t string, w string", w=F.col("w"), g=N.normalize_currency(F.col("t"))))


D = date
PERIODS = [
    *[(x, D(2023, 4, 1), D(2024, 3, 31)) for x in ("FY24", "FY 2023-24", "2023-24", "FY2023-24", "fiscal year 2023-24", "FY-24")],
    ("CY2024", D(2024, 1, 1), D(2024, 12, 31)), ("nine months period ended December 31, 2021", D(2021, 4, 1), D(2021, 12, 31)), ("first eight months of FY24", D(2023, 4, 1), D(2023, 11, 30)), ("last three months of FY24", D(2024, 1, 1), D(2024, 3, 31)),
    ("Q4 FY24", D(2024, 1, 1), D(2024, 3, 31)), ("H1 FY25", D(2024, 4, 1), D(2024, 9, 30)), ("second half of FY25", D(2024, 10, 1), D(2025, 3, 31)), ("end of FY24", D(2024, 3, 31), D(2024, 3, 31)), ("Mar-26", D(2026, 3, 1), D(2026, 3, 31)),
    ("April-December 2024", D(2024, 4, 1), D(2024, 12, 31)), *[(x, None, None) for x in ("FY20 to FY24", "FY23-FY26", "till FY26", "FY25 (April-December)", "2024", "March 31, 2024", "revised upward since March 2026", "", None, "year ended February 30, 2024")],
]


def test_periods(spark):
    for r in spark.createDataFrame(PERIODS, "t string, a date, b date").withColumn("p", P.parse_period(F.col("t"))).collect():
        assert ((r.p.start, r.p.end) if r.p else (None, None)) == (r.a, r.b), r
    (r,) = rows(spark, [("FY24",)], "t string", p=P.parse_period(F.col("t"), F.lit(9)))
    assert (r[0].start, r[0].end) == (D(2023, 10, 1), D(2024, 9, 30))


def test_dates_and_years(spark):
    data = [("As at March 31, 2024", D(2024, 3, 31)), ("31st of March 2024", D(2024, 3, 31)), ("31/03/2024", D(2024, 3, 31)), ("one year from August 24, 2021", None), ("February 30, 2024", None), ("31/13/2024", None), (None, None)]
    assert all(a == b for a, b in rows(spark, data, "t string, w date", w=F.col("w"), g=P.bare_date(F.col("t"))))
    years = [("till FY26", "inception till FY26", True), ("financial year under review", "financial year ended March 31, 2026", True), ("April-December 2024", "April-December 2023", False), ("end of FY24", "end of FY23", False)]
    assert all(a == b for a, b in rows(spark, years, "a string, b string, w boolean", w=F.col("w"), g=P.years_compatible(F.col("a"), F.col("b"))))


def test_names_and_keys(spark):
    names = [("Mr. Arun Vale's", "arun vale"), ("The Group", "group"), ("the", "the"), (None, ""), ("Acme, Ltd.", "acme ltd")]
    assert all(a == b for a, b in rows(spark, names, "t string, w string", w=F.col("w"), g=S.normalize_surface(F.col("t"))))
    keys = [("period", True), ("reporting_period", True), ("geography", True), ("as_of", True), ("as_of_date", True), ("source_table", False), ("rounding", False), ("date", False), ("report_date", False)]
    assert all(a == b for a, b in rows(spark, keys, "k string, w boolean", w=F.col("w"), g=S.key_matches(F.col("k"), S.DISCRIMINATING)))
    dims = [("for_the_year_ended", "period"), ("end_date", "end_date"), ("as_on", "period"), ("segment", "segment")]
    assert all(a == b for a, b in rows(spark, dims, "k string, w string", w=F.col("w"), g=S.dimension_of(F.col("k"))))
    contrast = [("gross_inflows", "total_inflows", True), ("basic_eps", "diluted_eps", True), ("real_gdp_growth_rate", "gdp_growth_rate", True), ("total_finance_costs", "finance_costs", False), ("consolidated_net_assets", "total_consolidated_net_assets", False)]
    assert all(a == b for a, b in rows(spark, contrast, "a string, b string, w boolean", w=F.col("w"), g=S.contrastive(F.col("a"), F.col("b"))))
    entity = [("acme", "acme limited", True), ("acme limited", "acme corp limited", False), ("acme", "acme freight", False)]
    assert all(a == b for a, b in rows(spark, entity, "a string, b string, w boolean", w=F.col("w"), g=S.same_entity(F.col("a"), F.col("b"))))
    ids = [("Acme Pvt Limited", ["acme", "acme pvt", "acme pvt limited"]), ("Limited", ["limited"]), ("", [])]
    assert all(a == b for a, b in rows(spark, ids, "t string, w array<string>", w=F.col("w"), g=S.surface_identities(F.col("t"))))
    doubled = [("Total equity", "total_equity", True), ("Acme", "total_equity", False), ("", "total_equity", False)]
    assert all(a == b for a, b in rows(spark, doubled, "a string, b string, w boolean", w=F.col("w"), g=S.subject_names_the_measurement(F.col("a"), F.col("b"))))


@pytest.mark.parametrize("name, want", [("consolidated_revenue", ("revenue", "consolidated")), ("Standalone Net Worth", ("net_worth", "standalone")), ("consolidated", ("consolidated", None)), ("revenue", ("revenue", None))])
def test_split_consolidation(spark, name, want):
    (r,) = rows(spark, [(name,)], "n string", s=S.split_consolidation(F.col("n")))
    assert tuple(r[0]) == want
