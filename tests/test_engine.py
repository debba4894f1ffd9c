"""Operators of the engine on small fixtures."""

import json
import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factweave.operators import adjudicate, align, blocking, decide, eager, extract, partition, registry, tally, textstruct, units
from factweave.operators import facts as FA
from factweave.sources import ledger
from factweave.streaming import ingest

COLUMNS = "fact_id string, doc_id long, claim_text string, subject_surface string, subject_key string, predicate string, predicate_canonical string, value_json string, value_kind string, qualifiers_json string, evidence_json string, align_status string, created_at timestamp"


def fact(i, raw="8,142 Cr", doc=1, predicate="revenue", subject="Acme Logistics Limited", key=None, kind="quantity", scale=None, unit=None, **quals):
    bag = {k: {"value": v, "provenance": "stated"} for k, v in quals.items()}
    return (i, doc, f"{subject} {predicate} was {raw}.", subject, key, predicate, predicate, json.dumps({"raw": raw, "kind": kind, "unit": unit, "scale": scale}), kind, json.dumps(bag), json.dumps({"page": 1, "char_start": hash(i) % 10**6, "char_end": 10**6}), "exact", None)


MINI = [
    fact("f_deck", "8,142 Cr", 1, period="FY 2023-24"), fact("f_report", "81,415.38 mn", 2, period="FY 2023-24", consolidation="consolidated"), fact("f_prior", "72,236.47 mn", 2, period="FY 2022-23", consolidation="consolidated"),
    fact("f_third", "79,900.00 mn", 3, period="FY 2023-24", consolidation="consolidated"), fact("f_other", "84,000", 3, "employee_count", period="FY 2023-24"),
]
RULES = [  # a, b, rule
    (dict(subject="Acme"), dict(subject="Acme Freight Private Limited"), "comparison_key_differs"),
    (dict(raw="5%"), dict(raw="5"), "incomparable_values"),
    (dict(raw="not said"), dict(), "incomparable_values"),
    (dict(raw="7", period="FY24"), dict(raw="7", period="FY23"), "context_differs_values_agree"),
    (dict(raw="1 billion"), dict(raw="740 million"), "agreement_rests_on_imprecision"),
    (dict(raw="7", consolidation="consolidated"), dict(raw="7", consolidation="standalone"), "keys_match_intervals_overlap"),
    (dict(raw="7", period="till FY26"), dict(raw="9", period="inception till FY26"), "discriminating_qualifier_differs"),
    (dict(raw="7", as_at="till FY26"), dict(raw="9", as_of="inception till FY26"), "unestablished_context_difference"),
    (dict(raw="7", as_at="March 31, 2024"), dict(raw="3.70", as_of="December 31, 2021"), "discriminating_qualifier_differs"),
    (dict(raw="7", service="air"), dict(raw="9", service="sea"), "discriminating_qualifier_differs"),
    (dict(raw="7", segment="air"), dict(raw="9"), "missing_qualifier_guard"),
    (dict(raw="7", segment="air"), dict(raw="9", segment="Air "), "same_context_disjoint_intervals"),
    (dict(raw="March 31, 2024", kind="date"), dict(raw="31 March 2024", kind="date"), "keys_match_intervals_overlap"),
    (dict(raw="Yes", kind="text"), dict(raw="no", kind="text"), "same_context_disjoint_intervals"),
    (dict(raw="7", period="till FY26"), dict(raw="7", period="inception till FY26"), "keys_match_intervals_overlap"),
]


def test_mini_corpus(spark):
    facts = FA.comparable(spark.createDataFrame(MINI + MINI[:1], COLUMNS))
    got = {(r.fact_a, r.fact_b): (r.verdict, r.qualifier_key) for r in decide.relations(blocking.exact_key_pairs(facts), facts).collect()}
    assert got == {
        ("f_deck", "f_report"): ("corroborates", None), ("f_report", "f_third"): ("contradicts", None), ("f_prior", "f_report"): ("reconciled_by_context", "period"), ("f_prior", "f_third"): ("reconciled_by_context", "period"),
        ("f_deck", "f_prior"): ("insufficient_context", "consolidation"), ("f_deck", "f_third"): ("insufficient_context", "consolidation"),
    }


def test_every_rule(spark):
    rows = [fact(f"{k:02d}{x}", doc=k, **args) for k, (a, b, _) in enumerate(RULES) for x, args in (("a", a), ("b", b))]
    facts = FA.comparable(spark.createDataFrame(rows, COLUMNS))
    pairs = spark.createDataFrame([(f"{k:02d}a", f"{k:02d}b") for k in range(len(RULES))], "fact_a string, fact_b string")
    got = {int(r.fact_a[:2]): r.rule_fired for r in decide.relations(pairs, facts).collect()}
    assert {k: got[k] for k in got} == {k: rule for k, (_, _, rule) in enumerate(RULES)}


def test_partitions(spark):
    share = lambda p, k, v: [fact(f"{p}{i}", f"{x}%", i, p, **{k: c}, period="FY24") for i, (c, x) in enumerate(v.items())]
    rows = share("a", "region", {"north": 63, "south": 15, "west": 22}) + share("b", "region", {"x": 100, "y": 97, "z": 96}) + share("c", "year", {"2023": 60, "2024": 40}) + [fact("d1", "630", predicate="d", region="n"), fact("d2", "370", predicate="d", region="s")]
    facts = FA.comparable(spark.createDataFrame(rows, COLUMNS))
    assert {r.fact_id for r in partition.members(facts).collect()} == {"a0", "a1", "a2"}
    rel = decide.relations(blocking.exact_key_pairs(facts), facts).where("fact_a like 'a%'").collect()
    assert {r.rule_fired for r in rel} == {"complementary_categories"} and {r.qualifier_key for r in rel} == {"region"}


def test_blocking(spark):
    facts = FA.comparable(spark.createDataFrame(MINI, COLUMNS))
    key, value = blocking.exact_key_pairs(facts), blocking.magnitude_pairs(facts)
    assert {tuple(r) for r in value.collect()} == {("f_deck", "f_report")}
    both = blocking.union_of({"key": key, "value": value})
    assert both.where("size(blocked_by) = 2").count() == 1
    (s,) = blocking.statistics(both, facts).collect()
    assert (s.n_facts, s.theoretical, s.candidates, s.duplicates_dropped) == (5, 10, 6, 1)
    assert blocking.only_touching(both, facts.where("fact_id = 'f_deck'")).count() == 3


def exchanges_above_joins(df):
    """Exchanges whose input is a join's output, in the plan as made."""
    depth, found = [], 0
    for line in df._jdf.queryExecution().sparkPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = [(d, x) for d, x in depth if d < at] + [(at, line)]
        found += "Join" in line and any("Exchange" in x or "Aggregate" in x for _, x in depth[:-1])
    return found


def test_pairs_meet_once_without_an_exchange_of_the_pairs(spark):
    rows = [("a", "Acme Limited", "K", "m", 100.0), ("b", "Acme Limited", "K", "m", 100.1), ("c", "Acme", "K", "m", 100.7), ("d", "acme", None, "n", 90.0), ("a", "Acme", None, "n", 100.7), ("d", "Acme Limited", None, "m", None), ("e", "Acme Limited", "", "m", None)]
    facts = spark.createDataFrame(rows, "fact_id string, subject_surface string, subject_key string, measure string, v double").withColumn("quantity", F.struct(F.col("v").alias("normalized"), F.lit(False).alias("is_percent")))
    for pairs, want in ((blocking.exact_key_pairs(facts), ["ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce", "de"]), (blocking.magnitude_pairs(facts), ["ab", "ac", "bc"]), (blocking.exact_key_pairs(facts, within=["v"]), ["de"])):
        assert sorted(r.fact_a + r.fact_b for r in pairs.collect()) == want
        assert exchanges_above_joins(pairs) == 0


def test_value_pairs_of_facts_meet_without_an_exchange_of_the_pairs(spark, monkeypatch):
    from factweave.plans import views

    rows = [(f"f{i}", v, json.dumps({"unit": u}), None) for i, (v, u) in enumerate([(100.0, None), (100.1, "Cr"), (100.7, None), (100.0, "per cent"), (-100.0, None), (0.0, None), (0.0, None), (None, None)])]
    df = spark.createDataFrame([*rows, rows[0]], "fact_id string, value_normalized double, value_json string, created_at timestamp")
    monkeypatch.setattr(views, "table", lambda s, d, name: df)
    pairs = views.facts_value_pairs(spark, "")
    assert sorted(map(tuple, pairs.collect())) == [("f0", "f1"), ("f0", "f2"), ("f1", "f2"), ("f5", "f6")]
    assert exchanges_above_joins(pairs) == 0


def test_blocking_of_facts_with_three_strategies(spark, monkeypatch):
    from factweave.plans import core

    vectors = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0], [0.1, 0.9]]
    schema = COLUMNS + ", embedding array<float>, embedding_model string"
    df = spark.createDataFrame([(*r, v, "m") for r, v in zip(MINI, vectors)], schema)
    facts = FA.comparable(df)
    key, value, near = blocking.exact_key_pairs(facts), blocking.magnitude_pairs(facts), blocking.semantic_pairs(df, k=1)
    assert {tuple(r) for r in near.collect()} == {("f_deck", "f_report"), ("f_other", "f_prior")}
    whole = blocking.union_of({"key": key, "value": value, "semantic": near})
    folded = blocking.folded_union(facts, {"value": value, "semantic": near})
    want = {(r.fact_a, r.fact_b): tuple(r.blocked_by) for r in whole.collect() if r.blocked_by != ["key"]}
    assert {(r.fact_a, r.fact_b): tuple(r.blocked_by) for r in folded.where("not folded").collect()} == want
    assert blocking.statistics(folded, facts).first() == blocking.statistics(whole, facts).first()
    registry_ = spark.createDataFrame([("revenue", '["sales"]')], "canonical string, aliases_json string")
    monkeypatch.setattr(core, "table", lambda s, d, name: df if name == "facts" else registry_)
    names = {n for r in core.facts_blocking_union(spark, "").collect() for n in r.blocked_by.split(",")}
    assert names == {"key", "value", "semantic"} and core.facts_key_classes(spark, "").count() == 5


def test_neighbours_in_blocks_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"v{i:02d}", [rng.gauss(0, 1) for _ in range(6)], "m") for i in range(60)] + [("z", [0.0] * 6, "m"), ("o", [1.0] * 4, "m"), (None, [1.0] * 6, "m")]
    df = spark.createDataFrame(rows, "fact_id string, embedding array<float>, embedding_model string")
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v, _ in rows if i and len(v) == 6 and any(v)}
    cos = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    best = {a: sorted((b for b in unit if b != a), key=lambda b: (-cos(a, b), b))[:3] for a in unit}
    whole = {tuple(sorted((a, b))) for a, bs in best.items() for b in bs}
    for block in (1000, 17):
        assert {tuple(r) for r in blocking.semantic_pairs(df.where("fact_id is not null"), k=3, block=block).collect()} == whole
    v = df.where("size(embedding) = 6 and fact_id <> 'z'")
    got = {}
    for r in blocking.neighbours(v, v.where("fact_id like '%5'"), "fact_id", "embedding", k=3, least=-1.0, vector_block=25, query_block=2).collect():
        got.setdefault(r.query, {})[r.rank] = r.neighbour
    assert got == {a: dict(enumerate(b, 1)) for a, b in best.items() if a.endswith("5")}
    assert blocking.semantic_pairs(df.limit(0)).count() == 0 and blocking.neighbours(v.limit(0), v.limit(0), "fact_id", "embedding").count() == 0


def test_nearest_computes_few_similarities_in_full(monkeypatch):
    import numpy as np

    rng, whole, full = np.random.default_rng(5), blocking._every, []
    monkeypatch.setattr(blocking, "_every", lambda unit, own, asked, first, end, k, least: full.append(end - first) or whole(unit, own, asked, first, end, k, least))

    def brute(x, asked, k, least):
        sim = np.round(asked @ x.T, 9)
        return [[j for j in np.lexsort((np.arange(len(x)), -row)) if j != i and row[j] >= least][:k] for i, row in enumerate(sim)]

    for size, copies, least in ((6000, 0, 0.0), (6000, 5, 0.3), (40, 0, -1.0), (6000, 3000, 0.0)):
        x = rng.normal(size=(size, 12))
        x[:copies] = x[-1]
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        full.clear()
        got = [list(near) for _, near, _ in blocking.nearest([f"{i:05d}" for i in range(size)], x, [f"{i:05d}" for i in range(30)], x[:30], 4, least)]
        assert got == brute(x, x[:30], 4, least)
        assert sum(full) == (30 if copies > 2000 else 0)  # before, all of them


def test_documents_become_relations(spark):
    from factweave.operators import pipeline

    texts = {1: "Acme report\nStandalone results\nRevenue of Acme Limited was 8,142 crore in FY24.\nfor the year ended March 31, 2024", 2: "Acme filing\nRevenue of Acme Limited was 81,415.38 million in FY24, and costs were Rs 5,444 crore."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fact_ = lambda raw, quote, scale=None, predicate="revenue": {"passage_id": 0, "claim_text": quote, "subject_surface": "Acme Limited", "subject_key": None, "subject_type": None, "predicate": predicate, "value": {"kind": "quantity", "raw": raw, "unit": None, "scale": scale}, "qualifiers": [{"key": "period", "value": "FY24", "provenance": "stated"}], "quote": quote, "confidence": 0.9}
    keys = {r.doc_id: r.key for r in pipeline.requests(pipeline.sectioned_chunks(docs), "m").collect()}
    answers = {1: [fact_("8,142", "Revenue of Acme Limited was 8,142 crore in FY24"), fact_("8,142", "Revenue of Acme Limited was 8,142 crore in FY24")], 2: [fact_("81,415.38", "Revenue of Acme Limited was 81,415.38 million"), fact_("9", "never said anywhere in it"), fact_("5,444", "costs were Rs 5,444 crore", predicate="costs")]}
    cache = spark.createDataFrame([(keys[d], json.dumps({"facts": a})) for d, a in answers.items()], "key string, response string")
    out = pipeline.extracted(docs, cache, "m")
    totals = {r.doc_id: r.asDict() for r in out["totals"].collect()}
    assert totals[1] == {"doc_id": 1, "requests": 1, "missing": 0, "extracted": 2, "grounded": 2, "quarantined": 0, "orphaned": 0, "duplicates_collapsed": 1, "kept": 1}
    assert totals[2]["extracted"] == 3 and totals[2]["quarantined"] == 1 and totals[2]["kept"] == 2
    facts = {(r.doc_id, r.measure): r for r in out["facts"].collect()}
    assert {q.key: (q.value, q.provenance) for q in facts[1, "revenue"].qualifiers} == {"period": ("FY24", "stated"), "consolidation": ("standalone", "inherited")}
    assert texts[2][facts[2, "costs"].char_start : facts[2, "costs"].char_end] == "costs were Rs 5,444 crore" and facts[2, "costs"].quantity.normalized == 5.444e10
    rel = pipeline.compared(out["facts"]).collect()
    assert [(r.verdict, r.rule_fired, r.cross_document, r.blocked_by) for r in rel] == [("corroborates", "keys_match_intervals_overlap", True, ["key", "value"])]
    assert pipeline.extracted(docs, cache.limit(0), "m")["totals"].agg({"missing": "sum"}).first()[0] == 2


def test_histogram_counts_every_pair(spark, monkeypatch):
    monkeypatch.setattr(tally, "CHUNK", 7)
    from factweave.plans import core

    rows = [fact(f"{k:02d}{x}", doc=k, **args) for k, (a, b, _) in enumerate(RULES) for x, args in (("a", a), ("b", b))] + MINI
    rows += [fact(f"s{i}", f"{v}%", i, "share", period="FY24", region=c) for i, (c, v) in enumerate({"north": 63, "south": 15, "west": 22}.items())] + [fact("odd1", "7", 1, consolidation_period="FY23"), fact("odd2", "7", 1, as_at="March 31, 2024")]
    rows += [fact("k1", "7", key="A"), fact("k2", "7", key="B"), fact("less", "less than 9", period="FY24"), fact("usd", "7", unit="USD"), fact("inr", "7", unit="INR"), fact("bool", "Yes", kind="boolean"), fact("none", None), fact("blank", "7", subject="")]
    facts = FA.comparable(spark.createDataFrame(rows, COLUMNS))
    whole = decide.histogram(decide.relations(blocking.exact_key_pairs(facts), facts))
    want = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in tally.histogram(facts).collect()} == want and "complementary_categories" in {r[1] for r in want}
    registry_ = spark.createDataFrame([("revenue", '["sales"]')], "canonical string, aliases_json string")
    monkeypatch.setattr(core, "table", lambda s, d, name: spark.createDataFrame(rows, COLUMNS) if name == "facts" else registry_)
    assert {tuple(r) for r in core.decide_histogram(spark, "").collect()} == want


def test_eager_aggregation(spark):
    left = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (2, "a", None), (None, "b", 5.0), (3, None, 1.0)], "k int, g string, v double")
    right = spark.createDataFrame([(1, 10), (1, 20), (2, 7), (None, 99)], "k int, v int")
    got = {r.g: r for r in eager.eager_join_aggregate(left, right, on="k", by=["g"], left_aggs={"s": ("sum", "v"), "hi": ("max", "v")}, right_aggs={"rs": ("sum", "v"), "lo": ("min", "v")}).collect()}
    assert (got["a"].n_rows, got["a"].n_on, got["a"].s, got["a"].hi, got["a"].rs, got["a"].lo) == (5, 2, 10.0, 3.0, 67, 7)
    assert (got["b"].n_rows, got["b"].n_on, got["b"].rs) == (1, 0, None) and got[None].n_rows == 1
    assert eager.eager_join_aggregate(left, right, on="k", by=["g"], how="inner").where("g = 'a'").first().n_rows == 5
    assert eager.eager_join_aggregate(left.limit(0), right, on="k", by=["g"]).count() == 0
    with pytest.raises(ValueError):
        eager.eager_join_aggregate(left, right, on="k", by=["g"], left_aggs={"x": ("avg", "v")})


QUANTITIES = [
    ("5", "pounds millions", None, "came to 5.", ("kg", 2267962)), ("778.4", None, None, "for H1 FY19 came to 778.4 lakhs.", ("each", 77840000)), ("-312.42", None, None, "came to USD -312.42mn..", ("USD", -312420000)), ("Rs (19.86)", None, "Cr.", "x", ("INR", -198600000)),
    ("52.3 percent", "percent", None, "", ("bps", 5230)), ("4", "lac, hectare", None, "", ("m2", 4000000000)), ("3.415 '000 km", None, None, "", ("m", 3415000)), ("222 134", None, None, "in H1 FY15 came to 222 134.", ("each", 222134)),
    ("4.9", "gigajoules", "Thousand", "", ("kwh", 1361111)), ("90", "mins", None, "", ("hour", 2)), ("30", "mins", None, "", ("hour", 1)), ("-30", "mins", None, "", ("hour", -1)), ("1.5", None, None, "it was Rs 1.5 m in FY20", ("INR", 1500000)), ("1.5 m", None, None, "", ("m", 2)),
    ("７.１９５ units", None, "Mn", "", ("each", 7195000)), ("nil", None, None, "", None), ("-", "km", None, "", None), (None, None, None, "", None), ("9" * 25, None, None, "", None), ("0", "km", None, "", ("m", 0)), ("about ₹975", None, "millions", "", ("INR", 975000000)),
    ("1.5e6 kg", None, None, "", ("kg", 1500000)), ("2.5 x 10^3 t", None, None, "", ("kg", 2500000)), ("0.1234567890123456789 kg", None, None, "", ("kg", 0)), ("1234567890123456789", None, None, "", ("each", 1234567890123456789)), (str(2**63 - 1), None, None, "", ("each", 2**63 - 1)),
    (str(2**63), None, None, "", None), ("-" + str(2**63), None, None, "", ("each", -(2**63))), ("1." + "5" * 5000, "km", None, "", ("m", 1556)), ("9" * 6000, None, None, "", None), ("1e400", None, None, "", None), ("5e-400", "m", None, "", ("m", 0)), ("1.560", None, None, "came to 1.560'000 gigajoules.", ("kwh", 433333)),
]


def test_common_units(spark):
    common = spark.createDataFrame([(d, c) for d, c in sorted({(d, c) for d, c, _, _ in units.FACTORS.values()})], "dimension string, common_unit string")
    rows = [(str(i), json.dumps({"raw": r, "unit": u, "scale": s}), c, 1) for i, (r, u, s, c, _) in enumerate(QUANTITIES)] + [("bad", "{oops", "5", 1), ("null", None, None, 1)]
    df = spark.createDataFrame(rows, "fact_id string, value_json string, claim_text string, common_unit int")
    got = {r.fact_id: (r.common_unit, r.common_value) for r in units.to_common_units(df, common).collect()}
    assert got == {str(i): w for i, (*_, w) in enumerate(QUANTITIES) if w}
    assert units.to_common_units(df, common.where("dimension <> 'mass'")).where("fact_id = '0'").count() == 0
    assert units.to_common_units(df.limit(0), common).count() == 0


def test_units_round_like_fractions():
    for unit, (_, _, n, d) in units.FACTORS.items():
        assert n > 0 and d > 0 and math.isfinite(Fraction(n, d)), unit


def test_text_structure(spark):
    text = "Acme report\nOverview\nThe first sentence of it all.\n\nRisk factors\nSecond sentence here."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 5000 + "\nend")], "doc_id long, text string")
    lines = textstruct.lines(docs)
    assert all(text[r.start : r.end] == r.text for r in lines.where("doc_id = 1").collect()) and lines.where("doc_id = 1").count() == 5
    heads = textstruct.headings(lines)
    points = spark.createDataFrame([(1, 0), (1, text.index("The first")), (1, text.index("Second"))], "doc_id long, start long")
    paths = {r.start: r.heading_path for r in textstruct.heading_paths(points, heads).collect()}
    assert [paths[k] for k in sorted(paths)] == [["Acme report"], ["Acme report", "Overview"], ["Acme report", "Risk factors"]]
    cut = textstruct.chunk_texts(docs).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.char_start, r.char_end) for r in cut] == [(1, 0, len(text)), (4, 0, 5000), (4, 5001, 5004)]
    assert textstruct.windows([0, 10, 20, 30], [9, 19, 29, 39], [0] * 4, 25, 8, 2) == [(0, 2), (2, 3)]
    same = spark.createDataFrame([(1, f"Page {i}", i, 0) for i in range(4)] + [(1, f"Body {'x' * i}", i, 9) for i in range(4)], "doc_id long, text string, page int, start int")
    found = textstruct.furniture(same, "page", "doc_id", same.select("doc_id", "page"))
    assert [r.shape for r in found.collect()] == ["page #"]
    assert textstruct.page_frames(same, found, "page", "doc_id").count() == 4


def test_bullets_and_pages(spark):
    rows = [(0, "•", 100.0), (1, "Express Parcel", 101.0), (2, "-", 110.0), (3, "Nil row", 111.0), (4, "\uf09f", 120.0), (5, "Supply Chain", 121.0), (6, "•", 130.0), (7, "Far away", 400.0), (8, "▪ Inline item", 410.0), (9, "- dash item", 420.0)]
    of = spark.createDataFrame([(1, n, t, y, 1) for n, t, y in rows], "doc_id long, line_no int, text string, y double, page int")
    assert {r.line_no for r in textstruct.bullet_starts(of).where("bulleted").collect()} == {1, 5, 8}
    pages = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (3, 7, 5, 9)], "doc_id long, page int, start long, end long")
    at = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 99), (2, 3), (3, 1)], "doc_id long, offset long")
    assert {(r.doc_id, r.offset): r.page for r in textstruct.page_of(at, pages).collect()} == {(1, 0): 1, (1, 9): 1, (1, 10): 2, (1, 99): 2, (2, 3): 0, (3, 1): 7}
    docs = spark.createDataFrame([(1, "\f".join(f"page {i}\n" for i in range(1, 7))), (2, None)], "doc_id long, text string")
    cut_up = textstruct.chunk_texts(docs).orderBy("chunk_no").collect()
    assert cut_up[0].pages == [1, 2, 3] and cut_up[-1].pages[-1] == 6


def test_alignment(spark):
    text = "Notes\nRevenue from services*\n81,415.38\t72,236.47\nTotal   revenue\n"
    docs = spark.createDataFrame([(1, text), (3, "a" * 5000 + "needle"), (4, "🚢 One\n two \\E three"), (5, None)], "doc_id long, text string")
    cases = [
        ("81,415.38", 1, None, "exact"), ("Revenue from services* 81,415.38", 1, None, "exact"), ("Total revenue", 1, None, "exact"), ("Total   revenue", 1, None, "exact"), ("Revenue from service 81,415.38", 1, None, "fuzzy"), ("Revnue form services* 81,415.38", 1, None, "fuzzy"),
        ("something else entirely unrelated", 1, None, "unlocated"), (" ", 1, None, "unlocated"), (None, 1, None, "unlocated"), ("x", 2, None, "unlocated"), ("needle", 3, 0, "exact"), ("One two \\E  three", 4, None, "exact"), ("x", 5, None, "unlocated"),
    ]
    quotes = spark.createDataFrame([(i, d, q, n, n and n + 10) for i, (q, d, n, _) in enumerate(cases)], "quote_id int, doc_id long, quote string, near_start long, near_end long")
    got = {r.quote_id: r for r in align.align(quotes, docs).collect()}
    assert {i: r.status for i, r in got.items()} == {i: c[3] for i, c in enumerate(cases)}
    assert text[got[1].start : got[1].end] == "Revenue from services*\n81,415.38" and text[got[5].start : got[5].end] == "Revenue from services*\n81,415.38" and (got[11].start, got[11].end) == (2, 19)
    near = {r.quote_id: r.status for r in align.align(quotes, docs, strict=True).collect()}
    assert near[10] == "unlocated" and near[1] == "exact"


def test_unlocated_claims_are_sought_in_the_whole_text(spark, monkeypatch):
    from factweave.plans import core

    text = "Some words. " * 400 + "Freight revenue of the northern division rose to 8,142 crore in the year."
    row = list(fact("u", "8,142 Cr"))
    row[2], row[10] = "Freight revenue of the northern division rises to 8,142 crore in the year.", json.dumps({"page": None, "char_start": -1, "char_end": -1})
    tables = {"facts": spark.createDataFrame([tuple(row)], COLUMNS), "documents": spark.createDataFrame([(1, text)], "doc_id long, text string")}
    monkeypatch.setattr(core, "table", lambda s, d, name: tables[name])
    assert [tuple(r) for r in core.aligned_claims(spark, "").collect()] == [("fuzzy", 1)]


def test_only_spans_that_can_hold_a_quote_are_searched(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9)))
    text = " \n ".join(" ".join(word() for _ in range(60)) + " é🚢" for _ in range(8))
    plain, searched, whole = align.folded(text)[0], [], align.nearest_end
    monkeypatch.setattr(align, "nearest_end", lambda needle, t: searched.append(len(t)) or whole(needle, t))
    for _ in range(20):
        assert align.most_similar(" ".join(word() for _ in range(9)), text) == (0.0, -1, -1)
    assert sum(searched) < 2 * len(plain)  # before, 20 times the text
    for size in (1, 2, 3, 5, 20, 60, 90):
        for at in (0, 7, len(plain) // 2, len(plain) - size):
            x = list(plain[at : at + size])
            for _ in range(size // 8):
                x[rng.randrange(len(x))] = rng.choice(["", "q", "bb"])
            needle = "".join(x).strip()
            edits, end = whole(needle, plain) if needle else (0, 0)
            spans = align.within_reach(needle, plain, edits) if needle else []
            assert not end or min((e, s + n) for s, t in spans for e, n in [whole(needle, plain[s:t])] if n) == (edits, end)


def test_extraction_from_cached_answers(spark):
    value = {"kind": "quantity", "raw": "622", "unit": None, "scale": None}
    one = {"passage_id": 0, "claim_text": "Payables were 622", "subject_surface": "Acme", "subject_key": None, "subject_type": None, "predicate": "consolidated_payables", "value": value, "qualifiers": [{"key": "Period", "value": "FY24", "provenance": "stated"}], "quote": "payables 622 INR crores", "confidence": 0.9}
    response = json.dumps({"facts": [one, one | {"passage_id": 9}, one | {"quote": "nowhere to be found at all"}]})
    requests = spark.createDataFrame([("k", 1), ("absent", 1)], "key string, doc_id long")
    got = extract.answers(requests, spark.createDataFrame([("k", response)], "key string, response string"))
    assert {r.key: r.missing for r in got.collect()} == {"k": False, "absent": True}
    passages = spark.createDataFrame([(1, 0, 0, 40)], "doc_id long, passage_id long, char_start long, char_end long")
    parts = extract.grounded(got, passages, spark.createDataFrame([(1, "Trade payables 622 INR crores in all")], "doc_id long, text string"))
    assert [parts[k].count() for k in ("grounded", "quarantined", "orphaned")] == [1, 1, 1]
    (f,) = extract.materialize(parts["grounded"]).collect()
    assert f.measure == "payables" and math.isclose(f.quantity.normalized, 6.22e9) and {q.key for q in f.qualifiers} == {"period", "consolidation"} and "scale_recovered_from_source" in f.flags
    keys = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{"a": "é", "b": 1}',), (None,)], "p string").select(extract.request_key(F.col("p")).alias("k")).collect()
    assert keys[0].k == keys[1].k and keys[2].k is None


def test_adjudication(spark):
    rel = spark.createDataFrame([(x, y, v, "r", None, "why", True) for x, y, v in (("a", "b", "contradicts"), ("a", "c", "contradicts"), ("a", "d", "contradicts"), ("b", "c", "reconciled_by_context"), ("b", "d", "contradicts"))], "fact_a string, fact_b string, verdict string, rule_fired string, qualifier_key string, explanation string, needs_llm boolean")
    answer = "fact_a string, fact_b string, verdict string, qualifier_key string, explanation string"
    forward = spark.createDataFrame([("a", "b", "contradicts", None, "ok"), ("a", "c", "unrelated", None, "x"), ("a", "d", "reconciled_by_context", "invented", "x"), ("b", "c", "reconciled_by_context", "period", "prose")], answer)
    reverse = spark.createDataFrame([("a", "b", "contradicts", None, "ok"), ("a", "c", "contradicts", None, "x"), ("a", "d", "reconciled_by_context", "invented", "x")], answer)
    keys = spark.createDataFrame([("a", ["period"]), ("b", ["period"])], "fact_id string, keys array<string>")
    out = adjudicate.admit(rel, forward, reverse, keys)
    got = {(r.fact_a, r.fact_b): (r.verdict, r.rule_fired, r.needs_llm) for r in out.collect()}
    assert got == {("a", "b"): ("contradicts", "llm_adjudicated", False), ("a", "c"): ("insufficient_context", "judge_inconsistent", False), ("a", "d"): ("insufficient_context", "hallucinated_qualifier_rejected", False), ("b", "c"): ("reconciled_by_context", "r", False), ("b", "d"): ("contradicts", "r", True)}
    (r,) = adjudicate.rates(out).collect()
    assert (r.adjudicated, r.upheld, r.downgraded, r.self_consistency_rate) == (3, 1, 2, 0.5)
    assert adjudicate.rates(out.limit(0)).first().self_consistency_rate == 0.0


def test_registry(spark):
    reg = registry.Registry(confirm=lambda a, b: True, threshold=0.6)
    events = [reg.observe(n) for n in ("finance_costs", "finance_costs", "finance_cost", "gross_inflows", "total_inflows", "")]
    assert [e[0] for e in events] == ["registered", "seen", "confirmed", "registered", "rejected", "seen"] and reg.of["finance_cost"] == "finance_costs"
    facts = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "measure string")
    assert [e[1] for e in registry.fold(facts, registry.Registry())] == ["a", "b"]


def test_modes_and_anaphora(spark):
    rows = [fact("1", subject="Acme Ltd"), fact("2", subject="acme ltd"), fact("3", subject="The Company"), fact("4", subject="Group", doc=2), fact("5", subject="X", doc=2), fact("6", subject="Y", doc=2)]
    got = {r.fact_id: r.surface_resolved for r in FA.resolve_anaphora(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got["3"] == "Acme Ltd" and got["4"] == "Group"
    docs = spark.createDataFrame([(1, "for the year ended March 31, 2024 and years ended March 31, 2023; year ended June 30, 2020"), (2, "year ended March 31, 2024; year ended June 30, 2020"), (3, "talks that ended on September 18, 2025"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.month for r in FA.fiscal_year_ends(docs).collect()} == {1: 3}


def test_ledger(spark, tmp_path):
    path = f"{tmp_path}/facts"
    schema = "fact_id string, doc_id long, v int"
    ledger.save_facts(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], schema), path)
    ledger.save_facts(spark.createDataFrame([("c", 1, 2)], schema), path)
    assert {r.fact_id for r in ledger.read(spark, path).collect()} == {"b", "c"}
    rel = f"{tmp_path}/rel"
    ledger.save_relations(spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "fact_a string, fact_b string, v int"), rel)
    ledger.save_relations(spark.createDataFrame([("a", "b", 2)], "fact_a string, fact_b string, v int"), rel)
    assert {(r.fact_b, r.v) for r in ledger.read(spark, rel).collect()} == {("b", 2), ("c", 1)}
    ledger.save_relations(spark.createDataFrame([("a", "b", 3)], "fact_a string, fact_b string, v int"), rel, replace=True)
    assert ledger.read(spark, rel).count() == 1
    assert len([n for n in os.listdir(rel) if n != "CURRENT" and not n.startswith(".")]) == 2  # this version and the one before
    entries = "canonical string, aliases_json string, embedding array<float>, first_seen_doc long, seen_count long"
    reg = f"{tmp_path}/registry"
    ledger.save_registry(spark.createDataFrame([("b", "[]", None, 1, 1), ("a", '["x"]', [0.5], 2, 3)], entries), reg)
    ledger.save_registry(spark.createDataFrame([("b", '["y"]', [1.0], 9, 4)], entries), reg)
    assert ledger.load_registry(spark, reg) == [("a", ["x"], [0.5], 2, 3), ("b", ["y"], [1.0], 1, 4)]
    ev = f"{tmp_path}/events"
    for rows in ([(2, 0, "b"), (1, 1, "a2"), (1, 0, "a1")], [(1, 0, "later")]):
        ledger.append_events(spark.createDataFrame(rows, "doc_id long, no int, subject string"), ev)
    assert [r.subject for r in ledger.read(spark, ev).orderBy("event_id").collect()] == ["a1", "a2", "b", "later"]
    ledger.save_quarantine(spark.createDataFrame([("q1", "x"), ("q1", "x")], "quarantine_id string, quote string"), f"{tmp_path}/quarantine")
    assert ledger.read(spark, f"{tmp_path}/quarantine").count() == 1
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("a\nb")
    named = spark.createDataFrame([(1, "data\\work\\one.txt"), (2, "/x/two.txt"), (3, None)], "doc_id long, text_path string")
    assert {r.doc_id: r.text for r in ledger.document_texts(named, f"{tmp_path}/texts").collect()} == {1: "a\nb", 2: None, 3: None}
    docs = f"{tmp_path}/docs"
    ledger.save_documents(spark.createDataFrame([(1, "h", "x")], "doc_id long, sha256 string, filename string"), docs)
    ledger.save_documents(spark.createDataFrame([(9, "h", "y")], "doc_id long, sha256 string, filename string"), docs)
    assert [(r.doc_id, r.filename) for r in ledger.read(spark, docs).collect()] == [(1, "y")]
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab/abc.json").write_text('{"facts": []}')
    assert ledger.answer_cache(spark, f"{tmp_path}/ab").first().key == "abc" and ledger.file_hashes(spark, f"{tmp_path}/ab/*").first().length == 13


def test_streaming_ingest(spark, tmp_path):
    df = spark.createDataFrame(MINI, COLUMNS)
    df.where("doc_id < 3").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    for _ in range(2):
        q = ingest.ingest_stream(spark, f"{tmp_path}/in/*", df.schema, f"{tmp_path}/ledger", f"{tmp_path}/cp")
        q.awaitTermination()
        df.where("doc_id = 3").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/2")
    assert ledger.read(spark, f"{tmp_path}/ledger/facts").count() == 5 and ledger.read(spark, f"{tmp_path}/ledger/relations").count() == 6


def test_catalogue():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p4_found", "p6_found"} <= set(entry.queries())
