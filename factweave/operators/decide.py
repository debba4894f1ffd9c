"""The decision table: one verdict for every candidate pair, from values and conditions alone.

A pair row holds both facts as structs `a` and `b`. Conditions are compared by higher-order functions and the table is one CASE, so a
pair never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import strings as S
from ..functions.lets import let
from . import partition as parts

VERDICTS = ("corroborates", "contradicts", "reconciled_by_context", "unrelated", "insufficient_context")
#: What a pair needs of each fact; the last row is computed once per fact, not per pair.
_FACT = ("fact_id", "doc_id", "subject_surface", "subject_key", "subject_id", "measure", "value_kind", "value_raw", "quantity", "qualifiers", "name", "hard_key", "words", "day", "digits")


def prepared(facts: DataFrame) -> DataFrame:
    raw = F.col("value_raw")
    return facts.withColumns({
        "name": S.normalize_surface(F.col("subject_surface")), "hard_key": F.nullif(F.col("subject_key"), F.lit("")), "words": F.when(F.col("value_kind") != "quantity", S.plain_words(raw)),
        "day": P.bare_date(F.when(F.col("value_kind") != "quantity", raw)), "digits": N.written_digits(F.col("quantity.raw")),
    })


def compare_values(a: Column, b: Column) -> Column:
    """agree, disagree or incomparable."""
    qa, qb = a["quantity"], b["quantity"]
    units_differ = F.coalesce(qa["unit"] != qb["unit"], F.lit(False))
    both = (a["value_kind"] == "quantity") & (b["value_kind"] == "quantity")
    figures = F.when(qa.isNull() | qb.isNull() | (qa["is_percent"] != qb["is_percent"]) | units_differ, "incomparable").when(N.intervals_overlap(qa, qb), "agree").otherwise("disagree")
    texts = F.when(F.coalesce(a["day"] == b["day"], a["words"] == b["words"], F.lit(False)), "agree").otherwise("disagree")
    return F.when(both, figures).when(a["value_kind"].eqNullSafe(b["value_kind"]), texts).otherwise("incomparable")


def _same(x: Column, y: Column) -> Column:
    """Whether two conditions are one: by interval where both have one, by date, by words."""
    return F.coalesce((x["start"] == y["start"]) & (x["end"] == y["end"]), x["day"] == y["day"], x["plain"] == y["plain"])


def _unreadable(x: Column, y: Column) -> Column:
    """Times of which at least one is no interval and whose years don't contradict each other."""
    years = (F.size(F.array_except(x["years"], y["years"])) == 0) | (F.size(F.array_except(y["years"], x["years"])) == 0)
    return (x["dim"] == "period") & (y["dim"] == "period") & (x["start"].isNull() | y["start"].isNull()) & years


def compare_contexts(a: Column, b: Column) -> Column:
    """struct(differing, missing, agreeing): conditions paired by key, a single spare time key of each side with the other's.

    differing: struct(plain, dim, cross, key, proven, established), recognised keys first; missing: struct(plain, dim, side, key).
    """
    split = F.struct(
        F.filter(a, lambda x: ~F.exists(b, lambda y: y["key"] == x["key"])).alias("la"),
        F.filter(b, lambda y: ~F.exists(a, lambda x: x["key"] == y["key"])).alias("lb"),
        F.transform(F.filter(a, lambda x: F.exists(b, lambda y: y["key"] == x["key"])), lambda x: F.struct(x.alias("x"), F.get(F.filter(b, lambda y: y["key"] == x["key"]), F.lit(0)).alias("y"))).alias("shared"),
    )

    def times(s: Column) -> Column:
        return F.struct(s.alias("s"), F.filter(s["la"], lambda x: x["dim"] == "period").alias("ta"), F.filter(s["lb"], lambda x: x["dim"] == "period").alias("tb"))

    def paired(t: Column) -> Column:
        crossed = (F.size(t["ta"]) == 1) & (F.size(t["tb"]) == 1)
        cross = F.when(crossed, F.transform(F.arrays_zip(t["ta"], t["tb"]), lambda z: F.struct(z["ta"].alias("x"), z["tb"].alias("y"))))
        spare = lambda side, of: F.transform(F.filter(of, lambda x: ~(crossed & (x["dim"] == "period"))), lambda x: F.struct((~x["known"]).alias("plain"), x["dim"].alias("dim"), F.lit(side).alias("side"), x["key"].alias("key")))
        return F.struct(
            F.concat(t["s"]["shared"], F.coalesce(cross, F.filter(t["s"]["shared"], lambda _: F.lit(False)))).alias("pairs"),
            F.array_sort(F.concat(spare(0, t["s"]["la"]), spare(1, t["s"]["lb"]))).alias("missing"),
        )

    def judged(p: Column) -> Column:
        def row(z: Column) -> Column:
            x, y = z["x"], z["y"]
            known = x["known"] & y["known"] & x["separates"]
            unreadable, cross = _unreadable(x, y), x["key"] != y["key"]
            return F.struct(~known, x["dim"].alias("dim"), cross.alias("cross"), x["key"].alias("key"), (known & ~unreadable).alias("proven"), (~(unreadable & cross)).alias("established"), _same(x, y).alias("same"))

        return F.struct(F.array_sort(F.transform(p["pairs"], row)).alias("compared"), p["missing"].alias("missing"))

    def result(j: Column) -> Column:
        return F.struct(F.filter(j["compared"], lambda c: ~c["same"]).alias("differing"), j["missing"].alias("missing"), F.size(F.filter(j["compared"], lambda c: c["same"])).alias("agreeing"))

    out = split
    for step in (times, paired, judged, result):
        out = let(out, step)
    return out


def decision(a: Column, b: Column, partition_key: Column | None = None) -> Column:
    """struct(verdict, rule_fired, qualifier_key, needs_llm, missing_keys) of a pair; the first rule that holds."""
    partition_key = partition_key if partition_key is not None else F.lit(None).cast("string")
    same_key = S.names_match(a["name"], a["hard_key"], b["name"], b["hard_key"]) & F.coalesce((a["measure"] == b["measure"]) & (a["measure"] != ""), F.lit(False))
    coarse = F.coalesce(N.rests_on_imprecision(a["quantity"], b["quantity"], a["digits"], b["digits"]), F.lit(False))
    return first_rule(F.coalesce(same_key, F.lit(False)), partition_key, compare_values(a, b), compare_contexts(a["qualifiers"], b["qualifiers"]), coarse)


def first_rule(same_key: Column, partition_key: Column, values: Column, diff: Column, coarse: Column) -> Column:
    """decision of what was seen of a pair; coarse: whether values that agree only do so by imprecision."""
    seen = F.struct(same_key.alias("same_key"), values.alias("values"), diff.alias("diff"), partition_key.alias("part"))

    def table(s: Column) -> Column:
        differing, missing = s["diff"]["differing"], s["diff"]["missing"]
        proven = F.filter(differing, lambda c: c["proven"])
        established = F.filter(differing, lambda c: c["established"])
        key = lambda cs: F.get(cs, F.lit(0))["key"]
        names = F.transform(missing, lambda m: m["key"])
        none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

        def row(verdict: str, rule: str, qualifier: Column = none, asks: bool = False, keys: Column = nothing) -> Column:
            return F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule_fired"), qualifier.alias("qualifier_key"), F.lit(asks).alias("needs_llm"), keys.alias("missing_keys"))

        agree = s["values"] == "agree"
        return (
            F.when(~s["same_key"], row("unrelated", "comparison_key_differs"))
            .when(s["part"].isNotNull(), row("unrelated", "complementary_categories", s["part"]))
            .when(s["values"] == "incomparable", row("insufficient_context", "incomparable_values", keys=names))
            .when(agree & (F.size(proven) > 0), row("unrelated", "context_differs_values_agree", key(proven)))
            .when(agree & coarse, row("insufficient_context", "agreement_rests_on_imprecision", keys=names))
            .when(agree, row("corroborates", "keys_match_intervals_overlap", keys=names))
            .when(F.size(missing) > 0, row("insufficient_context", "missing_qualifier_guard", F.get(missing, F.lit(0))["key"], keys=names))
            .when((F.size(differing) > 0) & (F.size(established) == 0), row("insufficient_context", "unestablished_context_difference", key(differing), keys=names))
            .when(F.size(established) > 0, row("reconciled_by_context", "discriminating_qualifier_differs", key(established), True))
            .otherwise(row("contradicts", "same_context_disjoint_intervals", asks=True))
        )

    return let(seen, table)


def explain(d: Column, a: Column, b: Column) -> Column:
    """A sentence for the verdict."""
    both = F.concat(F.coalesce(a["value_raw"], F.lit("?")), F.lit(" and "), F.coalesce(b["value_raw"], F.lit("?")))
    key = F.coalesce(d["qualifier_key"], F.lit(""))
    return (
        F.when(d["rule_fired"] == "comparison_key_differs", F.lit("The facts have different comparison keys."))
        .when(d["rule_fired"] == "complementary_categories", F.concat(F.lit("The facts are parts of one whole, divided by "), key, F.lit(".")))
        .when(d["rule_fired"] == "incomparable_values", F.concat(both, F.lit(" can't be compared.")))
        .when(d["rule_fired"] == "context_differs_values_agree", F.concat(both, F.lit(" agree but hold under different "), key, F.lit(".")))
        .when(d["rule_fired"] == "agreement_rests_on_imprecision", F.concat(both, F.lit(" only meet because one is written to a single digit.")))
        .when(d["rule_fired"] == "keys_match_intervals_overlap", F.concat(both, F.lit(" agree.")))
        .when(d["rule_fired"] == "missing_qualifier_guard", F.concat(both, F.lit(" disagree, and only one side states "), key, F.lit(".")))
        .when(d["rule_fired"] == "unestablished_context_difference", F.concat(both, F.lit(" disagree, and whether "), key, F.lit(" differs can't be told.")))
        .when(d["rule_fired"] == "discriminating_qualifier_differs", F.concat(both, F.lit(" disagree, which different "), key, F.lit(" accounts for.")))
        .otherwise(F.concat(both, F.lit(" disagree in the same context.")))
    )


def relations(pairs: DataFrame, facts: DataFrame, with_partitions: bool = True, keep_unrelated: bool = True) -> DataFrame:
    """fact_a, fact_b, verdict, rule_fired, qualifier_key, needs_llm, missing_keys, cross_document, relation_id, explanation[, blocked_by] of candidate pairs."""
    one = prepared(facts).select(F.struct(*_FACT).alias("f"))
    side = lambda x: one.select(F.col("f.fact_id").alias(f"fact_{x}"), F.col("f").alias(x))
    rows = pairs.join(side("a"), "fact_a").join(side("b"), "fact_b")
    if with_partitions:
        rows = rows.join(parts.complementary(pairs, parts.members(facts)), ["fact_a", "fact_b"], "left")
    else:
        rows = rows.withColumn("partition_key", F.lit(None).cast("string"))
    made = rows.withColumn("d", decision(F.col("a"), F.col("b"), F.col("partition_key")))
    out = made.select(
        "fact_a", "fact_b", "d.verdict", "d.rule_fired", "d.qualifier_key", "d.needs_llm", "d.missing_keys", (F.col("a.doc_id") != F.col("b.doc_id")).alias("cross_document"),
        F.concat(F.lit("r_"), F.col("fact_a"), F.lit("_"), F.col("fact_b")).alias("relation_id"), explain(F.col("d"), F.col("a"), F.col("b")).alias("explanation"), *(["blocked_by"] if "blocked_by" in pairs.columns else []),
    )
    return out if keep_unrelated else out.where("verdict <> 'unrelated'")


def histogram(of: DataFrame) -> DataFrame:
    return of.groupBy("verdict", "rule_fired").agg(F.count("*").alias("n"), F.sum(F.col("needs_llm").cast("long")).alias("referred"))
