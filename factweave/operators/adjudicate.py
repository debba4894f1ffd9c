"""Relations after judging: earlier answers kept, new ones admitted only if both orders agree and name conditions that the facts have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carry_forward(run: DataFrame, prior: DataFrame) -> DataFrame:
    """run (fact_a, fact_b, verdict, rule_fired, qualifier_key, needs_llm) with the judged answers of `prior`, where a pair still asks for one."""
    columns = ["verdict", "rule_fired", "qualifier_key"]
    kept = prior.where("judged").groupBy("fact_a", "fact_b").agg(*[F.min(c).alias(f"_{c}") for c in columns]).withColumn("_judged", F.lit(True))
    met = run.join(kept, ["fact_a", "fact_b"], "left")
    use = F.col("needs_llm") & F.col("_judged").isNotNull()
    out = met.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).withColumn("judged", use)
    return out.withColumn("needs_llm", F.col("needs_llm") & ~use).drop("_judged", *(f"_{c}" for c in columns))


def admit(relations: DataFrame, forward: DataFrame, reverse: DataFrame, keys: DataFrame) -> DataFrame:
    """Relations with the judge's answers applied.

    forward, reverse: (fact_a, fact_b, verdict, qualifier_key, explanation), the pair shown in either order; keys: (fact_id, keys array).
    Of `contradicts` pairs both answers are needed; a key that neither fact has, or a reconciliation without a key, rejects the
    answer; different verdicts cancel each other; both downgrade the pair to insufficient_context. `reconciled_by_context` pairs keep their
    verdict and take the explanation. Pairs without answers stay as they are.
    """
    answer = lambda df, x: df.groupBy("fact_a", "fact_b").agg(F.min(F.struct("verdict", "qualifier_key", "explanation")).alias(x))
    of = lambda x: keys.select(F.col("fact_id").alias(f"fact_{x}"), F.col("keys").alias(f"_k{x}"))
    rows = relations.join(answer(forward, "_f"), ["fact_a", "fact_b"], "left").join(answer(reverse, "_r"), ["fact_a", "fact_b"], "left").join(of("a"), "fact_a", "left").join(of("b"), "fact_b", "left")
    known = F.array_union(F.coalesce("_ka", F.array().cast("array<string>")), F.coalesce("_kb", F.array().cast("array<string>")))
    bad = lambda a: F.coalesce(~F.array_contains(known, a["qualifier_key"]), F.lit(False)) | ((a["verdict"] == "reconciled_by_context") & a["qualifier_key"].isNull())
    f, r = F.col("_f"), F.col("_r")
    asked = F.col("needs_llm") & (F.col("verdict") == "contradicts") & f.isNotNull() & r.isNotNull()
    outcome = F.when(~asked, F.lit(None)).when(bad(f) | bad(r), F.lit("hallucinated_qualifier_rejected")).when(f["verdict"] != r["verdict"], F.lit("judge_inconsistent")).otherwise(F.lit("llm_adjudicated"))
    rows = rows.withColumn("_o", outcome)
    prose = F.col("needs_llm") & (F.col("verdict") == "reconciled_by_context") & f.isNotNull()
    upheld, down = F.col("_o") == "llm_adjudicated", F.col("_o").isin("hallucinated_qualifier_rejected", "judge_inconsistent")
    return rows.withColumns({
        "verdict": F.when(upheld, f["verdict"]).when(down, F.lit("insufficient_context")).otherwise(F.col("verdict")),
        "rule_fired": F.coalesce("_o", "rule_fired"),
        "qualifier_key": F.when(upheld, f["qualifier_key"]).when(down, F.lit(None)).otherwise(F.col("qualifier_key")),
        "explanation": F.when(upheld | prose, f["explanation"]).otherwise(F.col("explanation")),
        "decided_by": F.when(upheld | prose, F.lit("llm")).otherwise(F.lit("deterministic")),
        "self_consistent": F.when(upheld, F.lit(True)).when(down, F.lit(False)),
        "needs_llm": F.col("needs_llm") & F.col("_o").isNull() & ~prose,
        "judged": F.col("_o").isNotNull() | prose,
    }).drop("_f", "_r", "_ka", "_kb", "_o")


def rates(judged: DataFrame) -> DataFrame:
    """One row: adjudicated, upheld, downgraded, self_consistency_rate and rejection_rate (0 where nothing was checked)."""
    done = F.col("rule_fired").isin("llm_adjudicated", "hallucinated_qualifier_rejected", "judge_inconsistent")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rejected = F.col("rule_fired") == "hallucinated_qualifier_rejected"
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)), 4)
    return judged.agg(
        n(done).alias("adjudicated"), n(F.col("rule_fired") == "llm_adjudicated").alias("upheld"), n(done & (F.col("rule_fired") != "llm_adjudicated")).alias("downgraded"),
        rate(F.col("rule_fired") == "llm_adjudicated", done & ~rejected).alias("self_consistency_rate"), rate(rejected, done).alias("rejection_rate"),
    )
