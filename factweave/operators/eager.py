"""Eager aggregation through joins: per-key results that heavy keys can't hold up.

Both inputs become compact states by join key (and group) before they meet: counts, sums, least and greatest values. A heavy group
is spread over its join keys, and partial aggregation has shrunk it before any shuffle. The joined states are combined algebraically (counts
multiply, a sum counts as often as the other side has rows) and rolled up to the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = ("sum", "min", "max")


def _state(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], side: str) -> DataFrame:
    for name, (kind, _) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"{name}: {kind} is none of {_KINDS}")
    made = [getattr(F, kind)(F.col(c)).alias(f"_{side}_{name}") for name, (kind, c) in aggs.items()]
    return df.groupBy(*keys).agg(F.count("*").alias(f"_{side}_n"), *made)


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, *, on: str, by: list[str], left_aggs: dict[str, tuple[str, str]] | None = None, right_aggs: dict[str, tuple[str, str]] | None = None,
    carried: dict[str, str] | None = None, how: str = "left",
) -> DataFrame:
    """`by`, n_rows, n_on and the named aggregates of `left` joined with `right` on `on`, without ever joining rows.

    left_aggs, right_aggs: output name -> (sum | min | max, column). n_rows counts joined rows, n_on the different non-null values of
    `on`. carried: output name -> column of `left` that is a count per left row to be summed without multiplication (e.g. compacted rows).
    `how` is left or inner; a null `on` matches nothing. Group columns may be null and are kept as a group. Repeated rows count as
    often as they occur, as in the join. An empty input gives an empty result. Columns of both sides may share names.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    left_aggs, right_aggs, carried = left_aggs or {}, right_aggs or {}, carried or {}
    a = _state(left, [on, *by], left_aggs | {f"+{k}": ("sum", c) for k, c in carried.items()}, "l")
    b = _state(right.where(F.col(on).isNotNull()), [on], right_aggs, "r").withColumnRenamed(on, "_r_on")
    met = a.join(b, a[on] == b["_r_on"], how)
    times = F.coalesce(F.col("_r_n"), F.lit(1))
    out: list[Column] = [F.sum(F.col("_l_n") * times).cast("long").alias("n_rows"), F.count(F.col(on)).cast("long").alias("n_on")]
    for name, (kind, _) in left_aggs.items():
        c = F.col(f"_l_{name}")
        out.append((F.sum(c * times) if kind == "sum" else getattr(F, kind)(c)).alias(name))
    for name, (kind, _) in right_aggs.items():
        c = F.col(f"_r_{name}")
        out.append((F.sum(c * F.col("_l_n")) if kind == "sum" else getattr(F, kind)(c)).alias(name))
    out += [F.sum(F.col(f"_l_+{k}")).alias(k) for k in carried]
    return met.groupBy(*by).agg(*out)


def key_report(facts: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, n_deliveries, n_facts, n_documents, lowest, highest, latest, n_chars: per value of `key`, null included.

    n_facts counts repeated deliveries once; n_chars sums the documents' n_chars over all deliveries, as a join would. Deliveries of
    a fact are folded first, hashed by fact, so neither a heavy key nor a heavy document gathers in one task.
    """
    folded = facts.groupBy("fact_id", "doc_id", key).agg(F.count("*").alias("n"), F.min("value_normalized").alias("lo"), F.max("value_normalized").alias("hi"), F.max("created_at").alias("at"))
    whole = folded.withColumn("one", F.lit(1))
    chars = documents.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    # n_chars counts each delivery: weigh by n on the left, once per document on the right
    stats = eager_join_aggregate(
        whole, chars.groupBy("doc_id").agg(F.sum("n_chars").alias("n_chars")), on="doc_id", by=[key],
        left_aggs={"lowest": ("min", "lo"), "highest": ("max", "hi"), "latest": ("max", "at")}, carried={"n_deliveries": "n", "n_facts": "one"},
    )
    weighed = eager_join_aggregate(facts.select("doc_id", key), chars, on="doc_id", by=[key], right_aggs={"n_chars": ("sum", "n_chars")})
    return stats.select(key, "n_deliveries", "n_facts", F.col("n_on").alias("n_documents"), "lowest", "highest", "latest").join(
        weighed.select(F.col(key).alias("_key"), "n_chars"), F.col(key).eqNullSafe(F.col("_key")), "left"
    ).drop("_key")


def heavy_keys(facts: DataFrame, documents: DataFrame, key: str = "comparison_key", share: float = 0.02) -> DataFrame:
    """Non-null keys that hold at least `share` of all rows of facts, with their number of rows; documents only lend their ids."""
    counted = eager_join_aggregate(
        facts.select("doc_id", key, F.lit(1).alias("one")), documents.select("doc_id").distinct(), on="doc_id", by=[key], carried={"n_deliveries": "one"}
    )
    total = facts.agg(F.count("*").alias("_all")).withColumn("_one", F.lit(1))
    met = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # a row
    return met.where(F.col(key).isNotNull() & (F.col("n_deliveries") >= F.lit(share) * F.col("_all"))).select(key, "n_deliveries")
