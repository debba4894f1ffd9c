"""Complementary categories: shares of one measure that add up to the whole along one condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import strings as S

WHOLE = 100.0


def members(facts: DataFrame) -> DataFrame:
    """(fact_id, group_id, split_key, category) of facts in groups of percentages that differ in one condition only and add up to the whole.

    A group has one subject, measure, split condition (no time) and one rest of the bag; of each category its least fact_id stands for
    it; at least two categories; the sum of the lower ends is at most, of the upper ends at least, a hundred.
    """
    q = F.col("quantity")
    share = q.isNotNull() & q["is_percent"] & ~N.is_bounded(q) & q["normalized"].between(0.0, WHOLE)
    rest = F.filter("qualifiers", lambda x: x["key"] != F.col("k.key"))
    rows = (
        facts.where(share)
        .select("fact_id", "subject_id", "measure", "qualifiers", q["lo"].alias("lo"), q["hi"].alias("hi"), F.explode("qualifiers").alias("k"))
        .where(~S.key_matches(F.col("k.key"), S.PARTITION_TIME))
        .select("fact_id", "subject_id", "measure", "lo", "hi", F.col("k.key").alias("split_key"), F.col("k.plain").alias("category"), F.to_json(F.transform(rest, lambda x: F.struct(x["key"], x["plain"]))).alias("signature"))
    )
    group = ["subject_id", "measure", "split_key", "signature"]
    categories = rows.groupBy(*group, "category").agg(F.min(F.struct("fact_id", "lo", "hi")).alias("x"))
    whole = categories.groupBy(*group).agg(F.count("*").alias("n"), F.sum("x.lo").alias("lo"), F.sum("x.hi").alias("hi")).where((F.col("n") >= 2) & (F.col("lo") <= WHOLE) & (F.col("hi") >= WHOLE))
    key = F.sha1(F.to_json(F.struct(*group))).alias("group_id")
    return rows.select("fact_id", key, "split_key", "category").join(whole.select(key), "group_id", "left_semi").distinct()


def complementary(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(fact_a, fact_b, partition_key): pairs in one group under different categories, with the least such condition."""
    side = lambda x: of.select(F.col("fact_id").alias(f"fact_{x}"), "group_id", F.col("split_key").alias(f"_k{x}"), F.col("category").alias(f"_c{x}"))
    met = pairs.select("fact_a", "fact_b").join(side("a"), "fact_a").join(side("b"), ["fact_b", "group_id"]).where("_ka = _kb and _ca <> _cb")
    return met.groupBy("fact_a", "fact_b").agg(F.min("_ka").alias("partition_key"))
