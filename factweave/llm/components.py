"""Consolidating pairwise matches into groups: union-find inside edge partitions, spanning forests only, merged level by level.

A task runs union-find over a bounded number of edges and keeps their spanning forest as (child, root) edges. On every level the
edges meet by either end, those of a hot node spread over several partitions, and then by child. A child that has one root and is nobody's root is
settled and put aside with it; only edges between roots go to the next, much smaller level. Once these fit one bounded partition a last
union-find settles them, and the levels' stars are joined with the components of their roots, from the last to the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

EDGES_PER_PARTITION = 100_000


def spanning_forest(left: list, right: list) -> tuple[list[int], list[int], list]:
    """Union-find with path halving over one partition's edges: (child, root) codes and the sorted names; roots are least names."""
    codes, names = pd.factorize(pd.Series(left + right, dtype=object), sort=True)
    parent = list(range(len(names)))
    n = len(left)
    codes = codes.tolist()
    for a, b in zip(codes[:n], codes[n:]):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    children, roots = [], []
    for x in range(len(parent)):  # parents are less than their children, so one pass in order settles all
        if parent[x] != x:
            parent[x] = parent[parent[x]]
            children.append(x)
            roots.append(parent[x])
    return children, roots, list(names)


def _forest(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list = []
        right: list = []

        def made(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            children, roots, names = spanning_forest(left, right)
            for i in range(0, len(children), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in xs[i : i + 50_000]], kind) for xs in (children, roots)], ["child", "root"])
            left.clear()
            right.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            left += batch.column(0).to_pylist()
            right += batch.column(1).to_pylist()
            if len(left) >= bound:
                yield from made(kind)
        if left:
            yield from made(kind)

    return run


def _local(edges: DataFrame, bound: int) -> DataFrame:
    """Spanning forests of every partition's edges, of about `bound` of them at a time."""
    kind = edges.schema[0].dataType.simpleString()
    return edges.mapInArrow(_forest(bound), f"child {kind}, root {kind}")


def _by_ends(edges: DataFrame, parts: int, bound: int) -> DataFrame:
    """Every edge in the partitions of both its ends; a node with more than `bound` edges has several, of which a hash of the other end picks one."""
    ends = edges.select("child", "root", F.explode(F.array(F.struct(F.col("child").alias("node"), F.col("root").alias("other")), F.struct(F.col("root").alias("node"), F.col("child").alias("other")))).alias("x")).select("child", "root", "x.*")
    hot = ends.groupBy("node").agg(F.ceil(F.count("*") / bound).alias("salts")).where("salts > 1")  # fewer than 2 * parts rows
    salted = ends.join(hot, "node", "left").withColumn("salt", F.pmod(F.xxhash64("other"), F.coalesce("salts", F.lit(1).cast("long"))))
    return salted.repartition(2 * parts, "node", "salt").select("child", "root")


def connected_components(pairs: DataFrame, a: str, b: str, *, edges_per_partition: int = EDGES_PER_PARTITION, max_levels: int = 60) -> DataFrame:
    """(node, component): one row for each node that some pair links to another node; `component` is the least node of its component.

    Pairs with a null end and pairs of a node with itself link nothing; repeated and reversed pairs count once; an empty table
    gives an empty result; other columns are ignored. Ends must be of one type. Each level cuts its lineage in the shared
    checkpoint folder. A union-find holds about `edges_per_partition` edges at a time, however large a split, a node or a component is.
    """
    spark = pairs.sparkSession
    ship(spark)
    kind = pairs.schema[a].dataType.simpleString()
    edges = pairs.select(F.col(a).alias("child"), F.col(b).cast(kind).alias("root")).where("child is not null and root is not null and child <> root")
    rest = cut(_local(edges, edges_per_partition))
    settled: list[DataFrame] = []
    for _ in range(max_levels):
        parts = math.ceil(rest.count() / edges_per_partition)
        if parts <= 1:
            break
        met = _local(_by_ends(rest, parts, edges_per_partition), 4 * edges_per_partition)
        forest = cut(_local(met.repartition(parts, "child"), 4 * edges_per_partition).distinct())
        # a hot root is counted before the shuffle
        roles = forest.select(F.col("child").alias("node"), F.lit(1).alias("roots"), "root").unionByName(forest.select(F.col("root").alias("node"), F.lit(2).alias("roots"), F.lit(None).cast(kind).alias("root")))
        done = cut(roles.groupBy("node").agg(F.sum("roots").alias("n"), F.min("root").alias("root")).where("n = 1").select(F.col("node").alias("child"), "root"))
        settled.append(done)
        rest = cut(forest.join(done.select("child"), "child", "left_anti"))
    else:
        raise RuntimeError(f"components are not settled after {max_levels} levels")
    found = _local(rest.repartition(1), 4 * edges_per_partition).select(F.col("child").alias("node"), F.col("root").alias("component"))
    for done in reversed(settled):
        of = found.select(F.col("node").alias("root"), "component")
        found = cut(found.unionByName(done.join(of, "root", "left").select(F.col("child").alias("node"), F.coalesce("component", "root").alias("component"))))
    # a component's least node is nobody's child
    return found.unionByName(found.select("component").distinct().select(F.col("component").alias("node"), "component"))


def corroborated_groups(relations: DataFrame) -> DataFrame:
    """(fact_id, group_id) over the corroborating rows of relations, whatever the verdict's case and outer blanks."""
    said = F.lower(F.regexp_replace("verdict", r"(?U)^\s+|\s+$", ""))
    pairs = relations.where(said == "corroborates").select("fact_a", "fact_b")
    return connected_components(pairs, "fact_a", "fact_b").select(F.col("node").alias("fact_id"), F.col("component").alias("group_id"))
