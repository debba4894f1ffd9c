"""Candidate pairs of facts: exact keys, magnitude bands, nearest neighbours; their union with provenance and its statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import strings as S
from ..session import ship, spread

BAND_WIDTH, BAND_WINDOW, NEIGHBOURS = 0.002, 1, 10


def with_aliases(facts: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Measures resolved by one hop of (alias, canonical)."""
    if aliases is None:
        return facts
    one = aliases.groupBy("alias").agg(F.min("canonical").alias("_canonical"))
    return facts.join(one, facts["measure"] == one["alias"], "left").withColumn("measure", F.coalesce("_canonical", "measure")).drop("alias", "_canonical")


def exact_key_pairs(facts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(fact_a, fact_b): facts that share an identity and a measure, and the columns `within`, e.g. the reporting period.

    An equi-join on all of these. Facts without identity or measure pair with nothing.
    """
    on = F.transform(S.subject_identities(F.col("subject_surface"), F.col("subject_key")), lambda i: F.struct(i.alias("identity"), "measure", *(within or [])))
    keyed = _keys(facts.where(F.col("measure").isNotNull() & (F.col("measure") != "")), on)
    return _met(keyed, keyed)


def _keys(facts: DataFrame, keys: Column) -> DataFrame:
    """(fact_id, keys): a row for each fact, the different keys of all its rows in order."""
    rows = facts.select("fact_id", F.explode(keys).alias("key"))
    return rows.groupBy("fact_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(fact_a, fact_b) of left and right (fact_id, keys) with a key in common, fact_a the lesser id; every pair once.

    Two facts meet at each of their common keys and count at the first one, so no exchange of the pairs, which are many times the facts, makes them
    distinct. The facts are spread by key, because the work is in the pairs and not in the bytes by which AQE coalesces.
    """
    side = lambda df, x: spread(df.select("fact_id", F.when(F.size("keys") > 1, F.col("keys")).alias("keys"), F.explode("keys").alias("key")), "key").select(*(F.col(c).alias(f"{c}_{x}") for c in ("fact_id", "keys", "key")))
    first = F.col("keys_a").isNull() | F.col("keys_b").isNull() | (F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == F.col("key_a"))  # keys are null where there is one
    met = side(left, "a").join(side(right, "b"), (F.col("key_a") == F.col("key_b")) & (F.col("fact_id_a") < F.col("fact_id_b")) & first)
    return met.select(F.col("fact_id_a").alias("fact_a"), F.col("fact_id_b").alias("fact_b"))


def touching_key_pairs(facts: DataFrame, some: DataFrame) -> DataFrame:
    """exact_key_pairs with at least one fact of `some` (rows of `facts`), without making the others."""
    keyed = lambda f, x: f.where(F.col("measure").isNotNull() & (F.col("measure") != "")).select(F.col("fact_id").alias(x), "measure", F.explode(S.subject_identities(F.col("subject_surface"), F.col("subject_key"))).alias("identity"))
    met = keyed(some, "x").join(keyed(facts, "y"), ["identity", "measure"]).where("x <> y")
    return met.select(F.least("x", "y").alias("fact_a"), F.greatest("x", "y").alias("fact_b")).distinct()


def magnitude_pairs(facts: DataFrame, width: float = BAND_WIDTH, window: int = BAND_WINDOW) -> DataFrame:
    """(fact_a, fact_b): figures of one kind and sign at most `window` steps apart on the logarithmic scale.

    The band join as an equi-join: one side is repeated for the neighbouring bands.
    """
    axes = F.array(*[F.lit(f"{kind}:{sign}") for kind in ("abs", "pct") for sign in ("zero", "-", "+")])
    m = N.magnitude_band(F.col("quantity"), width)
    banded = _keys(facts.select("fact_id", m.alias("m")).where("m is not null").withColumn("at", F.col("m.band") * 6 + F.array_position(axes, F.col("m.axis"))), F.array("at"))  # a number for each axis and band
    wide = F.array_sort(F.array_distinct(F.flatten(F.transform("keys", lambda k: F.sequence(k - 6 * window, k + 6 * window, F.lit(6).cast("long"))))))
    return _met(banded, banded.select("fact_id", wide.alias("keys")))


def _unit(table: pa.Table) -> tuple[list, np.ndarray]:
    """Ids and vectors of length 1, in the order of the ids; vectors without length stay so."""
    table = table.sort_by("id")
    flat = pa.concat_arrays([c.flatten() for c in table["vector"].chunks]) if table.num_rows else pa.array([], pa.float64())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return table["id"].to_pylist(), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(ids: list, unit: np.ndarray, asked_ids: list, asked: np.ndarray, k: int, least: float = 0.0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, similarities) of the k nearest of each asked vector, itself left out; ids in order break ties."""
    if not len(ids) or not len(asked_ids):
        return
    place = {x: i for i, x in enumerate(ids)}
    own = np.array([place.get(x, -1) for x in asked_ids])
    rough, rows = unit.astype(np.float32), 512
    for at in range(0, len(asked), rows):
        some = asked[at : at + rows]
        if (close := _close(rough, some.astype(np.float32), k, least)) is None:
            yield from _every(unit, own, asked, at, at + len(some), k, least)
            continue
        r, j = close
        sim = np.round(np.einsum("ij,ij->i", some[r], unit[j]), 9)
        kept = (sim >= least) & (own[at + r] != j)
        r, j, sim = r[kept], j[kept], sim[kept]
        order = np.lexsort((j, -sim, r))
        r, j, sim = r[order], j[order], sim[order]
        begin = np.searchsorted(r, np.arange(len(some) + 1))
        for q in range(len(some)):
            s = slice(begin[q], min(begin[q + 1], begin[q] + k))
            yield at + q, j[s], sim[s]


def _close(rough: np.ndarray, asked: np.ndarray, k: int, least: float, tile: int = 4096, slack: float = 2e-5, most: int = 64) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, place) of all that can be among the k nearest beside the query itself, by single precision; slack is more than twice its error.

    None where more than `most` a query and tile are close, so that they are not gathered, and where vectors are not finite or wider than 100.
    """
    if rough.shape[1] > 100 or not (np.isfinite(rough).all() and np.isfinite(asked).all()):
        return None
    bar, found = np.full(len(asked), least, np.float32), []
    for c in range(0, len(rough), tile):
        sim = asked @ rough[c : c + tile].T
        if c == 0 and sim.shape[1] > k:
            bar = np.maximum(bar, np.partition(sim, -k - 1, axis=1)[:, -k - 1])  # the query itself may be among them
        at = np.flatnonzero(sim >= (bar - slack)[:, None])
        if len(at) > most * len(asked):
            return None
        found.append((at // sim.shape[1], at % sim.shape[1] + c, sim.ravel()[at]))
    r, j, sim = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-sim, r))
    r, j, sim = r[order], j[order], sim[order]
    begin = np.searchsorted(r, np.arange(len(asked)))
    last = np.minimum(begin + k, len(r) - 1)  # the k + 1st of each query, where it has so many
    bar = np.where((last == begin + k) & (r[last] == np.arange(len(asked))), sim[last], bar) if len(r) else bar
    kept = sim >= bar[r] - slack
    return r[kept], j[kept]


def _every(unit: np.ndarray, own: np.ndarray, asked: np.ndarray, first: int, end: int, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """nearest for some of the asked vectors, by all similarities."""
    step = max(1, 8_000_000 // len(unit))
    for at in range(first, end, step):
        sim = np.round(asked[at : min(at + step, end)] @ unit.T, 9)
        for r in range(len(sim)):
            if own[at + r] >= 0:
                sim[r, own[at + r]] = -2.0
        n = min(k, len(unit))
        bar = np.partition(sim, -n, axis=1)[:, -n]
        for r in range(len(sim)):
            near = np.flatnonzero(sim[r] >= max(bar[r], least))
            near = near[np.argsort(-sim[r][near], kind="stable")][:k]
            yield at + r, near, sim[r][near]


def _found(query: list, other: list, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, c = [], [], []
    for i, near, sims in found:
        a += [query[i]] * len(near)
        b += [other[j] for j in near]
        c += sims.tolist()
    return pa.table({"query": a, "neighbour": b, "similarity": pa.array(c, pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = NEIGHBOURS, least: float = 0.0, vector_block: int = 200_000, query_block: int = 5_000) -> DataFrame:
    """(query, neighbour, similarity, rank): exact nearest neighbours of a stated query set against all vectors, itself left out; ties by id.

    Hashed blocks of queries meet hashed blocks of vectors as matrix products, so that a task holds a block of each; the best of every
    block are ranked again. Vectors without length are similar to nothing (0). For every vector as a query use a graph index instead.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    nv, nq = max(-(-n // vector_block), min(cores, -(-n // 1_000)), 1), max(1, -(-m // query_block))
    each = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    of = lambda df: df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    v = of(vectors).withColumn("bv", F.pmod(F.xxhash64("id"), F.lit(nv))).withColumn("bq", each(nq))
    q = of(queries).withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("bv", each(nv))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, x), (asked, y) = _unit(left), _unit(right)
        return _found(asked, ids, nearest(ids, x, asked, y, k, least)).cast(schema)

    one = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("query", one), ("neighbour", one), ("similarity", pa.float64())])
    found = v.groupBy("bv", "bq").cogroup(q.select(*(F.col(c).alias(c) for c in ("id", "vector", "bv", "bq"))).groupBy("bv", "bq")).applyInArrow(run, f"query {kind}, neighbour {kind}, similarity double")
    return _best(found, k).select("query", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def semantic_pairs(vectors: DataFrame, k: int = NEIGHBOURS, block: int = 200_000) -> DataFrame:
    """(fact_a, fact_b): every fact of vectors (fact_id, embedding_model, embedding) with its k exact nearest ones of one model and width.

    Both directions count once. Vectors without length and facts without vector pair with nothing. Vectors come in hashed blocks; every two
    blocks of a model meet once, for the queries of both, so that a task holds two blocks, and the best of every block are ranked
    again. The work grows with the square of a model's facts.
    """
    ship(vectors.sparkSession)
    v = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").select(F.col("fact_id").alias("id"), F.col("embedding").alias("vector"), F.concat_ws("/", F.coalesce("embedding_model", F.lit("")), F.size("embedding")).alias("space"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    busy = int((2 * cores) ** 0.5)  # so many blocks meet in about as many tasks as there are cores
    blocks = v.groupBy("space").agg(F.greatest(F.ceil(F.count("*") / block), F.least(F.lit(busy), F.ceil(F.count("*") / 10_000))).cast("int").alias("blocks"))  # a row for each model and width
    placed = v.join(blocks, "space").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = placed.select("space", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "id", "vector")

    def run(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        (ids, x), (more, y) = (_unit(t.filter(pc.equal(t["own"], b))) for b in (lo, hi))
        parts = [_found(ids, more, nearest(more, y, ids, x, k))] + ([_found(more, ids, nearest(ids, x, more, y, k))] if lo != hi else [])
        return pa.concat_tables(p.cast(pa.schema([("query", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())])) for p in parts)

    found = rows.repartition(16 * cores, "space", "lo", "hi").groupBy("space", "lo", "hi").applyInArrow(run, "query string, neighbour string, similarity double")
    return _best(found, k).select(F.least("query", "neighbour").alias("fact_a"), F.greatest("query", "neighbour").alias("fact_b")).distinct()


def key_classes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """exact_key_pairs, folded: (fact_id, name_class) of every fact that has a key, and (class_a, class_b, n) of the classes that meet, each with itself too.

    A class is the facts of one name, hard key and measure, called by its least fact_id; n is the number of their pairs.
    """
    name, hard = S.normalize_surface(F.col("subject_surface")), F.nullif("subject_key", F.lit(""))
    one = facts.where(F.col("measure").isNotNull() & (F.col("measure") != "")).select("fact_id", "measure", name.alias("name"), hard.alias("hard")).where("name <> '' or hard is not null")
    by = ["measure", "name", "hard"]
    classes = one.groupBy(*by).agg(F.min("fact_id").alias("name_class"), F.count("*").alias("n"))
    members = one.join(classes.withColumnsRenamed({c: f"_{c}" for c in by}), F.expr("measure = _measure and name = _name and hard <=> _hard")).select("fact_id", "name_class")
    met = exact_key_pairs(classes.select(F.col("name_class").alias("fact_id"), "measure", F.col("name").alias("subject_surface"), F.col("hard").alias("subject_key")))
    size = lambda x: classes.select(F.col("name_class").alias(f"class_{x}"), F.col("n").alias(f"n_{x}"))
    apart_ = met.withColumnsRenamed({"fact_a": "class_a", "fact_b": "class_b"}).join(size("a"), "class_a").join(size("b"), "class_b").select("class_a", "class_b", F.expr("n_a * n_b").alias("n"))
    return members, apart_.unionByName(classes.select(F.col("name_class").alias("class_a"), F.col("name_class").alias("class_b"), F.expr("n * (n - 1) div 2").alias("n"))).where("n > 0")


def folded_union(facts: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(fact_a, fact_b, folded, blocked_by, n): the union of the exact keys with other strategies, without the pairs that only the keys propose.

    Those are one row (folded) for each pair of key classes, with their number; every pair that another strategy proposes is a row of its own.
    """
    members, met = key_classes(facts)
    member = lambda x: members.select(F.col("fact_id").alias(f"fact_{x}"), F.col("name_class").alias(f"_{x}"))
    made = union_of(others).join(member("a"), "fact_a", "left").join(member("b"), "fact_b", "left").withColumns({"class_a": F.least("_a", "_b"), "class_b": F.greatest("_a", "_b")})
    made = made.withColumn("class_a", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("class_a"))).join(met.select("class_a", "class_b", F.lit(True).alias("key")), ["class_a", "class_b"], "left")
    rows = made.select("fact_a", "fact_b", F.lit(False).alias("folded"), F.when(F.col("key"), F.sort_array(F.concat("blocked_by", F.array(F.lit("key"))))).otherwise(F.col("blocked_by")).alias("blocked_by"), F.lit(1).cast("long").alias("n"))
    taken = made.where("key").groupBy("class_a", "class_b").agg(F.count("*").alias("k"))
    rest = met.join(taken, ["class_a", "class_b"], "left").select(F.col("class_a").alias("fact_a"), F.col("class_b").alias("fact_b"), F.lit(True).alias("folded"), F.array(F.lit("key")).alias("blocked_by"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")).where("n > 0")
    return rows.unionByName(rest)


def union_of(strategies: dict[str, DataFrame]) -> DataFrame:
    """(fact_a, fact_b, blocked_by): every pair once, with the sorted names of the strategies that proposed it."""
    every = reduce(DataFrame.unionByName, [p.select("fact_a", "fact_b", F.lit(name).alias("strategy")) for name, p in strategies.items()])
    return every.groupBy("fact_a", "fact_b").agg(F.sort_array(F.collect_set("strategy")).alias("blocked_by"))


def apart(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Without pairs of facts that were cut from one span of one document."""
    span = lambda x: facts.select(F.col("fact_id").alias(f"fact_{x}"), F.struct("doc_id", "char_start", "char_end").alias(f"_s{x}"))
    return pairs.join(span("a"), "fact_a").join(span("b"), "fact_b").where("_sa <> _sb").drop("_sa", "_sb")


def only_touching(pairs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs with at least one fact of `fresh` (fact_id)."""
    ids = fresh.select(F.col("fact_id").alias("_id")).distinct()
    marked = lambda df, x: df.join(ids.select(F.col("_id").alias(f"fact_{x}"), F.lit(True).alias(f"_{x}")), f"fact_{x}", "left")
    return marked(marked(pairs, "a"), "b").where("_a or _b").select(*pairs.columns)


def statistics(pairs: DataFrame, n_facts: DataFrame) -> DataFrame:
    """One row: n_facts, theoretical pairs, candidates, proposals that several strategies made, and the share saved. n: how many pairs a folded row is."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    made = pairs.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("candidates"), F.coalesce(F.sum((F.size("blocked_by") - 1) * n), F.lit(0)).cast("long").alias("duplicates_dropped"))
    n = n_facts.agg(F.count("*").alias("n_facts"))
    whole = made.join(n).withColumn("theoretical", (F.col("n_facts") * (F.col("n_facts") - 1) / 2).cast("long"))
    return whole.select("n_facts", "theoretical", "candidates", "duplicates_dropped", F.round(F.coalesce(F.try_divide(F.col("theoretical") - F.col("candidates"), F.col("theoretical")), F.lit(0.0)), 6).alias("reduction"))
