"""Most similar vectors by robust-pruned directed graphs, one for each shard of the collection; all close vectors by comparing within shards.

A vector is a node of one shard only, that of its nearest pivot; pivots are fitted on bounded samples, level by level, until shards
are small, so the number of shards grows with the collection. A shard's graph is grown in batches that double: a beam
search from the entry nodes proposes neighbours of each new vector, batch mates propose each other, and robust pruning with a relaxed distance
keeps an edge only where no kept edge leads closer to its end. Edges are added in reverse and pruned again. Queries are answered
by beam search in the shards whose pivots are nearly as similar as the nearest one. All steps work on whole batches of vectors at once.
Where all vectors of some similarity are wanted, each row is compared with all own rows of its shards instead: shards are bounded, so that this
costs less than building a graph, and leaves none of a shard's close vectors out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

#: Rows of a shard, pivots that one level fits at most (more rows take more levels), and sampled rows for each pivot.
SHARD_ROWS, MAX_PIVOTS, SAMPLE = 6_000, 1_024, 64
DEGREE, BEAM, WIDTH, ALPHA, ENTRIES = 20, 16, 4, 1.1, 192
#: Queries go to shards whose pivot is that much less similar than their nearest one: for all close vectors, and for the k best.
MARGIN, REACH = 0.06, 0.4
#: Similarities that one step of comparing computes at most.
CELLS = 1_500_000
#: Of the k best few are in shards whose pivot is that much less similar: the beam is narrower there, FAR_BEAM times k.
FAR, FAR_BEAM = 0.15, 2


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), each queries x beam, best first; free places have id -1. entries: start nodes of each query.

    Every step expands the `width` best nodes of each beam that are not expanded yet.
    """
    n, b, r = len(x), len(q), graph.shape[1]
    seen = np.zeros((b, n), dtype=bool)
    rows = np.arange(b)
    e = entries.shape[1]
    beam = max(beam, e)
    ids = np.full((b, beam), -1, dtype=np.int64)
    sims = np.full((b, beam), -2.0, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    s = np.matmul(x[entries], q[:, :, None])[..., 0]
    ids[:, :e], sims[:, :e] = _by_similarity(entries, s, e)
    done[:, :e] = ids[:, :e] < 0
    seen[rows[:, None], entries] = True
    while True:
        open_ = ~done
        pick = open_ & (np.cumsum(open_, axis=1) <= width)
        at, col = np.nonzero(pick)
        if not len(at):
            return ids, sims
        done[at, col] = True
        to = graph[ids[at, col]]
        where = np.repeat(at, r)
        to = to.ravel()
        key = where * n + to
        key = key[(to >= 0) & ~seen.ravel()[np.where(to >= 0, key, 0)]]
        if not len(key):
            continue
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        seen.ravel()[key] = True
        where, to = np.divmod(key, n)
        got = np.einsum("md,md->m", x[to], q[where])
        better = got > sims[where, -1]
        where, to, got = where[better], to[better], got[better]
        if not len(where):
            continue
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        active, count = where[first], np.diff(np.append(first, len(where)))
        place = np.arange(len(where)) - np.repeat(first, count)
        local = np.repeat(np.arange(len(active)), count)
        wide = beam + int(count.max())
        all_ids, all_sims, all_done = np.full((len(active), wide), -1, dtype=np.int64), np.full((len(active), wide), -2.0, dtype=np.float32), np.ones((len(active), wide), dtype=bool)
        all_ids[:, :beam], all_sims[:, :beam], all_done[:, :beam] = ids[active], sims[active], done[active]
        all_ids[local, beam + place], all_sims[local, beam + place], all_done[local, beam + place] = to, got, False
        order = np.argsort(-all_sims, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sims, all_done))


def starts(x: np.ndarray, entries: np.ndarray, q: np.ndarray, most: int = 4) -> np.ndarray:
    """The entry nodes most similar to each query."""
    if len(entries) <= most:
        return np.broadcast_to(entries, (len(q), len(entries)))
    return entries[np.argpartition(-(q @ x[entries].T), most - 1, axis=1)[:, :most]]


def robust_prune(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Rows of at most `degree` neighbours: candidates (best first, -1 where there is none) that no kept one is much closer to."""
    b, c = ids.shape
    v = x[np.maximum(ids, 0)]
    near = np.matmul(v, v.transpose(0, 2, 1))
    far = 1.0 - sims
    alive = ids >= 0
    kept = np.zeros((b, c), dtype=bool)
    count = np.zeros(b, dtype=np.int64)
    for j in range(c):
        take = alive[:, j] & (count < degree)
        if not take.any():
            continue
        kept[:, j] = take
        count += take
        occluded = alpha * (1.0 - near[:, j, :]) <= far
        occluded[:, : j + 1] = False
        alive &= ~(occluded & take[:, None])
    out = np.full((b, degree), -1, dtype=np.int64)
    at, col = np.nonzero(kept)
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    out[at, place] = ids[at, col]
    return out


def _by_similarity(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted best first, doubled ids once."""
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    double = np.zeros(ids.shape, dtype=bool)
    for k in range(1, 3):
        double[:, k:] |= (ids[:, k:] == ids[:, :-k]) & (ids[:, k:] >= 0)
    sims = np.where(double | (ids < 0), -2.0, sims)
    ids = np.where(double, -1, ids)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 768, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry nodes) over unit vectors; graph rows hold neighbours, -1 where there is none."""
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    entries = order[: min(n, ENTRIES)]
    at = 0
    while at < n:
        size = min(n - at, max(64, min(batch, at)))
        new = order[at : at + size]
        q = x[new]
        mates = q @ q.T
        np.fill_diagonal(mates, -2.0)
        m = min(8 if at else degree * 3, size - 1)
        best = np.argpartition(-mates, m - 1, axis=1)[:, :m] if 0 < m < size else np.empty((size, 0), dtype=np.int64)
        pool_ids, pool_sims = new[best], np.take_along_axis(mates, best, 1)
        if at:
            found, s = beam_search(x, graph, q, starts(x, entries[:at], q), beam)
            pool_ids, pool_sims = np.concatenate([pool_ids, found], 1), np.concatenate([pool_sims, s], 1)
        if pool_ids.shape[1]:
            graph[new] = robust_prune(x, *_by_similarity(pool_ids, pool_sims, beam + 8), degree, alpha)
            _reverse(x, graph, new, degree, alpha)
        at += size
    return graph, entries


def _reverse(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges back from the new nodes' neighbours; rows that get too long are pruned."""
    to = graph[new]
    at, col = np.nonzero(to >= 0)
    target, source = to[at, col], new[at]
    gone = (graph[target] == source[:, None]).any(axis=1)
    target, source = target[~gone], source[~gone]
    if not len(target):
        return
    sim = np.einsum("md,md->m", x[target], x[source])
    order = np.lexsort((-sim, target))
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    fits = place < degree
    extra = np.full((len(nodes), degree), -1, dtype=np.int64)
    extra[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    pool = np.concatenate([graph[nodes], extra], 1)
    sims = np.where(pool >= 0, np.matmul(x[np.maximum(pool, 0)], x[nodes][:, :, None])[..., 0], -2.0)
    pool, sims = _by_similarity(pool, sims, 2 * degree)
    long = (pool >= 0).sum(axis=1) > degree
    graph[nodes[~long]] = pool[~long, :degree]
    if long.any():
        graph[nodes[long]] = robust_prune(x, pool[long], sims[long], degree, alpha)


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column without nulls."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(values), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of k cells of unit vectors by a few rounds of spherical k-means; the same for the same rows."""
    c = x[np.random.default_rng(11).permutation(len(x))[:k]]
    for _ in range(6):
        own = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), c)
    return c


def _first_pivots(rows: DataFrame, n: int, shard_rows: int, max_pivots: int) -> tuple[np.ndarray, float]:
    """The first level's pivots, fitted on a sample of bounded size that a hash of the id picks, and the rows of the largest cell."""
    k = max(1, min(max_pivots, math.ceil(n / shard_rows)))
    if k == 1:
        return np.zeros((1, 1)), n
    every = max(1, n // (SAMPLE * 2 * k))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "vector").limit(SAMPLE * 4 * k)
    x = unit_rows(sample.toArrow().sort_by("id").column("vector"))
    c = fit_pivots(x, k)
    return c, np.bincount(np.argmax(x @ c.T, axis=1)).max() / len(x) * n


def _cells_of(v: np.ndarray, own: np.ndarray, asked: np.ndarray, pivots: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own, gap: how much less similar the cell's pivot is than the nearest): own rows go to their nearest pivot's cell, asked ones also to the cells within the margin."""
    s = v @ pivots.T
    best = np.argmax(s, axis=1)
    gap = s.max(axis=1, keepdims=True) - s
    near = (gap <= margin) & asked[:, None]
    near[np.arange(len(v)), best] |= own
    row, cell = np.nonzero(near)
    return row, cell, own[row] & (best[row] == cell), gap[row, cell]


def _placed(batch: pa.RecordBatch | pa.Table, row: np.ndarray, cell: np.ndarray, own: np.ndarray, gap: np.ndarray) -> pa.Table:
    """The rows in their new cells; a cell is called by its path from the first level on, and the gap is the largest on it."""
    out = batch.take(pa.array(row))
    gap = np.maximum(out.column("gap").to_numpy(zero_copy_only=False), gap.astype(np.float32))
    path = [f"{p}/{c}" if p else str(c) for p, c in zip(out.column("shard").to_pylist(), cell.tolist())]
    return pa.table({"part": out.column("part"), "shard": pa.array(path, pa.string()), "id": out.column("id"), "vector": out.column("vector"), "own": pa.array(own), "asked": out.column("asked"), "gap": pa.array(gap)})


def _assigned(pivots: dict[str, np.ndarray], margin: float):
    """Rows (part, shard, id, vector, own, asked, gap) in the cells of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("part").to_pylist(), dtype=object)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for part in sorted(set(groups)):
                at = np.flatnonzero(groups == part)
                some, c = batch.take(pa.array(at)), pivots[part]
                if len(c) == 1:
                    placed = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at))
                else:
                    placed = _cells_of(unit_rows(some.column("vector")), np.ones(len(at), bool), asked[at], c, margin)
                yield from _placed(some, *placed).to_batches()

    return run


def _divided(shard_rows: int, max_pivots: int, margin: float):
    """Rows of a salt of a large cell in cells of their own: every salt fits the same pivots on the cell's sample."""

    def run(sample: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["part", "shard", "id", "vector", "own", "asked", "gap"])
        own, asked = (rows.column(c).to_numpy() for c in ("own", "asked"))
        if not sample.num_rows:
            return _placed(rows, np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), own, np.zeros(rows.num_rows))
        x = unit_rows(sample.sort_by("id").column("vector"))
        k = min(max_pivots, max(2, math.ceil(len(x) * sample.column("every")[0].as_py() / shard_rows)), len(x))
        return _placed(rows, *_cells_of(unit_rows(rows.column("vector")), own, asked, fit_pivots(x, k), margin))

    return run


def _levels(placed: DataFrame, shard_rows: int, max_pivots: int, margin: float, levels: int = 3) -> DataFrame:
    """placed with large cells divided by pivots of their own, level by level; its cells are counted by their own rows."""
    kind = placed.schema["id"].dataType.simpleString()
    schema = f"part string, shard string, id {kind}, vector array<float>, own boolean, asked boolean, gap float"
    done: DataFrame | None = None
    for _ in range(levels):
        placed = cut(placed)
        # as many rows as cells of a level that are large: a row for shard_rows rows of the collection at most
        sizes = placed.groupBy("part", "shard").agg(F.count_if("own").alias("n"), F.count("*").alias("m")).where(F.col("n") > 4 * shard_rows)
        if sizes.isEmpty():
            break
        k = F.least(F.ceil(F.col("n") / shard_rows), F.lit(max_pivots))
        sizes = cut(sizes.select("part", "shard", F.greatest(F.lit(1), F.floor(F.col("n") / (k * SAMPLE))).alias("every"), F.ceil(F.col("m") / (16 * shard_rows)).alias("salts")))
        large = placed.join(sizes, ["part", "shard"])
        rest = placed.join(sizes, ["part", "shard"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        salted = large.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")))
        sample = large.where(F.col("own") & (F.pmod(F.xxhash64("id"), F.col("every")) == 0)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        sample = sample.select(*(F.col(c).alias(c) for c in sample.columns))  # columns of its own, as both sides come from one table
        by = ["part", "shard", "salt"]
        placed = sample.groupBy(*by).cogroup(salted.groupBy(*by)).applyInArrow(_divided(shard_rows, max_pivots, margin), schema)
    return placed if done is None else done.unionByName(placed)


def _compared(at_least: float):
    """(id, other, similarity) of a shard: the asked rows, own ones and visitors, with all its own rows of at least that similarity."""

    def run(table: pa.Table) -> pa.Table:
        exact = unit_rows(table.column("vector"))
        nodes = np.flatnonzero(table.column("own").to_numpy())
        asked = np.flatnonzero(table.column("asked").to_numpy())
        x = np.ascontiguousarray(exact[nodes].astype(np.float32).T)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        size = max(1, CELLS // max(1, len(nodes)))
        for i in range(0, len(asked) if len(nodes) else 0, size):
            rows = asked[i : i + size]
            near = exact[rows].astype(np.float32) @ x >= np.float32(at_least - 1e-4)
            at, col = np.divmod(np.flatnonzero(near.ravel()), len(nodes))
            a, b = rows[at], nodes[col]
            a, b = a[a != b], b[a != b]
            sims = np.einsum("md,md->m", exact[a], exact[b])
            keep = sims >= at_least - 1e-9
            found.append((a[keep], b[keep], sims[keep]))
        a, b, sims = (np.concatenate(v) for v in zip(*found))
        name = table.column("id").combine_chunks()
        return pa.table({"id": name.take(pa.array(a)), "other": name.take(pa.array(b)), "similarity": pa.array(sims)})

    return run


def _searched(k: int, degree: int, beam: int):
    """(id, other, similarity) of a shard: the graph over its own rows, queried by the asked rows, own ones and visitors. beam: the queries'."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        own = table.column("own").to_numpy()
        asked = table.column("asked").to_numpy()
        exact = unit_rows(table.column("vector"))
        x = np.ascontiguousarray(exact[own].astype(np.float32))
        nodes = np.flatnonzero(own)
        graph, entries = build_graph(x, degree) if len(nodes) else (None, None)
        node_of = np.full(len(own), -1, dtype=np.int64)
        node_of[nodes] = np.arange(len(nodes))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        far = table.column("gap").to_numpy() > FAR
        for mine, apart in ((True, False), (False, False), (False, True)) if len(nodes) else ():
            queries = np.flatnonzero(asked & (own == mine) & (far == apart))
            for i in range(0, len(queries), 768):
                rows = queries[i : i + 768]
                q = exact[rows].astype(np.float32)
                start = starts(x, entries, q, 4 if mine else 8)
                if mine:  # from the row's own node too
                    start = np.concatenate([node_of[rows][:, None], start], axis=1)
                most = FAR_BEAM * k if apart else max(beam, 3 * k)
                ids, sims = beam_search(x, graph, q, start, min(most, len(nodes)))
                ok = (ids >= 0) & (ids != node_of[rows][:, None])
                ok &= np.cumsum(ok, axis=1) <= k
                a, c = np.nonzero(ok)
                left.append(rows[a])
                right.append(nodes[ids[a, c]])
        a, b = np.concatenate(left), np.concatenate(right)
        sims = np.einsum("md,md->m", exact[a], exact[b])
        name = table.column("id").combine_chunks()
        return pa.table({"id": name.take(pa.array(a)), "other": name.take(pa.array(b)), "similarity": pa.array(sims)})

    return run


def usable(vector: Column) -> Column:
    """Neither null nor all zero, and without nulls or NaN."""
    return F.coalesce(F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def nearest(
    vectors: DataFrame, *, id_col: str, vector_col: str, part_col: str, k: int = 10, asked: Column | None = None, at_least: float | None = None,
    shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, margin: float | None = None, max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(id, other, similarity): the vectors most similar by cosine to each asked vector of its part (e.g. the model that made it) and width.

    With `at_least`, all vectors of at least that similarity; without, the `k` best. An asked vector visits the shards whose pivots are
    within `margin` of its nearest one's similarity (MARGIN or REACH), and meets the vectors whose own shard that is. Ids must be unique;
    null ids, parts and vectors, and zero vectors, are no rows of the collection. Ties go by id. A shard that stays beyond four times
    `shard_rows` rows, because its vectors are too alike to be divided, becomes several, each asked by all its visitors.
    """
    spark = vectors.sparkSession
    ship(spark)
    margin = margin if margin is not None else (REACH if at_least is None else MARGIN)
    part = F.concat_ws("#", F.col(part_col), F.size(vector_col))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(part_col).isNotNull()).select(
        part.alias("part"), F.lit("").alias("shard"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.coalesce(asked if asked is not None else F.lit(True), F.lit(False)).alias("asked"), F.lit(0.0).cast("float").alias("gap")
    )
    kind = rows.schema["id"].dataType.simpleString()
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    fitted = {p: _first_pivots(rows.where(F.col("part") == p), n, shard_rows, max_pivots) for p, n in counts.items()}
    placed = rows.mapInArrow(_assigned({p: c for p, (c, _) in fitted.items()}, margin), f"part string, shard string, id {kind}, vector array<float>, own boolean, asked boolean, gap float")
    if all(most <= 3 * shard_rows for _, most in fitted.values()):
        placed = placed.withColumn("cut", F.lit(0))
    else:
        placed = _levels(placed, shard_rows, max_pivots, margin)
        several = placed.groupBy("part", "shard").agg(F.greatest(F.lit(1), F.ceil(F.count_if("own") / (4 * shard_rows))).alias("cuts")).where("cuts > 1")
        met = placed.join(several, ["part", "shard"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long"))).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        placed = met.withColumn("own", F.col("own") & (F.col("cut") == F.pmod(F.xxhash64("id"), F.col("cuts")))).drop("cuts")
    # about a shard a task, whatever the session's number of shuffle partitions
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(math.ceil(n / shard_rows) for n in counts.values()))
    of_shard = _searched(k, degree, beam) if at_least is None else _compared(at_least)
    found = placed.repartition(tasks, "part", "shard", "cut").groupBy("part", "shard", "cut").applyInArrow(of_shard, f"id {kind}, other {kind}, similarity double")
    if at_least is not None:
        return found.distinct()
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "similarity")


def _classes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for every different vector of a model, and the members (fact_id, rep) of those that several facts have."""
    rows = facts.where(usable(F.col("embedding")) & F.col("embedding_model").isNotNull() & F.col("fact_id").isNotNull()).select(
        "fact_id", "embedding_model", "embedding", F.xxhash64("embedding_model", "embedding").alias("h"), F.hash("embedding", "embedding_model").alias("g")
    )
    reps = cut(
        rows.groupBy("h", "g").agg(F.min(F.struct("fact_id", "embedding_model", "embedding")).alias("x"), F.max("fact_id").alias("last")).select("h", "g", "last", "x.*")
    )
    several = reps.where(F.col("fact_id") != F.col("last")).select("h", "g", F.col("fact_id").alias("rep"))
    members = rows.select("fact_id", "h", "g").join(several, ["h", "g"]).select("fact_id", "rep").distinct()
    return reps, members


def close_pairs(facts: DataFrame, at_least: float = 0.96, **options) -> DataFrame:
    """(fact_a, fact_b), fact_a < fact_b: different facts of one model with cosine >= at_least, repeated deliveries once.

    Equal vectors are compared once; their facts are expanded at the end.
    """
    reps, members = _classes(facts)
    members = cut(members)
    found = nearest(reps, id_col="fact_id", vector_col="embedding", part_col="embedding_model", at_least=at_least, **options)
    links = found.select(F.least("id", "other").alias("ra"), F.greatest("id", "other").alias("rb")).distinct()
    alike = lambda x: members.select(F.col("rep").alias(f"r{x}"), F.col("fact_id").alias(f"m{x}"))
    across = links.join(alike("a"), "ra", "left").join(alike("b"), "rb", "left").select(F.coalesce("ma", "ra").alias("x"), F.coalesce("mb", "rb").alias("y"))
    inside = alike("a").join(alike("b").withColumnRenamed("rb", "ra"), "ra").where("ma < mb").select(F.col("ma").alias("x"), F.col("mb").alias("y"))
    return across.unionByName(inside).select(F.least("x", "y").alias("fact_a"), F.greatest("x", "y").alias("fact_b")).distinct()


def similar_facts(facts: DataFrame, k: int = 10, one_in: int = 20, **options) -> DataFrame:
    """(fact_id, other, rank, similarity): the k most similar other facts of every one_in-th fact (by a hash of its id), against all facts.

    Every fact is in the index; repeated deliveries count once. Facts with equal vectors are different facts here.
    """
    once = facts.select("fact_id", "embedding_model", "embedding").dropDuplicates(["fact_id"])
    asked = F.pmod(F.xxhash64("fact_id"), F.lit(one_in)) == 0
    found = nearest(once, id_col="fact_id", vector_col="embedding", part_col="embedding_model", k=k, asked=asked, **({"beam": 48} | options))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return found.select(F.col("id").alias("fact_id"), "other", rank.alias("rank"), F.round("similarity", 9).alias("similarity"))
