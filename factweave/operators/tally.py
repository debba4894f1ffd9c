"""The histogram of the decision table over all pairs of one identity and measure, without a row per pair.

Facts are folded by name, measure and conditions. Which conditions two facts differ in is decided once for each pair of different bags of
conditions, by the decision table itself; how many pairs of facts with these bags have figures that agree or disagree is counted over
sorted intervals, in numpy. Only agreeing pairs are enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import cut, ship
from . import blocking, decide
from . import partition as parts

#: Facts of a name that one task pairs with all of another; enumerated pairs and cells held at once.
CHUNK, AT_ONCE = 8_192, 500_000
COUNTED = "c1 bigint, c2 bigint, agree bigint, coarse bigint, disagree bigint"


def ranges(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for every place in each row's half-open range, in blocks."""
    n = np.maximum(end - begin, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        m = n[at:upto]
        rows = np.repeat(np.arange(at, upto), m)
        yield rows, np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m) + begin[rows]
        at = upto


def overlapping(a: dict, b: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (i, j) with lo_i < hi_j and lo_j < hi_i: the later start lies within the other interval."""
    oa, ob = np.argsort(a["lo"], kind="stable"), np.argsort(b["lo"], kind="stable")
    la, lb = a["lo"][oa], b["lo"][ob]
    for i, p in ranges(np.searchsorted(lb, a["lo"], "left"), np.searchsorted(lb, a["hi"], "left")):
        j = ob[p]
        ok = a["lo"][i] < b["hi"][j]
        yield i[ok], j[ok]
    for j, p in ranges(np.searchsorted(la, b["lo"], "right"), np.searchsorted(la, b["hi"], "left")):
        i = oa[p]
        ok = b["lo"][j] < a["hi"][i]
        yield i[ok], j[ok]


def equal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (i, j) with equal codes; negative ones equal nothing."""
    order = np.argsort(b, kind="stable")
    s = b[order]
    begin, end = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    for i, p in ranges(begin, np.where(a < 0, begin, end)):
        yield i, order[p]


def coarse(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """numbers.rests_on_imprecision of figures that overlap; of two equally wide ones that of the lesser fact_id counts as the wider."""
    wa, wb = a["hi"][i] - a["lo"][i], b["hi"][j] - b["lo"][j]
    gap = np.abs(a["normalized"][i] - b["normalized"][j])
    may = (gap > 0) & np.isfinite(wa) & np.isfinite(wb) & (gap >= np.minimum(wa, wb))
    one_a, one_b = a["digits"][i] <= 1, b["digits"][j] <= 1
    out = may & np.where(wa >= wb, one_a, one_b)
    for k in np.flatnonzero(may & (wa == wb) & (one_a != one_b)):
        out[k] = one_a[k] if a["own"][i[k]] < b["own"][j[k]] else one_b[k]
    return out


def count_unit(rows: pa.Table, cell) -> None:
    """Counts the pairs of one unit, side a by side b, by their bags of conditions; cell(c1, c2, agree, coarse, disagree) gets them.

    Within one name (side b holds side a's facts) every pair is met from either end and each fact meets itself, which is taken off; pairs
    of two names are counted twice to match.
    """
    whole = {}
    for c in ("kind", "unit", "words", "day"):
        codes = pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1)
        whole[c] = codes.to_numpy(zero_copy_only=False).astype(np.int64)
    for c, null in (("ctx", -1), ("w", 0), ("digits", 99), ("lo", np.nan), ("hi", np.nan), ("normalized", np.nan), ("figure", False), ("pct", False), ("is_a", False)):
        whole[c] = pc.fill_null(rows[c].combine_chunks(), null).to_numpy(zero_copy_only=False)
    whole["own"] = np.array(rows["own"].to_pylist(), dtype=object)
    within = bool(rows["within"][0].as_py())
    # Values of one sort are comparable alike: figures by percent and unit, others by kind.
    sort = np.where(whole["figure"], np.where(whole["pct"], 1, 0), 2 + whole["kind"] + 1)
    (sorts, code) = np.unique(np.stack([sort, np.where(whole["figure"], whole["unit"], -1)]), axis=1, return_inverse=True)
    whole["sort"] = code.ravel()
    s, u = sorts
    meet = (s[:, None] == s[None, :]) & ((s[:, None] >= 2) | (u[:, None] < 0) | (u[None, :] < 0) | (u[:, None] == u[None, :]))
    pick = lambda x, at: {k: v[at] for k, v in x.items()}
    side_a, b = pick(whole, whole["is_a"]), pick(whole, ~whole["is_a"])
    cb, b["c"] = np.unique(b["ctx"], return_inverse=True)
    nb = np.zeros((len(cb), len(s)))
    np.add.at(nb, (b["c"], b["sort"]), b["w"])
    fb, tb = pick(b, b["figure"]), pick(b, ~b["figure"])
    all_ca = np.unique(side_a["ctx"])
    step = max(1, AT_ONCE // max(1, len(cb)))
    for k in range(0, len(all_ca), step):
        ca = all_ca[k : k + step]
        a = pick(side_a, np.isin(side_a["ctx"], ca))
        a["c"] = np.searchsorted(ca, a["ctx"])
        na = np.zeros((len(ca), len(s)))
        np.add.at(na, (a["c"], a["sort"]), a["w"])
        met = na @ meet @ nb.T
        size = met.size
        agree, rough = np.zeros(size), np.zeros(size)
        fa, ta = pick(a, a["figure"]), pick(a, ~a["figure"])
        for i, j in overlapping(fa, fb):
            ua, ub = fa["unit"][i], fb["unit"][j]
            ok = (fa["pct"][i] == fb["pct"][j]) & ((ua < 0) | (ub < 0) | (ua == ub))
            i, j = i[ok], j[ok]
            at, is_rough = fa["c"][i] * len(cb) + fb["c"][j], coarse(fa, fb, i, j)
            agree += np.bincount(at[~is_rough], minlength=size)
            rough += np.bincount(at[is_rough], minlength=size)
        for by in ("day", "words"):
            pair = lambda t: np.where(t[by] < 0, -1, t[by] * (len(s) + 1) + t["sort"])  # noqa: B023, E731
            for i, j in equal(pair(ta), pair(tb)):
                if by == "words":
                    ok = (ta["day"][i] < 0) | (tb["day"][j] < 0)
                    i, j = i[ok], j[ok]
                agree += np.bincount(ta["c"][i] * len(cb) + tb["c"][j], weights=ta["w"][i] * tb["w"][j], minlength=size)
        agree, rough = (x.reshape(met.shape) for x in (agree, rough))
        other = met - agree - rough
        if within:
            itself = np.where(a["figure"], a["lo"] < a["hi"], (a["day"] >= 0) | (a["words"] >= 0))
            same = np.searchsorted(cb, ca)
            agree[np.arange(len(ca)), same] -= np.bincount(a["c"], weights=a["w"] * itself, minlength=len(ca))
            other[np.arange(len(ca)), same] -= np.bincount(a["c"], weights=a["w"] * ~itself, minlength=len(ca))
        x, y = np.nonzero((agree != 0) | (rough != 0) | (other != 0))
        times = 1 if within else 2
        cell(np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y]), *((m[x, y] * times).astype(np.int64) for m in (agree, rough, other)))


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit -> twice the pairs by bags of conditions; sums are kept over units, so that a task returns each pair of bags seldom."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def folded() -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        return cols[0][first], cols[1][first], *(np.add.reduceat(c, first) for c in cols[2:])

    def cell(*cols: np.ndarray) -> None:
        nonlocal n, held
        if len(cols[0]):
            held.append(cols)
            n += len(cols[0])
        if n > 2 * AT_ONCE:
            held = [folded()]
            n = len(held[0][0]) if len(held[0][0]) <= AT_ONCE else 0
            if not n:
                ready.append(held.pop())

    def out(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in cols], ["c1", "c2", "agree", "coarse", "disagree"])

    ready: list[tuple[np.ndarray, ...]] = []
    pending: list[pa.RecordBatch] = []
    unit = None

    def close() -> Iterator[pa.RecordBatch]:
        if pending:
            count_unit(pa.Table.from_batches(pending), cell)
            pending.clear()
        while ready:
            yield from out(ready.pop())

    for b in batches:
        units = b.column("unit_key").to_pylist()
        at = 0
        while at < len(units):
            if units[at] != unit:
                yield from close()
                unit = units[at]
            upto = at
            while upto < len(units) and units[upto] == unit:
                upto += 1
            pending.append(b.slice(at, upto - at))
            at = upto
    yield from close()
    if held:
        yield from out(folded())


def _conditions(facts: DataFrame) -> Column:
    """The bag as comparing sees it. Where every time has an interval only the interval of a time counts, not its spelling."""
    time = lambda q: (q["dim"] == "period") | S.key_matches(q["key"], S.PERIOD_KEYS)
    whole = lambda q: q["start"].isNotNull() & q["end"].isNotNull()
    spelled = facts.where(F.exists("qualifiers", lambda q: time(q) & ~whole(q))).limit(1).count() > 0
    said = lambda q, c: q[c] if spelled else F.when(~whole(q), q[c])
    return F.transform("qualifiers", lambda q: F.struct(q["key"].alias("key"), q["dim"].alias("dim"), said(q, "plain").alias("plain"), q["start"].alias("start"), q["end"].alias("end"), said(q, "day").alias("day"), said(q, "years").alias("years"), q["known"].alias("known"), q["separates"].alias("separates")))


def histogram(facts: DataFrame) -> DataFrame:
    """decide.histogram of decide.relations(blocking.exact_key_pairs(facts), facts), all pairs counted and few made."""
    ship(facts.sparkSession)
    state = F.sha1(F.to_json(F.struct("measure", S.normalize_surface(F.col("subject_surface")).alias("n"), F.nullif("subject_key", F.lit("")).alias("k"))))
    facts = cut(facts.where(F.col("measure").isNotNull() & (F.col("measure") != "")).withColumn("state", state))
    # A time of which only one order of the pair separates: such facts are paired one by one.
    odd = F.exists("qualifiers", lambda q: (q["dim"] == "period") & ~q["separates"])
    made = decide.histogram(decide.relations(blocking.touching_key_pairs(facts, facts.where(odd)), facts, with_partitions=True))
    rest = facts.where(~odd)
    q = F.col("quantity")
    figure = F.coalesce(F.col("value_kind") == "quantity", F.lit(False))
    one = decide.prepared(rest).withColumns({"figure": figure, "ctx_bag": _conditions(rest)}).withColumn("ctx_key", F.sha1(F.to_json("ctx_bag", {"ignoreNullFields": "false"})))
    keys = one.groupBy("ctx_key").agg(F.first("ctx_bag").alias("bag"))
    bags = cut(keys.select(F.monotonically_increasing_id().alias("ctx"), "ctx_key", "bag"))  # numbered where they lie, once
    num = lambda c: F.when(figure, q[c].cast("double")).alias(c)
    text = lambda c: F.when(~F.col("figure"), F.col(c))
    values = one.select("state", "ctx_key", "figure", (figure & q.isNull()).alias("unread"), F.when(figure, F.col("fact_id")).alias("own"), text("value_kind").alias("kind"), F.when(figure, q["unit"]).alias("unit_of"), F.when(figure, q["is_percent"]).alias("pct"), num("lo"), num("hi"), num("normalized"), F.when(figure, F.col("digits")).cast("int").alias("digits"), text("words").alias("words"), text("day").cast("string").alias("day"))
    folded = cut(values.groupBy(*values.columns).agg(F.count("*").cast("double").alias("w")).join(bags.select("ctx_key", "ctx"), "ctx_key").drop("ctx_key"))
    # Names of one measure that meet, each with itself too; n facts each.
    states = rest.groupBy("state").agg(F.count("*").alias("n"), F.min("measure").alias("measure"), F.min("subject_surface").alias("subject_surface"), F.max(F.nullif("subject_key", F.lit(""))).alias("subject_key")).where(F.size(S.subject_identities(F.col("subject_surface"), F.col("subject_key"))) > 0)
    states = cut(states.withColumnRenamed("state", "fact_id").withColumns({"name": S.normalize_surface(F.col("subject_surface")), "hard": F.nullif("subject_key", F.lit(""))}))
    side = lambda x: states.select(F.col("fact_id").alias(f"fact_{x}"), F.col("n").alias(f"n_{x}"), F.struct("name", "hard").alias(f"s_{x}"))
    met = blocking.exact_key_pairs(states).unionByName(states.select(F.col("fact_id").alias("fact_a"), F.col("fact_id").alias("fact_b")))
    met = met.join(side("a"), "fact_a").join(side("b"), "fact_b").withColumn("within", F.col("fact_a") == F.col("fact_b"))
    met = cut(met.withColumns({"same": F.coalesce(S.names_match(F.col("s_a.name"), F.col("s_a.hard"), F.col("s_b.name"), F.col("s_b.hard")), F.lit(False)), "pairs": F.when(F.col("within"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b")), "chunks": F.ceil(F.col("n_a") / CHUNK).cast("int"), "unit": F.concat("fact_a", "fact_b")}).drop("s_a", "s_b"))
    work = met.where("same and pairs > 0").select("unit", "fact_a", "fact_b", "within", "chunks")
    readable = folded.where("not unread").drop("unread")
    a = work.join(readable.withColumnRenamed("state", "fact_a"), "fact_a").withColumn("chunk", F.pmod(F.xxhash64("own", "ctx", "kind", "words", "day"), F.col("chunks")).cast("int")).withColumn("is_a", F.lit(True))
    b = work.join(readable.withColumnRenamed("state", "fact_b"), "fact_b").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("is_a", F.lit(False))
    columns = ["is_a", "within", "ctx", "figure", "own", "kind", F.col("unit_of").alias("of"), "pct", "lo", "hi", "normalized", "digits", "words", "day", "w"]
    rows = a.unionByName(b).select(F.concat_ws(":", "unit", "chunk").alias("unit"), *columns)
    counted = _count(rows)
    cells = cut(counted.groupBy("c1", "c2").agg(*[F.expr(f"sum({c}) div 2").alias(c) for c in ("agree", "coarse", "disagree")]))
    # One decision for each pair of bags and outcome of the values.
    bag = lambda x: bags.select(F.col("ctx").alias(f"c{x}"), F.col("bag").alias(f"bag{x}"))
    seen = cells.join(bag(1), "c1").join(bag(2), "c2").select("agree", "coarse", "disagree", decide.compare_contexts(F.col("bag1"), F.col("bag2")).alias("diff"))
    shape = seen.select("agree", "coarse", "disagree", F.struct(*[F.col("diff")[c].alias(c) for c in ("differing", "missing")]).alias("diff"))
    outcomes = F.array(*[F.struct(F.lit("agree" if c != "disagree" else c).alias("values"), F.lit(c == "coarse").alias("coarse"), F.col(c).alias("n")) for c in ("agree", "coarse", "disagree")])
    rule = decide.first_rule(F.lit(True), F.lit(None).cast("string"), F.col("o.values"), F.col("diff"), F.col("o.coarse"))
    decided = shape.select("diff", F.explode(F.filter(outcomes, lambda o: o["n"] > 0)).alias("o")).select(rule.alias("d"), F.col("o.n").alias("n"))
    by_bags = decided.groupBy("d.verdict", "d.rule_fired").agg(F.sum("n").alias("n"), F.sum(F.col("d.needs_llm").cast("long") * F.col("n")).alias("referred"))
    plain = lambda df, verdict, rule: df.select(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule_fired"), "n", F.lit(0).cast("long").alias("referred"))
    others = plain(met.where("not same").agg(F.sum("pairs").alias("n")), "unrelated", "comparison_key_differs")
    comparable = cells.agg(F.coalesce(F.sum(F.col("agree") + F.col("coarse") + F.col("disagree")), F.lit(0)).alias("m"))
    unlike = plain(met.where("same").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p")).join(comparable).select((F.col("p") - F.col("m")).alias("n")), "insufficient_context", "incomparable_values")
    # Parts of one whole are decided by that before their values: they move from one rule to the other.
    split = _parted(facts, odd)
    moved = decide.histogram(decide.relations(split, facts)).unionByName(decide.histogram(decide.relations(split, facts, with_partitions=False)).withColumns({"n": -F.col("n"), "referred": -F.col("referred")}))
    every = made.unionByName(by_bags).unionByName(others).unionByName(unlike).unionByName(moved)
    return every.groupBy("verdict", "rule_fired").agg(F.sum("n").alias("n"), F.sum("referred").alias("referred")).where("n <> 0")


def _count(rows: DataFrame) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    sorted_ = rows.repartition(n, "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_units(b.rename_columns(["unit_key" if c == "unit" else "unit" if c == "of" else c for c in b.schema.names]) for b in batches)

    return sorted_.mapInArrow(run, COUNTED)


def _parted(facts: DataFrame, odd: Column) -> DataFrame:
    """Pairs of one group under different categories that share an identity, without those that are made anyway."""
    of = parts.members(facts)
    ids = facts.where(~odd).select("fact_id", "measure", S.subject_identities(F.col("subject_surface"), F.col("subject_key")).alias("ids"))
    side = lambda x: of.join(ids, "fact_id").select(F.col("fact_id").alias(f"fact_{x}"), "group_id", "split_key", F.col("category").alias(f"c_{x}"), F.col("ids").alias(f"ids_{x}"))
    met = side("a").join(side("b"), ["group_id", "split_key"]).where((F.col("fact_a") < F.col("fact_b")) & (F.col("c_a") != F.col("c_b")) & F.arrays_overlap("ids_a", "ids_b"))
    return met.select("fact_a", "fact_b").distinct()
