"""Queries of the reconciliation engine's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import strings as S
from ..operators import adjudicate, align, blocking, decide, partition, registry, tally, textstruct
from ..operators import facts as FA
from ..session import cut, spread, table
from ..sources import ledger

BAG = FA.BAG


def canonical_predicates(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "facts").select("predicate").where("predicate is not null").distinct()
    return t.select("predicate", S.canonical_predicate(F.col("predicate")).alias("canonical"), S.split_consolidation(F.col("predicate"))["measure"].alias("measure"))


def surface_names(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "facts").select("subject_surface").where("subject_surface is not null").distinct()
    return t.select("subject_surface", S.normalize_surface(F.col("subject_surface")).alias("name"))


def surface_identities(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "facts").select("subject_surface").distinct()
    return t.select("subject_surface", F.explode(S.surface_identities(F.col("subject_surface"))).alias("identity"))


def fact_ids(s: SparkSession, d: str) -> DataFrame:
    e = F.from_json("evidence_json", FA.EVIDENCE)
    t = table(s, d, "facts").where("predicate_canonical is not null and evidence_json is not null")
    return t.select("fact_id", S.fact_id(F.col("doc_id"), e["char_start"], e["char_end"], F.col("predicate_canonical")).alias("made_id")).distinct()


def dimensions(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "facts").select(F.explode(F.map_keys(F.from_json("qualifiers_json", BAG))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return keys.select("k", S.dimension_of(F.col("k")).alias("dim"), S.key_matches(F.col("k"), S.DISCRIMINATING).alias("recognised"), "n")


def quantities(s: SparkSession, d: str) -> DataFrame:
    """Every different figure of facts as a number with its precision interval."""
    v = F.from_json("value_json", FA.VALUE)
    raw = table(s, d, "facts").where("value_kind = 'quantity'").select(v["raw"].alias("raw")).where("raw is not null").distinct()
    q = F.col("q")
    inf = lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 4))
    return raw.withColumn("q", N.parse_quantity(F.col("raw"))).where("q is not null").select("raw", F.round(q["normalized"], 4).alias("normalized"), inf(q["lo"]).alias("lo"), inf(q["hi"]).alias("hi"), q["scale"].alias("scale"), q["bound"].alias("bound"), q["is_percent"].alias("is_percent"))


def written_digits(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "facts").select(F.from_json("value_json", FA.VALUE)["raw"].alias("raw")).where("raw is not null").distinct()
    return raw.select("raw", N.written_digits(F.col("raw")).alias("digits"))


def periods(s: SparkSession, d: str) -> DataFrame:
    """Every different period label of facts as an interval."""
    labels = table(s, d, "facts").select(F.from_json("qualifiers_json", BAG)["period"]["value"].alias("label")).where("label is not null").distinct()
    p = F.col("p")
    return labels.withColumn("p", P.parse_period(F.col("label"))).where("p is not null").select("label", p["start"].alias("starts"), p["end"].alias("ends"), p["granularity"].alias("granularity"))


def fiscal_year_ends(s: SparkSession, d: str) -> DataFrame:
    return FA.fiscal_year_ends(table(s, d, "documents")).select("doc_id", "month", "n")


def deliveries(s: SparkSession, d: str) -> DataFrame:
    t = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "predicate", "created_at"))
    return t.select("fact_id", "doc_id", "predicate", "created_at")


def best_of_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Of each fact's deliveries the one with the most conditions, then the earliest."""
    t = table(s, d, "facts").select("fact_id", "created_at", F.coalesce(F.size(F.map_keys(F.from_json("qualifiers_json", BAG))), F.lit(0)).alias("known"))
    return FA.keep_best(t, F.col("known"), [F.col("created_at")]).select("fact_id", "known", "created_at")


def anaphora(s: SparkSession, d: str) -> DataFrame:
    t = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "subject_surface", "predicate", "created_at"))
    out = FA.resolve_anaphora(t)
    return out.where("resolved").select("fact_id", "doc_id", "surface_resolved")


def clear_modes(s: SparkSession, d: str) -> DataFrame:
    return FA.clear_mode(table(s, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "o_orderpriority", "n")


def _parties(s: SparkSession, d: str, name: str, prefix: str) -> DataFrame:
    """Balances as facts: one figure for each customer or supplier."""
    t = table(s, d, name)
    v = F.col(f"{prefix}_acctbal")
    q = F.struct(v.alias("normalized"), F.lit(False).alias("is_percent"))
    return t.select(F.format_string("%08d", F.col(f"{prefix}_{'custkey' if prefix == 'c' else 'suppkey'}")).alias("fact_id"), F.concat(F.lit("nation "), F.col(f"{prefix}_nationkey").cast("string")).alias("subject_surface"), F.lit(None).cast("string").alias("subject_key"), (F.col("c_mktsegment") if prefix == "c" else F.lit("balance")).alias("measure"), q.alias("quantity"))


def exact_key_pairs(s: SparkSession, d: str) -> DataFrame:
    return blocking.exact_key_pairs(_parties(s, d, "customer", "c"))


def magnitude_pairs(s: SparkSession, d: str) -> DataFrame:
    return blocking.magnitude_pairs(_parties(s, d, "supplier", "s"))


def neighbours(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return blocking.neighbours(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding").select("query", "neighbour", "rank")


def _blocked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _parties(s, d, "supplier", "s")
    return blocking.union_of({"key": blocking.exact_key_pairs(f), "value": blocking.magnitude_pairs(f)}), f


def blocking_union(s: SparkSession, d: str) -> DataFrame:
    return _blocked(s, d)[0].select("fact_a", "fact_b", F.concat_ws(",", "blocked_by").alias("blocked_by"))


def blocking_statistics(s: SparkSession, d: str) -> DataFrame:
    return blocking.statistics(*_blocked(s, d))


def _comparable(s: SparkSession, d: str) -> DataFrame:
    """The facts that are compared, their measures by the registry's names."""
    return blocking.with_aliases(FA.comparable(ledger.loadable(table(s, d, "facts"))), registry.aliases(table(s, d, "predicate_registry")))


def _blocked_facts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All three strategies over the facts that are compared."""
    rows = ledger.loadable(table(s, d, "facts"))
    f = cut(_comparable(s, d).select("fact_id", "subject_surface", "subject_key", "measure", "quantity"))
    vectors = FA.once(rows.select("fact_id", "embedding_model", "embedding", "created_at"))
    return blocking.folded_union(f, {"value": blocking.magnitude_pairs(f), "semantic": blocking.semantic_pairs(vectors)}), f


def facts_key_classes(s: SparkSession, d: str) -> DataFrame:
    """The class of each fact in the folded rows of facts_blocking_union."""
    f = ledger.loadable(table(s, d, "facts"))
    measure = S.split_consolidation(F.coalesce("predicate_canonical", "predicate"))["measure"]
    one = FA.once(f.select("fact_id", "subject_surface", "subject_key", measure.alias("measure"), "created_at"))
    return blocking.key_classes(blocking.with_aliases(one, registry.aliases(table(s, d, "predicate_registry"))))[0]


def facts_magnitude_pairs(s: SparkSession, d: str) -> DataFrame:
    return blocking.magnitude_pairs(FA.comparable(ledger.loadable(table(s, d, "facts"))))


def facts_blocking_union(s: SparkSession, d: str) -> DataFrame:
    return _blocked_facts(s, d)[0].select("fact_a", "fact_b", "folded", F.concat_ws(",", "blocked_by").alias("blocked_by"), "n")


def facts_blocking_statistics(s: SparkSession, d: str) -> DataFrame:
    return blocking.statistics(*_blocked_facts(s, d))


def _orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as facts: the customer's total of a year under a segment that some orders don't state."""
    t = spread(table(s, d, "orders"), "o_custkey")  # the customers' orders meet below
    figure = F.round("o_totalprice").cast("long").cast("string")
    bag = F.map_filter(F.map_from_arrays(F.array(F.lit("period"), F.lit("segment")), F.array(F.concat(F.lit("CY"), F.year("o_orderdate").cast("string")), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))), lambda _, v: v.isNotNull())
    whole = F.transform_values(bag, lambda _, v: F.struct(v.alias("value"), F.lit("stated").alias("provenance")))
    return FA.with_qualifiers(t, whole).select(
        F.format_string("%010d", "o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject_surface"), F.lit(None).cast("string").alias("subject_key"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject_id"), F.lit("order_total").alias("measure"), F.lit("quantity").alias("value_kind"), figure.alias("value_raw"),
        N.parse_quantity(figure).alias("quantity"), "qualifiers",
    )


def _order_relations(s: SparkSession, d: str) -> DataFrame:
    facts = cut(_orders(s, d))
    return decide.relations(blocking.exact_key_pairs(facts), facts, with_partitions=False)


def order_verdicts(s: SparkSession, d: str) -> DataFrame:
    return _order_relations(s, d).select("fact_a", "fact_b", "verdict", "rule_fired", "qualifier_key", "needs_llm")


def decide_histogram(s: SparkSession, d: str) -> DataFrame:
    """Verdicts by rule over the facts table: all pairs of one identity and measure."""
    return tally.histogram(_comparable(s, d))


def partition_groups(s: SparkSession, d: str) -> DataFrame:
    """Shares of line items by flag and status, whose sum is the whole, as complementary categories."""
    t = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    total = table(s, d, "lineitem").agg(F.count("*").alias("total"))
    share = F.round(F.col("n") * 100 / F.col("total"), 1)
    q = F.struct(share.alias("normalized"), (share - 0.05).alias("lo"), (share + 0.05).alias("hi"), F.lit(None).cast("string").alias("bound"), F.lit(True).alias("is_percent"))
    key = F.concat_ws("-", "l_returnflag", "l_linestatus")
    facts = t.join(total).select(F.concat(F.lit("f_"), key).alias("fact_id"), F.lit("items").alias("subject_id"), F.lit("share").alias("measure"), q.alias("quantity"), F.array(F.struct(F.lit("class").alias("key"), S.plain_words(key).alias("plain"))).alias("qualifiers"))
    return partition.members(facts).select("fact_id", "split_key", "category")


def text_lines(s: SparkSession, d: str) -> DataFrame:
    t = textstruct.lines(table(s, d, "documents"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("end").cast("long").alias("last_end"), F.sum("start").cast("long").alias("starts"))


def furniture(s: SparkSession, d: str) -> DataFrame:
    """Line shapes that a source repeats over its documents."""
    docs = table(s, d, "documents").where("text is not null and source is not null")
    of = textstruct.lines(docs).join(docs.select("doc_id", "source"), "doc_id")
    return textstruct.furniture(of, "doc_id", "source", docs.select("doc_id", "source"))


def chunk_headings(s: SparkSession, d: str) -> DataFrame:
    """The heading path at each chunk's start, by an as-of join of chunks with the headings of their documents."""
    docs = table(s, d, "documents")
    found = textstruct.headings(textstruct.lines(docs))
    points = table(s, d, "chunks").select("chunk_id", "doc_id", F.col("char_start").alias("start")).distinct()
    return textstruct.heading_paths(points, found).select("chunk_id", F.concat_ws(" > ", "heading_path").alias("path"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Own chunks of every document: number, span and length."""
    return textstruct.chunk_texts(table(s, d, "documents")).select("doc_id", "chunk_no", "char_start", "char_end", F.length("text").alias("n"))


def verify_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks re-cut from their documents: how many are what they say."""
    met = table(s, d, "chunks").join(table(s, d, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
    same = F.substring(F.col("whole"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("text")
    return met.groupBy(F.coalesce(same, F.lit(False)).alias("grounded")).agg(F.count("*").alias("n"))


def evidence_window(s: SparkSession, d: str) -> DataFrame:
    """Each located fact's text with 60 code points on either side."""
    e = F.from_json("evidence_json", FA.EVIDENCE)
    f = table(s, d, "facts").select("fact_id", "doc_id", e["char_start"].alias("a"), e["char_end"].alias("b")).where("a >= 0").distinct()
    met = f.join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    begin = F.greatest(F.lit(0), F.col("a") - 60)
    return met.select("fact_id", begin.alias("starts"), (F.col("a") - begin).alias("highlight"), F.md5(F.substring(F.col("text"), (begin + 1).cast("int"), (F.col("b") + 60 - begin).cast("int"))).alias("window_md5"))


def aligned_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims located in their documents near where they are said to be, unlocated ones in the whole text: status by count."""
    e = F.from_json("evidence_json", FA.EVIDENCE)
    q = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "claim_text", "evidence_json", "created_at")).select(F.col("fact_id").alias("quote_id"), "doc_id", F.col("claim_text").alias("quote"), F.when(e["char_start"] >= 0, e["char_start"]).alias("near_start"), F.when(e["char_start"] >= 0, e["char_end"]).alias("near_end"))
    return align.align(q, table(s, d, "documents")).groupBy("status").agg(F.count("*").alias("n"))


def content_hashes(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("text is not null")
    return t.groupBy((F.sha2(F.col("text"), 256) == F.col("sha256")).alias("same")).agg(F.count("*").alias("n"))


def _relations(s: SparkSession, d: str) -> DataFrame:
    """Relations once, least id first, verdicts in one spelling."""
    t = table(s, d, "relations").where("fact_a is not null and fact_b is not null and verdict is not null")
    rows = t.select(F.least("fact_a", "fact_b").alias("fact_a"), F.greatest("fact_a", "fact_b").alias("fact_b"), F.lower(F.trim("verdict")).alias("verdict"), "rule_fired", "qualifier_key", (F.col("judged") == 1).alias("judged"))
    return rows.groupBy("fact_a", "fact_b").agg(F.min("verdict").alias("verdict"), F.min("rule_fired").alias("rule_fired"), F.min("qualifier_key").alias("qualifier_key"), F.max("judged").alias("judged"))


def carry_forward(s: SparkSession, d: str) -> DataFrame:
    """A run that asks for every contradiction and reconciliation, with the judged answers of before."""
    prior = _relations(s, d)
    run = prior.select("fact_a", "fact_b", F.when(F.col("judged"), F.lit("contradicts")).otherwise(F.col("verdict")).alias("verdict"), F.lit("fresh").alias("rule_fired"), F.lit(None).cast("string").alias("qualifier_key"), F.lit(True).alias("needs_llm"))
    return adjudicate.carry_forward(run, prior).select("fact_a", "fact_b", "verdict", "rule_fired", "needs_llm", "judged")


def stale_relations(s: SparkSession, d: str) -> DataFrame:
    rel = _relations(s, d)
    return ledger.stale(rel, rel.where("verdict <> 'unrelated'")).select("fact_a", "fact_b")


def admitted(s: SparkSession, d: str) -> DataFrame:
    """Contradictions judged in both orders: answers made from the stored rows, the second order seeing the pair's rule."""
    rel = _relations(s, d).withColumn("needs_llm", F.lit(True)).withColumn("explanation", F.lit("found"))
    forward = rel.select("fact_a", "fact_b", "verdict", "qualifier_key", F.lit("f").alias("explanation"))
    turned = F.when(F.col("rule_fired") == "same_context_disjoint_intervals", F.col("verdict")).otherwise(F.lit("unrelated"))
    reverse = rel.select("fact_a", "fact_b", turned.alias("verdict"), "qualifier_key", F.lit("r").alias("explanation"))
    keys = FA.once(table(s, d, "facts").select("fact_id", "qualifiers_json", "created_at")).select("fact_id", F.map_keys(F.from_json("qualifiers_json", BAG)).alias("keys"))
    return adjudicate.admit(rel, forward, reverse, keys)


def adjudicated(s: SparkSession, d: str) -> DataFrame:
    return admitted(s, d).groupBy("verdict", "rule_fired", "decided_by").agg(F.count("*").alias("n"))


def adjudication_rates(s: SparkSession, d: str) -> DataFrame:
    return adjudicate.rates(admitted(s, d))


def facts_search(s: SparkSession, d: str, q: str = "revenue", page: int = 100) -> DataFrame:
    """Facts with a word in claim, subject or predicate, one page of them in order."""
    t = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "page", "claim_text", "subject_surface", "predicate", "align_status", "created_at"))
    hit = F.lit(False)
    for c in ("claim_text", "subject_surface", "predicate"):
        hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{q}%")), F.lit(False))
    return ledger.loadable(t).where(hit).orderBy("doc_id", F.col("page").asc_nulls_first(), "fact_id").limit(page).select("fact_id", "doc_id", "page")


def relations_list(s: SparkSession, d: str) -> DataFrame:
    """Relations that say something, with both claims."""
    rel = _relations(s, d).where("verdict <> 'unrelated'")
    one = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "claim_text", "created_at"))
    side = lambda x: one.select(F.col("fact_id").alias(f"fact_{x}"), F.col("doc_id").alias(f"doc_{x}"), F.col("claim_text").alias(f"claim_{x}"))
    return rel.join(side("a"), "fact_a", "left").join(side("b"), "fact_b", "left").select("fact_a", "fact_b", "verdict", "doc_a", "doc_b", F.md5("claim_a").alias("claim_a"), F.md5("claim_b").alias("claim_b"))


def verdict_histogram(s: SparkSession, d: str) -> DataFrame:
    return _relations(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


def ledger_stats(s: SparkSession, d: str) -> DataFrame:
    """Per document: facts, unlocated facts and the share located."""
    t = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "align_status", "created_at"))
    n = t.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("align_status") == "unlocated").alias("quarantined"))
    out = table(s, d, "documents").select("doc_id").join(n, "doc_id", "left")
    f, u = F.coalesce("facts", F.lit(0)), F.coalesce("quarantined", F.lit(0))
    return out.select("doc_id", f.alias("facts"), u.alias("quarantined"), F.round(F.coalesce(F.try_divide(f - u, f), F.lit(0.0)), 4).alias("located_rate"))


def health(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "facts", "relations", "predicate_registry", "schema_events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_summary(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "schema_events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def registry_aliases(s: SparkSession, d: str) -> DataFrame:
    return registry.aliases(table(s, d, "predicate_registry"))


def registry_fold(s: SparkSession, d: str) -> DataFrame:
    """Events of folding the facts' canonical measures into an empty registry."""
    t = table(s, d, "facts").select(F.col("predicate_canonical").alias("measure"))
    return s.createDataFrame(registry.fold(t, registry.Registry()), "event_type string, subject string, target string, similarity double")


def contrasts(s: SparkSession, d: str) -> DataFrame:
    """Names of the registry that are another one under a contrasting modifier: the names of one head meet, not all names."""
    t = table(s, d, "predicate_registry").select("canonical", S._modifier(F.col("canonical"))[0].alias("head"))
    a, b = t.withColumnRenamed("canonical", "a"), t.withColumnRenamed("canonical", "b")
    return a.join(b, "head").where(F.col("a") < F.col("b")).select("a", "b", S.contrastive(F.col("a"), F.col("b")).alias("contrast"))


def invariants(s: SparkSession, d: str) -> DataFrame:
    """Data-quality rules of the ledger, each with the number of rows that break it."""
    facts, rel = table(s, d, "facts"), table(s, d, "relations")
    ids = facts.select("fact_id").distinct()
    loose = rel.where("fact_a is not null").join(ids, rel["fact_a"] == ids["fact_id"], "left_anti")
    selfs = rel.where("fact_a = fact_b")
    scaled = facts.where("value_kind = 'quantity'").withColumn("v", F.from_json("value_json", FA.VALUE)).where(N.is_percent_unit(F.col("v.unit")) & F.col("v.scale").isNotNull())
    unlocated = rel.join(facts.where("align_status = 'unlocated'").select(F.col("fact_id").alias("fact_a")).distinct(), "fact_a", "left_semi")
    rules = {"dangling": loose, "self_pair": selfs, "scaled_percentage": scaled, "on_unlocated": unlocated}
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _all() -> dict:
    fs = (
        canonical_predicates, surface_names, surface_identities, fact_ids, dimensions, quantities, written_digits, periods, fiscal_year_ends, deliveries, best_of_duplicates, anaphora, clear_modes, exact_key_pairs, magnitude_pairs, neighbours,
        blocking_union, blocking_statistics, facts_key_classes, facts_magnitude_pairs, facts_blocking_union, facts_blocking_statistics, order_verdicts, decide_histogram, partition_groups, text_lines, furniture, chunk_headings, chunks, verify_chunks, evidence_window, aligned_claims, content_hashes, carry_forward, stale_relations,
        adjudicated, adjudication_rates, facts_search, relations_list, verdict_histogram, ledger_stats, health, schema_summary, registry_aliases, registry_fold, contrasts, invariants,
    )
    return {f.__name__: f for f in fs}


QUERIES = _all()


