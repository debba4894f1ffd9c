"""The ledger's query surface: filtered pages with totals, evidence, verification, and summaries, as DataFrames.

A page is a window over the whole order: `limit` and `offset` are the feature, everything else runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facts as FA

COUNTERS = ("extracted", "grounded", "quarantined", "duplicates_collapsed")


def _page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of the rows in order, with the number of all rows as total; an empty page has no rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _like(column: Column, word: str) -> Column:
    """Whether the text has the word, whatever its case; % and _ in the word are wildcards."""
    return F.coalesce(F.ilike(column, F.lit(f"%{word}%")), F.lit(False))


def facts_page(facts: DataFrame, *, doc_id: int | None = None, predicate: str | None = None, q: str | None = None, quarantined: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
    """Facts once, located ones or else the quarantined, by document, canonical predicate and a word in claim, subject or predicate; with total."""
    rows = FA.once(facts)
    unlocated = F.coalesce(F.col("align_status"), F.lit("")) == "unlocated"
    rows = rows.where(unlocated if quarantined else ~unlocated)
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    if predicate is not None:
        rows = rows.where(F.col("predicate_canonical") == predicate)
    if q:
        rows = rows.where(_like(F.col("claim_text"), q) | _like(F.col("subject_surface"), q) | _like(F.col("predicate"), q))
    return _page(rows, [F.col("doc_id"), F.col("page").asc_nulls_first(), F.col("fact_id")], limit, offset)


def relations_page(relations: DataFrame, facts: DataFrame, *, verdict: str | None = None, cross_document: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
    """Stored relations that say something, or those of one verdict, with both facts' claims and documents; with total.

    The page is cut before the facts are joined, so that only its own are looked up.
    """
    rows = relations.where(F.col("verdict") == verdict if verdict else F.col("verdict") != "unrelated")
    if cross_document:
        rows = rows.where("cross_document = 1")
    page = _page(rows, [F.desc("cross_document"), F.col("verdict"), F.col("relation_id")], limit, offset)
    one = FA.once(facts.select("fact_id", "doc_id", "claim_text", "created_at"))
    side = lambda x: one.select(F.col("fact_id").alias(f"fact_{x}"), F.col("doc_id").alias(f"doc_{x}"), F.col("claim_text").alias(f"claim_{x}"))
    return page.join(side("a"), "fact_a", "left").join(side("b"), "fact_b", "left")


def evidence(facts: DataFrame, documents: DataFrame, window: int = 600) -> DataFrame:
    """fact_id, located, context, context_start, highlight_start, highlight_end: each fact's place in its document's text; null where it has none."""
    e = F.from_json("evidence_json", FA.EVIDENCE)
    one = FA.once(facts.select("fact_id", "doc_id", "evidence_json", "created_at")).select("fact_id", "doc_id", e["char_start"].alias("a"), e["char_end"].alias("b"))
    met = one.join(documents.select("doc_id", "text"), "doc_id", "left")
    located = F.coalesce((F.col("a") >= 0) & F.col("text").isNotNull(), F.lit(False))
    begin = F.greatest(F.lit(0), F.col("a") - window)
    end = F.least(F.length("text").cast("long"), F.col("b") + window)
    where = lambda c: F.when(located, c)
    return met.select(
        "fact_id", located.alias("located"), where(F.substring(F.col("text"), (begin + 1).cast("int"), (end - begin).cast("int"))).alias("context"), where(begin).cast("long").alias("context_start"),
        where(F.col("a") - begin).cast("long").alias("highlight_start"), where(F.col("b") - begin).cast("long").alias("highlight_end"),
    )


def verify(facts: DataFrame, documents: DataFrame, quote: Column) -> DataFrame:
    """fact_id, verified, reason, text_at_offsets: whether the document's text at the stored offsets is the quote, character by character."""
    e = F.from_json("evidence_json", FA.EVIDENCE)
    met = facts.select("fact_id", "doc_id", e["char_start"].alias("a"), e["char_end"].alias("b"), quote.alias("quote")).join(documents.select("doc_id", "text"), "doc_id", "left")
    unlocated = F.coalesce(F.col("a") < 0, F.lit(True))
    actual = F.when(~unlocated, F.substring(F.col("text"), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")))
    same = F.coalesce(actual == F.col("quote"), F.lit(False))
    return met.select("fact_id", same.alias("verified"), F.when(unlocated, F.lit("unlocated")).when(~same, F.lit("text differs")).alias("reason"), actual.alias("text_at_offsets"))


def schema_timeline(events: DataFrame, *, doc_id: int | None = None, limit: int = 300) -> DataFrame:
    """The latest events first, of one document or all."""
    rows = events if doc_id is None else events.where(F.col("doc_id") == doc_id)
    return rows.orderBy(F.desc("event_id")).limit(limit)


def schema_entries(registry: DataFrame) -> DataFrame:
    """canonical, n_aliases, seen_count, first_seen_doc and place in the order of use."""
    names = F.size(F.from_json(F.coalesce("aliases_json", F.lit("[]")), "array<string>"))
    return registry.select("canonical", F.greatest(names, F.lit(0)).alias("n_aliases"), "seen_count", "first_seen_doc")


def extraction_totals(documents: DataFrame) -> DataFrame:
    """One row: the extraction counters that documents carry in doc_context, summed, and the share quarantined of what was extracted."""
    context = F.from_json("doc_context", "extraction map<string,bigint>")["extraction"]
    sums = documents.select(context.alias("x")).agg(*[F.coalesce(F.sum(F.try_element_at("x", F.lit(c))), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    done = F.col("grounded") + F.col("quarantined")
    return sums.withColumn("quarantine_rate", F.round(F.coalesce(F.try_divide(F.col("quarantined"), done), F.lit(0.0)), 4))


def totals(facts: DataFrame, documents: DataFrame, relations: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: documents, located facts, quarantined ones and their share, relations that say something, and measures."""
    one = FA.once(facts.select("fact_id", "align_status", "created_at"))
    unlocated = F.coalesce(F.col("align_status"), F.lit("")) == "unlocated"
    parts = [
        documents.agg(F.count("*").alias("documents")), one.agg(F.count_if(~unlocated).alias("facts"), F.count_if(unlocated).alias("quarantined")),
        relations.agg(F.count_if(F.col("verdict") != "unrelated").alias("relations")), registry.agg(F.count("*").alias("predicates")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    share = F.try_divide(F.col("quarantined"), F.col("facts") + F.col("quarantined"))
    return out.drop("_one").withColumn("quarantine_rate", F.round(F.coalesce(share, F.lit(0.0)), 4))


def shaped(facts: DataFrame) -> DataFrame:
    """Facts as the surface shows them: JSON fields read, and figures that no JSON can hold (infinite, not a number) null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return facts.withColumns({
        "value": F.from_json("value_json", FA.VALUE), "qualifiers": F.from_json("qualifiers_json", FA.BAG), "evidence": F.from_json("evidence_json", FA.EVIDENCE), "flags": F.from_json("flags_json", "array<string>"),
        "value_normalized": finite(F.col("value_normalized")), "confidence": finite(F.coalesce("confidence", F.lit(1.0))),
    }).drop("value_json", "qualifiers_json", "evidence_json", "flags_json", "embedding")
