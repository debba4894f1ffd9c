"""The way of a document through the engine: chunks, requests, cached answers, grounded facts, relations, and what a run counts.

Every step is a DataFrame; nothing calls a model, so requests without a cached answer are counted as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import cut
from . import blocking, decide, extract, textstruct
from . import facts as FA

BATCH = 16


def sectioned_chunks(documents: DataFrame) -> DataFrame:
    """Own chunks (doc_id, chunk_no, char_start, char_end, text, pages) with the heading_path at their start."""
    docs = documents.select("doc_id", "text")
    chunks = textstruct.chunk_texts(docs).withColumnRenamed("char_start", "start")
    return textstruct.heading_paths(chunks, textstruct.headings(textstruct.lines(docs))).withColumnRenamed("start", "char_start")


def requests(chunks: DataFrame, model: str, size: int = BATCH) -> DataFrame:
    """(doc_id, batch_no, key, prompt): a request for every `size` chunks of a document in a row."""
    context = textstruct.context_text(F.col("heading_path"), F.array().cast("array<string>"), F.col("text"))
    rows = textstruct.batches(chunks.withColumn("context", context), size=size)
    asked = rows.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_no").cast("long").alias("passage_id"), "context"))).alias("passages"))
    prompted = asked.withColumn("prompt", extract.extraction_prompt(F.col("passages")))
    return prompted.select("doc_id", "batch_no", extract.request_key(extract.request_payload(model, F.col("prompt"))).alias("key"), "prompt")


def extracted(documents: DataFrame, cache: DataFrame, model: str) -> dict[str, DataFrame]:
    """facts, quarantined, orphaned and totals (a row for each document) of documents whose requests the cache (key, response) answers.

    A fact takes the conditions of its place, the basis and the section of the headings above it, that it doesn't state itself. Facts of one span and measure are one, the one with the
    most conditions; totals count them as collapsed duplicates.
    """
    chunks = cut(sectioned_chunks(documents))
    asked = cut(requests(chunks, model))
    answered = cut(extract.answers(asked.select("doc_id", "key"), cache))
    passages = chunks.select("doc_id", F.col("chunk_no").cast("long").alias("passage_id"), "char_start", "char_end")
    parts = {k: cut(df) for k, df in extract.grounded(answered.where("not missing"), passages, documents.select("doc_id", "text")).items()}
    headings = textstruct.headings(textstruct.lines(documents.select("doc_id", "text")))
    located = textstruct.heading_paths(parts["grounded"], headings).withColumn("inherited", textstruct.inherited_qualifiers(F.col("heading_path"), F.array().cast("array<string>")))
    stated = F.transform("f.qualifiers", lambda q: S.canonical_predicate(q["key"]))
    gaps = F.filter(F.map_entries(F.coalesce("inherited", F.create_map().cast("map<string,string>"))), lambda e: ~F.array_contains(stated, e["key"]))
    filled = F.concat("f.qualifiers", F.transform(gaps, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit("inherited").alias("provenance"))))
    made = extract.materialize(located.withColumn("f", F.col("f").withField("qualifiers", filled)).drop("inherited", "heading_path"), FA.fiscal_year_ends(documents))
    facts = cut(FA.keep_best(made, F.size("qualifiers"), [F.col("confidence").desc_nulls_last(), F.col("claim_text")]))
    return {"facts": facts, "quarantined": parts["quarantined"], "orphaned": parts["orphaned"], "totals": _totals(documents, asked, answered, parts, facts)}


def _totals(documents: DataFrame, asked: DataFrame, answered: DataFrame, parts: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    """doc_id, requests, missing, extracted, grounded, quarantined, orphaned, duplicates_collapsed, kept."""
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    of = {"requests": asked, "missing": answered.where("missing"), "grounded": parts["grounded"], "quarantined": parts["quarantined"], "orphaned": parts["orphaned"], "kept": facts}
    out = documents.select("doc_id").distinct()
    for name, df in of.items():
        out = out.join(counted(df, name), "doc_id", "left").fillna(0, [name])
    n: dict[str, Column] = {c: F.col(c) for c in of}
    return out.select("doc_id", "requests", "missing", (n["grounded"] + n["quarantined"]).alias("extracted"), "grounded", "quarantined", "orphaned", (n["grounded"] - n["kept"]).alias("duplicates_collapsed"), "kept")


def compared(facts: DataFrame, aliases: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Relations of the pairs that the strategies propose: keys (by the registry's names), magnitudes and, with vectors, nearest neighbours; facts of one span never meet."""
    named = cut(blocking.with_aliases(facts, aliases))
    proposed = {"key": blocking.exact_key_pairs(named), "value": blocking.magnitude_pairs(named)}
    if vectors is not None:
        proposed["semantic"] = blocking.semantic_pairs(vectors)
    pairs = blocking.apart(blocking.union_of(proposed), named)
    return decide.relations(pairs, named, keep_unrelated=False)
