"""Extraction answers as a source: requests by hash, cached answers, grounding and materialised facts.

No model is called here: a request whose answer is not in the cache table is counted as missing.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import ship_active
from . import facts as FA
from .align import align

ANSWER = (
    "facts array<struct<passage_id:bigint,claim_text:string,subject_surface:string,subject_key:string,subject_type:string,predicate:string,"
    "value:struct<kind:string,raw:string,unit:string,scale:string>,qualifiers:array<struct<key:string,value:string,provenance:string>>,quote:string,confidence:double>>"
)
VERDICT = "verdict string, qualifier_key string, explanation string, confidence double"
SCALE_KEYS, UNIT_KEYS = ("scale", "magnitude"), ("currency", "unit", "units")


def request_key(payload: Column) -> Column:
    """SHA-256 of a JSON payload in canonical form: sorted keys, no blanks, ASCII; null for null. Only the sorting leaves the JVM."""
    ship_active()

    def canonical(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=True) for t in texts.to_pylist()], pa.string())

    return F.sha2(F.arrow_udf(canonical, "string")(payload), 256)


#: What an extraction request asks for, and what a judge is asked about two facts; the passages and claims follow.
EXTRACT_PROMPT = "List every fact that the numbered passages state, each with the words that state it and the number of its passage."
JUDGE_PROMPT = "Two statements about one measure of one subject disagree. Say whether they contradict each other or which condition accounts for the difference."


def extraction_prompt(passages: Column) -> Column:
    """The prompt over an array of struct(passage_id, context), in their order."""
    return F.concat_ws("\n\n", F.lit(EXTRACT_PROMPT), F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["passage_id"].cast("string"), F.lit("] "), p["context"])), "\n\n"))


def judge_prompt(first: Column, second: Column, keys: Column) -> Column:
    """The prompt about a pair, in the order given, with the conditions that either fact has."""
    return F.concat_ws("\n", F.lit(JUDGE_PROMPT), F.concat(F.lit("A: "), first), F.concat(F.lit("B: "), second), F.concat(F.lit("Conditions: "), F.array_join(F.array_sort(F.array_distinct(keys)), ", ")))


def request_payload(model: str, prompt: Column) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), prompt.alias("prompt")))


def answers(requests: DataFrame, cache: DataFrame, schema: str = ANSWER) -> DataFrame:
    """requests (key, ...) with the cached answer parsed (null and missing=true where there is none or it can't be read)."""
    one = cache.groupBy("key").agg(F.min("response").alias("_response"))
    return requests.join(one, "key", "left").withColumn("answer", F.from_json("_response", schema)).withColumn("missing", F.col("answer").isNull()).drop("_response")


def grounded(answered: DataFrame, passages: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """grounded, quarantined and orphaned facts of answers (doc_id, answer); passages: (doc_id, passage_id, char_start, char_end).

    A fact of an unknown passage is orphaned; one whose quote isn't found around its passage is quarantined.
    """
    out = answered.select("doc_id", F.posexplode("answer.facts").alias("no", "f")).withColumn("passage_id", F.col("f.passage_id")).withColumn("quote_id", F.sha1(F.concat_ws(":", "doc_id", "passage_id", "no", F.coalesce("f.quote", F.lit("")))))
    known = passages.select("doc_id", "passage_id", F.col("char_start").alias("near_start"), F.col("char_end").alias("near_end"))
    met = out.join(known, ["doc_id", "passage_id"])
    placed = align(met.select("quote_id", "doc_id", F.col("f.quote").alias("quote"), "near_start", "near_end"), documents, strict=True)
    located = met.join(placed, "quote_id")
    return {
        "grounded": located.where("status <> 'unlocated'"),
        "quarantined": located.where("status = 'unlocated'").withColumn("quarantine_id", S.quarantine_id(F.col("doc_id"), F.col("passage_id"), F.coalesce(F.col("f.quote"), F.lit("")))),
        "orphaned": out.join(known.select("doc_id", "passage_id"), ["doc_id", "passage_id"], "left_anti"),
    }


def default_units(qualifiers: Column) -> tuple[Column, Column]:
    """(scale, unit) that an inherited qualifier gives to a bare figure."""
    first = lambda names: F.get(F.filter(qualifiers, lambda q: F.lower(F.trim(q["key"])).isin(*names)), F.lit(0))["value"]
    return first(SCALE_KEYS), first(UNIT_KEYS)


def materialize(located: DataFrame, fiscal_ends: DataFrame | None = None) -> DataFrame:
    """Facts in comparable form from grounded rows, with ids from document, span and measure, and flags."""
    f = F.col("f")
    scale, unit = default_units(f["qualifiers"])
    rows = located.join(fiscal_ends.select("doc_id", "month"), "doc_id", "left") if fiscal_ends is not None else located.withColumn("month", F.lit(None).cast("int"))
    rows = rows.withColumn("_m", S.split_consolidation(f["predicate"])).withColumn("quantity", F.when(f["value"]["kind"] == "quantity", FA.quantity_of(f["value"], f["claim_text"], f["quote"], scale, unit)))
    bag = F.map_from_entries(F.transform(f["qualifiers"], lambda q: F.struct(q["key"], F.struct(q["value"].alias("value"), q["provenance"].alias("provenance")))))
    basis = F.when(F.col("_m.basis").isNotNull(), F.map_from_arrays(F.array(F.lit("consolidation")), F.array(F.col("_m.basis"))))
    flags = F.array_compact(F.array(
        F.when((f["value"]["kind"] == "quantity") & F.col("quantity").isNull(), F.lit("unparsed_quantity")),
        F.when(S.subject_names_the_measurement(f["subject_surface"], F.col("_m.measure")), F.lit("subject_names_the_measurement")),
        F.when(f["value"]["scale"].isNull() & F.col("quantity.scale").isNotNull() & scale.isNull(), F.lit("scale_recovered_from_source")),
    ))
    return FA.with_qualifiers(rows, bag, F.coalesce(basis, F.create_map().cast("map<string,string>")), F.col("month")).select(
        S.fact_id(F.col("doc_id"), F.col("start"), F.col("end"), F.col("_m.measure")).alias("fact_id"), "doc_id", f["claim_text"].alias("claim_text"), f["subject_surface"].alias("subject_surface"), f["subject_key"].alias("subject_key"), f["predicate"].alias("predicate"),
        F.col("_m.measure").alias("measure"), f["value"]["kind"].alias("value_kind"), f["value"]["raw"].alias("value_raw"), "quantity", "qualifiers",
        S.subject_id(f["subject_surface"], f["subject_key"]).alias("subject_id"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("status").alias("align_status"), f["confidence"].alias("confidence"), flags.alias("flags"),
    )
