"""Facts as the engine compares them: parsed quantities, qualifier bags with periods, identities; deduplication and document-level modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import strings as S
from ..functions.lets import let
from ..session import spread

VALUE = "raw string, kind string, unit string, scale string"
BAG = "map<string,struct<value:string,provenance:string>>"
EVIDENCE = "page int, char_start bigint, char_end bigint"

#: One known condition of a fact, with what comparing it needs.
QUALIFIER = "struct<key:string,dim:string,value:string,provenance:string,plain:string,start:date,end:date,day:date,years:array<int>,known:boolean,separates:boolean>"


def qualifier(q: Column, said: Column) -> Column:
    """A condition (key, value, provenance) with what its value says about time."""
    period = F.when(S.key_matches(q["key"], S.PERIOD_KEYS), P.interval_of(said, q["value"]))
    return F.struct(
        q["key"].alias("key"), S.dimension_of(q["key"]).alias("dim"), q["value"].alias("value"), q["provenance"].alias("provenance"), S.plain_words(q["value"]).alias("plain"), period["start"].alias("start"), period["end"].alias("end"),
        said["day"].alias("day"), said["years"].alias("years"), S.key_matches(q["key"], S.DISCRIMINATING).alias("known"), (~S.key_matches(q["key"], S.NON_SEPARATING)).alias("separates"),
    )


def known_conditions(bag: Column, inherited: Column | None = None) -> Column:
    """Known conditions sorted by key: blank and absent ones dropped; of keys that become one the last counts; inherited ones fill gaps only."""
    own = F.transform(F.map_entries(F.coalesce(bag, F.create_map().cast(BAG))), lambda e: F.struct(S.canonical_predicate(e["key"]).alias("key"), F.trim(e["value"]["value"]).alias("value"), F.coalesce(e["value"]["provenance"], F.lit("stated")).alias("provenance")))
    known = F.filter(own, lambda q: (q["key"] != "") & (q["value"] != "") & (q["provenance"] != "absent"))
    last = let(known, lambda k: F.filter(k, lambda q, i: ~F.exists(F.slice(k, i + 2, F.size(k)), lambda r: r["key"] == q["key"])))
    if inherited is not None:
        more = F.transform(F.map_entries(inherited), lambda e: F.struct(S.canonical_predicate(e["key"]).alias("key"), F.trim(e["value"]).alias("value"), F.lit("inherited").alias("provenance")))
        last = let(last, lambda k: F.concat(k, F.filter(more, lambda q: (q["key"] != "") & (q["value"] != "") & ~F.exists(k, lambda r: r["key"] == q["key"]))))
    return F.array_sort(last)


def with_qualifiers(facts: DataFrame, bag: Column, inherited: Column | None = None, fiscal_end_month: Column | None = None) -> DataFrame:
    """The facts with `qualifiers`: known conditions and what their values say about time; every different value of a batch is read once."""
    kept = facts.withColumn("_kept", known_conditions(bag, inherited))
    said = kept.withColumn("_said", P.labels(F.transform("_kept", lambda q: q["value"]), fiscal_end_month))
    return said.withColumn("qualifiers", F.transform("_kept", lambda q, i: qualifier(q, F.get(F.col("_said"), i)))).drop("_kept", "_said")


def quantity_of(value: Column, claim: Column, quote: Column | None = None, default_scale: Column | None = None, default_unit: Column | None = None) -> Column:
    """A figure with the scale that was stated, or else recovered from the quote or the claim, or else given by context."""
    recovered = N.scale_after_figure(value["raw"], claim)
    if quote is not None:
        recovered = F.coalesce(N.scale_after_figure(value["raw"], quote), recovered)
    nothing = F.lit(None).cast("string")
    default_scale = default_scale if default_scale is not None else nothing
    default_unit = default_unit if default_unit is not None else nothing
    stated = F.when(N.is_scale_word(value["scale"]), value["scale"]).when(N.is_scale_word(value["unit"]), value["unit"])
    settled = let(F.struct(stated.alias("s"), recovered.alias("r")), lambda x: F.coalesce(F.when(N.truncates(x["s"], x["r"]), x["r"]).otherwise(x["s"]), x["r"], default_scale))
    unit = F.when(value["unit"].isNotNull() & ~N.is_scale_word(value["unit"]), value["unit"]).otherwise(default_unit)
    return N.parse_quantity(value["raw"], settled, unit)


def once(facts: DataFrame) -> DataFrame:
    """Repeated deliveries of a fact are one: the first by created_at; rows without fact_id are dropped."""
    columns = [c for c in facts.columns if c != "fact_id"]
    first = F.min_by(F.struct(*columns), F.coalesce(F.col("created_at"), F.timestamp_seconds(F.lit(32503680000)))) if "created_at" in columns else F.first(F.struct(*columns))
    return facts.where(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(first.alias("_f")).select("fact_id", "_f.*")


def comparable(facts: DataFrame) -> DataFrame:
    """One comparable row per fact of the facts table: identity, measure, value, quantity, qualifiers and evidence.

    The measure is predicate_canonical, or the predicate made canonical; a leading consolidated or standalone becomes a condition.
    """
    rows = once(spread(facts.select("fact_id", "doc_id", "claim_text", "subject_surface", "subject_key", "predicate", "predicate_canonical", "value_json", "value_kind", "qualifiers_json", "evidence_json", "align_status", "created_at"), "fact_id"))
    read = rows.withColumns({"value": F.from_json("value_json", VALUE), "evidence": F.from_json("evidence_json", EVIDENCE), "_m": S.split_consolidation(F.coalesce("predicate_canonical", "predicate"))})
    bag = F.from_json("qualifiers_json", BAG)
    basis = F.when(F.col("_m.basis").isNotNull(), F.map_from_arrays(F.array(F.lit("consolidation")), F.array(F.col("_m.basis"))))
    return with_qualifiers(read, bag, F.coalesce(basis, F.create_map().cast("map<string,string>"))).select(
        "fact_id", "doc_id", "claim_text", "subject_surface", "subject_key", "predicate", F.col("_m.measure").alias("measure"), F.coalesce(F.col("value_kind"), F.col("value.kind")).alias("value_kind"), F.col("value.raw").alias("value_raw"),
        F.when(F.coalesce(F.col("value_kind"), F.col("value.kind")) == "quantity", quantity_of(F.col("value"), F.col("claim_text"))).alias("quantity"),
        "qualifiers",
        S.subject_id(F.col("subject_surface"), F.col("subject_key")).alias("subject_id"),
        F.col("evidence.char_start").alias("char_start"), F.col("evidence.char_end").alias("char_end"), "align_status",
    )


def keep_best(facts: DataFrame, known: Column, order: list[Column]) -> DataFrame:
    """Of rows with one fact_id the one with the most known conditions, then the first by `order`."""
    w = Window.partitionBy("fact_id").orderBy(known.desc(), *order)
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def clear_mode(rows: DataFrame, by: str, value: str, least: int = 1) -> DataFrame:
    """(by, value, n): the most frequent non-null value of each group, unless it ties or occurs less than `least` times."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(by).agg(F.max("n").alias("n"))
    top = counted.join(best, [by, "n"])
    return top.groupBy(by).agg(F.min(value).alias(value), F.min("n").alias("n"), F.count("*").alias("_ties")).where((F.col("_ties") == 1) & (F.col("n") >= least)).drop("_ties")


def fiscal_year_ends(documents: DataFrame) -> DataFrame:
    """(doc_id, month, n): the month that most of a document's `year ended <date>` statements name, where that is clear."""
    ends = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"(?i)\byears?\s+end(?:ed|ing)\b(?=(.{8,34}))"), F.lit(1))
    # the date must stand right there
    dated = P.as_of_date(F.concat(F.lit("as on "), F.regexp_replace("m", r"(?i)^\s*on\b", "")))
    said = documents.select("doc_id", F.explode(ends).alias("m")).select("doc_id", F.month(dated).alias("month"))
    return clear_mode(said, "doc_id", "month")


def resolve_anaphora(facts: DataFrame) -> DataFrame:
    """The facts with surface_resolved and resolved: stand-ins like `the Company` become their document's clearly dominant subject.

    Subjects that only repeat the measure don't vote; the dominant name occurs at least twice and is shown in its first spelling.
    """
    name = S.normalize_surface(F.col("subject_surface"))
    votes = facts.where((name != "") & ~name.isin(*S.ANAPHORS) & ~S.subject_names_the_measurement(F.col("subject_surface"), F.col("predicate"))).select("doc_id", name.alias("name"), "subject_surface")
    shown = votes.groupBy("doc_id", "name").agg(F.min("subject_surface").alias("shown"))
    dominant = clear_mode(votes, "doc_id", "name", least=2).join(shown, ["doc_id", "name"]).select("doc_id", "shown")
    is_stand_in = name.isin(*S.ANAPHORS)
    joined = facts.join(dominant, "doc_id", "left")
    hit = is_stand_in & F.col("shown").isNotNull()
    return joined.withColumn("surface_resolved", F.when(hit, F.col("shown")).otherwise(F.col("subject_surface"))).withColumn("resolved", F.coalesce(hit, F.lit(False))).drop("shown")
