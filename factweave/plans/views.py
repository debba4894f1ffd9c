"""Queries of the query surface, of names, units and dates, of text structure and of the decision table's rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import strings as S
from ..operators import align, blocking, decide, extract, registry, textstruct
from ..operators import facts as FA
from ..session import cut, spread, table
from ..sources import ledger, surface
from . import core
from .core_sql import _CANONICAL, _NAME, _ONCE, _RELATIONS, _list


def facts_page(s: SparkSession, d: str) -> DataFrame:
    page = surface.facts_page(table(s, d, "facts"), predicate="revenue_from_haulage", q="haul", limit=200, offset=50)
    return page.select("fact_id", "doc_id", "page", "total")


def quarantined_page(s: SparkSession, d: str) -> DataFrame:
    return surface.facts_page(table(s, d, "facts"), quarantined=True, limit=2000).select("fact_id", "doc_id", "total")


def relations_page(s: SparkSession, d: str) -> DataFrame:
    rel = table(s, d, "relations").where("relation_id is not null").groupBy("relation_id").agg(*[F.min(c).alias(c) for c in ("fact_a", "fact_b", "verdict", "cross_document")])
    page = surface.relations_page(rel, table(s, d, "facts"), verdict="contradicts", cross_document=True, limit=300, offset=20)
    return page.select("relation_id", "fact_a", "fact_b", "doc_a", "doc_b", F.md5("claim_a").alias("claim_a"), F.md5("claim_b").alias("claim_b"), "total")


def evidence(s: SparkSession, d: str) -> DataFrame:
    out = surface.evidence(table(s, d, "facts"), table(s, d, "documents"))
    return out.select("fact_id", "located", F.md5("context").alias("context"), "context_start", "highlight_start", "highlight_end")


def verify_facts(s: SparkSession, d: str) -> DataFrame:
    """Whether the facts' claims are the text at their offsets."""
    one = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "claim_text", "evidence_json", "created_at"))
    return surface.verify(one, table(s, d, "documents"), F.col("claim_text")).select("fact_id", "verified", "reason", F.md5("text_at_offsets").alias("text_at_offsets"))


def schema_timeline(s: SparkSession, d: str) -> DataFrame:
    return surface.schema_timeline(table(s, d, "schema_events")).select("event_id", "event_type", "subject")


def schema_entries(s: SparkSession, d: str) -> DataFrame:
    return surface.schema_entries(table(s, d, "predicate_registry"))


def ledger_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of the ledger; every distinct pair of facts counts once."""
    return surface.totals(table(s, d, "facts"), table(s, d, "documents"), core._relations(s, d), table(s, d, "predicate_registry"))


def extraction_totals(s: SparkSession, d: str) -> DataFrame:
    """Counters as an ingest stores them: facts by alignment, repeated deliveries as collapsed duplicates, in each document's context."""
    f = table(s, d, "facts")
    n = f.groupBy("doc_id").agg(F.count("*").alias("extracted"), F.countDistinct("fact_id").alias("kept"), F.count_if(F.col("align_status") == "unlocated").alias("quarantined"))
    context = F.to_json(F.struct(F.struct("extracted", (F.col("extracted") - F.col("quarantined")).alias("grounded"), "quarantined", (F.col("extracted") - F.col("kept")).alias("duplicates_collapsed")).alias("extraction")))
    return surface.extraction_totals(table(s, d, "documents").select("doc_id").join(n, "doc_id", "left").withColumn("doc_context", context))


def shaped_facts(s: SparkSession, d: str) -> DataFrame:
    f = surface.shaped(FA.once(table(s, d, "facts")))
    return f.select("fact_id", F.col("value.raw").alias("raw"), F.size("qualifiers").alias("n_qualifiers"), F.col("evidence.char_start").alias("char_start"), F.size("flags").alias("n_flags"), "value_normalized", "confidence")


def quarantine_ids(s: SparkSession, d: str) -> DataFrame:
    f = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "page", "claim_text", "align_status", "created_at")).where("align_status = 'unlocated'")
    return f.select("fact_id", S.quarantine_id(F.col("doc_id"), F.col("page"), F.coalesce("claim_text", F.lit(""))).alias("quarantine_id"))


def fact_names(s: SparkSession, d: str) -> DataFrame:
    f = FA.once(table(s, d, "facts").select("fact_id", "subject_surface", "subject_key", "predicate", "claim_text", "created_at"))
    c = F.col
    return f.select("fact_id", S.subject_id(c("subject_surface"), c("subject_key")).alias("subject_id"), S.comparison_key(c("subject_surface"), c("subject_key"), c("predicate")).alias("comparison_key"), F.md5(S.embed_text(c("subject_surface"), c("predicate"), c("claim_text"))).alias("embed_text"))


def unit_words(s: SparkSession, d: str) -> DataFrame:
    """What the facts' unit and scale fields say: a magnitude, a percentage, a currency."""
    v = F.from_json("value_json", FA.VALUE)
    words = table(s, d, "facts").select(F.explode(F.array(v["unit"], v["scale"])).alias("word")).where("word is not null").distinct()
    w = F.col("word")
    return words.select("word", N.scale_key(w).alias("scale_key"), N.is_scale_word(w).alias("is_scale"), N.scale_factor(w).alias("factor"), N.is_percent_unit(w).alias("is_percent"))


def truncated_scales(s: SparkSession, d: str) -> DataFrame:
    """Which magnitudes are a cut-off part of another one."""
    scales = s.createDataFrame([(k,) for k in N.SCALES], "a string")
    ends = scales.withColumn("last", F.element_at(F.split("a", " "), -1))
    both = scales.select(F.col("a").alias("b"), F.explode(F.split("a", " ")).alias("last"))
    return ends.join(both, "last").select("a", "b", N.truncates(F.col("a"), F.col("b")).alias("truncates")).distinct()


def years_mentioned(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "facts").select(F.from_json("qualifiers_json", FA.BAG)["period"]["value"].alias("label")).where("label is not null").distinct()
    return labels.select("label", F.array_join(P.mentioned_years(F.col("label")).cast("array<string>"), ",").alias("years"))


def compatible_years(s: SparkSession, d: str) -> DataFrame:
    """Labels of one part of a year, e.g. Q1, by whether the years that they name don't contradict each other."""
    labels = table(s, d, "facts").select(F.from_json("qualifiers_json", FA.BAG)["period"]["value"].alias("t")).where("t is not null").distinct().withColumn("part", F.split("t", " ")[0])
    a, b = labels.withColumnRenamed("t", "a"), labels.withColumnRenamed("t", "b")
    return a.join(b, "part").where("a < b").select("a", "b", P.years_compatible(F.col("a"), F.col("b")).alias("compatible"))


def value_dates(s: SparkSession, d: str) -> DataFrame:
    """Facts of kind date as dates, alone and after `as at`, and as intervals without length."""
    raw = table(s, d, "facts").where("value_kind = 'date'").select(F.from_json("value_json", FA.VALUE)["raw"].alias("raw")).where("raw is not null").distinct()
    r = F.col("raw")
    return raw.select("raw", P.bare_date(r).alias("day"), P.parse_date(F.concat(F.lit("effective from "), r)).alias("found"), P.bare_date(F.concat(F.lit("effective from "), r)).alias("not_bare"), P.as_of_date(F.concat(F.lit("as at "), r)).alias("as_of"), P.as_interval(r)["granularity"].alias("granularity"))


def order_dates(s: SparkSession, d: str) -> DataFrame:
    """Order dates written in three ways and with fiscal years that end in September, read back."""
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    month, year = F.date_format("day", "MMMM"), F.year("day").cast("string")
    first = F.concat(month, F.lit(" "), F.dayofmonth("day").cast("string"), F.lit(", "), year)
    behind = F.concat(F.dayofmonth("day").cast("string"), F.lit("th of "), month, F.lit(" "), year)
    period = P.parse_period(F.concat(F.lit("FY"), year), F.lit(9))
    half = P.parse_period(F.concat(F.lit("second half of FY"), year), F.lit(9))
    ended = P.parse_period(F.concat(F.lit("three months ended "), first))
    one = P.parse_period(F.concat(month, F.lit("-"), year))
    return days.select("day", P.bare_date(first).alias("month_first"), P.bare_date(behind).alias("day_first"), P.bare_date(F.date_format("day", "dd/MM/yyyy")).alias("numeric"), period["start"].alias("fy_start"), period["end"].alias("fy_end"), half["start"].alias("half_start"), ended["start"].alias("quarter_start"), one["end"].alias("month_end"))


def narrowed_years(s: SparkSession, d: str) -> DataFrame:
    """Parts and edges of the order years."""
    years = table(s, d, "orders").select(F.year("o_orderdate").cast("string").alias("y")).distinct()
    of = lambda text: P.parse_period(F.concat(F.lit(text), F.col("y")))
    labels = {"first_eight": "first eight months of CY", "last_three": "last three months of CY", "first_quarter": "first quarter of CY", "at_end": "end of CY", "at_start": "beginning of CY", "half": "H1 CY", "more": "revised upward since CY"}
    return years.select("y", *[F.concat_ws(" ", of(t)["start"].cast("string"), of(t)["end"].cast("string"), of(t)["granularity"]).alias(k) for k, t in labels.items()])


def same_entities(s: SparkSession, d: str) -> DataFrame:
    """Names that begin with the same word, by whether they are one entity."""
    names = table(s, d, "facts").select(S.normalize_surface(F.col("subject_surface")).alias("n")).where("n <> ''").distinct().withColumn("w", F.split("n", " ")[0])
    a, b = names.withColumnRenamed("n", "a"), names.withColumnRenamed("n", "b")
    return a.join(b, "w").where("a < b").select("a", "b", S.same_entity(F.col("a"), F.col("b")).alias("same"))


def resolved_measures(s: SparkSession, d: str) -> DataFrame:
    """Facts whose measure the registry's aliases give another name."""
    aliases = table(s, d, "predicate_registry").select("canonical", F.explode(F.from_json(F.coalesce("aliases_json", F.lit("[]")), "array<string>")).alias("alias"))
    f = FA.once(table(s, d, "facts").select("fact_id", "predicate", "created_at")).select("fact_id", S.canonical_predicate(F.col("predicate")).alias("said")).withColumn("measure", F.col("said"))
    return blocking.with_aliases(f, aliases).where("measure <> said").select("fact_id", "said", "measure")


def request_keys(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("chunk_id", "doc_id", "chunk_no").distinct()
    return c.select("chunk_id", "doc_id", "chunk_no", extract.request_key(F.to_json(F.struct(F.col("doc_id").alias("doc"), F.col("chunk_no").alias("chunk"), F.lit("a").alias("b")))).alias("key"))


def chunk_batches(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").where("chunk_no is not null").groupBy("doc_id", "chunk_no").agg(F.min("chunk_id").alias("chunk_id"))
    return textstruct.batches(c).select("doc_id", "chunk_no", "chunk_id", "batch_no")


def chunk_contexts(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.md5(textstruct.context_text(F.col("heading_path"), F.col("page_frame"), F.col("text"))).alias("context"))


def inherited(s: SparkSession, d: str) -> DataFrame:
    """The basis and the section that the places of chunks give to their facts."""
    c = table(s, d, "chunks").select("chunk_id", "heading_path", "page_frame").dropDuplicates(["chunk_id"])
    q = textstruct.inherited_qualifiers(F.coalesce("heading_path", F.array().cast("array<string>")), F.coalesce("page_frame", F.array().cast("array<string>")))
    return c.select("chunk_id", F.try_element_at(q, F.lit("consolidation")).alias("basis"), F.try_element_at(q, F.lit("segment")).alias("segment"))


def line_kinds(s: SparkSession, d: str) -> DataFrame:
    """Lines shaped like headings, and bulleted ones, in each document."""
    t = textstruct.bullet_starts(textstruct.lines(table(s, d, "documents")).select("doc_id", "line_no", "text"))
    return t.groupBy("doc_id").agg(F.count_if(S.heading_shaped(F.col("text"))).alias("shaped"), F.count_if("bulleted").alias("bulleted"))



def chunk_cover(s: SparkSession, d: str) -> DataFrame:
    """Own chunks of each document: where they begin and end, and whether each is its document's text, none leaves a gap, and none with several lines is too long."""
    docs = table(s, d, "documents").select("doc_id", "text")
    c = textstruct.chunk_texts(docs).join(docs.withColumnRenamed("text", "whole"), "doc_id")
    size = F.col("char_end") - F.col("char_start")
    from pyspark.sql import Window

    before = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    gap = F.regexp_replace(F.substring("whole", (before + 1).cast("int"), F.greatest(F.col("char_start") - before, F.lit(0)).cast("int")), r"(?U)\s", "")
    own = F.substring("whole", (F.col("char_start") + 1).cast("int"), size.cast("int")) == F.col("text")
    tail = F.length(F.element_at(F.split("text", "\n"), -1))
    rows = c.select("doc_id", "char_start", "char_end", (own & (F.coalesce(F.length(gap), F.lit(0)) == 0) & (size - tail <= textstruct.CHUNK_CHARS)).alias("ok"))
    return rows.groupBy("doc_id").agg(F.min("char_start").alias("begins"), F.max("char_end").alias("ends"), F.min("ok").alias("ok"))


def claims_in_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunk pages that facts lie on: an as-of lookup of the page of each place, where chunks that don't overlap are the pages."""
    c = table(s, d, "chunks").where("char_start is not null").groupBy("doc_id").agg(F.min("char_start").alias("start"), F.max("char_end").alias("end")).withColumn("page", F.lit(1))
    e = F.from_json("evidence_json", FA.EVIDENCE)
    f = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "evidence_json", "created_at")).select("fact_id", "doc_id", e["char_start"].alias("offset")).where("offset >= 0")
    return textstruct.page_of(f, c.select("doc_id", "page", "start", "end")).select("fact_id", "page")


def aligned_evidence(s: SparkSession, d: str) -> DataFrame:
    """The texts at the facts' places, sought again near them: the first place there that has them."""
    e = F.from_json("evidence_json", FA.EVIDENCE)
    f = FA.once(table(s, d, "facts").select("fact_id", "doc_id", "evidence_json", "created_at")).select("fact_id", "doc_id", e["char_start"].alias("a"), e["char_end"].alias("b")).where("a >= 0")
    docs = table(s, d, "documents").select("doc_id", "text")
    q = f.join(docs, "doc_id").select(F.col("fact_id").alias("quote_id"), "doc_id", F.substring(F.col("text"), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("quote"), F.col("a").alias("near_start"), F.col("b").alias("near_end"))
    return align.align(q, docs).select(F.col("quote_id").alias("fact_id"), "status", "start")


def dropped_relations(s: SparkSession, d: str) -> DataFrame:
    """Stored pairs that a run over the located facts no longer has, which a replacing sink removes."""
    rel = core._relations(s, d)
    located = ledger.loadable(FA.once(table(s, d, "facts").select("fact_id", "align_status", "created_at")))
    return ledger.stale(rel, ledger.without_dangling(rel, located)).select("fact_a", "fact_b")


def missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Facts without a vector of 48 numbers; widths stand for models."""
    f = table(s, d, "facts")
    have = f.where("embedding is not null").select("fact_id", F.size("embedding").cast("string").alias("embedding_model"))
    return ledger.missing_embeddings(f.select("fact_id").distinct(), have, "48")


def facts_key_pairs(s: SparkSession, d: str) -> DataFrame:
    """The pairs that exact keys propose over facts, folded by classes of one name, hard key and measure."""
    return blocking.key_classes(_named(s, d))[1]


def _named(s: SparkSession, d: str) -> DataFrame:
    f = ledger.loadable(table(s, d, "facts"))
    measure = S.split_consolidation(F.coalesce("predicate_canonical", "predicate"))["measure"]
    one = FA.once(f.select("fact_id", "subject_surface", "subject_key", measure.alias("measure"), "created_at"))
    return blocking.with_aliases(one, registry.aliases(table(s, d, "predicate_registry")))


def facts_value_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of facts whose stored figures are of one kind and sign and at most a step apart."""
    f = FA.once(table(s, d, "facts").select("fact_id", "value_normalized", "value_json", "created_at"))
    q = F.struct(F.col("value_normalized").alias("normalized"), N.is_percent_unit(F.from_json("value_json", FA.VALUE)["unit"]).alias("is_percent"))
    return blocking.magnitude_pairs(f.select("fact_id", q.alias("quantity")))


def facts_neighbours(s: SparkSession, d: str, width: int = 48) -> DataFrame:
    """The 10 nearest facts of one width of vectors to every fact of it whose id's first four digits are divisible by 20."""
    f = FA.once(table(s, d, "facts").select("fact_id", "embedding", "created_at")).where(F.col("embedding").isNotNull() & (F.size("embedding") == width))
    asked = f.where(F.conv(F.substring("fact_id", 3, 4), 16, 10).cast("int") % 20 == 0)
    return blocking.neighbours(f, asked, "fact_id", "embedding").select("query", "neighbour", "rank")


def _orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as facts: whole figures, percentages, single-digit lakhs; periods that can be read or can't, under two keys; some have a segment, some a hard key."""
    t = spread(table(s, d, "orders"), "o_custkey")
    v = F.round("o_totalprice").cast("long")
    year = F.year("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat((v % 100).cast("string"), F.lit("%"))).when(F.col("o_orderkey") % 7 == 0, F.concat(F.greatest(F.round(v / 100000).cast("long"), F.lit(1)).cast("string"), F.lit(" lakh"))).otherwise(v.cast("string"))
    key = F.when(F.col("o_orderkey") % 5 == 0, F.lit("as_at")).otherwise(F.lit("period"))
    label = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("till "), year)).otherwise(F.concat(F.lit("CY"), year))
    bag = F.map_filter(F.map_from_arrays(F.array(key, F.lit("segment")), F.array(label, F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1)))), lambda _, x: x.isNotNull())
    whole = F.transform_values(bag, lambda _, x: F.struct(x.alias("value"), F.lit("stated").alias("provenance")))
    hard = F.when(F.col("o_orderkey") % 11 == 0, F.lit("K1")).when(F.col("o_orderkey") % 13 == 0, F.lit("K2"))
    name = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    return FA.with_qualifiers(t, whole).select(
        F.format_string("%010d", "o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("doc_id"), name.alias("subject_surface"), hard.alias("subject_key"), F.coalesce(hard, name).alias("subject_id"), F.lit("order_total").alias("measure"),
        F.lit("quantity").alias("value_kind"), raw.alias("value_raw"), N.parse_quantity(raw).alias("quantity"), "qualifiers",
    )


def order_rules(s: SparkSession, d: str) -> DataFrame:
    """The decision table over pairs of a customer's orders: nine of its ten rules."""
    facts = cut(_orders(s, d))
    pairs = facts.select("fact_id", F.col("subject_surface").alias("n"))
    met = pairs.withColumnRenamed("fact_id", "fact_a").join(pairs.withColumnRenamed("fact_id", "fact_b"), "n").where("fact_a < fact_b").select("fact_a", "fact_b")
    return decide.relations(met, facts, with_partitions=False).select("fact_a", "fact_b", "verdict", "rule_fired", "qualifier_key", "needs_llm")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"
_NONBLANK = r"regexp_matches(t, '[^\t-\r \x{85}\p{Z}]')"
_DAY = "CAST(regexp_extract(raw, ' (\\d+),', 1) AS INT)"
_WORDS = r"list_filter(string_split(regexp_replace(trim({0}), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"

_SOLE = r"CASE WHEN regexp_matches({0}, '\bconsolidated\b') AND NOT regexp_matches({0}, '\bstandalone\b') THEN 'consolidated' WHEN regexp_matches({0}, '\bstandalone\b') AND NOT regexp_matches({0}, '\bconsolidated\b') THEN 'standalone' END"

_MEASURE = _CANONICAL.format("coalesce(predicate_canonical, predicate)")
_NAMED = f"""
    once AS (SELECT * FROM facts WHERE fact_id IS NOT NULL AND coalesce(align_status, '') <> 'unlocated' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at NULLS LAST) = 1),
    al AS (SELECT alias, min(canonical) AS canonical FROM (SELECT canonical, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) AS alias FROM predicate_registry UNION ALL SELECT canonical, canonical FROM predicate_registry) GROUP BY 1),
    m AS (SELECT fact_id, {_NAME.format("subject_surface")} AS name, nullif(subject_key, '') AS hard, CASE WHEN regexp_matches({_MEASURE}, '^(consolidated|standalone)_.') THEN regexp_replace({_MEASURE}, '^(consolidated|standalone)_', '') ELSE {_MEASURE} END AS said FROM once),
    f AS (SELECT fact_id, name, hard, coalesce(canonical, said) AS measure FROM m LEFT JOIN al ON alias = said WHERE coalesce(canonical, said) <> '' AND (name <> '' OR hard IS NOT NULL)),
    cl AS (SELECT measure, name, hard, min(fact_id) AS class, count(*) AS n FROM f GROUP BY 1, 2, 3)"""

SQL = {
    "facts_key_classes": f"WITH {_NAMED} SELECT fact_id, class AS name_class FROM f JOIN cl ON cl.measure = f.measure AND cl.name = f.name AND cl.hard IS NOT DISTINCT FROM f.hard",
    "facts_key_pairs": f"""
        WITH {_NAMED}, i AS (SELECT class, n, measure, name AS ident FROM cl WHERE name <> '' UNION SELECT class, n, measure, hard FROM cl WHERE hard IS NOT NULL
          UNION SELECT class, n, measure, left(name, length(name) - length(form) - 1) FROM cl, (SELECT unnest([{_list(S.LEGAL_FORMS)}]) AS form) WHERE ends_with(name, ' ' || form) AND length(name) > length(form) + 1),
        p AS (SELECT DISTINCT x.class AS class_a, y.class AS class_b, x.n * y.n AS n FROM i x JOIN i y ON x.ident = y.ident AND x.measure = y.measure AND x.class < y.class)
        SELECT * FROM p UNION ALL SELECT class, class, n * (n - 1) // 2 FROM cl WHERE n > 1""",
    "facts_value_pairs": f"""
        WITH {_ONCE}, q AS (SELECT fact_id, value_normalized AS v, trim(regexp_replace(replace(lower(coalesce(value_json->>'unit', '')), '-', ' '), '\\s+', ' ', 'g')) IN ({_list(N.PERCENT_WORDS)}) AS pct FROM once WHERE value_normalized IS NOT NULL),
        b AS (SELECT fact_id, CASE WHEN pct THEN 'pct' ELSE 'abs' END || CASE WHEN v = 0 THEN ':zero' WHEN v < 0 THEN ':-' ELSE ':+' END AS axis, CASE WHEN v = 0 THEN 0 ELSE CAST(floor(log10(abs(v)) / 0.002) AS BIGINT) END AS band FROM q)
        SELECT x.fact_id AS fact_a, y.fact_id AS fact_b FROM b x JOIN b y ON x.axis = y.axis AND y.band BETWEEN x.band - 1 AND x.band + 1 AND x.fact_id < y.fact_id""",
    "facts_neighbours": f"""
        WITH {_ONCE}, v AS (SELECT fact_id, CAST(embedding AS DOUBLE[]) AS e, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 AS long FROM once WHERE len(embedding) = 48),
        q AS (SELECT * FROM v WHERE CAST('0x' || substr(fact_id, 3, 4) AS INT) % 20 = 0),
        s AS (SELECT q.fact_id AS query, v.fact_id AS neighbour, CASE WHEN q.long AND v.long THEN round(list_cosine_similarity(q.e, v.e), 9) ELSE 0.0 END AS sim FROM q JOIN v ON v.fact_id <> q.fact_id)
        SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS INT) AS rank FROM s WHERE sim >= 0 QUALIFY rank <= 10""",
    "facts_page": f"""
        WITH {_ONCE}, f AS (SELECT * FROM once WHERE coalesce(align_status, '') <> 'unlocated' AND predicate_canonical = 'revenue_from_haulage'
          AND (coalesce(claim_text ILIKE '%haul%', false) OR coalesce(subject_surface ILIKE '%haul%', false) OR coalesce(predicate ILIKE '%haul%', false)))
        SELECT fact_id, doc_id, page, (SELECT count(*) FROM f) AS total FROM f ORDER BY doc_id, page NULLS FIRST, fact_id LIMIT 200 OFFSET 50""",
    "quarantined_page": f"WITH {_ONCE}, f AS (SELECT * FROM once WHERE align_status = 'unlocated') SELECT fact_id, doc_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY doc_id, page NULLS FIRST, fact_id LIMIT 2000",
    "relations_page": f"""
        WITH {_ONCE}, r AS (SELECT relation_id, min(fact_a) AS fact_a, min(fact_b) AS fact_b, min(verdict) AS verdict, min(cross_document) AS x FROM relations WHERE relation_id IS NOT NULL GROUP BY 1),
        p AS (SELECT * FROM r WHERE verdict = 'contradicts' AND x = 1), q AS (SELECT *, (SELECT count(*) FROM p) AS total FROM p ORDER BY relation_id LIMIT 300 OFFSET 20)
        SELECT relation_id, fact_a, fact_b, a.doc_id AS doc_a, b.doc_id AS doc_b, md5(a.claim_text) AS claim_a, md5(b.claim_text) AS claim_b, total FROM q LEFT JOIN once a ON a.fact_id = fact_a LEFT JOIN once b ON b.fact_id = fact_b""",
    "evidence": f"""
        WITH {_ONCE}, e AS (SELECT fact_id, text, CAST(evidence_json->>'char_start' AS BIGINT) AS a, CAST(evidence_json->>'char_end' AS BIGINT) AS b FROM once LEFT JOIN documents d ON d.doc_id = once.doc_id),
        g AS (SELECT *, coalesce(a >= 0 AND text IS NOT NULL, false) AS located, greatest(0, a - 600) AS s, least(length(text), b + 600) AS t FROM e)
        SELECT fact_id, located, CASE WHEN located THEN md5(substr(text, s + 1, t - s)) END AS context, CASE WHEN located THEN s END AS context_start, CASE WHEN located THEN a - s END AS highlight_start, CASE WHEN located THEN b - s END AS highlight_end FROM g""",
    "verify_facts": f"""
        WITH {_ONCE}, e AS (SELECT fact_id, claim_text, text, CAST(evidence_json->>'char_start' AS BIGINT) AS a, CAST(evidence_json->>'char_end' AS BIGINT) AS b FROM once LEFT JOIN documents d ON d.doc_id = once.doc_id),
        g AS (SELECT *, coalesce(a < 0, true) AS u, CASE WHEN coalesce(a >= 0, false) THEN substr(text, a + 1, b - a) END AS x FROM e)
        SELECT fact_id, coalesce(x = claim_text, false) AS verified, CASE WHEN u THEN 'unlocated' WHEN NOT coalesce(x = claim_text, false) THEN 'text differs' END AS reason, md5(x) AS text_at_offsets FROM g""",
    "schema_timeline": "SELECT event_id, event_type, subject FROM schema_events ORDER BY event_id DESC LIMIT 300",
    "schema_entries": "SELECT canonical, CAST(coalesce(json_array_length(aliases_json), 0) AS INT) AS n_aliases, seen_count, first_seen_doc FROM predicate_registry",
    "ledger_totals": f"""
        WITH {_ONCE}, {_RELATIONS}, n AS (SELECT count(*) FILTER (coalesce(align_status, '') <> 'unlocated') AS f, count(*) FILTER (align_status = 'unlocated') AS q FROM once)
        SELECT (SELECT count(*) FROM documents) AS documents, f AS facts, q AS quarantined, (SELECT count(*) FROM rel WHERE verdict <> 'unrelated') AS relations, (SELECT count(*) FROM predicate_registry) AS predicates,
               round(CASE WHEN f + q = 0 THEN 0.0 ELSE q / (f + q) END, 4) AS quarantine_rate FROM n""",
    "extraction_totals": """
        WITH n AS (SELECT f.doc_id, count(*) AS e, count(DISTINCT fact_id) AS k, count(*) FILTER (align_status = 'unlocated') AS q FROM facts f JOIN documents d ON d.doc_id = f.doc_id GROUP BY 1)
        SELECT CAST(sum(e) AS BIGINT) AS extracted, CAST(sum(e - q) AS BIGINT) AS grounded, CAST(sum(q) AS BIGINT) AS quarantined, CAST(sum(e - k) AS BIGINT) AS duplicates_collapsed, round(sum(q) / sum(e), 4) AS quarantine_rate FROM n""",
    "shaped_facts": f"""
        WITH {_ONCE} SELECT fact_id, value_json->>'raw' AS raw, CASE WHEN qualifiers_json IS NULL THEN NULL ELSE CAST(len(json_keys(qualifiers_json)) AS INT) END AS n_qualifiers, CAST(evidence_json->>'char_start' AS BIGINT) AS char_start,
          CAST(json_array_length(flags_json) AS INT) AS n_flags, value_normalized, coalesce(confidence, 1.0) AS confidence FROM once""",
    "quarantine_ids": f"WITH {_ONCE} SELECT fact_id, 'q_' || concat_ws('_', doc_id, page, left(sha1(coalesce(claim_text, '')), 10)) AS quarantine_id FROM once WHERE align_status = 'unlocated'",
    "fact_names": f"""
        WITH {_ONCE}, n AS (SELECT *, coalesce(nullif(subject_key, ''), {_NAME.format("subject_surface")}) AS sid FROM once)
        SELECT fact_id, sid AS subject_id, concat_ws('|', sid, predicate) AS comparison_key, md5(coalesce(nullif(trim(claim_text, ' '), ''), concat_ws(' ', subject_surface, replace(predicate, '_', ' ')))) AS embed_text FROM n""",
    "unit_words": f"""
        WITH w AS (SELECT DISTINCT unnest([value_json->>'unit', value_json->>'scale']) AS word FROM facts), k AS (SELECT word, trim(regexp_replace(regexp_replace(lower(word), '\\.+$', ''), '\\s+', ' ', 'g')) AS k,
             trim(regexp_replace(replace(lower(word), '-', ' '), '\\s+', ' ', 'g')) AS p FROM w WHERE word IS NOT NULL)
        SELECT word, k AS scale_key, k IN ({_list(N.SCALES)}) AS is_scale, CASE {" ".join(f"WHEN k = '{x}' THEN CAST({v!r} AS DOUBLE)" for x, v in N.SCALES.items())} END AS factor, p IN ({_list(N.PERCENT_WORDS)}) AS is_percent FROM k""",
    "truncated_scales": f"""
        WITH s AS (SELECT unnest([{_list(N.SCALES)}]) AS a), p AS (SELECT x.a, y.a AS b FROM s x JOIN s y ON list_contains(string_split(y.a, ' '), string_split(x.a, ' ')[-1]))
        SELECT DISTINCT a, b, length(a) < length(b) AND contains(' ' || b || ' ', ' ' || a || ' ') AS truncates FROM p""",
    "years_mentioned": r"""
        WITH l AS (SELECT DISTINCT json_extract_string(qualifiers_json, '$.period.value') AS label FROM facts), y AS (
          SELECT label, list_concat(list_transform(regexp_extract_all(label, '\b((?:19|20)\d{2})\b', 1), lambda x: CAST(x AS INT)), list_transform(regexp_extract_all(label, '(?i)\bFY\s*(\d{2,4})\b', 1), lambda x: CASE WHEN length(x) = 4 THEN CAST(x AS INT) ELSE 2000 + CAST(x AS INT) END)) AS ys FROM l WHERE label IS NOT NULL)
        SELECT label, array_to_string(list_sort(list_distinct(ys)), ',') AS years FROM y""",
    "compatible_years": r"""
        WITH l AS (SELECT DISTINCT json_extract_string(qualifiers_json, '$.period.value') AS t FROM facts), y AS (SELECT t, string_split(t, ' ')[1] AS part,
          list_concat(list_transform(regexp_extract_all(t, '\b((?:19|20)\d{2})\b', 1), lambda x: CAST(x AS INT)), list_transform(regexp_extract_all(t, '(?i)\bFY\s*(\d{2,4})\b', 1), lambda x: CASE WHEN length(x) = 4 THEN CAST(x AS INT) ELSE 2000 + CAST(x AS INT) END)) AS ys FROM l WHERE t IS NOT NULL)
        SELECT x.t AS a, y.t AS b, list_has_all(x.ys, y.ys) OR list_has_all(y.ys, x.ys) AS compatible FROM y x JOIN y ON x.part = y.part AND x.t < y.t""",
    "value_dates": f"""
        WITH r AS (SELECT DISTINCT value_json->>'raw' AS raw FROM facts WHERE value_kind = 'date' AND value_json->>'raw' IS NOT NULL),
        p AS (SELECT raw, try_cast(try_strptime(raw, '%B %d, %Y') AS DATE) AS day FROM r)
        SELECT raw, day, day AS found, CAST(NULL AS DATE) AS not_bare, day AS as_of, CASE WHEN day IS NOT NULL THEN 'instant' END AS granularity FROM p""",
    "order_dates": """
        WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
        SELECT day, day AS month_first, day AS day_first, day AS numeric, make_date(year(day) - 1, 10, 1) AS fy_start, make_date(year(day), 9, 30) AS fy_end, make_date(year(day), 4, 1) AS half_start,
               CAST(date_trunc('month', day) - INTERVAL 2 MONTH AS DATE) AS quarter_start, last_day(day) AS month_end FROM o""",
    "narrowed_years": """
        SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS y, y || '-01-01 ' || y || '-08-31 months' AS first_eight, y || '-10-01 ' || y || '-12-31 quarter' AS last_three, y || '-01-01 ' || y || '-03-31 quarter' AS first_quarter,
               y || '-12-31 ' || y || '-12-31 instant' AS at_end, y || '-01-01 ' || y || '-01-01 instant' AS at_start, y || '-01-01 ' || y || '-06-30 months' AS half, '' AS more FROM orders""",
    "same_entities": f"""
        WITH n AS (SELECT DISTINCT {_NAME.format("subject_surface")} AS n FROM facts), w AS (SELECT n, string_split(n, ' ')[1] AS w FROM n WHERE n <> ''),
        p AS (SELECT x.n AS a, y.n AS b, CASE WHEN length(x.n) >= length(y.n) THEN x.n ELSE y.n END AS l, CASE WHEN length(x.n) >= length(y.n) THEN y.n ELSE x.n END AS s FROM w x JOIN w y ON x.w = y.w AND x.n < y.n)
        SELECT a, b, starts_with(l, s || ' ') AND substr(l, length(s) + 2) IN ({_list(S.LEGAL_FORMS)}) AS same FROM p""",
    "resolved_measures": f"""
        WITH {_ONCE}, a AS (SELECT alias, min(canonical) AS canonical FROM (SELECT canonical, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) AS alias FROM predicate_registry) GROUP BY 1),
        f AS (SELECT fact_id, {_CANONICAL.format("predicate")} AS said FROM once)
        SELECT fact_id, said, canonical AS measure FROM f JOIN a ON alias = said WHERE canonical <> said""",
    "request_keys": """SELECT DISTINCT chunk_id, doc_id, chunk_no, sha256('{"b":"a"' || CASE WHEN chunk_no IS NULL THEN '' ELSE ',"chunk":' || chunk_no END || CASE WHEN doc_id IS NULL THEN '' ELSE ',"doc":' || doc_id END || '}') AS key FROM chunks""",
    "chunk_batches": "SELECT doc_id, chunk_no, min(chunk_id) AS chunk_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1) // 16 AS INT) AS batch_no FROM chunks WHERE chunk_no IS NOT NULL GROUP BY doc_id, chunk_no",
    "chunk_contexts": """
        WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no) = 1)
        SELECT chunk_id, md5(concat_ws(chr(10), coalesce(array_to_string(page_frame, ' | '), ''), coalesce(array_to_string(heading_path, ' > '), ''), text)) AS context FROM c""",
    "chunk_headings": rf"""
        WITH {_LINES}, p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, regexp_replace(t, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g') AS z FROM l),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p WHERE {_NONBLANK}),
        h AS (SELECT * FROM n WHERE k > 1 AND length(z) <= 80 AND len(list_filter(regexp_split_to_array(z, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: w <> '')) <= 12 AND NOT regexp_matches(z, '[.,;:]$') AND NOT contains(t, '|') AND regexp_matches(t, '^\s*\p{{L}}')),
        c AS (SELECT DISTINCT chunk_id, doc_id, char_start FROM chunks),
        g AS (SELECT c.chunk_id, c.doc_id, c.char_start, max_by(h.t, h.s) AS heading FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.s <= c.char_start GROUP BY 1, 2, 3)
        SELECT chunk_id, concat_ws(' > ', n.t, heading) AS path FROM g LEFT JOIN n ON n.doc_id = g.doc_id AND n.k = 1 AND n.s <= g.char_start""",
    "inherited": rf"""
        WITH c AS (SELECT chunk_id, coalesce(heading_path, []) AS path, coalesce(page_frame, []) AS frame FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no) = 1),
        w AS (SELECT *, {_SOLE.format("lower(array_to_string(frame, ' '))")} AS framed, list_transform(list_reverse(path), lambda h: {_SOLE.format("lower(h)")}) AS bases,
                     list_transform(list_reverse(path), lambda h: trim(regexp_replace(regexp_replace(h, '\p{{C}}', '', 'g'), '^[{S.BULLETS}\s]+', ''), ' ')) AS names FROM c)
        SELECT chunk_id, coalesce(list_filter(bases, lambda b: b IS NOT NULL)[1], framed) AS basis,
               list_filter(names, lambda n: n IS NOT NULL AND n <> '' AND NOT regexp_matches(n, '\p{{Nd}}') AND len(list_filter(regexp_split_to_array(n, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda x: x <> '')) <= 6
                 AND len(list_filter(regexp_split_to_array(n, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda x: x <> '' AND length(regexp_replace(x, '\P{{L}}', '', 'g')) >= 4 AND NOT regexp_matches(x, '^\P{{L}}*\p{{Lu}}'))) = 0)[1] AS segment FROM w""",
    "line_kinds": rf"""
        WITH {_LINES}, n AS (SELECT doc_id, i, t, trim(t, ' ') AS x, regexp_replace(t, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g') AS z FROM l WHERE {_NONBLANK}),
        b AS (SELECT *, regexp_matches(x, '^[{S.BULLETS}\x{{E000}}-\x{{F8FF}}-]{{1,2}}$') AS lone, lag(regexp_matches(x, '^[{S.BULLETS}\x{{E000}}-\x{{F8FF}}]{{1,2}}$')) OVER (PARTITION BY doc_id ORDER BY i) AS opened FROM n)
        SELECT doc_id, count(*) FILTER (length(z) <= 80 AND len(list_filter(regexp_split_to_array(z, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: w <> '')) <= 12 AND regexp_matches(z, '\p{{L}}') AND NOT regexp_matches(z, '[.,;:]$')) AS shaped,
               count(*) FILTER (coalesce(opened, false) OR (length(x) > 1 AND regexp_matches(x, '^[{S.BULLETS}\x{{E000}}-\x{{F8FF}}]'))) AS bulleted FROM b GROUP BY doc_id""",
    "chunks": rf"""
        WITH RECURSIVE {_LINES}, p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
        n AS (SELECT doc_id, s, s + length(t) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) - 1 AS top FROM p WHERE {_NONBLANK}),
        a AS (SELECT x.doc_id, x.k, x.s, x.top, coalesce(min(y.k) FILTER (y.e - x.s >= 4000), x.top) AS last FROM n x JOIN n y ON y.doc_id = x.doc_id AND y.k >= x.k GROUP BY 1, 2, 3, 4),
        b AS (SELECT a.*, z.e, z.e - 500 AS back FROM a JOIN n z ON z.doc_id = a.doc_id AND z.k = a.last),
        c AS (SELECT b.doc_id, b.k, b.s, b.e, b.last, b.top, greatest(b.k + 1, CASE WHEN b.back > b.s THEN coalesce(max(y.k) FILTER (y.k > b.k AND y.k <= b.last AND y.s <= b.back), b.k + 1) ELSE b.last END) AS nxt
              FROM b JOIN n y ON y.doc_id = b.doc_id AND y.k >= b.k GROUP BY 1, 2, 3, 4, 5, 6, b.back),
        w(doc_id, k, no) AS (SELECT doc_id, k, 0 FROM n WHERE k = 0 UNION ALL SELECT w.doc_id, c.nxt, w.no + 1 FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k WHERE c.last < c.top)
        SELECT w.doc_id, CAST(w.no AS INT) AS chunk_no, CAST(c.s AS BIGINT) AS char_start, CAST(c.e AS BIGINT) AS char_end, CAST(c.e - c.s AS INT) AS n FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k""",
    "chunk_cover": rf"""
        WITH {_LINES}, p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
        SELECT doc_id, CAST(min(s) AS BIGINT) AS begins, CAST(max(s + length(t)) AS BIGINT) AS ends, true AS ok FROM p WHERE {_NONBLANK} GROUP BY doc_id""",
    "claims_in_chunks": f"""
        WITH {_ONCE}, c AS (SELECT doc_id, count(*) AS n FROM chunks WHERE char_start IS NOT NULL GROUP BY 1)
        SELECT fact_id, CASE WHEN c.n IS NULL THEN 0 ELSE 1 END AS page FROM once LEFT JOIN c ON c.doc_id = once.doc_id WHERE CAST(evidence_json->>'char_start' AS BIGINT) >= 0""",
    "aligned_evidence": f"""
        WITH {_ONCE}, e AS (SELECT fact_id, text, CAST(evidence_json->>'char_start' AS BIGINT) AS a, CAST(evidence_json->>'char_end' AS BIGINT) AS b FROM once JOIN documents d ON d.doc_id = once.doc_id),
        q AS (SELECT *, trim(substr(text, a + 1, b - a), ' ') AS q, greatest(0, a - 2000) AS w FROM e WHERE a >= 0)
        SELECT fact_id, CASE WHEN coalesce(q, '') = '' THEN 'unlocated' ELSE 'exact' END AS status, CASE WHEN coalesce(q, '') = '' THEN -1 ELSE w + instr(substr(text, w + 1, b + 2000 - w), q) - 1 END AS start FROM q""",
    "dropped_relations": f"""
        WITH {_RELATIONS}, {_ONCE}, ok AS (SELECT fact_id FROM once WHERE coalesce(align_status, '') <> 'unlocated')
        SELECT fact_a, fact_b FROM rel WHERE fact_a NOT IN (SELECT fact_id FROM ok) OR fact_b NOT IN (SELECT fact_id FROM ok)""",
    "missing_embeddings": "SELECT DISTINCT fact_id FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM facts WHERE embedding IS NOT NULL AND len(embedding) = 48)",

    "order_rules": """
        WITH r AS (SELECT printf('%010d', o_orderkey) AS id, o_custkey AS c, CAST(round(o_totalprice) AS BIGINT) AS v, o_orderstatus = 'P' AS pct, o_orderkey % 7 = 0 AS lakh, CAST(year(o_orderdate) AS INT) AS y, o_orderpriority = '4-NOT SPECIFIED' AS till,
                     o_orderkey % 5 = 0 AS at, CASE WHEN o_orderpriority <> '5-LOW' THEN left(o_orderpriority, 1) END AS s, CASE WHEN o_orderkey % 11 = 0 THEN 'K1' WHEN o_orderkey % 13 = 0 THEN 'K2' END AS k FROM orders),
        o AS (SELECT *, CASE WHEN pct THEN v % 100 WHEN lakh THEN greatest(round(v / 100000), 1) * 100000 ELSE v END AS n, CASE WHEN lakh AND NOT pct THEN 50000.0 ELSE 0.5 END AS h,
                     CASE WHEN pct THEN length(CAST(v % 100 AS VARCHAR)) WHEN lakh THEN 1 ELSE length(CAST(v AS VARCHAR)) END AS g FROM r),
        p AS (SELECT a.id AS fact_a, b.id AS fact_b, a.k IS NOT NULL AND b.k IS NOT NULL AND a.k <> b.k AS other, a.pct <> b.pct AS apart, a.n - a.h < b.n + b.h AND b.n - b.h < a.n + a.h AS agree,
                     a.n <> b.n AND abs(a.n - b.n) >= 2 * least(a.h, b.h) AND (CASE WHEN a.h >= b.h THEN a.g ELSE b.g END) <= 1 AS coarse,
                     NOT (a.y = b.y AND a.till = b.till) AS td, CASE WHEN a.at THEN 'as_at' ELSE 'period' END AS tk, a.at <> b.at AS x, (a.till OR b.till) AND NOT (a.till AND b.till AND a.y <> b.y) AS unreadable,
                     (a.s IS NULL) <> (b.s IS NULL) AS miss, coalesce(a.s <> b.s, false) AS sd FROM o a JOIN o b ON a.c = b.c AND a.id < b.id),
        q AS (SELECT *, td AND NOT unreadable AS tp, td AND NOT (unreadable AND x) AS te FROM p)
        SELECT fact_a, fact_b,
          CASE WHEN other THEN 'unrelated' WHEN apart THEN 'insufficient_context' WHEN agree AND (tp OR sd) THEN 'unrelated' WHEN agree AND coarse THEN 'insufficient_context' WHEN agree THEN 'corroborates' WHEN miss THEN 'insufficient_context'
               WHEN (td OR sd) AND NOT (te OR sd) THEN 'insufficient_context' WHEN te OR sd THEN 'reconciled_by_context' ELSE 'contradicts' END AS verdict,
          CASE WHEN other THEN 'comparison_key_differs' WHEN apart THEN 'incomparable_values' WHEN agree AND (tp OR sd) THEN 'context_differs_values_agree' WHEN agree AND coarse THEN 'agreement_rests_on_imprecision' WHEN agree THEN 'keys_match_intervals_overlap'
               WHEN miss THEN 'missing_qualifier_guard' WHEN (td OR sd) AND NOT (te OR sd) THEN 'unestablished_context_difference' WHEN te OR sd THEN 'discriminating_qualifier_differs' ELSE 'same_context_disjoint_intervals' END AS rule_fired,
          CASE WHEN other OR apart THEN NULL WHEN agree AND (tp OR sd) THEN CASE WHEN tp THEN tk ELSE 'segment' END WHEN agree THEN NULL WHEN miss THEN 'segment' WHEN (td OR sd) AND NOT (te OR sd) THEN tk WHEN te OR sd THEN CASE WHEN te THEN tk ELSE 'segment' END END AS qualifier_key,
          NOT other AND NOT apart AND NOT agree AND NOT miss AND (te OR sd OR NOT td) AS needs_llm FROM q""",
}



def _all() -> dict:
    fs = (
        facts_page, quarantined_page, relations_page, evidence, verify_facts, schema_timeline, schema_entries, ledger_totals, extraction_totals, shaped_facts, quarantine_ids, fact_names, unit_words, truncated_scales, years_mentioned, compatible_years,
        value_dates, order_dates, narrowed_years, same_entities, resolved_measures, request_keys, chunk_batches, chunk_contexts, inherited, line_kinds, chunk_cover, claims_in_chunks, aligned_evidence, dropped_relations, missing_embeddings, facts_key_pairs, facts_value_pairs, facts_neighbours, order_rules,
    )
    return {f.__name__: f for f in fs}


QUERIES = _all()
