"""The queries of the operators in this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .bpe import encode_corpus
from .canonical import canonical_predicates
from .components import corroborated_groups
from .lookalikes import look_alike_pairs, one_form
from .names import same_name_pairs
from .packing import CAPACITY, pack_documents
from .splitting import LIMIT, OVERLAP, oversized_items, split_oversized
from .vector_graph import close_pairs, similar_facts


def _pieces(spark: SparkSession, d: str) -> list[DataFrame]:
    documents = split_oversized(table(spark, d, "documents"), id_col="doc_id", kind="document")
    chunks = split_oversized(table(spark, d, "chunks"), id_col="chunk_id", kind="chunk", heading_col="heading_path", base_col="char_start")
    return [documents, chunks]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_items(_pieces(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    documents, chunks = _pieces(spark, d)
    return documents.unionByName(chunks.dropDuplicates(["item_id", "piece_no"])).withColumn("heading_path", F.concat_ws(" > ", "heading_path"))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every cut item with the MD5 of its pieces' bodies put together, its length, and whether all pieces and overlaps keep to their limits."""
    documents, chunks = _pieces(spark, d)
    p = documents.unionByName(chunks.dropDuplicates(["item_id", "piece_no"]))
    back = F.col("body_start") - F.col("piece_start")
    ok = (F.length("piece") <= LIMIT) & (back <= OVERLAP) & (F.length("piece") == F.col("piece_end") - F.col("piece_start")) & ((F.col("piece_no") == 0) | (back > 0) | (F.col("body_start") == F.col("piece_start")))
    rows = p.select("item_kind", "item_id", "piece_no", F.substring(F.col("piece"), back + 1, F.length("piece")).alias("body"), ok.alias("ok"))
    whole = rows.groupBy("item_kind", "item_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "body"))).alias("b"), F.min("ok").alias("within"))
    text = F.array_join(F.transform("b", lambda x: x["body"]), "")
    return whole.select("item_kind", F.col("item_id").cast("long").alias("item_id"), F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"), "within")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_predicates(table(spark, d, "facts"), table(spark, d, "predicate_registry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return corroborated_groups(table(spark, d, "relations"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return close_pairs(table(spark, d, "facts"))


def p5_similar(spark: SparkSession, d: str) -> DataFrame:
    return similar_facts(table(spark, d, "facts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_name_pairs(table(spark, d, "facts"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every document, whether its pieces follow one another from its start, and whether all containers that hold some of it keep to the capacity."""
    c = cut(p9_containers(spark, d))
    used = c.where("container_id is not null").groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    met = c.join(used, "container_id", "left")
    size = F.col("token_end") - F.col("token_start")
    return met.groupBy("doc_id").agg((F.sum(size) == F.max("token_end")).alias("whole"), (F.coalesce(F.max("used"), F.lit(0)) <= CAPACITY).alias("fits"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, tokens, and the share of the containers' space that is used."""
    c = p9_containers(spark, d).where("container_id is not null")
    n, used = F.countDistinct("container_id"), F.sum(F.col("token_end") - F.col("token_start"))
    return c.agg(n.alias("containers"), used.alias("tokens"), F.round(used / (n * CAPACITY), 4).alias("fill"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of its form."""
    return one_form(table(spark, d, "documents"), keep_text=False).select("doc_id", F.hex("form_hash").alias("form_class"), "visible")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p3_found, p5_found, p5_similar, p7_found, p8_ids, p9_containers, p9_cover, p9_fill, p10_found, p10_forms)}

SQL = {
    "p1_found": """
        SELECT 'document' AS item_kind, doc_id AS item_id FROM documents WHERE length(text) > 4000
        UNION SELECT 'chunk', chunk_id FROM chunks WHERE length(text) > 4000""",
    "p1_cover": """
        SELECT 'document' AS item_kind, doc_id AS item_id, md5(text) AS text_md5, length(text) AS n_chars, true AS within FROM documents WHERE length(text) > 4000
        UNION SELECT 'chunk', chunk_id, md5(text), length(text), true FROM chunks WHERE length(text) > 4000""",
    "p9_cover": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p3_found": """
        WITH RECURSIVE link AS (
            SELECT fact_a AS a, fact_b AS b FROM relations
            WHERE fact_a IS NOT NULL AND fact_b IS NOT NULL AND fact_a <> fact_b AND lower(trim(verdict, ' \t\r\n')) = 'corroborates'),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach(fact_id, other) AS (SELECT a, a FROM edge UNION SELECT r.fact_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
        SELECT fact_id, min(other) AS group_id FROM reach GROUP BY fact_id""",
}
