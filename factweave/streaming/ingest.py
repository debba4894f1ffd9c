"""Incremental ingest: micro-batches of facts folded into the ledger; fresh facts meet all facts of their keys, others don't meet again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, decide
from ..operators import facts as FA
from ..session import cut
from ..sources import ledger


def ingest_batch(batch: DataFrame, root: str) -> None:
    """Stores the batch's facts and replaces the relations that touch them; relations of other facts stay. Idempotent for a batch."""
    fresh = cut(FA.comparable(batch))
    ledger.upsert(fresh, f"{root}/facts", ["fact_id"])
    facts = ledger.loadable(ledger.read(batch.sparkSession, f"{root}/facts"))
    pairs = blocking.apart(blocking.touching_key_pairs(facts, ledger.loadable(fresh)), facts)
    made = decide.relations(pairs, facts, keep_unrelated=False).drop("missing_keys")
    ids = fresh.select("fact_id")
    old = ledger.read(batch.sparkSession, f"{root}/relations", made)
    apart = old.join(ids.withColumnRenamed("fact_id", "fact_a"), "fact_a", "left_anti").join(ids.withColumnRenamed("fact_id", "fact_b"), "fact_b", "left_anti")
    ledger.overwrite(apart.unionByName(made), f"{root}/relations")


def ingest_stream(spark: SparkSession, source: str, schema, root: str, checkpoint: str) -> StreamingQuery:
    """Facts that arrive as Parquet files in `source`, once through (availableNow)."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(df, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, watermark: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Facts by hour of created_at and kind, late ones within the watermark included."""
    return stream.withWatermark("created_at", watermark).groupBy(F.window("created_at", window), "value_kind").agg(F.count("*").alias("n"))
