"""What operators need from the session: shared checkpoint folder, and the package on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need no shared source folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="factweave-"), "factweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(out)
    _SHIPPED[sc.applicationId] = out


def ship_active() -> None:
    """ship for the session in use, where a column is made and no session is at hand."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only where it is unset and the master is local, one of our own."""
    sc = spark.sparkContext
    if (own := sc.getConf().get("spark.checkpoint.dir", None)) or (own := sc.getCheckpointDir()):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(own)
        return own
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes `df` once and cuts its lineage through the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitioned by the columns for work that is heavy per row: as many partitions as a shuffle has, or as there are cores, and
    not coalesced by their size. A following aggregation or join on the columns needs no other exchange."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)
