"""Session helpers: tables, shared checkpoint folder, driver-sized broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: A relation that is broadcast on purpose has to stay below this many rows;
#: beyond it the caller takes a shuffled path.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is configured and the master is
    local (tests, one machine) a folder of our own is set. A cluster without one is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="stepfree-checkpoint-"))
    return configured or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage, so that a
    lost executor costs a re-read and never a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
