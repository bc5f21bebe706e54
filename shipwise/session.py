"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. These helpers exist for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Session time zone pins the meaning of
# timestamps (all tables are timestamp_ntz anyway); AQE coalesces shuffle
# partitions and splits skewed join partitions at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # remove reliable checkpoint files once their DataFrame is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # iterative training runs thousands of short queries: keep fewer of their records on the driver
    "spark.sql.ui.retainedExecutions": "200",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shipwise", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; if it is unset there, this fails rather than fall back to a
    machine-local folder. Only a local master (tests, the bench) gets a
    scratch folder of its own when the setting is missing.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (needed by reliable checkpoints)")
        d = tempfile.mkdtemp(prefix="shipwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # some sessions refuse runtime changes of core settings
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, for tables that outlive this driver (Spark keeps the checkpoints of
    each driver in a folder of its own below it)."""
    own = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or os.path.dirname(own.rstrip("/"))).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet beside the checkpoints and read again. They take less room than a checkpoint,
    and a reader of a few columns reads only these."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
