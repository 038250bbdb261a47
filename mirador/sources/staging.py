"""Tables written once in the folder that all executors share, for steps that read them often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Only where that is unset and the master is
    local (a test) one of this process."""
    global _own
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="mirador-")
        base = _own
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written and read back: later steps read it instead of computing it anew, and
    a lost executor costs a reread."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
