"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"

_own_folder: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and its master is local (a test) a folder of this
    process is made.
    """
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="mirador-")
    return _own_folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut,
    and a lost executor costs a reread rather than a rerun."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A character other than ASCII, small Latin-1 letters and common punctuation, none of
#: which but A-Z differs in lower case.
_CASED = "[^\\x00-\\x7f\\u00a0-\\u00bf\\u00df-\\u00ff\\u2010-\\u2027\\u20ac]"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone. Where nothing else has a lower
    case, the far quicker ``lower`` does the same."""
    return F.when(c.rlike(_CASED), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))
