"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_local_base: list[str] = []


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for a written table or a stream checkpoint.

    It lies under ``spark.checkpoint.dir``, which a cluster sets to shared storage. Only a
    local master may do without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="newsrate-"))
        base = _local_base[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df, name: str):
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that is
    still there after an executor is lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
