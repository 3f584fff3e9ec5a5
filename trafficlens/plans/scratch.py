"""Where intermediate tables are kept when lineage has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its own,
    since all of its tasks run on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="trafficlens-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str, partition_by: str | None = None):
    """Write ``df`` to the scratch folder and read it back, so later jobs start from files."""
    path = scratch_dir(df.sparkSession, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
