"""Tables of a run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and all runs on this machine, as
    in tests, a folder is made; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("jobweir.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must be set")
        found = "file://" + tempfile.mkdtemp(prefix="jobweir-")
        spark.conf.set("jobweir.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: worked out once for
    all that read it, and the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobweir/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
