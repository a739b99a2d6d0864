"""Scratch tables in the shared folder and small column helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes in an Arrow batch of texts, whichever is reached first. Python
#: workers hold a few batches at a time, so this and the longest text bound them.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs on this machine (tests), a folder is made;
    on a cluster it must be set, as a folder of one machine is not shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("jobweir.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="jobweir-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("jobweir.shared.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/jobweir/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends
    here, and a lost executor costs no more than reading the table again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, in this session from now on: results
    are lazy, so the limits must still hold when they are worked out."""
    for key, most in ARROW.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Bytes of text that a task in Python works on at once.
STRETCH = 1 << 20


def stretches(batches, *texts: int):
    """The rows of Arrow batches in slices of about STRETCH bytes in the columns
    texts, so that arrays made of them are small whatever a batch holds."""
    for b in batches:
        ends = np.cumsum(sum(pc.binary_length(b.column(c)).fill_null(0).to_numpy() for c in texts), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            most = STRETCH + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, most, "right")))
            yield b.slice(at, to - at)
            at = to


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # what the C library keeps, too


def lean(task, encodes: bool = False):
    """task, a function of batches for mapInArrow, in a worker that holds nothing
    else: Spark uses Python workers again for other stages, so a task that does
    not encode lets go of the tokenizers kept there, and memory freed before and
    in it goes back to the system."""

    def run(batches):
        if not encodes and "tokenizers" in sys.modules:
            vars(sys.modules["tokenizers"]).pop("_encoders_of_jobweir", None)
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole(text: str | Column) -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
