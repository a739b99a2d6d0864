"""Merges as a stream: each micro-batch of postings changes the partitions it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.merge import JOB_KEY, JOB_POLICY, new_keys, numbered, put_meta, upsert_jobs
from ..sources.store import bucket, read_table, write_table

#: The row of meta that holds the greatest id given to a job.
LAST_ID = "jobs.last_id"


def _touched(batch: DataFrame) -> Column:
    """A predicate on kind and bucket; there are at most kinds * BUCKETS pairs."""
    kinds = batch.groupBy("ats_kind").agg(F.collect_set(bucket()).alias("buckets")).collect()
    found = [(F.col("ats_kind") == r["ats_kind"]) & F.col("bucket").isin(r["buckets"]) for r in kinds]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def _given(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids that an earlier attempt at a batch gave; None if it did not get so far."""
    try:
        return spark.read.schema("ats_kind string, external_id string, id bigint").parquet(f"{path}/ids")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def batch_ids(root: str, epoch: int, batch: DataFrame, jobs: DataFrame) -> DataFrame:
    """(ats_kind, external_id, id) of the new keys of a batch.

    They are written under the batch's epoch before anything else changes, and the
    last id goes to meta after that; a batch that is repeated after a failure, at
    whatever point, finds its ids and gives none again. No other table is scanned
    for the last id.
    """
    spark = batch.sparkSession
    path = f"{root}/job_ids/epoch={epoch}"
    given, wanted = _given(spark, path), new_keys(batch, jobs, JOB_KEY)
    # jobs change only after all ids of a batch are there, so a part of them was never used
    if given is None or not wanted.join(given, list(JOB_KEY), "left_anti").isEmpty():
        held = read_table(spark, root, "meta", F.col("key") == LAST_ID).first()
        if held is None:  # a table from before ids were noted
            start = read_table(spark, root, "jobs").agg(F.max("id")).first()[0] or 0
        else:
            start = int(held["value"])
        numbered(wanted, start).write.mode("overwrite").parquet(f"{path}/ids")
        given = _given(spark, path)
    last = given.agg(F.max("id")).first()[0]
    if last is not None:
        row = spark.createDataFrame([(LAST_ID, str(last), 0)], "key string, value string, seq int")
        meta = put_meta(read_table(spark, root, "meta"), row, F.col("seq"))
        meta = spark.createDataFrame(meta.collect(), meta.schema)  # a few rows; the table is read before it is replaced
        write_table(meta, root, "meta")
    return given


def apply_postings(root: str, seq: Column, now):
    """A function for writeStream.foreachBatch that merges batches of the job
    columns (ats_kind, external_id, company_id, title, ...) into root/jobs.

    Only partitions with a key of the batch are read, merged and replaced. now
    (epoch) gives the time of a batch, so a batch that is repeated after a
    failure merges to the same state, with the same ids. One stream writes a table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        jobs = read_table(spark, root, "jobs", _touched(batch))
        ids = batch_ids(root, epoch, batch, jobs)
        rows = batch.join(ids, list(JOB_KEY), "left")
        out = upsert_jobs(jobs, rows, seq, now(epoch), policy=JOB_POLICY | {"id": "keep"}).drop("change")
        write_table(out.select(*jobs.columns), root, "jobs")
        batch.unpersist()

    return run
