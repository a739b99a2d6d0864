"""Table snapshots as plain Parquet, read and written by Spark alone.

jobs are partitioned by kind and by a bucket of the key, so that a merge
rewrites only the partitions its batch touches (dynamic partition overwrite).
Readers that must not see a merge under way, and histories of versions, are
what table formats are for; these functions keep to folders of Parquet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import COMPANIES, DISCOVERIES, JOBS, META, REQUIRED, RUNS

TABLES = {
    "companies": COMPANIES, "company_discoveries": DISCOVERIES, "jobs": JOBS, "crawl_runs": RUNS,
    "meta": META,
}
#: Buckets of each kind's jobs. It is part of the layout: a table keeps its own.
BUCKETS = 64
PARTITIONED = {"jobs": ["ats_kind", "bucket"]}


def bucket() -> Column:
    return F.pmod(F.xxhash64("ats_kind", "external_id"), F.lit(BUCKETS)).cast("int")


def read_table(spark: SparkSession, root: str, name: str, only: Column | None = None) -> DataFrame:
    """A table, or those of its partitions that only chooses; empty if there is none."""
    extra = ", bucket int" * ("bucket" in PARTITIONED.get(name, []))
    try:
        table = spark.read.schema(TABLES[name] + extra).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[name])
    return (table if only is None else table.where(only)).select(*[x.split()[0] for x in TABLES[name].split(", ")])


def rejected(df: DataFrame, name: str) -> DataFrame:
    """Rows with a null where the table allows none."""
    missing = F.lit(False)
    for c in REQUIRED.get(name, []):
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a table. mode "overwrite" replaces the partitions that df has, or
    the whole table where it has no partitions; "append" adds to a log. Rows
    with a null where the table allows none are an error."""
    by, need, error = PARTITIONED.get(name, []), REQUIRED.get(name, []), f"{name}: null in one of {REQUIRED.get(name)}"
    if by:  # such files count only when all are written, so rows are checked on their way
        df = df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(error))) for c in need})
    elif not rejected(df, name).isEmpty():
        raise ValueError(error)
    if "bucket" in by:
        df = df.withColumn("bucket", bucket()).repartition(*by)
    try:
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")
    except Exception as e:
        if by and error in str(e):
            raise ValueError(error) from e
        raise


def save_bucketed(df: DataFrame, table: str, path: str, key: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """df as a table of the session's catalog, in buckets of the key, sorted in
    them: a merge by this key moves its batch only. A snapshot of a table is never
    overwritten while a merge reads it; each version has a path of its own."""
    df = df.repartition(buckets, *key)
    df.write.format("parquet").bucketBy(buckets, *key).sortBy(*key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
