"""Discovery: query plans, hits of search engines, companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import classify

#: Kinds and the queries that look for their boards (fixed values).
PLANS = (
    ("greenhouse", 'site:boards.greenhouse.io "Remote"'),
    ("greenhouse", 'site:job-boards.greenhouse.io "Remote"'),
    ("ashbyhq", 'site:jobs.ashbyhq.com "Remote"'),
    ("lever", 'site:jobs.lever.co "Remote"'),
    ("smartrecruiters", 'site:jobs.smartrecruiters.com "Remote"'),
    ("recruitee", 'site:recruitee.com "Remote"'),
    ("workday", 'site:myworkdayjobs.com "Remote"'),
    ("bamboohr", "site:bamboohr.com engineer remote"),
    ("bamboohr", "site:bamboohr.com developer remote"),
    ("bamboohr", "site:bamboohr.com software remote"),
    ("bamboohr", "site:bamboohr.com careers remote"),
)


def plans(spark: SparkSession) -> DataFrame:
    """(kind, query)"""
    return spark.createDataFrame(PLANS, "kind string, query string")


def plan_hits(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """plan with url of its queries' hits (query, url); a query without a
    response stays with a null url: it was sent."""
    return plan.join(hits.select("query", "url"), "query", "left").select("kind", "query", "url")


def kind_matched(hits: DataFrame) -> DataFrame:
    """hits (kind, url) with ref, of those whose platform is the plan's."""
    rows = hits.withColumn("ref", classify(F.col("url")))
    return rows.where(F.col("ref.kind") == F.col("kind"))


def merge_engines(*companies: DataFrame) -> DataFrame:
    """Companies (ats_kind, ats_slug) that any engine found."""
    out = companies[0].select("ats_kind", "ats_slug")
    for c in companies[1:]:
        out = out.unionByName(c.select("ats_kind", "ats_slug"))
    return out.dropDuplicates(["ats_kind", "ats_slug"])
