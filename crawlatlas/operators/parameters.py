"""Effective script parameters per job and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Who wins: a later source beats an earlier one.
SCOPE_SCRIPT, LISTED_SCRIPT, SELECTED_SCRIPT, JOB, ENTITY, SEED = range(1, 7)


def job_parameters(annotations: DataFrame) -> DataFrame:
    """Declared keys of each job with their value.

    ``annotations`` are ``job_id, source, pos, key, value``; scripts declare keys, the
    job itself may only override declared ones.
    """
    return annotations.groupBy("job_id", "key").agg(
        F.max_by("value", F.struct("source", "pos")).alias("value"),
        F.min("source").alias("_declared")).where(F.col("_declared") < JOB).drop("_declared")


def resolve_parameters(annotations: DataFrame, jobs: DataFrame, seed_jobs: DataFrame,
                       overrides: DataFrame) -> DataFrame:
    """Parameters per (job, seed): the job's, overridden by the entity's and then the seed's.

    ``overrides`` are ``seed_id, source, pos, key, value``. A key ``{job}key`` is meant for
    the job of that id or name only, and beats the plain key of the same object.
    """
    declared = job_parameters(annotations)
    base = seed_jobs.join(declared, "job_id").select(
        "job_id", "seed_id", "key", "value", F.lit(0).alias("source"), F.lit(0).alias("targeted"), F.lit(0).alias("pos"))
    target = F.regexp_extract("key", r"^\{([^}]*)\}", 1)
    parsed = overrides.select(
        "seed_id", "source", "pos", "value", target.alias("_target"),
        F.regexp_replace("key", r"^\{[^}]*\}", "").alias("key"), F.col("key").startswith("{").cast("int").alias("targeted"))
    named = seed_jobs.join(jobs.select(F.col("id").alias("job_id"), F.col("name").alias("_name")), "job_id")
    meant = (F.col("targeted") == 0) | (F.col("_target") == F.col("job_id")) | (F.col("_target") == F.col("_name"))
    given = (parsed.join(named, "seed_id").where(meant)
             .join(declared.select("job_id", "key"), ["job_id", "key"], "left_semi"))
    rows = base.unionByName(given.select(*base.columns))
    return rows.groupBy("job_id", "seed_id", "key").agg(
        F.max_by("value", F.struct("source", "targeted", "pos")).alias("value"))
