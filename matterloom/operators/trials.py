"""Trials of cases: quotas, renumbering, abandonment, totals, and what to run next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(trials: DataFrame, case: str, trial: str, passed: str) -> DataFrame:
    """Adds ``passed_before``: trials of the case before this one that passed."""
    w = Window.partitionBy(case).orderBy(trial).rowsBetween(Window.unboundedPreceding, -1)
    return trials.withColumn("passed_before", F.coalesce(F.sum(F.col(passed).cast("int")).over(w), F.lit(0)))


def within_quota(trials: DataFrame, case: str, trial: str, passed: str, quota: int, most: int) -> DataFrame:
    """Trials that were run: the quota was not met before them, and they are among the first ``most``."""
    return counted(trials, case, trial, passed).where((F.col("passed_before") < quota) & (F.col(trial) < most))


def renumbered(trials: DataFrame, case: str, trial: str, passed: str, name: str = "sample_id") -> DataFrame:
    """Accepted trials, numbered from 0 within their case."""
    return trials.where(passed).withColumn(name, (F.row_number().over(Window.partitionBy(case).orderBy(trial)) - 1).cast("long"))


def abandoned(trials: DataFrame, case: str, trial: str, passed: str, quota: int, most: int) -> DataFrame:
    """Cases given up at trial ``2 * quota`` because fewer than ``quota^2 / most`` had passed."""
    at = counted(trials, case, trial, passed).where(F.col(trial) == 2 * quota)
    return at.where(F.col("passed_before") < quota * quota / most).select(case, "passed_before")


def totals(trials: DataFrame, case: str, passed: str) -> DataFrame:
    """Per case, and for all (case is null): trials and passes."""
    return trials.rollup(case).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))


def unfinished(totals_: DataFrame, case: str, quota: int, most: int) -> DataFrame:
    """Cases that were begun and are not done, most passed first (F2); take the first with ``limit``."""
    return totals_.where((F.col("total") > 0) & (F.col("total") < most) & (F.col("passed") < quota)).orderBy(F.desc("passed"), case)


def restored(found: DataFrame, errors: DataFrame, case: str, error_id: str) -> DataFrame:
    """Counters from what is on disk (D31): passed are the renders found, total is those and the errors, and the next
    trial is the larger of total and the highest error's number plus one."""
    passed = found.groupBy(case).agg(F.count("*").alias("passed"))
    failed = errors.groupBy(case).agg(F.count("*").alias("failed"), F.max(error_id).alias("last"))
    both = passed.join(failed, case, "full").na.fill(0, ["passed", "failed"])
    total = F.col("passed") + F.col("failed")
    return both.select(case, "passed", total.alias("total"), F.greatest(total, F.coalesce(F.col("last") + 1, F.lit(0))).alias("next_trial"))
