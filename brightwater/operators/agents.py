"""Agent runs: outcomes and tool failures from the step logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.functions.numbers import percent


def explode_steps(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per logged step of runs that hold their steps in an array."""
    return runs.select(key, F.explode("steps").alias("step")).select(
        F.col(key).alias("run_id"), "step.event", F.col("step.toolName").alias("tool_name")
    )


def agent_run_outcomes(steps: DataFrame) -> DataFrame:
    """Per run: its outcome and how many steps it started, finished and failed.

    A run without a plan failed in planning; one with a failed step failed in a tool.
    """
    runs = steps.groupBy("run_id").agg(
        F.count_if(F.col("event") == "plan").alias("plans"),
        F.count_if(F.col("event") == "step_start").alias("started"),
        F.count_if(F.col("event") == "step_end").alias("finished"),
        F.count_if(F.col("event") == "step_error").alias("failed"),
    )
    outcome = (
        F.when(F.col("plans") == 0, "planning_failure")
        .when(F.col("failed") > 0, "tool_failure")
        .otherwise("success")
    )
    return runs.withColumn("outcome", outcome).drop("plans")


def agent_run_summary(steps: DataFrame) -> DataFrame:
    """Runs, share and step counts per outcome."""
    by_outcome = agent_run_outcomes(steps).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("started").alias("steps_started"),
        F.sum("finished").alias("steps_finished"),
        F.sum("failed").alias("steps_failed"),
    )
    total = by_outcome.agg(F.sum("runs")).scalar()
    return by_outcome.withColumn("share_pct", percent(F.col("runs"), total, 1))


def agent_tool_failures(steps: DataFrame) -> DataFrame:
    """Failed steps per tool."""
    return (
        steps.filter("event = 'step_error'")
        .groupBy("tool_name")
        .agg(F.count(F.lit(1)).alias("failures"))
    )
