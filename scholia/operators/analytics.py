"""Planned in the reference's design documents, without formulas; the definitions here are our own.

A simulation is an account's attempt at a paper, with a score; its answers each have points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores_by_account(simulations: DataFrame) -> DataFrame:
    """simulations: (id, account_id, score). Count, mean, best and worst score by account; means are of whole hundredths, whatever the order."""
    mean = F.sum(F.round(F.col("score") * 100).cast("bigint")) / F.count("score") / F.lit(100.0)
    return simulations.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_score"), F.max("score").alias("best_score"), F.min("score").alias("worst_score"))


def answers_by_simulation(answers: DataFrame) -> DataFrame:
    """answers: (simulation_id, points, correct). Totals by simulation."""
    return answers.groupBy("simulation_id").agg(F.count(F.lit(1)).alias("n_answers"), F.round(F.sum("points"), 2).alias("points"), F.avg(F.col("correct").cast("double")).alias("share_correct"))


def requests_per_window(requests: DataFrame, minutes: int, limit: int) -> DataFrame:
    """requests: (user_id, ts). Windows in which a user sent more than `limit`."""
    grouped = requests.groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")
