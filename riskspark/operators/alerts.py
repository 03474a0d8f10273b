"""Batch twin of the alert state machine."""

from pyspark.sql import DataFrame, functions as F

from riskspark.operators.ordered import prior_value


def alert_state(scans: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``type`` and ``announce`` from the file's previous scan; keys include the file."""
    was = F.coalesce("_was", F.lit(False))
    return prior_value(scans, keys, [ts, tie], "blocked", "_was").withColumn(
        "type", F.when(F.col("blocked"), "HARD_BLOCK").when(was, "CLEAR")
    ).withColumn("announce", F.col("blocked") & ~was).drop("_was")
