"""Micro-batches with several outputs that survive a retry.

A body made by :func:`body` writes every output of a batch under ``<out>/<name>/batch_id=<id>`` and, when all stand, one
ledger row under ``<out>/ledger/batch_id=<id>``.  A batch that the ledger holds is not run again; one that broke off is
written anew over what it left.  Readers (:func:`read`, :func:`snapshot`) see ledger batches only, so an output without
its ledger row does not exist.

Snapshots are outputs that hold a whole table: a batch reads the one of the last ledger batch before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.operators import governance as gov, post, sqlrls
from riskspark.functions import paths as pf
from riskspark.session import checkpoint

LEDGER = "batch_id bigint, max_ts timestamp"


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a finished write stands at a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, max_ts) of every finished batch; max_ts is the latest event time seen so far."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", f"{out}/ledger").parquet(f"{out}/ledger")


def body(out: str, outputs: Callable[[DataFrame, int], dict[str, DataFrame]], ts: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: ``outputs`` maps a stored batch and its id to named tables."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _there(spark, f"{out}/ledger/batch_id={batch_id}"):
            return
        rows = checkpoint(batch)  # several outputs read it
        for name, table in outputs(rows, batch_id).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        before = last(spark, out, batch_id)
        seen = rows.agg(F.max(ts).alias("max_ts")) if ts else spark.createDataFrame([(None,)], "max_ts timestamp")
        latest = F.greatest(F.col("max_ts").cast("timestamp"), F.lit(before[1] if before else None).cast("timestamp"))
        seen.select(latest.alias("max_ts")).coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch_id={batch_id}")

    return run


def last(spark: SparkSession, out: str, before: int | None = None) -> tuple[int, object] | None:
    """(batch id, latest event time) of the last finished batch, of those before ``before``."""
    done = ledger(spark, out)
    done = done if before is None else done.where(F.col("batch_id") < before)
    row = done.agg(F.max("batch_id").alias("b"), F.max("max_ts").alias("t")).first()
    return None if row.b is None else (row.b, row.t)


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All rows of one output, with their batch_id."""
    rows = spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return rows.join(ledger(spark, out).select("batch_id"), "batch_id", "left_semi")


def snapshot(spark: SparkSession, out: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table as the last finished batch (before ``before``) left it; None if there is none."""
    found = last(spark, out, before)
    return None if found is None else spark.read.parquet(f"{out}/{name}/batch_id={found[0]}")


# --- jobs ------------------------------------------------------------------------------------------

def ingest_body(out: str, licenses: DataFrame, orgs: DataFrame):
    """Reports to ``rows``, ``rejects`` and ``usage``; usage of batches adds up (:func:`usage_totals`)."""

    def outputs(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        rows, rejects, usage = gov.ingest_telemetry(batch, licenses, orgs)
        return {"rows": rows, "rejects": rejects, "usage": usage}

    return body(out, outputs)


def usage_totals(spark: SparkSession, out: str, key: str = "license_id") -> DataFrame:
    return read(spark, out, "usage").groupBy(key).agg(F.sum("usage_count").alias("usage_count"), F.max("last_used_at").alias("last_used_at"))


def entitlement_body(out: str, users: DataFrame, licenses: DataFrame):
    """Entitlement rows to the snapshots ``users`` and ``licenses`` and to ``rejects``.

    Batches are applied in turn: within one, rows count in (ts, event_id) order, and a later batch overrides an earlier one.
    """

    def outputs(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        spark = batch.sparkSession
        now = [snapshot(spark, out, name, batch_id) for name in ("users", "licenses")]
        found = gov.entitlement_upsert(batch, users if now[0] is None else now[0], licenses if now[1] is None else now[1])
        return dict(zip(("users", "licenses", "rejects"), found))

    return body(out, outputs, "ts")


def late_body(out: str, delay: str, ts: str = "ts"):
    """Rows to ``rows``, or to ``late`` if they are older than the latest event time of earlier batches less ``delay``."""

    def outputs(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        before = last(batch.sparkSession, out, batch_id)
        mark = F.lit(before[1] if before else None).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts).cast("timestamp") < mark, F.lit(False))
        return {"rows": batch.where(~late), "late": batch.where(late)}

    return body(out, outputs, ts)


def scan_body(out: str, scan: Callable[[DataFrame], DataFrame], files: DataFrame):
    """Changed (repo_id, path) to the findings of these files (``findings``).

    A table's protection may stand in any migration of its repository, so where a migration changed, all of that
    repository's are checked again (``missing_rls``).
    """

    def outputs(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        repos = batch.where(pf.is_migration(F.col("path"))).select("repo_id").distinct()
        again = sqlrls.migrations(files).join(repos, "repo_id", "left_semi")
        return {"findings": scan(post.scope_changed(files, batch)), "missing_rls": sqlrls.missing_rls(again)}

    return body(out, outputs)
