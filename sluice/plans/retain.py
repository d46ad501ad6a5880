"""Retention as a job: purge old events, drop expired months of deliveries and runs.

Each step is one commit of one table, and a step that is repeated finds nothing left to do: the job can be restarted
anywhere. Deliveries are read before events go, so an event with an open delivery stays.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.retention import partitions_expired, purge_candidates
from sluice.plans.deliver import OPEN_STATE
from sluice.sinks import files
from sluice.sinks.keyed import KeyedTable
from sluice.sinks.ledger import Ledger, events_of, remove_events


def purge_events(spark: SparkSession, ledger: Ledger, deliveries: KeyedTable, now: datetime, days: int, batch_size: int) -> int:
    """Remove the oldest events past their age that no open delivery needs; returns how many.

    Only the batch partitions that hold victims are rewritten.
    """
    victims = purge_candidates(events_of(spark, ledger), deliveries.read(split=OPEN_STATE), now, days, batch_size)
    return remove_events(spark, ledger, victims.select("pipeline_id", "dedupe_key"))


def drop_expired_deliveries(deliveries: KeyedTable, policy: DataFrame, now: datetime) -> list[str]:
    """Drop the months of the delivery store that its policy no longer keeps."""
    spark = deliveries.spark
    held = [("pipeline_delivery", p) for p in deliveries.manifest.load().parts()]
    months = _expired(spark, policy, held, now)
    deliveries.drop_parts(months)
    deliveries.expire(keep=1)
    return months


def drop_expired_runs(spark: SparkSession, ledger: Ledger, policy: DataFrame, now: datetime) -> list[str]:
    """Drop the months of run rows that their policy no longer keeps."""
    folder, table = ledger.path("runs"), ledger.table("runs")
    held = [("pipeline_run", n.split("=", 1)[1]) for n in files.names(spark, folder) if n.startswith("created_month=")]
    months = _expired(spark, policy, held, now)
    for month in months:
        for row in spark.sql(f"SHOW PARTITIONS {table} PARTITION (created_month = '{month}')").collect():
            batch = row[0].rsplit("batch_id=", 1)[1]
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (created_month = '{month}', batch_id = '{batch}')")
        files.remove(spark, f"{folder}/created_month={month}")
    return months


def _expired(spark: SparkSession, policy: DataFrame, held: list[tuple[str, str]], now: datetime) -> list[str]:
    if not held:
        return []
    months = spark.createDataFrame(held, "table_name string, month string")
    return sorted(r["month"] for r in partitions_expired(policy, months, F.lit(now)).collect())
