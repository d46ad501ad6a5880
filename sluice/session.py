"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results, or that a plan shape depends on. All are
# runtime settings, so `configure` also works on a session built elsewhere.
RUNTIME_CONF = {
    # JSON objects with a repeated key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods over 8000 bytes of bytecode. Beyond that,
    # stages run operator by operator, which it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A replayed batch replaces its own partition only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Lets the event ledger, bucketed on dedupe_key, join on
    # (pipeline_id, dedupe_key) without being shuffled.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
