"""Event logs from text files or Kafka, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "scenario string, seq bigint, ts timestamp, json string"


def read_event_log(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Events ``(scenario, seq, ts, json)`` from JSON lines that wrap the message text.

    A line that is no valid envelope keeps its text in ``json`` with the rest null, so ``decode``
    sends it to the dead letter.
    """
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.format("text").load(path)
    env = F.from_json("value", ENVELOPE)
    return raw.select(env.alias("v"), "value").select(
        "v.scenario", "v.seq", "v.ts", F.coalesce("v.json", "value").alias("json")
    )


def read_kafka_events(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """The same columns from a Kafka topic; the connector must be on the class path.

    The message key is the scenario. ``seq`` is a header set by the producer, because offsets are
    only ordered within a partition.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", **options}).load()
    seq = F.filter("headers", lambda h: h["key"] == "seq")[0]["value"]
    return raw.select(
        F.col("key").cast("string").alias("scenario"),
        seq.cast("string").cast("bigint").alias("seq"),
        F.col("timestamp").alias("ts"),
        F.col("value").cast("string").alias("json"),
    )
