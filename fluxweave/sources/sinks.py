"""Where feature records go. A sink takes features and the number of their batch; a batch that comes again under its number changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import as_json

Sink = Callable[[DataFrame, int], None]


def files(path: str, kind: str = "json") -> Sink:
    """Records as JSON lines (kind json) or Parquet, in a folder for each batch that a repeated batch replaces."""

    def write(features: DataFrame, batch: int = 0) -> None:
        to = f"{path}/batch={batch}"
        if kind == "json":
            as_json(features).select("value").write.mode("overwrite").text(to)
        else:
            features.write.mode("overwrite").parquet(to)

    return write


def kafka(servers: str, topic: str, **options: str) -> Sink:
    """Records to a topic; needs Spark's Kafka connector on the class path. All brokers must acknowledge.

    The key, flow and batch, is that of the same record when a batch is repeated: a compacted topic, or a reader that keeps the last of a key, sees it once.
    """

    def write(features: DataFrame, batch: int = 0) -> None:
        keyed(features, batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").options(**options).save()

    return write


def keyed(features: DataFrame, batch: int) -> DataFrame:
    """key (flow:batch) and value, the record's JSON text."""
    return as_json(features).select(F.concat_ws(":", F.col("flow_id").cast("string"), F.lit(batch)).alias("key"), "value")


def fan_out(*sinks: Sink) -> Sink:
    """Each batch goes to all sinks and is computed once."""

    def write(features: DataFrame, batch: int = 0) -> None:
        features.persist()
        try:
            for sink in sinks:
                sink(features, batch)
        finally:
            features.unpersist()

    return write
