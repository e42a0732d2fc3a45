"""An extension: the same check over a stream of page snapshots, and the change against the snapshot before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.check import ParityResult, check


def monitor(pairs: DataFrame, sink: Callable[[ParityResult, int], None], checkpoint: str, options: Options | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Checks every micro-batch of a streaming pairs DataFrame; sink writes its results. A batch that is run again has the same id, so sinks can be idempotent."""
    return pairs.writeStream.foreachBatch(lambda df, n: sink(check(df, options), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by tumbling window and keys; with a stream, rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def latest(snapshots: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return snapshots.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
