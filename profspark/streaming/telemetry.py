"""Counters of a running stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from profspark.schema import RAW_TYPES

METRICS = "raw_events"


def observed(stream: DataFrame) -> DataFrame:
    """Count the raw events of each type on their way, without another pass."""
    counts = [F.count(F.when(F.col("type") == t, 1)).alias(t) for t in RAW_TYPES]
    return stream.observe(METRICS, F.count(F.lit(1)).alias("total"), *counts)


class Statistics(StreamingQueryListener):
    """Receives the counts of each micro-batch; ``deltas`` holds the latest ones."""

    def __init__(self, keep: int = 100):
        self.keep = keep
        self.deltas: list[dict[str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is not None:
            self.deltas = [*self.deltas, {k: v for k, v in row.asDict().items() if v}][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
