"""Event-time velocity counters and freshness for streams.

Late events are counted, yet kept: Spark's watermark alone would drop them, so
a processor with its own state does the counting. The watermark here only
tells late from on time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, event_time timestamp, ingest_time timestamp, on_time boolean, n_1h bigint, n_24h bigint, n_7d bigint"
WINDOWS = (3600, 86400, 604800)


class VelocityProcessor(StatefulProcessor):
    """Per key: events of the last week by event time, and the latest event time seen."""

    def __init__(self, lateness_seconds: int = 300, keep_seconds: int = WINDOWS[-1]):
        self.lateness = lateness_seconds
        self.keep = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "event_us bigint, ingest_us bigint")
        self.latest = handle.getValueState("latest", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.events.get()]
        latest = self.latest.get()[0] if self.latest.exists() else None
        new = pd.concat(list(rows)).sort_values(["ingest_time", "event_time"])
        out = []
        for r in new.itertuples(index=False):
            e, i = int(r.event_time.value // 1000), int(r.ingest_time.value // 1000)
            on_time = latest is None or e >= latest - self.lateness * 1_000_000
            latest = e if latest is None else max(latest, e)
            held.append((e, i))
            counts = [sum(1 for a, b in held if e - w * 1_000_000 <= a <= e and b <= i) for w in WINDOWS]
            out.append((key[0], r.event_time, r.ingest_time, on_time, *counts))
        # Only what no window of an event within the lateness can reach is forgotten.
        oldest = latest - (self.keep + self.lateness) * 1_000_000
        held = [x for x in held if x[0] >= oldest]
        self.events.put(held)
        self.latest.update((latest,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def counted(stream: DataFrame, lateness_seconds: int = 300) -> DataFrame:
    """Velocity counts as each event arrives. stream: key, event_time, ingest_time. Needs the RocksDB state store."""
    return stream.select("key", "event_time", "ingest_time").groupBy("key").transformWithStateInPandas(VelocityProcessor(lateness_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="none")


def windowed(stream: DataFrame, every: str = "1 hour", lateness: str = "5 minutes") -> DataFrame:
    """Counts and sums per key and window; rows beyond the watermark are dropped."""
    return stream.withWatermark("event_time", lateness).groupBy(F.window("event_time", every), "key").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def deduplicated(stream: DataFrame, id_: str = "event_id", lateness: str = "5 minutes") -> DataFrame:
    """Each event once, by its idempotency key."""
    return stream.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([id_])


def freshness(rows: DataFrame, limit_seconds: float = 60.0) -> DataFrame:
    """Nearest-rank 99th percentile of the lag from event to arrival, and whether it keeps the limit. Negative lags are errors."""
    from granary.operators.joins import nearest_rank_of

    lag = F.unix_micros("ingest_time") - F.unix_micros("event_time")
    lags = rows.select(F.when(lag < 0, F.raise_error(F.lit("an event arrived before it happened"))).otherwise(lag / 1e6).alias("lag"))
    return nearest_rank_of(lags, "lag", [0.99]).select(F.col("value").alias("p99"), (F.col("value") < limit_seconds).alias("passed"))
