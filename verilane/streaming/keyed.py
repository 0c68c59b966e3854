"""The last verdict of each claim kept as keyed state: a batch costs what it brings, however long the stream has run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

KEYS = ["claim_id", "prompt_version"]
STATE, CHANGED = "support string, line long", "claim_id string, prompt_version string, support string, line long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastVerdict(StatefulProcessor):
    """Keeps the verdict of the highest line of a key; of equal lines the first stays. Returns the key's verdict if it has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._last.get() if self._last.exists() else None
        best = known
        for frame in rows:
            for support, line in frame[["support", "line"]].itertuples(index=False):
                if best is None or line > best[1]:
                    best = (support, line)
        if best is not None and best is not known:
            best = (None if pd.isna(best[0]) else best[0], int(best[1]))
            self._last.update(best)
            yield pd.DataFrame({"claim_id": [key[0]], "prompt_version": [key[1]], "support": [best[0]], "line": [best[1]]})

    def close(self) -> None:
        pass


class Progress(StreamingQueryListener):
    """Batches that brought rows, as (name, batch, rows), and how queries ended."""

    def __init__(self):
        self.batches: list[tuple[str, int, int]] = []
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.batches.append((event.progress.name, event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)


def changes(stream: DataFrame) -> DataFrame:
    """The verdicts of the keys that a batch changes. stream: claim_id, prompt_version, support and line."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=LastVerdict(), outputStructType=CHANGED, outputMode="Update", timeMode="none")


def keep_last(stream: DataFrame, checkpoint: str, path: str, name: str = "verdicts"):
    """A query that appends each batch's changes to path, once, and keeps the last verdicts in its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes(stream).writeStream.queryName(name).outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last verdict of each key, read from the state itself: no batch is read again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark.read.format("statestore").option("stateVarName", "last").load(checkpoint).select("key.*", "value.*")
