"""Structured Streaming over landed files: micro-batches through a batch plan, and count batches kept in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillflow.streaming.http import with_meta


def landed_stream(spark: SparkSession, folder: str, schema: str = "seq long, item string", files_per_batch: int = 1000) -> DataFrame:
    """The stream of JSON files in a folder, as envelopes; each file is read once."""
    return with_meta(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").json(folder))


def run_stream(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Each micro-batch goes through the batch plan to Parquet in ``out/batch=<id>``.

    A batch that is repeated after a failure replaces its own folder, so every input
    file counts once. With ``available_now`` the query ends when the input is used up;
    stopping the query and starting it again goes on at the checkpoint.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        plan(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


class _CountBatches(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "item string")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        items = [x[0] for x in self.waiting.get()]
        for pdf in rows:
            items += pdf.sort_values("seq")["item"].tolist()
        made = self.made.get()[0] if self.made.exists() else 0
        out = []
        while len(items) >= self.n:
            out.append((key[0], made, items[: self.n]))
            items, made = items[self.n :], made + 1
        if items:
            self.waiting.put([(x,) for x in items])
        else:
            self.waiting.clear()
        self.made.update((made,))
        if out:
            yield pd.DataFrame(out, columns=["key", "batch", "items"])

    def close(self) -> None:
        pass


def stateful_batches(stream: DataFrame, n: int, key: str) -> DataFrame:
    """Full count batches of n items for each key, over micro-batches: (key, batch, items).

    A short rest stays in state until more arrives. The state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=_CountBatches(n), outputStructType="key string, batch long, items array<string>", outputMode="append", timeMode="None")
