"""Cooldown and topic drift as keyed state of a stream: a state store and timers in place of a pass over the past.

``cooldowns`` keeps, for each (monitor, topic, kind), the day that last fired and the days that wait for their turn. A day
is decided when the watermark has passed it, in order of days whatever the order of arrival, so a day may come ``late``
days after others; later ones are dropped by the watermark. ``drifts`` keeps, for each topic, the moving centroid,
how far vectors lay from it and how many there were; it starts from the topics' table and takes a batch's vectors in
order of their id. Both survive a restart through the checkpoint, and hold one small row for each key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DateType, DoubleType, LongType, StructField, StructType

from tidemark.operators.series import COOLDOWN

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An event of this kind only moves the watermark: a source that has no more to come sends one.
CLOSE = "__close__"
_DAY = 86_400_000


class Cooldown(StatefulProcessor):
    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("on", DateType())]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("on", DateType())]), StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[2] != CLOSE:
            for part in rows:
                for on in set(part["detected_on"]):
                    if not self.waiting.containsKey((on,)):
                        self.waiting.updateValue((on,), (1,))
                        self.handle.registerTimer(int(dt.datetime.combine(on, dt.time(), dt.timezone.utc).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).date()
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= until)
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for on in due:
            self.waiting.removeKey((on,))
            if last is None or (on - last).days >= self.days:
                last = on
                fired.append((*key, on))
        if fired:
            self.last.update((last,))
            yield pd.DataFrame(fired, columns=["monitor_id", "topic_id", "kind", "detected_on"])

    def close(self) -> None:
        pass


def cooldowns(found: DataFrame, days: int = COOLDOWN, late: int = 2) -> DataFrame:
    """Of a stream (monitor_id, topic_id, kind, detected_on): which days fire, each at rest for ``days`` after one that fired."""
    keys = ["monitor_id", "topic_id", "kind"]
    seen = found.select(*keys, "detected_on", F.col("detected_on").cast("timestamp").alias("at")).withWatermark("at", f"{late} days")
    schema = StructType([*[StructField(k, found.schema[k].dataType) for k in keys], StructField("detected_on", DateType())])
    return seen.groupBy(*keys).transformWithStateInPandas(Cooldown(days), schema, "Append", "EventTime")


class Drift(StatefulProcessor):
    def __init__(self, rate: float, topic: StructField):
        self.rate, self.topic = rate, topic

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("topic", StructType([StructField("centroid", ArrayType(DoubleType())), StructField("start", ArrayType(DoubleType())), StructField("score", DoubleType()), StructField("n", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        start = [float(x) for x in initialState["centroid"].iloc[0]]
        self.state.update((start, start, 0.0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return  # no such topic
        new = pd.concat(list(rows)).sort_values("vec_id")
        centroid, start, score, n = self.state.get()
        c = np.array(centroid, float)
        for x in new["embedding"]:
            x = np.asarray(x, float)
            score += self.rate * float(np.linalg.norm(c - x))
            c = (1 - self.rate) * c + self.rate * x
        n += len(new)
        self.state.update((c.tolist(), list(start), score, n))
        yield pd.DataFrame({"topic_id": [key[0]], "doc_count": [n], "drift_score": [score], "moved": [float(np.linalg.norm(c - np.array(start)))], "centroid": [c.tolist()]})

    def close(self) -> None:
        pass


def drifts(assigned: DataFrame, topics: DataFrame, rate: float = 0.02) -> DataFrame:
    """Of a stream (topic_id, vec_id, embedding): topic_id, doc_count, drift_score, moved, centroid after each batch that a topic takes part in."""
    topic = assigned.schema["topic_id"]
    schema = StructType([StructField("topic_id", topic.dataType), StructField("doc_count", LongType()), StructField("drift_score", DoubleType()), StructField("moved", DoubleType()), StructField("centroid", ArrayType(DoubleType()))])
    start = topics.select("topic_id", F.transform("centroid", lambda x: x.cast("double")).alias("centroid")).groupBy("topic_id")
    vectors = assigned.select("topic_id", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return vectors.groupBy("topic_id").transformWithStateInPandas(Drift(rate, topic), schema, "Update", "None", start)


def take_in(stream: DataFrame, root: str, mode: str) -> None:
    """Process what has landed and stop; ``root`` holds the results (one folder a batch) and the checkpoint to go on from.

    Keyed state with timers needs a store of its own kind, which keeps state on disk, not in the executors' heap; the
    session's setting comes back afterwards.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    try:
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(_STORE, before)


def results(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows of all batches, with ``batch``."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{root}/out")
