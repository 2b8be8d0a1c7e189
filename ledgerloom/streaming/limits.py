"""Sliding-window rate limiting, as a batch window and as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.lineage import shared_folder

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def over_limit(requests: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """Each request with the number of its user's requests in the `seconds` up to it, and whether that exceeds `most`."""
    back = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return requests.withColumn("recent", F.count(F.lit(1)).over(back)).withColumn("limited", F.col("recent") > most)


def limited_windows(requests: DataFrame, most: int = 10, seconds: int = 60, slide: int = 10, late: str = "2 minutes") -> DataFrame:
    """For a stream: users and sliding windows with more than `most` requests; late rows up to `late` are counted."""
    spans = requests.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "user_id")
    return spans.agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > most)


class Limiter(StatefulProcessor):
    """One user's requests, counted exactly once no earlier one can come any more.

    Requests wait until the watermark has passed them, so late ones take their place in time. Then each is counted with
    those in the `seconds` up to it. What is kept is the waiting requests and the times of the last `seconds`; a user
    without either has no state. With `refusing` a request over the limit is not counted against later ones.
    """

    def __init__(self, most: int, seconds: int, refusing: bool):
        self.most, self.span, self.refusing = most, seconds * 1_000_000, refusing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long")
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(None if pd.isna(e) else int(e), int(a)) for frame in rows for e, a in zip(frame["event_id"], frame["at"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(a for _, a in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((a, e) for e, a in self.waiting.get()), key=lambda w: w[0])
        due, later = [w for w in waiting if w[0] <= until], [w for w in waiting if w[0] > until]
        if due:
            recent = [r[0] for r in self.recent.get()]
            counts, recent = self.counted([a for a, _ in due], recent)
            yield pd.DataFrame({"event_id": pd.array([e for _, e in due], dtype="Int64"), "user_id": pd.array([None if pd.isna(key[0]) else int(key[0])] * len(due), dtype="Int64"), "recent": counts, "limited": [n > self.most for n in counts]})
            _put(self.waiting, [(e, a) for a, e in later])
            _put(self.recent, [(a,) for a in recent])
        elif self.recent.exists():
            _put(self.recent, [r for r in self.recent.get() if r[0] > until - self.span])
        # times are forgotten once they are too old to count
        ahead = [a for a, _ in later[:1]] + [r[0] + self.span for r in ([] if not self.recent.exists() else self.recent.get())][-1:]
        if ahead:
            self.handle.registerTimer(max(min(ahead), until) // 1000 + 1)

    def counted(self, due: list[int], recent: list[int]) -> tuple[list[int], list[int]]:
        """For each time, in order, the number of requests in the span up to it, itself included; and the times that still count."""
        held, counts = sorted(recent), []
        if self.refusing:
            for a in due:
                held = [h for h in held if h > a - self.span]
                counts.append(len(held) + 1)
                if len(held) < self.most:
                    held.append(a)
        else:
            every, first, last = sorted(held + due), 0, 0
            for a in due:
                while every[first] <= a - self.span:
                    first += 1
                while last < len(every) and every[last] <= a:
                    last += 1
                counts.append(last - first)
            held = every
        return counts, [h for h in held if h > due[-1] - self.span]

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def limited_stream(requests: DataFrame, most: int = 10, seconds: int = 60, late: str = "2 minutes", refusing: bool = False) -> DataFrame:
    """`over_limit` on a stream, row by row: event_id, user_id, recent, limited of each request that is up to `late` late.

    Rows come out once the watermark has passed them. The session must keep state in `STORE`. With `refusing` a request
    that is over the limit doesn't count for later ones, as a server that turns it away counts.
    """
    seen = requests.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = seen.withColumn("at", F.unix_micros("ts")).groupBy("user_id")
    return rows.transformWithStateInPandas(Limiter(most, seconds, refusing), "event_id long, user_id long, recent long, limited boolean", "Append", "EventTime")


def limited_files(requests: DataFrame, most: int, seconds: int, late: str = "0 seconds", refusing: bool = False) -> DataFrame:
    """The stream's result for a table of requests, which is replayed through files in the shared folder."""
    spark = requests.sparkSession
    folder = f"{shared_folder(spark)}/limits-{uuid.uuid4().hex}"
    rows = requests.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    # a last request of a user of its own moves the watermark past all others
    last = rows.agg((F.coalesce(F.max("user_id"), F.lit(0)) + 1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    nobody = last.first().user_id
    mark = last.select(F.lit(None).cast("long").alias("event_id"), "user_id", "ts")
    rows.unionByName(mark.where("ts is not null")).write.parquet(f"{folder}/in")
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{folder}/in")
        found = limited_stream(stream, most, seconds, late, refusing).where(F.col("user_id").isNull() | (F.col("user_id") != nobody))
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema("event_id long, user_id long, recent long, limited boolean").parquet(f"{folder}/out")
