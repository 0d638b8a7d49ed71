"""Streams: a source resumed by a cursor, idempotent enqueueing and the incremental fold."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from quillon.operators import sinks
from quillon.operators.claims import alias_closure, fold_since


class _Reader(SimpleDataSourceStreamReader):
    """Windows of at most ``max_events`` events of a JSON-lines log, in the log's order.

    The offset is the byte behind the last line that was read, with the time of
    the newest event: equal times, late events and a window's end between two of
    them lose nothing, and no batch reads the log from its start.  A line that the
    writer has not finished is left for the next batch.  ``since`` skips events up to that time.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("max_events", 500))
        self.since = int(options.get("since", -1))

    def initialOffset(self) -> dict:
        return {"byte": 0, "cursor": self.since}

    def _events(self, start: int, end: int | None, most: int) -> tuple[list[tuple[int, str]], int]:
        rows: list[tuple[int, str]] = []
        with open(self.path, "rb") as f:
            f.seek(start)
            at = start
            while most > 0 and (end is None or at < end):
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                at += len(line)
                try:
                    time = int(json.loads(line)["time_us"])
                except (ValueError, KeyError, TypeError):
                    continue
                if time > self.since:
                    rows.append((time, line.decode("utf-8").strip()))
                    most -= 1
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._events(start["byte"], None, self.most)
        return iter(rows), {"byte": at, "cursor": max([start["cursor"], *(t for t, _ in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._events(start["byte"], end["byte"], 1 << 60)[0])


class EventLog(DataSource):
    """``format("event_log")``: events in cursor order from a log that may be replayed from any cursor."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "cursor long, value string"

    def simpleStreamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def events(spark: SparkSession, path: str, max_events: int = 500) -> DataFrame:
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").option("path", path).option("max_events", str(max_events)).load()


def enqueue_stream(stream: DataFrame, mapping: Callable[[DataFrame], DataFrame], queue: str, checkpoint: str, connector: str):
    """Map micro-batches and enqueue them; a replayed batch adds nothing, as known keys are ignored."""
    def batch(df: DataFrame, _: int) -> None:
        sinks.enqueue(mapping(df), queue, connector)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project(spark: SparkSession, claims: str, ledger: DataFrame, target: str, state: str, *, full: bool = False) -> int:
    """Fold claims after the watermark into the entity table; gives the number of claims read.

    The entities are published before the watermark moves, so a crash between
    the two repeats an idempotent step.  Without new claims nothing is folded.
    """
    log = spark.read.parquet(claims)
    mark = -1
    if not full and sinks.versions(spark, state):
        mark = sinks.read_or_none(spark, state).agg(F.max("seq")).first()[0]
    new = log.where(F.col("seq") > mark).agg(F.count(F.lit(1)), F.max("seq")).first()
    if not new[0]:
        return 0
    from quillon.operators.claims import alias_map

    closure = alias_closure(alias_map(ledger))
    fresh = fold_since(log, closure, mark)
    old = None if full else sinks.read_or_none(spark, target)
    if old is not None:
        moved = closure.select(F.col("alias").alias("id"))
        fresh = fresh.unionByName(old.join(fresh.select("id"), "id", "left_anti").join(moved, "id", "left_anti"))
    sinks.replace(fresh, target)
    sinks.replace(spark.createDataFrame([(int(new[1]),)], "seq long"), state)
    return int(new[0])
