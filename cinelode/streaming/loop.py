"""The micro-batch loop: one sync each turn, the slower jobs every few turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def every(stream: DataFrame, jobs: list[tuple[int, Callable[[DataFrame], None]]], checkpoint: str, period: str | None = "15 minutes") -> StreamingQuery:
    """Run each (n, job) on every n-th micro-batch; ``period`` None runs what is there and stops.

    A job sees the batch's rows; the batch number decides which jobs run, so a restarted query repeats the same ones.
    """

    def turn(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for n, job in jobs:
                if number % n == 0:
                    job(batch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if period is None else writer.trigger(processingTime=period)).start()
