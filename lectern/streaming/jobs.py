"""Jobs followed by their status events, until they end, are cancelled or run out of time.

What decides is the earliest, by the events' own time, of: a status that ends the job, a cancel, and
the deadline counted from the job's first event. Events may come in any order, so nothing is told
before the watermark has passed the time of the decision; then no earlier event can come any more.
``outcomes`` says the same of a table of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions import records as R

CANCEL, STOPPED, TIMEOUT = "cancel", "stopped", "timeout"
OUTCOME = "job_id long, outcome string, decided_ms long"
#: How many groups jobs are followed in: a key of the state stands for the jobs of one.
GROUPS = 1024
_OPEN = "job_id array<long>, first_ms array<long>, ends_ms array<long>, outcome array<string>"
_TOLD = "job_id array<long>"


def told(events: DataFrame) -> DataFrame:
    """Events (job_id, at, status) with what each decides (null: nothing): cancels stop, others by their status.

    An event without time says nothing.
    """
    outcome = F.when(F.col("status") == CANCEL, STOPPED).otherwise(R.outcome(F.col("status")))
    return events.where(F.col("at").isNotNull()).select("job_id", "at", F.unix_millis("at").alias("ms"), F.when(outcome != "pending", outcome).alias("outcome"))


def outcomes(events: DataFrame, limit_ms: int, delay_ms: int = 0) -> DataFrame:
    """Jobs decided before the last event's time less ``delay_ms``: job_id, outcome, decided_ms."""
    own = told(events)
    now = own.agg((F.max("ms") - delay_ms).alias("now"))  # one row
    first = own.groupBy("job_id").agg(F.min("ms").alias("first"), F.min(F.when(F.col("outcome").isNotNull(), F.struct("ms", "outcome"))).alias("e"))
    deadline = F.col("first") + limit_ms
    ended = F.coalesce(F.col("e.ms") <= deadline, F.lit(False))
    out = first.select("job_id", F.when(ended, F.col("e.outcome")).otherwise(TIMEOUT).alias("outcome"), F.when(ended, F.col("e.ms")).otherwise(deadline).alias("decided_ms"))
    return out.join(F.broadcast(now), F.col("decided_ms") < F.col("now")).select("job_id", "outcome", "decided_ms")


class JobWatch(StatefulProcessor):
    """What is known of a group's jobs, and one timer at the earliest decision that is still to be told.

    A key's state and timers are asked for over a socket, call by call, which costs far more than the
    jobs' own work; so a key stands for many jobs, and its state is read and written once a batch.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open, self.told = handle, handle.getValueState("open", _OPEN), handle.getValueState("told", _TOLD)

    def _read(self) -> tuple[dict[int | None, list], set[int | None]]:
        """Jobs not yet told: their first event, the earliest that ends them and how; and those told."""
        held, told = self.open.get(), self.told.get()
        return {job: list(own) for job, *own in zip(*held)} if held else {}, set(told[0]) if told else set()

    def _keep(self, jobs: dict[int | None, list]) -> None:
        columns = [list(c) for c in zip(*((job, *own) for job, own in jobs.items()))]
        self.open.update(tuple(columns or ([], [], [], [])))

    def _decision(self, first: int, ends: int | None, outcome: str | None) -> tuple[int, str]:
        deadline = first + self.limit_ms
        return (ends, outcome) if ends is not None and ends <= deadline else (deadline, TIMEOUT)

    def _wake(self, jobs: dict[int | None, list]) -> None:
        """Sets the timer to the earliest decision."""
        if jobs:
            self.handle.registerTimer(min(self._decision(*own)[0] for own in jobs.values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        jobs, told = self._read()
        for part in rows:
            ids = part["job_id"].tolist() if key[0] >= 0 else [None] * len(part)
            for job, ms, own in zip(ids, part["ms"].tolist(), part["outcome"].tolist()):
                if job in told:
                    continue
                known = jobs.setdefault(job, [ms, None, None])
                known[0] = min(known[0], ms)
                if own is not None and own == own and (known[1] is None or (ms, own) < (known[1], known[2])):
                    known[1:] = ms, own
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self._wake(jobs)
        self._keep(jobs)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        jobs, told = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        found = [(job, said, at) for job, own in jobs.items() for at, said in [self._decision(*own)] if at < now]
        for job, _, _ in found:
            del jobs[job]
        self._wake(jobs)
        self._keep(jobs)
        self.told.update((sorted(told.union(job for job, _, _ in found), key=lambda job: job or 0),))
        if found:
            yield pd.DataFrame(found, columns=["job_id", "outcome", "decided_ms"]).astype({"job_id": "Int64"})

    def close(self) -> None:
        pass


def followed(events: DataFrame, limit_ms: int, delay_ms: int = 0, groups: int = GROUPS) -> DataFrame:
    """Decided jobs of a stream of events (job_id, at, status): job_id, outcome, decided_ms.

    ``groups`` must stay the same as long as a checkpoint is used.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = told(events.withWatermark("at", f"{delay_ms} milliseconds"))
    # events without job have a group of their own
    group = F.when(F.col("job_id").isNotNull(), F.pmod(F.xxhash64("job_id"), F.lit(groups))).otherwise(-1)
    own = own.withColumns({"group": group, "job_id": F.coalesce("job_id", F.lit(0))})
    return own.groupBy("group").transformWithStateInPandas(JobWatch(limit_ms), OUTCOME, "Append", "EventTime")


def follow(events: DataFrame, out: str, checkpoint: str, limit_ms: int, delay_ms: int = 0) -> DataFrame:
    """Runs a stream of events to what has come by now; decided jobs go to the table at ``out``, which is returned."""
    spark: SparkSession = events.sparkSession
    followed(events, limit_ms, delay_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTCOME).parquet(out)
