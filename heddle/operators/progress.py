"""Progress of jobs: what each stage of a plan lets through, counted by the job itself.

A stage is a DataFrame observed on its way: its rows and whatever else is asked are counted while they pass, without a job of their own. In a batch job the
counts are there once an action has ended; a stream reports them after each micro-batch to a listener."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Report = Callable[[str, dict], None]


class Progress:
    """Stages of one batch job in the order in which they were named. report: called once for each stage when `finish` is."""

    def __init__(self, report: Report | None = None):
        self.report = report
        self.stages: list[tuple[str, Observation]] = []

    def stage(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df, counting its rows and these aggregates under a name of its own."""
        if name in [n for n, _ in self.stages]:
            raise ValueError(f"there is a stage {name} already")
        seen = Observation()
        self.stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items()))

    def finish(self) -> dict[str, dict]:
        """The counts by stage; waits for the first action on the last stage."""
        out = {name: dict(seen.get) for name, seen in self.stages}
        for name, counts in out.items() if self.report else ():
            self.report(name, counts)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, name and the counts, a row for each stage."""
        rows = [json.dumps({"stage": k, "name": name} | counts) for k, (name, counts) in enumerate(self.finish().items())]
        extra = sorted({k for _, counts in self.finish().items() for k in counts} - {"rows"})
        schema = ", ".join(["stage int", "name string", "rows long", *(f"`{k}` long" for k in extra)])
        return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", schema).alias("x")).select("x.*")


def streamed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """A stage of a stream: its rows and these aggregates go to listeners after each micro-batch."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items()))


class StreamProgress(StreamingQueryListener):
    """Reports of one stream, by its name: for each micro-batch its number, the rows read and the counts of each stage. Use as a context:
    `with StreamProgress(spark, "name") as seen: ...`; `seen.batches` has what has come, `report` is called with each."""

    def __init__(self, spark: SparkSession, name: str, report: Callable[[dict], None] | None = None):
        self.spark, self.name, self.report = spark, name, report
        self.batches: list[dict] = []
        self.ended = threading.Event()
        self._id = None

    def __enter__(self) -> StreamProgress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.wait(30)  # events come after the stream has ended
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._id = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            stages = {k: row.asDict() for k, row in p.observedMetrics.items()}
            self.batches.append({"batch": p.batchId, "read": p.numInputRows, "stages": stages})
            if self.report:
                self.report(self.batches[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._id:
            self.ended.set()
