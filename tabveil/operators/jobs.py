"""Running an action with progress and a way to cancel it, by the tags that Spark gives jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class Job:
    """An action in a thread of its own. on_progress gets (tasks done, tasks known) about every interval seconds, and
    once at the end; on_rows gets the rows written so far, each time that every more are, and at the end. Both are what
    Spark counts for the jobs of this action alone; rows count when their task is done. Exceptions of the action come
    out of result()."""

    def __init__(
        self, spark: SparkSession, action: Callable[[], object], on_progress: Callable[[int, int], None] | None = None, interval: float = 1.0,
        on_rows: Callable[[int], None] | None = None, every: int = 10_000,
    ):
        self.tag, self._spark, self._action, self._tell, self._interval = f"job-{uuid.uuid4().hex}", spark, action, on_progress, interval
        self._tell_rows, self._every, self._told = on_rows, every, 0
        self._value = self._error = None
        self._cancelled, self._over = threading.Event(), threading.Event()
        threading.Thread(target=self._run, daemon=True).start()
        threading.Thread(target=self._watch, daemon=True).start()

    def _run(self) -> None:
        self._spark.addTag(self.tag)
        self._spark.sparkContext.addJobTag(self.tag)
        try:
            self._value = self._action()
        except BaseException as e:
            self._error = e
        finally:
            self._spark.removeTag(self.tag)
            self._spark.sparkContext.removeJobTag(self.tag)
            self._over.set()

    def _stages(self) -> set[int]:
        """Of the jobs that this action has started."""
        context = self._spark.sparkContext
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in context._jsc.sc().statusTracker().getJobIdsForTag(self.tag)]
        return {s for j in jobs if j for s in j.stageIds}

    def progress(self) -> tuple[int, int]:
        tracker, done, known = self._spark.sparkContext.statusTracker(), 0, 0
        for stage in self._stages():
            if info := tracker.getStageInfo(stage):
                done, known = done + info.numCompletedTasks, known + info.numTasks
        return done, known

    def rows_written(self) -> int:
        store, rows = self._spark.sparkContext._jsc.sc().statusStore(), 0
        for stage in self._stages():
            try:
                rows += store.lastStageAttempt(stage).outputRecords()
            except Py4JError:  # a stage that has not begun
                continue
        return rows

    def _say_rows(self, last: bool = False) -> None:
        if self._tell_rows:
            rows = self.rows_written()
            if rows // self._every > self._told // self._every or (last and rows > self._told):
                self._told = rows
                self._tell_rows(rows)

    def _watch(self) -> None:
        while not self._over.wait(self._interval):
            if self._tell:
                self._tell(*self.progress())
            self._say_rows()
        self._spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # so that the last tasks are counted
        self._say_rows(last=True)
        if self._tell and not self._error:
            self._tell(1, 1)

    def cancel(self) -> None:
        """Stops the action's running jobs and those it would start next."""
        self._cancelled.set()
        while not self._over.wait(0.2):
            self._spark.interruptTag(self.tag)

    def result(self, timeout: float | None = None):
        if not self._over.wait(timeout):
            raise TimeoutError("the job still runs")
        if self._cancelled.is_set() and self._error:
            raise Cancelled("the job was cancelled") from None
        if self._error:
            raise self._error
        return self._value
