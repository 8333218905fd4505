"""Running a pipeline: a chain of operators, then sinks, per micro-batch, with progress by sink."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Sink:
    id: str
    write: Callable[[DataFrame, int], DataFrame | None]  #: gives the rows that failed, if any
    required: bool = True
    takes: Step | None = None
    deadline_s: float = 300


@dataclass
class Progress:
    """Last batch by (pipeline, sink), in a JSON file that is replaced as a whole."""

    path: str
    held: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if os.path.exists(self.path):
            with open(self.path) as f:
                self.held = json.load(f)

    def last(self, pipeline: str, sink: str) -> int:
        return self.held.get(f"{pipeline}/{sink}", -1)

    def commit(self, pipeline: str, sink: str, batch: int) -> None:
        self.held[f"{pipeline}/{sink}"] = batch
        temporary = f"{self.path}.new"
        with open(temporary, "w") as f:
            json.dump(self.held, f)
        os.replace(temporary, self.path)


class SharedProgress(Progress):
    """The same in a file wherever Spark can write, so that a driver on another machine finds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.held = spark, path, {}
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at, self._new, self._old = hadoop.Path(path), hadoop.Path(f"{path}.new"), hadoop.Path(f"{path}.old")
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        for at in (self._at, self._old):  # between the two renames of a commit only the old file is there
            if self._files.exists(at):
                self.held = json.loads(self._read(at))
                break

    def _read(self, at) -> str:
        stream = self._files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, pipeline: str, sink: str, batch: int) -> None:
        self.held[f"{pipeline}/{sink}"] = batch
        stream = self._files.create(self._new, True)
        try:
            stream.write(bytearray(json.dumps(self.held).encode()))
        finally:
            stream.close()
        if self._files.exists(self._at):
            self._files.delete(self._old, False)
            self._files.rename(self._at, self._old)
        self._files.rename(self._new, self._at)


def _started(run: Callable[[], bool]) -> Future:
    """Runs in a thread of its own that ends with the process, and that nobody has to wait for."""
    job: Future = Future()

    def body() -> None:
        try:
            job.set_result(run())
        except BaseException as e:
            job.set_exception(e)

    thread = InheritableThread(target=body)
    thread.daemon = True
    thread.start()
    return job


class CommitError(Exception):
    pass


@dataclass
class Pipeline:
    name: str
    steps: Sequence[Step]
    sinks: Sequence[Sink]
    progress: Progress
    policy: str = "required"
    quorum: int = 1
    dead_letters: Callable[[DataFrame, str, int], None] | None = None

    def transform(self, events: DataFrame) -> DataFrame:
        for step in self.steps:
            events = step(events)
        return events

    def committed(self, acks: dict[str, bool]) -> bool:
        if self.policy == "all":
            return all(acks.get(s.id, False) for s in self.sinks)
        if self.policy == "required":
            return all(acks.get(s.id, False) for s in self.sinks if s.required)
        return sum(acks.values()) >= self.quorum

    def run_batch(self, events: DataFrame, batch: int) -> dict[str, bool]:
        """Every sink gets the same rows, at the same time. A sink that already has the batch is skipped, and one that isn't done by its
        deadline has failed: its jobs are cancelled, and nothing waits for it. If the policy isn't met the batch fails and comes again, to all
        sinks that hadn't committed it before."""
        # Serialized, so compressed: a partition's block is read as a whole by each sink's task, and a source that can't be split is one partition.
        frozen = self.transform(events).persist(StorageLevel.MEMORY_AND_DISK)
        context = frozen.sparkSession.sparkContext
        errors: dict[str, Exception] = {}
        tags = {s.id: f"sink-{uuid.uuid4().hex}" for s in self.sinks}

        def one(sink: Sink) -> bool:
            if self.progress.last(self.name, sink.id) >= batch:
                return True
            context.addJobTag(tags[sink.id])
            try:
                bad = sink.write(sink.takes(frozen) if sink.takes else frozen, batch)
                if bad is not None and self.dead_letters:
                    self.dead_letters(bad, sink.id, batch)
                return True
            except Exception as e:  # one sink's failure is the policy's matter
                errors[sink.id] = e
                return False

        try:
            ends = {s.id: time.monotonic() + s.deadline_s for s in self.sinks}
            jobs = {s.id: _started(lambda s=s: one(s)) for s in self.sinks}
            acks = {}
            for sid, job in jobs.items():
                try:
                    acks[sid] = job.result(timeout=max(0.0, ends[sid] - time.monotonic()))
                except TimeoutError as e:
                    acks[sid], errors[sid] = False, e
                    context.cancelJobsWithTag(tags[sid])
        finally:
            frozen.unpersist()
        if not self.committed(acks):
            raise CommitError(f"batch {batch}: {policy_text(self.policy, acks)}") from next(iter(errors.values()), None)
        for sid, ok in acks.items():
            if ok:
                self.progress.commit(self.name, sid, batch)
        return acks

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        writer = stream.writeStream.queryName(self.name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.run_batch(df, n) and None)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def policy_text(policy: str, acks: dict[str, bool]) -> str:
    return f"policy {policy} isn't met by {acks}"


@dataclass
class Manager:
    """Pipelines by name: start, stop, pause (stop and keep the checkpoint), resume, replace."""

    checkpoints: str
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    known: dict[str, tuple[Pipeline, Callable[[], DataFrame]]] = field(default_factory=dict)

    def start(self, pipeline: Pipeline, source: Callable[[], DataFrame], every: str | None = None) -> StreamingQuery:
        self.known[pipeline.name] = (pipeline, source)
        self.running[pipeline.name] = pipeline.start(source(), os.path.join(self.checkpoints, pipeline.name), every)
        return self.running[pipeline.name]

    def pause(self, name: str) -> None:
        self.running.pop(name).stop()

    def resume(self, name: str, every: str | None = None) -> StreamingQuery:
        return self.start(*self.known[name], every)

    def stop(self, name: str) -> None:
        if name in self.running:
            self.pause(name)
        self.known.pop(name, None)

    def status(self) -> dict[str, str]:
        return {n: "running" if n in self.running and self.running[n].isActive else "paused" for n in self.known}
