"""Jobs of named steps with declared inputs and outputs, which take up finished steps when they run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import commits
from .steps import cleared, file_system


def state_of(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of the files of a path, hidden ones left out: what tells an input from a changed one."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(at).isDirectory():
        s = fs.getFileStatus(at)
        return [[at.getName(), s.getLen(), s.getModificationTime()]]
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith((".", "_")):
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


class Job:
    """A run of a command over inputs, in a folder that keeps what its steps made.

    A step is known by its name, the job's parameters and the state of its inputs: the same job taken up after a failure
    reads what finished steps made, a job with other inputs makes all anew. Steps are committed once, so two runs at a time
    agree. Inputs that are missing are all told before any work.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, inputs: dict[str, str | None], **parameters):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        inputs = {k: v for k, v in inputs.items() if v}
        states, missing = {}, []
        for key, path in inputs.items():
            try:
                states[key] = state_of(spark, path)
            except FileNotFoundError:
                missing.append(f"{key}: {path}")
        if missing:
            raise FileNotFoundError("missing inputs: " + ", ".join(missing))
        told = json.dumps([name, parameters, states], sort_keys=True, default=str)
        self.mark = hashlib.sha256(told.encode()).hexdigest()[:16]
        self.inputs = inputs
        self.made: list[str] = []
        self.found: list[str] = []

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What a step makes, from the folder if it is finished."""
        key = f"{self.name}-{name}-{self.mark}"
        known = commits.committed(self.spark, self.folder, key)
        (self.made if known is None else self.found).append(name)
        if known is not None:
            return known
        with cleared(self.spark):  # what the step wrote on its way isn't needed once its result is committed
            return commits.commit(make(), self.folder, key)

    def effect(self, name: str, make: Callable[[], dict]) -> dict:
        """What a step that writes outside of the folder tells, a few words of JSON, from the folder if it is finished. Such a
        step may be run again after a failure: it must give the same then."""
        marker = f"{self.folder}/{commits.MARKERS}/{self.name}-{name}-{self.mark}.json"
        if (text := commits.read_text(self.spark, marker)) is None:
            self.made.append(name)
            commits.create(self.spark, marker, json.dumps(make()))
            text = commits.read_text(self.spark, marker)
        else:
            self.found.append(name)
        return json.loads(text)

    def finished(self) -> list[str]:
        """The steps of this job, with these inputs, that are finished."""
        head, tail = f"{self.name}-", f"-{self.mark}"
        return [k[len(head) : -len(tail)] for k in commits.keys(self.spark, self.folder) if k.startswith(head) and k.endswith(tail)]
