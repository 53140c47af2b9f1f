"""Extraction jobs: several at a time, taken a document each in turn, to which chunks can be added and which can be cancelled."""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.extract import Adapter, JobStatus, Ontology, run_job
from quillon.operators.graph import Graph


@dataclass
class Job:
    chunks: list[tuple[str, DataFrame]]  # documents that wait: (doc_id, its chunks)
    status: str = "queued"
    done: list[JobStatus] = field(default_factory=list)
    skipped: int = 0


class Jobs:
    """Runs extraction over one graph. The work on a document is one Spark job over its chunks; the driver holds document names alone."""

    def __init__(self, graph: Graph, adapter: Adapter, ontology: Ontology, stored: DataFrame):
        self.graph, self.adapter, self.ontology, self.stored = graph, adapter, ontology, stored
        self.jobs: dict[str, Job] = {}
        self.turn: deque[str] = deque()

    def submit(self, chunks: DataFrame) -> str:
        """A new job's id. Documents are taken in order of their id."""
        name = uuid.uuid4().hex
        self.jobs[name] = Job([])
        self.turn.append(name)
        self.append(name, chunks)
        return name

    def append(self, name: str, chunks: DataFrame) -> None:
        """More chunks for a job that isn't over."""
        job = self.jobs[name]
        if job.status not in ("queued", "running"):
            raise ValueError(f"the job is {job.status}")
        docs = [r["doc_id"] for r in chunks.select("doc_id").distinct().orderBy("doc_id").collect()]
        job.chunks += [(d, chunks.filter(F.col("doc_id") == d)) for d in docs]

    def cancel(self, name: str) -> None:
        """What waits is skipped; what is done stays."""
        job = self.jobs[name]
        if job.status in ("queued", "running"):
            job.skipped, job.chunks, job.status = len(job.chunks), [], "cancelled"

    def step(self) -> bool:
        """Takes the next document of the job whose turn it is; False if nothing waits."""
        for _ in range(len(self.turn)):
            name = self.turn[0]
            self.turn.rotate(-1)
            job = self.jobs[name]
            if not job.chunks:
                continue
            job.status = "running"
            _, rows = job.chunks.pop(0)
            self.graph, self.stored, _, status = run_job(self.graph, rows, self.stored, self.adapter, self.ontology)
            job.done.append(status)
            if not job.chunks:
                bad, n = sum(s.failed for s in job.done), sum(s.total for s in job.done)
                job.status = "completed" if not bad else "failed" if bad == n else "completed_with_errors"
            return True
        return False

    def run(self) -> None:
        while self.step():
            pass

    def status(self, name: str) -> dict[str, object]:
        job = self.jobs[name]
        sums = {k: sum(getattr(s, k) for s in job.done) for k in ("total", "done", "failed", "input_tokens", "output_tokens")}
        return {"status": job.status, "waiting": len(job.chunks), "skipped": job.skipped, **sums, "errors": [e for s in job.done for e in s.errors][:100]}
