"""A structured log of runs and their timed steps, as JSON lines that Spark reads back."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from pathlib import Path


class RunLog:
    """Events of one run, appended to a file on the driver; ``sources.tables.read_manifests`` finds them."""

    def __init__(self, folder: str, name: str, **facts):
        self.id = uuid.uuid4().hex[:12]
        self.path = Path(folder) / f"{name}-{self.id}.jsonl"
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.name = name
        self.event("run_start", **facts)

    def event(self, kind: str, **facts) -> None:
        with self.path.open("a") as f:
            f.write(json.dumps({"run": self.id, "name": self.name, "event": kind, "at": round(time.time(), 3), **facts}, default=str) + "\n")

    @contextmanager
    def step(self, name: str, **facts):
        """A step with its time; one that fails is logged and the error goes on."""
        began = time.time()
        self.event("step_start", step=name, **facts)
        try:
            yield self
        except BaseException as e:
            self.event("step_failed", step=name, seconds=round(time.time() - began, 3), error=f"{type(e).__name__}: {e}"[:500])
            raise
        self.event("step_end", step=name, seconds=round(time.time() - began, 3))

    def close(self) -> None:
        self.event("run_end")
