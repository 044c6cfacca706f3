"""Handlers of execution runs: functions from a JSON payload to a JSON result, by name, run over tables of runs.

Handlers are pure functions, so that a run whose executor is lost is run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Handler:
    """A function under a durable name; its own name and place do not matter."""

    id: str
    run: Callable[[dict], object]
    plugin: str = "local"
    max_attempts: int = 1
    concurrency_key: str | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.id.strip() or self.max_attempts < 1:
            raise ValueError(f"not valid: {self}")


class Registry:
    def __init__(self, *handlers: Handler):
        self.held: dict[str, Handler] = {}
        for h in handlers:
            self.add(h)

    def add(self, handler: Handler) -> None:
        if handler.id in self.held:
            raise ValueError(f"there is a handler {handler.id!r}")
        self.held[handler.id] = handler

    def handler(self, id: str, **about):
        """Registers a function."""

        def add(f):
            self.add(Handler(id, f, **about))
            return f

        return add

    def execute(self, runs: DataFrame) -> DataFrame:
        """``runs`` (handler_id, payload, attempt) with status, result and error.

        completed, or failed when attempts are used up, else queued again with
        the error; a handler that is not there, or a payload that is no object, is
        rejected.
        """
        held = dict(self.held)

        def one(name: str, payload: str | None, attempt: int) -> tuple[str, str | None, str | None]:
            handler = held.get(name)
            if handler is None:
                return "rejected", None, "unknown_handler"
            try:
                value = json.loads(payload or "")
            except ValueError:
                value = None
            if not isinstance(value, dict):
                return "rejected", None, "invalid_payload"
            try:
                return "completed", json.dumps(handler.run(value), separators=(",", ":"), ensure_ascii=False), None
            except Exception as error:  # noqa: BLE001  whatever a handler raises is its run's failure
                return "failed" if attempt >= handler.max_attempts else "queued", None, str(error)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("handler_id", "payload", "attempt")), strict=True)]
                parts = [pa.array([d[k] for d in done], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, "status", "result", "error"])

        answers = StructType.fromDDL("status string, result string, error string")
        return runs.mapInArrow(run, StructType([*runs.schema.fields, *answers.fields]))
