"""What streams and queries report while they run."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Handlers(StreamingQueryListener):
    """Calls the functions that are registered for ``started``, ``progress`` and ``ended``; one that fails does not stop the others."""

    KINDS = ("started", "progress", "ended")

    def __init__(self) -> None:
        self.functions: dict[str, list[Callable[[dict], None]]] = {k: [] for k in self.KINDS}
        self.failed: list[Exception] = []

    def on(self, kind: str, function: Callable[[dict], None]) -> Handlers:
        self.functions[kind].append(function)
        return self

    def emit(self, kind: str, event: dict) -> None:
        for f in self.functions[kind]:
            try:
                f(event)
            except Exception as e:  # noqa: BLE001  a handler's own fault
                self.failed.append(e)

    def onQueryStarted(self, event) -> None:
        self.emit("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        self.emit("progress", json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.emit("ended", {"id": str(event.id), "error": event.exception})

    def attached(self, spark: SparkSession) -> Handlers:
        spark.streams.addListener(self)
        return self
