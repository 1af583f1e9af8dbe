"""Progress and diagnostics from the plan itself: observed counts of a run and a listener of streams.

Counters are aggregates that Spark gathers with the rows that pass, so they hold for all executors and count a task once that was tried
twice; no worker keeps any of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

CALLS = {
    "calls": F.count, "failures": lambda _: F.count("error"), "input_tokens": lambda _: F.coalesce(F.sum("input_tokens"), F.lit(0)), "output_tokens": lambda _: F.coalesce(F.sum("output_tokens"), F.lit(0)),
    "unmetered": lambda _: F.count_if(F.col("input_tokens").isNull() & F.col("error").isNull()),
}


def call_counters() -> list[Column]:
    """Counters of model calls (columns error, input_tokens, output_tokens)."""
    return [f(F.lit(1)).alias(name) for name, f in CALLS.items()]


def observed(df: DataFrame, name: str, *counters: Column) -> tuple[DataFrame, Observation]:
    """df, and the counters of its rows, which are there once an action on it has ended (``get``). One action an observation."""
    seen = Observation(name)
    return df.observe(seen, *(counters or call_counters())), seen


def streamed(df: DataFrame, name: str, *counters: Column) -> DataFrame:
    """A stream whose counters come with each batch's progress, under their name."""
    return df.observe(name, *(counters or call_counters()))


class Progress(StreamingQueryListener):
    """Events of streams in the driver, as they come: (kind, query, batch, name, counters). tell gets each; totals() adds batches up."""

    def __init__(self, tell: Callable[[tuple], None] | None = None):
        self.events: list[tuple] = []
        self.tell = tell

    def _add(self, *event) -> None:
        self.events.append(event)
        if self.tell is not None:
            self.tell(event)

    def onQueryStarted(self, event) -> None:
        self._add("started", event.name, None, None, {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add("batch", p.name, p.batchId, None, {"rows": p.numInputRows})
        for name, row in p.observedMetrics.items():
            self._add("counters", p.name, p.batchId, name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("ended", None, None, None, {"error": event.exception})

    def totals(self, name: str) -> dict[str, int]:
        """Sums of the counters of a name; a batch that was told twice counts as it was told last."""
        last = {(query, batch): counters for kind, query, batch, n, counters in self.events if kind == "counters" and n == name}
        out: dict[str, int] = {}
        for counters in last.values():
            for k, v in counters.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
