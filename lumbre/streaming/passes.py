"""Periodic passes over what has arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_pass(stream: DataFrame, write: Callable[[DataFrame], None], progress: str, timeout: int = 3600) -> int:
    """One pass: everything new in ``stream`` goes through ``write`` in batches, then the
    pass ends; the number of batches is returned.

    ``progress`` is the folder that remembers how far passes have come. A batch that a
    lost pass left half done is given to ``write`` again, so it must be idempotent, as
    upserts and inserts of absent keys are."""
    seen = []

    def each(batch: DataFrame, number: int) -> None:
        write(batch)
        seen.append(number)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination(timeout)
    if q.exception() is not None:
        raise q.exception()
    return len(seen)
