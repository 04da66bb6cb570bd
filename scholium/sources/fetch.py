"""Remote answers as rows: spaced calls, and retries that wait longer each time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Busy(Exception):
    """Raised by a call that should come again; ``after`` are the seconds that the server asks for."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


def retried(call: Callable[[int], str | None], attempts: int, base: float, cap: float, sleep: Callable[[float], None] = time.sleep):
    """(answer, attempts made, error) of ``call(attempt)``; it is repeated while it is busy or the connection fails.

    The pauses double from ``base`` seconds up to ``cap``, or are as long as the server says. Other errors are not
    repeated and not hidden: they end the task.
    """
    for attempt in range(1, attempts + 1):
        try:
            return call(attempt), attempt, None
        except (Busy, ConnectionError, TimeoutError) as problem:
            said = getattr(problem, "after", None)
            if attempt == attempts:
                return None, attempt, type(problem).__name__
            sleep(min(cap, said if said is not None else base * 2 ** (attempt - 1)))
    return None, 0, None


def fetched(
    requests: DataFrame, call: Callable[[str, int], str | None], per_second: float = 10.0, tasks: int = 4, attempts: int = 4,
    base: float = 1.0, cap: float = 60.0,
) -> DataFrame:
    """(query, body, attempts, error) of each distinct query; all tasks together make ``per_second`` calls at most.

    The number of tasks is fixed, so that the rate holds however large the cluster is. A lost task asks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pause, last = tasks / per_second, 0.0
        for batch in batches:
            rows = []
            for query in batch.column(0).to_pylist():

                def spaced(attempt: int, query: str = query) -> str | None:
                    nonlocal last
                    wait = last + pause - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                    return call(query, attempt)

                rows.append((query, *retried(spaced, attempts, base, cap)))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query", "body", "attempts", "error"])

    one = requests.select("query").filter("query is not null").distinct().repartition(tasks)
    return one.mapInArrow(run, "query string, body string, attempts int, error string")
