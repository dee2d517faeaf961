"""Events seen before: exact windows of the last sequence numbers, and sinks that a replay does not fill twice."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sequence numbers that a vehicle's window remembers.
WINDOW = 64


def fresh(window: list[int], seqs: list[int], size: int = WINDOW) -> list[bool]:
    """Which of the numbers are new to the window, which takes them in as they come and forgets its oldest."""
    out = []
    for seq in seqs:
        new = seq not in window
        if new:
            window.append(seq)
            del window[:-size]
        out.append(new)
    return out


def stream_dedup(events: DataFrame, key: str, seq: str, arrival: list[str], size: int = WINDOW) -> DataFrame:
    """The events whose number is not among the last `size` ones of their key; late ones pass if they are new."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        window = json.loads(held.get[0]) if held.exists else []
        rows = pd.concat(list(frames)).sort_values(arrival)
        rows = rows[fresh(window, rows[seq].tolist(), size)]
        held.update((json.dumps(window),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "state string", "append", GroupStateTimeout.NoTimeout)


def batch_dedup(events: DataFrame, key: str, seq: str, arrival: str) -> DataFrame:
    """Each (key, number) once: the one that came first."""
    rest = [c for c in events.columns if c not in (key, seq, arrival)]
    first = events.groupBy(key, seq).agg(F.min(F.struct(arrival, *rest)).alias("_row"))
    return first.select(key, seq, "_row.*").select(*events.columns)
