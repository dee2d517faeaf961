"""Mappings as a stream of versions that the event stream is joined to: an event is read by the version in force when it arrives.

Specifications come as records with the maker as their key. What is no document, is broken, names another maker than its key, or isn't
newer than what is in force is left out, and what is in force stays. The versions in force are a table of latest rows, so a batch of
specifications is in it whole or not at all, and again the same when it runs again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import normalize
from roadloom.streaming.store import LatestStore


class Mappings:
    """The versions in force, kept at a path: a row for each maker."""

    def __init__(self, path: str):
        self._store = LatestStore(path, ["maker"], "version", buckets=4)

    def in_force(self, spark: SparkSession, before: int | None = None) -> dict[str, dict]:
        rows = self._store.read(spark, before)
        return {r.maker: json.loads(r.spec) for r in rows.collect()} if rows is not None else {}  # one a maker

    def take(self, records: DataFrame, number: int) -> None:
        """A sink for foreachBatch. records: key, value (the specification as JSON) and offset, in whose order they are looked at. A
        batch holds the changes of a few makers."""
        spark, current, taken = records.sparkSession, self.in_force(records.sparkSession, number), {}  # a batch that runs again begins where it began
        for r in records.orderBy("offset").collect():
            try:
                spec = json.loads(r.value or "")
                maker = str(spec.get("oem", "")).upper() if isinstance(spec, dict) else ""
                if maker != str(r.key or "").upper():
                    raise normalize.MappingError("the key is another maker's")
                current[maker] = taken[maker] = normalize.check_mapping(spec, current.get(maker, {}).get("version"))
            except ValueError:  # no JSON, or no mapping
                continue
        rows = [(maker, spec["version"], json.dumps(spec)) for maker, spec in taken.items()]
        self._store.write(spark.createDataFrame(rows, "maker string, version int, spec string"), number)


def normalised(mappings: Mappings, sink: Callable[[DataFrame, int], None], now: Callable[[DataFrame], Column]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch of raw events (oem, value, ...): each batch is read by the mappings that are in force when it begins,
    and goes on to `sink` with event and reason. now: the time against which a batch's events are held."""
    return lambda batch, number: sink(normalize.normalize(batch, mappings.in_force(batch.sparkSession), now(batch)), number)
