"""State changes of alerts, proposals and inspections, as guarded updates of whole tables.

A request names a row and what is to become of it. All requests of a batch are judged in their order (`at`, then `id`), and each
comes back with what happened to it: its new state, or why it was refused. Rows that no request names pass through one join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each target the states from which it can be reached.
ALERT_MOVES = {"ACKNOWLEDGED": ("OPEN",), "RESOLVED": ("OPEN", "ACKNOWLEDGED")}
INSPECTION_MOVES = {"DONE": ("SCHEDULED",)}
PROPOSAL_MOVES = {"EXECUTED": ("PROPOSED",), "REJECTED": ("PROPOSED",), "FAILED": ("PROPOSED",)}


def judged(rows: DataFrame, requests: DataFrame, moves: dict[str, tuple[str, ...]], key: str = "id", state: str = "status") -> DataFrame:
    """The requests (request, key, to, at, by) with `outcome`: done, not_found or conflict, and `found`, the state that the request met.
    Of several requests for one row each meets what those before it have left: a task reads a row's requests in order and holds no
    more than the row's state, however many there are."""
    met = requests.select(F.col("request").cast("bigint").alias("request"), key, F.col("to").cast("string").alias("to"), F.col("at").cast("timestamp").alias("at"), F.col("by").cast("string").alias("by"))
    met = met.join(rows.select(key, F.col(state).alias("_state")), key, "left").select("request", key, "to", "at", "by", "_state")
    ordered = met.repartition(key).sortWithinPartitions(key, "at", "request", "to", "by")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, now = object(), None
        for batch in batches:
            found, outcome = [], []
            for k, to, begun in zip(*[batch.column(i).to_pylist() for i in (1, 2, 5)], strict=True):
                if k != row:
                    row, now = k, begun
                found.append(now)
                outcome.append("not_found" if now is None else "done" if now in moves.get(to, ()) else "conflict")
                if outcome[-1] == "done":
                    now = to
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.string()), pa.array(outcome, pa.string())], ["request", key, "to", "at", "by", "found", "outcome"])

    return ordered.mapInArrow(work, f"request long, {key} {met.schema[key].dataType.simpleString()}, to string, at timestamp, by string, found string, outcome string")


def moved(rows: DataFrame, verdicts: DataFrame, key: str = "id", state: str = "status") -> DataFrame:
    """The rows with the state that their accepted requests left; `_first` and `_last` are their first and last accepted request."""
    done = verdicts.where("outcome = 'done'").groupBy(key).agg(F.min(F.struct("at", "request", "to", "by")).alias("_first"), F.max(F.struct("at", "request", "to", "by")).alias("_last"))
    return rows.join(done, key, "left").withColumn(state, F.coalesce("_last.to", state))


def alert_transitions(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, verdicts): OPEN, ACKNOWLEDGED, RESOLVED. Who moves an alert first is its acknowledged_by, unless it has one;
    resolved_at is the time of the move. alerts: id, status, acknowledged_by, resolved_at and others."""
    verdicts = judged(alerts, requests, ALERT_MOVES)
    out = moved(alerts, verdicts).withColumn("acknowledged_by", F.coalesce("acknowledged_by", "_first.by"))
    resolved = F.when(F.col("_last.to") == "RESOLVED", F.col("_last.at"))
    return out.withColumn("resolved_at", F.coalesce(resolved, "resolved_at")).select(alerts.columns), verdicts


def inspection_results(bookings: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bookings, verdicts): SCHEDULED to DONE with the mechanic's finding. results: request, id, at, by, fault_found, component, of
    which a part counts only where a fault was found. part_right: whether it is the part that had been predicted."""
    verdicts = judged(bookings, results.select("request", "id", F.lit("DONE").alias("to"), "at", "by"), INSPECTION_MOVES)
    said = results.select("request", "fault_found", F.when(F.col("fault_found"), F.col("component")).alias("found_component"), F.col("at").alias("completed_at"))
    kept = verdicts.where("outcome = 'done'").select("id", "request").join(said, "request").drop("request")
    old = bookings.drop("fault_found", "found_component", "completed_at", "part_right")
    out = old.join(kept, "id", "left").withColumn("status", F.when(F.col("completed_at").isNotNull(), "DONE").otherwise(F.col("status")))
    return out.withColumn("part_right", F.when(F.col("fault_found"), F.col("found_component") == F.col("predicted_component"))), verdicts


def decided_proposals(proposals: DataFrame, decisions: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, bookings): PROPOSED to EXECUTED, REJECTED, or, where a plan's item no longer fits, FAILED: all of a plan's items are
    booked or none. decisions: id, approve, by, at, of which the first for a proposal counts. checked: the items (id of the proposal,
    item, vehicle, depot, day, reason), with why an item cannot be booked now (check_bookings), or null."""
    first = decisions.groupBy("id").agg(F.min(F.struct("at", "by", "approve")).alias("d"))
    bad = checked.where("reason is not null").groupBy("id").agg(F.min(F.struct("item", "reason")).alias("bad"))
    n = checked.groupBy("id").agg(F.count("*").alias("items"))
    met = proposals.join(first, "id", "left").join(bad, "id", "left").join(n, "id", "left")
    open_ = F.col("d").isNotNull() & (F.col("status") == "PROPOSED")
    status = F.when(~open_, F.col("status")).when(~F.col("d.approve"), "REJECTED").when(F.col("bad").isNotNull(), "FAILED").otherwise("EXECUTED")
    met = met.withColumn("_old", F.col("status")).withColumn("status", F.when(F.col("d").isNull(), F.col("status")).otherwise(status))
    met = met.withColumn("error", F.when((F.col("status") == "FAILED") & (F.col("_old") == "PROPOSED"), F.col("bad.reason"))).withColumn("bookings", F.when((F.col("status") == "EXECUTED") & (F.col("_old") == "PROPOSED"), F.coalesce("items", F.lit(0))))
    keep = [c for c in proposals.columns if c not in ("decided_by", "error", "bookings")]
    out = met.select(*keep, F.when(F.col("_old") == "PROPOSED", F.col("d.by")).alias("decided_by"), "error", "bookings")
    executed = out.where("bookings is not null").select("id")
    return out, checked.join(executed, "id", "left_semi").drop("reason")


def _chain_text(key: str, body: list[str]) -> Column:
    return F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in body])


def audit_chain(log: DataFrame, key: str = "id", group: str | None = None, body: list[str] | None = None, after: DataFrame | None = None) -> DataFrame:
    """The log with prev_hash and row_hash: each row's hash covers the hash of the row before it in its group, '' before the first.
    after: a chain (group, key, row_hash) that is there already; a group goes on from its last row, so an append costs what is
    appended, and rows up to a group's last key are refused. A group's rows pass through one task in the order of the key, which a chain
    asks for, but none are held: only the last hash is."""
    body = body or [c for c in log.columns if c not in (key, group)]
    by = F.col(group) if group else F.lit(0)
    rows = log.select(by.alias("_g"), F.col(key).cast("bigint").alias("_k"), _chain_text(key, body).alias("_text"), F.lit(None).cast("string").alias("_last"))
    if after is not None:
        ends = after.groupBy(by.alias("_g")).agg(F.max(F.col(key).cast("bigint")).alias("_k"), F.max_by("row_hash", key).alias("_last"))
        rows = rows.unionByName(ends.select("_g", "_k", F.lit(None).cast("string").alias("_text"), "_last"))
    # a group's end comes before its new rows
    ordered = rows.repartition("_g").sortWithinPartitions("_g", F.col("_text").isNotNull(), "_k")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, end = object(), "", None
        for batch in batches:
            out = []
            for g, k, text, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g != now:
                    now, last, end = g, "", None
                if text is None:
                    last, end = start, k
                    continue
                if end is not None and k <= end:
                    raise ValueError(f"row {k} is not after the chain's last one, {end}")
                before, last = last, hashlib.sha256((last + text).encode()).hexdigest()
                out.append((g, k, before, last))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()), strict=True)], ["_g", "id", "prev_hash", "row_hash"])

    chained = ordered.mapInArrow(work, f"_g {rows.schema['_g'].dataType.simpleString()}, id long, prev_hash string, row_hash string")
    return chained.withColumnRenamed("_g", group) if group else chained.drop("_g")


def broken_links(stored: DataFrame, recomputed: DataFrame, key: str = "id") -> DataFrame:
    """(key, ok): whether a stored row_hash is what the row's own text and the stored hash of the row before it give."""
    return stored.select(key, "row_hash").join(recomputed.select(key, F.col("row_hash").alias("_again")), key).select(key, F.col("row_hash").eqNullSafe(F.col("_again")).alias("ok"))


def chain_checked(log: DataFrame, key: str, group: str, body: list[str]) -> DataFrame:
    """(key, ok) for a log that carries prev_hash and row_hash: ok where row_hash fits the row and prev_hash is the row_hash of the
    row before it in the group. Each row looks at one neighbour, so a chain of any length is checked by a window."""
    own = F.sha2(F.concat("prev_hash", _chain_text(key, body)).cast("binary"), 256) == F.col("row_hash")
    before = F.lag("row_hash", 1, "").over(Window.partitionBy(group).orderBy(key))
    return log.select(key, (own & (F.col("prev_hash") == before)).alias("ok"))
