"""Streaming: pending operations, visit counts, debounced changes, and the embedding queue's state machine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.ingest import last_ops

FIRST_DELAY, MOST_DELAY, DEBOUNCE = 1, 60, "200 milliseconds"


def delay(attempt: int) -> int:
    """Seconds before the next try: 1, 2, 4, ... up to 60."""
    return min(MOST_DELAY, FIRST_DELAY << max(0, min(attempt - 1, 10)))


def latest_ops(ops: DataFrame, sink, checkpoint_dir: str, **trigger):
    """Applies each micro-batch's last operation of every key through ``sink(df, batch_id)``."""
    return ops.writeStream.foreachBatch(lambda df, i: sink(last_ops(df), i)).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def removals(ops: DataFrame, delete_on_remove: bool) -> DataFrame:
    """Removed files are deleted from the index only if the directory says so."""
    return ops if delete_on_remove else ops.filter("op != 'delete'")


def visit_counts(events: DataFrame) -> DataFrame:
    """Running visits by user and query; combined before the state is touched. The same text serves batch and stream."""
    return events.groupBy("user_id", "query").agg(F.count("*").alias("visits"), F.max("ts").alias("last_at"))


def debounced(changes: DataFrame, at: str = "ts", key: str = "path", late: str = "1 hour") -> DataFrame:
    """One row for each burst of changes to a key: bursts are sessions that a quiet 200 ms end."""
    source = changes.withWatermark(at, late) if changes.isStreaming else changes
    return source.groupBy(key, F.session_window(at, DEBOUNCE)).agg(F.count("*").alias("changes"), F.max_by("op", at).alias("op"), F.max(at).alias("at"))


def windowed_counts(events: DataFrame, at: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling or sliding event-time windows."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    return source.groupBy(F.window(at, width, slide or width), "event_type").agg(F.count("*").alias("n"))


def changed_texts(docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Documents whose text isn't the one embedded already; ``embedded`` is (id, text_hash)."""
    hashed = docs.withColumn("text_hash", F.sha2("text", 256))
    return hashed.join(embedded.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


# ---------------------------------------------------------------- embedding queue

QUEUED, RUNNING = "pending", "in_progress"


def step(job: dict | None, op: str, now: int) -> dict | None:
    """The job after an operation, None when it is gone.

    ``add``: a new job waits; one in progress becomes dirty. ``claim``: a due job runs. ``done``: the job is gone, or waits
    anew with no attempts if it was dirty. ``fail``: tried later, at once if dirty. ``release``: given back untried.
    ``restart``: what ran waits again.
    """
    if op == "add":
        if job is None:
            return {"status": QUEUED, "dirty": False, "attempts": 0, "available_at": now}
        return job | ({"dirty": True} if job["status"] == RUNNING else {"available_at": now, "attempts": 0})
    if job is None:
        return None
    if op == "claim":
        return job | {"status": RUNNING, "attempts": job["attempts"] + 1} if job["status"] == QUEUED and job["available_at"] <= now else job
    if op == "restart":
        return job | {"status": QUEUED} if job["status"] == RUNNING else job
    if job["status"] != RUNNING:
        return job
    if op == "done":
        return {"status": QUEUED, "dirty": False, "attempts": 0, "available_at": now} if job["dirty"] else None
    if op == "fail":
        if job["dirty"]:
            return {"status": QUEUED, "dirty": False, "attempts": 0, "available_at": now}
        return job | {"status": QUEUED, "available_at": now + delay(job["attempts"])}
    if op == "release":
        return job | {"status": QUEUED, "attempts": max(0, job["attempts"] - 1), "available_at": now}
    return job


STATE = "status string, dirty boolean, attempts int, available_at long"
OUT = "doc_id string, seq long, " + STATE


def _replay(pdf: pd.DataFrame, job: dict | None) -> tuple[dict | None, int]:
    seq = 0
    for s, op, at in sorted(zip(pdf["seq"], pdf["op"], pdf["at"])):
        job, seq = step(job, op, int(at)), int(s)
    return job, seq


def embedding_queue(ops: DataFrame) -> DataFrame:
    """A stream of (doc_id, seq, op, at) as a stream of jobs after each micro-batch; the state of a document is its job."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):
        job = dict(zip(("status", "dirty", "attempts", "available_at"), state.get)) if state.exists else None
        seq = 0
        for pdf in batches:
            job, seq = _replay(pdf, job)
        if job is None:
            if state.exists:
                state.remove()
        else:
            state.update((job["status"], job["dirty"], job["attempts"], job["available_at"]))
        shown = job or {"status": "gone", "dirty": False, "attempts": 0, "available_at": 0}
        yield pd.DataFrame([{"doc_id": key[0], "seq": seq, **shown}])

    return ops.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def replayed_queue(ops: DataFrame) -> DataFrame:
    """The same over a finished log: the last job of each document, gone ones left out."""

    def run(key, pdf):
        job, seq = _replay(pdf, None)
        return pd.DataFrame([{"doc_id": key[0], "seq": seq, **job}] if job else [], columns=["doc_id", "seq", "status", "dirty", "attempts", "available_at"])

    return ops.groupBy("doc_id").applyInPandas(run, OUT)


def capture_times(changes: list[int], first: int = 1, quiet: int = 10, most: int = 30) -> list[int]:
    """When a page that changes at the given seconds is captured: once ``first`` after its opening, then after ``quiet``
    seconds without a change, but at most ``most`` after the first change that waits."""
    if not changes:
        return []
    out, waiting, due = [changes[0] + first], None, None
    for t in sorted(changes[1:]):
        if due is not None and t >= due:
            out.append(due)
            waiting = due = None
        if t < out[0]:
            continue
        waiting = t if waiting is None else waiting
        due = min(t + quiet, waiting + most)
    return out + ([due] if due is not None else [])
