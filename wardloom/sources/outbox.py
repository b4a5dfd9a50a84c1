"""An outbox in a store: events enqueued with the rows that they tell of, claimed, sent and marked, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.sources.store import Store

OUTBOX, CLAIMS, ATTEMPTS = "outbox", "outbox_claims", "outbox_attempts"
WRITER = "dispatch"

Send = Callable[[DataFrame, int], DataFrame]


def status(store: Store) -> DataFrame:
    """(event, status, attempts) of all events: PUBLISHED after a success, FAILED after attempts without one, else PENDING."""
    at = store.snapshot()
    events = at.table(OUTBOX)
    if ATTEMPTS not in at:
        return events.withColumns({"status": F.lit("PENDING"), "attempts": F.lit(0).cast("long")})
    tries = at.table(ATTEMPTS).groupBy("event_id").agg(F.max("ok").alias("ok"), F.count("*").alias("attempts"))
    said = F.when(F.col("ok"), "PUBLISHED").when(F.col("attempts") > 0, "FAILED").otherwise("PENDING")
    return events.join(tries, "event_id", "left").withColumns({"status": said, "attempts": F.coalesce("attempts", F.lit(0)).cast("long")}).drop("ok")


def pending(store: Store, most: int = 5) -> DataFrame:
    """Events that are not published and were tried fewer than ``most`` times, the oldest first."""
    return status(store).where((F.col("status") != "PUBLISHED") & (F.col("attempts") < most)).orderBy("created_at", "event_id")


def dispatch(store: Store, send: Send, most: int = 5) -> int:
    """Sends what is pending; gives the number of its claim.

    A claim is committed before anything is sent, and the results after. ``send(events, claim)`` gives (event_id, ok) and must leave the same when it is called again with the same
    claim, as ``to_files`` does: a run that is killed between sending and marking is finished by the next one, with the events and the number of its claim, so that nothing is lost or doubled.
    """
    at = store.snapshot()
    last = at.writers.get(WRITER, -1)
    if last % 2 == 0:  # a claim without results: those of a run that was killed
        return _finish(store, send, last // 2)
    claim = (last + 1) // 2
    events = pending(store, most) if OUTBOX in at else None
    if events is None or events.isEmpty():
        return claim
    claimed = events.select("event_id", F.lit(claim).cast("long").alias("claim"))
    store.commit(WRITER, 2 * claim, {CLAIMS: (claimed, [])}, at)
    return _finish(store, send, claim)


def _finish(store: Store, send: Send, claim: int) -> int:
    at = store.snapshot()
    events = at.table(OUTBOX).join(at.table(CLAIMS).where(F.col("claim") == claim).select("event_id"), "event_id", "left_semi")
    results = send(events, claim).select("event_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(claim).cast("long").alias("claim"))
    store.commit(WRITER, 2 * claim + 1, {ATTEMPTS: (results, [])}, at)
    return claim


def to_files(path: str, good: str = "true") -> Send:
    """Writes the events of a claim as JSON into a folder of their own, which a repeated call replaces; those that ``good`` is not true of fail."""

    def send(events: DataFrame, claim: int) -> DataFrame:
        sent = events.where(F.coalesce(F.expr(good), F.lit(False)))
        sent.write.mode("overwrite").json(f"{path}/claim={claim}")
        return events.select("event_id", F.coalesce(F.expr(good), F.lit(False)).alias("ok"))

    return send
