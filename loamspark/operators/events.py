"""Operational events: progress, leases, retries, idempotent requests, rate limits and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Seconds before the next try, tries, and what a review command may change.
DELAYS = (60, 300, 900, 3600, 21600)
TRIES = 5
LEASE_SECONDS, LEASE_TRIES, BACKOFF = 1200, 3, (30, 120)
TRANSITIONS = {
    "approve": ("proposed:approved",),
    "correct": ("proposed:corrected", "approved:corrected", "corrected:corrected"),
    "reject": ("proposed:archived",),
    "archive": ("approved:archived", "corrected:archived"),
    "restore": ("archived:approved",),
    "unapprove": ("approved:proposed",),
}
REVIEWABLE = ("review_required", "ready")


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def progress(events: DataFrame, key: str, rank: Column, done: Column) -> DataFrame:
    """How far each job has come. Greatest values only, so late or repeated events never take it back.

    The same aggregate runs over a stream (update mode).
    """
    return events.groupBy(key).agg(F.max(rank).alias("stage"), F.max(done).alias("progress"), F.count("*").alias("n_events"))


def leases(jobs: DataFrame, now: Column) -> DataFrame:
    """State of each job (status, attempts, leased_at) after expired leases are taken back.

    A running job whose lease is over is queued again after a pause, or fails after its last try.
    """
    over = (F.col("status") == "running") & (micros("leased_at") < micros(now) - LEASE_SECONDS * 1_000_000)
    last = over & (F.col("attempts") >= LEASE_TRIES)
    pause = F.when(F.col("attempts") <= 1, BACKOFF[0]).otherwise(BACKOFF[1])
    status = F.when(last, "failed").when(over, "queued").otherwise(F.col("status"))
    return jobs.withColumns({"next_status": status, "wait_seconds": F.when(over & ~last, pause).cast("long")})


def retry(kind: Column, attempt: Column, started: Column) -> tuple[Column, Column]:
    """Z3: whether a failure is tried again, and the seconds until then."""
    again = F.when(kind == "permanent", False).when(kind == "concurrency", ~started).otherwise(attempt < TRIES)
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(DELAYS))).cast("int"))
    return again, delay


def idempotent(requests: DataFrame, keys: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """The first request of a key is new; later ones replay it if equal, or conflict.

    The first fingerprint of a key is one partial aggregate, so no key is gathered.
    """
    first = requests.groupBy(*keys).agg(F.min_by(F.struct(fingerprint, *order), F.struct(*order)).alias("_first"))
    is_first = F.struct(*order) == F.struct(*(F.col(f"_first.{c}") for c in order))
    state = F.when(is_first, "new").when(F.col(fingerprint).eqNullSafe(F.col(f"_first.{fingerprint}")), "replay").otherwise("conflict")
    return requests.join(first, keys).withColumn("outcome", state).drop("_first")


def recent(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events of the key in the last ``seconds`` up to each event, itself and equal times included.

    Time is cut into spans of that length and each event also lends itself to the next span, so a
    window holds two spans of a key and never its whole history.
    """
    at = micros(ts)
    own = events.withColumns({"_at": at, "_span": F.floor(at / (seconds * 1_000_000)), "_lent": F.lit(False)})
    both = own.unionByName(own.withColumns({"_span": F.col("_span") + 1, "_lent": F.lit(True)}))
    w = W.partitionBy(key, "_span").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("recent", F.count("*").over(w)).where("not _lent").drop("_at", "_span", "_lent")


def changes(states: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """Only the rows whose signature differs from the key's last one, with that one."""
    last = F.lag(signature).over(W.partitionBy(key).orderBy(*order))
    return states.withColumn("previous", last).where(~F.col(signature).eqNullSafe(F.col("previous")))


def review_issues(correction: Column) -> Column:
    """Codes of what speaks against a review command, joined by commas in the order of the checks.

    Columns: project, command_project, item_project, actor, owner, archived, project_status, client_revision, revision, processed, item_state
    (null: no such item), item_kind, command_item_kind, expected, from_state, to_state, kind;
    ``correction`` says whether a correction is well formed.
    """
    c = F.col
    allowed = F.lit(False)
    for kind, moves in TRANSITIONS.items():
        allowed = F.when(c("kind") == kind, F.concat_ws(":", "from_state", "to_state").isin(*moves)).otherwise(allowed)
    checks = (
        ((c("actor") != c("owner")) | (c("project") != c("command_project")), "project_not_owned"),
        (c("archived"), "project_archived"),
        (~c("archived") & ~c("project_status").isin(*REVIEWABLE), "project_not_reviewable"),
        (c("client_revision") != c("revision"), "stale_revision"),
        (c("processed"), "duplicate_command"),
        (c("item_state").isNull(), "item_not_found"),
        (c("item_state").isNotNull() & ((c("item_project") != c("project")) | (c("item_project") != c("command_project"))), "item_project_mismatch"),
        (c("item_state").isNotNull() & (c("item_kind") != c("command_item_kind")), "item_kind_mismatch"),
        (c("item_state").isNotNull() & (c("item_state") != c("expected")), "stale_review_state"),
        ((c("from_state") != c("expected")) | ~allowed, "invalid_transition"),
        ((c("kind") == "correct") & ~correction, "invalid_correction"),
    )
    return F.array_join(F.array_compact(F.array(*(F.when(test, code) for test, code in checks))), ",")
