"""Governance appends: review transitions, corrected claims, trusted revisions; written, audited, then published (X34c, X34d, X34f, X34g)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, shuffled

c = F.col
ENTRY = ["project", "kind", "entry"]

#: The action of a change of status; no other change is allowed.
ACTIONS = {
    "proposed:approved": "approve", "proposed:corrected": "correction", "proposed:archived": "reject", "approved:corrected": "correction", "approved:archived": "archive", "approved:proposed": "unapprove",
    "corrected:archived": "archive", "archived:approved": "restore", "archived:corrected": "correction",
}


def transitions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What happened to each entry (project, kind, entry, status, content, updated) between two snapshots: action, or the code of its refusal.

    Entries of one snapshot only had no event, nor those that stayed as they were.
    """
    was = previous.select(*ENTRY, c("status").alias("previous_status"), c("content").alias("was"))
    both = current.select(*ENTRY, "status", "content", "updated").join(was, ENTRY)
    same, changed = c("status") == c("previous_status"), ~c("content").eqNullSafe(c("was"))
    action = F.try_element_at(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair)), F.concat_ws(":", "previous_status", "status"))
    action = F.when(same, F.when((c("status") == "corrected") & changed, "correction")).otherwise(action)
    code = F.when(same & (c("status") == "approved") & changed, "content_changed_without_corrected_status").when(~same & action.isNull(), "invalid_review_transition")
    out = both.withColumns({"action": action, "code": code}).where("action is not null or code is not null")
    return out.select(*ENTRY, "previous_status", "status", F.trim("content").alias("content"), "updated", "action", "code")


def _latest(claims: DataFrame, name: str) -> Column:
    return F.max_by(F.struct("claim", "snapshot", "type", "category", "title"), F.struct("created", "claim")).alias(name)


def stage(moves: DataFrame, claims: DataFrame, evidence: DataFrame, trusted: DataFrame) -> dict[str, DataFrame]:
    """X34d, X34f: the rows that transitions add, and the transitions that are refused.

    ``claims``: project, kind, entry, claim, content, created, snapshot, type, category, title; ``evidence``: claim, evidence; ``trusted``:
    project, kind, entry, id, revision, ... A correction without a claim of its content makes one, whose id follows from what it corrects, and
    inherits the evidence of its predecessor, the latest claim of other content. Each transition but a rejection adds the next revision of its entry.
    Of each entry a snapshot holds one transition, so revisions have no gaps.
    """
    fine = moves.where("code is null").drop("code")
    own = claims.join(fine.select(*ENTRY, c("content").alias("said"), "action"), ENTRY)
    equal = own.where("content = said").groupBy(*ENTRY).agg(_latest(claims, "candidate"))
    before = own.where("content <> said and action = 'correction'").groupBy(*ENTRY).agg(_latest(claims, "before"))
    last = trusted.groupBy(*ENTRY).agg(F.max_by("id", "revision").alias("previous"), F.max("revision").alias("revision"))
    fine = fine.join(equal, ENTRY, "left").join(before, ENTRY, "left").join(last, ENTRY, "left")
    corrects, archives = c("action") == "correction", c("action").isin("archive", "unapprove")
    made = T.sha_id("candidate_claim", c("before.snapshot"), c("before.type"), c("kind"), c("entry"), c("content"))
    fine = fine.withColumn("claim", F.when(corrects & c("candidate").isNull(), made).otherwise(c("candidate.claim")))
    code = F.when(corrects & c("before").isNull() | ~corrects & c("candidate").isNull(), "canonical_governance_candidate_missing").when(archives & c("previous").isNull(), "canonical_governance_archive_without_trusted_knowledge")
    fine = fine.withColumn("code", code)
    refused = moves.where("code is not null").select(*ENTRY, "code").union(fine.where("code is not null").select(*ENTRY, "code"))
    fine = fine.where("code is null")
    action = F.when(c("action") == "unapprove", "archive").otherwise(c("action"))
    fine = fine.withColumn("review", T.sha_id("claim_review", c("project").cast("string"), c("kind"), c("entry"), c("claim"), action, c("updated")))
    new = fine.where(corrects & c("candidate").isNull())
    links = fine.where(corrects).select("claim", c("before.claim").alias("inherits")).join(evidence.select(c("claim").alias("inherits"), "evidence"), "inherits").select("claim", "evidence")
    kept = fine.where("action <> 'reject'")
    identity = T.sha_id("trusted_knowledge", c("project").cast("string"), c("kind"), c("entry"), c("review"))
    return {
        "claims": new.select(*ENTRY, "claim", "content", c("updated").alias("created"), "before.snapshot", "before.type", "before.category", "before.title"),
        "evidence": links.distinct().join(evidence, ["claim", "evidence"], "left_anti"),
        "reviews": fine.select(*ENTRY, c("review").alias("id"), "claim", action.alias("action"), "previous_status", "status", c("updated").alias("reviewed")),
        "trusted": kept.select(*ENTRY, identity.alias("id"), "claim", "review", "previous", (F.coalesce("revision", F.lit(0)) + 1).cast("long").alias("revision"), F.when(archives, "archived").otherwise("active").alias("lifecycle"), c("updated").alias("created")),
        "refused": refused,
    }


def unequal(staged: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """X34g: the staged rows of which ``stored`` has no row that is equal in every column, null being equal to null."""
    names = staged.columns
    rows = stored.select(*(c(n).alias(f"s_{n}") for n in names))
    same = c(key) == c(f"s_{key}")
    for n in names:
        same = same & c(n).eqNullSafe(c(f"s_{n}")) if n != key else same
    return staged.join(rows, same, "left_anti")


def publish(stored: dict[str, DataFrame], staged: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reviews and trusted rows after a write, audit and publish: both tables, and the projects that were held back.

    A staged row that is stored already is a replay and writes nothing. One whose id is stored with other content is a
    conflict: nothing of its project is published. What is published is then looked up again, null-safe in every column.
    The projects held back and both tables are stored, as a publication is read again by its checks.
    """
    held = None
    for name in ("reviews", "trusted"):
        known = staged[name].join(shuffled(stored[name].select("id")), "id", "left_semi")
        clash = unequal(known, shuffled(stored[name]), "id").select("project", F.lit(f"canonical_governance_{name}_conflict").alias("code"))
        held = clash if held is None else held.union(clash)
    held = cut(held.groupBy("project").agg(F.min("code").alias("code")))
    after = {}
    for name in ("reviews", "trusted"):
        rows = stored[name]
        fresh = staged[name].join(shuffled(held), "project", "left_anti").join(shuffled(rows.select("id")), "id", "left_anti").select(rows.columns)
        after[name] = cut(rows.unionByName(fresh))
    return after, held


def mismatches(after: dict[str, DataFrame], staged: dict[str, DataFrame], held: DataFrame) -> DataFrame:
    """X34g: postconditions: project and code of staged rows that were published, but aren't found as they were staged."""
    out = None
    for name in ("reviews", "trusted"):
        bad = unequal(staged[name].join(shuffled(held), "project", "left_anti"), shuffled(after[name]), "id").select("project", "id", F.lit(f"canonical_governance_completion_{name}_mismatch").alias("code"))
        out = bad if out is None else out.union(bad)
    return out
