"""Redirects, duplicates, rewiring and conflicts of the memory graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, shuffled


class CycleError(ValueError):
    """Redirects that lead back to themselves."""


def resolve_redirects(redirects: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst) with dst the end of each chain, by doubling the length of steps each round.

    Every id redirects at most once. A chain of n redirects takes log2(n) rounds; what still moves after ``rounds``
    is a cycle, which is an error. Each round is checkpointed, so that plans stay short.
    """
    now = cut(redirects.select("src", "dst").distinct())
    for _ in range(rounds):
        step = now.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        after = cut(now.join(shuffled(step), "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), F.col("next").isNotNull().alias("moved")))
        if not after.where("src = dst").isEmpty():
            raise CycleError("redirect cycle")
        now = after.select("src", "dst")
        if after.where("moved").isEmpty():
            return now
    raise CycleError("redirect cycle")


def chains(redirects: DataFrame) -> DataFrame:
    """(project, src, dst, cyclic) of redirects (project, src, dst), each followed to its end within its project.

    Every id redirects at most once. Steps are doubled each round; a chain is no longer than the redirects are many, so
    what moves after that many steps leads into a cycle: it keeps its own row, marked, and fails nothing else.
    """
    now = cut(redirects.select("project", "src", "dst").distinct())
    most = now.count().bit_length() + 1
    moving = now.limit(0).select("project", "src")
    for _ in range(most):
        step = now.select("project", F.col("src").alias("dst"), F.col("dst").alias("next"))
        after = cut(now.join(shuffled(step), ["project", "dst"], "left").select("project", "src", F.coalesce("next", "dst").alias("dst"), F.col("next").isNotNull().alias("moved")))
        now, moving = after.select("project", "src", "dst"), after.where("moved").select("project", "src")
        if moving.isEmpty():
            break
    return now.join(shuffled(moving.withColumn("cyclic", F.lit(True))), ["project", "src"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def components(edges: DataFrame) -> DataFrame:
    """(project, id, root) of every end of an edge (project, a, b), the root being the least id connected with it.

    Each round every id with a smaller neighbour goes to its least one; such steps never form a cycle, so each is
    followed to its end, and the edges between ends are what is left. At least half of the ids are gone each round.
    """
    edges = cut(edges.where("a <> b").select("project", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = cut(edges.select("project", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    while not edges.isEmpty():
        both = edges.union(edges.select("project", "b", "a"))
        least = both.groupBy("project", "a").agg(F.min("b").alias("dst")).where("dst < a").withColumnRenamed("a", "src")
        ends = cut(chains(least).select("project", "src", "dst"))
        to = lambda x: shuffled(ends.select("project", F.col("src").alias(x), F.col("dst").alias(f"_{x}")))
        found = cut(found.join(to("root"), ["project", "root"], "left").select("project", "id", F.coalesce("_root", "root").alias("root")))
        edges = edges.join(to("a"), ["project", "a"], "left").join(to("b"), ["project", "b"], "left").select("project", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = cut(edges.where("a <> b").select("project", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one edge away from the seeds (query, node), either way, seeds left out."""
    out = seeds.join(edges.select(F.col("a").alias("node"), F.col("b").alias("next"), "edge"), "node").select("query", F.col("next").alias("node"), "edge")
    back = seeds.join(edges.select(F.col("b").alias("node"), F.col("a").alias("next"), "edge"), "node").select("query", F.col("next").alias("node"), "edge")
    return out.union(back).join(seeds, ["query", "node"], "left_anti").distinct()


def identity_key(kind: Column, value: Column) -> Column:
    """The normalised key of an e-mail address, phone, domain or website; null if it is none."""
    v = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    phone = F.regexp_replace(v, "[^0-9+]", "")
    site = F.regexp_replace(F.regexp_replace(v, "^[a-z]+://", ""), "^www\\.", "")
    out = F.when((kind == "email") & v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), v)
    out = out.when((kind == "phone") & phone.rlike(r"^\+?[0-9]{7,15}$"), phone)
    out = out.when((kind == "domain") & v.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,63}$"), v)
    return out.when((kind == "website") & site.rlike(r"^[^/\s]+\.[^/\s]+"), F.regexp_replace(F.regexp_replace(site, "[?#].*$", ""), "/$", ""))


def duplicate_candidates(keys: DataFrame) -> DataFrame:
    """Keys (kind, value, entity_id, entity_type, strong) that several entities share.

    Members are counted, and linked to the least of them, so that a key shared by many costs a row each.
    """
    own = keys.where("value is not null").groupBy("kind", "value", "entity_id", "entity_type").agg(F.bool_or("strong").alias("strong"))
    group = own.groupBy("kind", "value").agg(F.count("*").alias("n"), F.countDistinct("entity_type").alias("types"), F.bool_or("strong").alias("strong"), F.min("entity_id").alias("lead"))
    group = group.where("n > 1")
    auto = F.col("strong") & (F.col("types") == 1) & F.col("kind").isin("external_id", "email", "phone", "domain", "website")
    return group.select("kind", "value", "n", "lead", F.when(auto, "auto_merge").otherwise("manual_review").alias("classification"))


def rewire(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges (edge, kind, a, b, at) with ends redirected, self links dropped, doubles collapsed to the earliest."""
    ends = lambda e: resolved.select(F.col("src").alias(e), F.col("dst").alias(f"_{e}"))
    own = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    own = own.select("edge", "kind", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "at").where("a <> b")
    return own.groupBy("kind", "a", "b").agg(F.min_by("edge", F.struct("at", "edge")).alias("edge"), F.min("at").alias("at"), F.count("*").alias("n"))


def assertion_conflicts(assertions: DataFrame) -> DataFrame:
    """Topics of an entity with two or more values among active assertions of good authority."""
    active = assertions.where(F.col("active") & ~F.col("review").isin("archived", "rejected") & F.col("authority").isin("confirmed", "corrected", "observed"))
    return active.groupBy("entity_id", "topic").agg(F.countDistinct("norm").alias("n_values"), F.count("*").alias("n")).where("n_values > 1")


def drift(desired: dict[str, DataFrame], persisted: dict[str, DataFrame], key: str, hash: str) -> DataFrame:
    """Missing, extra and changed rows of several models at once."""
    out = None
    for model, want in desired.items():
        both = want.select(key, F.col(hash).alias("w")).join(persisted[model].select(key, F.col(hash).alias("h")), key, "full_outer")
        kind = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("w") != F.col("h"), "changed")
        found = both.select(F.lit(model).alias("model"), F.col(key).cast("string").alias("key"), kind.alias("drift")).where("drift is not null")
        out = found if out is None else out.union(found)
    return out


#: What repairs a drift, in order of work; what is not named cannot be repaired.
REPAIRS = {"missing": (1, "insert"), "changed": (2, "update"), "extra": (3, "deactivate")}


def repair_plan(found: DataFrame) -> DataFrame:
    """A typed, ordered repair for each drift."""
    rank = F.create_map(*(F.lit(x) for k, (n, _) in REPAIRS.items() for x in (k, n)))
    verb = F.create_map(*(F.lit(x) for k, (_, v) in REPAIRS.items() for x in (k, v)))
    return found.select("model", "key", "drift", F.element_at(rank, F.col("drift")).alias("rank"), F.element_at(verb, F.col("drift")).alias("repair"))


def integrity(revisions: DataFrame, project: Column) -> DataFrame:
    """X34h, W13: what is wrong with the rows of each item's history, in the order (revision, id).

    Columns: kind, item, id (unique), revision, project, review, review_project, review_claim, claim,
    action, lifecycle, predecessor.
    """
    w = W.partitionBy("kind", "item").orderBy("revision", "id")
    c = F.col
    own = revisions.withColumns({"before": F.lag("id").over(w), "before_revision": F.lag("revision").over(w), "before_project": F.lag("project").over(w)})
    named = revisions.select("kind", "item", c("id").alias("predecessor"), c("lifecycle").alias("predecessor_lifecycle"))
    own = own.join(named, ["kind", "item", "predecessor"], "left")
    later, follows = c("before").isNotNull(), c("predecessor").eqNullSafe(c("before"))
    archives = c("action").eqNullSafe(F.lit("archive"))
    archived = c("lifecycle") == "archived"
    checks = (
        (c("revision").isNull() | (c("revision") < 1), "invalid_revision"),
        (later & (c("revision") <= c("before_revision")), "duplicate_or_unordered_revision"),
        (~c("project").eqNullSafe(project), "cross_project_trusted_knowledge"),
        (c("review").isNull() | ~c("review_project").eqNullSafe(project) | ~c("review_claim").eqNullSafe(c("claim")), "cross_project_or_claim_review"),
        (~F.coalesce(c("action").isin(*ACTIONS), F.lit(False)), "unsupported_or_missing_review_action"),
        (archived != archives, "lifecycle_review_action_mismatch"),
        (~archived & ~F.coalesce(c("action").isin("approve", "correction", "restore"), F.lit(False)), "missing_compatible_review"),
        (later & ~follows, "broken_predecessor_chain"),
        (later & follows & ~c("before_project").eqNullSafe(project), "cross_project_or_logical_predecessor"),
        (~later & c("predecessor").isNotNull(), "unexpected_first_predecessor"),
        ((c("action") == "restore") & ~c("predecessor_lifecycle").eqNullSafe(F.lit("archived")), "restore_predecessor_invalid"),
    )
    reasons = F.array_compact(F.array(*(F.when(test, reason) for test, reason in checks)))
    return own.select("kind", "item", "id", F.explode(reasons).alias("reason"))


#: The review actions of a history.
ACTIONS = ("approve", "correction", "archive", "restore")
