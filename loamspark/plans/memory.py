"""The memory graph on stand-ins: build, rebuild, drift, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as O
from . import registry as R
from .registry import Tables, query

c = F.col
KINDS = list(O.REVIEW_TYPE)
SITE_KINDS = ["pricing_plan", "company_overview", "product", "contact", "faq", "unheard_of"]
STATES = ["approved", "corrected", "proposed", "rejected"]
ORIGINS = ["user_edit", "website", "generated_qa", "manual"]


def _pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def _inputs(t: Tables, changed: bool = False) -> dict[str, DataFrame]:
    """An entry, a fact and a FAQ of many orders; ``changed`` alters the entries of one project of nine."""
    k, text = c("o_orderkey"), lambda x: x.cast("string")
    title = F.when(k % 4 == 0, F.lower("o_orderpriority")).when(k % 4 == 1, F.concat(F.lit("  "), c("o_orderpriority"))).otherwise(c("o_orderpriority"))
    value = F.concat_ws(" ", c("o_orderstatus"), text(k % 3))
    when = text(c("o_orderdate").cast("date"))
    e = lambda n: F.struct(F.concat(F.lit("https://s.example/"), text(k % (3 + n))).alias("url"), F.concat(F.lit("Excerpt "), text(k % 5)).alias("excerpt"), F.when(k % 2 == 0, F.lit("d")).alias("document"), F.lit(None).cast("string").alias("block"))
    rows = t.orders.select(
        c("o_custkey").cast("string").alias("project"), k.alias("k"), title.alias("title"), value.alias("value"), when.alias("created"), F.when(k % 6 == 0, F.array(e(0), e(1))).otherwise(F.array(e(0))).alias("evidence"),
        _pick(SITE_KINDS, k).alias("site_kind"), _pick(KINDS, k).alias("kind"), _pick(STATES, k).alias("status"), _pick(ORIGINS, F.floor(k / 8)).alias("source_type"),
    )
    facts = rows.where("k % 2 = 0").select("project", "k", c("site_kind").alias("category"), "title", "value", F.lit("medium").alias("confidence"), "evidence")
    own = F.when(c("k") % 14 == 0, F.concat(F.lit("website_fact_"), F.regexp_replace(T.stable_id("x", c("material"), padded=False), "^x_", ""))).otherwise(F.concat(F.lit("e"), text(c("k"))))
    entries = rows.withColumn("category", c("site_kind")).withColumn("material", O.fact_material("url")).withColumn("id", own).where("k % 3 <> 0 or k % 14 = 0")
    if changed:
        entries = entries.withColumn("value", F.when(c("project").cast("long") % 9 == 0, F.concat("value", F.lit(" new"))).otherwise(c("value")))
    entries = entries.select(
        "project", "id", c("kind").alias("category"), "title", c("value").alias("content"), F.array(c("kind"), F.lit(" a  tag ")).alias("tags"), F.lit("high").alias("confidence"), (c("k") % 100).alias("score"), "status", "source_type",
        (c("k") % 11 == 0).alias("user_edited"), F.when(c("k") % 2 == 1, F.lit("b1")).otherwise(F.lit("")).alias("block"), F.lit(None).cast("string").alias("url"), F.when(c("k") % 5 > 0, c("value")).alias("excerpt"), "created", c("created").alias("updated"),
    )
    faqs = rows.where("k % 5 = 0").select(
        "project", F.concat(F.lit("q"), text(c("k"))).alias("id"), F.concat("title", F.lit("?")).alias("question"), c("value").alias("answer"), F.lit("low").alias("confidence"), (c("k") % 100).alias("score"), "status",
        F.array(F.concat(F.lit("e"), text(c("k"))), F.lit("gone")).alias("sources"), "created", c("created").alias("updated"),
    )
    project = c("c_custkey").cast("string").alias("project")
    urls = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return {
        "entries": entries, "faqs": faqs, "facts": facts.drop("k"),
        "crawls": t.customer.select(project, F.concat(F.lit("a"), text(c("c_custkey"))).alias("attempt"), F.lit("https://s.example/").alias("url"), F.lit("2026-01-01").alias("imported")),
        "pages": t.customer.select(project, urls.alias("n")).select("project", F.concat(F.lit("https://s.example/"), text(c("n"))).alias("url"), F.lit("page").alias("page_type")),
        "labels": t.customer.select(project, F.lit("b1").alias("block"), F.lit("Label").alias("label")),
        "conflicts": t.customer.select(project, F.lit("c").alias("id"), F.lit("topic").alias("topic"), F.lit("o  1").alias("first"), F.lit("1-urgent").alias("second"), F.lit(False).alias("resolved")),
        "missing": t.customer.select(project, F.lit("m").alias("id"), F.lit("topic").alias("topic"), F.lit("reason").alias("reason"), F.lit(False).alias("resolved")),
    }


def _sha(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || sha256({' || chr(0) || '.join(R.merge_value(p) for p in parts)})"


def _case(key: str, names: dict[str, str], rest: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE '{rest}' END"


def _rows_sql(changed: bool = False) -> str:
    material = lambda each: f"array_to_string(list_concat([{R.merge_value('site_kind')}, {R.merge_value('title')}, {R.merge_value('value')}], list_sort(list_transform(evidence, lambda e: {each}))), chr(0))"
    short = f"lower(to_hex({R.fnv(material(R.merge_value('e.url')))}))"
    ev = lambda n: f"{{'url': 'https://s.example/' || (o_orderkey % {3 + n}), 'excerpt': 'Excerpt ' || (o_orderkey % 5), 'document': CASE WHEN o_orderkey % 2 = 0 THEN 'd' END}}"
    value = "CASE WHEN project::BIGINT % 9 = 0 THEN value || ' new' ELSE value END" if changed else "value"
    return f"""base AS (SELECT o_custkey::VARCHAR AS project, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN '  ' || o_orderpriority ELSE o_orderpriority END AS title,
            o_orderstatus || ' ' || (o_orderkey % 3) AS value, (o_orderdate::DATE)::VARCHAR AS created, CASE WHEN o_orderkey % 6 = 0 THEN [{ev(0)}, {ev(1)}] ELSE [{ev(0)}] END AS evidence,
            {SITE_KINDS!r}[o_orderkey % {len(SITE_KINDS)} + 1] AS site_kind, {KINDS!r}[o_orderkey % {len(KINDS)} + 1] AS kind, {STATES!r}[o_orderkey % {len(STATES)} + 1] AS status, {ORIGINS!r}[o_orderkey // 8 % {len(ORIGINS)} + 1] AS st FROM orders),
        keyed AS (SELECT *, {short} AS short, {material("lower(" + R.clean("e.url || chr(0) || e.excerpt") + ")")} AS finger FROM base),
        entry AS (SELECT * REPLACE ({value} AS value), CASE WHEN k % 14 = 0 THEN 'website_fact_' || short ELSE 'e' || k END AS id, CASE WHEN st = 'user_edit' OR k % 11 = 0 THEN 'user_edit' WHEN st = 'website' THEN 'website' WHEN st = 'generated_qa' THEN 'generated_qa' ELSE 'manual_intake' END AS origin
                  FROM keyed WHERE k % 3 <> 0 OR k % 14 = 0),
        fact AS (SELECT * FROM keyed WHERE k % 2 = 0),
        known AS (SELECT project, short, max({{'site_kind': site_kind, 'evidence': evidence}}) AS f FROM fact GROUP BY ALL),
        open AS (SELECT f.*, row_number() OVER (PARTITION BY project, finger ORDER BY title, value, site_kind, k) - 1 AS nth FROM fact f WHERE NOT EXISTS (SELECT 1 FROM entry e WHERE e.project = f.project AND e.id = 'website_fact_' || f.short)),
        rows0 AS (
          SELECT e.project, 'context' AS what, id AS identity, id AS legacy_id, CASE WHEN origin = 'website' THEN 'website-restored:' ELSE 'context:' END || coalesce(n.f.site_kind, kind) || ':' || {R.merge_value('title')} AS entity_key,
                 CASE WHEN n.f IS NOT NULL THEN {_case('n.f.site_kind', O.WEBSITE_TYPE, 'other')} ELSE {_case('kind', O.REVIEW_TYPE, 'other')} END AS type, {R.clean('title')} AS name, {R.clean('value')} AS value, status AS review,
                 CASE WHEN status = 'corrected' THEN 'corrected' WHEN k % 11 = 0 THEN 'confirmed' WHEN origin = 'generated_qa' THEN 'generated' WHEN origin = 'website' THEN 'observed' ELSE 'provided' END AS authority, origin, 'high' AS confidence, (k % 100)::DOUBLE AS score,
                 id AS source_entry, CASE WHEN k % 2 = 1 THEN 'b1' END AS block, NULL AS url, CASE WHEN k % 2 = 1 THEN 'Label' END AS label, created AS captured, CASE WHEN origin = 'website' THEN 'a' || e.project END AS attempt, CASE WHEN origin = 'website' THEN '2026-01-01' END AS imported,
                 coalesce(n.f.evidence, CASE WHEN k % 5 > 0 THEN [{{'url': NULL, 'excerpt': value, 'document': NULL}}] END, []) AS evidence, created, 'e' || k AS own
          FROM entry e LEFT JOIN known n ON n.project = e.project AND id = 'website_fact_' || n.short
          UNION ALL SELECT project, 'faq', 'q' || k, 'q' || k, 'faq:q' || k, 'faq', {R.clean("title || '?'")}, {R.clean('value')}, status, CASE WHEN status = 'corrected' THEN 'corrected' ELSE 'generated' END, 'generated_qa', 'low', (k % 100)::DOUBLE, 'q' || k, NULL, NULL, 'Generated FAQ', created, NULL, NULL, [], created, 'e' || k FROM base WHERE k % 5 = 0
          UNION ALL SELECT project, 'website', {_sha('website_fact', 'finger', 'nth::VARCHAR')}, NULL, 'website:' || site_kind || ':' || {R.merge_value('title')}, {_case('site_kind', O.WEBSITE_TYPE, 'other')}, {R.clean('title')}, {R.clean('value')}, 'proposed', 'observed', 'website', 'medium', 0.7,
                 NULL, 'website_knowledge', 'https://s.example/', 'https://s.example/', '2026-01-01', 'a' || project, '2026-01-01', evidence, '2026-01-01', NULL FROM open),
        r AS (SELECT *, {_sha('business_entity', 'project', 'type', 'entity_key')} AS entity_id, {_sha('business_assertion', 'project', 'what', 'identity')} AS assertion_id FROM rows0),
        shown AS (SELECT project, assertion_id, origin, source_entry, block, coalesce(e.url, r.url) AS url, label, attempt, e.document AS document, captured, imported, created, e, CASE WHEN regexp_matches(coalesce(e.url, r.url), '^https://s.example/[0-3]$') THEN 'page' END AS page_type
                  FROM (SELECT *, unnest(CASE WHEN len(evidence) = 0 THEN [NULL] ELSE evidence END) AS e FROM r) r),
        src AS (SELECT *, {_sha('knowledge_source', 'project', 'assertion_id', 'origin', 'source_entry', 'block', 'url', 'label', 'attempt', 'document', 'captured', 'imported', 'page_type')} AS source_id FROM shown)"""


ROWS = _rows_sql()


@query(f"WITH {ROWS} SELECT project, assertion_id AS id, entity_id, value, confidence, score, review, authority, legacy_id, created FROM r")
def x35_assertions(t: Tables) -> DataFrame:
    return O.build(_inputs(t))["assertions"].drop("tags", "updated")


@query(f"""WITH {ROWS}, p AS (SELECT *, CASE WHEN review IN ('approved', 'corrected') THEN CASE origin WHEN 'user_edit' THEN 0 WHEN 'manual_intake' THEN 1 ELSE 2 END ELSE 3 END AS priority FROM r)
           SELECT project, entity_id AS id, min(type) AS type, (min([lpad(priority::VARCHAR, 2, '0'), name]))[2] AS name, count(*) AS n_assertions, min(created) AS created, max(created) AS updated FROM p GROUP BY ALL""")
def x35_entities(t: Tables) -> DataFrame:
    return O.build(_inputs(t))["entities"]


@query(f"""WITH {ROWS} SELECT DISTINCT project, {_sha('evidence', 'source_id', 'e.url', 'e.excerpt', "''", 'created')} AS id, source_id, {R.clean('e.excerpt')} AS excerpt, e.url AS url FROM src WHERE e IS NOT NULL""")
def x35_evidence(t: Tables) -> DataFrame:
    return O.build(_inputs(t))["evidence"].select("project", "id", "source_id", "excerpt", "url")


@query(f"""WITH {ROWS} SELECT f.project, {_sha('business_relationship', "'supports'", 'a.entity_id', 'f.entity_id', 'a.legacy_id', 'f.legacy_id')} AS id, a.assertion_id AS from_assertion, f.assertion_id AS to_assertion, f.review
           FROM r f JOIN r a ON a.project = f.project AND a.legacy_id = f.own WHERE f.what = 'faq'""")
def x35_relationships(t: Tables) -> DataFrame:
    return O.build(_inputs(t))["relationships"].select("project", "id", "from_assertion", "to_assertion", "review")


@query(f"""WITH {ROWS} SELECT DISTINCT project, {_sha('business_memory_conflict', 'project', "'c'")} AS conflict_id, assertion_id FROM r WHERE lower(value) IN ('o 1', '1-urgent') OR lower(name) IN ('o 1', '1-urgent')""")
def x35_conflict_assertions(t: Tables) -> DataFrame:
    return O.build(_inputs(t))["conflict_assertions"]


# --- X35b, X46: fingerprints and plans ---------------------------------------------------


def _material(t: Tables, changed: bool) -> DataFrame:
    """What a memory's revision hangs on: its assertions and their links to evidence."""
    m = O.build(_inputs(t, changed))
    return O.state_fingerprints({"assertions": m["assertions"].select("project", "id", "value", "review"), "evidence": m["assertion_evidence"].select("project", "assertion_id", "evidence_id")})


def _digests(model: str, *columns: str) -> str:
    return f"""md5('{model}' || chr(31) || md5(concat_ws(chr(31), {', '.join(f"coalesce({x}, chr(0))" for x in columns)})))"""


def _fingers(changed: bool, name: str) -> str:
    evidence_id = _sha("evidence", "source_id", "e.url", "e.excerpt", "''", "created")
    return f"""{name} AS (WITH {_rows_sql(changed)}, d AS (SELECT project, {_digests('assertions', 'assertion_id', 'review', 'value')} AS x FROM r
            UNION ALL SELECT project, {_digests('evidence', 'assertion_id', 'evidence_id')} FROM (SELECT DISTINCT project, assertion_id, {evidence_id} AS evidence_id FROM src WHERE e IS NOT NULL))
          SELECT project, sha256(count(*) || '|' || sum(('0x' || substr(x, 1, 15))::BIGINT::HUGEINT) || '|' || sum(('0x' || substr(x, 16, 15))::BIGINT::HUGEINT)) AS fingerprint FROM d GROUP BY project)"""


@query(f"""WITH {_fingers(False, 'a')} SELECT project, fingerprint FROM a""")
def x46_state_fingerprints(t: Tables) -> DataFrame:
    return _material(t, False)


def _plan(t: Tables) -> DataFrame:
    """Memories of the state before (but for some projects) against the present inputs (but for others)."""
    number = c("project").cast("long")
    state = _material(t, False).where(number % 13 != 0).select("project", (number % 4 + 1).alias("revision"), "fingerprint", F.lit(1).cast("long").alias("trusted_revision"))
    now = _material(t, True).where(number % 17 != 0).select("project", "fingerprint", (1 + (number % 5 == 0).cast("long")).alias("trusted_revision"))
    return O.rebuild_plan(state, now)


@query(f"""WITH {_fingers(False, 'a')}, {_fingers(True, 'b')}, s AS (SELECT *, project::BIGINT % 4 + 1 AS revision FROM a WHERE project::BIGINT % 13 <> 0), n AS (SELECT *, 1 + (project::BIGINT % 5 = 0)::BIGINT AS trusted FROM b WHERE project::BIGINT % 17 <> 0)
           SELECT project, CASE WHEN n.fingerprint IS NULL THEN 'drop' WHEN s.fingerprint IS NULL THEN 'create' WHEN n.fingerprint <> s.fingerprint THEN 'rebuild' WHEN trusted <> 1 THEN 'refresh' ELSE 'keep' END AS action,
                  CASE WHEN s.fingerprint IS NULL THEN 1 WHEN n.fingerprint <> s.fingerprint THEN revision + 1 ELSE revision END AS revision, coalesce(n.fingerprint, s.fingerprint) AS fingerprint, coalesce(trusted, 1) AS trusted_revision FROM s FULL JOIN n USING (project)""")
def x35b_rebuild_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query(f"""WITH {_rows_sql(True)} SELECT project, assertion_id AS id, entity_id, value, review FROM r WHERE project::BIGINT % 17 <> 0""")
def x35b_rebuilt_assertions(t: Tables) -> DataFrame:
    """Only changed and new projects are built; the result is that of a full build of all projects that are not dropped."""
    after = O.rebuild(O.build(_inputs(t)), _inputs(t, True), _plan(t))
    return after["assertions"].select("project", "id", "entity_id", "value", "review")


# --- X44, X45, X48: drift and repairs ----------------------------------------------------

#: Models whose rows stand in orders, by the remainder of the key.
BY_ORDER = ("identityKeys", "aliases", "relationships", "conflicts", "conflictAssertionLinks", "sources", "evidence", "assertionSourceLinks", "assertionEvidenceLinks")


def _state(t: Tables, persisted: bool) -> dict[str, DataFrame]:
    """Customers have four entities, three of which redirect to the next; orders stand for the other rows."""
    p, j, k = c("project"), c("j"), c("id")
    each = t.customer.select(c("c_custkey").alias("project"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).withColumn("id", p * 10 + j)
    entities = each.select("project", "id", F.when((p % 19 == 0) & (j < 2) & F.lit(persisted), "u").otherwise("t").alias("type"), ((p + j) % 5 != 0).alias("active"))
    redirects = each.where("j > 0" + (" or project % 17 = 0" if persisted else "")).where("not (j = 2 and project % 7 = 0)" if persisted else "true")
    redirects = redirects.select("project", "id", F.when(j > 0, k - 1).otherwise(k + 3).alias("dst"))
    owner = F.when((p % 3 == 0) & F.lit(persisted), p * 10).when((p % 3 == 1) & F.lit(persisted) & (j == 3), p * 10 + 2).otherwise(k)
    owned = each.select("project", "id", owner.alias("entity"))
    out = {"resolvedEntities": entities, "redirects": redirects, "sourceEntityOwnership": owned, "assertionOwnership": owned.where("id % 10 < 2")}
    rows = t.orders.withColumns({"project": c("o_custkey"), "id": c("o_orderkey")}).where("id % 11 <> 0" if persisted else "id % 7 <> 0")
    value = (k % 5 + ((k % 6 == 0).cast("int") if persisted else 0)).alias("v")
    own = {
        "identityKeys": [F.concat(F.lit("e"), (k % 4).cast("string")).alias("entity"), F.lit("email").alias("type"), c("o_orderpriority").alias("value"), (k % 2 == 0).alias("strong"), F.lit(True).alias("authoritative")],
        "aliases": [(k % 3 == 0).alias("accepted")],
        "relationships": [F.when(k % 3 == 0, "supports").otherwise("related").alias("kind"), (k % 2).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("from_assertion"), F.lit(0).alias("to_assertion")],
    }
    for i, model in enumerate(BY_ORDER):
        out[model] = rows.where(k % len(BY_ORDER) == i).select("project", "id", value, *own.get(model, []))
    return out


def _found(t: Tables) -> DataFrame:
    p = c("c_custkey")
    heads = t.customer.select(p.alias("project"), F.lit(5).alias("desired_trusted"), F.when(p % 23 == 0, 4).otherwise(5).alias("persisted_trusted"), F.lit("f").alias("desired_fingerprint"), F.when(p % 29 == 0, F.lit(None)).otherwise("f").alias("persisted_fingerprint"))
    issues = t.customer.where(p % 31 == 0).select(p.alias("project"), F.lit("governance_history_gap").alias("category"), p.alias("id")).union(t.customer.where(p % 37 == 0).select(p, F.lit("governance_history_integrity_failure"), p))
    return O.drift(_state(t, False), _state(t, True), heads, issues)


def _drift_sql() -> str:
    kinds = lambda at: " ".join(f"WHEN '{m}' THEN '{v[at]}'" for m, v in O.MODELS.items())
    model = f"{list(BY_ORDER)!r}[o_orderkey % {len(BY_ORDER)} + 1]"
    reported = ", ".join(f"'{m}'" for m in O.REPORTED)
    one = lambda category, m, repairable, action, rest, id="id": f"SELECT project, '{category}', '{m}', {id}::VARCHAR, 1, {repairable}, '{action}' FROM {rest}"
    return f"""cust AS (SELECT c_custkey AS project, j, c_custkey * 10 + j AS id FROM customer, range(4) r(j)),
        ord AS (SELECT o_custkey AS project, o_orderkey AS id, {model} AS model, o_orderpriority AS prio FROM orders),
        byorder AS (SELECT project, model, id, id % 11 = 0 AS no_have, id % 7 = 0 AS absent, id % 6 = 0 AS stale, model = 'aliases' AND id % 3 = 0 AS accepted, model IN ({reported}) OR (model = 'relationships' AND id % 3 <> 0) AS held FROM ord),
        o1 AS (SELECT project, CASE WHEN no_have THEN CASE model {kinds(0)} END WHEN absent THEN 'unexpected_row' ELSE CASE model {kinds(1)} END END AS category, model, id::VARCHAR AS id, 1 AS n, CASE WHEN absent THEN NOT held ELSE true END AS repairable,
                  CASE WHEN no_have THEN 'insert' WHEN absent THEN CASE WHEN held THEN 'report' ELSE 'deactivate' END ELSE 'update' END AS action FROM byorder
               WHERE (no_have AND NOT absent) OR (absent AND NOT no_have AND NOT accepted) OR (NOT no_have AND NOT absent AND stale)),
        kept AS (SELECT project, id, CASE WHEN j > 0 THEN id - 1 ELSE id + 3 END AS dst, j FROM cust WHERE (j > 0 OR project % 17 = 0) AND NOT (j = 2 AND project % 7 = 0)),
        keys AS (SELECT project, prio, count(DISTINCT id % 4) AS owners, count(*) AS n, min('e' || id % 4) AS id FROM ord WHERE model = 'identityKeys' AND id % 11 <> 0 AND id % 2 = 0 GROUP BY ALL),
        rel AS (SELECT project, id % 3 = 0 AS s, id % 2 AS a, min(id) AS id, count(*) AS n FROM ord WHERE model = 'relationships' AND id % 11 <> 0 GROUP BY ALL),
        d(project, category, model, id, n, repairable, action) AS (SELECT * FROM o1
          UNION ALL {one('stale_field', 'resolvedEntities', 'true', 'update', "cust WHERE j = 0 AND project % 19 = 0")}
          UNION ALL {one('missing_row', 'redirects', 'true', 'insert', 'cust WHERE j = 2 AND project % 7 = 0')}
          UNION ALL {one('unexpected_row', 'redirects', 'false', 'report', 'cust WHERE j = 0 AND project % 17 = 0')}
          UNION ALL {one('wrong_entity_ownership', 'sourceEntityOwnership', 'true', 'update', 'cust WHERE j = 3 AND project % 3 = 1')}
          UNION ALL {one('broken_redirect', 'redirects', 'true', 'update', 'kept WHERE (project + dst % 10) % 5 = 0')}
          UNION ALL {one('redirect_cycle', 'redirects', 'false', 'block', 'kept WHERE project % 17 = 0 AND project % 7 <> 0')}
          UNION ALL SELECT project, 'conflicting_identity_key_ownership', 'identityKeys', id, n, false, 'block' FROM keys WHERE owners > 1
          UNION ALL SELECT project, 'duplicate_relationship', 'relationships', id::VARCHAR, n, true, 'deactivate' FROM rel WHERE n > 1
          UNION ALL {one('trusted_knowledge_revision_mismatch', 'business_memory', 'true', 'synchronize_trusted_knowledge_revision', 'cust WHERE j = 0 AND project % 23 = 0', "''").replace(", 1, ", ", 0, ")}
          UNION ALL {one('revision_fingerprint_mismatch', 'business_memory', 'true', 'synchronize_fingerprint', 'cust WHERE j = 0 AND project % 29 = 0', "''").replace(", 1, ", ", 0, ")}
          UNION ALL {one('governance_history_gap', 'governance', 'false', 'block', 'cust WHERE j = 0 AND project % 31 = 0', 'project')}
          UNION ALL {one('governance_history_integrity_failure', 'governance', 'false', 'block', 'cust WHERE j = 0 AND project % 37 = 0', 'project')})"""


@query(f"WITH {_drift_sql()} SELECT * FROM d")
def x44_state_drift(t: Tables) -> DataFrame:
    return _found(t)


def _operation_sql() -> str:
    operation = f"coalesce({_case('model', O.MODEL_OPERATION, '')[:-len(' ELSE ' + repr('') + ' END')]} END, {_case('category', O.OPERATION, '')})"
    return f"{operation} AS operation"


@query(f"""WITH {_drift_sql()}, bad AS (SELECT DISTINCT project FROM d WHERE NOT repairable), plan AS (SELECT *, {_operation_sql()} FROM d WHERE project NOT IN (SELECT project FROM bad))
           SELECT project, {_case('operation', {k: str(v) for k, v in O.RANK.items()}, '')}::INT AS rank, operation, category, model, id, action FROM plan""")
def x45_typed_repairs(t: Tables) -> DataFrame:
    return O.repair_plan(_found(t))[0]


@query(f"""WITH {_drift_sql()}, own AS (SELECT project, count(*) AS n, bool_and(repairable) AS fine FROM d GROUP BY project), x AS (SELECT c_custkey AS project, c_custkey % 4 AS revision, CASE WHEN c_custkey % 41 = 0 THEN 9 ELSE c_custkey % 4 END AS expected FROM customer),
           y AS (SELECT x.*, coalesce(n, 0) AS n, CASE WHEN revision <> expected THEN 'conflict' WHEN own.n IS NULL THEN 'no_op' WHEN NOT fine THEN 'blocked' ELSE 'repaired' END AS outcome FROM x LEFT JOIN own USING (project))
           SELECT project, outcome, n, revision + (outcome = 'repaired')::BIGINT AS revision FROM y""")
def x48_reconcile_outcome(t: Tables) -> DataFrame:
    p = c("c_custkey")
    heads = t.customer.select(p.alias("project"), (p % 4).alias("revision"), F.when(p % 41 == 0, 9).otherwise(p % 4).alias("expected"))
    return O.outcome(_found(t), heads)


# --- X41: merges -------------------------------------------------------------------------


def _merge_state(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Projects of twenty customers, in chains of five that links connect."""
    k = c("c_custkey")
    own = t.customer.select(F.floor(k / 20).alias("project"), k.alias("id"))
    i = c("id")
    entities = own.select("project", "id", F.when(i % 37 == 0, "product").otherwise("service").alias("type"), (i % 41 != 0).alias("active"))
    links = own.where("id % 5 <> 0").select("project", i.alias("a"), (i - 1).alias("b"))
    keys = own.where("id % 7 = 0").select("project", i.alias("entity"), F.concat(F.lit("k"), i.cast("string")).alias("id"), F.lit("email").alias("type"), (i % 3).cast("string").alias("value"), (i % 2).alias("source"), F.lit(True).alias("strong"), (i % 4 < 3).alias("authoritative"))
    aliases = own.select("project", i.alias("entity"), F.concat(F.lit("a"), i.cast("string")).alias("id"), (i % 2).cast("string").alias("value"), (i % 3 == 0).alias("accepted"))
    redirects = own.where("id % 20 in (6, 7, 11, 12)").select("project", i.alias("src"), F.when(i % 20 == 6, i + 1).when(i % 20 == 7, F.when(i % 3 == 0, i - 1).otherwise(i + 1)).otherwise(i - 1).alias("dst"))
    return links, {"entities": entities, "keys": keys, "aliases": aliases, "redirects": redirects, "ownership": own.select("project", i.alias("entity"), (i * 10).alias("source_entity"))}


def _merges(t: Tables) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    links, state = _merge_state(t)
    done, refused = O.merges(links, state["entities"], state["keys"].where("strong and authoritative"))
    return done, refused, state


MERGES = """e AS (SELECT c_custkey // 20 AS project, c_custkey AS id, CASE WHEN c_custkey % 37 = 0 THEN 'product' ELSE 'service' END AS type, c_custkey % 41 <> 0 AS active FROM customer),
    run AS (SELECT *, sum(starts) OVER (PARTITION BY project ORDER BY id) AS g FROM (SELECT *, (id % 5 = 0 OR lag(id) OVER (PARTITION BY project ORDER BY id) IS DISTINCT FROM id - 1)::INT AS starts FROM e WHERE active)),
    own AS (SELECT project, id, type, min(id) OVER (PARTITION BY project, g) AS root, count(*) OVER (PARTITION BY project, g) AS size FROM run),
    own2 AS (SELECT * FROM own WHERE size > 1),
    o AS (SELECT DISTINCT e.project, e.id % 3 AS value, coalesce(root, e.id) AS owner, root IS NOT NULL AS moves FROM e LEFT JOIN own2 ON own2.id = e.id WHERE e.id % 7 = 0 AND e.id % 4 < 3),
    bad AS (SELECT project, root AS survivor, 'business_memory_incompatible_entity_types' AS code FROM own2 GROUP BY project, root HAVING count(DISTINCT type) > 1
            UNION ALL SELECT project, owner, 'business_memory_conflicting_strong_identity_key' FROM o WHERE moves AND (project, value) IN (SELECT (project, value) FROM o GROUP BY project, value HAVING count(*) > 1)),
    refused AS (SELECT project, survivor, max(code) AS code FROM bad GROUP BY ALL),
    done AS (SELECT project, id, root AS survivor FROM own2 WHERE root NOT IN (SELECT survivor FROM refused))"""


@query(f"WITH {MERGES} SELECT project, id, survivor, NULL AS code FROM done UNION ALL SELECT project, NULL, survivor, code FROM refused")
def x41_entity_merges(t: Tables) -> DataFrame:
    done, refused, _ = _merges(t)
    return done.withColumn("code", F.lit(None).cast("string")).unionByName(refused.withColumn("id", F.lit(None).cast("long")).select("project", "id", "survivor", "code"))


@query(f"""WITH RECURSIVE {MERGES}, r0 AS (SELECT project, id AS src, CASE WHEN id % 20 = 6 THEN id + 1 WHEN id % 20 = 7 THEN CASE WHEN id % 3 = 0 THEN id - 1 ELSE id + 1 END ELSE id - 1 END AS dst FROM e WHERE id % 20 IN (6, 7, 11, 12)),
           r AS (SELECT * FROM r0 WHERE src NOT IN (SELECT id FROM done WHERE id <> survivor) UNION ALL SELECT * FROM done WHERE id <> survivor),
           walk(project, src, dst, n) AS (SELECT project, src, dst, 1 FROM r UNION ALL SELECT w.project, w.src, r.dst, n + 1 FROM walk w JOIN r ON r.project = w.project AND r.src = w.dst WHERE n < 30)
           SELECT project, src, CASE WHEN max(n) < 30 THEN arg_max(dst, n) END AS dst FROM walk GROUP BY project, src""")
def x41_flat_redirects(t: Tables) -> DataFrame:
    """Old and new redirects followed to their ends; null where they lead into a cycle."""
    done, _, state = _merges(t)
    after = O.merged_state(state, done)
    return after["redirects"].unionByName(after["cycles"].withColumn("dst", F.lit(None).cast("long")))


@query(f"""WITH {MERGES}, x AS (SELECT e.project, coalesce(survivor, e.id) AS entity, e.id FROM e LEFT JOIN done ON done.id = e.id)
           SELECT 'alias' AS kind, project, entity, (id % 2)::VARCHAR AS value, min('a' || id) AS id, bool_or(id % 3 = 0) AS flag, count(*) AS n FROM x GROUP BY ALL
           UNION ALL SELECT 'key' || id % 2, project, entity, (id % 3)::VARCHAR, min('k' || id), bool_or(id % 4 < 3), count(*) FROM x WHERE id % 7 = 0 GROUP BY ALL""")
def x41_merged_aliases_and_keys(t: Tables) -> DataFrame:
    done, _, state = _merges(t)
    after = O.merged_state(state, done)
    aliases = after["aliases"].select(F.lit("alias").alias("kind"), "project", "entity", "value", "id", c("accepted").alias("flag"), "n")
    return aliases.union(after["keys"].select(F.concat(F.lit("key"), c("source").cast("string")), "project", "entity", "value", "id", "authoritative", "n"))


@query("""WITH x AS (SELECT o_custkey AS project, o_orderkey AS k FROM orders), y AS (SELECT *, k % 4 AS expected, project % 4 AS revision, k % 11 = 0 AS no_members, k % 13 = 0 AS dead, k % 17 = 0 AS other FROM x)
          SELECT project, k AS command, CASE WHEN k % 19 = 0 AND k % 2 = 0 THEN 'business_memory_merge_command_content_conflict' WHEN k % 19 = 0 THEN NULL WHEN expected <> revision THEN 'business_memory_stale_revision' WHEN no_members THEN 'business_memory_invalid_merge_members'
                 WHEN dead THEN 'business_memory_invalid_merge_survivor' WHEN k % 23 = 0 THEN 'business_memory_invalid_merge_entity' WHEN other THEN 'business_memory_incompatible_entity_types'
                 WHEN k % 2 = 0 AND k % 3 = 0 THEN 'business_memory_unqualified_auto_merge' WHEN k % 2 = 1 AND k % 5 = 0 THEN 'business_memory_manual_merge_requires_actor_and_reason' END AS code, k % 19 = 0 AND k % 2 = 1 AS replayed FROM y""")
def x41_merge_commands(t: Tables) -> DataFrame:
    """Each project has entities 1 and 2, a product 3 and an inactive 4; commands of every kind of fault."""
    k = c("o_orderkey")
    commands = t.orders.select(
        c("o_custkey").alias("project"), k.alias("command"), F.when(k % 13 == 0, 4).otherwise(1).alias("survivor"),
        F.when(k % 11 == 0, F.array(F.lit(2), F.lit(2))).when(k % 23 == 0, F.array(F.lit(2), F.lit(9))).when(k % 17 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(5))).alias("merged"), (k % 4).alias("expected"), (k % 2 == 0).alias("auto"),
        F.when(k % 3 == 0, F.array(F.lit("exact_weak_key"))).otherwise(F.array(F.lit("authoritative_exact_key"))).alias("evidence"), F.when(k % 5 == 0, " ").otherwise("someone").alias("actor"), F.lit("reason").alias("reason"),
    )
    projects = t.orders.select(c("o_custkey").alias("project")).distinct()
    row = lambda i, kind, live: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), F.lit(live).alias("active"))
    entities = projects.select("project", F.explode(F.array(row(1, "service", True), row(2, "service", True), row(3, "product", True), row(4, "service", False))).alias("e")).select("project", "e.*")
    redirects = projects.select("project", F.lit(5).alias("src"), F.lit(2).alias("dst"))
    ledger = commands.withColumn("digest", O.row_digest(commands, "project")).where("command % 19 = 0").select("project", "command", F.when(c("command") % 2 == 0, "other").otherwise(c("digest")).alias("digest"))
    return O.merge_refusals(commands, entities, redirects, projects.withColumn("revision", c("project") % 4), ledger)
