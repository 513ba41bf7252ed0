"""Queries over contributions, conventions, review rounds and event order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conventions as cv
from ..operators import curation as cu
from ..operators import review as rv
from ..streaming import streams as st
from .fixtures import PATTERNS, query, rows, table, terms
from .relational import NO_TEXTS, found_sql
from .texts import HITS, LINES, VERBATIM, docs, sources

# --- contributions

C = "{contrib}"


#: One perspective more: an item for each event, over a hundred a run.
MANY = """SELECT run_id, perspective, item_no, item_id, section, consideration FROM {contrib} c
    UNION ALL SELECT run_id, 'ops' AS perspective, item_no, concat(CAST(run_id AS STRING), '/ops/', CASE WHEN item_no < 10 THEN '0' ELSE '' END, CAST(item_no AS STRING)) AS item_id, 's1' AS section, 'event' AS consideration
    FROM (SELECT CAST(floor(event_id / 250) AS BIGINT) AS run_id, 1 + event_id % 250 AS item_no FROM {events}) e"""


def items(s: SparkSession, d: str) -> DataFrame:
    n, k = F.col("item_no"), F.col("run_id")
    own = rows(s, d, MANY).withColumn("item_no", n)
    return own.select("run_id", "perspective", "item_no", F.when((n + k) % 17 == 0, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")).alias("item_id"), F.when(k % 9 == 0, "s9").otherwise(F.col("section")).alias("target_section"), "consideration", F.when(n % 13 == 6, " ").otherwise("?").alias("human_question"), F.when(k % 7 == 0, "odd").otherwise("both").alias("human_need"), F.when(n % 4 == 3, F.array(F.lit("a"), F.lit("zz"))).otherwise(F.array(F.lit("a"))).alias("evidence_refs"))


def section_defs(s, d):
    return rows(s, d, "SELECT DISTINCT conv_id AS run_id FROM {conversations}").select("run_id", F.posexplode(F.array(*(F.lit(f"s{i}") for i in (3, 1, 0, 2)))).alias("pos", "section"))


def files(s, d):
    return rows(s, d, "SELECT DISTINCT conv_id AS run_id, 'a' AS path FROM {conversations}")


IT = f"(SELECT *, CAST(row_number() OVER (PARTITION BY run_id, perspective ORDER BY item_no) AS BIGINT) AS rn, CASE WHEN (item_no + run_id) % 17 = 0 THEN concat(item_id, 'x') ELSE item_id END AS iid FROM ({MANY}) c)"


@query("cu1_envelope_violations", found_sql("run_id", ("id_out_of_sequence", "iid", "concat(CAST(run_id AS STRING), '/', perspective, '/', CASE WHEN rn < 10 THEN '0' ELSE '' END, CAST(rn AS STRING))", f"{IT} i WHERE iid <> concat(CAST(run_id AS STRING), '/', perspective, '/', CASE WHEN rn < 10 THEN '0' ELSE '' END, CAST(rn AS STRING))"), ("human_question_blank", "iid", "NULL", f"{IT} i WHERE item_no % 13 = 6"), ("need_unknown", "iid", "'odd'", f"{IT} i WHERE run_id % 7 = 0"), ("section_unknown", "iid", "'s9'", f"{IT} i WHERE run_id % 9 = 0"), ("evidence_not_captured", "iid", "'zz'", f"{IT} i WHERE item_no % 4 = 3")))
def _(s, d):
    return cu.envelope_violations(items(s, d), section_defs(s, d), files(s, d))


@query("cu1_item_index", f"SELECT run_id, iid AS item_id, perspective, CASE WHEN run_id % 9 = 0 THEN 's9' ELSE section END AS target_section, CAST(row_number() OVER (PARTITION BY run_id ORDER BY iid) AS INTEGER) AS pos FROM {IT} i")
def _(s, d):
    return cu.item_index(items(s, d))


def clean_items(s, d):
    return rows(s, d, "contrib").select("run_id", "perspective", "item_no", "item_id", F.col("section").alias("target_section"), "consideration")


def dispositions(s, d):
    n, status = F.col("item_no"), F.col("status")
    own = rows(s, d, "contrib").where("item_no % 11 <> 10")
    refs = F.when((status == "supported") & (n % 4 != 2), F.array(F.concat(F.lit("m"), (n % 3).cast("string")))).when(n % 9 == 8, F.array(F.lit("m9"))).otherwise(F.array().cast(NO_TEXTS))
    made = own.select("run_id", "item_id", "status", F.when(n % 4 == 1, F.concat(F.lit("g"), (n % 2).cast("string"))).otherwise("").alias("group_id"), F.when((status == "decided") & (n % 3 != 0), "yes").otherwise("").alias("decision"), refs.alias("material_refs"), F.when(n % 4 != 0, "why").otherwise("").alias("rationale"), n.alias("n"))
    return made.unionByName(made.where("n % 13 = 2")).unionByName(made.where("n = 0").withColumns({"item_id": F.concat(F.lit("?"), "item_id"), "status": F.lit("odd")})).drop("n")


def materials(s, d):
    return rows(s, d, "SELECT DISTINCT conv_id AS run_id FROM {conversations}").select("run_id", F.explode(F.array(*(F.lit(f"m{i}") for i in range(3)))).alias("material_id")).withColumn("sha256", F.sha2(F.when(F.col("material_id") == "m2", "m1").otherwise(F.col("material_id")), 256))


DI = "(SELECT *, unnest(CASE WHEN item_no % 13 = 2 THEN [1, 2] ELSE [1] END) AS copy FROM {contrib} c WHERE item_no % 11 <> 10)"


@query("cu2_disposition_coverage", found_sql("run_id", ("decided_without_decision", "item_id", "NULL", f"{DI} i WHERE status = 'decided' AND item_no % 3 = 0"), ("supported_without_material", "item_id", "NULL", f"{DI} i WHERE status = 'supported' AND item_no % 4 = 2 AND item_no % 9 <> 8"), ("no_rationale", "item_id", "status", f"{DI} i WHERE status IN ('carried', 'dismissed') AND item_no % 4 = 0"), ("item_without_disposition", "item_id", "NULL", f"{C} c WHERE item_no % 11 = 10"),
    ("disposition_repeated", "item_id", "2", f"{C} c WHERE item_no % 11 <> 10 AND item_no % 13 = 2"), ("material_unknown", "item_id", "'m9'", f"{DI} i WHERE NOT (status = 'supported' AND item_no % 4 <> 2) AND item_no % 9 = 8"), ("status_unknown", "concat('?', item_id)", "'odd'", f"{C} c WHERE item_no = 0"), ("item_unknown", "concat('?', item_id)", "NULL", f"{C} c WHERE item_no = 0")))
def _(s, d):
    return cu.disposition_coverage(clean_items(s, d), dispositions(s, d), materials(s, d))


SIGN = "concat(status, '|', section, '|', CASE WHEN status = 'decided' AND item_no % 3 <> 0 THEN 'yes' ELSE '' END, '|', CASE WHEN item_no % 4 <> 0 THEN 'why' ELSE '' END, '|', CASE WHEN status = 'supported' AND item_no % 4 <> 2 THEN concat('m', CAST(item_no % 3 AS STRING)) WHEN item_no % 9 = 8 THEN 'm9' ELSE '' END)"


@query("cu3_group_consistency", f"SELECT run_id, concat('g', CAST(item_no % 2 AS STRING)) AS group_id, count(DISTINCT {SIGN}) AS n FROM {DI} i WHERE item_no % 4 = 1 GROUP BY 1, 2 HAVING count(DISTINCT {SIGN}) > 1")
def _(s, d):
    return cu.group_consistency(clean_items(s, d), dispositions(s, d))


def good_dispositions(s, d):
    return rows(s, d, "contrib").select("run_id", "item_id", "status", F.when(F.col("item_no") % 4 == 1, "g").otherwise("").alias("group_id"), F.lit("yes").alias("decision"), F.when(F.col("status") == "supported", F.array(F.lit("m1"), F.lit("m2"), F.lit("m0"))).otherwise(F.array().cast(NO_TEXTS)).alias("material_refs"), F.lit("why").alias("rationale"))


CURATED = """(SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE section WHEN 's3' THEN 0 WHEN 's1' THEN 1 WHEN 's0' THEN 2 ELSE 3 END, CASE WHEN item_no % 4 = 1 THEN 0 ELSE 1 END, CASE status WHEN 'decided' THEN 1 WHEN 'supported' THEN 2 WHEN 'carried' THEN 3 WHEN 'open' THEN 4 ELSE 5 END, item_id) AS INTEGER) AS pos, item_id, perspective,
CASE WHEN item_no % 4 = 1 THEN 'g' ELSE '' END AS group_id, status, section AS target_section, consideration, 'yes' AS decision, CASE WHEN status = 'supported' THEN array_to_string(list_sort([sha256('m0'), sha256('m1')]), ',') ELSE '' END AS material_sha256, 'why' AS rationale FROM {contrib} c)"""


def curated(s, d):
    return cu.curated_items(clean_items(s, d), good_dispositions(s, d), materials(s, d), section_defs(s, d))


@query("cu4_curated_items", f"SELECT * FROM {CURATED} c")
def _(s, d):
    return curated(s, d).withColumn("material_sha256", F.array_join("material_sha256", ","))


@query("cu4_curation_digest", "SELECT run_id, sha256(string_agg(concat('{\"item_id\":\"', item_id, '\",\"status\":\"', status, '\"}'), chr(10) ORDER BY pos)) AS digest, count(*) AS n FROM " + CURATED + " c GROUP BY 1")
def _(s, d):
    return cu.curation_digest(curated(s, d).select("run_id", "pos", "item_id", "status"))


@query("cu5_curated_notes", f"SELECT run_id, CASE WHEN status = 'open' THEN 'open' ELSE 'settled' END AS part, target_section, CASE WHEN status = 'open' THEN '' ELSE group_id END AS group_id, count(*) AS n, string_agg(concat('- ', consideration, ' (', item_id, ')'), chr(10) ORDER BY pos) AS note FROM {CURATED} c GROUP BY 1, 2, 3, 4")
def _(s, d):
    return cu.curated_notes(curated(s, d))


# --- conventions: a profile per supplier nation, an intake per supplier


def profiles(s, d, name="nation", key="n_nationkey"):
    n = table(s, d, name).select(F.col(key).cast("string").alias("profile_id"), F.col(key).alias("k"))
    own = n.select("profile_id", "k", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos"))
    q, k = F.col("pos"), F.col("k")
    return own.select("profile_id", "pos", F.concat(F.lit("q"), q.cast("string")).alias("question_id"), F.when((k % 5 == 0) & (q == 1), F.array().cast(NO_TEXTS)).otherwise(F.array(F.lit("t1"), F.lit("t2"))).alias("targets"), F.when((k % 7 == 0) & (q == 2), F.array(F.lit("world"))).otherwise(F.array(F.lit("document"), F.lit("template"))).alias("allowed_scopes"), F.array(F.lit("A"), F.concat(F.lit("B"), q.cast("string"))).alias("required_sections"))


def options(s, d, *of):
    p, k = profiles(s, d, *of), F.col("profile_id").cast("long")
    own = p.where(~((k % 6 == 1) & (F.col("pos") == 3))).select("profile_id", "question_id", F.explode(F.array(F.lit("o1"), F.lit("o2"))).alias("option_id"))
    return own.withColumn("targets", F.when((k % 4 == 2) & (F.col("option_id") == "o2"), F.array(F.lit("t1"))).otherwise(F.array(F.lit("t2"), F.lit("t1"))))


PQ = "(SELECT CAST(n_nationkey AS STRING) AS profile_id, n_nationkey AS k, unnest([1, 2, 3, 4]) AS q FROM {nation} n)"


#: A profile for each customer.
PC = "(SELECT CAST(c_custkey AS STRING) AS profile_id, c_custkey AS k, unnest([1, 2, 3, 4]) AS q FROM {customer} n)"


@query("cv1_profile_violations", found_sql("profile_id", ("targets_empty", "concat('q', q)", "NULL", f"{PC} p WHERE k % 5 = 0 AND q = 1"), ("scope_unknown", "concat('q', q)", "NULL", f"{PC} p WHERE k % 7 = 0 AND q = 2"), ("no_options", "concat('q', q)", "NULL", f"{PC} p WHERE k % 6 = 1 AND q = 3"), ("option_targets", "concat('q', q)", "o", f"(SELECT *, unnest(['o1', 'o2']) AS o FROM {PC} p) WHERE NOT (k % 6 = 1 AND q = 3) AND (k % 5 = 0 AND q = 1 OR k % 4 = 2 AND o = 'o2')")))
def _(s, d):
    return cv.profile_violations(profiles(s, d, "customer", "c_custkey"), options(s, d, "customer", "c_custkey"))


def intakes(s, d):
    k = F.col("s_suppkey")
    seen = F.when(k % 3 == 0, F.array(F.lit("A"), F.lit("B1"), F.lit("B4"))).otherwise(F.array(F.lit("B2")))
    return table(s, d, "supplier").select(k.cast("string").alias("intake_id"), F.col("s_nationkey").cast("string").alias("profile_id"), F.when(k % 4 == 3, "inapplicable").otherwise("applicable").alias("result"), F.when(k % 4 == 3, seen).alias("observed_sections"), F.when(k % 5 != 0, "doc").alias("target_document"))


def answers(s, d):
    i = intakes(s, d).where("result = 'applicable'").select("intake_id", F.col("intake_id").cast("long").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    i = i.where("not (k % 6 = 0 and q = 4)").unionByName(i.where("k % 10 = 1 and q = 2")).unionByName(i.where("k % 9 = 0 and q = 1").withColumn("q", F.lit(7)))
    k, q = F.col("k"), F.col("q")
    state = F.when(q == 1, "inapplicable").when(q == 2, "unanswered").when(q == 3, "answered").otherwise("approved_to_draft")
    said = q >= 3
    return i.select("intake_id", F.concat(F.lit("q"), q.cast("string")).alias("question_id"), F.when(q == 1, "inapplicable").otherwise("applicable").alias("applicability"), F.lit("seen").alias("evidence"), (said | ((q == 1) & (k % 7 == 0))).alias("asked"), F.when(said, F.when(k % 8 == 0, "o9").otherwise("o1")).when((q == 2) & (k % 11 == 0), "o1").alias("response"), F.when(said & (k % 13 != 0), "me").alias("authority"), F.when(said, "document").alias("scope"), F.when(said, "mail").alias("source"), state.alias("approval"))


AN = "(SELECT CAST(s_suppkey AS STRING) AS intake_id, s_suppkey AS k, s_nationkey AS n, unnest([1, 2, 3, 4]) AS q FROM {supplier} s WHERE s_suppkey % 4 <> 3)"
AN2 = f"(SELECT *, unnest(CASE WHEN k % 10 = 1 AND q = 2 THEN [1, 2] ELSE [1] END) AS c FROM {AN} a WHERE NOT (k % 6 = 0 AND q = 4))"


@query("cv2_intake_coverage", f"SELECT intake_id, concat('q', q) AS question_id, 'missing' AS state FROM {AN} a WHERE k % 6 = 0 AND q = 4 UNION ALL SELECT intake_id, 'q7', 'unknown' FROM {AN} a WHERE k % 9 = 0 AND q = 1 UNION ALL SELECT intake_id, 'q2', 'repeated' FROM {AN} a WHERE k % 10 = 1 AND q = 2")
def _(s, d):
    return cv.intake_coverage(profiles(s, d), intakes(s, d), answers(s, d))


@query("cv3_answer_states", found_sql("intake_id", ("inapplicable_asked", "concat('q', q)", "NULL", f"{AN2} a WHERE q = 1 AND k % 7 = 0"), ("unanswered_filled", "concat('q', q)", "NULL", f"{AN2} a WHERE q = 2 AND k % 11 = 0"), ("response_not_an_option", "concat('q', q)", "CASE WHEN k % 8 = 0 THEN 'o9' ELSE 'o1' END", f"{AN2} a WHERE q > 2 AND (k % 8 = 0 OR q = 3 AND n % 6 = 1)"), ("authority_blank", "concat('q', q)", "NULL", f"{AN2} a WHERE q > 2 AND k % 13 = 0"), ("document_unnamed", "concat('q', q)", "NULL", f"{AN2} a WHERE q > 2 AND k % 5 = 0")))
def _(s, d):
    return cv.answer_state_violations(profiles(s, d), options(s, d), intakes(s, d), answers(s, d))


@query("cv4_applicability", "SELECT CAST(s_suppkey AS STRING) AS intake_id, unnest(['q1', 'q4']) AS question_id FROM {supplier} s WHERE s_suppkey % 4 = 3 AND s_suppkey % 3 = 0")
def _(s, d):
    return cv.applicability_contradictions(profiles(s, d), intakes(s, d))


@query("cv5_materialize", f"""SELECT CAST(s_suppkey AS STRING) AS intake_id, 'refused' AS state, CAST(NULL AS STRING) AS key, CAST(NULL AS STRING) AS identity, CAST(NULL AS STRING) AS body, CAST(NULL AS INTEGER) AS pos FROM {{supplier}} s WHERE s_suppkey % 4 = 3 OR s_suppkey % 6 = 0
UNION ALL SELECT intake_id, 'merged', 'sections', unnest(['i4', 'x']), unnest(['b', 'b']), unnest([1, 2]) FROM {AN2} a WHERE q = 4 AND k % 8 <> 0 AND k % 2 = 0
UNION ALL SELECT intake_id, unnest(['merged', 'conflict']), 'sections', unnest(['i4', 'x']), unnest(['b', 'b']), unnest([1, 2]) FROM {AN2} a WHERE q = 4 AND k % 8 <> 0 AND k % 2 = 1""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    a = answers(s, d).where("question_id = 'q4'").unionByName(answers(s, d).where("question_id = 'q3'").join(answers(s, d).where("question_id = 'q4'").select("intake_id"), "intake_id", "left_semi").withColumn("approval", F.when(F.col("intake_id").cast("long") % 2 == 1, "approved_to_draft").otherwise("answered")))
    one = profiles(s, d).where("pos >= 3").select("profile_id", "question_id", F.lit("o1").alias("option_id"), F.lit("sections").alias("key"), F.explode(F.when(F.col("pos") == 4, F.array(F.lit("i4"), F.lit("x"))).otherwise(F.array(F.lit("x")))).alias("identity"), F.when(F.col("pos") == 4, "b").otherwise("c").alias("body"), "pos")
    # question 4 comes first in the order here, so its bodies are the ones kept
    order = profiles(s, d).withColumn("pos", -F.col("pos"))
    return cv.materialize_conventions(order, intakes(s, d), a, one.drop("pos"))


# --- review rounds


@query("rv1_next_round", """SELECT o_custkey AS k, CAST(min(n) AS INTEGER) AS next_round FROM (SELECT o_custkey, unnest(range(1, 60)) AS n FROM (SELECT DISTINCT o_custkey FROM orders)) c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o.o_orderkey % 4 < 3 AND o.o_orderkey % 6 + 1 = c.n) GROUP BY 1""")
def _(s, d):
    n = F.col("o_orderkey")
    r = (n % 6 + 1).cast("string")
    name = F.when(n % 4 == 0, F.concat(F.lit("PROMPT_doc_r"), r)).when(n % 4 == 1, F.concat(F.lit("x_REVIEW_r"), r, F.lit(".md"))).when(n % 4 == 2, F.concat(F.lit("TRIAGE_r"), r)).otherwise(F.concat(F.lit("NOTES_r"), r))
    return rv.next_round(table(s, d, "orders").select(F.col("o_custkey").alias("k"), name.alias("name")), ["k"])


FI = """(SELECT o_custkey AS k, CAST(o_orderkey AS STRING) AS finding_id, o_orderkey AS n, CASE o_orderkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'refuted' END AS validity, o_orderkey % 10 = 0 AS owned_rule, CASE o_orderkey % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'overclaim' WHEN 2 THEN 'robustness' WHEN 3 THEN 'design' ELSE 'odd' END AS nature,
CASE o_orderkey % 7 WHEN 0 THEN 'reopened' ELSE 'new' END AS lifecycle, CASE o_orderkey % 4 WHEN 0 THEN 'apply' WHEN 1 THEN 'reject' WHEN 2 THEN 'already addressed' ELSE 'human decision' END AS disposition, CASE WHEN o_orderkey % 6 <> 0 THEN 'r' END AS reason, o_orderkey % 8 = 0 AS validated, CAST(o_orderkey % 4 AS INT) AS round FROM {orders} o)"""
DUE = "CASE WHEN validity = 'refuted' THEN 'reject' WHEN validity = 'unverified' THEN 'pending verification' WHEN owned_rule OR nature = 'design' THEN 'human decision' WHEN nature <> 'odd' THEN 'apply' END"


def findings(s, d):
    return rows(s, d, f"SELECT * FROM {FI} f")


@query("rv2_triage", f"SELECT k, finding_id, {DUE} AS due FROM {FI} f")
def _(s, d):
    return rv.triage(findings(s, d)).select("k", "finding_id", "due")


@query("rv2_triage_violations", found_sql("k", ("unverified_rejected", "finding_id", "NULL", f"{FI} f WHERE validity = 'unverified' AND disposition = 'reject'"), ("recurring_as_addressed", "finding_id", "'reopened'", f"{FI} f WHERE lifecycle = 'reopened' AND disposition = 'already addressed'"), ("reason_missing", "finding_id", "disposition", f"{FI} f WHERE reason IS NULL AND disposition IN ('reject', 'human decision')"), ("place_missing", "finding_id", "NULL", f"{FI} f WHERE reason IS NULL AND disposition = 'already addressed'"), ("no_rule", "finding_id", "NULL", f"{FI} f WHERE {DUE} IS NULL")))
def _(s, d):
    return rv.triage_violations(findings(s, d), ["k"])


@query("rv3_fold_aliases", """WITH RECURSIVE f AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS al FROM orders), r AS (SELECT k, id, id AS root FROM f WHERE al IS NULL UNION ALL SELECT f.k, f.id, r.root FROM r JOIN f ON f.k = r.k AND f.al = r.id)
SELECT f.k, f.id AS finding_id, r.root AS canonical, CASE WHEN al IS NULL THEN 'new' WHEN f.id % 5 = 0 THEN 'reopened' ELSE 'duplicate' END AS folded FROM f JOIN r ON r.k = f.k AND r.id = f.id""")
def _(s, d):
    own = rows(s, d, "SELECT o_custkey AS k, o_orderkey AS finding_id, CASE WHEN o_orderkey % 3 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS alias_of, o_orderkey % 5 = 0 AS new_evidence FROM {orders}")
    return rv.fold_aliases(own, ["k"]).select("k", "finding_id", "canonical", "folded")


LEFT = "disposition = 'human decision' OR lifecycle = 'reopened' OR disposition = 'apply' AND NOT validated"


@query("rv4_convergence", f"SELECT k, max(round) AS rounds, coalesce(array_to_string(list_sort(list(finding_id) FILTER ({LEFT})), ','), '') AS unresolved, CASE WHEN count(*) FILTER ({LEFT}) = 0 THEN 'converged' WHEN max(round) >= 3 THEN 'round_cap' ELSE 'running' END AS status FROM {FI} f GROUP BY 1")
def _(s, d):
    return rv.convergence(findings(s, d), ["k"]).withColumn("unresolved", F.array_join("unresolved", ","))


PA = "(SELECT CAST(floor(event_id / 50) AS BIGINT) AS panel, concat('f', CAST(event_id % 9 AS STRING)) AS finding_id, concat('role', CAST(user_id % 4 AS STRING)) AS role, CASE WHEN event_id % 6 = 0 THEN 'critical' ELSE 'minor' END AS severity, CASE event_id % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN 'no' ELSE 'yes' END AS verdict, CASE WHEN event_id % 3 <> 0 THEN 'e' WHEN event_id % 6 = 0 THEN 'f' END AS evidence FROM {events} e)"
ROLL = f"(SELECT panel, finding_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT role) = 1 AND bool_or(severity = 'critical') AS lone_critical, count(DISTINCT CASE WHEN verdict <> 'abstain' THEN verdict END) > 1 AS conflict, count(*) FILTER (verdict = 'abstain') AS n_abstained FROM {PA} p WHERE evidence IS NOT NULL GROUP BY 1, 2)"


def panel(s, d):
    return rows(s, d, f"SELECT * FROM {PA} p")


@query("rv5_panel_rollup", f"SELECT * FROM {ROLL} r")
def _(s, d):
    return rv.panel_rollup(panel(s, d), ["panel"]).withColumn("roles", F.array_join("roles", ","))


@query("rv5_panel_gate", f"SELECT panel, count(*) AS n_findings, count(*) FILTER (conflict) AS n_conflicts, count(*) FILTER (lone_critical) AS n_lone, count(*) FILTER (conflict OR lone_critical) AS n_decisions, count(*) FILTER (conflict OR lone_critical) <= 5 AS within_cap FROM {ROLL} r GROUP BY 1")
def _(s, d):
    return rv.panel_gate(rv.panel_rollup(panel(s, d), ["panel"]), ["panel"])


@query("rv6_reviewer_eval", """WITH e AS (SELECT *, NOT gold_blocking AND doc_id % 5 = 0 AS known_false, predicted_blocking AND NOT gold_blocking AND doc_id % 7 = 0 AS fresh FROM {eval} x), p AS (SELECT dimension, count(*) FILTER (gold_blocking AND predicted_blocking) AS tp, count(*) FILTER (predicted_blocking AND NOT fresh) AS np FROM e GROUP BY 1)
SELECT CAST(count(*) FILTER (gold_blocking) AS BIGINT) AS n_gold, CAST(count(*) FILTER (gold_blocking AND predicted_blocking) AS BIGINT) AS n_matched, count(*) FILTER (gold_blocking AND predicted_blocking) / count(*) FILTER (gold_blocking) AS recall, (SELECT avg(tp / np) FROM p WHERE np > 0) AS macro_precision, count(*) FILTER (known_false AND NOT predicted_blocking) / count(*) FILTER (known_false) AS rejection_rate FROM e""")
def _(s, d):
    own = rows(s, d, "eval")
    gold = own.select("dimension", F.col("doc_id").alias("item"), (~F.col("gold_blocking") & (F.col("doc_id") % 5 == 0)).alias("known_false"), "gold_blocking").where("gold_blocking or known_false").drop("gold_blocking")
    said = own.where("predicted_blocking").select("dimension", F.col("doc_id").alias("item"), F.when(~F.col("gold_blocking") & (F.col("doc_id") % 7 == 0), "valid-new").alias("adjudicated"))
    return rv.reviewer_eval(gold, said, ["dimension"])


@query("rv7_lens_coverage", """SELECT lang AS dimension, count(*) FILTER (doc_id % 3 = 0) / count(*) AS auto, count(*) FILTER (doc_id % 3 = 1) / count(*) AS human, count(*) FILTER (doc_id % 3 = 2) / count(*) AS uncovered, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 = 0) AS passed, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 = 1) AS failed, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 5 > 1) AS unknown FROM documents GROUP BY 1""")
def _(s, d):
    n = F.col("doc_id")
    return rv.lens_coverage(table(s, d, "documents").select(F.col("lang").alias("dimension"), F.when(n % 3 == 0, "auto").when(n % 3 == 1, "human").alias("covered_by"), (n % 4 != 0).alias("applicable"), F.when(n % 5 == 0, "pass").when(n % 5 == 1, "fail").alias("result")))


# --- event order and streams

ORDER = """(WITH t AS (SELECT * FROM {trace} x), f AS (SELECT *, count(*) FILTER (event = 'intake') OVER w AS i, count(*) FILTER (event = 'input_gate') OVER w AS g, count(*) FILTER (event = 'candidates') OVER w AS c, count(*) FILTER (event = 'lens_L1') OVER w AS l1, count(*) FILTER (event = 'lens_L2') OVER w AS l2, count(*) FILTER (event = 'lens_L3') OVER w AS l3 FROM t WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT run_id, seq, event, CASE WHEN event = 'intake' AND i > 0 THEN 'intake_repeated' WHEN event = 'input_gate' AND i = 0 THEN 'gate_before_intake' WHEN event = 'input_gate' AND g > 0 THEN 'gate_repeated' WHEN event LIKE 'lens_%' AND i = 0 THEN 'lens_before_intake' WHEN event LIKE 'lens_%' AND g = 0 THEN 'lens_before_gate'
WHEN event LIKE 'lens_%' AND event NOT IN ('lens_L1', 'lens_L2', 'lens_L3') THEN 'lens_unknown' WHEN event = 'lens_L1' AND l1 > 0 OR event = 'lens_L2' AND l2 > 0 OR event = 'lens_L3' AND l3 > 0 THEN 'lens_repeated' WHEN event = 'candidates' AND (l1 = 0 OR l2 = 0 OR l3 = 0) THEN 'candidates_early' WHEN event = 'candidates' AND c > 0 THEN 'candidates_repeated' END AS violation FROM f)
SELECT run_id, arg_min(violation, seq) AS violation, min(seq) AS seq FROM v WHERE violation IS NOT NULL GROUP BY 1)"""


@query("st1_trace_order", f"SELECT * FROM {ORDER} o")
def _(s, d):
    return st.trace_order(rows(s, d, "trace"))


@query("st2_trace_order_stream", f"SELECT * FROM {ORDER} o")
def _(s, d):
    return st.run_to_end(lambda x: st.trace_order_stream(x, None), rows(s, d, "trace"))


@query("st3_scan_stream", f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'term' AS kind, variant AS hit FROM {HITS} h UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), pattern, unnest(regexp_extract_all(line, rx)) FROM {LINES} l, (VALUES ('email', '(?i)[A-Za-z0-9_.]+@[A-Za-z0-9_.]+'), ('token', '(?i)token = "[0-9a-f]{{40}}"'), ('license', '(?i)(?:licen[sc]e|copyright)')) t(pattern, rx) UNION ALL SELECT doc_id, 0, 'sha16', substr(sha256(text), 1, 16) FROM documents""")
def _(s, d):
    return st.run_to_end(lambda x: st.scan_stream(x, terms(s), PATTERNS), docs(s, d).select("doc_id", "text"))


@query("st4_verbatim_stream", f"SELECT * FROM {VERBATIM} v")
def _(s, d):
    return st.verbatim_stream_to_end(rows(s, d, "quotes"), sources(s, d))


