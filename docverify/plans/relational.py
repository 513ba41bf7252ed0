"""Queries over registries, ledgers, receipts, manifests, plans and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as dr
from ..operators import ledger as lg
from ..operators import manifest as mf
from ..operators import receipts as rc
from .fixtures import query, rows, table

NO_TEXTS = "array<string>"


def found_sql(keys: str, *rules: tuple) -> str:
    """Violations by SQL: each rule as name, subject, detail, rows, and severity."""
    return " UNION ALL ".join(f"SELECT {keys}, '{r[0]}' AS rule, CAST({r[1]} AS STRING) AS subject, CAST({r[2]} AS STRING) AS detail, '{r[4] if len(r) > 4 else 'error'}' AS severity FROM {r[3]}" for r in rules)


def text(c: str) -> Column:
    return F.col(c).cast("string")


# --- decision registries

REGISTRY = """(SELECT registry_id, CAST(decision_id AS STRING) AS id, decision_id AS n, CASE WHEN decision_id % 83 = 0 THEN '' ELSE 'text' END AS decision, CASE WHEN decision_id % 97 = 0 THEN 'maybe' ELSE status END AS status,
CASE WHEN decision_id % 89 = 0 THEN '1 May' ELSE decided_on END AS date, 'minutes' AS evidence, subject, CAST(supersedes AS STRING) AS supersedes, CAST(superseded_by AS STRING) AS superseded_by, CASE WHEN decision_id % 79 = 0 THEN 'a.md' END AS source_ref, CASE WHEN decision_id % 158 = 0 THEN 'abc' END AS source_hash FROM {decisions} x)"""
EDGES = f"""(SELECT DISTINCT r AS registry_id, old, new FROM (SELECT registry_id AS r, supersedes AS old, id AS new FROM {REGISTRY} a UNION ALL SELECT registry_id, id, superseded_by FROM {REGISTRY} b) e WHERE old <> new AND old IN (SELECT id FROM {REGISTRY} c WHERE c.registry_id = r) AND new IN (SELECT id FROM {REGISTRY} c WHERE c.registry_id = r))"""
JUDGED = f"""(SELECT e.registry_id, e.old, e.new, CASE WHEN n.status <> 'confirmed' THEN 'unconfirmed' WHEN o.subject IS NULL THEN NULL WHEN n.subject IS NULL THEN 'unverifiable_slot' WHEN n.subject <> o.subject THEN 'slot_mismatch' END AS reason,
length(o.date) = 10 AND length(n.date) = 10 AND n.date < o.date AS date_inverted FROM {EDGES} e JOIN {REGISTRY} o ON o.registry_id = e.registry_id AND o.id = e.old JOIN {REGISTRY} n ON n.registry_id = e.registry_id AND n.id = e.new)"""
CURRENT = f"(SELECT * FROM {REGISTRY} d WHERE status = 'confirmed' AND NOT EXISTS (SELECT 1 FROM {JUDGED} j WHERE j.reason IS NULL AND j.registry_id = d.registry_id AND j.old = d.id))"
FIELD_FAULTS = found_sql("registry_id", ("decision_missing", "id", "NULL", f"{REGISTRY} r WHERE decision = ''"), ("status_unknown", "id", "status", f"{REGISTRY} r WHERE status = 'maybe'"), ("date_format", "id", "date", f"{REGISTRY} r WHERE date = '1 May'"), ("hash_format", "id", "NULL", f"{REGISTRY} r WHERE source_hash = 'abc'"), ("hash_missing", "id", "NULL", f"{REGISTRY} r WHERE source_ref IS NOT NULL AND source_hash IS NULL"))
REF_FAULTS = found_sql("registry_id", ("dangling_reference", "id", "superseded_by", f"{REGISTRY} r WHERE superseded_by = '-1'"))
CYCLIC = f"(WITH RECURSIVE p AS (SELECT registry_id, old, new FROM {EDGES} e UNION SELECT p.registry_id, p.old, e.new FROM p JOIN {EDGES} e ON e.registry_id = p.registry_id AND e.old = p.new) SELECT DISTINCT registry_id FROM p WHERE old = new)"
CONFLICTS = f"(SELECT registry_id, subject AS slot, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM {CURRENT} c WHERE subject IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"
UNLABELED = f"(SELECT c.registry_id, count(*) AS n, CASE WHEN c.registry_id IN (SELECT registry_id FROM {REGISTRY} r WHERE status = 'do_not_reopen') THEN 'error' ELSE 'warning' END AS severity FROM {CURRENT} c WHERE subject IS NULL GROUP BY 1 HAVING count(*) > 1)"


def registry(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, f"SELECT * FROM {REGISTRY} r").drop("n")


def edges(s, d):
    return dr.supersede_edges(registry(s, d))


@query("dr1_decision_violations", FIELD_FAULTS)
def _(s, d):
    return dr.decision_violations(registry(s, d))


@query("dr2_supersede_edges", f"SELECT * FROM {EDGES} e")
def _(s, d):
    return edges(s, d)


@query("dr2_reference_violations", REF_FAULTS)
def _(s, d):
    return dr.reference_violations(registry(s, d))


@query("dr3_supersede_cycles", f"SELECT * FROM {CYCLIC} c")
def _(s, d):
    return dr.supersede_cycles(edges(s, d)).select("registry_id").distinct()


@query("dr4_honored_edges", f"SELECT * FROM {JUDGED} j")
def _(s, d):
    return dr.judged_edges(edges(s, d), registry(s, d))


def honored(s, d):
    return dr.honored_edges(edges(s, d), registry(s, d))


@query("dr5_slot_conflicts", f"SELECT * FROM {CONFLICTS} c")
def _(s, d):
    return dr.slot_conflicts(registry(s, d), honored(s, d)).withColumn("ids", F.array_join("ids", ","))


@query("dr6_unlabeled_decisions", f"SELECT * FROM {UNLABELED} u")
def _(s, d):
    return dr.unlabeled_decisions(registry(s, d), honored(s, d))


VERDICTS = f"""(WITH f AS ({FIELD_FAULTS} UNION ALL {REF_FAULTS} UNION ALL SELECT registry_id, '', '', '', 'error' FROM {CYCLIC} c UNION ALL SELECT registry_id, '', '', '', 'error' FROM {CONFLICTS} c UNION ALL SELECT registry_id, '', '', '', severity FROM {UNLABELED} u
UNION ALL SELECT registry_id, '', '', '', 'warning' FROM {JUDGED} j WHERE reason IS NOT NULL UNION ALL SELECT registry_id, '', '', '', 'warning' FROM {JUDGED} j WHERE date_inverted)
SELECT r.registry_id, count(*) FILTER (f.severity = 'error') AS n_errors, count(*) FILTER (f.severity = 'warning') AS n_warnings, CASE WHEN count(*) FILTER (f.severity = 'error') > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT DISTINCT registry_id FROM {REGISTRY} x) r LEFT JOIN f ON f.registry_id = r.registry_id GROUP BY 1)"""


def verdicts(rows):
    return dr.registry_verdict(rows, dr.registry_findings(rows))


@query("dr7_eligible_decisions", f"SELECT registry_id, id, status FROM {REGISTRY} d WHERE status IN ('confirmed', 'do_not_reopen') AND superseded_by IS NULL AND registry_id IN (SELECT registry_id FROM {VERDICTS} v WHERE verdict = 'pass') AND NOT EXISTS (SELECT 1 FROM {JUDGED} j WHERE reason IS NULL AND j.registry_id = d.registry_id AND j.old = d.id)")
def _(s, d):
    rows = dr.stored(dr.examined(registry(s, d)))
    return dr.eligible_examined(rows, verdicts(rows))


@query("dr8_registry_verdict", f"SELECT * FROM {VERDICTS} v")
def _(s, d):
    return verdicts(dr.stored(dr.examined(registry(s, d))))


# --- ledgers

ATOMS = "(SELECT run_id, CAST(atom_id AS STRING) AS atom_id, atom_id AS n, CAST(CASE WHEN atom_id % 71 = 0 THEN -1 ELSE source_id END AS STRING) AS source_id, anchor, co_reference, semantic_values, presentation_rule, CASE WHEN atom_id % 29 = 0 THEN 'none' ELSE concat('see ', anchor) END AS evidence FROM {atoms} a)"
SOURCES = "(SELECT CAST(floor(event_id / 20) AS BIGINT) AS run_id, CAST(event_id AS STRING) AS source_id, event_id AS n FROM {events} e WHERE event_id % 2 = 0)"
ROWS = "(SELECT run_id, CAST(atom_id AS STRING) AS atom_id, atom_id AS n, outcome, CASE WHEN atom_id % 67 = 0 THEN 'gone' ELSE record_id END AS record_id, anchor FROM {ledger} l)"
RECORDS = "(SELECT run_id, record_id, CASE WHEN atom_id % 53 = 0 THEN 'drift' ELSE outcome END AS category, CAST(atom_id AS STRING) AS atom_id, atom_id AS n, CAST(atom_id - atom_id % 2 AS STRING) AS source_id, CASE WHEN atom_id % 61 = 0 THEN 'L99' ELSE anchor END AS anchor, outcome FROM {ledger} l)"
EXPECTED = "CASE WHEN co_reference = 'unknown' THEN 'question' WHEN co_reference = 'not_coreferential' THEN 'nonissue' WHEN semantic_values = 'different' THEN 'finding' ELSE CASE presentation_rule WHEN 'unknown' THEN 'question' WHEN 'binding_violated' THEN 'finding' WHEN 'not_violated' THEN 'drift' WHEN 'intentional_variant' THEN 'nonissue' END END"


def atoms(s, d):
    own = rows(s, d, f"SELECT * FROM {ATOMS} a")
    return own.select("run_id", "atom_id", F.array("source_id").alias("source_refs"), F.array("anchor").alias("anchors"), F.struct("co_reference", "semantic_values", "presentation_rule", "evidence").alias("basis"), F.when(F.col("n") % 31 == 0, F.array(F.concat(F.lit("R"), (F.col("n") - 1).cast("string")))).otherwise(F.array().cast(NO_TEXTS)).alias("derived_from"))


def anchor_of(n: Column) -> Column:
    return F.concat(F.lit("L"), (10 + n % 80).cast("string"))


def sources(s, d):
    n = F.col("n")
    return rows(s, d, f"SELECT * FROM {SOURCES} x").select("run_id", "source_id", F.when(n % 58 == 0, F.array(anchor_of(n))).when(n % 38 == 0, F.array(anchor_of(n), anchor_of(n + 1), F.lit("L98"))).otherwise(F.array(anchor_of(n), anchor_of(n + 1))).alias("anchors"))


def ledger_rows(s, d):
    return rows(s, d, f"SELECT * FROM {ROWS} l").select("run_id", "atom_id", "outcome", "record_id", F.array("anchor").alias("anchors"))


def records(s, d):
    n = F.col("n")
    own = rows(s, d, f"SELECT * FROM {RECORDS} r")
    is_q = F.col("category") == "question"
    return own.select(
        "run_id", "record_id", "category", F.array(F.when(n % 59 == 0, (n + 1).cast("string")).otherwise(F.col("atom_id"))).alias("atom_refs"), F.when(~is_q, F.array("source_id")).alias("source_refs"), F.array("anchor").alias("anchors"), F.when(n % 47 == 0, "old").otherwise("snap").alias("snapshot_id"),
        F.when(F.col("category") == "finding", F.concat(F.lit("F"), (n - n % 10).cast("string"))).alias("finding_id"), F.when(is_q, F.when(n % 3 == 0, "resolved").otherwise("open")).when(F.col("category") == "finding", F.when(n % 4 == 0, "verified").when(n % 4 == 1, "rejected").when(n % 44 == 2, "odd").otherwise("accepted")).alias("status"),
        F.when(is_q, F.when(n % 31 == 30, F.array((n + 1).cast("string"))).otherwise(F.array().cast(NO_TEXTS))).alias("derived_refs"), F.when(is_q, F.when(n % 2 == 0, "pass").otherwise("unresolved")).alias("verification_result"), F.lit("why").alias("rationale"), n.alias("n"),
    )


@query("lg1_shape_violations", "WITH r AS (SELECT * FROM " + RECORDS + " x) " + found_sql("run_id", ("missing:rationale", "record_id", "category", "r WHERE category IN ('suppressed', 'nonissue') AND n % 5 = 0"), ("unknown:rationale", "record_id", "category", "r WHERE category IN ('finding', 'question', 'drift') AND n % 5 <> 0"), ("enum:finding.status", "record_id", "'odd'", "r WHERE category = 'finding' AND n % 44 = 2"), ("snapshot", "record_id", "'old'", "r WHERE n % 47 = 0"),
    ("missing:verdict", "record_id", "'finding'", "r WHERE category = 'finding' AND n % 2 = 1 AND n % 5 = 0"), ("unknown:verdict", "record_id", "'finding'", "r WHERE category = 'finding' AND n % 2 = 0 AND n % 5 <> 0"), ("enum:finding.verdict", "record_id", "'odd'", "r WHERE category = 'finding' AND n % 2 = 1 AND n % 5 = 1"), ("schema_version", "record_id", "3", "r WHERE category = 'nonissue' AND n % 2 = 1 AND n % 3 = 0")))
def _(s, d):
    own = records(s, d).withColumn("rationale", F.when(F.col("n") % 5 != 0, F.col("rationale")))
    filled = {"digest": F.lit("x"), "severity": F.when(F.col("category") == "finding", "high"), "provenance": F.when(F.col("category") == "finding", "p"), "convention_slot": F.when(F.col("category") == "question", "c"), "detail": F.when(F.col("category") == "drift", "d"), "co_reference_basis": F.when(F.col("category") == "drift", "b"), "variants": F.when(F.col("category") == "drift", F.array(F.lit("v"))), "authority_path": F.when(F.col("category") == "suppressed", "a")}
    n, finding = F.col("n"), F.col("category") == "finding"  # odd findings are of version 2, even ones of version 1
    filled |= {"schema_version": F.when((F.col("category") == "nonissue") & (n % 3 == 0) & (n % 2 == 1), 3).otherwise(1 + n % 2).cast("int"), "verdict": F.when(finding & (n % 5 != 0), F.when((n % 5 == 1) & (n % 2 == 1), "odd").otherwise("partial"))}
    return lg.shape_violations(own.withColumns(filled), own.select("run_id").distinct().withColumn("snapshot_id", F.lit("snap")))


@query("lg2_duplicate_ids", found_sql("run_id", ("finding_repeated", "f", "n", "(SELECT run_id, concat('F', n - n % 10) AS f, count(*) AS n FROM " + RECORDS + " r WHERE category = 'finding' GROUP BY 1, 2 HAVING count(*) > 1)")))
def _(s, d):
    return lg.duplicate_ids(sources(s, d), atoms(s, d), records(s, d))


@query("lg3_dangling_refs", found_sql("run_id", ("atom_to_source", "atom_id", "'-1'", ATOMS + " a WHERE n % 71 = 0"), ("record_to_atom", "record_id", "n + 1", RECORDS + " r WHERE n % 59 = 0 AND NOT EXISTS (SELECT 1 FROM " + ATOMS + " a WHERE a.run_id = r.run_id AND a.n = r.n + 1)"), ("row_to_record", "atom_id", "'gone'", ROWS + " l WHERE record_id = 'gone'")))
def _(s, d):
    return lg.dangling_refs(sources(s, d), atoms(s, d), records(s, d), ledger_rows(s, d))


@query("lg4_expected_outcome", f"SELECT run_id, atom_id, {EXPECTED} AS expected FROM {ATOMS} a")
def _(s, d):
    return lg.with_outcome(atoms(s, d)).select("run_id", "atom_id", "expected")


@query("lg5_uncovered_sources", f"SELECT run_id, source_id FROM {SOURCES} s WHERE NOT EXISTS (SELECT 1 FROM {ATOMS} a WHERE a.run_id = s.run_id AND a.source_id = s.source_id AND a.n % 7 <> 0)")
def _(s, d):
    return lg.uncovered_sources(sources(s, d), atoms(s, d).where(F.col("atom_id").cast("long") % 7 != 0))


SOURCE_ANCHORS = "(SELECT run_id, source_id, unnest(CASE WHEN n % 58 = 0 THEN [concat('L', 10 + n % 80)] WHEN n % 38 = 0 THEN [concat('L', 10 + n % 80), concat('L', 10 + (n + 1) % 80), 'L98'] ELSE [concat('L', 10 + n % 80), concat('L', 10 + (n + 1) % 80)] END) AS anchor FROM " + SOURCES + " s)"


@query("lg6_anchor_conservation", found_sql("run_id", ("anchor_not_in_sources", "atom_id", "anchor", ATOMS + f" a WHERE NOT EXISTS (SELECT 1 FROM {SOURCE_ANCHORS} s WHERE s.run_id = a.run_id AND s.source_id = a.source_id AND s.anchor = a.anchor)"), ("anchor_lost", "source_id", "anchor", SOURCE_ANCHORS + f" s WHERE EXISTS (SELECT 1 FROM {ATOMS} a WHERE a.run_id = s.run_id AND a.source_id = s.source_id) AND NOT EXISTS (SELECT 1 FROM {ATOMS} a WHERE a.run_id = s.run_id AND a.source_id = s.source_id AND a.anchor = s.anchor)")))
def _(s, d):
    return lg.anchor_conservation(sources(s, d), atoms(s, d))


@query("lg7_evidence_cites_anchor", found_sql("run_id", ("evidence_without_anchor", "atom_id", EXPECTED, f"{ATOMS} a WHERE evidence = 'none' AND {EXPECTED} IN ('drift', 'nonissue')")))
def _(s, d):
    return lg.evidence_cites_anchor(atoms(s, d))


@query("lg8_terminal_exactly_once", f"SELECT a.run_id, a.atom_id, count(l.atom_id) AS n FROM {ATOMS} a LEFT JOIN {ROWS} l ON l.run_id = a.run_id AND l.atom_id = a.atom_id GROUP BY 1, 2 HAVING count(l.atom_id) <> 1")
def _(s, d):
    return lg.terminal_exactly_once(atoms(s, d), ledger_rows(s, d))


@query("lg9_outcome_consistency", found_sql("run_id", ("outcome_unexpected", "atom_id", "concat(e, '>', outcome)", f"(SELECT l.run_id, l.atom_id, outcome, {EXPECTED} AS e FROM {ROWS} l JOIN {ATOMS} a ON a.run_id = l.run_id AND a.atom_id = l.atom_id) WHERE outcome <> e"), ("category_differs", "atom_id", "record_id", f"(SELECT l.run_id, l.atom_id, l.record_id FROM {ROWS} l JOIN {RECORDS} r ON r.run_id = l.run_id AND r.record_id = l.record_id WHERE r.category <> l.outcome)")))
def _(s, d):
    return lg.outcome_consistency(atoms(s, d), ledger_rows(s, d), records(s, d))


def same_sql(rule: str, who: str, what: str, a: str, b: str) -> str:
    return " UNION ALL ".join(found_sql("run_id", (rule, who, f"concat('{w} ', {what})", f"(SELECT DISTINCT run_id, {who}, {what} FROM {x} EXCEPT SELECT DISTINCT run_id, {who}, {what} FROM {y})")) for w, x, y in (("only here", a, b), ("lacks", b, a)))


OWN_ATOMS = f"(SELECT run_id, record_id, category, CASE WHEN n % 59 = 0 THEN CAST(n + 1 AS STRING) ELSE atom_id END AS atom_id, source_id AS source, anchor FROM {RECORDS} r)"
TARGETS = f"(SELECT l.run_id, l.record_id, l.atom_id FROM {ROWS} l JOIN {RECORDS} r ON r.run_id = l.run_id AND r.record_id = l.record_id)"
VIA = f"(SELECT o.run_id, o.record_id, o.category, a.source_id AS source, a.anchor FROM {OWN_ATOMS} o JOIN {ATOMS} a ON a.run_id = o.run_id AND a.atom_id = o.atom_id)"


@query("lg10_set_equality", " UNION ALL ".join([same_sql("record_atoms", "record_id", "atom_id", f"{OWN_ATOMS} o", f"{TARGETS} t"), same_sql("record_sources", "record_id", "source", f"{OWN_ATOMS} o WHERE category <> 'question'", f"{VIA} v WHERE category <> 'question'"), same_sql("record_anchors", "record_id", "anchor", f"{OWN_ATOMS} o", f"{VIA} v"),
    same_sql("row_anchors", "atom_id", "anchor", f"{ROWS} l", f"(SELECT a.run_id, a.atom_id, a.anchor FROM {ATOMS} a WHERE EXISTS (SELECT 1 FROM {ROWS} l WHERE l.run_id = a.run_id AND l.atom_id = a.atom_id))"),
    found_sql("run_id", ("row_anchor_not_in_record", "atom_id", "anchor", f"(SELECT l.run_id, l.atom_id, l.anchor FROM {ROWS} l JOIN {RECORDS} r ON r.run_id = l.run_id AND r.record_id = l.record_id WHERE r.anchor <> l.anchor)"))]))
def _(s, d):
    return lg.set_equality(atoms(s, d), ledger_rows(s, d), records(s, d))


Q = f"(SELECT *, CASE WHEN n % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM {RECORDS} r WHERE category = 'question')"
DOWN, UP = f"(SELECT run_id, record_id, status, CAST(n + 1 AS STRING) AS atom_id FROM {Q} q WHERE n % 31 = 30)", f"(SELECT run_id, concat('R', n - 1) AS record_id, atom_id FROM {ATOMS} a WHERE n % 31 = 0)"


@query("lg11_question_lineage", found_sql("run_id", ("atom_lacks_question", "record_id", "atom_id", f"{DOWN} d WHERE NOT EXISTS (SELECT 1 FROM {UP} u WHERE u.run_id = d.run_id AND u.record_id = d.record_id AND u.atom_id = d.atom_id)"), ("question_lacks_atom", "record_id", "atom_id", f"{UP} u WHERE NOT EXISTS (SELECT 1 FROM {DOWN} d WHERE u.run_id = d.run_id AND u.record_id = d.record_id AND u.atom_id = d.atom_id)"),
    ("resolved_without_atoms", "record_id", "NULL", f"{Q} q WHERE status = 'resolved' AND n % 31 <> 30"), ("open_with_atoms", "record_id", "NULL", f"{Q} q WHERE status = 'open' AND n % 31 = 30"), ("derived_not_ended", "record_id", "atom_id", f"{DOWN} d WHERE status = 'resolved' AND NOT EXISTS (SELECT 1 FROM {ROWS} l WHERE l.run_id = d.run_id AND l.atom_id = d.atom_id AND outcome IN ('finding', 'drift', 'nonissue'))")))
def _(s, d):
    return lg.question_lineage(atoms(s, d), ledger_rows(s, d), records(s, d))


#: Findings with verdicts by modulus, counter records on every third, narrowing on every fifth.
F_ = f"(SELECT run_id, record_id, n, anchor, CASE n % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' WHEN 2 THEN 'full' ELSE 'odd' END AS verdict, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'full' ELSE 'partial' END END AS counter, n % 5 = 0 AS narrowed, CASE WHEN n % 7 = 0 THEN 'L97' ELSE anchor END AS cited FROM {RECORDS} r WHERE category = 'finding')"


@query("lg12_counter_evidence", found_sql("run_id", ("verdict_invalid", "record_id", "verdict", f"{F_} f WHERE verdict = 'odd'"), ("none_with_counter", "record_id", "NULL", f"{F_} f WHERE verdict = 'none' AND counter IS NOT NULL"), ("none_with_narrowing", "record_id", "NULL", f"{F_} f WHERE verdict = 'none' AND narrowed"), ("partial_without_counter", "record_id", "NULL", f"{F_} f WHERE verdict = 'partial' AND counter IS DISTINCT FROM 'partial'"),
    ("partial_without_narrowing", "record_id", "NULL", f"{F_} f WHERE verdict = 'partial' AND NOT narrowed"), ("partial_anchors_differ", "record_id", "NULL", f"{F_} f WHERE verdict = 'partial' AND narrowed AND counter IS NOT NULL AND cited <> anchor"), ("full_without_counter", "record_id", "NULL", f"{F_} f WHERE verdict = 'full' AND counter IS DISTINCT FROM 'full'"), ("full_with_narrowing", "record_id", "NULL", f"{F_} f WHERE verdict = 'full' AND narrowed"),
    ("full_but_verified", "record_id", "NULL", f"{F_} f WHERE verdict = 'full' AND n % 6 = 0"), ("narrowing_blank", "record_id", "NULL", f"{F_} f WHERE narrowed AND n % 11 = 0"), ("counter_anchor_unknown", "concat('C', record_id)", "cited", f"{F_} f WHERE counter IS NOT NULL AND cited = 'L97'")))
def _(s, d):
    f, n = rows(s, d, f"SELECT * FROM {F_} f"), F.col("n")
    narrowing = F.when(F.col("narrowed"), F.struct(F.lit("claim").alias("original_claim"), F.lit("scope").alias("withdrawn_scope"), F.when(n % 11 == 0, " ").otherwise("rest").alias("residual_claim"), F.array("anchor").alias("anchors")))
    found = f.select("run_id", "record_id", F.lit("finding").alias("category"), F.array("anchor").alias("anchors"), "verdict", narrowing.alias("narrowing"), F.when(n % 6 == 0, "verified").otherwise("accepted").alias("status"), F.lit(None).cast("string").alias("finding_record_id"), F.lit(None).cast("string").alias("resolution"))
    counter = f.where("counter is not null").select("run_id", F.concat(F.lit("C"), "record_id").alias("record_id"), F.lit("counter_evidence").alias("category"), F.array("cited").alias("anchors"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast(found.schema["narrowing"].dataType).alias("narrowing"), F.lit(None).cast("string").alias("status"), F.col("record_id").alias("finding_record_id"), F.col("counter").alias("resolution"))
    return lg.counter_evidence_matrix(found.unionByName(counter), f.select("run_id", F.array("anchor").alias("anchors")))


@query("lg13_drift_variants", "WITH r AS (SELECT * FROM " + RECORDS + " x WHERE category = 'drift') " + found_sql("run_id", ("few_variants", "record_id", "NULL", "r WHERE n % 5 = 0"), ("notation_repeated", "record_id", "NULL", "r WHERE n % 5 = 1"), ("variant_anchor_outside", "record_id", "'L96'", "r WHERE n % 5 = 2"), ("drift_has_severity", "record_id", "NULL", "r WHERE n % 7 = 0")))
def _(s, d):
    n = F.col("n")
    v = lambda name, anchor: F.struct(name.alias("notation"), F.array(anchor).alias("anchors"))
    own = rows(s, d, f"SELECT * FROM {RECORDS} r")
    second = v(F.when(n % 5 == 1, " a").otherwise("b"), F.when(n % 5 == 2, "L96").otherwise(F.col("anchor")))
    variants = F.when(n % 5 == 0, F.array(v(F.lit("a"), F.col("anchor")))).otherwise(F.array(v(F.lit("a"), F.col("anchor")), second))
    return lg.drift_variants(own.select("run_id", "record_id", "category", F.array("anchor").alias("anchors"), variants.alias("variants"), F.when(n % 7 == 0, "high").alias("severity")))


JSON = """concat('{{"anchors":["', anchor, '"],"atom_refs":["', atom_id, '"],"category":"', category, '","rationale":"why","record_id":"', record_id, '","snapshot_id":"snap","source_refs":["', source_id, '"]}}')""".replace("{{", "{").replace("}}", "}")


@query("lg14_record_digest", f"SELECT run_id, record_id, category, concat('sha256:', sha256({JSON})) AS computed, n % 9 <> 0 AS matches FROM {RECORDS} r WHERE category = 'nonissue'")
def _(s, d):
    own = rows(s, d, f"SELECT * FROM {RECORDS} r WHERE category = 'nonissue'").select("run_id", "record_id", "category", F.array("anchor").alias("anchors"), F.array("atom_id").alias("atom_refs"), F.lit("why").alias("rationale"), F.lit("snap").alias("snapshot_id"), F.array("source_id").alias("source_refs"), "n")
    stored = lg.record_digest(own).select("run_id", "record_id", F.col("computed").alias("digest"))
    return lg.record_digest(own.join(stored, ["run_id", "record_id"]).withColumn("digest", F.when(F.col("n") % 9 != 0, F.col("digest"))))


@query("lg15_authority_eligibility", f"SELECT run_id, record_id, CASE WHEN n % 5 = 0 THEN 'unbound' WHEN n % 3 = 0 THEN 'missing' WHEN n % 7 = 0 THEN 'stale' WHEN n % 2 = 0 AND n % 11 = 0 OR n % 2 = 1 AND n % 13 = 0 THEN 'ok' ELSE 'ineligible' END AS state FROM {RECORDS} r")
def _(s, d):
    own, n = rows(s, d, f"SELECT * FROM {RECORDS} r"), F.col("n")
    sha = lambda x: F.sha2(x, 256)
    refs = own.select("run_id", "record_id", F.col("atom_id").alias("path"), F.when(n % 5 != 0, F.when(n % 7 == 0, sha(F.lit("old"))).otherwise(sha(F.col("atom_id")))).alias("sha256"), F.when(n % 2 == 0, "decision").otherwise("approval").alias("kind"), F.col("atom_id").alias("entry_id"))
    files = own.where("n % 3 <> 0").select(F.col("atom_id").alias("path"), sha(F.col("atom_id")).alias("sha256")).distinct()
    return lg.authority_eligibility(refs, files, own.where("n % 11 = 0").select(F.col("atom_id").alias("id")), own.where("n % 13 = 0").select(F.col("atom_id").alias("id"), F.lit("approved").alias("state")))


#: Approvals of models by registry: a registry for each customer, an approval for each order.
APPROVED = """(SELECT o_custkey AS registry_id, o_orderkey AS n, CASE WHEN o_orderkey % 211 = 0 THEN CAST(NULL AS STRING) ELSE CAST(o_orderkey - CASE WHEN o_orderkey % 199 = 0 THEN 1 ELSE 0 END AS STRING) END AS id,
CASE WHEN o_orderkey % 31 = 0 THEN '../m.yaml' WHEN o_orderkey % 7 = 0 THEN concat('m/', o_orderkey, '.Draft.yaml') ELSE concat('m/', o_orderkey, '.yaml') END AS docmodel_path,
CASE WHEN o_orderkey % 53 = 0 THEN 'maybe' WHEN o_orderkey % 5 = 0 THEN 'revoked' ELSE 'approved' END AS status, CASE WHEN o_orderkey % 61 = 0 THEN ' ' ELSE 'owner' END AS approved_by,
CASE WHEN o_orderkey % 67 = 0 THEN 'May' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS approved_at, 'minutes' AS evidence, CASE WHEN o_orderkey % 71 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 't' END AS template FROM {orders} o)"""
APPROVERS = "(SELECT c_custkey AS registry_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat('t', c_custkey) END AS target, CASE WHEN c_custkey % 17 = 0 THEN 'May' ELSE '2024-01-01' END AS updated_at FROM {customer} c)"
_BAD_SHA, _BOUND = "n % 23 = 0", "n % 23 <> 0 AND n % 31 <> 0"
APPROVAL_FAULTS = "(" + found_sql(
    "registry_id", ("blank:target", "target", "NULL", f"{APPROVERS} a WHERE target = ''"), ("format:updated_at", "target", "updated_at", f"{APPROVERS} a WHERE updated_at = 'May'"),
    ("no_approval", "target", "NULL", f"{APPROVERS} a WHERE registry_id NOT IN (SELECT o_custkey FROM {{orders}} o)"), ("blank:id", "id", "NULL", f"{APPROVED} a WHERE id IS NULL"),
    ("blank:approved_by", "id", "NULL", f"{APPROVED} a WHERE approved_by = ' '"), ("blank:template", "id", "NULL", f"{APPROVED} a WHERE template = ''"), ("enum:status", "id", "status", f"{APPROVED} a WHERE status = 'maybe'"),
    ("format:docmodel_sha256", "id", "NULL", f"{APPROVED} a WHERE {_BAD_SHA}"), ("format:approved_at", "id", "approved_at", f"{APPROVED} a WHERE approved_at = 'May'"),
    ("unsafe_path", "id", "docmodel_path", f"{APPROVED} a WHERE n % 31 = 0 AND n % 23 <> 0"), ("missing_model", "id", "docmodel_path", f"{APPROVED} a WHERE {_BOUND} AND n % 29 = 0"),
    ("stale_model", "id", "docmodel_path", f"{APPROVED} a WHERE {_BOUND} AND n % 29 <> 0 AND n % 37 = 0"),
    ("repeated_id", "id", "c", f"(SELECT registry_id, id, count(*) AS c FROM {APPROVED} a WHERE id IS NOT NULL GROUP BY registry_id, id HAVING count(*) > 1) r"),
) + ")"


def approved(s, d) -> DataFrame:
    n = F.col("n")
    return rows(s, d, f"SELECT * FROM {APPROVED} a").withColumn("docmodel_sha256", F.when(n % 23 == 0, "bad").when(n % 37 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("docmodel_path", 256)))


def approval_faults(s, d) -> DataFrame:
    own = approved(s, d)
    files = own.where("n % 29 <> 0").select(F.col("docmodel_path").alias("path"), F.sha2("docmodel_path", 256).alias("sha256")).distinct()
    return lg.approval_violations(rows(s, d, f"SELECT * FROM {APPROVERS} a"), own.drop("n"), files)


@query("lg15_approval_violations", f"SELECT * FROM {APPROVAL_FAULTS} f")
def _(s, d):
    return approval_faults(s, d)


@query("lg15_current_approvals", f"SELECT registry_id, id, CASE WHEN n % 7 = 0 THEN 'draft' ELSE status END AS state FROM {APPROVED} a WHERE registry_id NOT IN (SELECT registry_id FROM {APPROVAL_FAULTS} f)")
def _(s, d):
    return lg.current_approvals(approved(s, d), approval_faults(s, d))


@query("lg16_ledger_summary", "SELECT r.run_id, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS n_{o}" for o in lg.OUTCOMES) + f", coalesce(any_value(v.n), 0) AS n_violations, coalesce(any_value(v.n), 0) = 0 AND NOT (r.run_id % 2 = 0 AND count(*) FILTER (outcome = 'question') > 0) AS passes FROM {ROWS} r LEFT JOIN (SELECT run_id, count(*) AS n FROM (SELECT a.run_id FROM {ATOMS} a LEFT JOIN {ROWS} l ON l.run_id = a.run_id AND l.atom_id = a.atom_id GROUP BY a.run_id, a.atom_id HAVING count(l.atom_id) <> 1) GROUP BY 1) v ON v.run_id = r.run_id GROUP BY 1")
def _(s, d):
    r = ledger_rows(s, d)
    runs = r.groupBy("run_id").agg(F.count_if(F.col("outcome") == "question").alias("n_open")).withColumn("state", F.when(F.col("run_id") % 2 == 0, "closed").otherwise("open"))
    return lg.ledger_summary(r, lg.terminal_exactly_once(atoms(s, d), r), runs)


# --- receipts

RUNS = "(SELECT DISTINCT CAST(floor(event_id / 20) AS BIGINT) AS run_id FROM {events} e)"


def runs(s, d, **cols: Column) -> DataFrame:
    return rows(s, d, f"SELECT * FROM {RUNS} r").withColumns(cols) if cols else rows(s, d, f"SELECT * FROM {RUNS} r")


def K() -> Column:  # noqa: N802
    return F.col("run_id")


@query("rc1_receipt_vs_ledger", f"SELECT run_id, record_id, CASE WHEN n % 17 = 0 THEN 'omitted' WHEN n % 19 = 0 AND category <> 'drift' THEN 'category' ELSE 'digest' END AS state FROM {RECORDS} r WHERE n % 17 = 0 OR n % 19 = 0 AND category <> 'drift' OR n % 23 = 0 UNION ALL SELECT run_id, concat('X', record_id), 'extra' FROM {RECORDS} r WHERE n % 29 = 0 AND n % 17 <> 0")
def _(s, d):
    own, n = records(s, d).select("run_id", "record_id", "category", "n", F.lit("d").alias("digest")), F.col("n")
    kept = own.where("n % 17 <> 0")
    changed = kept.withColumns({"category": F.when(n % 19 == 0, "drift").otherwise(F.col("category")), "digest": F.when(n % 23 == 0, "other").otherwise("d")})
    return rc.receipt_vs_ledger(changed.unionByName(kept.where("n % 29 = 0").withColumn("record_id", F.concat(F.lit("X"), "record_id"))), own)


STATUS = "(SELECT *, CASE WHEN category = 'question' THEN CASE WHEN n % 3 = 0 THEN 'resolved' ELSE 'open' END WHEN n % 4 = 0 THEN 'verified' WHEN n % 4 = 1 THEN 'rejected' WHEN n % 44 = 2 THEN 'odd' ELSE 'accepted' END AS status, CASE WHEN n % 2 = 0 THEN 'pass' ELSE 'unresolved' END AS vr FROM " + RECORDS + " r WHERE run_id % 5 <> 0)"


@query("rc2_terminal_status", found_sql("run_id", ("finding_not_terminal", "record_id", "status", f"{STATUS} r WHERE category = 'finding' AND n % 4 > 1"), ("question_not_resolved", "record_id", "status", f"{STATUS} r WHERE category = 'question' AND n % 3 <> 0"), ("question_not_judged", "record_id", "vr", f"{STATUS} r WHERE category = 'question' AND n % 2 = 1")))
def _(s, d):
    return rc.terminal_status(records(s, d), runs(s, d).where("run_id % 5 = 0"))


@query("rc3_verifier_quorum", found_sql("run_id", ("deferred_with_verifiers", "run_id", "3", f"{RUNS} r WHERE run_id % 6 = 0"), ("wrong_number", "run_id", "2", f"{RUNS} r WHERE run_id % 6 = 1"), ("verifier_repeated", "run_id", "NULL", f"{RUNS} r WHERE run_id % 6 = 2"), ("not_passed", "run_id", "NULL", f"{RUNS} r WHERE run_id % 6 = 3"), ("other_snapshot", "run_id", "NULL", f"{RUNS} r WHERE run_id % 6 = 4"), ("evidence_blank", "run_id", "NULL", f"{RUNS} r WHERE run_id % 6 = 4")))
def _(s, d):
    m = K() % 6
    v = lambda i, r="pass", snap="s", ev="e": F.struct(F.lit(i).alias("verifier_id"), F.lit(r).alias("result"), F.lit(snap).alias("snapshot_id"), F.lit(ev).alias("evidence"))
    verifiers = F.when(m == 1, F.array(v("a"), v("b"))).when(m == 2, F.array(v("a"), v("b"), v("a"))).when(m == 3, F.array(v("a"), v("b"), v("c", "fail"))).when(m == 4, F.array(v("a"), v("b"), v("c", snap="old", ev=" "))).otherwise(F.array(v("a"), v("b"), v("c")))
    return rc.verifier_quorum(runs(s, d, snapshot_id=F.lit("s"), verifiers=verifiers), runs(s, d).where("run_id % 6 = 0"))


@query("rc4_binding_mismatch", f"SELECT run_id, 'snapshot_id' AS field, 'ledger' AS other FROM {RUNS} r WHERE run_id % 7 = 0 UNION ALL SELECT run_id, 'packet_digest', 'packet' FROM {RUNS} r WHERE run_id % 9 = 0 OR run_id % 11 = 0 UNION ALL SELECT run_id, 'target', 'packet' FROM {RUNS} r WHERE run_id % 11 = 0")
def _(s, d):
    receipt = runs(s, d, snapshot_id=F.when(K() % 7 == 0, "old").otherwise("s"), packet_digest=F.when(K() % 9 == 0, "x").otherwise("p"), target=F.lit("t"), profile_id=F.lit(None).cast("string"))
    packets = runs(s, d, packet_digest=F.lit("p"), target=F.lit("t")).where("run_id % 11 <> 0")
    return rc.binding_mismatch(receipt, runs(s, d, snapshot_id=F.lit("s"), profile_id=F.lit(None).cast("string")), packets)


@query("rc5_trace_binding", f"SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'no_gate_event' ELSE 'several_gate_events' END AS problem, CAST(NULL AS VARCHAR) AS field FROM {RUNS} r WHERE run_id % 5 < 2 UNION ALL SELECT run_id, 'rewritten', 'editing_state' FROM {RUNS} r WHERE run_id % 5 > 1 AND run_id % 3 = 0 UNION ALL SELECT run_id, 'rewritten', 'prior_round_no' FROM {RUNS} r WHERE run_id % 5 > 1 AND run_id % 4 = 0")
def _(s, d):
    receipt = runs(s, d, editing_state=F.lit("frozen"), prior_round_no=F.when(K() % 4 != 0, 1))
    gate = runs(s, d, event=F.lit("input_gate"), editing_state=F.when(K() % 3 == 0, "editing").otherwise("frozen"), prior_round_no=F.lit(1))
    return rc.trace_binding(receipt, gate.where("run_id % 5 <> 0").unionByName(gate.where("run_id % 5 = 1")))


@query("rc6_open_item_misuse", found_sql("run_id", ("open_items_suppress", "record_id", "p", f"(SELECT run_id, record_id, n, CASE WHEN n % 2 = 0 THEN 'open.md' ELSE 'other.md' END AS p FROM {RECORDS} r WHERE category = 'nonissue') WHERE n % 2 = 0 OR n % 3 = 0"), ("classified_not_live", "'Z'", "NULL", f"{RUNS} r WHERE run_id % 3 = 0"), ("classified_rejected", "'F1'", "NULL", f"{RUNS} r WHERE run_id % 4 = 0")))
def _(s, d):
    n = F.col("n")
    sup = records(s, d).where("category = 'nonissue'").select("run_id", "record_id", F.lit("suppressed").alias("category"), F.when(n % 2 == 0, "open.md").otherwise("other.md").alias("authority_path"), F.when(n % 3 == 0, "h").otherwise("g").alias("authority_sha256"))
    found = F.array(F.struct(F.lit("F1").alias("record_id"), F.when(K() % 4 == 0, "rejected").otherwise("accepted").alias("status")))
    return rc.open_item_misuse(runs(s, d, open_items_path=F.lit("open.md"), open_items_sha256=F.lit("h"), classified_ids=F.when(K() % 3 == 0, F.array(F.lit("F1"), F.lit("Z"))).otherwise(F.array(F.lit("F1"))), findings=found), sup)


#: Which runs' configuration is empty, has a blank name, a repeated one, a negative count.
C_EMPTY, C_BLANK, C_TWICE, C_LESS = "run_id % 19 = 0", "run_id % 19 <> 0 AND run_id % 17 = 0", "run_id % 19 <> 0 AND run_id % 17 <> 0 AND run_id % 4 = 0", "run_id % 19 <> 0 AND run_id % 23 = 0"


@query("rc7_scale_totals", found_sql("run_id", ("total_differs", "run_id", "4", f"{RUNS} r WHERE run_id % 5 = 0 AND NOT ({C_EMPTY} OR {C_BLANK} OR {C_TWICE} OR {C_LESS})"), ("upper_below_total", "run_id", "2", f"{RUNS} r WHERE run_id % 7 = 0"), ("upper_differs", "run_id", "2", f"{RUNS} r WHERE run_id % 7 = 0 AND run_id % 29 <> 0"), ("rounds_differ", "run_id", "2", f"{RUNS} r WHERE run_id % 3 = 0"),
    ("list_empty:configuration", "run_id", "NULL", f"{RUNS} r WHERE {C_EMPTY}"), ("name_blank:configuration", "run_id", "NULL", f"{RUNS} r WHERE {C_BLANK}"), ("name_repeated:configuration", "run_id", "NULL", f"{RUNS} r WHERE {C_TWICE}"), ("negative_count:configuration", "run_id", "NULL", f"{RUNS} r WHERE {C_LESS}"), ("negative_count:upper_configuration", "run_id", "NULL", f"{RUNS} r WHERE run_id % 29 = 0"),
    ("rounds_without_runs", "run_id", "2", f"{RUNS} r WHERE run_id % 3 = 0 AND run_id % 2 = 1"), ("rounds_without_reason", "run_id", "NULL", f"{RUNS} r WHERE run_id % 31 = 0"), ("volume_lines", "run_id", "0", f"{RUNS} r WHERE run_id % 11 = 0")))
def _(s, d):
    item = lambda n, c: F.struct(n.alias("name"), c.cast("int").alias("count"))
    config = F.array(item(F.lit("a"), F.when(K() % 23 == 0, -1).otherwise(1)), item(F.when(K() % 17 == 0, " ").when(K() % 4 == 0, "a").otherwise("b"), F.lit(2)))
    config = F.when(K() % 19 == 0, F.slice(config, 1, 0)).otherwise(config)
    upper = F.array(item(F.lit("a"), F.when(K() % 29 == 0, -6).otherwise(6)))
    return rc.scale_totals(runs(s, d, snapshot_id=F.lit("s"), volume_snapshot_id=F.lit("s"), volume_lines=F.when(K() % 11 == 0, 0).otherwise(5), configuration=config, derived_total=F.when(K() % 5 == 0, 4).otherwise(3).cast("long"), upper_configuration=upper, upper_bound=F.when(K() % 7 == 0, 2).otherwise(6).cast("long"),
        planned_rounds=F.lit(1), executed_rounds=F.when(K() % 3 == 0, 2).otherwise(1), run_ids=F.when(K() % 2 == 0, F.array(F.lit("r1"))), rounds_reason=F.when(K() % 31 == 0, " ").otherwise("why")))


@query("rc8_round_context", found_sql("run_id", ("label_format", "run_id", "'x'", f"{RUNS} r WHERE run_id % 5 = 0"), ("label_not_next", "run_id", "'r1'", f"{RUNS} r WHERE run_id % 5 <> 0 AND run_id % 2 = 0"), ("comparison_missing", "run_id", "NULL", f"{RUNS} r WHERE run_id % 2 = 0 AND run_id % 3 = 0"), ("comparison_unasked", "run_id", "NULL", f"{RUNS} r WHERE run_id % 2 = 1 AND run_id % 3 <> 0"), ("few_snapshots", "run_id", "NULL", f"{RUNS} r WHERE run_id % 7 = 0"), ("lost_id_unknown", "run_id", "NULL", f"{RUNS} r WHERE run_id % 11 = 0"), ("axis_without_reason", "run_id", "NULL", f"{RUNS} r WHERE run_id % 13 = 0"), ("axis_not_undetermined", "run_id", "'judged'", f"{RUNS} r WHERE run_id % 13 <> 0 AND run_id % 17 = 0")))
def _(s, d):
    return rc.round_context_violations(runs(s, d, round_label=F.when(K() % 5 == 0, "x").otherwise("r1"), prior_exists=K() % 2 == 0, prior_round_no=F.when(K() % 2 == 0, 1), comparison_ref=F.when(K() % 3 != 0, "c"), observed_snapshots=F.when(K() % 7 == 0, F.array(F.lit("a"))), lost_ids=F.when(K() % 11 == 0, F.array(F.lit("q"))), record_ids=F.array(F.lit("r")), structure_axis=F.when(K() % 13 == 0, "undetermined").otherwise("judged"), structure_reason=F.lit(None).cast("string"), profile_not_applicable=K() % 17 == 0))


@query("rc9_input_gate", found_sql("run_id", ("editing_state", "run_id", "'odd'", f"{RUNS} r WHERE run_id % 5 = 0"), ("open_items_missing", "run_id", "NULL", f"{RUNS} r WHERE run_id % 3 = 0"), ("copy_missing", "run_id", "'copy.md'", f"{RUNS} r WHERE run_id % 7 = 0"), ("copy_changed", "run_id", "'copy.md'", f"{RUNS} r WHERE run_id % 7 <> 0 AND run_id % 11 = 0"), ("copy_not_snapshot", "run_id", "NULL", f"{RUNS} r WHERE run_id % 13 = 0"), ("prior_incomplete", "run_id", "NULL", f"{RUNS} r WHERE run_id % 2 = 0")))
def _(s, d):
    h, o = F.sha2(F.lit("t"), 256), F.sha2(F.lit("o"), 256)
    receipt = runs(s, d, snapshot_id=F.concat(F.lit("sha256:"), F.when(K() % 13 == 0, o).otherwise(h)), editing_state=F.when(K() % 5 == 0, "odd").otherwise("frozen"), target_maturity=F.when(K() % 3 == 0, "draft").otherwise("final"), open_items_ref=F.lit(None).cast("string"), source_copy_path=F.lit("copy.md"), source_copy_sha256=h, prior_exists=K() % 2 == 0, prior_path=F.lit(None).cast("string"), prior_round_no=F.lit(None).cast("int"))
    return rc.input_gate_violations(receipt, runs(s, d, path=F.lit("copy.md"), sha256=F.when(K() % 11 == 0, o).otherwise(h)).where("run_id % 7 <> 0"))


@query("rc10_receipt_verdict", f"SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'legacy' WHEN run_id % 3 = 0 THEN 'failed' WHEN run_id % 2 = 0 THEN 'deferred' ELSE 'done' END AS verdict FROM {RUNS} r")
def _(s, d):
    receipt = runs(s, d, schema_version=F.when(K() % 5 == 0, 1).otherwise(2), editing_state=F.when(K() % 2 == 0, "editing").otherwise("frozen"))
    return rc.receipt_verdict(receipt, runs(s, d).where("run_id % 3 = 0"))


# --- manifests, gaps, grounding, scores

SEC = "{sections}"


def man_sections(s, d):
    n = F.col("section_id")
    return rows(s, d, "sections").select("project_id", n.alias("pos"), text("section_id").alias("id"), F.when(n % 31 == 0, "").otherwise(F.concat(F.lit("T"), text("section_id"))).alias("title"), F.when(n % 37 == 0, "odd").otherwise(F.col("status")).alias("status"), F.when(n % 4 != 0, F.array(F.lit("src"))).alias("sources"), F.when(F.col("gap").isNotNull(), F.array("gap")).alias("gaps"), F.when(n % 41 == 0, F.create_map(F.lit("charm"), F.lit(1))).alias("scores"))


def questions(s, d):
    n = F.col("section_id")
    return rows(s, d, "sections").where("question_status is not null").select("project_id", F.concat(F.lit("Q"), text("section_id")).alias("id"), F.when(n % 15 != 0, "topic").alias("topic"), F.when(n % 35 == 0, "odd").otherwise(F.col("question_status")).alias("status"), F.when(n % 10 != 0, "me").alias("owner"))


def audit(s, d):
    n = F.col("section_id")
    own = rows(s, d, "sections").where("pending_apply").select("project_id", F.lit("pending_apply").alias("list"), F.when(n % 5 == 0, "none").when(n % 7 == 0, "").otherwise(F.concat(F.lit("D"), text("section_id"))).alias("decision_id"), n.alias("n"))
    return own.unionByName(own.where("n % 3 = 0").withColumn("list", F.lit("applied"))).drop("n")


def decision_log(s, d):
    return rows(s, d, "sections").where("pending_apply").select("project_id", F.concat(F.lit("D"), text("section_id")).alias("id"), F.when(F.col("section_id") % 2 == 0, "yes").alias("decision"))


def projects(s, d):
    paths = lambda c, p: F.when(c, p).otherwise(F.create_map().cast("map<string,array<string>>"))
    k = F.col("project_id")
    return rows(s, d, "SELECT DISTINCT o_custkey AS project_id FROM {orders}").withColumns({"product": F.when(k % 11 != 0, "p"), "ssot": F.lit("ssot.md"), "doc_type": F.when(k % 3 != 0, "t"), "sources": paths(k % 2 == 0, F.create_map(F.lit("docs"), F.array(F.lit("a"), F.lit("b")), F.lit("typo"), F.array(F.lit("c")))), "downstream": paths(k % 5 == 0, F.create_map(F.lit("any"), F.array(F.concat(F.lit("f"), (k % 7).cast("string")), F.lit("f1"), F.lit(" f1 "))))})


A_ = "(SELECT *, CASE WHEN section_id % 5 = 0 THEN 'none' WHEN section_id % 7 = 0 THEN '' ELSE concat('D', section_id) END AS did, unnest(CASE WHEN section_id % 3 = 0 THEN ['pending_apply', 'applied'] ELSE ['pending_apply'] END) AS list FROM {sections} s WHERE pending_apply)"


@query("gp1_manifest_violations", found_sql("project_id", ("product_missing", "project_id", "NULL", "(SELECT DISTINCT o_custkey AS project_id FROM orders) WHERE project_id % 11 = 0"), ("doc_type_unset", "project_id", "NULL", "(SELECT DISTINCT o_custkey AS project_id FROM orders) WHERE project_id % 3 = 0", "warning"), ("title_missing", "section_id", "NULL", f"{SEC} s WHERE section_id % 31 = 0"), ("status_invalid", "section_id", "'odd'", f"{SEC} s WHERE section_id % 37 = 0"),
    ("approved_without_sources", "section_id", "NULL", f"{SEC} s WHERE section_id % 37 <> 0 AND status = 'approved' AND section_id % 4 = 0", "warning"), ("unknown_axis", "section_id", "'charm'", f"{SEC} s WHERE section_id % 41 = 0", "warning"), ("question_topic_missing", "concat('Q', section_id)", "NULL", f"{SEC} s WHERE question_status IS NOT NULL AND section_id % 15 = 0"), ("question_status_invalid", "concat('Q', section_id)", "'odd'", f"{SEC} s WHERE question_status IS NOT NULL AND section_id % 35 = 0"),
    ("question_owner_unset", "concat('Q', section_id)", "NULL", f"{SEC} s WHERE question_status IS NOT NULL AND section_id % 10 = 0", "warning"), ("decision_text_missing", "concat('D', section_id)", "NULL", f"{SEC} s WHERE pending_apply AND section_id % 2 = 1"), ("audit_id_missing", "list", "NULL", f"{A_} a WHERE did = ''"), ("audit_dangling", "did", "list", f"{A_} a WHERE did = 'none'"),
    ("audit_repeated", "did", "list", f"(SELECT project_id, did, list FROM {A_} a WHERE did <> '' GROUP BY ALL HAVING count(*) > 1)"), ("audit_in_both", "did", "NULL", f"(SELECT project_id, did FROM {A_} a WHERE did <> '' GROUP BY ALL HAVING count(DISTINCT list) > 1)", "warning")))
def _(s, d):
    return mf.manifest_violations(projects(s, d), man_sections(s, d), questions(s, d), decision_log(s, d), audit(s, d))


def observations(s, d):
    n = F.col("obs_id")
    return rows(s, d, "obs").select(F.col("chunk_id").alias("project_id"), text("obs_id").alias("id"), F.when(n % 13 != 0, "seen").alias("what"), F.when(n % 17 == 0, "odd").otherwise("bug").alias("kind"), "verified", F.when(F.col("source_id").isNotNull(), F.array(text("source_id"))).otherwise(F.array().cast(NO_TEXTS)).alias("sources"))


#: Every order is a project of its own here, with one chunk of its line items.
def one_chunk(s, d):
    members = rows(s, d, "obs").groupBy("chunk_id").agg(F.collect_list(text("obs_id")).alias("members"))
    own = rows(s, d, "chunks").join(members, "chunk_id", "left")
    more = F.when(F.col("chunk_id") % 19 == 0, F.concat(F.coalesce("members", F.array().cast(NO_TEXTS)), F.array(F.lit("ghost")))).otherwise(F.coalesce("members", F.array().cast(NO_TEXTS)))
    return own.select(F.col("chunk_id").alias("project_id"), text("chunk_id").alias("id"), F.lit("t").alias("title"), more.alias("members"), F.col("ord").alias("order"), "order_rationale", "status", "asis", "tobe")


AUTH = "status <> 'pending'"
OBS_P = "(SELECT chunk_id AS project_id, * FROM {obs} o)"
CH_P = "(SELECT chunk_id AS pid, * FROM {chunks} c)"
BARE = "(SELECT pid AS project_id, c.* FROM " + CH_P + " c WHERE chunk_id % 19 <> 0 AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = c.chunk_id))"


@query("gp2_plan_violations", found_sql("project_id", ("what_missing", "obs_id", "NULL", f"{OBS_P} o WHERE obs_id % 13 = 0"), ("kind_unknown", "obs_id", "'odd'", f"{OBS_P} o WHERE obs_id % 17 = 0", "warning"), ("verified_without_source", "obs_id", "NULL", f"{OBS_P} o WHERE verified AND source_id IS NULL", "warning"), ("members_empty", "chunk_id", f"CASE WHEN {AUTH} THEN 'authored' ELSE 'not authored' END", f"{BARE} b", "warning")) + " UNION ALL "
    + found_sql("pid AS project_id", ("rationale_missing", "chunk_id", "NULL", f"{CH_P} c WHERE order_rationale IS NULL", "warning"), ("asis_missing", "chunk_id", "NULL", f"{CH_P} c WHERE {AUTH} AND asis IS NULL", "warning"), ("tobe_missing", "chunk_id", "NULL", f"{CH_P} c WHERE {AUTH} AND tobe IS NULL", "warning"), ("member_dangling", "chunk_id", "'ghost'", f"{CH_P} c WHERE chunk_id % 19 = 0")))
def _(s, d):
    return mf.plan_violations(observations(s, d), one_chunk(s, d))


REPORT = """(SELECT project_id, count(*) AS n_sections, count(gap) AS n_gaps, count(*) FILTER (status = 'pending' AND section_id % 37 <> 0) AS n_pending, count(*) FILTER (status = 'draft' AND section_id % 37 <> 0) AS n_draft, count(*) FILTER (status = 'review' AND section_id % 37 <> 0) AS n_review, count(*) FILTER (status = 'approved' AND section_id % 37 <> 0) AS n_approved,
count(*) FILTER (question_status = 'open' AND section_id % 35 <> 0) AS n_q_open, CAST(0 AS BIGINT) AS n_q_resolved, count(*) FILTER (question_status = 'deferred' AND section_id % 35 <> 0) AS n_q_deferred, count(*) FILTER (pending_apply) AS n_pending_apply FROM {sections} s GROUP BY project_id)"""


def report(s, d):
    return mf.gap_report(man_sections(s, d), questions(s, d), audit(s, d))


@query("gp3_gap_report", f"SELECT * FROM {REPORT} r")
def _(s, d):
    return report(s, d)


COVER = "(SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_sources, CASE WHEN project_id % 5 <> 0 THEN 0 WHEN project_id % 7 IN (0, 3) THEN 2 ELSE 1 END::BIGINT AS n_downstream, CASE WHEN project_id % 5 = 0 AND project_id % 7 NOT IN (0, 1, 3) THEN concat('f', project_id % 7) ELSE '' END AS unreadable, project_id % 2 = 1 AND project_id % 5 <> 0 AS cross_blind FROM (SELECT DISTINCT o_custkey AS project_id FROM orders))"


def coverage(s, d):
    return mf.crosscheck_coverage(projects(s, d), s.createDataFrame([("f0",), ("f1",), ("f3",)], "path string"))


@query("gp4_crosscheck_coverage", f"SELECT * FROM {COVER} c")
def _(s, d):
    return coverage(s, d).withColumn("unreadable", F.array_join("unreadable", ","))


@query("gp5_release_gate", f"SELECT project_id, reasons, reasons = '' AS passes FROM (SELECT r.project_id, concat_ws(',', CASE WHEN n_gaps > 0 THEN 'gaps' END, CASE WHEN n_q_open > 0 THEN 'open_questions' END, CASE WHEN n_pending > 0 THEN 'pending' END, CASE WHEN n_pending_apply > 0 THEN 'pending_apply' END, CASE WHEN cross_blind THEN 'cross_blind' END, CASE WHEN unreadable <> '' THEN 'unreadable_downstream' END) AS reasons FROM {REPORT} r LEFT JOIN {COVER} c ON c.project_id = r.project_id)")
def _(s, d):
    return mf.release_gate(report(s, d), coverage(s, d), strict_cross=True).withColumn("reasons", F.array_join("reasons", ","))


GAPS = "(SELECT project_id, concat('agent', CAST(section_id % 3 AS STRING)) AS agent, CASE WHEN section_id % 21 = 0 THEN 'nowhere' ELSE CAST(section_id - section_id % 2 AS STRING) END AS section_id, gap, CASE WHEN section_id % 6 = 0 THEN 'missing' WHEN section_id % 6 = 3 THEN 'odd' END AS kind FROM {sections} s WHERE gap IS NOT NULL)"


@query("gp6_merge_gaps", f"""SELECT g.project_id, g.section_id, gap, array_to_string(list_sort(list(DISTINCT agent)), ',') AS agents, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), ','), '') AS kinds, CASE WHEN bool_or(k.id IS NULL) OR NOT coalesce(bool_or(kind = 'missing'), false) THEN 'open_question' ELSE 'gap' END AS becomes, count(DISTINCT kind) > 1 AS disagreement
FROM {GAPS} g LEFT JOIN (SELECT DISTINCT project_id, CAST(section_id AS VARCHAR) AS id FROM {{sections}} s) k ON k.project_id = g.project_id AND k.id = g.section_id GROUP BY 1, 2, 3""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    out = mf.merge_gaps(rows(s, d, f"SELECT * FROM {GAPS} g"), man_sections(s, d))
    return out.withColumns({"agents": F.array_join("agents", ","), "kinds": F.array_join("kinds", ",")})


@query("gr1_grounded", "SELECT chunk_id AS project_id, CAST(obs_id AS STRING) AS id, verified AND source_id IS NOT NULL AS grounded FROM {obs} o")
def _(s, d):
    return mf.grounded(observations(s, d)).select("project_id", "id", "grounded")


UNGROUNDED = "(SELECT o.chunk_id AS project_id, CAST(o.chunk_id AS STRING) AS chunk_id, CAST(obs_id AS STRING) AS obs_id, CASE WHEN obs_id % 13 <> 0 THEN 'seen' END AS what FROM {obs} o JOIN {chunks} c ON c.chunk_id = o.chunk_id WHERE c.status <> 'pending' AND NOT (verified AND source_id IS NOT NULL))"


@query("gr2_ungrounded_plans", f"SELECT * FROM {UNGROUNDED} u")
def _(s, d):
    return mf.ungrounded_plans(one_chunk(s, d), observations(s, d))


PLAN_GAPS = found_sql("pid AS project_id", ("pending", "chunk_id", "NULL", f"{CH_P} c WHERE status = 'pending'"), ("no_rationale", "chunk_id", "NULL", f"{CH_P} c WHERE order_rationale IS NULL"), ("no_asis", "chunk_id", "NULL", f"{CH_P} c WHERE {AUTH} AND asis IS NULL"), ("no_tobe", "chunk_id", "NULL", f"{CH_P} c WHERE {AUTH} AND tobe IS NULL")) + " UNION ALL " + found_sql("project_id", ("no_members", "chunk_id", "NULL", f"{BARE} b WHERE {AUTH}"))


@query("gr3_plan_gaps", PLAN_GAPS)
def _(s, d):
    return mf.plan_gaps(one_chunk(s, d))


@query("gr4_resolution_order", "SELECT project_id, CAST(chunk_id AS STRING) AS id, ord AS \"order\", CAST(row_number() OVER (PARTITION BY project_id ORDER BY ord, CAST(chunk_id AS STRING)) AS INTEGER) AS pos, count(*) OVER (PARTITION BY project_id, ord) > 1 AS ambiguous FROM {chunks} c")
def _(s, d):
    return mf.resolution_order(rows(s, d, "chunks").select("project_id", text("chunk_id").alias("id"), F.col("ord").alias("order")))


@query("gr5_handoff_gate", f"SELECT c.pid AS project_id, coalesce(g.reasons, '') AS reasons, coalesce(g.reasons, '') = '' AS passes FROM {CH_P} c LEFT JOIN (SELECT project_id, array_to_string(list_sort(list(DISTINCT rule)), ',') AS reasons FROM (SELECT project_id, rule FROM ({PLAN_GAPS}) p UNION ALL SELECT project_id, 'ungrounded_plan' FROM {UNGROUNDED} u) x GROUP BY 1) g ON g.project_id = c.pid")
def _(s, d):
    own = one_chunk(s, d)
    p = own.select("project_id").withColumns({"sources": F.create_map().cast("map<string,array<string>>"), "downstream": F.create_map().cast("map<string,array<string>>")})
    return mf.handoff_gate(own, observations(s, d), p).withColumn("reasons", F.array_join("reasons", ","))


@query("gr6_cluster_observations", """WITH RECURSIVE h AS (SELECT o_custkey AS p, o_orderkey AS id, unnest([o_orderkey % 9, o_orderkey % 11 + 100]) AS s FROM orders), e AS (SELECT DISTINCT a.p, a.id AS x, b.id AS y FROM h a JOIN h b ON a.p = b.p AND a.s = b.s), r AS (SELECT p, x, y FROM e UNION SELECT r.p, r.x, e.y FROM r JOIN e ON e.p = r.p AND e.x = r.y)
SELECT p AS project_id, x AS id, min(y) AS cluster FROM r GROUP BY 1, 2""")
def _(s, d):
    own = table(s, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.array((F.col("o_orderkey") % 9).cast("string"), (F.col("o_orderkey") % 11 + 100).cast("string")).alias("sources"))
    return mf.cluster_observations(own)


@query("gr7_sequence_chunks", """WITH RECURSIVE c AS (SELECT o_custkey AS p, o_orderkey AS id, o_totalprice AS w, CASE WHEN o_orderkey % 3 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS need FROM orders), r AS (SELECT p, id, 0 AS l FROM c WHERE need IS NULL UNION ALL SELECT c.p, c.id, l + 1 FROM r JOIN c ON c.p = r.p AND c.need = r.id)
SELECT c.p AS project_id, c.id, r.l AS level, CAST(row_number() OVER (PARTITION BY c.p ORDER BY l, w * CAST(0.5 AS DOUBLE) DESC, c.id) AS INTEGER) AS pos FROM c JOIN r ON r.p = c.p AND r.id = c.id""")
def _(s, d):
    own = rows(s, d, "SELECT o_custkey AS project_id, o_orderkey AS id, o_totalprice AS risk, CASE WHEN o_orderkey % 3 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS needs FROM {orders}")
    return mf.sequence_chunks(own.select("project_id", "id", "risk"), own.where("needs is not null").select("project_id", "id", "needs"), {"risk": 0.5})


def policy(s, d):
    own = rows(s, d, "SELECT DISTINCT CAST(p_size AS BIGINT) AS project_id FROM {part}")
    k, m, no = F.col("project_id"), lambda *a: F.create_map(*map(F.lit, a)), F.lit(None).cast("map<string,int>")
    return mf.scale_of(own.withColumns({"legacy_scale": F.when(k % 2 == 0, m("pass_threshold", 4)), "scale": m("max", 6), "rubric_scale": no, "weights": F.when(k % 3 == 0, F.create_map().cast("map<string,int>")), "legacy_weights": m("clarity", 2, "blocking", 5)}))


def score_sections(s, d):
    own = rows(s, d, "scores")
    axes = F.map_filter(F.create_map(*(x for a in mf.AXES for x in (F.lit(a), F.col(a)))), lambda _, v: v.isNotNull())
    return own.select("project_id", F.col("section_id").alias("pos"), text("section_id").alias("id"), F.when(F.col("section_id") % 29 != 0, axes).alias("scores"), F.create_map(F.lit("blocking"), F.col("blocking")).alias("flags"))


SCORED = """(SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, pos)::INTEGER AS rank FROM (SELECT *, weight * 10 + deficit AS priority FROM (SELECT project_id, section_id AS pos, CAST(section_id AS VARCHAR) AS id,
(greatest(0, thr - completeness) + greatest(0, thr - coherence) + coalesce(greatest(0, thr - clarity), 0) + coalesce(greatest(0, thr - depth), 0))::INTEGER AS deficit,
((completeness < thr)::INT + (coherence < thr)::INT + coalesce((clarity < thr)::INT * CASE WHEN project_id % 3 = 0 THEN 1 ELSE 2 END, 0) + coalesce((depth < thr)::INT, 0) + CASE WHEN blocking AND project_id % 3 <> 0 THEN 5 ELSE 0 END)::INTEGER AS weight,
concat_ws(',', CASE WHEN completeness < thr THEN 'completeness' END, CASE WHEN coherence < thr THEN 'coherence' END, CASE WHEN clarity < thr THEN 'clarity' END, CASE WHEN depth < thr THEN 'depth' END) AS failing, concat_ws(',', CASE WHEN clarity IS NULL THEN 'clarity' END, CASE WHEN depth IS NULL THEN 'depth' END) AS absent
FROM (SELECT *, CASE WHEN project_id % 2 = 0 THEN 4 ELSE 3 END AS thr FROM {scores} s) WHERE section_id % 29 <> 0)))"""


def scored(s, d):
    return mf.section_scores(score_sections(s, d), policy(s, d))


def joined(rows_: DataFrame, *cols: str) -> DataFrame:
    return rows_.withColumns({c: F.array_join(c, ",") for c in cols})


@query("sc1_section_scores", f"SELECT * FROM {SCORED} s")
def _(s, d):
    return joined(scored(s, d), "failing", "absent")


@query("sc1_scale", "SELECT DISTINCT CAST(p_size AS BIGINT) AS project_id, 1 AS min, 6 AS max, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END AS pass_threshold, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END AS n_weights FROM part")
def _(s, d):
    return policy(s, d).withColumn("n_weights", F.size("weights")).drop("weights")


@query("sc2_below_threshold", f"SELECT project_id, id, failing FROM {SCORED} s WHERE failing <> ''")
def _(s, d):
    return joined(mf.below_threshold(scored(s, d)), "failing")


@query("sc2_incomplete_scores", f"SELECT project_id, id, absent FROM {SCORED} s WHERE absent <> ''")
def _(s, d):
    return joined(mf.incomplete_scores(scored(s, d)), "absent")


@query("sc3_scoring_gate", f"SELECT *, reasons = '' AS passes FROM (SELECT p.project_id, any_value(p.n) AS n_sections, count(s.id) AS n_scored, concat_ws(',', CASE WHEN count(*) FILTER (failing <> '') > 0 THEN 'below_threshold' END, CASE WHEN count(s.id) = 0 THEN 'nothing_scored' END, CASE WHEN count(*) FILTER (absent <> '') > 0 THEN 'unscored_axes' END) AS reasons FROM (SELECT CAST(p_size AS BIGINT) AS project_id, count(*) AS n FROM part GROUP BY 1) p LEFT JOIN {SCORED} s ON s.project_id = p.project_id GROUP BY 1)")
def _(s, d):
    return joined(mf.scoring_gate(score_sections(s, d), scored(s, d), strict_coverage=True), "reasons")
