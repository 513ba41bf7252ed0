"""Classification ledgers of many review runs at once.

sources: run_id, source_id, lens, statement, anchors; atoms: run_id, atom_id, source_refs, statement, anchors, basis (struct of co_reference,
semantic_values, presentation_rule, evidence), derived_from; records: one wide row with its category; rows: run_id, atom_id, outcome, record_id, anchors.
Ids are strings, lists arrays; a column that a frame lacks is taken as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_violation, repeated, union, violations
from ..functions.text import blank
from .decisions import DATE, SHA
from .graph import or_false

KEY = ["run_id"]
#: The categories with what each requires and may have besides, and the enumerations.
OUTCOMES = ("finding", "question", "drift", "suppressed", "nonissue")
COMMON = ("record_id", "snapshot_id", "anchors", "digest")
REQUIRED = {
    "finding": ("finding_id", "atom_refs", "source_refs", "severity", "provenance", "status"),
    "question": ("status", "convention_slot", "atom_refs", "derived_refs", "verification_result"),
    "drift": ("atom_refs", "source_refs", "detail", "variants", "co_reference_basis"),
    "suppressed": ("atom_refs", "source_refs", "rationale", "authority_path"),
    "nonissue": ("atom_refs", "source_refs", "rationale"),
    "counter_evidence": ("finding_record_id", "resolution"),
}
OPTIONAL = {"finding": ("narrowing", "verdict"), "question": ("authority", "scope", "authority_path"), "drift": ("comparison_ref",), "suppressed": (), "nonissue": (), "counter_evidence": ()}
ENUMS = {
    ("finding", "status"): ("discovered", "accepted", "rejected", "planned", "applied", "verified"), ("finding", "verdict"): ("none", "partial", "full"),
    ("question", "status"): ("open", "resolved"), ("question", "verification_result"): ("pass", "kill", "unresolved"), ("counter_evidence", "resolution"): ("partial", "full"),
}
#: What an approval must say, and its states.
APPROVAL = ("id", "docmodel_path", "docmodel_sha256", "status", "approved_by", "approved_at", "evidence")
APPROVAL_STATUS = ("approved", "revoked")
#: What findings have by the schema's version.
VERSIONED = "verdict"
#: What counts for a record's digest, by category; the fields' order is that of their names.
DIGESTED = {
    "finding": ("anchors", "atom_refs", "finding_id", "narrowing", "provenance", "record_id", "severity", "snapshot_id", "source_refs", "verdict"),
    "question": ("anchors", "atom_refs", "authority", "authority_path", "convention_slot", "derived_refs", "record_id", "scope", "snapshot_id", "verification_result"),
    "drift": ("anchors", "atom_refs", "co_reference_basis", "comparison_ref", "detail", "record_id", "snapshot_id", "source_refs", "variants"),
    "suppressed": ("anchors", "atom_refs", "authority_path", "rationale", "record_id", "snapshot_id", "source_refs"),
    "nonissue": ("anchors", "atom_refs", "rationale", "record_id", "snapshot_id", "source_refs"),
    "counter_evidence": ("anchors", "finding_record_id", "record_id", "resolution", "snapshot_id"),
}


def _has(rows: DataFrame, field: str) -> Column:
    return F.col(field).isNotNull() if field in rows.columns else F.lit(False)


def _each(rows: DataFrame, ids: list[str], array: str, name: str) -> DataFrame:
    return rows.select(*KEY, *ids, F.explode(array).alias(name))


def _ids(rows: DataFrame, col: str, name: str) -> DataFrame:
    return rows.select(*KEY, F.col(col).alias(name)).distinct()


def shape_violations(records: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """lg1: missing and unknown fields by category, values outside their enumeration, lists that are empty or repeat themselves, foreign snapshots (run_id, snapshot_id).

    With a column schema_version, findings of version 2 must have a verdict, those of version 1 must not, and there are no other versions."""
    is_it, rules, versioned = lambda c: F.col("category") == c, [], "schema_version" in records.columns
    fields = sorted({f for c in REQUIRED for f in REQUIRED[c] + OPTIONAL[c]})
    for f in (*COMMON, *fields):
        needs = [c for c in REQUIRED if f in COMMON or f in REQUIRED[c]]
        takes = needs + [c for c in OPTIONAL if f in OPTIONAL[c]]
        lacks, strange = F.col("category").isin(*needs), ~F.col("category").isin(*takes)
        if f == VERSIONED and versioned:
            lacks, strange = lacks | is_it("finding") & (F.col("schema_version") == 2), strange | is_it("finding") & (F.col("schema_version") == 1)
        rules.append((f"missing:{f}", lacks & ~_has(records, f), F.col("category")))
        if set(takes) != set(REQUIRED):
            rules.append((f"unknown:{f}", strange & _has(records, f), F.col("category")))
    for (c, f), values in ENUMS.items():
        if f in records.columns:
            asked = F.col("schema_version") == 2 if f == VERSIONED and versioned else F.lit(True)
            rules.append((f"enum:{c}.{f}", is_it(c) & asked & F.col(f).isNotNull() & ~F.col(f).isin(*values), F.col(f)))
    for f in ("anchors", "atom_refs", "source_refs"):
        if f in records.columns:
            rules.append((f"list:{f}", F.col(f).isNotNull() & ((F.size(f) == 0) | (F.size(f) != F.size(F.array_distinct(f)))), F.col("category")))
    if versioned:
        rules.append(("schema_version", ~or_false(F.col("schema_version").isin(1, 2)), F.col("schema_version")))
    rules.append(("category", ~F.col("category").isin(*REQUIRED), F.col("category")))
    found = violations(records, KEY, rules, "record_id")
    if snapshots is None:
        return found
    other = records.join(snapshots.select(*KEY, F.col("snapshot_id").alias("_s")), KEY).where(~F.col("snapshot_id").eqNullSafe(F.col("_s")))
    return union(found, as_violation(other, KEY, "snapshot", "record_id", F.col("snapshot_id")))


def duplicate_ids(sources: DataFrame, atoms: DataFrame, records: DataFrame) -> DataFrame:
    """lg2: source and atom ids, record ids across categories, and canonical finding ids that are used again."""
    named = records.where(F.col("category") == "finding") if "category" in records.columns else records
    parts = [repeated(sources, KEY, "source_id", "source_repeated"), repeated(atoms, KEY, "atom_id", "atom_repeated"), repeated(records, KEY, "record_id", "record_repeated")]
    return union(*parts, *([repeated(named, KEY, "finding_id", "finding_repeated")] if "finding_id" in records.columns else []))


def dangling_refs(sources: DataFrame, atoms: DataFrame, records: DataFrame, rows: DataFrame) -> DataFrame:
    """lg3: references to sources, atoms, records and findings that aren't there."""
    s, a, r = _ids(sources, "source_id", "ref"), _ids(atoms, "atom_id", "ref"), _ids(records, "record_id", "ref")
    findings = _ids(records.where(F.col("category") == "finding"), "record_id", "ref")
    gone = lambda refs, known, rule, who: as_violation(refs.where(F.col("ref").isNotNull()).join(known, [*KEY, "ref"], "left_anti"), KEY, rule, who, F.col("ref"))
    parts = [
        gone(_each(atoms, ["atom_id"], "source_refs", "ref"), s, "atom_to_source", "atom_id"), gone(_each(records, ["record_id"], "atom_refs", "ref"), a, "record_to_atom", "record_id"), gone(_each(records, ["record_id"], "source_refs", "ref"), s, "record_to_source", "record_id"),
        gone(rows.select(*KEY, "atom_id", F.col("atom_id").alias("ref")), a, "row_to_atom", "atom_id"), gone(rows.select(*KEY, "atom_id", F.col("record_id").alias("ref")), r, "row_to_record", "atom_id"),
    ]
    if "finding_record_id" in records.columns:
        parts.append(gone(records.where(F.col("category") == "counter_evidence").select(*KEY, "record_id", F.col("finding_record_id").alias("ref")), findings, "counter_to_finding", "record_id"))
    return union(*parts)


def expected_outcome(co: Column, values: Column, rule: Column) -> Column:
    """lg4: what an atom's basis leads to; null where it contradicts itself."""
    by_rule = F.when(rule == "unknown", "question").when(rule == "binding_violated", "finding").when(rule == "not_violated", "drift").when(rule == "intentional_variant", "nonissue")
    proven = F.when(values == "unknown", F.lit("question")).when((values == "different") & (rule == "not_applicable"), F.lit("finding")).when(values == "equal", by_rule)
    return F.when(co == "unknown", F.lit("question")).when(co == "not_coreferential", F.lit("nonissue")).when(co == "proven", proven)


def with_outcome(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("expected", expected_outcome(F.col("basis.co_reference"), F.col("basis.semantic_values"), F.col("basis.presentation_rule")))


def uncovered_sources(sources: DataFrame, atoms: DataFrame) -> DataFrame:
    """lg5: run_id, source_id of sources that no atom came from."""
    return sources.select(*KEY, "source_id").join(_each(atoms, [], "source_refs", "source_id"), [*KEY, "source_id"], "left_anti")


def anchor_conservation(sources: DataFrame, atoms: DataFrame) -> DataFrame:
    """lg6: anchors of an atom that none of its sources has, and anchors of a source that none of its atoms has."""
    refs = _each(atoms, ["atom_id"], "source_refs", "source_id")
    atom_a, source_a = _each(atoms, ["atom_id"], "anchors", "anchor"), _each(sources, ["source_id"], "anchors", "anchor")
    given = refs.join(source_a, [*KEY, "source_id"]).select(*KEY, "atom_id", "anchor").distinct()
    kept = refs.join(atom_a, [*KEY, "atom_id"]).select(*KEY, "source_id", "anchor").distinct()
    used = source_a.join(refs.select(*KEY, "source_id").distinct(), [*KEY, "source_id"], "left_semi")
    return union(as_violation(atom_a.join(given, [*KEY, "atom_id", "anchor"], "left_anti"), KEY, "anchor_not_in_sources", "atom_id", F.col("anchor")), as_violation(used.join(kept, [*KEY, "source_id", "anchor"], "left_anti"), KEY, "anchor_lost", "source_id", F.col("anchor")))


def evidence_cites_anchor(atoms: DataFrame) -> DataFrame:
    """lg7: atoms that lead to drift or to nothing and whose evidence names none of their anchors."""
    bad = with_outcome(atoms).where(F.col("expected").isin("drift", "nonissue") & ~or_false(F.exists("anchors", lambda a: F.contains(F.col("basis.evidence"), a))))
    return as_violation(bad, KEY, "evidence_without_anchor", "atom_id", F.col("expected"))


def terminal_exactly_once(atoms: DataFrame, rows: DataFrame) -> DataFrame:
    """lg8: run_id, atom_id, n of atoms with no terminal row or several."""
    n = rows.groupBy(*KEY, "atom_id").agg(F.count("*").alias("n"))
    return atoms.select(*KEY, "atom_id").distinct().join(n, [*KEY, "atom_id"], "left").na.fill(0, ["n"]).where("n <> 1")


def outcome_consistency(atoms: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """lg9: rows whose outcome isn't the expected one (suppressed stands for an expected finding), or isn't their record's category."""
    both = rows.join(with_outcome(atoms).select(*KEY, "atom_id", "expected"), [*KEY, "atom_id"])
    wanted = F.when(F.col("outcome") == "suppressed", "finding").otherwise(F.col("outcome"))
    wrong = as_violation(both.where(~wanted.eqNullSafe(F.col("expected"))), KEY, "outcome_unexpected", "atom_id", F.concat_ws(">", F.coalesce("expected", F.lit("inconsistent")), "outcome"))
    category = rows.join(records.select(*KEY, "record_id", "category"), [*KEY, "record_id"]).where("category <> outcome")
    return union(wrong, as_violation(category, KEY, "category_differs", "atom_id", F.col("record_id")))


def _same(a: DataFrame, b: DataFrame, on: list[str], rule: str, who: str, what: str) -> DataFrame:
    """Pairs of either side that the other lacks."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), on, "full")
    return as_violation(both.where("_a is null or _b is null"), KEY, rule, who, F.concat(F.when(F.col("_a").isNull(), "lacks ").otherwise("only here "), what))


def set_equality(atoms: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """lg10: a record's atoms are those of the rows that lead to it; its sources and anchors the unions of those atoms'; a row's anchors its atom's, within its record's."""
    targets = rows.where(F.col("record_id").isNotNull()).select(*KEY, "record_id", "atom_id").distinct()
    public = records.where(F.col("category") != "counter_evidence")
    own_atoms = _each(public, ["record_id"], "atom_refs", "atom_id")
    via = lambda array, name: own_atoms.join(_each(atoms, ["atom_id"], array, name), [*KEY, "atom_id"]).select(*KEY, "record_id", name)
    mine = lambda array, name: _each(public, ["record_id"], array, name)
    row_a, atom_a = _each(rows, ["atom_id"], "anchors", "anchor"), _each(atoms, ["atom_id"], "anchors", "anchor").join(rows.select(*KEY, "atom_id").distinct(), [*KEY, "atom_id"], "left_semi")
    outside = _each(rows, ["atom_id", "record_id"], "anchors", "anchor").join(mine("anchors", "anchor"), [*KEY, "record_id", "anchor"], "left_anti").join(_ids(public, "record_id", "record_id"), [*KEY, "record_id"], "left_semi")
    return union(
        _same(own_atoms, targets.join(_ids(public, "record_id", "record_id"), [*KEY, "record_id"], "left_semi"), [*KEY, "record_id", "atom_id"], "record_atoms", "record_id", "atom_id"),
        _same(mine("source_refs", "source"), via("source_refs", "source").join(public.where(F.col("source_refs").isNotNull()).select(*KEY, "record_id"), [*KEY, "record_id"], "left_semi"), [*KEY, "record_id", "source"], "record_sources", "record_id", "source"),
        _same(mine("anchors", "anchor"), via("anchors", "anchor"), [*KEY, "record_id", "anchor"], "record_anchors", "record_id", "anchor"),
        _same(row_a, atom_a, [*KEY, "atom_id", "anchor"], "row_anchors", "atom_id", "anchor"), as_violation(outside, KEY, "row_anchor_not_in_record", "atom_id", F.col("anchor")),
    )


def question_lineage(atoms: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """lg11: questions and the atoms derived from them name each other; resolved questions have some, each ending in finding, drift or nonissue; open ones have none."""
    q = records.where(F.col("category") == "question")
    down, up = _each(q, ["record_id"], "derived_refs", "atom_id"), _each(atoms, ["atom_id"], "derived_from", "record_id")
    ends = rows.where(F.col("outcome").isin("finding", "drift", "nonissue")).select(*KEY, "atom_id").distinct()
    n = F.coalesce(F.size("derived_refs"), F.lit(0))
    pairs = [*KEY, "record_id", "atom_id"]
    return union(
        as_violation(down.join(up, pairs, "left_anti"), KEY, "atom_lacks_question", "record_id", F.col("atom_id")), as_violation(up.join(down, pairs, "left_anti"), KEY, "question_lacks_atom", "record_id", F.col("atom_id")),
        violations(q, KEY, [("resolved_without_atoms", (F.col("status") == "resolved") & (n <= 0), None), ("open_with_atoms", (F.col("status") != "resolved") & (n > 0), None)], "record_id"),
        as_violation(down.join(q.where("status = 'resolved'").select(*KEY, "record_id"), [*KEY, "record_id"], "left_semi").join(ends, [*KEY, "atom_id"], "left_anti"), KEY, "derived_not_ended", "record_id", F.col("atom_id")),
    )


def counter_evidence_matrix(records: DataFrame, sources: DataFrame) -> DataFrame:
    """lg12: a finding's verdict on counter citations against its counter records, its narrowing, their anchors and its status."""
    c = records.where(F.col("category") == "counter_evidence")
    found = records.where(F.col("category") == "finding")
    by = c.groupBy(*KEY, F.col("finding_record_id").alias("record_id")).agg(F.count("*").alias("n"), F.collect_set("resolution").alias("kinds"), F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("cited"))
    f = found.join(by, [*KEY, "record_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    narrowed = F.col("narrowing").isNotNull()
    only = lambda k: or_false((F.size("kinds") == 1) & F.array_contains("kinds", k))
    v = lambda k: F.col("verdict") == k
    differ = (F.size(F.array_except("narrowing.anchors", "cited")) > 0) | (F.size(F.array_except("cited", "narrowing.anchors")) > 0)
    own = violations(f, KEY, [
        ("verdict_invalid", F.col("verdict").isNull() | ~F.col("verdict").isin("none", "partial", "full"), F.col("verdict")), ("none_with_counter", v("none") & (F.col("n") > 0), None), ("none_with_narrowing", v("none") & narrowed, None),
        ("partial_without_counter", v("partial") & ~only("partial"), None), ("partial_without_narrowing", v("partial") & ~narrowed, None), ("partial_anchors_differ", v("partial") & narrowed & (F.col("n") > 0) & differ, None),
        ("full_without_counter", v("full") & ~only("full"), None), ("full_with_narrowing", v("full") & narrowed, None), ("full_but_verified", v("full") & (F.col("status") == "verified"), None),
        ("narrowing_blank", narrowed & (blank(F.col("narrowing.original_claim")) | blank(F.col("narrowing.withdrawn_scope")) | blank(F.col("narrowing.residual_claim"))), None),
        ("narrowing_anchor_lost", narrowed & or_false(F.size(F.array_except("narrowing.anchors", "anchors")) > 0), None),
    ], "record_id")
    known = _each(sources, [], "anchors", "anchor").distinct()
    strange = _each(c, ["record_id"], "anchors", "anchor").join(known, [*KEY, "anchor"], "left_anti")
    return union(own, as_violation(strange, KEY, "counter_anchor_unknown", "record_id", F.col("anchor")))


def drift_variants(records: DataFrame) -> DataFrame:
    """lg13: drifts with fewer than two variants, a notation twice, anchors outside the record's, or a finding's fields."""
    d = records.where(F.col("category") == "drift")
    notations = F.transform("variants", lambda x: F.btrim(x["notation"]))
    strange = F.array_except(F.flatten(F.transform("variants", lambda x: x["anchors"])), F.col("anchors"))
    rules = [("few_variants", F.coalesce(F.size("variants"), F.lit(0)) < 2, None), ("notation_repeated", or_false(F.size(notations) != F.size(F.array_distinct(notations))), None), ("variant_anchor_outside", or_false(F.size(strange) > 0), F.array_join(F.array_sort(strange), ","))]
    rules += [(f"drift_has_{f}", F.col(f).isNotNull(), None) for f in ("severity", "status", "blocking") if f in records.columns]
    return violations(d, KEY, rules, "record_id")


def record_digest(records: DataFrame) -> DataFrame:
    """lg14: run_id, record_id, category, computed, matches: sha256 over each category's fields as JSON in the order of their names; nulls are absent fields."""
    out = F.lit(None).cast("string")
    for category, fields in DIGESTED.items():
        cols = sorted([*(f for f in fields if f in records.columns), "category"])
        out = F.when(F.col("category") == category, F.to_json(F.struct(*cols))).otherwise(out)
    return records.withColumn("computed", F.concat(F.lit("sha256:"), F.sha2(out, 256))).select(*KEY, "record_id", "category", "computed", *([or_false(F.col("digest") == F.col("computed")).alias("matches")] if "digest" in records.columns else []))


def approval_violations(registries: DataFrame, approvals: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """lg15: what keeps a registry of approvals (registry_id, target, updated_at) from being an authority: blank or ill-formed fields, no approval,
    repeated ids, paths that leave the packet, models that are gone or have changed since.

    approvals: registry_id, the fields of APPROVAL, and template; fingerprints: path, sha256.  A template may be null, not blank."""
    key, safe = ["registry_id"], ~F.col("docmodel_path").rlike(r"^/|(^|/)\.\.(/|\z)")
    head = violations(registries, key, [*((f"blank:{c}", blank(F.col(c)), None) for c in ("target", "updated_at")), ("format:updated_at", ~blank(F.col("updated_at")) & ~F.col("updated_at").rlike(DATE), F.col("updated_at"))], "target")
    none = as_violation(registries.join(approvals.select(*key).distinct(), key, "left_anti"), key, "no_approval", "target")
    both = approvals.join(fingerprints.select(F.col("path").alias("docmodel_path"), F.col("sha256").alias("_now")), "docmodel_path", "left")
    bound = ~blank(F.col("docmodel_path")) & F.col("docmodel_sha256").rlike(SHA)
    own = violations(both, key, [
        *((f"blank:{c}", blank(F.col(c)), None) for c in APPROVAL), ("blank:template", F.col("template").isNotNull() & blank(F.col("template")), None),
        ("enum:status", ~blank(F.col("status")) & ~F.col("status").isin(*APPROVAL_STATUS), F.col("status")), ("format:docmodel_sha256", ~blank(F.col("docmodel_sha256")) & ~F.col("docmodel_sha256").rlike(SHA), None),
        ("format:approved_at", ~blank(F.col("approved_at")) & ~F.col("approved_at").rlike(DATE), F.col("approved_at")), ("unsafe_path", bound & ~safe, F.col("docmodel_path")),
        ("missing_model", bound & safe & F.col("_now").isNull(), F.col("docmodel_path")), ("stale_model", bound & safe & (F.col("_now") != F.col("docmodel_sha256")), F.col("docmodel_path")),
    ], "id")
    return union(head, none, own, repeated(approvals.where(~blank(F.col("id"))), key, "id", "repeated_id"))


def current_approvals(approvals: DataFrame, found: DataFrame) -> DataFrame:
    """lg15: registry_id, id, state of the approvals in registries without a violation; a draft is none, whatever its status says."""
    draft = F.lower(F.regexp_extract("docmodel_path", r"[^/]*\z", 0)).contains(".draft.")
    return approvals.join(found.select("registry_id").distinct(), "registry_id", "left_anti").select("registry_id", "id", F.when(draft, "draft").otherwise(F.col("status")).alias("state"))


def authority_eligibility(refs: DataFrame, fingerprints: DataFrame, eligible: DataFrame, approvals: DataFrame) -> DataFrame:
    """lg15: run_id, record_id, state of each suppression's authority (path, sha256, kind, entry_id): unbound, missing, stale, ineligible or ok.

    A decision must be among the eligible (id); an approval current and no draft (approvals: id, state)."""
    both = refs.join(fingerprints.select("path", F.col("sha256").alias("_now")), "path", "left")
    both = both.join(eligible.select(F.col("id").alias("entry_id")).distinct().withColumn("_d", F.lit(True)), "entry_id", "left")
    both = both.join(approvals.where("state = 'approved'").select(F.col("id").alias("entry_id")).distinct().withColumn("_p", F.lit(True)), "entry_id", "left")
    good = F.when(F.col("kind") == "decision", F.col("_d")).when(F.col("kind") == "approval", F.col("_p"))
    state = F.when(F.col("path").isNull() | F.col("sha256").isNull(), "unbound").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "stale").when(or_false(good), "ok").otherwise("ineligible")
    return both.select(*KEY, "record_id", state.alias("state"))


def ledger_summary(rows: DataFrame, found: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """lg16: per run rows by outcome, n_violations, passes.  runs (run_id, state, n_open): a closed ledger with open questions fails."""
    n = rows.groupBy(*KEY).agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES))
    bad = found.groupBy(*KEY).agg(F.count("*").alias("n_violations"))
    every = n.join(bad, KEY, "full").na.fill(0)
    ok = F.col("n_violations") == 0
    if runs is not None:
        every = every.join(runs, KEY, "left")
        ok &= ~or_false((F.col("state") == "closed") & (F.col("n_open") > 0))
    return every.withColumn("passes", ok).drop("state", "n_open")
