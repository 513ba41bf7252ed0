"""Receipts of review runs against ledgers, packets and traces.

receipts: run_id, schema_version, snapshot_id, target, deferred, structure_axis, structure_reason, … (each operator names what it reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_violation, repeated, union, violations
from ..functions.text import blank
from .graph import or_false

KEY = ["run_id"]
#: What a receipt binds, what the gate's trace event repeats, and the gate's enumerations.
BOUND = ("ledger_path", "ledger_sha256", "packet_digest", "profile_id", "intake_sha256", "snapshot_id", "target")
TRACED = ("editing_state", "target_maturity", "source_copy_sha256", "prior_exists", "prior_round_no", "prior_path", "prior_sha256", "open_items_ref", "verification_deferred")
EDITING, MATURITY, UNSETTLED = ("frozen", "editing", "unknown"), ("final", "draft", "unknown"), ("draft", "unknown")


def receipt_vs_ledger(receipt_records: DataFrame, ledger_records: DataFrame) -> DataFrame:
    """rc1: run_id, record_id, state of records that differ: omitted, extra, category or digest.  Both: run_id, record_id, category, digest."""
    side = lambda d, n: d.select(*KEY, "record_id", F.struct("category", "digest").alias(n))
    both = side(receipt_records, "r").join(side(ledger_records, "l"), [*KEY, "record_id"], "full")
    state = F.when(F.col("r").isNull(), "omitted").when(F.col("l").isNull(), "extra").when(~F.col("r.category").eqNullSafe(F.col("l.category")), "category").when(~F.col("r.digest").eqNullSafe(F.col("l.digest")), "digest")
    return both.select(*KEY, "record_id", state.alias("state")).where("state is not null")


def terminal_status(receipt_records: DataFrame, deferred_runs: DataFrame) -> DataFrame:
    """rc2: in runs that aren't deferred, findings neither verified nor rejected, and questions not resolved by pass or kill."""
    rows = receipt_records.join(deferred_runs.select(*KEY).distinct(), KEY, "left_anti")
    return violations(rows, KEY, [
        ("finding_not_terminal", (F.col("category") == "finding") & ~or_false(F.col("status").isin("verified", "rejected")), F.col("status")), ("question_not_resolved", (F.col("category") == "question") & ~or_false(F.col("status") == "resolved"), F.col("status")),
        ("question_not_judged", (F.col("category") == "question") & ~or_false(F.col("verification_result").isin("pass", "kill")), F.col("verification_result")),
    ], "record_id")


def verifier_quorum(receipts: DataFrame, deferred_runs: DataFrame, size: int = 3) -> DataFrame:
    """rc3: runs (run_id, snapshot_id, verifiers: array of verifier_id, result, snapshot_id, evidence) without exactly ``size`` distinct passing verifiers of
    the current snapshot with evidence; a deferred run has none."""
    rows = receipts.join(deferred_runs.select(*KEY).distinct().withColumn("_d", F.lit(True)), KEY, "left").withColumn("_d", or_false(F.col("_d")))
    n = F.coalesce(F.size("verifiers"), F.lit(0))
    own, ids = ~F.col("_d"), F.transform("verifiers", lambda v: v["verifier_id"])
    some = lambda test: or_false(F.exists("verifiers", test))
    return violations(rows, KEY, [
        ("deferred_with_verifiers", F.col("_d") & (n > 0), n), ("wrong_number", own & (n != size), n), ("verifier_repeated", own & or_false(F.size(F.array_distinct(ids)) != F.size(ids)), None), ("id_blank", own & some(lambda v: blank(v["verifier_id"])), None),
        ("not_passed", own & some(lambda v: ~v["result"].eqNullSafe("pass")), None), ("other_snapshot", own & some(lambda v: ~v["snapshot_id"].eqNullSafe(F.col("snapshot_id"))), None), ("evidence_blank", own & some(lambda v: blank(v["evidence"])), None),
    ], "run_id")


def binding_mismatch(receipts: DataFrame, ledgers: DataFrame, packets: DataFrame, fields: tuple[str, ...] = BOUND) -> DataFrame:
    """rc4: run_id, field, other (ledger or packet), where a receipt's field isn't that of its ledger or packet; fields that the other lacks are passed over."""
    found = []
    for name, other in (("ledger", ledgers), ("packet", packets)):
        shared = [f for f in fields if f in receipts.columns and f in other.columns]
        both = receipts.select(*KEY, F.struct(*shared).alias("a")).join(other.select(*KEY, F.struct(*shared).alias("b")), KEY, "left")
        differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in shared)))
        found.append(both.select(*KEY, F.explode(differ).alias("field"), F.lit(name).alias("other")))
    return union(*found)


def trace_binding(receipts: DataFrame, trace: DataFrame, fields: tuple[str, ...] = TRACED) -> DataFrame:
    """rc5: run_id, problem, field: there is exactly one input_gate event, and what it recorded is what the receipt declares.  trace: run_id, event and the fields."""
    gates = trace.where(F.col("event") == "input_gate")
    own = [f for f in fields if f in receipts.columns and f in trace.columns]
    n = gates.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.first(f).alias(f"_{f}") for f in own))
    both = receipts.join(n, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    differ = F.when(F.col("n") == 1, F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in own)))).otherwise(F.array().cast("array<string>"))
    wrong = both.where("n <> 1").select(*KEY, F.when(F.col("n") == 0, "no_gate_event").otherwise("several_gate_events").alias("problem"), F.lit(None).cast("string").alias("field"))
    return wrong.unionByName(both.select(*KEY, F.lit("rewritten").alias("problem"), F.explode(differ).alias("field")))


def open_item_misuse(receipts: DataFrame, ledger_records: DataFrame) -> DataFrame:
    """rc6: suppressions that cite the open-item ledger (same path or hash), and classified ids that are no live finding or a rejected one.

    receipts: run_id, open_items_path, open_items_sha256, classified_ids, findings (array of record_id, status)."""
    cited = ledger_records.where(F.col("category") == "suppressed").join(receipts.select(*KEY, "open_items_path", "open_items_sha256"), KEY)
    same = or_false(F.col("authority_path") == F.col("open_items_path")) | or_false(F.col("authority_sha256") == F.col("open_items_sha256"))
    bad = as_violation(cited.where(F.col("open_items_path").isNotNull() & same), KEY, "open_items_suppress", "record_id", F.col("authority_path"))
    live = receipts.select(*KEY, F.explode("findings").alias("f")).select(*KEY, F.col("f.record_id").alias("record_id"), F.col("f.status").alias("status"))
    ids = receipts.select(*KEY, F.explode("classified_ids").alias("record_id")).join(live, [*KEY, "record_id"], "left")
    gone = receipts.select(*KEY, F.explode("classified_ids").alias("record_id")).join(live, [*KEY, "record_id"], "left_anti")
    return union(bad, as_violation(gone, KEY, "classified_not_live", "record_id"), as_violation(ids.where("status = 'rejected'"), KEY, "classified_rejected", "record_id"))


def scale_totals(receipts: DataFrame) -> DataFrame:
    """rc7: declared totals against the sums of their items (array of name, count); upper bound at least the derived total; rounds planned and run, with their reason
    and, of more than one, the runs' ids.  Lists are not empty, their names neither blank nor repeated, their counts 0 or more; only such lists are summed.

    receipts: run_id, snapshot_id, volume_snapshot_id, volume_lines, configuration, derived_total, upper_configuration, upper_bound, planned_rounds, executed_rounds, run_ids (array), rounds_reason."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["count"], F.lit(0)))
    names = lambda c: F.transform(c, lambda x: x["name"])
    lists, given = ("configuration", "upper_configuration"), F.col("upper_configuration").isNotNull()
    empty = {c: F.coalesce(F.size(c) == 0, F.lit(c == "configuration")) for c in lists}
    unnamed = {c: or_false(F.exists(c, lambda x: blank(x["name"]))) for c in lists}
    twice = {c: or_false(F.size(names(c)) != F.size(F.array_distinct(names(c)))) for c in lists}
    negative = {c: or_false(F.exists(c, lambda x: x["count"].isNull() | (x["count"] < 0))) for c in lists}
    sound = {c: ~(empty[c] | unnamed[c] | twice[c] | negative[c]) for c in lists}
    several = or_false(F.col("executed_rounds") > 1)
    return violations(receipts, KEY, [
        ("total_differs", sound["configuration"] & (total("configuration") != F.col("derived_total")), F.col("derived_total")), ("upper_differs", given & sound["upper_configuration"] & (total("upper_configuration") != F.col("upper_bound")), F.col("upper_bound")),
        ("upper_below_total", F.col("upper_bound") < F.col("derived_total"), F.col("upper_bound")), ("rounds_differ", ~F.col("planned_rounds").eqNullSafe(F.col("executed_rounds")), F.col("executed_rounds")),
        *((f"{rule}:{c}", of[c], None) for rule, of in (("list_empty", empty), ("name_blank", unnamed), ("name_repeated", twice), ("negative_count", negative)) for c in lists),
        ("rounds_not_positive", ~or_false(F.col("executed_rounds") >= 1), F.col("executed_rounds")), ("rounds_without_runs", several & ~or_false(F.size("run_ids") > 0), F.col("executed_rounds")), ("rounds_without_reason", blank(F.col("rounds_reason")), None),
        ("volume_snapshot", ~F.col("volume_snapshot_id").eqNullSafe(F.col("snapshot_id")), None), ("volume_lines", ~or_false(F.col("volume_lines") >= 1), F.col("volume_lines")),
    ], "run_id")


def round_context_violations(receipts: DataFrame) -> DataFrame:
    """rc8: round label against the prior round, the comparison that a prior round asks for, revisions seen during the run, and the structure axis.

    receipts: run_id, round_label, prior_exists, prior_round_no, comparison_ref, observed_snapshots, lost_ids, record_ids, structure_axis, structure_reason, profile_not_applicable."""
    label = F.col("round_label")
    good = or_false(label.rlike(r"^r[1-9]\d*\z"))
    lost = F.size(F.array_except("lost_ids", F.coalesce("record_ids", F.array().cast("array<string>"))))
    axis = F.col("structure_axis")
    return violations(receipts, KEY, [
        ("label_format", ~good, label), ("label_not_next", good & F.col("prior_exists") & F.col("prior_round_no").isNotNull() & (label != F.concat(F.lit("r"), (F.col("prior_round_no") + 1).cast("string"))), label), ("label_not_first", good & ~F.col("prior_exists") & (label != "r1"), label),
        ("comparison_missing", F.col("prior_exists") & F.col("comparison_ref").isNull(), None), ("comparison_unasked", ~F.col("prior_exists") & F.col("comparison_ref").isNotNull(), None),
        ("few_snapshots", F.col("observed_snapshots").isNotNull() & (F.size("observed_snapshots") < 2), None), ("lost_id_unknown", F.col("lost_ids").isNotNull() & (lost > 0), None),
        ("axis_invalid", ~or_false(axis.isin("judged", "undetermined")), axis), ("axis_without_reason", (axis == "undetermined") & blank(F.col("structure_reason")), None), ("axis_reason_unasked", (axis == "judged") & F.col("structure_reason").isNotNull(), None),
        ("axis_not_undetermined", F.col("profile_not_applicable") & ~axis.eqNullSafe("undetermined"), axis),
    ], "run_id")


def input_gate_violations(receipts: DataFrame, inventory: DataFrame) -> DataFrame:
    """rc9: editing state and maturity, open items where the target is unsettled, the archived copy's hash and presence, the prior round's shape.

    receipts: run_id, snapshot_id, editing_state, target_maturity, open_items_ref, source_copy_path, source_copy_sha256, prior_exists, prior_path, prior_round_no; inventory: run_id, path, sha256."""
    files = inventory.select(*KEY, F.col("path").alias("source_copy_path"), F.col("sha256").alias("_now"))
    both = receipts.join(files, [*KEY, "source_copy_path"], "left")
    named = F.regexp_extract("snapshot_id", r"^sha256:([0-9a-f]{64})\n?\z", 1)
    return violations(both, KEY, [
        ("editing_state", ~or_false(F.col("editing_state").isin(*EDITING)), F.col("editing_state")), ("maturity", ~or_false(F.col("target_maturity").isin(*MATURITY)), F.col("target_maturity")), ("open_items_missing", F.col("target_maturity").isin(*UNSETTLED) & F.col("open_items_ref").isNull(), None),
        ("copy_hash_format", ~or_false(F.col("source_copy_sha256").rlike(r"^[0-9a-f]{64}\z")), None), ("copy_not_snapshot", (named != "") & (F.col("source_copy_sha256") != named), None), ("copy_missing", F.col("_now").isNull(), F.col("source_copy_path")), ("copy_changed", F.col("_now") != F.col("source_copy_sha256"), F.col("source_copy_path")),
        ("prior_incomplete", F.col("prior_exists") & (F.col("prior_path").isNull() | F.col("prior_round_no").isNull()), None), ("prior_unasked", ~F.col("prior_exists") & F.col("prior_path").isNotNull(), None), ("prior_unknown", F.col("prior_exists").isNull(), None),
    ], "run_id")


def receipt_verdict(receipts: DataFrame, found: DataFrame) -> DataFrame:
    """rc10: run_id, verdict: legacy (version 1 is never done), failed, deferred while the target isn't frozen, or done."""
    n = found.groupBy(*KEY).agg(F.count("*").alias("n"))
    verdict = F.when(F.col("schema_version") == 1, "legacy").when(F.coalesce("n", F.lit(0)) > 0, "failed").when(~F.col("editing_state").eqNullSafe("frozen"), "deferred").otherwise("done")
    return receipts.join(n, KEY, "left").select(*KEY, verdict.alias("verdict"))
