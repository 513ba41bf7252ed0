"""Decision registries: fields, supersede edges, cycles, slots, and what may serve as authority.

Decisions: registry_id, id, decision, status, date, evidence, subject, supersedes, superseded_by, source_ref, source_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import as_violation, broken, repeated, union, violations
from ..functions.text import blank, slot_key
from .graph import HELD, kept, new_folder, on_cycles, with_cycles

#: The statuses, and the one that suppresses findings.
STATUS, CONFIRMED, SUPPRESSING = ("confirmed", "rejected", "do_not_reopen"), "confirmed", "do_not_reopen"
DATE, SHA = r"^\d{4}-\d{2}-\d{2}\z", r"^[0-9a-f]{64}\z"
KEY = ["registry_id"]


def _field_rules() -> list[tuple]:
    return [
        *((f"{c}_missing", blank(F.col(c)), None) for c in ("id", "decision", "status", "date", "evidence")),
        *((f"{c}_blank", F.col(c).isNotNull() & blank(F.col(c)), None) for c in ("subject", "supersedes", "superseded_by", "source_ref", "source_hash")),
        ("status_unknown", ~blank(F.col("status")) & ~F.col("status").isin(*STATUS), F.col("status")), ("date_format", ~blank(F.col("date")) & ~F.col("date").rlike(DATE), F.col("date")),
        ("hash_format", ~blank(F.col("source_hash")) & ~F.col("source_hash").rlike(SHA), None), ("hash_missing", ~blank(F.col("source_ref")) & blank(F.col("source_hash")), None),
    ]


def decision_violations(decisions: DataFrame) -> DataFrame:
    """dr1: required and optional fields, enumerations, formats, the hash of a reference, repeated ids."""
    return union(violations(decisions, KEY, _field_rules(), "id"), repeated(decisions, KEY, "id", "id_repeated"))


def _references(decisions: DataFrame) -> DataFrame:
    said = decisions.select(*KEY, "id", F.explode(F.array(F.struct(F.lit("supersedes").alias("field"), F.col("supersedes").alias("ref")), F.struct(F.lit("superseded_by").alias("field"), F.col("superseded_by").alias("ref")))).alias("_ref"))
    return said.select(*KEY, "id", "_ref.field", "_ref.ref").where(F.col("ref").isNotNull() & F.col("id").isNotNull())


def supersede_edges(decisions: DataFrame) -> DataFrame:
    """dr2: registry_id, old, new, each once; references to oneself or to nothing make no edge."""
    known = decisions.select(*KEY, F.col("id").alias("ref")).distinct()
    good = _references(decisions).where(F.col("id") != F.col("ref")).join(known, [*KEY, "ref"], "left_semi")
    forward = F.col("field") == "supersedes"
    return good.select(*KEY, F.when(forward, F.col("ref")).otherwise(F.col("id")).alias("old"), F.when(forward, F.col("id")).otherwise(F.col("ref")).alias("new")).distinct()


def reference_violations(decisions: DataFrame) -> DataFrame:
    """dr2: references to oneself and dangling ones."""
    refs = _references(decisions)
    known = decisions.select(*KEY, F.col("id").alias("ref")).distinct()
    own = as_violation(refs.where(F.col("id") == F.col("ref")), KEY, "self_reference", "id", F.col("field"))
    return union(own, as_violation(refs.where(F.col("id") != F.col("ref")).join(known, [*KEY, "ref"], "left_anti"), KEY, "dangling_reference", "id", F.col("ref")))


def supersede_cycles(edges: DataFrame) -> DataFrame:
    """dr3: registry_id, id of decisions on a cycle; any makes its registry unusable."""
    return on_cycles(edges, KEY, "old", "new").withColumnRenamed("node", "id")


def _ends(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges with status, slot and date of both ends; of a repeated id one row speaks."""
    one = decisions.groupBy(*KEY, "id").agg(F.min(F.struct("status", F.when(~blank(F.col("subject")), F.col("subject")).alias("subject"), "date")).alias("d"))
    one = one.select(*KEY, "id", F.struct("d.status", slot_key(F.col("d.subject")).alias("slot"), "d.date").alias("d"))
    side = lambda c: one.select(*KEY, F.col("id").alias(c), F.col("d").alias(f"{c}_d"))
    return edges.join(side("old"), [*KEY, "old"]).join(side("new"), [*KEY, "new"])


def _judgement() -> list[Column]:
    """reason and date_inverted of an edge with both ends."""
    reason = F.when(~F.col("new_d.status").eqNullSafe(CONFIRMED), "unconfirmed").when(F.col("old_d.slot").isNull(), None).when(F.col("new_d.slot").isNull(), "unverifiable_slot").when(F.col("new_d.slot") != F.col("old_d.slot"), "slot_mismatch")
    dated = F.col("old_d.date").rlike(DATE) & F.col("new_d.date").rlike(DATE) & (F.col("new_d.date") < F.col("old_d.date"))
    return [reason.alias("reason"), F.coalesce(dated, F.lit(False)).alias("date_inverted")]


def judged_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """dr4: registry_id, old, new, reason (null: honoured), date_inverted."""
    return _ends(edges, decisions).select(*KEY, "old", "new", *_judgement())


def honored_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """dr4: the edges that retire their old decision."""
    return judged_edges(edges, decisions).where("reason is null").select(*KEY, "old", "new")


def _current(decisions: DataFrame, honored: DataFrame) -> DataFrame:
    return decisions.where(F.col("status") == CONFIRMED).join(honored.select(*KEY, F.col("old").alias("id")).distinct(), [*KEY, "id"], "left_anti")


def slot_conflicts(decisions: DataFrame, honored: DataFrame) -> DataFrame:
    """dr5: registry_id, slot, n, ids: slots with more than one current confirmed decision."""
    own = _current(decisions, honored).where(~blank(F.col("subject"))).withColumn("slot", slot_key(F.col("subject")))
    return own.groupBy(*KEY, "slot").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids")).where("n > 1")


def unlabeled_decisions(decisions: DataFrame, honored: DataFrame) -> DataFrame:
    """dr6: registry_id, n, severity where more than one current confirmed decision has no slot: an error if the registry suppresses."""
    bare = _current(decisions, honored).where(blank(F.col("subject"))).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    does = decisions.where(F.col("status") == SUPPRESSING).select(*KEY).distinct().withColumn("_s", F.lit(True))
    return bare.join(does, KEY, "left").select(*KEY, "n", F.when(F.col("_s"), "error").otherwise("warning").alias("severity"))


def eligible_decisions(decisions: DataFrame, honored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """dr7: registry_id, id, status of what may serve as authority: registry passes, confirmed or not to be reopened, not superseded by its own word or an honoured edge."""
    good = decisions.where(F.col("status").isin(CONFIRMED, SUPPRESSING) & blank(F.col("superseded_by"))).join(verdicts.where("verdict = 'pass'").select(*KEY), KEY, "left_semi")
    return good.join(honored.select(*KEY, F.col("old").alias("id")).distinct(), [*KEY, "id"], "left_anti").select(*KEY, "id", "status")


def eligible_examined(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """dr7 of examined decisions, as ``eligible_decisions`` gives it: a decision's own row says whether an honoured edge retires it."""
    good = rows.where(F.col("field").isNull() & F.col("status").isin(CONFIRMED, SUPPRESSING) & blank(F.col("superseded_by")) & ~F.col("retired"))
    return good.join(verdicts.where("verdict = 'pass'").select(*KEY), KEY, "left_semi").select(*KEY, "id", "status")


def registry_verdict(decisions: DataFrame, found: DataFrame, hashes_checked: bool = True) -> DataFrame:
    """dr8: per registry n_errors, n_warnings, verdict: fail, structure_only where hashes weren't checked, or pass."""
    counts = found.groupBy(*KEY).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    every = decisions.select(*KEY).distinct().join(counts, KEY, "left").na.fill(0, ["n_errors", "n_warnings"])
    return every.withColumn("verdict", F.when(F.col("n_errors") > 0, "fail").otherwise("pass" if hashes_checked else "structure_only"))


def all_findings(decisions: DataFrame, edges: DataFrame, honored: DataFrame) -> DataFrame:
    """All that counts for a registry's verdict, as violations."""
    cycles = as_violation(with_cycles(edges, KEY, "old", "new"), KEY, "supersede_cycle", "registry_id")
    bare = unlabeled_decisions(decisions, honored)
    judged = judged_edges(edges, decisions)
    return union(
        decision_violations(decisions), reference_violations(decisions), cycles, as_violation(slot_conflicts(decisions, honored), KEY, "slot_conflict", "slot", F.col("n")),
        *(as_violation(bare.where(F.col("severity") == s), KEY, "unlabeled", "registry_id", F.col("n"), s) for s in ("error", "warning")),
        as_violation(judged.where("reason is not null"), KEY, "edge_not_honoured", "old", F.col("reason"), "warning"), as_violation(judged.where("date_inverted"), KEY, "date_inverted", "old", F.col("new"), "warning"),
    )


def _cards(decisions: DataFrame) -> DataFrame:
    """What of a decision takes part in judging others, and its own violations."""
    subject = F.when(~blank(F.col("subject")), F.col("subject"))
    return decisions.select(*KEY, "id", "status", "supersedes", "superseded_by", slot_key(subject).alias("slot"), subject.alias("_subject"), "date", broken(_field_rules(), "id").alias("_own"))


def _examined(own: DataFrame) -> DataFrame:
    """The rows of ``examined`` from cards.  Both ends of a reference meet by windows over a registry's ids: rows that come partitioned by registry move no more, others by id."""
    same = Window.partitionBy(*KEY, "id").orderBy("id")
    all_same = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.select(*KEY, "id", "supersedes", "superseded_by", "_own", F.struct("status", F.col("_subject").alias("subject"), "date", "slot").alias("_card"))
    own = own.select(*KEY, "id", "_card.status", "supersedes", "superseded_by", "_card.slot", "_own", F.min("_card").over(all_same).alias("_d"), F.count("*").over(all_same).alias("_rows"), F.row_number().over(same).alias("_n"))
    said = lambda c: F.when(F.col("id").isNotNull() & F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("ref")))
    itself = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("ref"))
    # the array is a column of its own, for explode works out the type of an expression anew in every row; it is never empty
    every = own.withColumn("_all", F.array_compact(F.array(itself, said("supersedes"), said("superseded_by")))).withColumn("_r", F.explode_outer("_all"))
    every = every.select(*KEY, "id", "status", "slot", "superseded_by", "_own", "_n", "_rows", "_d", "_r.field", "_r.ref").withColumn("_at", F.coalesce("ref", "id"))
    card = F.col("field").isNull()
    met = Window.partitionBy(*KEY, "_at").orderBy(F.col("field").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = every.withColumn("_to", F.when(F.first(card).over(met), F.first("_d").over(met)))
    itself, known = F.col("id") == F.col("ref"), F.col("_to").isNotNull() & F.col(KEY[0]).isNotNull()
    forward, edge = F.col("field") == "supersedes", ~card & ~itself & known
    side = lambda a, b: F.when(edge, F.when(forward, a).otherwise(b))
    every = every.select("*", edge.alias("_edge"), side(F.col("ref"), F.col("id")).alias("_old"), side(F.col("id"), F.col("ref")).alias("_new"), side(F.col("_to"), F.col("_d")).alias("old_d"), side(F.col("_d"), F.col("_to")).alias("new_d"))
    every = every.select("*", *_judgement()).withColumn("_at", F.when(card, F.col("id")).otherwise(F.col("_old")))
    near = Window.partitionBy(*KEY, "_at").orderBy("_new")
    every = every.select("*", F.lag("_new").over(near).eqNullSafe(F.col("_new")).alias("_again"), F.max(F.col("_edge") & F.col("reason").isNull()).over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("retired"))
    every = every.withColumn("_edge", F.col("_edge") & ~F.col("_again"))
    of_card = [("id_repeated", F.col("id").isNotNull() & (F.col("_n") == 1) & (F.col("_rows") > 1), F.col("_rows"))]
    of_ref = [("self_reference", itself, F.col("field")), ("dangling_reference", ~itself & ~known, F.col("ref"))]
    of_edge = [("edge_not_honoured", F.col("reason").isNotNull(), F.col("reason"), "warning"), ("date_inverted", F.col("date_inverted"), F.col("_new"), "warning")]
    found = F.when(card, F.concat("_own", broken(of_card, "id"))).when(F.col("_edge"), broken(of_edge, "_old")).otherwise(broken(of_ref, "id"))
    once = lambda c: F.when(F.col("_edge"), F.col(c))
    return every.select(*KEY, "id", "status", "slot", "superseded_by", "field", "ref", F.when(card, F.col("retired")).alias("retired"), found.alias("found"), once("_old").alias("old"), once("_new").alias("new"), once("reason").alias("reason"), once("date_inverted").alias("date_inverted"))


def examined(decisions: DataFrame, most: int = HELD) -> DataFrame:
    """A row for every decision, and one for each of its references, with what the whole registry says of them.

    registry_id, id; of a decision (field null) status, slot, superseded_by, retired (by an honoured edge) and found, its violations; of a
    reference field, ref, found and, in one row of each edge, old, new, reason, date_inverted.  Registries are counted first: those of up to
    ``most`` decisions move once, each to one task; rows of larger ones move by id."""
    large = kept(decisions.groupBy(*KEY).count().where(F.col("count") > most).select(F.col(KEY[0]).alias("_large")))
    own = _cards(decisions)
    if large.isEmpty():
        return _examined(own.repartition(*KEY))
    of = F.col(KEY[0]).eqNullSafe(F.col("_large"))
    return _examined(own.join(large, of, "left_anti").repartition(*KEY)).unionByName(_examined(own.join(large, of, "left_semi")))


def stored(rows: DataFrame) -> DataFrame:
    """The examined rows, written once to the shared folder: verdicts read them several times."""
    folder = new_folder(rows.sparkSession, "examined")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def own_edges(rows: DataFrame) -> DataFrame:
    """dr4: the judged edges of examined decisions, as ``judged_edges`` gives them."""
    return rows.where("old is not null").select(*KEY, "old", "new", "reason", "date_inverted")


def registry_findings(rows: DataFrame) -> DataFrame:
    """Of examined decisions, all that counts for a registry's verdict: the rows of ``all_findings`` with the decisions' own edges."""
    cards = rows.where("field is null")
    does = cards.where(F.col("status") == SUPPRESSING).select(*KEY).distinct().withColumn("_s", F.lit(True))
    groups = cards.where((F.col("status") == CONFIRMED) & ~F.col("retired")).groupBy(*KEY, "slot").agg(F.count("*").alias("n")).where("n > 1").join(does, KEY, "left")
    bare = F.col("slot").isNull()
    rules = [("slot_conflict", ~bare, F.col("n")), ("unlabeled", bare & F.col("_s"), F.col("n")), ("unlabeled", bare & F.col("_s").isNull(), F.col("n"), "warning")]
    cycles = as_violation(with_cycles(rows.where("old is not null"), KEY, "old", "new"), KEY, "supersede_cycle", "registry_id")
    return union(rows.select(*KEY, F.explode("found").alias("v")).select(*KEY, "v.*"), violations(groups, KEY, rules, F.when(bare, F.col(KEY[0]).cast("string")).otherwise(F.col("slot"))), cycles)
