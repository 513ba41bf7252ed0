"""Convention profiles, the answers given to them, and the conventions that follow.

profiles: profile_id, pos, question_id, targets, allowed_scopes, required_sections (arrays); options: profile_id, question_id, option_id, targets;
intakes: intake_id, profile_id, result, observed_sections, target_document; answers: intake_id, question_id, applicability, evidence, asked, response, authority,
scope, source, approval; declarations: profile_id, question_id, option_id, key, identity, body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import as_violation, union, violations
from ..functions.text import blank, nfc
from .graph import or_false
from .structure import identity_collisions, unstable_ids

#: The answers' states and the scopes.
APPROVALS, SCOPES = ("inapplicable", "unanswered", "answered", "approved_to_draft"), ("document", "template")
P, I = ["profile_id"], ["intake_id"]


def profile_violations(profiles: DataFrame, options: DataFrame) -> DataFrame:
    """cv1: fields of questions, options that don't declare exactly their question's targets, questions without options, ids that collide or are unstable."""
    own = violations(profiles, P, [
        ("targets_empty", F.coalesce(F.size("targets"), F.lit(0)) <= 0, None), ("scope_unknown", or_false(F.size(F.array_except("allowed_scopes", F.array(*map(F.lit, SCOPES)))) > 0) | (F.coalesce(F.size("allowed_scopes"), F.lit(0)) <= 0), None),
        ("sections_empty", F.coalesce(F.size("required_sections"), F.lit(0)) <= 0, None),
    ], "question_id")
    both = options.join(profiles.select(*P, "question_id", F.col("targets").alias("_t")), [*P, "question_id"])
    differ = ~or_false(F.array_sort(F.array_distinct("targets")) == F.array_sort(F.array_distinct("_t")))
    bare = profiles.join(options.select(*P, "question_id").distinct(), [*P, "question_id"], "left_anti")
    per = options.withColumn("_o", F.concat_ws("/", "question_id", "option_id"))
    return union(own, as_violation(both.where(differ), P, "option_targets", "question_id", F.col("option_id")), as_violation(bare, P, "no_options", "question_id"), identity_collisions(profiles, P, "question_id"), identity_collisions(per, P, "_o"), unstable_ids(profiles, P, ["question_id"]), unstable_ids(options, P, ["option_id"]))


def intake_coverage(profiles: DataFrame, intakes: DataFrame, answers: DataFrame) -> DataFrame:
    """cv2: intake_id, question_id, state of questions that are missing, unknown or answered more than once.  An intake that declares its profile inapplicable has no answers to give."""
    due = intakes.where(F.col("result") == "applicable").select(*I, *P).join(profiles.select(*P, "question_id"), P).select(*I, "question_id").withColumn("_p", F.lit(True))
    given = answers.groupBy(*I, "question_id").agg(F.count("*").alias("n"))
    both = due.join(given, [*I, "question_id"], "full")
    return both.select(*I, "question_id", F.when(F.col("n").isNull(), "missing").when(F.col("_p").isNull(), "unknown").when(F.col("n") > 1, "repeated").alias("state")).where("state is not null")


def answer_state_violations(profiles: DataFrame, options: DataFrame, intakes: DataFrame, answers: DataFrame) -> DataFrame:
    """cv3: each answer's state against its applicability, whether it was asked, and its fields; the response is an option, the scope allowed."""
    rows = answers.join(intakes.select(*I, *P, "target_document"), I).join(profiles.select(*P, "question_id", "allowed_scopes"), [*P, "question_id"])
    rows = rows.join(options.select(*P, "question_id", F.col("option_id").alias("response")).distinct().withColumn("_o", F.lit(True)), [*P, "question_id", "response"], "left")
    filled = F.coalesce(*(F.col(c).isNotNull() & F.lit(True) for c in ("response",))) | F.col("authority").isNotNull() | F.col("scope").isNotNull() | F.col("source").isNotNull()
    a, known = F.col("approval"), or_false(F.col("approval").isin(*APPROVALS))
    no, un = a == "inapplicable", a == "unanswered"
    said = known & ~no & ~un
    return violations(rows, I, [
        ("approval_unknown", ~known, a), ("applicability_unknown", ~or_false(F.col("applicability").isin("applicable", "inapplicable")), F.col("applicability")), ("evidence_blank", blank(F.col("evidence")), None), ("asked_unset", F.col("asked").isNull(), None),
        ("inapplicable_result", no & ~F.col("applicability").eqNullSafe("inapplicable"), None), ("inapplicable_asked", no & ~F.col("asked").eqNullSafe(False), None), ("inapplicable_filled", no & filled, None),
        ("not_applicable_result", known & ~no & ~F.col("applicability").eqNullSafe("applicable"), a), ("unanswered_filled", un & filled, None),
        ("not_asked", said & ~F.col("asked").eqNullSafe(True), None), ("response_not_an_option", said & F.col("_o").isNull(), F.col("response")), ("authority_blank", said & blank(F.col("authority")), None),
        ("scope_not_allowed", said & ~or_false(F.array_contains("allowed_scopes", F.col("scope")) & F.col("scope").isin(*SCOPES)), F.col("scope")), ("document_unnamed", said & (F.col("scope") == "document") & blank(F.col("target_document")), None), ("source_blank", said & blank(F.col("source")), None),
    ], "question_id")


def applicability_contradictions(profiles: DataFrame, intakes: DataFrame) -> DataFrame:
    """cv4: intake_id, question_id: the profile is said not to apply, yet every section that the question requires was observed."""
    seen = intakes.where(F.col("result") == "inapplicable").select(*I, *P, F.explode("observed_sections").alias("s")).select(*I, *P, nfc(F.col("s")).alias("s")).distinct()
    need = profiles.select(*P, "question_id", F.size(F.array_distinct("required_sections")).alias("_n"), F.explode(F.array_distinct("required_sections")).alias("s")).withColumn("s", nfc(F.col("s")))
    need = need.groupBy(*P, "question_id", "s").agg(F.lit(1).alias("_1"))
    n = need.groupBy(*P, "question_id").agg(F.count("*").alias("_need"))
    met = need.join(seen, [*P, "s"]).groupBy(*I, *P, "question_id").agg(F.count("*").alias("_met"))
    return met.join(n, [*P, "question_id"]).where("_met = _need").select(*I, "question_id")


def materialize_conventions(profiles: DataFrame, intakes: DataFrame, answers: DataFrame, declarations: DataFrame) -> DataFrame:
    """cv5: intake_id, state, key, identity, body, pos: approved declarations in profile order, merged by identity: merged, or conflict where bodies differ;
    refused (no key) where nothing is approved or the profile doesn't apply."""
    good = answers.where(F.col("approval") == "approved_to_draft").join(intakes.where(F.col("result") == "applicable").select(*I, *P), I)
    rows = good.join(declarations.withColumnRenamed("option_id", "response"), [*P, "question_id", "response"]).join(profiles.select(*P, "question_id", F.col("pos").alias("_q")), [*P, "question_id"])
    rows = rows.withColumn("_i", nfc(F.col("identity")))
    by = Window.partitionBy(*I, "key", "_i")
    first = rows.withColumns({"_n": F.row_number().over(by.orderBy("_q", "body")), "_bodies": F.size(F.collect_set("body").over(by))}).where("_n = 1")
    merged = first.select(*I, F.when(F.col("_bodies") > 1, "conflict").otherwise("merged").alias("state"), "key", "identity", "body", F.row_number().over(Window.partitionBy(*I, "key").orderBy("_q", "_i")).alias("pos"))
    none = intakes.join(good.select(*I).distinct(), I, "left_anti").select(*I, F.lit("refused").alias("state"), *(F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("identity", "string"), ("body", "string"), ("pos", "int"))))
    return merged.unionByName(none)
