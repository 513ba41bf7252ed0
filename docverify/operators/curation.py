"""Contributions of several perspectives, what people decided on them, and the curated result.

contrib_items: run_id, perspective, item_no, item_id, target_section, consideration, human_question, human_need, evidence_refs; dispositions: run_id, item_id, status,
group_id, decision, material_refs, rationale; materials: run_id, material_id, sha256; section_defs: run_id, section, pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import as_violation, repeated, union, violations
from ..functions.text import blank
from .graph import or_false

KEY = ["run_id"]
#: Statuses in their order, and what people can be needed for.
STATUS = ("decided", "supported", "carried", "open", "dismissed")
NEEDS = ("decision", "material", "both", "none")


def envelope_violations(items: DataFrame, section_defs: DataFrame, inventory: DataFrame) -> DataFrame:
    """cu1: item ids in sequence within run and perspective, known sections, needs, no blank consideration or question, evidence captured and named once, ids unique over all perspectives."""
    n = F.row_number().over(Window.partitionBy(*KEY, "perspective").orderBy("item_no"))
    due = F.concat_ws("/", F.col("run_id").cast("string"), "perspective", F.format_string("%02d", n))
    own = violations(items.withColumn("_due", due), KEY, [
        ("id_out_of_sequence", ~F.col("item_id").eqNullSafe(F.col("_due")), F.col("_due")), ("need_unknown", ~or_false(F.col("human_need").isin(*NEEDS)), F.col("human_need")), ("evidence_repeated", or_false(F.size("evidence_refs") != F.size(F.array_distinct("evidence_refs"))), None),
        ("consideration_blank", blank(F.col("consideration")), None), ("human_question_blank", blank(F.col("human_question")), None),
    ], "item_id")
    strange = items.join(section_defs.select(*KEY, F.col("section").alias("target_section")).distinct(), [*KEY, "target_section"], "left_anti")
    refs = items.select(*KEY, "item_id", F.explode("evidence_refs").alias("path")).join(inventory.select(*KEY, "path").distinct(), [*KEY, "path"], "left_anti")
    return union(own, as_violation(strange, KEY, "section_unknown", "item_id", F.col("target_section")), as_violation(refs, KEY, "evidence_not_captured", "item_id", F.col("path")), repeated(items, KEY, "item_id", "item_repeated"))


def item_index(items: DataFrame) -> DataFrame:
    """cu1: all items of a run in the order of their ids' bytes."""
    return items.select(*KEY, "item_id", "perspective", "target_section", F.row_number().over(Window.partitionBy(*KEY).orderBy("item_id")).alias("pos"))


def disposition_coverage(items: DataFrame, dispositions: DataFrame, materials: DataFrame) -> DataFrame:
    """cu2: items without a disposition, dispositions of unknown items or given twice, unknown statuses and materials, and what a status asks for."""
    one = [*KEY, "item_id"]
    own = violations(dispositions, KEY, [
        ("status_unknown", ~or_false(F.col("status").isin(*STATUS)), F.col("status")), ("decided_without_decision", (F.col("status") == "decided") & blank(F.col("decision")), None), ("supported_without_material", (F.col("status") == "supported") & (F.coalesce(F.size("material_refs"), F.lit(0)) <= 0), None),
        ("no_rationale", F.col("status").isin("carried", "dismissed") & blank(F.col("rationale")), F.col("status")),
    ], "item_id")
    refs = dispositions.select(*one, F.explode("material_refs").alias("material_id")).join(materials.select(*KEY, "material_id").distinct(), [*KEY, "material_id"], "left_anti")
    return union(
        own, as_violation(items.select(*one).join(dispositions.select(*one), one, "left_anti"), KEY, "item_without_disposition", "item_id"), as_violation(dispositions.join(items.select(*one), one, "left_anti"), KEY, "item_unknown", "item_id"),
        repeated(dispositions, KEY, "item_id", "disposition_repeated"), as_violation(refs, KEY, "material_unknown", "item_id", F.col("material_id")),
    )


def group_consistency(items: DataFrame, dispositions: DataFrame) -> DataFrame:
    """cu3: run_id, group_id, n (different signatures) of groups whose members don't agree on status, section, decision, materials and rationale."""
    both = dispositions.where(~blank(F.col("group_id"))).join(items.select(*KEY, "item_id", "target_section"), [*KEY, "item_id"])
    signature = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("status", "target_section", "decision", "rationale")), F.array_join("material_refs", ","))
    return both.groupBy(*KEY, "group_id").agg(F.count_distinct(signature).alias("n")).where("n > 1")


def curated_items(items: DataFrame, dispositions: DataFrame, materials: DataFrame, section_defs: DataFrame) -> DataFrame:
    """cu4: items with their dispositions and materials' hashes, pos in the canonical order: section, grouped ones first, group, status, id."""
    d = dispositions.select(*KEY, "item_id", "status", F.coalesce("group_id", F.lit("")).alias("group_id"), "decision", "material_refs", "rationale")
    shas = d.select(*KEY, "item_id", F.explode("material_refs").alias("material_id")).join(materials, [*KEY, "material_id"]).groupBy(*KEY, "item_id").agg(F.array_sort(F.collect_set("sha256")).alias("material_sha256"))
    own = items.join(d, [*KEY, "item_id"]).join(section_defs.select(*KEY, F.col("section").alias("target_section"), F.col("pos").alias("_s")), [*KEY, "target_section"]).join(shas, [*KEY, "item_id"], "left")
    by = Window.partitionBy(*KEY).orderBy("_s", F.col("group_id") == "", "group_id", F.array_position(F.array(*map(F.lit, STATUS)), F.col("status")), "item_id")
    return own.select(*KEY, F.row_number().over(by).alias("pos"), "item_id", "perspective", "group_id", "status", "target_section", "consideration", "decision", F.coalesce("material_sha256", F.array().cast("array<string>")).alias("material_sha256"), "rationale")


def curation_digest(curated: DataFrame) -> DataFrame:
    """cu4: one sha256 per run over its items as JSON, in canonical order."""
    fields = [c for c in curated.columns if c not in (*KEY, "pos")]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*sorted(fields))).alias("j"))))
    return curated.groupBy(*KEY).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["j"]), "\n"), 256).alias("digest"), F.count("*").alias("n"))


def curated_notes(curated: DataFrame) -> DataFrame:
    """cu5: run_id, part (settled or open), target_section, group_id, n, note: settled items by section and group with where they come from, open ones apart by section."""
    is_open = F.col("status") == "open"
    line = F.concat(F.lit("- "), F.coalesce("consideration", F.lit("")), F.lit(" ("), "item_id", F.lit(")"))
    rows = curated.select(*KEY, F.when(is_open, "open").otherwise("settled").alias("part"), "target_section", F.when(is_open, "").otherwise(F.col("group_id")).alias("group_id"), "pos", line.alias("line"))
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(*KEY, "part", "target_section", "group_id").agg(F.count("*").alias("n"), note.alias("note"))
