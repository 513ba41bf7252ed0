"""Manifests, their gaps and release gates; change plans and their grounding; scores.

projects: project_id, product, ssot, doc_type, sources and downstream (map of class to paths); manifest_sections: project_id, pos, id, title,
status, sources, gaps, scores (map), flags (map of booleans); open_questions: project_id, id, topic, status, owner; decision_log: project_id, id,
decision; review_audit: project_id, list, decision_id; observations: project_id, id, what, kind, verified, sources; chunks: project_id, id, title,
members, order, order_rationale, status, asis, tobe.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import WARNING, as_violation, repeated, union, violations
from ..functions.text import blank
from .graph import classes, kept, levels, or_false

#: Fixed values of the manifest's contract.
STATUS = ("pending", "draft", "review", "approved")
AUTHORED = STATUS[1:]
QUESTION_STATUS = ("open", "resolved", "deferred")
AXES = ("completeness", "coherence", "clarity", "depth")
KINDS = ("bug", "ux", "debt", "risk", "gap")
DOC_SOURCES, PLAN_SOURCES = ("code_roots", "design", "docs", "prototype"), ("code_roots", "design", "docs", "logs")
KEY = ["project_id"]


def manifest_violations(projects: DataFrame, sections: DataFrame, questions: DataFrame, decisions: DataFrame, audit: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """gp1: errors and warnings of document manifests."""
    p = violations(projects, KEY, [("product_missing", blank(F.col("product")), None), ("ssot_missing", blank(F.col("ssot")), None), ("doc_type_unset", blank(F.col("doc_type")), None, WARNING)], "project_id")
    holds_blank = lambda c: or_false(F.exists(c, lambda x: x.isNull() | (F.btrim(x) == "")))
    strange = F.filter(F.map_keys("scores"), lambda a: ~a.isin(*axes))
    s = violations(sections, KEY, [
        ("id_missing", blank(F.col("id")), None), ("title_missing", blank(F.col("title")), None), ("status_invalid", ~or_false(F.col("status").isin(*STATUS)), F.col("status")), ("blank_source", holds_blank("sources"), None), ("blank_gap", holds_blank("gaps"), None),
        ("approved_without_sources", (F.col("status") == "approved") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0), None, WARNING), ("unknown_axis", F.size(strange) > 0, F.array_join(F.array_sort(strange), ","), WARNING),
    ], "id")
    empty = as_violation(projects.join(sections.select(*KEY).distinct(), KEY, "left_anti"), KEY, "no_sections", "project_id", None, WARNING)
    q = violations(questions, KEY, [("question_topic_missing", blank(F.col("topic")), None), ("question_status_invalid", F.col("status").isNotNull() & ~F.col("status").isin(*QUESTION_STATUS), F.col("status")), ("question_owner_unset", blank(F.col("owner")), None, WARNING)], "id")
    d = violations(decisions, KEY, [("decision_text_missing", blank(F.col("decision")), None)], "id")
    known = decisions.select(*KEY, F.col("id").alias("decision_id")).distinct()
    named = audit.where(~blank(F.col("decision_id")))
    dangling = as_violation(named.join(known, [*KEY, "decision_id"], "left_anti"), KEY, "audit_dangling", "decision_id", F.col("list"))
    twice = named.groupBy(*KEY, "list", "decision_id").agg(F.count("*").alias("n")).where("n > 1")
    both = named.groupBy(*KEY, "decision_id").agg(F.countDistinct("list").alias("n")).where("n > 1")
    return union(
        p, s, empty, q, d, repeated(sections, KEY, "id", "section_repeated"), repeated(questions, KEY, "id", "question_repeated"), repeated(decisions, KEY, "id", "decision_repeated"),
        as_violation(audit.where(blank(F.col("decision_id"))), KEY, "audit_id_missing", F.col("list")), dangling, as_violation(twice, KEY, "audit_repeated", "decision_id", F.col("list")), as_violation(both, KEY, "audit_in_both", "decision_id", None, WARNING),
    )


def plan_violations(observations: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """gp2: errors and warnings of change plans."""
    o = violations(observations, KEY, [("what_missing", blank(F.col("what")), None), ("kind_unknown", F.col("kind").isNotNull() & ~F.col("kind").isin(*kinds), F.col("kind"), WARNING), ("verified_without_source", F.col("verified") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0), None, WARNING)], "id")
    authored = or_false(F.col("status").isin(*AUTHORED))
    bare = F.coalesce(F.size("members"), F.lit(0)) <= 0
    c = violations(chunks, KEY, [
        ("title_missing", blank(F.col("title")), None), ("status_invalid", ~or_false(F.col("status").isin(*STATUS)), F.col("status")), ("members_empty", bare, F.when(authored, "authored").otherwise("not authored"), WARNING),
        ("rationale_missing", F.col("order_rationale").isNull(), None, WARNING), ("rationale_blank", F.col("order_rationale").isNotNull() & blank(F.col("order_rationale")), None), ("asis_missing", authored & blank(F.col("asis")), None, WARNING), ("tobe_missing", authored & blank(F.col("tobe")), None, WARNING),
    ], "id")
    members = chunks.select(*KEY, "id", F.explode("members").alias("member"))
    dangling = members.join(observations.select(*KEY, F.col("id").alias("member")).distinct(), [*KEY, "member"], "left_anti")
    return union(o, c, repeated(observations, KEY, "id", "observation_repeated"), repeated(chunks, KEY, "id", "chunk_repeated"), as_violation(dangling, KEY, "member_dangling", "id", F.col("member")), repeated(chunks, KEY, "order", "order_repeated", WARNING))


def gap_report(sections: DataFrame, questions: DataFrame, audit: DataFrame) -> DataFrame:
    """gp3: per project n_sections, n_gaps, sections by status, questions by status, n_pending_apply."""
    s = sections.groupBy(*KEY).agg(F.count("*").alias("n_sections"), F.sum(F.greatest(F.coalesce(F.size("gaps"), F.lit(0)), F.lit(0))).alias("n_gaps"), *(F.count_if(F.col("status") == x).alias(f"n_{x}") for x in STATUS))
    q = questions.groupBy(*KEY).agg(*(F.count_if(F.coalesce("status", F.lit("open")) == x).alias(f"n_q_{x}") for x in QUESTION_STATUS))
    a = audit.groupBy(*KEY).agg(F.count_if(F.col("list") == "pending_apply").alias("n_pending_apply"))
    every = s.join(q, KEY, "full").join(a, KEY, "full")
    return every.na.fill(0, [c for c in every.columns if c not in KEY])


def crosscheck_coverage(projects: DataFrame, inventory: DataFrame, known: tuple[str, ...] = DOC_SOURCES) -> DataFrame:
    """gp4: per project n_sources (paths under recognised classes), n_downstream (distinct readable files), unreadable (declared paths), cross_blind."""
    flat = lambda c: projects.select(*KEY, F.explode(c).alias("class", "paths")).select(*KEY, "class", F.explode("paths").alias("path"))
    n = flat("sources").where(F.col("class").isin(*known)).groupBy(*KEY).agg(F.count("path").alias("n_sources"))
    declared = flat("downstream").where(~blank(F.col("path"))).select(*KEY, F.btrim("path").alias("path")).distinct()
    there = inventory.select("path").distinct().withColumn("_r", F.lit(True))
    d = declared.join(there, "path", "left").groupBy(*KEY).agg(F.count("_r").alias("n_downstream"), F.array_sort(F.collect_set(F.when(F.col("_r").isNull(), F.col("path")))).alias("unreadable"))
    every = projects.select(*KEY).join(n, KEY, "left").join(d, KEY, "left").na.fill(0, ["n_sources", "n_downstream"])
    return every.withColumns({"unreadable": F.coalesce("unreadable", F.array().cast("array<string>")), "cross_blind": F.col("n_sources") + F.col("n_downstream") == 0})


def release_gate(report: DataFrame, coverage: DataFrame, strict_cross: bool = False) -> DataFrame:
    """gp5: per project reasons (array) and passes."""
    every = report.join(coverage, KEY, "left")
    reasons = [F.when(F.col("n_gaps") > 0, "gaps"), F.when(F.col("n_q_open") > 0, "open_questions"), F.when(F.col("n_pending") > 0, "pending"), F.when(F.col("n_pending_apply") > 0, "pending_apply")]
    if strict_cross:
        reasons += [F.when(F.coalesce("cross_blind", F.lit(True)), "cross_blind"), F.when(F.size("unreadable") > 0, "unreadable_downstream")]
    return every.withColumn("reasons", F.array_compact(F.array(*reasons))).select(*KEY, "reasons", (F.size("reasons") == 0).alias("passes"))


def merge_gaps(agent_gaps: DataFrame, sections: DataFrame, classes_known: tuple[str, ...] = ("missing", "conflict", "vague")) -> DataFrame:
    """gp6: project_id, section_id, gap, agents, kinds, becomes (gap or open_question), disagreement: agents' gaps (project_id, agent, section_id, gap, kind)
    as one row for each section and gap; what names no section or no known class becomes an open question."""
    merged = agent_gaps.groupBy(*KEY, "section_id", "gap").agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    known = sections.select(*KEY, F.col("id").alias("section_id")).distinct().withColumn("_k", F.lit(True))
    unclear = F.col("_k").isNull() | ~or_false(F.size(F.array_intersect("kinds", F.array(*map(F.lit, classes_known)))) > 0)
    return merged.join(known, [*KEY, "section_id"], "left").select(*KEY, "section_id", "gap", "agents", "kinds", F.when(unclear, "open_question").otherwise("gap").alias("becomes"), (F.size("kinds") > 1).alias("disagreement"))


def grounded(observations: DataFrame) -> DataFrame:
    """gr1: adds grounded: verified, and at least one source that isn't blank."""
    return observations.withColumn("grounded", or_false(F.col("verified")) & or_false(F.exists("sources", lambda s: F.btrim(s) != "")))


def ungrounded_plans(chunks: DataFrame, observations: DataFrame) -> DataFrame:
    """gr2: project_id, chunk_id, obs_id, what of each authored chunk's members that exist and aren't grounded."""
    members = chunks.where(F.col("status").isin(*AUTHORED)).select(*KEY, F.col("id").alias("chunk_id"), F.explode("members").alias("obs_id"))
    bad = grounded(observations).where("not grounded").select(*KEY, F.col("id").alias("obs_id"), "what")
    return members.join(bad, [*KEY, "obs_id"]).select(*KEY, "chunk_id", "obs_id", "what")


def plan_gaps(chunks: DataFrame) -> DataFrame:
    """gr3: project_id, rule, subject (chunk), …: pending chunks, and what others lack."""
    authored = or_false(F.col("status").isin(*AUTHORED))
    return violations(chunks, KEY, [("pending", F.col("status") == "pending", None), ("no_rationale", blank(F.col("order_rationale")), None), ("no_asis", authored & blank(F.col("asis")), None), ("no_tobe", authored & blank(F.col("tobe")), None), ("no_members", authored & (F.coalesce(F.size("members"), F.lit(0)) <= 0), None)], "id")


def resolution_order(chunks: DataFrame) -> DataFrame:
    """gr4: project_id, id, order, pos, ambiguous: by order and then id; chunks without an order come last."""
    by = Window.partitionBy(*KEY)
    return chunks.select(*KEY, "id", "order", F.row_number().over(by.orderBy(F.col("order").asc_nulls_last(), "id")).alias("pos"), (F.col("order").isNotNull() & (F.count("*").over(Window.partitionBy(*KEY, "order")) > 1)).alias("ambiguous"))


def handoff_gate(chunks: DataFrame, observations: DataFrame, projects: DataFrame, strict_cross: bool = False) -> DataFrame:
    """gr5: per project reasons and passes."""
    rules = plan_gaps(chunks).groupBy(*KEY).agg(F.collect_set("rule").alias("_r"))
    bad = ungrounded_plans(chunks, observations).select(*KEY).distinct().withColumn("_u", F.lit(True))
    n = chunks.groupBy(*KEY).agg(F.count_if(F.col("status") != "pending").alias("_a"))
    cover = crosscheck_coverage(projects, projects.sparkSession.createDataFrame([], "path string"), PLAN_SOURCES).select(*KEY, "n_sources")
    every = n.join(rules, KEY, "left").join(bad, KEY, "left").join(cover, KEY, "left")
    reasons = [F.coalesce("_r", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("_u"), "ungrounded_plan"), *([F.when((F.col("_a") > 0) & (F.coalesce("n_sources", F.lit(0)) == 0), "cross_blind")] if strict_cross else [])))]
    return every.select(*KEY, F.array_sort(F.concat(*reasons)).alias("reasons")).withColumn("passes", F.size("reasons") == 0)


#: Observations and their sources of a project up to which one task holds them; larger projects go by rounds.
HELD = 100_000
#: Rows in a batch that leaves a task.
BATCH = 10_000


def _by_project(observations: DataFrame) -> DataFrame:
    """project_id, id, cluster of whole projects, each in one task: rows come sorted by project, and sets that share a source are merged as they come."""
    kind = {c: observations.schema[c].dataType.simpleString() for c in (*KEY, "id")}

    def clusters(rows: Iterator[tuple]) -> Iterator[tuple]:
        for project, own in groupby(rows, itemgetter(0)):
            up = {}  # an id, or a source in a tuple, to another of its set; the least id leads each set

            def top(x: object) -> object:
                while up[x] != x:  # noqa: B023
                    up[x] = x = up[up[x]]  # noqa: B023
                return x

            ids, leads = {}, {}
            for _, i, sources in own:
                ids[i] = None
                if project is None or i is None:
                    continue
                up.setdefault(i, i)
                for source in sources or ():
                    a, b = top(i), top(leads.setdefault(source, i))
                    up[max(a, b)] = min(a, b)
            yield from ((project, i, top(i) if i in up else i) for i in ids)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def rows() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([(*KEY, batch.schema.field(0).type), ("id", batch.schema.field(1).type), ("cluster", batch.schema.field(1).type)])
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for row in clusters(rows()):
            out.append(row)
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return observations.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(find, f"{KEY[0]} {kind[KEY[0]]}, id {kind['id']}, cluster {kind['id']}")


def _by_rounds(observations: DataFrame) -> DataFrame:
    """The same by rounds over all projects together."""
    held = observations.select(*KEY, "id", F.explode("sources").alias("source"))
    first = held.groupBy(*KEY, "source").agg(F.min("id").alias("_f"))
    found = classes(held.join(first, [*KEY, "source"]), KEY, "id", "_f")
    return observations.select(*KEY, "id").distinct().join(found.withColumnRenamed("node", "id"), [*KEY, "id"], "left").select(*KEY, "id", F.coalesce("label", "id").alias("cluster"))


def cluster_observations(observations: DataFrame, most: int = HELD) -> DataFrame:
    """gr6: project_id, id, cluster (least id): observations that share a source, directly or through others, are one candidate chunk.

    Clusters lie within a project.  Projects are counted first: those of up to ``most`` observations and sources are clustered in one pass, larger ones by rounds."""
    own = observations.select(*KEY, "id", F.filter("sources", lambda x: ~blank(x)).alias("sources"))
    large = kept(own.groupBy(*KEY).agg(F.sum(1 + F.coalesce(F.size("sources"), F.lit(0))).alias("_n")).where(F.col("_n") > most).select(F.col(KEY[0]).alias("_large")))
    if large.isEmpty():
        return _by_project(own)
    of = F.col(KEY[0]).eqNullSafe(F.col("_large"))
    return _by_project(own.join(large, of, "left_anti")).unionByName(_by_rounds(own.join(large, of, "left_semi")))


def sequence_chunks(chunks: DataFrame, deps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """gr7: project_id, id, level, pos: first by level of dependencies (project_id, id, needs), then by the weighted columns, largest first."""
    level = levels(deps, chunks, KEY, "id", "needs").withColumnRenamed("node", "id")
    weight = reduce(Column.__add__, (F.coalesce(F.col(c), F.lit(0)) * F.lit(w) for c, w in weights.items()))
    scored = chunks.join(level, [*KEY, "id"], "left").withColumn("_w", weight)
    return scored.select(*KEY, "id", "level", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("level").asc_nulls_last(), F.desc("_w"), "id")).alias("pos"))


def scale_of(policies: DataFrame) -> DataFrame:
    """sc1: per project min, max, pass_threshold and weights: later maps win key by key; weights are the new ones wherever that key is there, else the old."""
    d = F.create_map(F.lit("min"), F.lit(1), F.lit("max"), F.lit(5), F.lit("pass_threshold"), F.lit(3))
    maps = [d, *(F.coalesce(c, F.create_map().cast("map<string,int>")) for c in ("legacy_scale", "scale", "rubric_scale"))]
    pick = lambda k: F.coalesce(*(F.element_at(m, k) for m in reversed(maps)))
    return policies.select(*KEY, pick("min").alias("min"), pick("max").alias("max"), pick("pass_threshold").alias("pass_threshold"), F.coalesce("weights", "legacy_weights", F.create_map().cast("map<string,int>")).alias("weights"))


def section_scores(sections: DataFrame, policy: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """sc1: per scored section deficit, weight, priority, rank, failing, absent.  policy: project_id, pass_threshold, weights."""
    own = sections.where(F.col("scores").isNotNull() & (F.size("scores") > 0)).join(policy.select(*KEY, "pass_threshold", "weights"), KEY)
    v = {a: F.element_at("scores", a) for a in axes}
    w = lambda a: F.coalesce(F.element_at("weights", a), F.lit(1))
    thr = F.col("pass_threshold")
    add = lambda xs: reduce(Column.__add__, xs)
    deficit = add(F.when(v[a] < thr, thr - v[a]).otherwise(0) for a in axes)
    failing = add(F.when(v[a] < thr, w(a)).otherwise(0) for a in axes)
    flags = F.aggregate(F.map_entries("weights"), F.lit(0), lambda s, e: s + F.when(~e["key"].isin(*axes) & F.coalesce(F.element_at("flags", e["key"]), F.lit(False)), e["value"]).otherwise(0))
    names = lambda test: F.array_compact(F.array(*(F.when(test(v[a]), a) for a in axes)))
    scored = own.select(*KEY, "pos", "id", deficit.alias("deficit"), (failing + flags).alias("weight"), names(lambda x: x < thr).alias("failing"), names(lambda x: x.isNull()).alias("absent"))
    scored = scored.withColumn("priority", F.col("weight") * 10 + F.col("deficit"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("priority"), "pos")))


def below_threshold(scores: DataFrame) -> DataFrame:
    """sc2: sections with an axis below the threshold."""
    return scores.where(F.size("failing") > 0).select(*KEY, "id", "failing")


def incomplete_scores(scores: DataFrame) -> DataFrame:
    """sc2: scored sections with an axis left out."""
    return scores.where(F.size("absent") > 0).select(*KEY, "id", "absent")


def scoring_gate(sections: DataFrame, scores: DataFrame, strict_coverage: bool = False) -> DataFrame:
    """sc3: per project n_sections, n_scored, reasons, passes."""
    n = sections.groupBy(*KEY).agg(F.count("*").alias("n_sections"))
    s = scores.groupBy(*KEY).agg(F.count("*").alias("n_scored"), F.count_if(F.size("failing") > 0).alias("_f"), F.count_if(F.size("absent") > 0).alias("_a"))
    every = n.join(s, KEY, "left").na.fill(0, ["n_scored", "_f", "_a"])
    reasons = [F.when(F.col("_f") > 0, "below_threshold"), *([F.when(F.col("n_scored") == 0, "nothing_scored"), F.when(F.col("_a") > 0, "unscored_axes")] if strict_coverage else [])]
    return every.withColumn("reasons", F.array_compact(F.array(*reasons))).select(*KEY, "n_sections", "n_scored", "reasons", (F.size("reasons") == 0).alias("passes"))
