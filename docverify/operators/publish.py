"""What is published in which order, and the approval brief.

sections (bodies): doc_id, section_idx, title, block; manifest_sections: doc_id, pos, id, title, status; policy: doc_id, pos, id, title, required.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key
from .graph import or_false

KEY = ["doc_id"]


def section_order(policy: DataFrame, manifest: DataFrame) -> DataFrame:
    """pb1: doc_id, pos, id, title, required, status: the policy's order, then what the manifest alone has; the manifest's order where there is no policy."""
    p = policy.select(*KEY, "id", F.col("pos").alias("_p"), F.col("title").alias("_pt"), "required")
    m = manifest.select(*KEY, "id", F.col("pos").alias("_m"), F.col("title").alias("_mt"), "status")
    both = p.join(m, [*KEY, "id"], "full")
    by = Window.partitionBy(*KEY).orderBy(F.col("_p").isNull(), "_p", "_m")
    return both.select(*KEY, F.row_number().over(by).alias("pos"), "id", F.coalesce("_mt", "_pt", "id").alias("title"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("status", F.lit("undefined")).alias("status"))


def publish_plan(order: DataFrame, bodies: DataFrame, drafts: bool = False) -> DataFrame:
    """pb2: the order with action (included, excluded, no_body), unmet (required and not approved) and the block; of a repeated heading the first block."""
    first = bodies.where(F.col("title").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, F.btrim("title")).orderBy("section_idx"))).where("_n = 1").select(*KEY, F.btrim("title").alias("_t"), "block")
    both = order.withColumn("_t", F.btrim("title")).join(first, [*KEY, "_t"], "left")
    shown = F.col("status").isin(*(("approved", "draft", "review") if drafts else ("approved",)))
    action = F.when(~shown, "excluded").when(F.col("block").isNull(), "no_body").otherwise("included")
    return both.select(*KEY, "pos", "id", "title", "status", action.alias("action"), (F.col("required") & (F.col("status") != "approved")).alias("unmet"), F.when(action == "included", F.col("block")).alias("block"))


def publish_gate(plan: DataFrame, repeats: DataFrame) -> DataFrame:
    """pb2: per document n_included, n_excluded, n_no_body, n_unmet, n_repeated, and passes (no unmet section, none without body, no repeated heading)."""
    n = plan.groupBy(*KEY).agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("included", "excluded", "no_body")), F.count_if("unmet").alias("n_unmet"))
    every = n.join(repeats.groupBy(*KEY).agg(F.count("*").alias("n_repeated")), KEY, "left").na.fill(0, ["n_repeated"])
    return every.withColumn("passes", (F.col("n_unmet") == 0) & (F.col("n_no_body") == 0) & (F.col("n_repeated") == 0))


def duplicate_headings(bodies: DataFrame) -> DataFrame:
    """pb3: doc_id, title, n of headings that come more than once."""
    return bodies.where(F.col("title").isNotNull()).groupBy(*KEY, F.btrim("title").alias("title")).agg(F.count("*").alias("n")).where("n > 1")


def orphan_headings(bodies: DataFrame, manifest: DataFrame, page_titles: DataFrame) -> DataFrame:
    """pb3: doc_id, title of headings that are neither a section of the manifest nor the page's title."""
    known = manifest.select(*KEY, "title").union(page_titles.select(*KEY, "title")).distinct()
    return bodies.where(F.col("title").isNotNull()).select(*KEY, F.btrim("title").alias("title")).distinct().join(known, [*KEY, "title"], "left_anti")


def approval_brief(manifest: DataFrame, bodies: DataFrame, questions: DataFrame, decisions: DataFrame, goals: tuple[str, ...] = ("goal", "purpose"), scopes: tuple[str, ...] = ("scope",), resolved: bool = False) -> DataFrame:
    """pb4: doc_id, kind (goal, scope, question, decision, status), pos, name, detail.  A section is a goal or a scope by its id or by how its title begins; goal
    wins.  Its body is that under the same title key, without the heading."""
    starts = lambda words: F.lower("id").isin(*words) | F.lower(F.btrim("title")).rlike("^(?:" + "|".join(words) + ")")
    kind = F.when(or_false(starts(goals)), "goal").when(or_false(starts(scopes)), "scope")
    body = bodies.where(F.col("title").isNotNull()).withColumn("_k", title_key(F.col("title"))).withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "_k").orderBy("section_idx"))).where("_n = 1")
    body = body.select(*KEY, "_k", F.btrim(F.regexp_replace("block", r"^ {0,3}#\s+\S[^\n]*(?:\n|\z)", ""), F.lit("\n")).alias("detail"))
    s = manifest.withColumn("kind", kind).where("kind is not null").withColumn("_k", title_key(F.coalesce("title", "id"))).join(body, [*KEY, "_k"], "left")
    out = lambda d, k, pos, name, detail: d.select(*KEY, k.alias("kind"), pos.cast("int").alias("pos"), name.cast("string").alias("name"), detail.cast("string").alias("detail"))
    numbered = lambda d: d.withColumn("_pos", F.row_number().over(Window.partitionBy(*KEY).orderBy("id")))
    shown = F.coalesce("status", F.lit("open")).isin(*(("open", "deferred", "resolved") if resolved else ("open", "deferred")))
    q, d = numbered(questions.where(shown)), numbered(decisions)
    counts = manifest.groupBy(*KEY, "status").agg(F.count("*").alias("n"))
    return out(s, F.col("kind"), F.col("pos"), F.coalesce("title", "id"), F.col("detail")).unionByName(out(q, F.lit("question"), F.col("_pos"), F.col("topic"), F.coalesce("status", F.lit("open")))).unionByName(out(d, F.lit("decision"), F.col("_pos"), F.col("id"), F.col("decision"))).unionByName(out(counts, F.lit("status"), F.lit(0), F.col("status"), F.col("n")))
