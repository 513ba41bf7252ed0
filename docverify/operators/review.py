"""Review rounds, triage, panels and the evaluation of reviewers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import violations
from ..functions.text import blank
from .graph import followed, kept, or_false

#: Names of a round's artefacts, the triage's words, and the caps.
ARTEFACTS = (r"^PROMPT_.*_r(\d+)", r"^.*REVIEW_r(\d+)", r"^TRIAGE_r(\d+)")
REASONED = ("defer", "reject", "pending verification", "human decision")
ROUND_CAP, DECISION_ITEMS = 3, 5


def next_round(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """rv1: keys, next_round: the least positive round that no artefact's name (keys, name) occupies; gaps are used again."""
    found = [F.regexp_extract("name", p, 1).try_cast("int") for p in ARTEFACTS]
    taken = artifacts.select(*keys, F.coalesce(*found).alias("n")).where("n > 0").distinct()
    free = artifacts.select(*keys, F.lit(1).alias("n")).distinct().unionByName(taken.select(*keys, (F.col("n") + 1).alias("n")))
    return free.join(taken, [*keys, "n"], "left_anti").groupBy(*keys).agg(F.min("n").alias("next_round"))


def triage(findings: DataFrame) -> DataFrame:
    """rv2: adds due, what the rules lead to, from validity, owned_rule and nature: the first rule that holds."""
    due = F.when(F.col("validity") == "refuted", "reject").when(F.col("validity") == "unverified", "pending verification").when(or_false(F.col("owned_rule")) | (F.col("nature") == "design"), "human decision").when((F.col("validity") == "verified") & F.col("nature").isin("bug", "overclaim", "robustness"), "apply")
    return findings.withColumn("due", due)


def triage_violations(findings: DataFrame, keys: list[str]) -> DataFrame:
    """rv2: forbidden combinations and reasons left out."""
    d = F.col("disposition")
    return violations(triage(findings), keys, [
        ("unverified_rejected", (F.col("validity") == "unverified") & (d == "reject"), None), ("recurring_as_addressed", F.col("lifecycle").isin("reopened", "regression") & (d == "already addressed"), F.col("lifecycle")),
        ("reason_missing", d.isin(*REASONED) & blank(F.col("reason")), d), ("place_missing", (d == "already addressed") & blank(F.col("reason")), None), ("no_rule", F.col("due").isNull(), None),
    ], "finding_id")


def fold_aliases(findings: DataFrame, keys: list[str]) -> DataFrame:
    """rv3: adds canonical (the first id that an alias leads to, over any number of steps; null on a cycle) and folded (duplicate, or reopened where new evidence came)."""
    alias = findings.where(F.col("alias_of").isNotNull() & (F.col("alias_of") != F.col("finding_id")))
    ends = followed(alias, keys, "finding_id", "alias_of").select(*keys, F.col("a").alias("finding_id"), "root")
    both = findings.join(ends, [*keys, "finding_id"], "left")
    is_alias = F.col("alias_of").isNotNull() & (F.col("alias_of") != F.col("finding_id"))
    return both.withColumn("canonical", F.when(is_alias, F.col("root")).otherwise(F.col("finding_id"))).withColumn("folded", F.when(is_alias, F.when(or_false(F.col("new_evidence")), "reopened").otherwise("duplicate")).otherwise("new")).drop("root")


def convergence(findings: DataFrame, keys: list[str]) -> DataFrame:
    """rv4: keys, rounds, unresolved (sorted ids), status: converged, round_cap or running."""
    d = F.col("disposition")
    left = d.isin("pending verification", "human decision") | F.col("lifecycle").isin("reopened", "regression") | ((d == "apply") & ~or_false(F.col("validated")))
    every = findings.groupBy(*keys).agg(F.max("round").alias("rounds"), F.array_sort(F.collect_set(F.when(left, F.col("finding_id")))).alias("unresolved"))
    return every.withColumn("status", F.when(F.size("unresolved") == 0, "converged").when(F.col("rounds") >= ROUND_CAP, "round_cap").otherwise("running"))


def panel_rollup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """rv5: keys, finding_id, roles, lone_critical, conflict, n_abstained of findings with evidence (keys, finding_id, role, severity, verdict, evidence); nothing is voted on."""
    own = findings.where(~blank(F.col("evidence")))
    return own.groupBy(*keys, "finding_id").agg(
        F.array_sort(F.collect_set("role")).alias("roles"), ((F.count_distinct("role") == 1) & F.bool_or(F.col("severity") == "critical")).alias("lone_critical"),
        (F.count_distinct(F.when(F.col("verdict") != "abstain", F.col("verdict"))) > 1).alias("conflict"), F.count_if(F.col("verdict") == "abstain").alias("n_abstained"),
    )


def panel_dropped(findings: DataFrame, keys: list[str]) -> DataFrame:
    """rv5: findings left out, with the reason."""
    return findings.where(blank(F.col("evidence"))).select(*keys, "finding_id", "role", F.lit("no evidence").alias("reason"))


def panel_gate(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """rv5: per panel n_findings, n_conflicts, n_lone, n_decisions and whether these are few enough to put to people."""
    n = rollup.groupBy(*keys).agg(F.count("*").alias("n_findings"), F.count_if("conflict").alias("n_conflicts"), F.count_if("lone_critical").alias("n_lone"), F.count_if(F.col("conflict") | F.col("lone_critical")).alias("n_decisions"))
    return n.withColumn("within_cap", F.col("n_decisions") <= DECISION_ITEMS)


def _overlapping(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """_g, _p: pairs of one item whose places overlap, one to one.  In each round those match that are each other's best, by overlap and then by order."""
    place = lambda d, n: d.where("start is not null and end is not null").select(*keys, "item", F.col("_id").alias(n), F.col("start").alias(f"{n}s"), F.col("end").alias(f"{n}e"))
    size = F.least("_ge", "_pe") - F.greatest("_gs", "_ps")
    left = kept(place(gold, "_g").join(place(predicted, "_p"), [*keys, "item"]).withColumn("_o", size).where("_o > 0").select("_g", "_p", "_o", (F.col("_gs") - F.col("_ps")).alias("_d")))
    found = left.select("_g", "_p").limit(0)
    while not left.isEmpty():
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("_o"), F.abs("_d"), "_g", "_p"))
        both = kept(left.withColumn("_1", first("_g")).withColumn("_2", first("_p")).where("_1 = 1 and _2 = 1").select("_g", "_p"))
        found = found.unionByName(both)
        left = kept(left.join(both.select("_g"), "_g", "left_anti").join(both.select("_p"), "_p", "left_anti"))
    return found


def reviewer_eval(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """rv6: one row: n_gold, n_matched, recall over gold blocking items, macro precision over documents, rejection rate of known false positives.

    gold: keys, item, known_false; predicted: keys, item, adjudicated (valid-new is neutral); both may have start and end, where the finding is.
    Findings of one item match one to one: those whose places overlap first, the most overlap first; then, of those left, in order: by place, true
    gold items before known false ones, predictions not adjudicated before others.  The order of rows plays no part: rows that are equal in all this are alike."""
    placed = {"start", "end"} <= set(gold.columns) & set(predicted.columns)
    place = ["start", "end"] if placed else []
    whole = lambda d, own: d.select(*keys, "item", own, *place)
    gold, predicted = whole(gold, "known_false"), whole(predicted, "adjudicated")
    if placed:  # a number for each row, by what it says
        number = lambda d, own: kept(d.withColumn("_id", F.row_number().over(Window.partitionBy(*keys, "item").orderBy("start", "end", own))).withColumn("_id", F.struct(*keys, "item", "_id")))
        gold, predicted = number(gold, "known_false"), number(predicted, "adjudicated")
        pairs = kept(_overlapping(gold, predicted, keys).withColumn("_m", F.struct("_g", "_p")))
        gold = gold.join(pairs.select(F.col("_g").alias("_id"), "_m"), "_id", "left").drop("_id")
        predicted = predicted.join(pairs.select(F.col("_p").alias("_id"), "_m"), "_id", "left").drop("_id")
        one = F.col("_m").isNull()
    else:
        one = F.lit(True)
    mark = F.when(~one, F.xxhash64("_m")) if placed else F.lit(None).cast("long")
    num = lambda d, own: d.withColumn("_x", mark).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "item", "_x").orderBy(*place, F.col(own).asc_nulls_first()))).drop("_m", *place)
    g, p = num(gold, "known_false").withColumn("_g", F.lit(True)), num(predicted, "adjudicated").withColumn("_p", F.lit(True))
    p = p.withColumnsRenamed({c: f"_p_{c}" for c in (*keys, "item", "_x", "_n")})
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in ("_x", "_n")] + [F.col(c) == F.col(f"_p_{c}") for c in (*keys, "item")]
    both = g.join(p, reduce(and_, same), "full").select(*(F.coalesce(c, f"_p_{c}").alias(c) for c in keys), "known_false", "adjudicated", "_g", "_p")
    g, p = or_false(F.col("_g") & ~F.col("known_false")), or_false(F.col("_p"))
    neutral = p & ~g & or_false(F.col("adjudicated") == "valid-new")
    per = both.groupBy(*keys).agg(F.count_if(g & p).alias("tp"), F.count_if(p & ~neutral).alias("np"), F.count_if(g).alias("ng"), F.count_if(or_false(F.col("known_false"))).alias("nf"), F.count_if(or_false(F.col("known_false")) & ~p).alias("rf"))
    share = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return per.agg(F.sum("ng").alias("n_gold"), F.sum("tp").alias("n_matched"), share("tp", "ng").alias("recall"), F.avg(F.when(F.col("np") > 0, F.col("tp") / F.col("np"))).alias("macro_precision"), share("rf", "nf").alias("rejection_rate"))


def lens_coverage(labels: DataFrame) -> DataFrame:
    """rv7: dimension, auto, human, uncovered (shares of its lenses), and results among the applicable: passed, failed, unknown.  labels: dimension, covered_by, applicable, result."""
    n = F.count("*")
    r = lambda x: F.count_if(or_false(F.col("applicable")) & (F.coalesce("result", F.lit("unknown")) == x))
    return labels.groupBy("dimension").agg(*((F.count_if(F.coalesce("covered_by", F.lit("uncovered")) == c) / n).alias(c) for c in ("auto", "human", "uncovered")), r("pass").alias("passed"), r("fail").alias("failed"), r("unknown").alias("unknown"))
