"""Evidence anchors: extraction, coverage, promotion and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: The anchors' forms, a scan's hit, the default heading and promotion phrases, and the form of a finding's id.
ANCHOR = r"(?<![A-Za-z0-9_-])(?:L\d{2,5}(?![\d-])|A[0-9a-f]{12}(?![A-Za-z0-9_-]))"
SCAN_HIT = r"\bHIT line (\d{2,5})\b"
NEW_ISSUES = r"신규\s*쟁점"
PROMOTED = r"\s*(?:으로|로)\s*(?:별도\s*)?승격"
FINDING_ID = r"[A-Z]+\d*-\d+"


def anchor_list(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Distinct anchors of a text, with those of the caller's patterns between ASCII boundaries."""
    found = [F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0))]
    found += [F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_-])(?:{p})(?![A-Za-z0-9_-])"), F.lit(0)) for p in extra]
    return F.array_distinct(F.concat(*found))


def anchors(texts: DataFrame, keys: list[str], text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """an1: keys, anchor, each once."""
    return texts.select(*keys, F.explode(anchor_list(F.col(text_col), extra)).alias("anchor")).distinct()


def scan_anchors(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Anchors that a term scan's hits ask for; line numbers of one digit are none."""
    return texts.select(*keys, F.explode(F.regexp_extract_all(text_col, F.lit(SCAN_HIT), F.lit(1))).alias("_n")).select(*keys, F.concat(F.lit("L"), "_n").alias("anchor")).distinct()


def anchors_after(rows: DataFrame, heading: str = NEW_ISSUES, extra: tuple[str, ...] = ()) -> DataFrame:
    """an2: doc_id, anchor from the first heading line that matches on; from the whole text where there is none."""
    is_it = F.ltrim("line").startswith("#") & F.col("line").rlike(heading)
    start = F.coalesce(F.min(F.when(is_it, F.col("line_no"))).over(Window.partitionBy("doc_id")), F.lit(1))
    return anchors(rows.withColumn("_s", start).where("line_no >= _s"), ["doc_id"], "line", extra)


def _order(anchor: Column) -> list[Column]:
    number = F.regexp_extract(anchor, r"^L(\d+)\z", 1)
    return [F.when(number != "", 0).otherwise(1), number.try_cast("long"), anchor]


def missing_anchors(required: DataFrame, terminal: DataFrame) -> DataFrame:
    """an3: run_id, anchor, pos of anchors (run_id, anchor) that some input asks for and no terminal row has; line anchors first, by number."""
    gone = required.select("run_id", "anchor").distinct().join(terminal.select("run_id", "anchor").distinct(), ["run_id", "anchor"], "left_anti")
    return gone.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy(*_order(F.col("anchor")))))


def anchor_coverage(required: DataFrame, terminal: DataFrame) -> DataFrame:
    """an3: per run n_required, n_missing, lens_files, second_files, and whether fewer second-lens files came than the lenses suggest.
    required: run_id, file, kind (lens, second or scan), anchor."""
    files = required.groupBy("run_id").agg(F.countDistinct("anchor").alias("n_required"), F.countDistinct(F.when(F.col("kind") == "lens", F.col("file"))).alias("lens_files"), F.countDistinct(F.when(F.col("kind") == "second", F.col("file"))).alias("second_files"))
    gone = missing_anchors(required, terminal).groupBy("run_id").agg(F.count("*").alias("n_missing"))
    rounds = F.floor(F.col("lens_files") / 2)
    return files.join(gone, "run_id", "left").na.fill(0, ["n_missing"]).withColumn("partial", (rounds >= 2) & (F.col("second_files") >= 1) & (F.col("second_files") < rounds))


def promotion_check(rows: DataFrame, id_pattern: str = FINDING_ID, phrase: str = PROMOTED, extra: tuple[str, ...] = ()) -> DataFrame:
    """an4: doc_id, line_no, finding, state, multi of every promotion that a line (doc_id, line_no, line) speaks of.

    dangling: no table row has that id; skipped: the line has no anchor or is that row; ok: they share an anchor; violation: they don't.
    multi: the line promotes to several findings."""
    text = strip(F.col("line"))
    said = rows.select("doc_id", "line_no", text.alias("said"), anchor_list(F.col("line"), extra).alias("own"), F.array_distinct(F.regexp_extract_all("line", F.lit(f"({id_pattern}){phrase}"), F.lit(1))).alias("ids"))
    said = said.where(F.size("ids") > 0).select("*", F.explode("ids").alias("finding"))
    cell = F.regexp_replace(F.btrim(F.get(F.split(text, r"\|"), F.lit(1))), r"^[*` ]+|[*` ]+$", "")
    table = rows.where(text.startswith("|") & (F.size(F.split(text, r"\|")) >= 3)).select("doc_id", cell.alias("finding"), text.alias("row"), anchor_list(F.col("line"), extra).alias("has"))
    table = table.where(F.col("finding").rlike(rf"^(?:{id_pattern})\z")).groupBy("doc_id", "finding").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"), F.collect_set("row").alias("rows"))
    both = said.join(table, ["doc_id", "finding"], "left")
    itself = F.exists("rows", lambda r: F.contains(r, F.col("said")))
    state = F.when(F.col("rows").isNull(), "dangling").when((F.size("own") == 0) | itself, "skipped").when(F.arrays_overlap("own", "has"), "ok").otherwise("violation")
    return both.select("doc_id", "line_no", "finding", state.alias("state"), (F.size("ids") > 1).alias("multi"))


def resolve_anchors(found: DataFrame, rows: DataFrame) -> DataFrame:
    """an5: doc_id, anchor, line, dangling: the line that each line anchor cites, or none."""
    cited = found.select("doc_id", "anchor", F.regexp_extract("anchor", r"^L(\d+)\z", 1).try_cast("int").alias("line_no")).where("line_no is not null")
    return cited.join(rows.select("doc_id", "line_no", "line"), ["doc_id", "line_no"], "left").select("doc_id", "anchor", "line", F.col("line").isNull().alias("dangling"))
