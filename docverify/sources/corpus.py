"""Reading a corpus, its inventory, publishing pages, and snapshots that are written once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import tree_digest

#: The file that makes a run complete.
RECORD = "COMPLETE.json"


def read_corpus(spark: SparkSession, path: str, fmt: str = "binaryFile", id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """io1: documents (doc_id, path, text, sha256, n_bytes, valid) from files, or from a table of any Spark format.

    Content that isn't UTF-8 keeps its row, with ``valid`` false and its faulty bytes replaced."""
    rows = spark.read.format(fmt).load(path)
    if fmt == "binaryFile":
        return rows.select(F.col("path").alias("doc_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_bytes"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    return from_table(rows, id_col or rows.columns[0], text_col)


def from_table(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents from any frame; ``path`` is the id's text."""
    text = F.col(text_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("path"), text.alias("text"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("n_bytes"), F.is_valid_utf8(text).alias("valid"))


def file_inventory(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """io2: path, bytes, sha256 with the run's keys; a path sorts by its UTF-8 bytes, which is Spark's order of strings."""
    return docs.select(*(keys or []), "path", F.col("n_bytes").alias("bytes"), "sha256")


def publish_pages(plan: DataFrame, blocks: DataFrame, header: str = "<!-- generated page, do not edit -->") -> DataFrame:
    """io3: a page per document from its included sections in plan order, each with its block.

    plan: doc_id, pos, title_key, action, page_pattern, product, feature, title; blocks: doc_id, title_key, block.  Adds the page's name,
    made safe as a file name, and whether a token of the pattern was left unfilled."""
    body = plan.where("action = 'included'").join(blocks, ["doc_id", "title_key"]).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "").alias("body"), F.count("*").alias("n_sections"),
        *(F.first(c, ignorenulls=True).alias(c) for c in ("page_pattern", "product", "feature", "title")),
    )
    fallback = F.coalesce("title", "product", F.lit("document"))
    filled = F.col("page_pattern")
    for token, value in (("{product}", F.coalesce("product", F.lit(""))), ("{feature}", F.coalesce("feature", "title", F.lit(""))), ("{title}", fallback)):
        filled = F.replace(filled, F.lit(token), value)
    name = F.when(F.coalesce(F.btrim(filled), F.lit("")) == "", fallback).otherwise(F.btrim(filled))
    safe = F.regexp_replace(F.btrim(F.translate(name, "/\\\x00", "__")), r"^\.+", "")
    return body.select("doc_id", F.concat(F.lit(header + "\n"), "body").alias("page"), "n_sections", F.when(safe == "", "untitled").otherwise(safe).alias("file_name"), F.regexp_like(name, F.lit(r"\{[A-Za-z_]+\}")).alias("leftover_token"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Regenerates all pages, a folder for each page name."""
    pages.write.mode("overwrite").partitionBy("file_name").parquet(path)


class SnapshotError(ValueError):
    """A run that is there already, isn't complete, or isn't what its record says."""


def stored_inventory(rows: DataFrame) -> DataFrame:
    """path, bytes and sha256 of documents by their texts as they are, whatever columns of that kind the rows bring."""
    return rows.select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def _file(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path, so any store that Spark reads will do."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _digest(rows: DataFrame, run_id: str, inventory: Callable[[DataFrame], DataFrame]) -> tuple[str | None, int]:
    found = tree_digest(inventory(rows).withColumn("run_id", F.lit(run_id)), ["run_id"]).first()
    return (found["digest"], found["n_files"]) if found else (None, 0)


def write_snapshot(rows: DataFrame, path: str, run_id: str, inventory: Callable[[DataFrame], DataFrame] = stored_inventory) -> DataFrame:
    """io4: publishes a run once and returns run_id, digest, n_files; an id that is taken is an error.

    Rows go to a folder of this attempt; their digest is that of what was stored, read again.  The run's one record, with the digest and
    the attempt's name, is written last, by a create that fails where the file exists: of several writers one wins, the others' rows are
    taken away, and what was left half-written has no record."""
    spark, record = rows.sparkSession, f"{path}/{run_id}/{RECORD}"
    fs, at = _file(spark, record)
    if fs.exists(at):
        raise SnapshotError(f"{run_id} is published already")
    attempt = f"attempt-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{path}/{run_id}/{attempt}")
    digest, n = _digest(spark.read.schema(rows.schema).parquet(f"{path}/{run_id}/{attempt}"), run_id, inventory)
    text = json.dumps({"run_id": run_id, "rows": attempt, "digest": digest, "n_files": n, "end": True})
    try:
        out = fs.create(at, False)
    except Py4JJavaError as taken:
        fs.delete(_file(spark, f"{path}/{run_id}/{attempt}")[1], True)
        raise SnapshotError(f"{run_id} was published meanwhile") from taken
    out.write(bytearray(text.encode()))
    out.close()
    return spark.createDataFrame([(run_id, digest, n)], "run_id string, digest string, n_files long")


def read_snapshot(spark: SparkSession, path: str, run_id: str, inventory: Callable[[DataFrame], DataFrame] = stored_inventory) -> DataFrame:
    """io4: rows of a complete run; one without a whole record, or whose rows don't give the record's digest and number, is an error."""
    fs, at = _file(spark, f"{path}/{run_id}/{RECORD}")
    if not fs.exists(at):
        raise SnapshotError(f"{run_id} has no record: it is not there or not complete")
    try:
        record = json.loads("".join(r[0] for r in spark.read.text(f"{path}/{run_id}/{RECORD}").collect()))
        same = record["run_id"] == run_id and record["end"] is True
    except (ValueError, KeyError, TypeError) as broken:
        raise SnapshotError(f"the record of {run_id} is broken off") from broken
    if not same:
        raise SnapshotError(f"the record of {run_id} speaks of another run")
    if not fs.exists(_file(spark, f"{path}/{run_id}/{record['rows']}/_SUCCESS")[1]):
        raise SnapshotError(f"the rows of {run_id} are not complete")
    rows = spark.read.parquet(f"{path}/{run_id}/{record['rows']}")
    if _digest(rows, run_id, inventory) != (record["digest"], record["n_files"]):
        raise SnapshotError(f"the rows of {run_id} are not those of its record")
    return rows
