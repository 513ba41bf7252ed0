"""What the operators share: the cluster's shared folder, and text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast (of 150 bytes at most: 15 MB); rows from which on a key is hot, or this share of all rows if that is more.
FEW, HOT, SHARE = 100_000, 1000, 1e-4
#: Words of the contracts: runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, one of our own on a local master; a cluster must name it."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and lost executors cost no recomputation."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, small: DataFrame, keys: list[str], count: str, spread: str, how: str = "left", few: int = FEW, hot: int = HOT) -> DataFrame:
    """``rows`` joined with a settled table of one small row for each key, which holds the number of the key's rows in ``count``.

    Few keys are broadcast.  Of more, those with over ``hot`` rows and over SHARE of all rows (10,000 keys at most) are dealt over as many
    tasks as they hold that many rows, by the column ``spread``, so no key's rows meet in one task."""
    n, total = small.agg(F.count("*"), F.sum(count)).first()
    if n <= few:
        return rows.join(F.broadcast(small.drop(count)), keys, how)
    each = max(hot, int((total or 0) * SHARE))
    sized = small.withColumn("part_count", F.ceil(F.col(count) / each)).drop(count)
    heads = F.broadcast(sized.where("part_count > 1").select(*keys, "part_count"))
    dealt = rows.join(heads, keys, "left").withColumn("part_no", F.coalesce(F.pmod(F.xxhash64(spread), F.col("part_count")), F.lit(0))).drop("part_count")
    copied = sized.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part_count") - 1))).drop("part_count")
    return dealt.join(copied, [*keys, "part_no"], how).drop("part_no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Documents of which nothing is learned: crc32 of the id's text, modulo 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
