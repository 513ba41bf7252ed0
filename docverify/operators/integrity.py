"""Digests, inventories, seals and ports."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate_digest(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """in1: keys, digest, n_files: one sha256 per run over its files' path, bytes and hash, in the order of the paths' bytes.

    A run's rows are sorted in one task, on disk if need be, and go through one hash as they come, so memory stays bounded however many they are.
    Files that are repeated count each; a file without a path, size or hash is counted and not hashed.  ``tree_digest`` deals a run over tasks."""
    line = F.concat("path", F.lit("\0"), F.col("bytes").cast("string"), F.lit("\0"), "sha256", F.lit("\n")).cast("binary")
    own = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    names = [f"_k{n}" for n in range(len(keys))]
    rows = inventory.select(*own, F.col("path").alias("_p"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), line.alias("_line"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "_p", "_b", "_s").select(*names, "_line")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n, kinds = None, sha256(), 0, None

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(run, kinds, strict=True)), pa.array([held.hexdigest()]), pa.array([n], pa.int64())], [*names, "digest", "n_files"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in names]
            columns = [batch.column(k).to_pylist() for k in names]
            for at, text in enumerate(batch.column("_line").to_pylist()):
                now = tuple(c[at] for c in columns)
                if now != run:
                    if run is not None:
                        yield give()
                    run, held, n = now, sha256(), 0
                held.update(text or b"")
                n += 1
        if run is not None:
            yield give()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_line")
    return rows.mapInArrow(digests, f"{fields}, digest string, n_files long").withColumnsRenamed(dict(zip(names, keys, strict=True)))


def tree_digest(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest, n_files of runs of any size, as a tree: files are parted by the first four hex digits of the sha256 of their path, and a part's
    digest is that of in1; parts are joined by their first two digits, and these to the run's digest, each time one sha256
    over the parts' name, count and digest in the order of names.  A task holds a 65,536th of a run's files."""
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n_files", "digest"))), lambda x: F.concat(x["part"], F.lit("\0"), x["n_files"].cast("string"), F.lit("\0"), x["digest"], F.lit("\n"))), ""), 256)
    rows = aggregate_digest(inventory.withColumn("part", F.substring(F.sha2("path", 256), 1, 4)), [*keys, "part"])
    rows = rows.withColumn("up", F.substring("part", 1, 2)).groupBy(*keys, "up").agg(node.alias("digest"), F.sum("n_files").alias("n_files")).withColumnRenamed("up", "part")
    return rows.groupBy(*keys).agg(node.alias("digest"), F.sum("n_files").alias("n_files"))


def inventory_diff(recorded: DataFrame, current: DataFrame, keys: list[str], mutable: str | None = None) -> DataFrame:
    """in2: keys, path, change: missing, extra or changed; paths under ``mutable`` are left out."""
    side = lambda d, n: d.select(*keys, "path", F.struct("bytes", "sha256").alias(n))
    both = side(recorded, "a").join(side(current, "b"), [*keys, "path"], "full")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    rows = both.withColumn("change", change).where("change is not null")
    return (rows.where(~F.col("path").startswith(mutable)) if mutable else rows).select(*keys, "path", "change")


def capture_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """in3: what differs between two readings of one tree."""
    return inventory_diff(before, after, keys)


def seal(payloads: DataFrame, seals: DataFrame, at: str) -> DataFrame:
    """in4: new seals (key, sha256, length, sealed_at) of payloads (key, payload); what is sealed already is refused, so left out."""
    new = payloads.join(seals.select("key").distinct(), "key", "left_anti")
    return new.select("key", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("length"), F.lit(at).alias("sealed_at"))


def verify_seal(payloads: DataFrame, seals: DataFrame) -> DataFrame:
    """in4: key, state of each seal: intact, mismatch, malformed, or missing where its payload is gone."""
    both = seals.join(payloads, "key", "left")
    good = F.col("sha256").rlike(r"^[0-9a-f]{64}\z") & (F.col("length") >= 0)
    same = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("length"))
    return both.select("key", F.when(~F.coalesce(good, F.lit(False)), "malformed").when(F.col("payload").isNull(), "missing").when(same, "intact").otherwise("mismatch").alias("state"))


def port_drift(rows: DataFrame, upstream: DataFrame, downstream: DataFrame) -> DataFrame:
    """in5: path, state of port rows (path, upstream_path, upstream_sha, downstream_sha) against files (path, sha256) on both sides; files of
    downstream that no row covers are reported too."""
    up = upstream.select(F.col("path").alias("upstream_path"), F.col("sha256").alias("_u"))
    both = rows.join(up, "upstream_path", "left").join(downstream.select("path", F.col("sha256").alias("_d")), "path", "left")
    good = F.col("upstream_sha").rlike(r"^[0-9a-f]{64}\z") & F.col("downstream_sha").rlike(r"^[0-9a-f]{64}\z") & F.col("upstream_path").isNotNull()
    states = F.array_compact(F.when(~F.coalesce(good, F.lit(False)), F.array(F.lit("malformed"))).otherwise(F.array(
        F.when(F.col("_u").isNull(), "missing_upstream").when(F.col("_u") != F.col("upstream_sha"), "stale_upstream"),
        F.when(F.col("_d").isNull(), "missing_downstream").when(F.col("_d") != F.col("downstream_sha"), "stale_downstream"),
    )))
    bare = downstream.join(rows.select("path").distinct(), "path", "left_anti").select("path", F.lit("uncovered").alias("state"))
    return both.select("path", F.explode(states).alias("state")).unionByName(bare)


def dedupe_materials(materials: DataFrame, refs: DataFrame) -> DataFrame:
    """in6: sha256, sources (sorted ids), n, unused, one row for each content; materials: material_id, sha256; refs: material_id."""
    used = refs.select("material_id").distinct().withColumn("_u", F.lit(True))
    return materials.join(used, "material_id", "left").groupBy("sha256").agg(F.array_sort(F.collect_set("material_id")).alias("sources"), F.count("*").alias("n"), (~F.coalesce(F.bool_or("_u"), F.lit(False))).alias("unused"))
