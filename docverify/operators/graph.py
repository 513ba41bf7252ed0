"""Loops over tables of edges.  Each round is written to the checkpoint folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.  Where that is unset, one of our own on a local master; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed and cut from its lineage in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


#: Edges of a graph up to which one task holds them; larger graphs go by rounds.
HELD = 100_000
#: Rows in a batch that leaves a task.
BATCH = 10_000
#: Layers that are peeled off a graph before its chains are shortened as well.
PEEL = 8


def _shortened(edges: DataFrame, keys: list[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """Takes nodes out of chains: of those with one edge in and one out, the ones whose hash is less than that of such neighbours, about a
    third.  Returns the edges (keys, a, b, w), two by a taken node now one of their joint length, and the nodes taken (keys, node, a, b, wa, wb)."""
    into = edges.groupBy(*keys, F.col("b").alias("node")).agg(F.count("*").alias("_n"), F.min("a").alias("a"), F.min("w").alias("wa")).where("_n = 1")
    out = edges.groupBy(*keys, F.col("a").alias("node")).agg(F.count("*").alias("_n"), F.min("b").alias("b"), F.min("w").alias("wb")).where("_n = 1")
    plain = into.drop("_n").join(out.drop("_n"), [*keys, "node"]).where("a <> node").withColumn("_h", F.xxhash64("node", F.lit(turn)))
    links = plain
    for side in ("a", "b"):
        links = links.join(plain.select(*keys, F.col("node").alias(side), F.col("_h").alias(f"_{side}")), [*keys, side], "left")
    least = [F.coalesce(F.col("_h") < F.col(side), F.lit(True)) for side in ("_a", "_b")]
    gone = kept(links.where(least[0] & least[1]).select(*keys, "node", "a", "b", "wa", "wb"))
    rest = edges
    for side in ("a", "b"):
        rest = rest.join(gone.select(*keys, F.col("node").alias(side)), [*keys, side], "left_anti")
    rest = rest.select(*keys, "a", "b", "w").unionByName(gone.select(*keys, "a", "b", (F.col("wa") + F.col("wb")).alias("w")))
    return kept(rest.groupBy(*keys, "a", "b").agg(F.max("w").alias("w"))), gone


def _farthest(edges: DataFrame, keys: list[str], turn: int) -> DataFrame:
    """keys, node, label (its hash in this turn, and the node): the node of greatest hash from which a node can be reached, itself included.  Labels pass along edges, and a label's own label is taken over, until none changes."""
    ends = edges.select(*keys, F.col("a").alias("node")).unionByName(edges.select(*keys, F.col("b").alias("node"))).distinct()
    now = kept(ends.withColumn("label", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("node"))))
    while True:
        came = edges.select(*keys, "a", "b").join(now.select(*keys, F.col("node").alias("a"), "label"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(F.max("label").alias("_m"))
        met = now.join(came, [*keys, "node"], "left").select(*keys, "node", "label", F.greatest("label", "_m").alias("_n"))
        up = now.select(*keys, F.col("node").alias("_to"), F.col("label").alias("_u"))
        after = kept(met.withColumn("_to", F.col("_n.node")).join(up, [*keys, "_to"]).select(*keys, "node", F.greatest("_n", "_u").alias("_n"), "label"))
        changed = not after.where(F.col("_n") != F.col("label")).isEmpty()
        now = after.select(*keys, "node", F.col("_n").alias("label"))
        if not changed:
            return now


def _strong(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of strongly connected components, by colouring forwards and backwards.

    A node's colour is the node of greatest hash that reaches it.  No node of a colour has a greater one than the colour's own; so those
    from which, within the colour, that node can be reached are its component.  They go, and the rest is coloured anew by other
    hashes, so turns grow with the logarithm of a chain of components."""
    found, turn = None, 0
    left = kept(edges.select(*keys, "a", "b").distinct())
    while not left.isEmpty():
        turn += 1
        colour = _farthest(left, keys, turn)
        side = lambda c: colour.select(*keys, F.col("node").alias(c), F.col("label").alias(f"_{c}"))  # noqa: E731, B023
        within = kept(left.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where("_a = _b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        back = _farthest(within, keys, turn).withColumnRenamed("label", "_back")
        roots = colour.where("node = label.node").select(*keys, "node", F.col("node").alias("component"))
        own = kept(colour.join(back, [*keys, "node"]).where("_back = label").select(*keys, "node", F.col("label.node").alias("component")).unionByName(roots).distinct())
        found = own if found is None else found.unionByName(own)
        for c in ("a", "b"):
            left = left.join(own.select(*keys, F.col("node").alias(c)), [*keys, c], "left_anti")
        left = kept(left)
    return found


def _peeled(edges: DataFrame, keys: list[str], a: str, b: str) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (keys, a, b, w) that are left when nodes without an edge in or out are taken away again and again, and the nodes taken out of chains on the way.

    After ``PEEL`` layers chains are shortened too, so rounds grow with the logarithm of a chain's length."""
    rest = kept(edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1).alias("w")).where("a is not null and b is not null").distinct())
    n, turn, taken = rest.count(), 0, []
    while n:
        into = rest.select(*keys, F.col("b").alias("a")).distinct()
        out = rest.select(*keys, F.col("a").alias("b")).distinct()
        rest = kept(rest.join(into, [*keys, "a"], "left_semi").join(out, [*keys, "b"], "left_semi"))
        if (now := rest.count()) == n:
            break
        n, turn = now, turn + 1
        if n and turn >= PEEL:
            rest, gone = _shortened(rest, keys, turn)
            taken.append(gone)
            n = rest.count()
    return rest, taken


def _turns(edges: Iterable[tuple[object, object]]) -> bool:
    """Whether one graph has a cycle: nodes without an edge in are taken away until none is left."""
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into[b] = into.get(b, 0) + 1
    free = [a for a in out if a not in into]
    while free:
        for b in out.pop(free.pop(), ()):
            into[b] -= 1
            if not into[b]:
                free.append(b)
    return bool(out)


def _turning(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the graphs with a cycle, of whole graphs of edges (keys, a, b), each in one task: rows come sorted by graph."""
    schema = edges.select(*keys).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [f.type for f in batch.schema][: len(keys)]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def found() -> Iterator[tuple]:
            for key, own in groupby(rows(), itemgetter(slice(len(keys)))):
                if _turns((a, b) for *_, a, b in own):
                    yield key

        whole = found()
        while part := list(islice(whole, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=list(keys))

    return edges.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(find, schema)


def with_cycles(edges: DataFrame, keys: list[str], a: str, b: str, most: int = HELD) -> DataFrame:
    """keys of the graphs that have a cycle.  Graphs are counted first: those of up to ``most`` edges are searched whole, each in one task, larger ones by rounds."""
    whole = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    large = kept(whole.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    if large.isEmpty():
        return _turning(whole, keys)
    rest = _peeled(whole.join(large, keys, "left_semi"), keys, "a", "b")[0].select(*keys).distinct()
    return _turning(whole.join(large, keys, "left_anti"), keys).unionByName(rest)


def on_cycles(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, node of the nodes on a cycle, of one edge or more.  What peeling leaves lies on cycles or between them; strongly connected components part these."""
    rest, taken = _peeled(edges, keys, a, b)
    if rest.isEmpty():
        return rest.select(*keys, F.col("a").alias("node"))
    of = kept(_strong(rest, keys))

    def inside(rows: DataFrame) -> DataFrame:
        """Rows whose edge from a to b lies in one component."""
        side = lambda c: of.select(*keys, F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        return rows.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where("_a = _b")

    own = kept(inside(rest))
    left = own.select(*keys, F.col("a").alias("node")).unionByName(own.select(*keys, F.col("b").alias("node"))).distinct()
    for gone in reversed(taken):  # a node taken out of a chain lies on a cycle where the edge that stood for it does
        back = kept(inside(gone).select(*keys, "node", F.col("_a").alias("component")))
        of = kept(of.unionByName(back))
        left = left.unionByName(back.select(*keys, "node"))
    return left.distinct()


def followed(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, a, root: where each node ends up along its one edge, by pointer jumping; nodes on a cycle have no root."""
    now = kept(edges.groupBy(*keys, F.col(a).alias("a")).agg(F.min(b).alias("r")).withColumn("end", F.lit(False)))
    left = now.where("not end").count()
    while left:
        other = now.select(*keys, F.col("a").alias("r"), F.col("r").alias("_r"), F.col("end").alias("_e"))
        now = kept(now.join(other, [*keys, "r"], "left").select(*keys, "a", F.coalesce("_r", "r").alias("r"), F.coalesce("_e", F.lit(True)).alias("end")))
        before, left = left, now.where("not end").count()
        if left == before:  # each step ends some node of a chain; what is left runs into a cycle
            break
    return now.where("end").select(*keys, "a", F.col("r").alias("root"))


def classes(links: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, node, label (least node reachable): labels pass along links, and labels of labels are taken over, until none changes."""
    pairs = links.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = kept(pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = kept(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        met = now.join(near, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "_m").alias("_n"))
        up = now.select(*keys, F.col("node").alias("_n"), F.col("label").alias("_u"))
        after = kept(met.join(up, [*keys, "_n"], "left").select(*keys, "node", F.least("_n", "_u").alias("_n"), "label"))
        changed = not after.where(F.col("_n") != F.col("label")).isEmpty()
        now = after.select(*keys, "node", F.col("_n").alias("label"))
        if not changed:
            return now


def levels(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str, needs: str) -> DataFrame:
    """keys, node, level: 0 without a need, else one more than the highest need; nodes on or behind a cycle, or an unknown need, have none.

    After ``PEEL`` levels chains are shortened too, so rounds grow with the logarithm of a chain's length."""
    left = kept(edges.select(*keys, F.col(node).alias("a"), F.col(needs).alias("b"), F.lit(1).alias("w")).distinct())
    done = kept(nodes.select(*keys, F.col(node).alias("node")).distinct().join(left.select(*keys, F.col("a").alias("node")).distinct(), [*keys, "node"], "left_anti").withColumn("level", F.lit(0)))
    turn, taken = 0, []
    while not left.isEmpty():
        met = left.join(done.withColumnRenamed("node", "b"), [*keys, "b"], "left").groupBy(*keys, F.col("a").alias("node"))
        ready = kept(met.agg(F.max(F.col("level") + F.col("w")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("_k")).where("_k").drop("_k"))
        if ready.isEmpty():
            break
        done, left, turn = done.unionByName(ready), kept(left.join(ready.select(*keys, F.col("node").alias("a")), [*keys, "a"], "left_anti")), turn + 1
        if turn >= PEEL:
            left, gone = _shortened(left, keys, turn)
            taken.append(gone)
    for gone in reversed(taken):
        back = gone.join(done.withColumnRenamed("node", "b"), [*keys, "b"]).select(*keys, "node", (F.col("level") + F.col("wb")).alias("level"))
        done = done.unionByName(kept(back))
    return done


def or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
