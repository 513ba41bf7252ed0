"""Near-duplicate documents by a chosen-path forest over minwise hashes.

Documents with equal shingle sets are one class from the start.  In each tree of the forest a node picks one or two
positions of the minhash signature by its own hash, and sends each of its documents to the child named by the value there:
similar documents agree at most positions and walk together, others part.  Paths depend on the document alone, so
several levels are walked in one pass.  Then nodes are counted:

* nodes of one document are done;
* in every other node each document is compared with the node's least one, and what is linked is contracted;
* nodes whose documents are all linked are done, however large;
* in small nodes that are left each document is held against the most alike of another class (in nodes over 1,024 documents, of its
  own block of the node: this only saves work), and after that documents that still have a likely partner in another class are
  compared exhaustively, with their full sets, inside the node;
* large ones branch further, and their documents start as many further trees, on positions that no tree has used, as that depth asks for;
* what is compared exhaustively is first cut into blocks where it is over 2,048 documents, or over HEAVY shingles, and every two blocks are
  a node of their own, so neither a task's work nor its memory grows with a node; after the last pass that is all that is left, whatever its size.

Pairs are held against their signatures first, then against the full shingle sets, and only the latter makes a link.
No step emits the pairs of a node: rows and links grow with the documents, however large a group is.
All of the first 16 trees pick from the same 64 positions.  By calculation (``missed``) a pair of similarity 0.8 shares no node of theirs after
three levels in about six of a million cases; where nodes branch on, further trees hold that below MISS at each depth.  Its signatures
fall short once in some thirty thousand times; more similar pairs are missed less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, settled
from .components import components
from .shingles import U, minhash, minhash_factors, mixed, shingle_sets

#: Signature positions that trees branch by, and those that similarity is estimated by (of these a byte each is kept), trees, levels walked in one pass, documents up to which a node is compared exhaustively, and up to which a task takes it whole.
POSITIONS, MARKS, TREES, LEVELS, SMALL, WHOLE = 64, 256, 16, 3, 4096, 2048
#: Shingles up to which a node's full sets are held by one task (32 MB, and about six times that while they are counted), and two documents.
HEAVY = 4_000_000
#: A node takes a second position this often; four standard errors of the signature below the least similarity.
SECOND, SLACK = 0.25, 0.1
#: Chance at most that a pair of the least similarity shares no node at a depth that nodes branch to.
MISS = 1e-5
#: Passes after which a node is compared exhaustively, block by block, whatever its size; ids up to which the scan for full sets gets them by broadcast (8 MB).
PASSES, FEW = 8, 500_000


def walk(nodes: np.ndarray, rows: np.ndarray, signatures: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and row numbers some levels further down."""
    k = signatures.shape[1]
    for _ in range(levels):
        pick = mixed(nodes ^ U(0x9E3779B97F4A7C15))
        first, second = pick % U(k), (pick >> U(20)) % U(k)
        more = ((pick >> U(40)) < U(int(SECOND * (1 << 24)))) & (second != first)
        nodes, rows, at = np.concatenate([nodes, nodes[more]]), np.concatenate([rows, rows[more]]), np.concatenate([first, second[more]]).astype(np.int64)
        nodes = mixed(nodes * U(0xD6E8FEB86659FD93) + (at.astype(U) << U(32)) + signatures[rows, at].astype(U))
    return nodes, rows


def missed(similarity: float, depth: int, trees: int, positions: int) -> float:
    """Chance that a pair shares no node of some trees at a depth, which all pick from the same positions.

    Given the share of positions at which the pair agrees, trees are independent, and a node's children die out alike."""
    agree = np.arange(positions + 1)
    share = agree / positions
    gone = np.zeros(positions + 1)
    for _ in range(depth):
        one = 1 - share + share * gone
        gone = (1 - SECOND) * one + SECOND * one * one
    chance = np.array([float(comb(positions, k)) for k in agree]) * similarity**agree * (1 - similarity) ** (positions - agree)
    return float((chance * gone**trees).sum())


@cache
def further(similarity: float, depth: int, trees: int) -> int:
    """Trees on fresh positions that hold the chance of a miss at a depth to MISS, beside the first ones."""
    low, high = -1, 1
    left = MISS / missed(similarity, depth, trees, POSITIONS)
    while missed(similarity, depth, high, MARKS - POSITIONS) > left:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if missed(similarity, depth, middle, MARKS - POSITIONS) <= left else (middle, high)
    return high


def _matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def signatures(docs: DataFrame, width: int, positions: int = POSITIONS, marks: int = MARKS) -> DataFrame:
    """id, text_key (a hash of the text), n (shingles), k1, k2 (a key of the set), sig (the first positions in full) and marks (a byte of every position) of rows (id, text)."""
    factors = minhash_factors(marks)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                keys = np.array([[int(s.sum(dtype=U)), int(mixed(s ^ U(0x5555)).sum(dtype=U))] for s in sets], U).view(np.int64).reshape(-1, 2)
                least = [minhash(s, factors) for s in sets]
                cells = [[len(s) for s in sets], keys[:, 0], keys[:, 1], [x[:positions].astype("<u4").tobytes() for x in least], [x.astype(np.uint8).tobytes() for x in least]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], ["id", "text_key", "n", "k1", "k2", "sig", "marks"])

    return docs.select("id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(sign, "id long, text_key long, n long, k1 long, k2 long, sig binary, marks binary")


def _branch(rows: DataFrame, levels: int, trees: range | None = None, fresh: bool = False) -> DataFrame:
    """node and id of rows (id, sig), from the roots of the trees, or (id, sig, node) from where they are.

    Nodes of fresh trees are odd, those of the first trees even; fresh positions are a byte each."""
    many = (len(trees) if trees else 1) * (1 + SECOND) ** levels
    size = max(1, min(2048, int(65536 / many)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                sigs = _matrix(part.column("sig"), "u1" if fresh else "<u4")
                own = np.arange(len(sigs))
                if trees is None:
                    start = np.array(part.column("node").to_pylist(), np.int64).view(U)
                else:
                    start, own = np.repeat(mixed(np.arange(trees.start + 1, trees.stop + 1, dtype=U)), len(sigs)), np.tile(own, len(trees))
                nodes, at_row = walk(start, own, sigs, levels)
                nodes = nodes | U(1) if fresh else nodes & ~U(1)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), part.column("id").take(pa.array(at_row))], ["node", "id"])

    return rows.mapInArrow(step, "node long, id long")


def _blocks(rows: DataFrame, small: int) -> DataFrame:
    """node, id and label of rows (node, id, label, size), with nodes over ``small`` cut into blocks of half that many documents: every two blocks are a node."""
    large = F.col("size") > small
    count = F.ceil(F.col("size") * 2 / small)
    cut = rows.where(large).withColumns({"count": count, "own": F.pmod(F.xxhash64("id"), count)}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).where("own <> other")
    return rows.where(~large).select("node", "id", "label").unionByName(cut.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "label"))


def _light(rows: DataFrame, heavy: int) -> DataFrame:
    """node, id and label of rows (node, id, label, n), of nodes of bounded size: nodes with over ``heavy`` shingles are cut into blocks of half
    that many and one document at most, filled in the order of ids; every two blocks are a node."""
    node = Window.partitionBy("node")
    before = F.coalesce(F.sum("n").over(node.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("half", F.when(F.sum("n").over(node) > heavy, F.floor(before * 2 / heavy)).otherwise(0))
    cut = cut.withColumn("own", F.dense_rank().over(node.orderBy("half")).cast("long") - 1).withColumn("count", F.max("own").over(node) + 1)
    paired = cut.where("count > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).where("own <> other")
    return cut.where("count = 1").select("node", "id", "label").unionByName(paired.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "label"))


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column("sa"), "u1") == _matrix(batch.column("sb"), "u1")).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in "ab"], ["a", "b"])

    side = lambda x: sigs.select(F.col("id").alias(x), F.col("marks").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(agree, "a long, b long")


def _across(rows: DataFrame, least: float) -> DataFrame:
    """For each document its node, id and most alike one (other) of another label in that node, if their signatures agree often enough;
    rows: node, id, label, marks, of nodes of bounded size.

    A node's documents are held against each other where they are: a row leaves the task for each, not for each pair."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _nodes(batches, ["node", "id", "label"], "marks"):
            name, ids, label, data = node
            marks = np.frombuffer(b"".join(data), np.uint8).reshape(len(ids), -1)
            for i in range(0, len(ids), 64):
                part = slice(i, i + 64)
                if len(ids) <= 64:
                    same = (marks[part, None, :] == marks[None, :, :]).sum(axis=2, dtype=np.int16)
                else:
                    same = np.zeros((len(ids[part]), len(ids)), np.int16)
                    for k in range(marks.shape[1]):
                        same += marks[part, k, None] == marks[None, :, k]
                same[label[part, None] == label[None, :]] = -1
                other = same.argmax(axis=1)
                near = np.flatnonzero(same[np.arange(len(other)), other] >= least * marks.shape[1])
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name[part][near], ids[part][near], ids[other[near]])], ["node", "id", "other"])

    return rows.select("node", "id", "label", "marks").repartition("node").sortWithinPartitions("node").mapInArrow(hold, "node long, id long, other long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, n (shingles) and own (the full set, sorted) of the wanted ids; settled."""
    wanted = settled(wanted.distinct(), "dup-wanted")
    few = wanted.count() <= FEW

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "own"])

    return settled(docs.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInArrow(whole, "id long, n long, own binary"), "dup-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of settled pairs (a, b) those with 100 * intersection >= percent * union of their full sets."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("oa"), batch.column("ob"), strict=True):
                p, q = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), width)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("own").alias(f"o{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(hold, "a long, b long").distinct()


def _exact(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of different labels in one node, by the full sets; rows: node, id, label, own, of nodes of bounded size.
    What a node has linked already is one label from then on, so a node gives fewer links than it has documents.

    Each document's set is marked in the node's vocabulary and counted in all others at once."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _nodes(batches, ["id", "label"], "own"):
            ids, label, own = node
            label = label.copy()
            sets = [np.frombuffer(x, U) for x in own]
            sizes = np.array([len(x) for x in sets])
            words, at = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            found = []
            for i in range(len(sets) - 1):
                if (label[i + 1 :] == label[i]).all():
                    continue
                mark = np.zeros(len(words), np.int32)
                mark[at[starts[i] : starts[i] + sizes[i]]] = 1
                both = np.add.reduceat(mark[at[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
                for j in np.flatnonzero((100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)) & (label[i + 1 :] != label[i])) + i + 1:
                    if label[j] != label[i]:
                        found.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.select("node", "id", "label", "own").repartition("node").sortWithinPartitions("node").mapInArrow(hold, "a long, b long").distinct()


def _nodes(batches: Iterator[pa.RecordBatch], numbers: list[str], data: str) -> Iterator[list]:
    """Node by node the columns of number and the one of bytes, from batches that are sorted by node."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            parts = [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for part in parts if batch is not None else [None]:
            if rest and (part is None or part.column("node")[0] != rest[0].column("node")[0]):
                if sum(r.num_rows for r in rest) > 1:
                    yield [np.concatenate([r.column(c).to_numpy() for r in rest]) for c in numbers] + [[x for r in rest for x in r.column(data).to_pylist()]]
                rest = []
            if part is not None:
                rest.append(part)


def linked_classes(docs: DataFrame, sigs: DataFrame, width: int, percent: int, trees: int = TREES, levels: int = LEVELS, small: int = SMALL, passes: int = PASSES, whole: int = WHOLE, heavy: int = HEAVY) -> DataFrame:
    """id and label of those of the rows (id, sig, marks) that a link joins to another; docs: (id, text)."""
    least = percent / 100 - SLACK
    labels = docs.sparkSession.createDataFrame([], "id long, label long")
    frontier = _branch(sigs.select("id", "sig"), levels, range(trees))
    marks = sigs.select("id", "marks")
    unused = marks.select("id", F.substring("marks", POSITIONS + 1, MARKS).alias("sig"))
    grown = trees

    def taken(found: DataFrame) -> None:
        """Links join what is linked already: each class is one node of the new graph."""
        nonlocal labels
        found = settled(found, "dup-links")
        root = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        new = settled(found.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "dup-new")
        if not new.isEmpty():
            joined = components(new).select(F.col("id").alias("label"), F.col("label").alias("to"))
            known = labels.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            fresh = joined.select(F.col("label").alias("id"), F.col("to").alias("label")).join(labels.select("id"), "id", "left_anti")
            labels = settled(known.unionByName(fresh), "dup-labels")

    def mixed_of(rows: DataFrame) -> DataFrame:
        """The rows of nodes that hold several classes, with their labels."""
        named = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        several = settled(named.groupBy("node").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("rows")).where("l < h").select("node", "rows"), "dup-several")
        return settled(joined(named, several, ["node"], "rows", "id", "inner").select("node", "id", "label", "size"), "dup-mixed")

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    for turn in range(passes + 1):
        sizes = settled(frontier.groupBy("node").agg(F.count("*").alias("size"), F.count("*").alias("rows"), F.min("id").alias("first")).where("size > 1"), "dup-sizes")
        members = settled(joined(frontier, sizes, ["node"], "rows", "id", "inner"), "dup-members")
        taken(confirmed(settled(_likely(members.where("id <> first").select(*pair("id", "first")).distinct(), sigs, least), "dup-likely"), docs, width, percent))
        rest = mixed_of(members.select("node", "id", "size"))
        done = F.lit(True) if turn == passes else F.col("size") <= small
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") * 2 / whole))
        blocks = rest.where(done).select(F.when(F.col("size") * 2 > whole, F.xxhash64("node", part)).otherwise(F.col("node")).alias("node"), "id", "label")
        near = settled(_across(blocks.join(marks, "id"), least), "dup-near")
        taken(confirmed(settled(near.select(*pair("id", "other")).distinct(), "dup-likely"), docs, width, percent))
        rest = mixed_of(rest.select("node", "id", "size"))
        pieces = settled(_blocks(rest.where(done), whole), "dup-pieces")
        alike = settled(_across(pieces.join(marks, "id"), least).select("node", "id").join(pieces.select("node", "id", "label"), ["node", "id"]), "dup-near")
        sets = full_sets(docs, alike.select("id"), width)
        light = _light(alike.join(sets.select("id", "n"), "id"), heavy)
        taken(_exact(light.join(sets.select("id", "own"), "id"), percent))
        frontier = rest.where(F.col("size") > small).select("node", "id")
        if turn == passes or frontier.isEmpty():
            return labels
        depth, odd = levels * (turn + 2), F.col("node").bitwiseAND(F.lit(1).cast("long")) == 1
        start = range(grown, max(grown, trees + further(percent / 100, depth, trees)))
        grown, ids = start.stop, frontier.select("id").distinct()
        frontier = _branch(frontier.where(~odd).join(sigs.select("id", "sig"), "id"), levels).unionByName(_branch(frontier.where(odd).join(unused, "id"), levels, fresh=True))
        if start:
            frontier = frontier.unionByName(_branch(ids.join(unused, "id"), depth, start, fresh=True))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable over links), kept, text_key (xxhash64 of the text, which tells rows of one id apart).

    Null and empty texts have an empty set and are linked with nothing; a null id takes no part in links, its component is
    null and it is kept; rows that repeat an id are each placed by their own text's class, and classes with the same least
    id are one; other columns are left out; an empty table gives no rows.

    A group of equal texts is summed before its shuffle and its rows are dealt over tasks, so it may hold a third of all rows."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = settled(signatures(own, width), "dup-signatures")
    full = rows.where("n > 0 and id is not null")
    classes = settled(full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("marks").alias("marks")), "dup-classes")
    own = own.where("id is not null")
    labels = linked_classes(own, classes.select(F.col("rep").alias("id"), "sig", "marks"), width, percent, trees)
    named = settled(classes.drop("sig", "marks").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", "copies", F.coalesce("label", "rep").alias("label")), "dup-named")
    placed = joined(full.drop("sig", "marks"), named, ["k1", "k2", "n"], "copies", "id").select("id", "text_key", "n", "label").unionByName(rows.where("n = 0 or id is null").select("id", "text_key", "n", F.col("id").alias("label")))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("label"))).alias("kept"), "text_key")
