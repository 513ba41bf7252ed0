"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, one above the groups, and a proof for every row.

Leaves are dealt over tasks by range, in the order of their tree, and numbered; a superblock is an aligned
run of 2^``bits`` of them.  Upwards, each superblock becomes the node above it, and these
nodes form superblocks in turn, until every tree has one node: its root.  The groups' roots are the
leaves of one more tree.  Downwards, a superblock's leaves and the outer nodes that their
proofs need (the siblings on the way from its own node to the root, some dozens at most) are
cogrouped; the task finishes the reduction inside the block, joins each leaf's siblings there with the outer
ones, and folds every leaf up to the root.  No task ever holds more than a block and its way up.

A node is the hex sha256 of the hex digests of up to two nodes below it; one without a neighbour is hashed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: A superblock has 2^BITS leaves.
BITS = 10
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A digest, and an entry of a way: a byte that says where the sibling stands, and its digest.
SIZE, LEFT, RIGHT, ALONE = 32, b"L", b"R", b"-"

NODE = "tree string, pos long, n long, digest binary"
WAY = "tree string, pos long, way binary, root binary"


def leaf(*fields: Column) -> Column:
    """Hex sha256 of the fields, each as its bytes' number, a colon and its text, or a dash for null."""
    shown = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*shown), 256)


def tampered_leaf(docs: DataFrame, id_col: str, fields: tuple[str, ...]) -> Column:
    """The leaf of a row whose n_chars is one more, where 7 divides the crc32 of its decimal id; else null."""
    other = leaf(*(F.col(f"`{f}`") + 1 if f == "n_chars" else F.col(f"`{f}`") for f in fields))
    return F.when((F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), other)


def _hashed(*digests: bytes) -> bytes:
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Settled rows with ``pos``, their number from 0 within ``tree`` by an order, and ``n``, how many the tree has.

    Rows are sorted by range, a task counts on as it goes, and totals of (task, tree), no more than tasks and trees together, become offsets."""
    spread = rows.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by)
    names, fields = spread.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            at = []
            for tree in batch.column("tree").to_pylist():
                if tree != last:
                    last, n = tree, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*names, "part", "at"])

    placed = settled(spread.withColumn("part", F.spark_partition_id()).mapInArrow(count, f"{fields}, part int, at long"), "merkle-rows")
    totals = placed.groupBy("tree", "part").agg(F.count("*").alias("own"))
    within = Window.partitionBy("tree")
    sized = totals.select("tree", "part", (F.sum("own").over(within.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(within).alias("n"))
    return settled(placed.join(sized, ["tree", "part"]).select(*names, (F.col("before") + F.col("at")).alias("pos"), "n"), "merkle-placed")


def _levels(nodes: list[bytes], n: int, bits: int) -> list[list[bytes]]:
    """All levels of a block of a tree of n nodes, up to the block's own node."""
    levels = [nodes]
    for _ in range(min(bits, (n - 1).bit_length())):
        nodes = [_hashed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def _above(nodes: DataFrame, bits: int) -> DataFrame:
    """The node above each block."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n, pos = int(block["n"].iloc[0]), int(block["pos"].iloc[0])
        top = _levels(block["digest"].tolist(), n, bits)[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [pos >> bits], "n": [-(-n >> bits)], "digest": [top]})

    return settled(nodes.select("tree", "pos", "n", "digest").groupBy("tree", F.shiftright("pos", bits).alias("block")).applyInPandas(reduce, NODE), "merkle-nodes")


def _layers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes and those above them, up to one a tree."""
    layers = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        layers.append(_above(layers[-1], bits))
        largest = -(-largest >> bits)
    return layers


def _ways(digests: list[bytes], n: int, bits: int, outer: bytes) -> list[bytes]:
    """The way of each node of a block: its siblings inside, level by level, then the block's own way."""
    levels = _levels(digests, n, bits)
    out = []
    for i in range(len(digests)):
        way = b""
        for nodes in levels[:-1]:
            sibling = i ^ 1
            way += ALONE if sibling >= len(nodes) else (LEFT if sibling < i else RIGHT) + nodes[sibling]
            i >>= 1
        out.append(way + outer)
    return out


def _steps(way: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(way):
        side = way[at : at + 1]
        end = at + 1 + SIZE * (side != ALONE)
        yield side, way[at + 1 : end]
        at = end


def _folded(digest: bytes, way: bytes) -> bytes:
    """The root that a leaf and its way lead to."""
    for side, sibling in _steps(way):
        digest = _hashed(sibling, digest) if side == LEFT else _hashed(digest, sibling) if side == RIGHT else _hashed(digest)
    return digest


def _below(nodes: DataFrame, ways: DataFrame, bits: int) -> DataFrame:
    """The way and root of every node, from the ways of the nodes above."""

    def descend(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        own = _ways(block["digest"].tolist(), int(block["n"].iloc[0]), bits, outer["way"].iloc[0])
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "way": own, "root": outer["root"].iloc[0]})

    blocks = nodes.groupBy("tree", F.shiftright("pos", bits).alias("block"))
    return settled(blocks.cogroup(ways.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(descend, WAY), "merkle-ways")


def _descended(layers: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """From the way of every tree's one node down to that of every node over the leaves."""
    for nodes in layers[-2:0:-1]:
        top = _below(nodes, top, bits)
    return top


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, bits: int = BITS, with_proof: bool = False) -> DataFrame:
    """Of every row: id, leaf, subroot (its group's), root, proof_sha256, folded_root and verified; with ``with_proof`` the proof (side and digest of each sibling, bottom up).

    Leaves of a group ascend by id, null ids first, and of one id by their digests; groups ascend by
    their UTF-8 bytes, the null group first, which is not the empty one.  Nulls in any field have their own form.  Repeated rows are leaves each, dealt over tasks
    whatever their number.  A tree of one row has that leaf as subroot and no siblings in it; an empty table has no rows.  Other columns are left out.

    ``folded_root`` is worked out from the row's leaf, or from its tampered one where ``tampered_leaf`` gives one, and the siblings of the untouched tree."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(leaf(*(F.col(f"`{f}`") for f in fields))).alias("digest"), F.unhex(tampered_leaf(docs, id_col, fields)).alias("changed"), F.monotonically_increasing_id().alias("tie"),
    )
    # the tie parts equal rows, so any number of them may be dealt over tasks; which comes first makes no difference
    leaves = _numbered(settled(rows, "merkle-leaves"), ["id", "digest", "tie"])
    layers = _layers(leaves, bits)
    groups = _numbered(layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("digest")), ["own"])
    upper = _layers(groups, bits)
    root = upper[-1].select("tree", "pos", F.lit(b"").alias("way"), F.col("digest").alias("root"))
    ways = _below(groups, _descended(upper, root, bits), bits) if len(upper) > 1 else root
    # a group's way to the root, which is that of its tree's one node, and its subroot
    top = groups.join(ways.select("pos", "way", "root"), "pos").select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("pos"), "way", "root")
    subroots = groups.select(F.col("own").alias("tree"), F.col("digest").alias("subroot"))
    outer = (_descended(layers, top, bits) if len(layers) > 1 else top).join(subroots, "tree")
    return _proven(leaves, outer, id_col, bits if len(layers) > 1 else 0, with_proof)


def _proven(leaves: DataFrame, outer: DataFrame, id_col: str, bits: int, with_proof: bool) -> DataFrame:
    """Leaves and outer nodes, cogrouped by superblock: reduction inside, proofs joined, leaves folded."""

    def prove(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        way, root, subroot = own[["way", "root", "subroot"]].iloc[0]
        digests = block["digest"].tolist()
        ways = _ways(digests, int(block["n"].iloc[0]), bits, way)
        folded = [_folded(changed or digest, w) for changed, digest, w in zip(block["changed"], digests, ways, strict=True)]
        siblings = [[(side.decode(), sibling.hex()) for side, sibling in _steps(w)] for w in ways] if with_proof else None
        return pd.DataFrame({
            "id": block["id"], "leaf": [d.hex() for d in digests], "subroot": subroot.hex(), "root": root.hex(),
            "proof_sha256": [_hashed(*(s for _, s in _steps(w))).hex() for w in ways], "folded_root": [f.hex() for f in folded], "verified": [f == root for f in folded],
        } | ({"proof": siblings} if with_proof else {}))

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<struct<side: string, digest: string>>" if with_proof else "")
    # ids go as text, for pandas would make floats of a column with nulls
    blocks = leaves.select("tree", "pos", "n", F.col("id").cast("string").alias("id"), "digest", "changed").groupBy("tree", F.shiftright("pos", bits).alias("block"))
    proven = blocks.cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(prove, schema)
    return proven.select(F.col("id").cast("long").alias(id_col), *proven.columns[1:])


def folded(digest: Column, proof: Column) -> Column:
    """The root that a hex leaf and a proof (as ``manifest`` gives it) lead to, for anyone who holds just these."""
    step = lambda d, s: F.sha2(F.concat(F.when(s["side"] == "L", s["digest"]).otherwise(""), d, F.when(s["side"] == "R", s["digest"]).otherwise("")), 256)
    return F.aggregate(proof, digest, step)


#: Levels are recursive steps; the crc32 is worked out bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, crc, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS changed FROM (SELECT doc_id, lang, n_chars,
  list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS back, xor(back, 4294967295) AS crc,
  concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
  sha256(concat(head, coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), tail)) AS leaf, sha256(concat(head, length(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1, tail)) AS other FROM documents)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM numbered UNION ALL SELECT lang, any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, pos // 2),
subroots AS (SELECT lang, level, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS h FROM subroots UNION ALL SELECT any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 2),
steps AS (SELECT s.lang, t.level, t.pos, o.h AS sibling FROM subroots s JOIN tree t ON t.lang IS NOT DISTINCT FROM s.lang AND t.n > 1 LEFT JOIN tree o ON o.lang IS NOT DISTINCT FROM t.lang AND o.level = t.level AND o.pos = xor(t.pos, 1)),
upper AS (SELECT t.level, t.pos, o.h AS sibling FROM top t LEFT JOIN top o ON o.level = t.level AND o.pos = xor(t.pos, 1) WHERE t.n > 1),
way AS (SELECT m.doc_id, m.leaf, m.pos AS place, m.lang, s.level, s.pos % 2 AS side, s.sibling FROM numbered m JOIN steps s ON s.lang IS NOT DISTINCT FROM m.lang AND s.pos = m.pos >> s.level
  UNION ALL SELECT m.doc_id, m.leaf, m.pos, m.lang, r.level + u.level, u.pos % 2, u.sibling FROM numbered m JOIN subroots r ON r.lang IS NOT DISTINCT FROM m.lang JOIN upper u ON u.pos = r.pos >> u.level),
fold AS (SELECT lang, pos, 0 AS level, changed AS h FROM numbered UNION ALL SELECT f.lang, f.pos, f.level + 1, CASE WHEN w.sibling IS NULL THEN sha256(f.h) WHEN w.side = 1 THEN sha256(w.sibling || f.h) ELSE sha256(f.h || w.sibling) END FROM fold f JOIN way w ON w.lang IS NOT DISTINCT FROM f.lang AND w.place = f.pos AND w.level = f.level),
proofs AS (SELECT lang, place AS pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM way GROUP BY lang, place),
ends AS (SELECT lang, pos, arg_max(h, level) AS folded_root FROM fold GROUP BY lang, pos)
SELECT m.doc_id, m.leaf, s.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM numbered m JOIN subroots s ON s.lang IS NOT DISTINCT FROM m.lang JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN ends e ON e.lang IS NOT DISTINCT FROM m.lang AND e.pos = m.pos LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM m.lang AND p.pos = m.pos
"""
