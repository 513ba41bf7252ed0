"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions alone.

A document can share only shingles that some item has, so each document is first cut down to those; its containment of an
item stays what it is, and long documents become small sets.  Equal sets are searched once.  A set that is still large (a document
that holds many items) is split: items are dealt into buckets of bounded size, and the set's part for a bucket is what the
bucket's items have of it, so each item's containment in its own bucket's part is that in the whole set.  Sets are partitioned
by size (powers of two), items likewise; for a pair of classes the containment asked for bounds the Jaccard similarity
from below, and that sets how many minwise values find a pair with all but certainty; as sets are bounded, so is that number.

Shingles that many items share (a common opening) would bring every set to all these items.  So shingles have levels, by how many items
hold them, and an item is sought by its rarest part: the lowest level that gives it more shingles than a set may lack of the item.
A set that holds enough of the item holds a share of that part, which is known; sets meet items of a level by their
shingles up to that level alone.  Items of one opening and ends of their own meet no set by the opening, however many they are;
only those whose ends are too short to tell them apart do.  Pairs that meet in a value are verified by exact intersection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, settled
from .rules import let

#: Chance that a pair of the least similarity its classes allow is missed; item shingles up to which they are broadcast (16 MB).
MISS, FEW = 1e-6, 1_000_000
#: Shingles from which on a set is split, and item shingles of a bucket (expected; an item of more has its bucket to itself but for others dealt there).
LARGE, BUCKET = 128, 64
#: A level's shingles are held by up to BASE^level items; the part of an item that its search needs beyond what a set may lack.
BASE, BEYOND = 8, 0.1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: Column, width: int) -> Column:
    """Distinct hashes of ``width`` words in a row; an empty array where there are fewer."""
    n = F.size(words)
    each = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.lit(width), *(F.get(h, i + j) for j in range(width)))))
    return F.when(n < width, F.array().cast("array<bigint>")).otherwise(F.array_distinct(each))


def _by_width(words: Column, width: int) -> Column:
    """An item's shingles: of fewer words where it has fewer."""
    out = _shingles(words, width)
    for w in range(width - 1, 0, -1):
        out = F.when(F.size(words) == w, _shingles(words, w)).otherwise(out)
    return out


def item_shingles(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """item, w (words in a shingle), q (how many), own (the shingles) of each distinct item that has a word."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), let(_words(F.col(text_col)), lambda w: F.struct(F.least(F.size(w), F.lit(width)).alias("w"), F.array_sort(_by_width(w, width)).alias("own"))).alias("x"))
    return rows.select("item", "x.w", F.size("x.own").alias("q"), "x.own").where("w > 0").distinct()


def hashes_needed(size_class: int, item_class: int, share: float, miss: float = MISS) -> int:
    """Minwise values for sets of 2^size_class to twice that and items of 2^item_class on; 0 where no such set can hold enough."""
    most, least = 2 ** (size_class + 1) - 1, 2**item_class
    if most < share * least:
        return 0
    similar = min(1 - 1e-9, share * least / (most + (1 - share) * least))
    return math.ceil(math.log(miss) / math.log1p(-similar))


def _class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double") + 0.5)).cast("int")


def _minwise(own: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.array_min(F.transform(own, lambda h: F.xxhash64(h, i))).alias("v")))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80, large: int = LARGE, bucket: int = BUCKET, by_text: bool = False) -> DataFrame:
    """A row for each document and item of which it holds at least ``percent`` of the shingles: id, item id, n_item_shingles, n_shared, containment.

    Items of fewer words than ``width`` are one shingle of all their words; null and empty items and texts give no
    rows.  Rows that repeat an id and item are reported once, with the largest share, or with ``by_text`` once for each text, with its
    xxhash64 as text_key; a null id is an id; other columns are left out; an empty table gives no rows."""
    spark = docs.sparkSession
    listed = settled(item_shingles(items, item_col, item_text_col, width).withColumn("item_key", F.xxhash64("w", "own")), "decontam-items")
    own = listed.select("item_key", "w", "q", "own").distinct()
    level = F.greatest(F.lit(1), F.ceil(F.log(float(BASE), F.count("*").cast("double")) - 1e-9)).cast("int")
    vocabulary = settled(own.select("w", F.explode("own").alias("h")).groupBy("w", "h").agg(level.alias("level")), "decontam-vocabulary")
    own = settled(_sought(own, vocabulary, percent), "decontam-sought")
    widths = sorted(r["w"] for r in vocabulary.select("w").distinct().collect())
    few = vocabulary.count() <= FEW
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_key"), _words(F.col(text_col)).alias("words"))
    per_width = lambda w: F.array(*(F.struct(F.lit(k).alias("w"), _shingles(w, k).alias("hs")) for k in widths or [width]))
    each = texts.select("doc", "text_key", F.explode(let(F.col("words"), per_width)).alias("x")).select("doc", "text_key", "x.w", F.explode("x.hs").alias("h"))
    cut = each.join(vocabulary, ["w", "h"], "left_semi").groupBy("doc", "text_key", "w").agg(F.array_sort(F.collect_set("h")).alias("own"))
    cut = settled(cut.withColumns({"set_key": F.xxhash64("w", "own"), "s": F.size("own")}), "decontam-sets")
    sets = settled(cut.select("set_key", "w", "own", "s").distinct(), "decontam-classes")
    buckets = max(1, (own.agg(F.sum("q")).first()[0] or 0) // bucket)
    dealt = own.select("w", F.pmod("item_key", F.lit(buckets)).alias("bucket"), F.explode("own").alias("h")).distinct()
    parts = sets.where(F.col("s") >= large).select("set_key", "w", F.explode("own").alias("h")).join(dealt, ["w", "h"]).groupBy("set_key", "w", "bucket").agg(F.array_sort(F.collect_set("h")).alias("own"))
    parts = parts.select("set_key", "w", F.xxhash64("w", "own").alias("part_key"), "own")
    parts = settled(sets.where(F.col("s") < large).select("set_key", "w", F.col("set_key").alias("part_key"), "own").unionByName(parts), "decontam-parts")
    searched = parts.select("part_key", "w", "own").distinct()

    levels = sorted(r[0] for r in own.select("level").distinct().collect())
    upto = F.filter(F.array(*(F.lit(x) for x in levels)).cast("array<int>"), lambda x: x >= F.col("level"))
    of_level = searched.select("part_key", "w", F.explode("own").alias("h")).join(vocabulary, ["w", "h"]).select("part_key", "w", "h", F.explode(upto).alias("level"))
    sets = settled(of_level.groupBy("part_key", "w", "level").agg(F.collect_set("h").alias("rare")).withColumn("p", _class(F.size("rare"))), "decontam-searched")
    size_classes = sorted(r[0] for r in sets.select("p").distinct().collect())
    wanted = sorted(map(tuple, own.select("level", "j", "tenths").distinct().collect()))
    need = [(x, p, j, t, n) for x, j, t in wanted for p in size_classes if (n := hashes_needed(p, j, t / 10))]
    most: dict[tuple[int, int], int] = {}
    for x, p, _, _, n in need:
        most[x, p] = max(n, most.get((x, p), 0))
    plan = spark.createDataFrame(need, "level int, p int, j int, tenths int, k int")  # levels, tenths and two classes of sizes: some thousand rows at most
    depth = spark.createDataFrame([(x, p, n) for (x, p), n in most.items()], "level int, p int, k int")
    of_sets = sets.join(F.broadcast(depth), ["level", "p"]).select("part_key", "w", "level", "p", F.explode(_minwise(F.col("rare"), F.col("k"))).alias("x"))
    of_items = own.join(F.broadcast(plan), ["level", "j", "tenths"]).select("item_key", "w", "level", "p", F.explode(_minwise(F.col("rare"), F.col("k"))).alias("x"))
    met = of_sets.select("part_key", "w", "level", "p", "x.i", "x.v").join(of_items.select("item_key", "w", "level", "p", "x.i", "x.v"), ["w", "level", "p", "i", "v"])
    pairs = met.select("part_key", "w", "item_key").distinct()
    held = pairs.join(searched.select("part_key", "w", F.col("own").alias("a")), ["part_key", "w"]).join(own.select("item_key", "w", "q", F.col("own").alias("b")), ["item_key", "w"])
    held = held.withColumn("n", F.size(F.array_intersect("a", "b"))).where(F.col("n") * 100 >= F.col("q") * percent).select("part_key", "w", "item_key", "q", "n")
    held = held.join(listed.select("item", "item_key", "w"), ["item_key", "w"]).drop("item_key")
    texts_too = ["text_key"] if by_text else []
    found = cut.select("doc", *texts_too, "set_key", "w").join(parts.select("set_key", "w", "part_key").join(held, ["part_key", "w"]), ["set_key", "w"])
    best = found.groupBy("doc", *texts_too, "item").agg(F.max(F.struct((F.col("n") / F.col("q")).alias("c"), F.col("q"), F.col("n"))).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("x.q").cast("long").alias("n_item_shingles"), F.col("x.n").cast("long").alias("n_shared"), F.col("x.c").alias("containment"), *texts_too)


def _sought(own: DataFrame, vocabulary: DataFrame, percent: int) -> DataFrame:
    """Adds to items the level of their search, ``rare`` (their shingles up to it), j (the class of its size) and how many tenths of it a set must hold, rounded down."""
    slack = F.col("q") - F.ceil(F.col("q") * percent / 100)
    enough = F.least(F.col("q"), slack + F.ceil(F.col("q") * BEYOND))
    ranked = own.select("item_key", "w", F.explode("own").alias("h")).join(vocabulary, ["w", "h"]).groupBy("item_key", "w").agg(F.array_sort(F.collect_list(F.struct("level", "h"))).alias("x"))
    both = own.join(ranked, ["item_key", "w"]).withColumn("level", F.get("x", (enough - 1).cast("int"))["level"])
    both = both.withColumn("rare", F.transform(F.filter("x", lambda y: y["level"] <= F.col("level")), lambda y: y["h"])).drop("x")
    r = F.size("rare")
    return both.withColumns({"j": _class(r), "tenths": F.greatest(F.lit(1), F.floor(10 * (r - slack) / r)).cast("int")})


#: The same result by SQL: every shingle of every document against every shingle of every item.
ORACLE_SQL = r"""
WITH lowered AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
worded AS (SELECT side, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
item AS (SELECT DISTINCT id, least(len(w), 5) AS k, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS own FROM worded WHERE side = 'i' AND len(w) > 0),
item_shingle AS (SELECT id, k, len(own) AS q, unnest(own) AS s FROM item),
doc_shingle AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM worded, (SELECT DISTINCT k FROM item) WHERE side = 'd')
SELECT d.id AS doc_id, i.id AS item_id, i.q AS n_item_shingles, count(*) AS n_shared, count(*) / i.q AS containment
FROM doc_shingle d JOIN item_shingle i ON d.k = i.k AND d.s = i.s GROUP BY d.id, i.id, i.q HAVING count(*) * 100 >= i.q * 80
"""
