"""How the sources of a language differ: term statistics of every source against the others and against the language.

Equal texts of a language collapse first: each is kept once with the number of times that every source has it.
It is tokenized once, and its terms are counted with those numbers, so copies cost no work of their own.
Counts are kept sparse, a row for each term that a source has.  Terms of too few documents go.

Pairs of sources are evaluated in blocks: sources are dealt over tiles of TILE, terms over shards of about SHARD, and
a task has the rows of two tiles and one shard as a small matrix.  It gives a sum over the terms that either tile has
there; all other terms count alike for a pair, for neither source has them, and are added as one product.
All numbers are integers; a share per thousand million is divided out three digits at a time, so no product leaves 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, settled

#: Terms: runs of letters A to Z and of anything beyond ASCII; what lies between them.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Documents that a term needs in its language, ranks of the term part, parts of a whole.
DOCUMENTS, RANKS, SCALE = 3, 200, 1_000_000_000
#: Sources of a tile and terms of a shard in a task; entries of a task's counts and spellings that it knows before they are given on, characters of a text taken at once.
TILE, SHARD, ENTRIES, PIECE = 64, 2048, 1_000_000, 1 << 20


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact up to totals of nine thousand million million."""
    out, rest = _div(count + 1, total), (count + 1) % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, total), rest % total
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Integers divided, rounded down; both positive."""
    return F.call_function("div", a, b)


def _excess(p, q):
    """floor((p - q)^2 / q), for columns and arrays alike."""
    return (p - q) * (p - q) // q if isinstance(p, np.ndarray) else _div((p - q) * (p - q), q)


def collapsed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each different text of a language once: lang, text, by (source and how many of its rows have the text, for each).  Nulls are empty strings."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    own = own.withColumn("key", F.sha2("text", 256))
    # copies meet within each task before anything is shuffled, so a text of very many copies costs a row a task; texts move once, multiplicities by their digest
    by = own.groupBy("lang", "key", "source").agg(F.count("*").alias("n")).groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("by"))
    return own.groupBy("lang", "key").agg(F.first("text").alias("text")).join(by, ["lang", "key"]).drop("key")


class _Codes(dict):
    """A number for each term as a text has it; spellings that differ in A to Z alone share one."""

    def __init__(self):
        super().__init__()
        self.terms: list[str] = []
        self.own: dict[str, int] = {}

    def __missing__(self, spelling: str) -> int:
        term = spelling.translate(LOWER)
        if (code := self.own.get(term)) is None:
            code = self.own[term] = len(self.terms)
            self.terms.append(term)
        self[spelling] = code
        return code


def _coded(text: str, codes: _Codes) -> np.ndarray:
    """Codes of a text's terms."""
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # cut where a term ends, so no list holds all of a very long text
            found = BETWEEN.search(text, end)
            end = found.start() if found else len(text)
        some = TERM.findall(text, at, end)
        parts.append(np.fromiter(map(codes.__getitem__, some), np.int64, len(some)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _summed(keys: list[np.ndarray], n: list[np.ndarray], d: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its sums."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(np.concatenate(n)[order], first), np.add.reduceat(np.concatenate(d)[order], first)


def counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that have it), summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, groups = _Codes(), {}
        keys, ns, ds, size = [], [], [], 0

        def give() -> pa.RecordBatch:
            key, n, d = _summed(keys, ns, ds) if size else (np.zeros(0, np.int64),) * 3
            lang, source = (pa.array([g[x] for g in groups], pa.string()).take(pa.array(key >> 32)) for x in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, pa.array(codes.terms, pa.string()).take(pa.array(key & 0xFFFFFFFF)), pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            for lang, text, by in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "by")), strict=True):
                terms, n = np.unique(_coded(text, codes), return_counts=True)
                for x in by if len(terms) else ():
                    group = groups.setdefault((lang, x["source"]), len(groups))
                    keys.append(group << 32 | terms)
                    ns.append(n * x["n"])
                    ds.append(np.full(len(terms), x["n"]))
                    size += len(terms)
                    if size >= 2 * ENTRIES:
                        keys, ns, ds = ([x] for x in _summed(keys, ns, ds))
                        size = len(keys[0])
                        if size >= ENTRIES:
                            yield give()
                            keys, ns, ds, size = [], [], [], 0
                if len(codes) >= ENTRIES:
                    yield give()
                    codes, groups = _Codes(), {}
                    keys, ns, ds, size = [], [], [], 0
        yield give()

    rows = texts.select("lang", "text", "by").mapInArrow(count, "lang string, source string, term string, n long, d long")
    # by (lang, term), which the count of a term's documents in its language needs too
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _kept(rows: DataFrame, documents: int) -> DataFrame:
    """Terms of enough documents, with their number in the language."""
    term = Window.partitionBy("lang", "term")
    return rows.withColumn("documents", F.sum("d").over(term)).withColumn("lang_n", F.sum("n").over(term)).where(F.col("documents") >= documents).select("lang", "source", "term", "n", "lang_n")


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value and n: sums of excesses over the terms that a task had, and how many terms it had.

    ``rows``: lang, source, term, p of the terms that a source has; ``groups``: lang, source, p0 (of a term that it hasn't), v and sources (of the language)."""
    tiles = F.ceil(F.col("sources") / TILE)
    sized = groups.select("lang", "source", "p0", tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).alias("tile"), F.ceil(F.col("v") / SHARD).alias("shards"), "terms")
    columns = ["lang", "source", "term", "p", "p0", "tile", "tiles", "shard"]
    own = joined(rows, sized, ["lang", "source"], "terms", "term", "inner").withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).select(columns)
    # every source is in every shard, with none of its terms too
    named = sized.where("shards > 0").withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long"), "shard": F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))})
    own = own.unionByName(named.select(columns))
    # a source's rows go to a task for each tile, of two tiles to the one named by the smaller number first
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other"))

    def evaluate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(rows["source"])
        term_at, terms = pd.factorize(rows["term"])
        zero, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        zero[at], tile[at] = rows["p0"], rows["tile"]
        p = np.repeat(zero[:, None], len(terms), axis=1)
        has = term_at >= 0
        p[at[has], term_at[has]] = rows["p"][has].astype(np.int64)
        out = []
        for a in range(len(names)):
            others = np.flatnonzero(tile != tile[a]) if key[2] != key[3] else np.flatnonzero(np.arange(len(names)) != a)
            out += [(key[0], names[a], names[b], v, len(terms)) for b, v in zip(others, _excess(p[None, a], p[others]).sum(axis=1).tolist(), strict=True)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value", "n"])

    return dealt.select("lang", "shard", "first", "second", "source", "term", "p", "p0", "tile").groupBy("lang", "shard", "first", "second").applyInPandas(evaluate, "lang string, source string, item string, value long, n long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: every other source of the language, by the sum of its terms' excesses.  Part ``term``: terms that the source has
    and uses more than the language does, by their excess, up to ``ranks``.  Ties are ordered by the UTF-8 bytes of the item.

    Null texts, languages and sources are empty strings.  Repeated rows are documents each; ids and other columns are not read.  A language without a
    kept term has pairs of value 0 and no terms; one with a single source has no pairs; an empty table gives no rows."""
    kept = settled(_kept(counts(collapsed(docs, text_col, lang_col, source_col)), documents), "divergence-counts")
    occurring = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    language = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    own = occurring.join(totals, ["lang", "source"], "left").join(language, "lang", "left").fillna(0, ["total", "terms", "v", "lang_total"])
    sources = Window.partitionBy("lang")
    whole = F.col("total") + F.col("v")
    groups = settled(own.withColumn("sources", F.count("*").over(sources)).withColumn("p0", F.when(whole > 0, share(F.lit(0).cast("long"), whole))), "divergence-groups")

    shared = joined(kept, groups.select("lang", "source", "total", "v", "lang_total", "terms"), ["lang", "source"], "terms", "term", "inner")
    shares = shared.select("lang", "source", "term", share(F.col("n"), F.col("total") + F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    sums = _pairs(shares.drop("q"), groups).groupBy("lang", "source", "item").agg(F.sum("value").alias("sum"), F.sum("n").alias("n"))
    # every two sources of a language are the result itself
    every = groups.select("lang", "source", "p0", "v").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    value = F.when(F.col("v") == 0, 0).otherwise(F.coalesce("sum", F.lit(0)) + (F.col("v") - F.coalesce("n", F.lit(0))) * _excess(F.col("p0"), F.col("q0")))
    pair = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    return pair.unionByName(term)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT o.lang, o.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN c USING (lang, source) GROUP BY o.lang, o.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
