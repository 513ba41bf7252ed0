"""Quotes against sources, terms and patterns against lines, references against fingerprints."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import CHARS, GRAM, grams, holders, linear, matched
from ..functions.rules import as_violation, repeated, union, violations
from ..functions.text import blank, normalize_ws, strip
from .graph import kept

#: Rows up to which a dictionary or a word list is broadcast.
FEW = 100_000
#: Fixed value: the form of a dictionary's date.
DATE = r"^\d{4}-\d{2}-\d{2}\z"


def _small(rows: DataFrame) -> DataFrame:
    """A broadcast hint behind a look at the size."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


#: Words of a winnowed run, and runs of a window: RUN + WINDOW - 1 words in a row share a fingerprint wherever they stand; words of a run at most where there are fewer.
RUN, WINDOW, FEWER = 5, 4, 3


#: Keys in a batch that leaves a task.
BATCH = 200_000


def _keys(words: list[str], run: int) -> np.ndarray:
    """What sources are found by: all runs of one to FEWER words, or the winnowed fingerprints of longer ones (the least hash of each window); distinct hashes of 64 bits."""
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = len(words) - run + 1
    if n < (WINDOW if run >= RUN else 1):
        return np.empty(0, np.int64)
    runs = hashes[:n]
    for j in range(1, run):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        runs ^= runs >> np.uint64(29)
    if run >= RUN:
        runs = np.minimum.reduce([runs[j : n - WINDOW + 1 + j] for j in range(WINDOW)])
    return np.unique(runs).view(np.int64)


def _keyed(rows: DataFrame, col: str, run: int) -> DataFrame:
    """Rows without ``col`` and with ``key``: each key of the words in ``col``, which single blanks part."""
    ids = [c for c in rows.columns if c != col]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found, n = [], [], 0
            own = batch.select(ids)

            def out() -> pa.RecordBatch:
                at = own.take(pa.array(np.repeat(places, [len(f) for f in found]), pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*at.columns, pa.array(np.concatenate(found), pa.int64())], [*ids, "key"])  # noqa: B023

            for i, text in enumerate(batch.column(col)):
                places.append(i)
                found.append(_keys(text.as_py().split(" "), run))
                n += len(found[-1])
                if n >= BATCH:
                    yield out()
                    places, found, n = [], [], 0
            if found:
                yield out()

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.mapInArrow(find, f"{fields}, key long")


def _quotes(quotes: DataFrame) -> DataFrame:
    """Adds nq (the quote, normalised), cut (its leading part), inner (the cut's whole words) and run, the words of a key by how many these are."""
    q = quotes.select("doc_id", "quote_idx", "quote", normalize_ws(F.col("quote")).alias("nq"))
    q = q.withColumn("cut", F.substring("nq", F.lit(1), F.greatest(F.lit(8), F.floor(F.length("nq") * F.lit(0.6)).cast("int"))))
    words = F.split("cut", " ")
    q = q.withColumn("inner", F.when(F.size(words) >= 3, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>")))
    return q.withColumn("run", F.when(F.size("inner") >= RUN + WINDOW - 1, RUN).when(F.size("inner") > 0, F.least(F.size("inner"), F.lit(FEWER))))


#: Parts that an index's keys and texts are dealt into; a batch of quotes reads those that it needs.
PARTS = 64


def _part(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(PARTS)).cast("int")


#: The kinds of keys: words of a run.
KINDS = (*range(1, FEWER + 1), RUN)


def write_index(sources: DataFrame, path: str, kinds: tuple[int, ...] = KINDS) -> None:
    """What ``verbatim_match`` works out of sources, written once for many batches of quotes: their normalised texts, and their keys of these kinds.  Others may follow by ``write_keys``."""
    s = _readable(sources).withColumn("part", _part("doc_id", "source_ord"))
    s.repartition("part").write.mode("errorifexists").partitionBy("part").parquet(f"{path}/texts")
    # a part without rows, for the schema where there are no sources
    s.drop("part").limit(0).write.parquet(f"{path}/texts/part=-1")
    for run in kinds:
        write_keys(sources.sparkSession, path, run)


def write_keys(spark: SparkSession, path: str, run: int) -> None:
    """Adds the keys of one kind to an index; what an attempt that failed left of them is replaced."""
    keys = _keyed(spark.read.parquet(f"{path}/texts").select("doc_id", "source_ord", "ns"), "ns", run).withColumn("part", _part("key"))
    keys.repartition("part").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{path}/keys/run={run}")
    keys.drop("part").limit(0).write.mode("overwrite").parquet(f"{path}/keys/run={run}/part=-1")


def kinds_of(quotes: DataFrame) -> list[int]:
    """The kinds of keys that these quotes are sought by, four at most."""
    return sorted(r["run"] for r in _quotes(quotes).where("run is not null").select("run").distinct().collect())


def _readable(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("text").isNotNull()).select("doc_id", "source_ord", "label", normalize_ws(F.col("text")).alias("ns"))


def _held(s: DataFrame, asked: DataFrame, run: int, index: str | None) -> DataFrame:
    """doc_id, source_ord, key of the keys asked for (doc_id, key), from the texts or from an index."""
    if index is None:
        return _keyed(s.select("doc_id", "source_ord", "ns"), "ns", run).join(_small(asked), ["doc_id", "key"], "left_semi")
    asked = asked.withColumn("part", _part("key"))
    keys = asked.sparkSession.read.parquet(f"{index}/keys/run={run}")
    parts = [r["part"] for r in asked.select("part").distinct().collect()]  # PARTS at most
    return keys.where(F.col("part").isin(parts)).join(_small(asked), ["part", "doc_id", "key"], "left_semi").select("doc_id", "source_ord", "key")


def _candidates(q: DataFrame, s: DataFrame, index: str | None = None, kinds: Collection[int] = KINDS) -> DataFrame:
    """doc_id, quote_idx, source_ord: of each quote the sources that hold the rarest of its keys, or for a quote without a whole word a run of its characters."""
    pairs = None
    for run in sorted(r["run"] for r in q.where("run is not null").select("run").distinct().collect()):  # four at most
        own = _keyed(q.where(F.col("run") == run).select("doc_id", "quote_idx", F.array_join("inner", " ").alias("words")), "words", run)
        held = kept(_held(s, own.select("doc_id", "key").distinct(), run, index if run in kinds else None))
        often = held.groupBy("doc_id", "key").agg(F.count("*").alias("df"))
        # a key that no source has settles the quote: it is in none
        rarest = own.join(often, ["doc_id", "key"], "left").groupBy("doc_id", "quote_idx").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r"))
        found = rarest.where("r.df > 0").select("doc_id", "quote_idx", F.col("r.key").alias("key")).join(held, ["doc_id", "key"]).select("doc_id", "quote_idx", "source_ord")
        pairs = found if pairs is None else pairs.unionByName(found)
    short = q.where((F.size("inner") == 0) & (F.col("nq") != "")).select("doc_id", "quote_idx", "cut", F.least(F.length("cut"), F.lit(GRAM)).alias("n"))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # 1 to GRAM
        own = short.where(F.col("n") == n).select("doc_id", "quote_idx", F.substring("cut", 1, n).alias("gram"))
        runs = s.select("doc_id", "source_ord", F.explode(grams(F.col("ns"), n)).alias("gram")).join(_small(own.select("doc_id", "gram").distinct()), ["doc_id", "gram"], "left_semi")
        found = own.join(runs, ["doc_id", "gram"]).select("doc_id", "quote_idx", "source_ord")
        pairs = found if pairs is None else pairs.unionByName(found)
    return q.select("doc_id", "quote_idx").join(s.select("doc_id", "source_ord"), "doc_id").where(F.lit(False)) if pairs is None else pairs


def _by_keys(q: DataFrame, s: DataFrame, index: str | None, kinds: Collection[int]) -> DataFrame:
    """doc_id, quote_idx, source_ord, label, whole of the sources that hold a quote or its cut, each quote held against the sources that its keys name."""
    pairs = _candidates(q, s, index, kinds)
    if index is not None:
        pairs = kept(pairs.withColumn("part", _part("doc_id", "source_ord")))
        s = s.where(F.col("part").isin([r["part"] for r in pairs.select("part").distinct().collect()])).drop("part")  # PARTS at most
        pairs = pairs.drop("part")
    met = pairs.join(q.select("doc_id", "quote_idx", "nq", "cut"), ["doc_id", "quote_idx"]).join(s, ["doc_id", "source_ord"]).where(F.contains("ns", "cut"))
    return met.select("doc_id", "quote_idx", "source_ord", "label", F.contains("ns", "nq").alias("whole"))


def _chars(q: DataFrame) -> int:
    return q.agg(F.sum(F.length("nq") + F.length("cut"))).first()[0] or 0


def _read_once(q: DataFrame, texts: DataFrame) -> DataFrame:
    """The same rows: every source (doc_id, source_ord, label, text) is read once, where it lies, for all quotes together."""
    both = F.array(F.struct(F.col("nq").alias("word"), F.lit(True).alias("whole")), F.struct(F.col("cut").alias("word"), F.lit(False).alias("whole")))
    spans = q.where("nq <> ''").select("doc_id", "quote_idx", F.explode(both).alias("x")).select("doc_id", "quote_idx", "x.*")
    words = [r["word"] for r in spans.select("word").distinct().collect()]  # CHARS characters at most
    return holders(texts.where("source_ord is not null"), words, "text").join(_small(spans), ["doc_id", "word"]).select("doc_id", "quote_idx", "source_ord", "label", "whole")


def verbatim_match(quotes: DataFrame, sources: DataFrame | None = None, index: str | None = None, kinds: Collection[int] = KINDS, chars: int = CHARS) -> DataFrame:
    """vf2: doc_id, quote_idx, quote, verdict, label of quotes (doc_id, quote_idx, quote) against the sources (doc_id, source_ord, label, text) of the same doc_id.

    FULL: the quote, white space normalised, is in a source; PARTIAL: its first max(8, 60 %) characters are; MISS otherwise and for a
    blank quote.  The label is that of the first source in declared order.  A source without text is skipped.

    Quotes of up to CHARS characters together go to every worker as one automaton, and each source is read once.  For more of them, and with an
    index, no pair is made without reason.  A cut of eight whole words or more meets sources by winnowed fingerprints: the least hash of every four
    runs of five words, which any text that holds these words has too.  Shorter ones go by runs of up to three words, those without a whole word by
    a run of characters; of a quote's keys the rarest counts.  So a quote of common words meets only sources that have them in that order.

    ``index``: a folder that ``write_index`` made of the sources, in their place: keys are read from the parts that the quotes ask for, texts from those
    of the candidates.  Quotes without a whole word, or of a kind whose keys it lacks (``kinds``: those it has), read all texts once, together."""
    q = _quotes(quotes)
    if index is None:
        met = _read_once(q, sources.select("doc_id", "source_ord", "label", "text")) if _chars(q) <= chars else _by_keys(q, _readable(sources), None, ())
    else:
        s = quotes.sparkSession.read.parquet(f"{index}/texts")
        without = ~F.coalesce(F.col("run").isin(*kinds), F.lit(False))
        if 0 < _chars(q.where(without)) <= chars:
            met = _by_keys(q.where(~without), s, index, kinds).unionByName(_read_once(q.where(without), s.select("doc_id", "source_ord", "label", F.col("ns").alias("text"))))
        else:
            met = _by_keys(q, s, index, kinds)
    first = lambda c: F.min(F.when(c, F.struct("source_ord", "label")))["label"]
    best = met.groupBy("doc_id", "quote_idx").agg(first(F.col("whole")).alias("full"), F.max("whole").alias("is_full"), first(F.lit(True)).alias("part"))
    verdict = F.when(F.col("is_full"), "FULL").when(F.col("is_full").isNotNull(), "PARTIAL").otherwise("MISS")
    return q.select("doc_id", "quote_idx", "quote").join(best, ["doc_id", "quote_idx"], "left").select("doc_id", "quote_idx", "quote", verdict.alias("verdict"), F.when(F.col("is_full"), F.col("full")).otherwise(F.col("part")).alias("label"))


def quotes_to_check(extracted: DataFrame, listed: DataFrame) -> DataFrame:
    """A document's listed quotes, or where it lists none, those found in its body."""
    return listed.unionByName(extracted.join(listed.select("doc_id").distinct(), "doc_id", "left_anti"))


def verbatim_summary(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """vf3: per doc_id the verdicts' counts, declared, readable and missing sources, blind (nothing to check), fails, fails_under_coverage."""
    m = matches.groupBy("doc_id").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("FULL", "PARTIAL", "MISS")))
    s = sources.groupBy("doc_id").agg(F.count("*").alias("n_declared"), F.count("text").alias("n_readable"))
    every = m.join(s, "doc_id", "full").na.fill(0, ["n_full", "n_partial", "n_miss", "n_declared", "n_readable"])
    blind = (F.col("n_full") + F.col("n_partial") + F.col("n_miss") == 0) | (F.col("n_readable") == 0)
    return every.withColumns({"n_missing": F.col("n_declared") - F.col("n_readable"), "blind": blind, "fails": F.col("n_miss") > 0, "fails_under_coverage": (F.col("n_miss") > 0) | blind})


def _roles(terms: DataFrame) -> DataFrame:
    """word, canonical, avoided and excepted: what a word is to a term, an avoided variant or its preferred wording."""
    none = F.array().cast("array<string>")
    avoided = terms.select(F.explode("forbidden").alias("word"), "canonical", F.lit(True).alias("avoided"), F.coalesce("excepted", none).alias("excepted"))
    preferred = terms.select(F.col("canonical").alias("word"), "canonical", F.lit(False).alias("avoided"), none.alias("excepted")).distinct()
    return avoided.unionByName(preferred).where("word <> ''")


def _uses(rows: DataFrame, terms: DataFrame, preferred: bool) -> DataFrame:
    """doc_id, line_no, line, word, offset, canonical and avoided of every use of a term, in one pass over the lines for variants, exceptions and preferred wordings.  A variant inside an exception's span is none."""
    roles = _roles(terms)
    roles = roles if preferred else roles.where("avoided")
    words = roles.select("word").unionByName(terms.select(F.explode("excepted").alias("word")))
    found = matched(rows.select("doc_id", "line_no", "line"), words, "line").select("*", F.explode("hits").alias("h")).select("*", "h.word", "h.offset")
    covers = lambda h: F.array_contains("excepted", h["word"]) & (h["offset"] <= F.col("offset")) & (F.col("offset") + F.length("word") <= h["offset"] + F.length(h["word"]))
    return found.join(_small(roles), "word").where(~F.exists("hits", covers))


def term_scan(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """vf4: doc_id, line_no, variant, canonical, offset, line of every occurrence of a forbidden variant that lies in no exception's span.

    rows: doc_id, line_no, line; terms: canonical, forbidden, excepted (arrays)."""
    return _uses(rows, terms, False).select("doc_id", "line_no", F.col("word").alias("variant"), "canonical", "offset", strip(F.col("line")).alias("line"))


def term_usage(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """vf5: per document and term how often the preferred wording and the avoided ones are used; terms without either use are left out.  Lines are read once for both."""
    return _uses(rows, terms, True).groupBy("doc_id", "canonical").agg(F.count_if("avoided").alias("n_avoided"), F.count_if(~F.col("avoided")).alias("n_preferred"))


def dictionary_meta_violations(meta: DataFrame, keys: list[str]) -> DataFrame:
    """vf6: dictionaries (keys, target, updated_at, n_terms) without a target, a date of the form YYYY-MM-DD or a term."""
    return violations(meta, keys, [("target_missing", blank(F.col("target")), None), ("date_malformed", ~F.coalesce(F.col("updated_at").rlike(DATE), F.lit(False)), F.col("updated_at")), ("terms_empty", F.coalesce(F.col("n_terms"), F.lit(0)) <= 0, None)], "target")


def term_dictionary_violations(terms: DataFrame, keys: list[str]) -> DataFrame:
    """vf6: faults of dictionaries (keys, canonical, forbidden, excepted; note if there is one).

    A list with a blank entry is reported and judged no further, and exceptions are judged against a sound list alone."""
    none = F.array().cast("array<string>")
    t = terms.withColumns({"forbidden": F.coalesce("forbidden", none), "excepted": F.coalesce("excepted", none)})
    newline = lambda a: F.exists(a, lambda v: F.coalesce(v.rlike(r"[\r\n]"), F.lit(False)))
    blanks = lambda a: F.exists(a, blank)
    rules = [("canonical_missing", blank(F.col("canonical")), None), ("forbidden_empty", F.size("forbidden") == 0, None), ("newline_in_value", F.coalesce(F.col("canonical").rlike(r"[\r\n]"), F.lit(False)) | newline("forbidden") | newline("excepted"), None), ("forbidden_blank", blanks("forbidden"), None), ("exception_blank", blanks("excepted"), None)]
    if "note" in terms.columns:
        rules.append(("note_blank", F.col("note").isNotNull() & blank(F.col("note")), None))
    own = violations(t, keys, rules, "canonical")
    sound = t.where(~blanks("forbidden"))
    allowed = F.when(blanks("excepted"), none).otherwise(F.col("excepted"))
    each = sound.select(*keys, "canonical", allowed.alias("excepted"), F.explode("forbidden").alias("v"))
    same = as_violation(each.where("v = canonical"), keys, "forbidden_is_canonical", "canonical", F.col("v"))
    twice = repeated(each, keys, "v", "forbidden_repeated")
    exc = sound.select(*keys, "canonical", "forbidden", F.explode(allowed).alias("e"))
    useless = ~F.exists("forbidden", lambda v: F.contains(F.col("e"), v) & (v != F.col("e")))
    silenced = F.array_contains("forbidden", F.col("e"))
    x = violations(exc, keys, [("exception_is_forbidden", silenced, F.col("e")), ("exception_useless", ~silenced & useless, F.col("e"))], "canonical")
    names = t.where(~blank(F.col("canonical"))).select(*keys, F.col("canonical").alias("other")).distinct()
    inside = each.join(names, keys).where(F.contains("other", "v") & (F.col("v") != F.col("other")) & ~F.array_contains("excepted", F.col("other")))
    return union(own, same, twice, x, as_violation(inside.select(*keys, "v", "other").distinct(), keys, "forbidden_inside_canonical", "other", F.col("v")))


def stale_refs(refs: DataFrame, fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """vf7: keys, ref, state of references (keys, source_ref, source_hash) that aren't fresh: unpaired, malformed, missing or stale.
    fingerprints: path, sha256."""
    both = refs.where(F.col("source_ref").isNotNull() | F.col("source_hash").isNotNull()).join(fingerprints.select(F.col("path").alias("source_ref"), F.col("sha256").alias("_now")), "source_ref", "left")
    state = F.when(F.col("source_ref").isNull() | F.col("source_hash").isNull(), "unpaired").when(~F.col("source_hash").rlike(r"^[0-9a-f]{64}\z"), "malformed").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("source_hash"), "stale")
    return both.withColumn("state", state).where("state is not null").select(*keys, "source_ref", "state")


def pattern_scan(rows: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """vf8: doc_id, line_no, pattern, hit, severity for each match of each pattern (name, expression), whatever its case; any hit blocks.

    A pattern that begins with a repeated class is tried where a run of it begins, and only in lines that hold the character which must follow."""

    def found(name: str, pattern: str) -> Column:
        rewritten, needs = linear(pattern)
        hits = F.transform(F.regexp_extract_all("line", F.lit(f"(?i){rewritten}"), F.lit(0)), lambda h: F.struct(F.lit(name).alias("pattern"), h.alias("hit")))
        return F.when(F.contains(F.lower("line"), F.lit(needs.lower())), hits) if needs else hits

    hits = F.flatten(F.array_compact(F.array(*(found(n, p) for n, p in patterns))))
    return rows.select("doc_id", "line_no", F.explode(hits).alias("h")).select("doc_id", "line_no", "h.*", F.lit("blocker").alias("severity"))
