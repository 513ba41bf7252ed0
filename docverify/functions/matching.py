"""Many words at once, and patterns in time linear in a line."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all words up to which one automaton holds them: about 40 bytes each, so 160 MB in a worker and 4 MB broadcast.
CHARS = 4_000_000
#: Characters of a word's start by which larger dictionaries are joined.
GRAM = 4

HITS = "array<struct<word: string, offset: int>>"
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, words: list[str]) -> ahocorasick.Automaton:
    """One for a worker process; a trie with failure links."""
    if key not in _built:
        _built.clear()
        _built[key] = made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
    return _built[key]


def matched(rows: DataFrame, words: DataFrame, col: str, chars: int = CHARS) -> DataFrame:
    """Rows whose text in ``col`` holds any word (``words``: word), with ``hits``: each word and offset, overlapping ones too, by offset.

    Words are looked for together, in one pass over a text however many there are: an automaton of all of them goes to
    every worker once.  Whether it fits is counted first; a larger dictionary is joined on the words' first characters instead.  Null and empty words are none."""
    own = words.where("word <> ''").select("word").distinct()
    total = own.agg(F.sum(F.length("word"))).first()[0] or 0
    if total > chars:
        return _by_gram(rows, own, col)
    held = [r["word"] for r in own.collect()]
    sent, key = rows.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("offset", pa.int32())]))
        automaton = _automaton(key, sent.value) if sent.value else None
        for batch in batches:
            places, hits = [], []
            for i, text in enumerate(batch.column(col).to_pylist() if automaton else ()):
                if text and (found := [(at - len(w) + 1, w) for at, w in automaton.iter(text)]):
                    places.append(i)
                    hits.append([{"word": w, "offset": at} for at, w in sorted(found)])
            kept = batch.take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, kind)], [*kept.schema.names, "hits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(find, f"{fields}, hits {HITS}")


def holders(rows: DataFrame, words: list[str], col: str) -> DataFrame:
    """Rows without ``col`` and with ``word``: each word, once, that the text in ``col`` holds when its white space is normalised.

    A text is normalised and read once for all words where it lies; it moves no further.  The words go to every worker, so the caller looks at
    their size (CHARS).  A null text holds none."""
    ids = [c for c in rows.columns if c != col]
    sent, key = rows.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, sent.value) if sent.value else None
        for batch in batches:
            places, hits = [], []
            for i, text in enumerate(batch.column(col) if automaton else ()):
                # str.split parts at the same characters as normalize_ws
                if own := {w for _, w in automaton.iter(" ".join((text.as_py() or "").split()))}:
                    places += [i] * len(own)
                    hits += own
            kept = batch.select(ids).take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.string())], [*ids, "word"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.mapInArrow(find, f"{fields}, word string")


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    chars = F.split(text, "")
    runs = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + j) for j in range(n)))))
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.get(runs, F.lit(0))))


def _by_gram(rows: DataFrame, words: DataFrame, col: str) -> DataFrame:
    """The same by an equal join on the first characters of a word; words of fewer are their own start."""
    from .text import occurrences

    starts = words.withColumn("_gram", F.substring("word", 1, GRAM))
    numbered = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    each = F.explode(F.concat(*(grams(F.col(f"`{col}`"), n) for n in range(1, GRAM + 1))))
    met = numbered.select("_row", each.alias("_gram")).join(starts, "_gram").where(F.contains(F.col("_row")[col], F.col("word")))
    found = met.select("_row", F.transform(occurrences(F.col("_row")[col], F.col("word")), lambda at: F.struct(at.alias("offset"), F.col("word").alias("word"))).alias("h"))
    hits = F.array_sort(F.flatten(F.collect_list("h")))
    return found.groupBy("_row").agg(F.transform(hits, lambda h: F.struct(h["word"].alias("word"), h["offset"].alias("offset"))).alias("hits")).select("_row.*", "hits")


#: A pattern's start that is one class, repeated, and the character that must follow.
_LEAD = re.compile(r"(\[(?!\^?\])(?:\\.|[^\]\\\[])+\]|\\[dDwWsS])\+(\\[^\w\s]|[^\\\[(){}.*+?^$|])(?![*?{|])")


def linear(pattern: str) -> tuple[str, str | None]:
    """The pattern, rewritten where it begins with a repeated class and a character outside that class, and that character.

    Such a pattern is tried at every place of a run of the class and reads to its end each time.  A match can only
    begin where a run begins, and must hold the character behind it: so it is tried there alone, and reads the run once.
    Where a match ends inside a run, the next may begin there; a run's rest is one then, which ``\\\\G`` allows."""
    lead = _LEAD.match(pattern)
    if not lead or "|" in re.sub(r"\\.|\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)", "", pattern):
        return pattern, None
    one, then = lead.group(1), lead.group(2)[-1]
    if re.match(one, then, re.IGNORECASE):
        return pattern, None
    return f"(?:\\G|(?<!{one})){one}++{pattern[lead.end(2) - len(lead.group(2)):]}", then
