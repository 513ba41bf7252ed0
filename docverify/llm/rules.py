"""Quality rules: statistics of every text, and a decision list learned from labelled ones, by DataFrame functions alone.

Sequential covering: from counts of labelled documents in cells of binned statistics (Spark makes both), a rule grows
threshold by threshold while it gains, is pruned on the third of the sample that it didn't grow on, and is kept if it is
right there often enough; then what it covers is taken out and the next one grows.  A rule that fails there gives way to one that
begins elsewhere.  The list becomes one Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out

#: Labelled rows that a list is learned from at most (expected; they are picked by a hash), and quantiles of a statistic.
SAMPLE, BINS = 4000, 24
#: Most rules and thresholds in a rule; how often a rule must be right on the rows it is pruned on; the share of the bad ones left there that it must cover, or this many; beginnings tried for a rule.
RULES, CONDITIONS, RIGHT, SHARE, COVER, TRIES = 8, 3, 0.95, 0.1, 5, 24
STATISTICS = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "line_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, width: int = 5) -> Column:
    """Words in windows that a text holds twice or more, first ones included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, k, to: F.coalesce(F.get(s, k)["h"] == F.get(s, k + to)["h"], F.lit(False))
        places = let(ordered, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((k > 0) & same(s, k, -1) | same(s, k, 1)).alias("again"))), lambda x: x["again"]), lambda x: x["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["to"])).alias("n"), (p + width).alias("to")), lambda a: a["n"])

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return F.when(n < width, F.lit(0)).otherwise(let(hashed, of)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct and n_lines of the whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def all_of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))

    own = docs.withColumns({"of_words": let(words, all_of), "of_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))})
    less = lambda c, gone: (F.length(c) - F.length(F.translate(c, gone, ""))).cast("long")
    return own.withColumns({"word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"), "n_symbols": less(text, "#*$%&|<>")}).select(
        *docs.columns, "of_words.*", "of_lines.*", "word_chars", "n_symbols"
    )


def _statistics() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = [F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_distinct", "n_words"), share("n_words", "n_lines")]
    return dict(zip(STATISTICS, values, strict=True))


def _failed() -> Column:
    """The base rules."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


#: A cell: each statistic's bin; bad and good documents to grow on; bad and good ones to prune on.
Cell = tuple[tuple[int, ...], float, float, float, float]


def _held(cell: Cell, rule: list[tuple[int, bool, int]]) -> bool:
    return all((cell[0][f] > b) == above for f, above, b in rule)


def _sums(cells: list[Cell], rule: list[tuple[int, bool, int]], k: int) -> tuple[float, float]:
    own = [c for c in cells if _held(c, rule)]
    return sum(c[k] for c in own), sum(c[k + 1] for c in own)


def _grown(cells: list[Cell], bins: list[int], conditions: int, barred: set[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
    """Thresholds added by most information gain while there is any; the first is none of the barred ones."""
    rule, own = [], cells
    while len(rule) < conditions:
        bad, good = sum(c[1] for c in own), sum(c[2] for c in own)
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for f, n in enumerate(bins):
            per = [[0.0, 0.0] for _ in range(n + 1)]
            for c in own:
                per[c[0][f]][0] += c[1]
                per[c[0][f]][1] += c[2]
            low = [0.0, 0.0]
            for b in range(n):
                low = [low[0] + per[b][0], low[1] + per[b][1]]
                for above in (False, True):
                    p, q = (bad - low[0], good - low[1]) if above else low
                    g = p * (math.log2((p + 1e-9) / (p + q + 1e-9)) - math.log2(bad / (bad + good))) if p else 0
                    if g > gain and (rule or (f, above, b) not in barred):
                        best, gain = (f, above, b), g
        if best is None:
            break
        rule.append(best)
        own = [c for c in own if _held(c, [best])]
    return rule


def cover(cells: list[Cell], bins: list[int], rules: int = RULES, conditions: int = CONDITIONS, right: float = RIGHT, least: float = COVER, share: float = SHARE, tries: int = TRIES) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering of bad documents: rules of (statistic's number, above, bin)."""
    found: list[list[tuple[int, bool, int]]] = []
    barred: set[tuple[int, bool, int]] = set()
    while len(found) < rules and len(barred) < tries:
        rule = _grown(cells, bins, conditions, barred)
        if not rule:
            break
        first = rule[0]
        worth = lambda r: (lambda p, q: (p - q) / (p + q) if p + q else -1)(*_sums(cells, r, 3))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        (bad, good), (grown_bad, grown_good) = _sums(cells, rule, 3), _sums(cells, rule, 1)
        enough = min(least, max(1.0, share * sum(c[3] for c in cells)))
        if bad < enough or bad < right * (bad + good) or grown_bad < right * (grown_bad + grown_good):
            barred.add(first)
            continue
        found.append(rule)
        barred = set()
        cells = [c for c in cells if not _held(c, rule)]
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bins: int = BINS) -> list[list[Condition]]:
    """The ordered list for bad documents (label 0), from at most about ``sample`` labelled rows that are not held out;
    what fails the base rules is no concern of the list and left out.

    No usable label, or one class alone: an empty list, which keeps everything."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("bad"))
    n = own.count()
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000))
    picked = own.where(place < 1_000_000 * min(1.0, sample / max(n, 1))).withColumn("prune", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(3)) == 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # judged behind the cache, or the base rules would be worked out for every text before the join
    known = measured(texts.join(F.broadcast(picked), "id")).select("bad", "prune", _failed().alias("failed"), *(c.alias(k) for k, c in _statistics().items())).cache()
    rows = known.where("not failed")
    at = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*(F.percentile_approx(c, at, 10_000).alias(n) for s in STATISTICS for c, n in ((F.col(s), s), (F.when(F.col("bad"), F.col(s)), f"{s}_bad")))).first()
    edges = [sorted({*(cuts[s] or []), *(cuts[f"{s}_bad"] or [])}) for s in STATISTICS]
    code = lambda s, e: sum(((F.col(s) > x).cast("int") for x in e), F.lit(0))
    counts = rows.groupBy(F.array(*(code(s, e) for s, e in zip(STATISTICS, edges, strict=True))).alias("cell")).agg(
        F.count_if(F.col("bad") & ~F.col("prune")), F.count_if(~F.col("bad") & ~F.col("prune")), F.count_if(F.col("bad") & F.col("prune")), F.count_if(~F.col("bad") & F.col("prune"))
    )
    cells = sorted((tuple(r[0]), *map(float, r[1:])) for r in counts.collect())
    known.unpersist()
    return [[Condition(STATISTICS[f], above, edges[f][b]) for f, above, b in rule] for rule in cover(cells, [len(e) for e in edges])]


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    values = _statistics()
    out = F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds &= values[c.statistic] > c.threshold if c.above else values[c.statistic] <= c.threshold
        out = F.when(holds, F.lit(n)).otherwise(out)
    return out


def apply(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    Null and empty texts have no word, so the base fails; repeated rows and null ids give a row each; other columns are left
    out; an empty table gives no rows.  No shuffle."""
    own = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text")
    judged = own.withColumns({"base_failed": _failed(), "rule": verdict(rules)})
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
