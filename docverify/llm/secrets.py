"""Secret scans with corpus-wide ownership, by DataFrame functions alone.

Every text gives candidates: the three base kinds, and long tokens of mixed letters and digits
(kind ``owned``).  Candidate hashes are counted over the corpus by distinct owners and
repositories.  What many owners or many repositories hold is a copied example; what a few of both hold is
taken as live, of kind ``owned`` only if it looks random: a base kind is judged by ownership alone.  The method adds the live ``owned`` spans; base spans stay whatever their verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, HOT, joined, settled
from .rules import let

#: Owners from which on a value is a copied example, distinct repositories from which on it is one too, and distinct characters from which on one of kind ``owned`` looks random.
WIDE, MANY, VARIED = 3, 10, 8
#: Elements of an array that are gone through at once, and characters of a text's piece.
BLOCK, PIECE = 64, 4096
#: The base kinds in their order, then the method's own; the group that holds the value; its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"[A-Za-z0-9_-]{20,}", 0, 20),
]
SPAN = "array<struct<start:int,stop:int,kind_no:int,value:string>>"


def _before(values: Column, joined: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each element what all those before it (integers from 0) come to, by blocks of blocks: no array is gone through for each element of it."""
    start = F.lit(0)
    over = lambda a, begin, n: F.aggregate(F.slice(a, begin + 1, n), start, joined)
    if levels == 1:
        return let(values, lambda a: F.transform(a, lambda _, i: over(a, start, i)))

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda k: over(a, k * BLOCK, F.lit(BLOCK)))
        return let(_before(blocks, joined, levels - 1), lambda o: F.transform(a, lambda _, i: joined(F.get(o, F.floor(i / BLOCK).cast("int")), over(a, i - i % BLOCK, i % BLOCK))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, of))


def _spans(text: Column, no: int) -> Column:
    """Leftmost matches of a kind with their places, from the lengths of the matches and of what lies between them."""
    _, pattern, group, least = KINDS[no]
    rx = F.lit(pattern)
    found, between = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, rx, F.lit(group)) if group else found
    both = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), values.alias("v"))

    def placed(every: Column) -> Column:
        before = _before(F.transform(every, lambda x: F.length(x["m"]) + F.length(x["b"])), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            begin = at + F.length(x["b"])
            return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("stop"), F.lit(no).alias("kind_no"), x["v"].alias("value"))

        return let(before, lambda p: F.transform(every, lambda x, i: span(x, F.get(p, i))))

    fits = F.filter(let(both, placed), lambda s: F.length(s["value"]) >= least)
    return F.when(F.regexp_like(text, rx), fits.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _named(spans: Column) -> Column:
    """kind:start:end, by start and then kind."""
    kinds = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["stop"])), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["stop"].alias("stop")))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds row_key, base and own (candidate spans of the method that no base span holds) to the rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_base = docs.withColumns({"row_key": F.monotonically_increasing_id(), "base": F.concat(*(_spans(text, n) for n in range(3))), "own": _spans(text, 3)})
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    free = F.filter("own", lambda s: mixed(s) & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return with_base.withColumn("own", free)


def ownership(found: DataFrame, owner_col: str, repo_col: str, wide: int = WIDE, varied: int = VARIED, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Spans with their candidate's hash, and per hash: n (spans), owners, repos (distinct ones, whoever owns them), example, live; settled.

    Each step is summed before its shuffle, so that a value copied to a third of all rows arrives as a row for
    each task.  A null owner counts as one owner, and so does a null repository."""
    spans = found.where("size(base) + size(own) > 0").select("row_key", F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.explode(F.concat("base", "own")).alias("s"))
    spans = spans.select("row_key", "owner", "repo", "s.start", "s.stop", "s.kind_no", F.sha2("s.value", 256).alias("hash"), ((F.col("s.kind_no") < 3) | (F.size(F.array_distinct(F.split("s.value", ""))) >= varied)).alias("random"))
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"), F.count("*").alias("n"))
    counts = pairs.groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repo")).alias("repos"), F.max("random").alias("random"))
    example = (F.col("owners") >= wide) | (F.col("repos") >= many)
    return spans, settled(counts.select("hash", "n", "owners", "repos", example.alias("example"), (F.col("random") & ~example).alias("live")), "secrets-verdicts")


def judged(found: DataFrame, owner_col: str, repo_col: str, wide: int = WIDE, varied: int = VARIED, many: int = MANY, few: int = FEW, hot: int = HOT) -> DataFrame:
    """For each row_key with candidates: live (spans of live candidates), n_example (spans of copied ones) and counts (owners and repositories of all).

    No value's spans meet in one task, however many there are."""
    spans, verdicts = ownership(found, owner_col, repo_col, wide, varied, many)
    span = F.struct("start", "kind_no", "stop")
    return joined(spans, verdicts, ["hash"], "n", "row_key", "inner", few, hot).groupBy("row_key").agg(F.array_sort(F.collect_list(F.when(F.col("live"), span))).alias("live"), F.count_if("example").alias("n_example"), F.array_sort(F.collect_list(F.struct("start", "kind_no", "owners", "repos"))).alias("counts"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = WIDE, varied: int = VARIED, many: int = MANY) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, ownership (kind:start:owners:repositories of every candidate).

    Null and empty texts have no spans; repeated rows and ids give a row each; a null owner is one owner of its own; other
    columns are left out; an empty table gives no rows."""
    own = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.col(text_col).alias("text"))
    found = settled(candidates(own).drop("text"), "secrets")
    verdicts = judged(found, "owner", "repo", wide, varied, many)
    every = found.join(verdicts, "row_key", "left")
    added = F.filter(F.coalesce("live", F.array().cast("array<struct<start:int,kind_no:int,stop:int>>")), lambda s: s["kind_no"] == 3)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    base, kinds = _plain(F.col("base")), F.array(*(F.lit(k[0]) for k in KINDS))
    return every.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.concat(base, added)).alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce(F.array_join(F.transform("counts", lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["owners"], s["repos"])), ","), F.lit("")).alias("ownership"),
    )


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = "[SECRET]", wide: int = WIDE, varied: int = VARIED, many: int = MANY) -> DataFrame:
    """The rows with each live secret's span replaced by ``mask``; copied examples stay.  Columns and row count stay as they are."""
    row = F.col("row").getField(text_col)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"))
    found = settled(candidates(own).drop("text"), "secrets-text")
    some = F.size("base") + F.size("own") > 0
    live = judged(found, "owner", "repo", wide, varied, many).where("size(live) > 0").select("row_key", "live")
    marked = found.where(some).join(live, "row_key", "left")
    stops = F.transform("live", lambda s: s["stop"])

    def masked(pieces: Column, before: Column) -> Column:  # spans by start; what lies in an earlier one is masked with it
        def between(begin: Column, stop: Column) -> Column:
            first = F.floor(begin / PIECE).cast("int")
            own = F.slice(pieces, first + 1, F.greatest(F.lit(0), F.floor((stop - 1) / PIECE).cast("int") - first + 1))
            return F.array_join(F.transform(own, lambda x, k: F.substring(x, F.greatest(F.lit(0), begin - (first + k) * PIECE) + 1, F.least(F.lit(PIECE), stop - (first + k) * PIECE) - F.greatest(F.lit(0), begin - (first + k) * PIECE))), "")

        parts = F.transform("live", lambda s, i: F.when(s["stop"] <= F.get(before, i), F.lit("")).otherwise(F.concat(between(F.get(before, i), F.greatest(F.get(before, i), s["start"])), F.lit(mask))))
        return F.concat(F.array_join(parts, ""), between(F.array_max(stops), F.length(row)))

    # the text in pieces, so that no cut starts at its beginning
    masked_text = let(F.regexp_extract_all(row, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), lambda p: let(_before(stops, lambda a, b: F.greatest(a, b)), lambda b: masked(p, b)))
    changed = marked.withColumn("row", F.col("row").withField(text_col, F.when(F.col("live").isNull(), row).otherwise(masked_text)))
    return changed.select("row.*").unionByName(found.where(~some).select("row.*"))
