"""Lines, fences, sections and quotes of documents, and checks of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import as_violation, repeated, union, violations
from ..functions.text import SPACE, let, nfc, places, running_count, strip

#: Where a line ends, and the code points that draw nothing (default ignorable ones), which no identifier may hold.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in IGNORABLE) + "]"
#: A character that stands on its own: no control, format, surrogate, private or unassigned code point, separator or mark.
BASE = r"[^\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Z}\p{M}]"


def _lines() -> Column:
    """The text's lines, each with its line end; none of an empty text."""
    ends = F.regexp_extract_all("text", F.lit(LINE_END), F.lit(0))
    both = F.arrays_zip(F.split("text", LINE_END, -1).alias("line"), F.concat(ends, F.array(F.lit(""))).alias("eol"))
    return F.filter(both, lambda x: (x["line"] != "") | (x["eol"] != ""))  # only the last can be dropped, so positions stay


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds line_no and anchor to lines with their position."""
    return rows.withColumn("line_no", F.col("_p") + 1).withColumn("anchor", F.format_string("L%02d", F.col("_p") + 1))


def lines(docs: DataFrame) -> DataFrame:
    """tx1: doc_id, line_no from 1, anchor, line, eol.  No line after the last line end; no line of an empty or null text."""
    rows = docs.select("doc_id", F.posexplode(_lines()).alias("_p", "_l"))
    return _numbered(rows).select("doc_id", "line_no", "anchor", "_l.line", "_l.eol")


def _fenced() -> Column:
    """The text's lines with is_fence and in_fence, worked out inside the row: no line moves."""

    def state(found: Column, fences: Column, count: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            fence = F.get(fences, i)
            return F.struct(x["line"].alias("line"), x["eol"].alias("eol"), fence.alias("is_fence"), (fence | (F.get(count, i) % 2 == 1)).alias("in_fence"))

        return F.transform(found, one)

    fence = lambda x: x["line"].rlike(rf"^{SPACE}*(```|~~~)")
    return let(_lines(), lambda found: let(F.transform(found, fence), lambda fences: let(running_count(fences), lambda count: state(found, fences, count))))


def fence_state(docs: DataFrame) -> DataFrame:
    """tx2: the lines of tx1 with is_fence and in_fence; a fence line counts as inside."""
    rows = docs.select("doc_id", F.posexplode(_fenced()).alias("_p", "_l"))
    return _numbered(rows).select("doc_id", "line_no", "anchor", "_l.*")


def sections(docs: DataFrame) -> DataFrame:
    """tx3: doc_id, section_idx, title, block, split at first-level headings outside fences.  What stands before the first has no title;
    the blocks of a document join to its text."""
    heading = lambda x: ~x["in_fence"] & x["line"].rlike(r"^ {0,3}#[\s]+\S")
    title = lambda x: F.regexp_replace(strip(F.regexp_replace(strip(x["line"]), "^#+", "")), r"\s+#+\s*\z", "")

    def cut(found: Column, starts: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i), F.size(found))  # the next heading: before the first one stands section 0
            block = F.array_join(F.transform(F.slice(found, start + 1, end - start), lambda x: F.concat(x["line"], x["eol"])), "")
            return F.struct(i.alias("section_idx"), F.when(i > 0, title(F.get(found, start))).alias("title"), block.alias("block"))

        return F.filter(F.transform(F.concat(F.array(F.lit(0)), starts), one), lambda s: s["block"] != "")

    whole = let(_fenced(), lambda found: let(places(F.transform(found, heading)), lambda starts: cut(found, starts)))
    return docs.select("doc_id", F.inline(whole))


def blockquotes(docs: DataFrame) -> DataFrame:
    """tx4: doc_id, quote_idx from 1, quote: consecutive quoted lines outside fences as one; blank ones are dropped."""
    quoted = lambda x: ~x["in_fence"] & x["line"].rlike(r"^ {0,3}>")
    edge = lambda marks, step: places(F.transform(marks, lambda q, i: q & ~F.coalesce(F.get(marks, i + step), F.lit(False))))

    def joined(found: Column, starts: Column, ends: Column) -> Column:
        bare = lambda x: F.regexp_replace(x["line"], r"^\s{0,3}>\s?", "")
        one = lambda s, i: strip(F.array_join(F.transform(F.slice(found, s + 1, F.get(ends, i) - s + 1), bare), " "))
        return F.filter(F.transform(starts, one), lambda q: q != "")

    marked = lambda found: let(F.transform(found, quoted), lambda marks: let(edge(marks, -1), lambda starts: let(edge(marks, 1), lambda ends: joined(found, starts, ends))))
    rows = docs.select("doc_id", F.posexplode(let(_fenced(), marked)).alias("_p", "quote"))
    return rows.select("doc_id", (F.col("_p") + 1).alias("quote_idx"), "quote")


def unstable_ids(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """tx7: identifiers that are blank, hold white space, a slash or an invisible code point (detail: the first one), or no base character."""
    found = []
    for c in cols:
        bad = F.regexp_extract(c, INVISIBLE, 0)
        code = F.format_string("U+%04X", F.ascii(bad))
        found.append(violations(rows, keys, [
            ("blank_id", F.col(c).isNull() | (strip(F.col(c)) == ""), c), ("space_in_id", F.col(c).rlike(rf"\S{SPACE}|{SPACE}\S"), c), ("slash_in_id", F.col(c).contains("/"), c),
            ("invisible_in_id", F.col(c).rlike(INVISIBLE), code), ("no_base_character", (strip(F.col(c)) != "") & ~F.col(c).rlike(BASE), c),
        ], c))
    return union(*found)


def identity_collisions(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """tx8: values that are repeated, or are equal once composed but written in several ways (detail: how often, or how many ways)."""
    own = rows.where(F.col(col).isNotNull()).withColumn("_k", nfc(F.col(col)))
    ways = own.groupBy(*keys, "_k").agg(F.countDistinct(col).alias("_n")).where("_n > 1")
    return union(repeated(own, keys, col, "repeated_identity"), as_violation(ways, keys, "several_spellings", "_k", F.col("_n")))
