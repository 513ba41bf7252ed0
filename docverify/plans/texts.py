"""Queries over texts: sources, structure, verification, anchors, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, slot_key
from ..operators import anchors as an
from ..operators import integrity as it
from ..operators import publish as pb
from ..operators import structure as tx
from ..operators import verify as vf
from ..operators.graph import new_folder
from ..sources import corpus as io
from .fixtures import PATTERNS, query, rows, table, terms, values_sql


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return io.from_table(table(spark, sf, "documents"), "doc_id", "text")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tx.lines(docs(spark, sf).select("doc_id", "text"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A document per conversation: a heading for each turn, the user's text as a quote."""
    body = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))).otherwise(F.col("text"))
    turn = F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), body, F.lit("\n"))
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "").alias("text"))


#: Lines of documents by SQL; the data has no other line end than the line feed.
LINES = """(SELECT doc_id, i AS line_no, l[i] AS line, CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS eol FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT (i = len(l) AND l[i] = ''))"""
MD = """(SELECT conv_id AS doc_id, turn, role, concat('# ', turn, ' ', role) AS title, text, concat('# ', turn, ' ', role, chr(10), CASE role WHEN 'user' THEN concat('> ', replace(text, chr(10), chr(10) || '> ')) ELSE text END, chr(10)) AS block FROM conversations)"""


@query("io1_read_corpus", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS valid FROM documents")
def _(s, d):
    return docs(s, d).drop("text")


@query("io2_file_inventory", "SELECT CAST(page_id AS VARCHAR) AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def _(s, d):
    return io.file_inventory(io.from_table(table(s, d, "pages"), "page_id", "html"))


@query("io3_publish_pages", f"""SELECT doc_id, concat('<!-- generated page, do not edit -->', chr(10), string_agg(block, '' ORDER BY turn)) AS page, count(*) AS n_sections, concat('P', doc_id, '_conversation') AS file_name, false AS leftover_token FROM {MD} WHERE role = 'assistant' GROUP BY doc_id""")
def _(s, d):
    body = tx.sections(markdown(s, d)).select("doc_id", F.col("title").alias("title_key"), "block")
    plan = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat_ws(" ", F.col("turn").cast("string"), "role").alias("title_key"), F.when(F.col("role") == "assistant", "included").otherwise("excluded").alias("action"))
    named = plan.withColumns({"page_pattern": F.lit("{product}/{feature}"), "product": F.concat(F.lit("P"), F.col("doc_id").cast("string")), "feature": F.lit("conversation"), "title": F.lit(None).cast("string")})
    return io.publish_pages(named, body)


TREE = """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha FROM documents),
l4 AS (SELECT substr(sha256(path), 1, 4) AS part, sha256(string_agg(concat(path, chr(0), bytes, chr(0), sha, chr(10)), '' ORDER BY encode(path))) AS digest, count(*) AS n FROM f GROUP BY 1),
l2 AS (SELECT substr(part, 1, 2) AS part, sha256(string_agg(concat(part, chr(0), n, chr(0), digest, chr(10)), '' ORDER BY part)) AS digest, sum(n)::BIGINT AS n FROM l4 GROUP BY 1)
SELECT 'run' AS run_id, sha256(string_agg(concat(part, chr(0), n, chr(0), digest, chr(10)), '' ORDER BY part)) AS digest, sum(n)::BIGINT AS n_files FROM l2"""


@query("io4_snapshot_digest", TREE)
def _(s, d):
    folder = new_folder(s, "snapshot")
    written = io.write_snapshot(docs(s, d), folder, "run")
    again = io.read_snapshot(s, folder, "run")
    return written.join(again.select(F.lit("run").alias("run_id")).distinct(), "run_id")


@query("tx1_lines", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, concat('L', lpad(CAST(line_no AS VARCHAR), CAST(greatest(2, len(CAST(line_no AS VARCHAR))) AS INTEGER), '0')) AS anchor, line, eol FROM {LINES}")
def _(s, d):
    return doc_lines(s, d)


FENCED = "(SELECT conv_id AS doc_id, concat('intro', chr(10), CASE WHEN conv_id % 2 = 0 THEN concat('```', chr(10)) ELSE '' END, '# h', chr(10), CASE WHEN conv_id % 3 = 0 THEN concat('~~~', chr(10)) ELSE '' END, 'end') AS text FROM (SELECT DISTINCT conv_id FROM {conversations}) c)"


@query("tx2_fence_state", f"""WITH l AS (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {FENCED})),
m AS (SELECT doc_id, i, x[i] AS line, x[i] IN ('```', '~~~') AS f FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, line, f AS is_fence, f OR sum(f::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS in_fence FROM m""")
def _(s, d):
    return tx.fence_state(rows(s, d, f"SELECT * FROM {FENCED}".replace("chr(10)", "char(10)"))).drop("anchor", "eol")


@query("tx3_sections", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS INTEGER) AS section_idx, concat(turn, ' ', role) AS title, block FROM {MD}")
def _(s, d):
    return tx.sections(markdown(s, d))


@query("tx4_blockquotes", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS INTEGER) AS quote_idx, trim(replace(text, chr(10), ' ')) AS quote FROM {MD} WHERE role = 'user' AND trim(text) <> ''")
def _(s, d):
    return tx.blockquotes(markdown(s, d))


@query("tx5_normalize_ws", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", normalize_ws(F.col("text")).alias("norm"))


@query("tx6_slot_key", r"SELECT doc_id, translate(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS slot FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", slot_key(F.col("text")).alias("slot"))


#: Identifiers that reach each rule, by code points: blank and spaced ones, each range of code points that draw nothing at both its ends, marks, private and unassigned code points alone and beside a letter, and sound ones.
PLANTED = [(), (32,), (0x3000, 9), (97, 32, 98), (32, 97), (97, 0xA0), (97, 47, 98), (97, 7), (97, 0x600, 98), (97, 0x2028), (0x301,), (0x301, 97), (97, 0x301), (0x20DD, 0x903), (0xE000,), (97, 0xE000), (0x378,), (97, 0x378), (65,), (45, 49), (0x4E2D,), (0x1F600,), (0xE9, 0x5F)]
PLANTED += [(107, x) for a, b in tx.IGNORABLE for x in {a, b}] + [(0xFFF0,), (0x2065, 0x2065), (0xE0100, 98), (0x3164,), (0xFFEF, 98), (0xFFF9, 98), (0x1D172, 98), (0x1D17B, 98)]
CODES = "list_transform(string_split(v, ''), lambda c: unicode(c))"


@query("tx7_unstable_ids", f"""WITH t AS (SELECT p_partkey AS k, [{", ".join("concat(''" + "".join(f", chr({c})" for c in own) + ")" for own in PLANTED)}][1 + p_partkey % {len(PLANTED)}] AS v FROM part),
c AS (SELECT k, v, list_filter({CODES}, lambda c: c < 32 OR c BETWEEN 127 AND 159 OR c IN (1536, 8232, 65529) OR {" OR ".join(f"c BETWEEN {a} AND {b}" for a, b in tx.IGNORABLE)}) AS bad, len(list_filter({CODES}, lambda c: c NOT IN (9, 32, 160, 12288, 8232))) = 0 OR v = '' AS empty,
  len(list_filter({CODES}, lambda c: c IN (9, 32, 160, 12288, 8232))) > 0 AS spaced, regexp_matches(v, '[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}]') AS base FROM t)
SELECT k, rule, v AS subject, detail, 'error' AS severity FROM (
  SELECT k, v, 'blank_id' AS rule, 'v' AS detail FROM c WHERE empty UNION ALL SELECT k, v, 'space_in_id', 'v' FROM c WHERE spaced AND (NOT empty OR len(v) > 1) UNION ALL SELECT k, v, 'slash_in_id', 'v' FROM c WHERE contains(v, '/')
  UNION ALL SELECT k, v, 'invisible_in_id', printf('U+%04X', bad[1]) FROM c WHERE v <> '' AND len(bad) > 0 UNION ALL SELECT k, v, 'no_base_character', 'v' FROM c WHERE NOT empty AND NOT base)""")
def _(s, d):
    planted = F.array(*(F.lit("".join(map(chr, own))) for own in PLANTED))
    own = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.get(planted, (F.col("p_partkey") % len(PLANTED)).cast("int")).alias("v"))
    return tx.unstable_ids(own, ["k"], ["v"])


@query("tx8_identity_collisions", """SELECT lang, 'repeated_identity' AS rule, text AS subject, CAST(count(*) AS VARCHAR) AS detail, 'error' AS severity FROM documents GROUP BY lang, text HAVING count(*) > 1""")
def _(s, d):
    return tx.identity_collisions(table(s, d, "documents"), ["lang"], "text")


@query("vf1_fingerprint", "SELECT page_id, sha256(html) AS sha256, substr(sha256(html), 1, 16) AS sha16 FROM pages")
def _(s, d):
    from ..functions.text import fingerprint

    return table(s, d, "pages").select("page_id", fingerprint(F.col("html")).alias("f")).select("page_id", "f.*")


def sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.lit(0).cast("long").alias("doc_id"), F.col("doc_id").alias("source_ord"), F.col("doc_id").cast("string").alias("label"), "text")


VERBATIM = r"""(WITH q AS (SELECT doc_id, quote_idx, quote, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS nq FROM {quotes} x), c AS (SELECT *, substr(nq, 1, greatest(8, CAST(floor(length(nq) * CAST(0.6 AS DOUBLE)) AS INTEGER))) AS cut FROM q),
s AS (SELECT doc_id AS ord, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ns FROM documents),
m AS (SELECT c.quote_idx, min(CASE WHEN contains(s.ns, c.nq) THEN s.ord END) AS f, min(s.ord) AS p FROM c JOIN s ON c.nq <> '' AND contains(s.ns, c.cut) GROUP BY c.quote_idx)
SELECT c.doc_id, c.quote_idx, c.quote, CASE WHEN f IS NOT NULL THEN 'FULL' WHEN p IS NOT NULL THEN 'PARTIAL' ELSE 'MISS' END AS verdict, CAST(coalesce(f, p) AS VARCHAR) AS label FROM c LEFT JOIN m USING (quote_idx))"""


@query("vf2_verbatim_match", f"SELECT * FROM {VERBATIM} v")
def vf2(s, d):
    return vf.verbatim_match(rows(s, d, "quotes"), sources(s, d))


@query("vf2_verbatim_short", r"""WITH q AS (SELECT item_id AS quote_idx, substr(text, 1, 9) AS quote FROM benchmark), m AS (SELECT quote_idx, min(doc_id) AS o FROM q JOIN documents ON contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(substr(trim(regexp_replace(quote, '\s+', ' ', 'g')), 1, 8)) ) AND contains(trim(regexp_replace(text, '\s+', ' ', 'g')), substr(trim(regexp_replace(quote, '\s+', ' ', 'g')), 1, 8)) GROUP BY 1),
f AS (SELECT quote_idx, min(doc_id) AS o FROM q JOIN documents ON contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS doc_id, q.quote_idx, quote, CASE WHEN f.o IS NOT NULL THEN 'FULL' WHEN m.o IS NOT NULL THEN 'PARTIAL' ELSE 'MISS' END AS verdict, CAST(coalesce(f.o, m.o) AS VARCHAR) AS label FROM q LEFT JOIN m USING (quote_idx) LEFT JOIN f USING (quote_idx)""")
def _(s, d):
    return vf.verbatim_match(rows(s, d, "SELECT CAST(0 AS BIGINT) AS doc_id, item_id AS quote_idx, substr(text, 1, 9) AS quote FROM {benchmark}"), sources(s, d))


@query("vf3_verbatim_summary", f"""SELECT doc_id, n_full, n_partial, n_miss, n AS n_declared, r AS n_readable, n - r AS n_missing, n_full + n_partial + n_miss = 0 OR r = 0 AS blind, n_miss > 0 AS fails, n_miss > 0 OR n_full + n_partial + n_miss = 0 OR r = 0 AS fails_under_coverage
FROM (SELECT doc_id, count(*) FILTER (verdict = 'FULL') AS n_full, count(*) FILTER (verdict = 'PARTIAL') AS n_partial, count(*) FILTER (verdict = 'MISS') AS n_miss FROM {VERBATIM} v GROUP BY doc_id), (SELECT count(*) AS n, count(text) AS r FROM documents)""")
def _(s, d):
    return vf.verbatim_summary(vf2(s, d), sources(s, d))


#: Offsets are worked out in lines that hold a part, from the lengths of what lies between its occurrences; no part here overlaps itself.
STARTS = "unnest(list_transform(range(1, len(p)), lambda j: CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) AS BIGINT) + (j - 1) * length({0})))"
HITS = f"""(WITH t AS (SELECT canonical, excepted, unnest(forbidden) AS variant FROM {values_sql()}),
h AS (SELECT doc_id, line_no, line, canonical, excepted, variant, {STARTS.format("variant")} AS o FROM (SELECT l.doc_id, l.line_no, l.line, t.*, string_split(l.line, t.variant) AS p FROM {LINES} l JOIN t ON contains(l.line, t.variant))),
x AS (SELECT DISTINCT doc_id, line_no, line, variant, unnest(excepted) AS e FROM h),
e AS (SELECT doc_id, line_no, variant, length(e) AS n, {STARTS.format("e")} AS a FROM (SELECT *, string_split(line, e) AS p FROM x WHERE contains(line, e)))
SELECT doc_id, line_no, variant, canonical, CAST(o AS INTEGER) AS "offset", trim(line) AS line FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = h.doc_id AND e.line_no = h.line_no AND e.variant = h.variant AND e.a <= h.o AND h.o + length(h.variant) <= e.a + e.n))"""


@query("vf4_term_scan", f'SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, variant, canonical, "offset", line FROM {HITS} x')
def vf4(s, d):
    return vf.term_scan(doc_lines(s, d), terms(s))


@query("vf5_term_usage", f"""WITH a AS (SELECT doc_id, canonical, count(*) AS n FROM {HITS} x GROUP BY 1, 2), p AS (SELECT doc_id, canonical, sum((length(line) - length(replace(line, canonical, ''))) / length(canonical))::BIGINT AS n FROM {LINES} l JOIN (SELECT canonical FROM {values_sql()}) t ON contains(line, canonical) GROUP BY 1, 2)
SELECT coalesce(a.doc_id, p.doc_id) AS doc_id, coalesce(a.canonical, p.canonical) AS canonical, coalesce(a.n, 0) AS n_avoided, coalesce(p.n, 0) AS n_preferred FROM a FULL JOIN p ON a.doc_id = p.doc_id AND a.canonical = p.canonical""")
def _(s, d):
    return vf.term_usage(doc_lines(s, d), terms(s))


#: A dictionary for every four parts: a part's name is preferred to its first word and its brand; every third allows its own name, every fifth the brand, every seventh what no variant is in.
@query("vf6_term_dictionary", r"""WITH t AS (SELECT p_partkey // 4 AS k, CASE WHEN p_partkey % 11 = 0 THEN concat(p_name, chr(10)) ELSE p_name END AS canonical, [CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END, p_brand] AS forbidden,
  list_filter([CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 5 = 0 THEN p_brand END, CASE WHEN p_partkey % 7 = 0 THEN 'zzz' END, CASE WHEN p_partkey % 23 = 0 THEN ' ' END], lambda x: x IS NOT NULL) AS excepted FROM part),
b AS (SELECT k, CASE WHEN k % 31 = 0 THEN ' ' ELSE canonical END AS canonical, CASE k % 29 WHEN 0 THEN [] WHEN 1 THEN list_append(forbidden, chr(9)) ELSE forbidden END AS forbidden, excepted, CASE WHEN k % 19 = 0 THEN '' WHEN k % 2 = 0 THEN 'n' END AS note FROM t),
s AS (SELECT k, canonical, forbidden, CASE WHEN list_contains(excepted, ' ') THEN [] ELSE excepted END AS excepted FROM b WHERE NOT list_contains(forbidden, chr(9))), v AS (SELECT k, canonical, excepted, unnest(forbidden) AS v FROM s)
SELECT k, rule, subject, detail, 'error' AS severity FROM (
SELECT k, 'newline_in_value' AS rule, canonical AS subject, NULL AS detail FROM b WHERE contains(canonical, chr(10)) OR len(list_filter(forbidden, lambda f: contains(f, chr(10)))) > 0 OR len(list_filter(excepted, lambda f: contains(f, chr(10)))) > 0
UNION ALL SELECT k, 'canonical_missing', canonical, NULL FROM b WHERE canonical = ' ' UNION ALL SELECT k, 'forbidden_empty', canonical, NULL FROM b WHERE len(forbidden) = 0 UNION ALL SELECT k, 'forbidden_blank', canonical, NULL FROM b WHERE k % 29 = 1
UNION ALL SELECT k, 'exception_blank', canonical, NULL FROM b WHERE list_contains(excepted, ' ') UNION ALL SELECT k, 'note_blank', canonical, NULL FROM b WHERE note = '' UNION ALL SELECT k, 'forbidden_is_canonical', canonical, v FROM v WHERE v = canonical
UNION ALL SELECT k, 'forbidden_repeated', v, CAST(count(*) AS VARCHAR) FROM v GROUP BY k, v HAVING count(*) > 1
UNION ALL SELECT k, CASE WHEN list_contains(forbidden, e) THEN 'exception_is_forbidden' ELSE 'exception_useless' END, canonical, e FROM (SELECT k, canonical, forbidden, unnest(excepted) AS e FROM s) WHERE list_contains(forbidden, e) OR len(list_filter(forbidden, lambda f: contains(e, f) AND f <> e)) = 0
UNION ALL SELECT DISTINCT v.k, 'forbidden_inside_canonical', t.canonical, v.v FROM v JOIN b t ON v.k = t.k AND t.canonical <> ' ' AND contains(t.canonical, v.v) AND v.v <> t.canonical AND NOT list_contains(v.excepted, t.canonical)
UNION ALL SELECT k, CASE m WHEN 0 THEN 'target_missing' WHEN 1 THEN 'date_malformed' ELSE 'terms_empty' END, CASE m WHEN 0 THEN ' ' ELSE 'manual' END, CASE m WHEN 1 THEN '2024-1-01' END FROM (SELECT DISTINCT p_partkey // 4 AS k, (p_partkey // 4) % 5 AS m FROM part) WHERE m < 3)""")
def _(s, d):
    k, name, every = F.col("p_partkey"), F.col("p_name"), lambda n, c: F.when(F.col("p_partkey") % n == 0, c)
    excepted = F.array_compact(F.array(every(3, name), every(5, F.col("p_brand")), every(7, F.lit("zzz")), every(23, F.lit(" "))))
    own = table(s, d, "part").select(F.floor(k / 4).cast("long").alias("k"), F.when(k % 11 == 0, F.concat(name, F.lit("\n"))).otherwise(name).alias("canonical"), F.array(F.coalesce(every(13, name), F.substring_index("p_name", " ", 1)), F.col("p_brand")).alias("forbidden"), excepted.alias("excepted"))
    j = F.col("k")
    own = own.select("k", F.when(j % 31 == 0, " ").otherwise(F.col("canonical")).alias("canonical"), F.when(j % 29 == 0, F.array().cast("array<string>")).when(j % 29 == 1, F.array_append("forbidden", F.lit("\t"))).otherwise(F.col("forbidden")).alias("forbidden"), "excepted", F.when(j % 19 == 0, "").when(j % 2 == 0, "n").alias("note"))
    m = j % 5
    meta = own.groupBy("k").agg(F.count("*").alias("n")).select("k", F.when(m == 0, " ").otherwise("manual").alias("target"), F.when(m == 1, "2024-1-01").otherwise("2024-01-01").alias("updated_at"), F.when(m == 2, 0).otherwise(F.col("n")).alias("n_terms"))
    return vf.term_dictionary_violations(own, ["k"]).unionByName(vf.dictionary_meta_violations(meta, ["k"]))


@query("vf7_stale_refs", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS VARCHAR) END AS source_ref, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'xyz' WHEN doc_id % 3 = 0 THEN sha256('old') ELSE sha256(text) END AS source_hash FROM documents)
SELECT * FROM (SELECT r.doc_id, source_ref, CASE WHEN source_ref IS NULL OR source_hash IS NULL THEN 'unpaired' WHEN length(source_hash) <> 64 THEN 'malformed' WHEN d.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) <> source_hash THEN 'stale' END AS state
FROM r LEFT JOIN documents d ON r.source_ref = CAST(d.doc_id AS VARCHAR) WHERE source_ref IS NOT NULL OR source_hash IS NOT NULL) WHERE state IS NOT NULL""")
def _(s, d):
    k = F.col("doc_id")
    refs = table(s, d, "documents").select("doc_id", F.when(k % 7 != 0, F.when(k % 11 == 0, F.lit(-1)).otherwise(k).cast("string")).alias("source_ref"), F.when(k % 5 == 0, None).when(k % 13 == 0, "xyz").when(k % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("source_hash"))
    return vf.stale_refs(refs, docs(s, d), ["doc_id"])


@query("vf8_pattern_scan", f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, unnest(regexp_extract_all(line, rx)) AS hit, 'blocker' AS severity FROM {LINES} l, (VALUES ('email', '(?i)[A-Za-z0-9_.]+@[A-Za-z0-9_.]+'), ('token', '(?i)token = "[0-9a-f]{{40}}"'), ('license', '(?i)(?:licen[sc]e|copyright)')) t(pattern, rx)""".replace("{{40}}", "{40}"))
def _(s, d):
    return vf.pattern_scan(doc_lines(s, d), PATTERNS)


#: Reviewer notes rendered from the ledger's atoms: a text for each atom, with anchors and what looks like one.
NOTES = "SELECT run_id, atom_id AS doc_id, concat('see ', anchor, ' and L1-24, xL77; A0123456789ab') AS text, anchor FROM {atoms} a"


@query("an1_anchors", f"SELECT DISTINCT doc_id, unnest([anchor, 'A0123456789ab']) AS anchor FROM ({NOTES}) n")
def _(s, d):
    return an.anchors(rows(s, d, NOTES), ["doc_id"])


@query("an2_anchors_after", """SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [concat('L', 10 + doc_id % 80)] ELSE [concat('L', 10 + doc_id % 80), 'L99'] END) AS anchor FROM documents""")
def _(s, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("L99 listed\n"), F.when(k % 2 == 0, F.lit("## New issues\n")).otherwise(F.lit("text\n")), F.concat(F.lit("L"), (10 + k % 80).cast("string")))
    return an.anchors_after(tx.lines(table(s, d, "documents").select("doc_id", text.alias("text"))), heading=r"New\s*issues")


#: Terms that a scan reported, as its report's lines say; a line number of one digit is no anchor.
SCANNED = "SELECT run_id, concat('ok line 7, HIT line ', CAST(event_line AS STRING), ' und, HIT line 5') AS text FROM (SELECT run_id, 100 + atom_id % 900 AS event_line FROM {atoms} a WHERE atom_id % 6 = 0) x"
REQUIRED = "SELECT run_id, concat('f', CAST(atom_id % 5 AS STRING)) AS file, CASE WHEN atom_id % 5 < 4 THEN 'lens' ELSE 'second' END AS kind, anchor FROM {atoms} a"
TERMINAL = "SELECT run_id, anchor FROM {ledger} l WHERE outcome <> 'question'"


@query("an3_missing_anchors", f"""SELECT run_id, anchor, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CAST(substr(anchor, 2) AS BIGINT)) AS INTEGER) AS pos FROM (SELECT DISTINCT run_id, anchor FROM (SELECT run_id, anchor FROM ({REQUIRED}) q UNION ALL SELECT run_id, concat('L', 100 + atom_id % 900) FROM {{atoms}} a WHERE atom_id % 6 = 0) r WHERE NOT EXISTS (SELECT 1 FROM ({TERMINAL}) t WHERE t.run_id = r.run_id AND t.anchor = r.anchor))""")
def _(s, d):
    asked = rows(s, d, REQUIRED).select("run_id", "anchor").unionByName(an.scan_anchors(rows(s, d, SCANNED), ["run_id"]))
    return an.missing_anchors(asked, rows(s, d, TERMINAL))


@query("an3_anchor_coverage", f"""SELECT run_id, count(DISTINCT anchor) AS n_required, count(DISTINCT CASE WHEN kind = 'lens' THEN file END) AS lens_files, count(DISTINCT CASE WHEN kind = 'second' THEN file END) AS second_files, count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM ({TERMINAL}) t WHERE t.run_id = r.run_id AND t.anchor = r.anchor) THEN anchor END) AS n_missing,
count(DISTINCT CASE WHEN kind = 'lens' THEN file END) // 2 >= 2 AND count(DISTINCT CASE WHEN kind = 'second' THEN file END) BETWEEN 1 AND count(DISTINCT CASE WHEN kind = 'lens' THEN file END) // 2 - 1 AS partial FROM ({REQUIRED}) r GROUP BY run_id""")
def _(s, d):
    return an.anchor_coverage(rows(s, d, REQUIRED), rows(s, d, TERMINAL))


#: Per document a table row for finding F-<id % 3> and lines that promote to F-0 … F-3.
PROMO = """SELECT doc_id, concat('| F-', CAST(doc_id % 3 AS STRING), ' | L', CAST(10 + doc_id % 5 AS STRING), ' |', chr(10), 'L', CAST(10 + doc_id % 2 AS STRING), ' promoted: F-', CAST(doc_id % 4 AS STRING), ' as promoted', chr(10), 'F-', CAST(doc_id % 3 AS STRING), ' as promoted') AS text FROM {documents}"""


@query("an4_promotion_check", """SELECT doc_id, 2 AS line_no, concat('F-', doc_id % 4) AS finding, CASE WHEN doc_id % 4 <> doc_id % 3 THEN 'dangling' WHEN doc_id % 5 = doc_id % 2 THEN 'ok' ELSE 'violation' END AS state, false AS multi FROM documents
UNION ALL SELECT doc_id, 3, concat('F-', doc_id % 3), 'skipped', false FROM documents""")
def _(s, d):
    return an.promotion_check(tx.lines(rows(s, d, PROMO.replace("chr(10)", "char(10)"))), phrase=r" as promoted")


@query("an5_resolve_anchors", f"""SELECT a.doc_id, a.anchor, l.line, l.line IS NULL AS dangling FROM (SELECT doc_id, concat('L', 10 + doc_id % 30) AS anchor, 10 + doc_id % 30 AS n FROM documents) a LEFT JOIN {LINES} l ON a.doc_id = l.doc_id AND a.n = l.line_no""")
def _(s, d):
    return an.resolve_anchors(table(s, d, "documents").select("doc_id", F.concat(F.lit("L"), (10 + F.col("doc_id") % 30).cast("string")).alias("anchor")), doc_lines(s, d))


FILES = "SELECT run_id, path, bytes, text FROM {files} f"


def inventory(s: SparkSession, d: str, changed: bool = False) -> DataFrame:
    own = table(s, d, "documents").select((F.col("doc_id") % 50).alias("run_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")
    if changed:
        own = own.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
        own = own.unionByName(own.where("doc_id % 23 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))
    return own.select("run_id", "path", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("in1_aggregate_digest", "SELECT doc_id // 100 AS run_id, sha256(string_agg(concat('docs/', doc_id, '.txt', chr(0), octet_length(encode(text)), chr(0), sha256(text), chr(10)), '' ORDER BY encode(concat('docs/', doc_id, '.txt')))) AS digest, count(*) AS n_files FROM documents GROUP BY 1")
def _(s, d):
    own = inventory(s, d).withColumn("run_id", F.floor(F.regexp_extract("path", r"\d+", 0).cast("long") / 100).cast("long"))  # a hundred files a run, at every scale
    return it.aggregate_digest(own, ["run_id"])


DIFF = """SELECT doc_id % 50 AS run_id, concat('docs/', doc_id, '.txt') AS path, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'changed' END AS change FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0"""


@query("in2_inventory_diff", DIFF)
def _(s, d):
    return it.inventory_diff(inventory(s, d), inventory(s, d, True), ["run_id"], mutable="new/")


@query("in3_capture_drift", DIFF + " UNION ALL SELECT doc_id % 50, concat('new/docs/', doc_id, '.txt'), 'extra' FROM documents WHERE doc_id % 23 = 0 AND doc_id % 17 <> 0")
def _(s, d):
    return it.capture_drift(inventory(s, d), inventory(s, d, True), ["run_id"])


def payloads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("payload"))


def seals(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    sha = F.when(k % 6 == 0, "zz").when(k % 10 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256))
    return table(s, d, "pages").select(k.alias("key"), sha.alias("sha256"), F.octet_length("html").cast("long").alias("length"))


#: What is sealed already: about half of all pages, by their digest.
SEALED = "substr(sha256(html), 1, 1) < '8'"


@query("in4_seal", f"SELECT page_id AS key, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS length, '2024-01-01' AS sealed_at FROM pages WHERE NOT {SEALED}")
def _(s, d):
    own = payloads(s, d)
    return it.seal(own, own.where(F.substring(F.sha2("payload", 256), 1, 1) < "8"), "2024-01-01")


@query("in4_verify_seal", "SELECT page_id AS key, CASE WHEN page_id % 6 = 0 THEN 'malformed' WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 10 = 0 THEN 'mismatch' ELSE 'intact' END AS state FROM pages")
def _(s, d):
    return it.verify_seal(payloads(s, d).where("key % 7 <> 0"), seals(s, d))


@query("in5_port_drift", """SELECT path, unnest(states) AS state FROM (SELECT concat('d/', page_id) AS path, CASE WHEN page_id % 13 = 0 THEN ['malformed'] ELSE list_filter([CASE WHEN page_id % 5 = 0 THEN 'missing_upstream' WHEN page_id % 3 = 0 THEN 'stale_upstream' END, CASE WHEN page_id % 7 = 0 THEN 'missing_downstream' END], lambda x: x IS NOT NULL) END AS states FROM pages WHERE page_id % 11 <> 0)
UNION ALL SELECT concat('d/', page_id), 'uncovered' FROM pages WHERE page_id % 11 = 0 AND page_id % 7 <> 0""")
def _(s, d):
    p, k = table(s, d, "pages"), F.col("page_id")
    name = lambda x: F.concat(F.lit(f"{x}/"), k.cast("string"))
    sha = F.sha2("html", 256)
    ports = p.where("page_id % 11 <> 0").select(name("d").alias("path"), name("u").alias("upstream_path"), F.when(k % 13 == 0, "bad").when(k % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(sha).alias("upstream_sha"), sha.alias("downstream_sha"))
    return it.port_drift(ports, p.where("page_id % 5 <> 0").select(name("u").alias("path"), sha.alias("sha256")), p.where("page_id % 7 <> 0").select(name("d").alias("path"), sha.alias("sha256")))


@query("in6_dedupe_materials", "SELECT sha256(text) AS sha256, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS sources, count(*) AS n, NOT coalesce(bool_or(doc_id % 3 = 0), false) AS unused FROM documents GROUP BY 1")
def _(s, d):
    m = table(s, d, "documents").select(F.col("doc_id").alias("material_id"), F.sha2("text", 256).alias("sha256"))
    return it.dedupe_materials(m, m.where("material_id % 3 = 0")).withColumn("sources", F.array_join("sources", ","))


#: A manifest over the conversations' sections: every fifth turn isn't approved, every seventh is left out of the manifest.
def manifest(s: SparkSession, d: str) -> DataFrame:
    c, t = table(s, d, "conversations"), F.col("turn")
    return c.where("turn % 7 <> 6").select(F.col("conv_id").alias("doc_id"), t.alias("pos"), F.concat(F.lit("s"), t.cast("string")).alias("id"), F.concat_ws(" ", t.cast("string"), "role").alias("title"), F.when(t % 5 == 4, "draft").otherwise("approved").alias("status"))


def policy(s: SparkSession, d: str) -> DataFrame:
    c, t = table(s, d, "conversations"), F.col("turn")
    return c.where("turn % 2 = 0 and conv_id % 3 <> 0").select(F.col("conv_id").alias("doc_id"), (100 - t).alias("pos"), F.concat(F.lit("s"), t.cast("string")).alias("id"), F.lit("policy title").alias("title"), (t % 4 == 0).alias("required"))


ORDER = """(WITH m AS (SELECT conv_id AS doc_id, turn, concat('s', turn) AS id, concat(turn, ' ', role) AS title, CASE WHEN turn % 5 = 4 THEN 'draft' ELSE 'approved' END AS status FROM conversations WHERE turn % 7 <> 6), p AS (SELECT conv_id AS doc_id, 100 - turn AS pos, concat('s', turn) AS id, turn % 4 = 0 AS required FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 <> 0)
SELECT coalesce(m.doc_id, p.doc_id) AS doc_id, CAST(row_number() OVER (PARTITION BY coalesce(m.doc_id, p.doc_id) ORDER BY (p.pos IS NULL), p.pos, m.turn) AS INTEGER) AS pos, coalesce(m.id, p.id) AS id, coalesce(m.title, 'policy title') AS title, coalesce(required, false) AS required, coalesce(status, 'undefined') AS status FROM m FULL JOIN p ON m.doc_id = p.doc_id AND m.id = p.id)"""
PLAN = f"""(SELECT o.doc_id, pos, id, o.title, status, CASE WHEN status <> 'approved' THEN 'excluded' WHEN b.block IS NULL THEN 'no_body' ELSE 'included' END AS action, required AND status <> 'approved' AS unmet, CASE WHEN status = 'approved' THEN b.block END AS block FROM {ORDER} o LEFT JOIN (SELECT doc_id, concat(turn, ' ', role) AS title, block FROM {MD} m) b ON o.doc_id = b.doc_id AND o.title = b.title)"""


@query("pb1_section_order", f"SELECT * FROM {ORDER} o")
def pb1(s, d):
    return pb.section_order(policy(s, d), manifest(s, d))


@query("pb2_publish_plan", f"SELECT * FROM {PLAN} p")
def pb2(s, d):
    return pb.publish_plan(pb1(s, d), tx.sections(markdown(s, d)))


@query("pb2_publish_gate", f"""SELECT doc_id, count(*) FILTER (action = 'included') AS n_included, count(*) FILTER (action = 'excluded') AS n_excluded, count(*) FILTER (action = 'no_body') AS n_no_body, count(*) FILTER (unmet) AS n_unmet, CAST(0 AS BIGINT) AS n_repeated, count(*) FILTER (unmet) = 0 AND count(*) FILTER (action = 'no_body') = 0 AS passes FROM {PLAN} p GROUP BY doc_id""")
def _(s, d):
    return pb.publish_gate(pb2(s, d), pb.duplicate_headings(tx.sections(markdown(s, d))))


@query("pb3_duplicate_headings", "SELECT conv_id AS doc_id, role AS title, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    b = tx.sections(markdown(s, d)).withColumn("title", F.regexp_replace("title", r"^\d+ ", ""))
    return pb.duplicate_headings(b)


@query("pb3_orphan_headings", "SELECT conv_id AS doc_id, concat(turn, ' ', role) AS title FROM conversations WHERE turn % 7 = 6 AND turn <> 13")
def _(s, d):
    titles = table(s, d, "conversations").where("turn = 13").select(F.col("conv_id").alias("doc_id"), F.concat_ws(" ", F.col("turn").cast("string"), "role").alias("title"))
    return pb.orphan_headings(tx.sections(markdown(s, d)), manifest(s, d), titles)


@query("pb4_approval_brief", r"""WITH m AS (SELECT conv_id AS doc_id, turn, role, concat('s', turn) AS id, CASE WHEN turn % 5 = 4 THEN 'draft' ELSE 'approved' END AS status, CASE role WHEN 'user' THEN concat('> ', replace(text, chr(10), chr(10) || '> ')) ELSE text END AS body FROM conversations WHERE turn % 7 <> 6)
SELECT doc_id, CASE turn WHEN 0 THEN 'goal' ELSE 'scope' END AS kind, CAST(turn AS INTEGER) AS pos, concat(CASE turn WHEN 0 THEN 'Goal' ELSE 'Scope' END, ' ', turn, ' ', role) AS name, trim(body, chr(10)) AS detail FROM m WHERE turn < 2
UNION ALL SELECT conv_id, 'question', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER), role, CASE WHEN turn % 3 = 0 THEN 'open' ELSE 'deferred' END FROM conversations WHERE turn % 3 < 2 AND turn < 10
UNION ALL SELECT conv_id, 'decision', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER), concat('d', turn), role FROM conversations WHERE turn < 3
UNION ALL SELECT doc_id, 'status', 0, status, CAST(count(*) AS VARCHAR) FROM m GROUP BY doc_id, status""")
def _(s, d):
    c, t = table(s, d, "conversations"), F.col("turn")
    head = F.when(F.col("pos") == 0, F.concat(F.lit("Goal "), "title")).when(F.col("pos") == 1, F.concat(F.lit("Scope "), "title")).otherwise(F.col("title"))
    m = manifest(s, d).withColumn("title", head)
    bodies = tx.sections(markdown(s, d)).withColumn("_t", F.regexp_extract("title", r"^(\d+) ", 1))
    bodies = bodies.withColumn("title", F.when(F.col("_t") == "0", F.concat(F.lit("1. goal"), "title")).when(F.col("_t") == "1", F.concat(F.lit("2) SCOPE "), "title")).otherwise(F.col("title"))).drop("_t")
    key = F.col("conv_id").alias("doc_id")
    questions = c.where("turn < 10").select(key, F.concat(F.lit("q"), t.cast("string")).alias("id"), F.col("role").alias("topic"), F.when(t % 3 == 0, None).when(t % 3 == 1, "deferred").otherwise("resolved").alias("status"))
    return pb.approval_brief(m, bodies, questions, c.where("turn < 3").select(key, F.concat(F.lit("d"), t.cast("string")).alias("id"), F.col("role").alias("decision")))
