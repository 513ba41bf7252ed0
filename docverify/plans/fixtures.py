"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both take.

A text names tables and other inputs in braces; for DuckDB the braces go.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

INPUTS = {
    "quotes": """SELECT CAST(0 AS BIGINT) AS doc_id, item_id AS quote_idx, text AS quote FROM {benchmark}
        UNION ALL SELECT CAST(0 AS BIGINT) AS doc_id, item_id + 100000 AS quote_idx, concat(substr(text, 1, CAST(floor(length(text) * 0.7) AS INT)), ' zzqq zzqq') AS quote FROM {benchmark}""",
    "obs": """SELECT l_orderkey AS chunk_id,
        l_orderkey * 1000 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS obs_id,
        l_returnflag <> 'N' AS verified, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS source_id FROM {lineitem}""",
    "chunks": """SELECT o_custkey AS project_id, o_orderkey AS chunk_id,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'pending' END AS status, CAST(o_orderkey % 50 AS INT) AS ord,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS order_rationale, CASE WHEN o_orderkey % 11 <> 0 THEN 'as-is' END AS asis, CASE WHEN o_orderkey % 13 <> 0 THEN 'to-be' END AS tobe FROM {orders}""",
    "sections": """SELECT o_custkey AS project_id, o_orderkey AS section_id,
        CASE WHEN o_orderkey % 9 = 0 THEN 'review' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'pending' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('gap-', CAST(o_orderkey % 7 AS STRING)) END AS gap,
        CASE WHEN o_orderkey % 5 = 0 THEN 'open' WHEN o_orderkey % 5 = 1 THEN 'deferred' END AS question_status, o_orderkey % 23 = 0 AS pending_apply FROM {orders}""",
    "scores": """SELECT CAST(p_size AS BIGINT) AS project_id, p_partkey AS section_id, CAST(1 + p_partkey % 5 AS INT) AS completeness, CAST(1 + (p_partkey * 3) % 5 AS INT) AS coherence,
        CASE WHEN p_partkey % 7 <> 0 THEN CAST(1 + (p_partkey * 7) % 5 AS INT) END AS clarity, CASE WHEN p_partkey % 8 <> 0 THEN CAST(1 + (p_partkey * 2) % 5 AS INT) END AS depth,
        p_partkey % 6 = 0 AS blocking FROM {part}""",
    "decisions": """SELECT registry_id, decision_id, subject, status, CAST(decided_on AS STRING) AS decided_on, CASE WHEN decision_id % 4 = 0 THEN prev_id END AS supersedes,
        CASE WHEN decision_id % 40 = 0 THEN prev_id WHEN decision_id % 41 = 0 THEN -1 END AS superseded_by
        FROM (SELECT o_custkey AS registry_id, o_orderkey AS decision_id, CASE WHEN o_orderkey % 10 <> 0 THEN concat('slot-', CAST(o_orderkey % 3 AS STRING)) END AS subject,
        CASE WHEN o_orderkey % 12 = 0 THEN 'rejected' WHEN o_orderkey % 15 = 0 THEN 'do_not_reopen' ELSE 'confirmed' END AS status, CAST(o_orderdate AS DATE) AS decided_on,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_id FROM {orders}) d""",
    "atoms": """SELECT CAST(floor(event_id / 20) AS BIGINT) AS run_id, event_id AS atom_id, event_id - event_id % 2 AS source_id, concat('L', CAST(10 + event_id % 80 AS STRING)) AS anchor,
        CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 5 = 1 THEN 'not_coreferential' ELSE 'proven' END AS co_reference,
        CASE WHEN event_id % 5 < 2 THEN 'not_applicable' WHEN event_id % 3 = 0 THEN 'different' ELSE 'equal' END AS semantic_values,
        CASE WHEN event_id % 5 < 2 OR event_id % 3 = 0 THEN 'not_applicable' WHEN event_id % 7 = 0 THEN 'binding_violated' WHEN event_id % 7 = 1 THEN 'intentional_variant'
        WHEN event_id % 7 = 2 THEN 'unknown' ELSE 'not_violated' END AS presentation_rule FROM {events}""",
    "ledger": """SELECT run_id, atom_id, concat('R', CAST(atom_id AS STRING)) AS record_id, anchor,
        CASE WHEN atom_id % 37 = 0 THEN 'nonissue' WHEN co_reference = 'unknown' THEN 'question' WHEN co_reference = 'not_coreferential' THEN 'nonissue' WHEN semantic_values = 'different' THEN 'finding'
        WHEN presentation_rule = 'unknown' THEN 'question' WHEN presentation_rule = 'binding_violated' THEN 'finding' WHEN presentation_rule = 'not_violated' THEN 'drift' ELSE 'nonissue' END AS outcome
        FROM ({atoms}) a WHERE atom_id % 41 <> 0
        UNION ALL SELECT run_id, atom_id, concat('D', CAST(atom_id AS STRING)) AS record_id, anchor, 'drift' AS outcome FROM ({atoms}) a WHERE atom_id % 43 = 0""",
    "trace": """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
        CASE event_type WHEN 'signup' THEN 'intake' WHEN 'view' THEN 'input_gate' WHEN 'purchase' THEN 'candidates' WHEN 'error' THEN 'other' ELSE concat('lens_L', CAST(1 + event_id % 4 AS STRING)) END AS event FROM {events}""",
    "contrib": """SELECT conv_id AS run_id, CASE role WHEN 'user' THEN 'pm' WHEN 'assistant' THEN 'qa' ELSE 'backend' END AS perspective, turn AS item_no, text AS consideration, concat('s', CAST(turn % 4 AS STRING)) AS section,
        CASE WHEN turn % 5 = 0 THEN 'open' WHEN turn % 5 = 1 THEN 'decided' WHEN turn % 5 = 2 THEN 'supported' WHEN turn % 5 = 3 THEN 'carried' ELSE 'dismissed' END AS status,
        concat(CAST(conv_id AS STRING), '/', CASE role WHEN 'user' THEN 'pm' WHEN 'assistant' THEN 'qa' ELSE 'backend' END, '/', lpad(CAST(turn AS STRING), 2, '0')) AS item_id FROM {conversations}""",
    "eval": """SELECT l.doc_id, l.quality = 0 AS gold_blocking, d.n_chars < 400 OR l.doc_id % 11 = 0 AS predicted_blocking, d.lang AS dimension FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "files": """SELECT doc_id % 50 AS run_id, concat('docs/', CAST(doc_id AS STRING), '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, text FROM {documents}""",
}

#: A dictionary of terms, and patterns for leaks.
TERMS = [("und", ["and"], ["hand", "land"]), ("suffix", ["ent"], ["ment", "enter"]), ("of the", ["th the"], []), ("permission notice", ["License"], ["MIT License"])]
PATTERNS = [("email", r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+"), ("token", r'token = "[0-9a-f]{40}"'), ("license", r"licen[sc]e|copyright")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def expanded(sql: str) -> str:
    """The text with inputs put in; only tables are left in braces."""
    while found := [n for n in re.findall(r"\{(\w+)\}", sql) if n in INPUTS]:
        for n in found:
            sql = sql.replace("({" + n + "})", "(" + INPUTS[n] + ")").replace("{" + n + "}", "(" + INPUTS[n] + ")")
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A select over tables and inputs, or an input by its name."""
    text = expanded(INPUTS.get(sql, sql))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def duck(sql: str) -> str:
    """The same for DuckDB."""
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", expanded(sql))


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return put


def terms(spark: SparkSession, rows_: list = TERMS) -> DataFrame:
    return spark.createDataFrame(rows_, "canonical string, forbidden array<string>, excepted array<string>")


def values_sql(rows_: list = TERMS) -> str:
    """The dictionary as a DuckDB select."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    array = lambda a: "[" + ", ".join(map(text, a)) + "]::VARCHAR[]"
    return "(SELECT * FROM (VALUES " + ", ".join(f"({text(c)}, {array(f)}, {array(e)})" for c, f, e in rows_) + ") t(canonical, forbidden, excepted))"
