"""Registered queries of the library against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from docverify.plans import QUERIES, oracles
from docverify.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
#: A query of each family; the driver holds all against their SQL.
SOME = ["tx3_sections", "tx7_unstable_ids", "vf5_term_usage", "vf6_term_dictionary", "cu1_envelope_violations", "io4_snapshot_digest", "rv6_reviewer_eval", "tx4_blockquotes", "vf2_verbatim_match", "vf4_term_scan", "vf8_pattern_scan", "an3_missing_anchors", "dr4_honored_edges", "lg10_set_equality", "lg12_counter_evidence", "rc8_round_context", "gp1_manifest_violations", "sc1_section_scores", "pb2_publish_plan", "in5_port_drift", "cu4_curated_items", "cv3_answer_states", "rv4_convergence", "st1_trace_order"]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(oracles())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    answer = con.execute(oracles()[name])
    names = [c[0] for c in answer.description]
    want = [dict(zip(names, row, strict=True)) for row in answer.fetchall()]
    text = lambda r: "|".join(str(r[c]) for c in cols)
    assert sorted(text(r) for r in found.toArrow().to_pylist()) == sorted(text(r) for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["dr7_eligible_decisions", "dr8_registry_verdict"])
def test_verdicts_read_the_registry_once(spark, name):
    test_query_equals_sql(spark, name)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "examined-" in plan
