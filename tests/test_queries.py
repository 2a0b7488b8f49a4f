"""Registered evidence queries against their SQL, and their plans."""

from __future__ import annotations

import math

import duckdb
import pytest

from sightline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These share the work of t1_top_results and q19_method_comparison.
SLOW = {"q1_lexical_scores", "q5_entity_scores", "q6_action_scores", "q8_speaker_scores", "q10_fused_scores", "q14_reliability", "q15_interpretations", "t2_reliability_order", "q16_hypotheses", "q2_baselines", "q18_without_actions"}


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["j5_assign_speakers", "j7_points_in_utterances", "j1_spatial_relations", "t1_top_results"])
def test_no_products_in_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
