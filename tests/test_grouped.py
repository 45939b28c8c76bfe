"""Grouping of the graph's tables where they are large."""

from __future__ import annotations

import re

import pytest

from engramix.operators import graph
from engramix.plans import catalog, views

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c04_touching_relations", "j04_merged_entities"])
def test_parts_of_a_large_table_follow_its_rows(spark, monkeypatch, name):
    want = sorted(catalog.QUERIES[name](spark, FOLDER).collect())
    rows = views.table(spark, FOLDER, "lineitem").count()
    monkeypatch.setattr(views, "GROUPED", rows // 40)
    got = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-rows // views.GROUPED)}), REPARTITION_BY_NUM" in plan  # and no other shuffle before the grouping


def test_relations_are_grouped_once_for_both_ends(spark):
    plan = catalog.QUERIES["c04_touching_relations"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1


@pytest.mark.parametrize("name", ["c03_described_relations", "j04_merged_entities"])
def test_joins_of_a_large_graph_follow_its_rows(spark, monkeypatch, name):
    want = sorted(catalog.QUERIES[name](spark, FOLDER).collect())
    rows = views.table(spark, FOLDER, "lineitem").count()
    monkeypatch.setattr(views, "GROUPED", rows // 40)
    got = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    most = views.graph_parts(spark, FOLDER)
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) == {str(-(-rows // views.GROUPED)), str(most)} and most > 40
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and "Broadcast" not in plan  # a task sorts nothing and holds its own part


@pytest.mark.parametrize("parts", [None, 7])
def test_merged_entities_are_grouped_by_hash(spark, parts):
    rows = [(5, "Ann", "person", None), (2, "ann ", "person", 3), (1, "ANN", "person", 3), (3, "ann", "person", 1), (4, "ann", "project", 9), (7, "bo", "person", None), (6, "Bo", "person", None)]
    got = graph.merged(spark.createDataFrame(rows, "id long, name string, entity_type string, mention_count long"), parts)
    assert {(r.id, r.canonical_id) for r in got.collect()} == {(5, 1), (2, 1), (1, 1), (3, 1), (4, 4), (7, 6), (6, 6)}  # unknown counts come last
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [None, 7])
def test_repointed_keeps_the_first_of_each_triple(spark, parts):
    relations = spark.createDataFrame([(9, 1, "uses", 3), (8, 2, "uses", 4), (7, 2, "in", 3), (6, 1, "uses", 1), (5, 2, "uses", 2), (4, 1, "uses", 99)], "id long, source_id long, relation_type string, target_id long")
    same = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, canonical_id long")
    got = graph.repointed(relations, same, parts)
    assert {tuple(r) for r in got.collect()} == {(1, "uses", 3, 8), (1, "in", 3, 7), (1, "uses", 1, 5)}
