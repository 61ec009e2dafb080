"""Queries over the taxonomy and graph made from the tables have something to say."""

import pytest

from cairnwatch.operators import scorers
from cairnwatch.plans import catalog, derived, scoring

OF_TABLES = "keyword_gen related_1hop related_2hop enrich_techniques relationships_top15 context_join capec_name_similarity graph_edges tactic_by_phase relationship_validation tactic_filter kev_with_cwe cwe_to_technique cwe_map_generate update_keywords graph_paths".split()


@pytest.mark.parametrize("name", OF_TABLES)
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(derived.TABLES))
def test_table_grows_with_its_sources(spark, sf_dir, name):
    small, large = (derived.derived(spark, d, name).count() for d in (sf_dir, "/root/testdata/sf0.01"))
    assert 0 < small <= large


@pytest.mark.parametrize("name", ["kev_with_cwe", "cwe_to_technique"])
def test_a_tasks_share_of_the_mappings_does_not_grow(spark, sf_dir, monkeypatch, name):
    want = sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(scoring, "DEALT_ROWS", 500)
    rows = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, rows.collect())) == want
    # 6,000 lineitems: twelve partitions, where the session's four would be merged into one.
    assert "REPARTITION_BY_NUM" in (plan := rows._jdf.queryExecution().toString()) and ", 12)" in plan


def test_ties_of_a_weakness_are_counted_once(spark):
    cwe = spark.createDataFrame([("C1", "W1"), ("C1", "W1"), ("C2", "W1"), ("C2", "W2"), (None, "W1")], "cve_id string, cwe_id string")
    direct = spark.createDataFrame([("C1", "T1", 0.5), ("C1", "T1", 0.9), ("C2", "T1", 0.5), ("C2", "T2", 0.5), (None, "T1", 0.5)], "cve_id string, technique_id string, confidence double")
    want = [("W1", "T1", 2), ("W1", "T2", 1), ("W2", "T1", 1), ("W2", "T2", 1)]
    for parts in (None, 7):
        assert sorted((r.cwe_id, r.technique_id, r.cve_count) for r in scorers.cwe_to_techniques(cwe, direct, parts).collect()) == want
