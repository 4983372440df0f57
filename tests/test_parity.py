"""Catalog queries against their SQL twins. COMARCA_ALL=1 runs every query, otherwise a cross-section."""

import os

import pytest
from parity import compare, oracle

SF = os.environ.get("COMARCA_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = """stage_cast normalize_name repair_mojibake title_case_es region_lookup type_columns scan_partitioned
write_partitioned latest_pull load_by_name variant_long melt_year_columns export_year_matrix snapshot_diff snapshot_as_of
join_null_safe join_full_outer splice_priority shared_boundary_edges annualize median_by_group quantile_summary column_profile
cum_deflator rank_topk holm_adjust running_index union_all_blocks union_distinct_codes date_spine expect_total_equals_members
table_diff_tolerance build_index distance_to_ideal fe_fit_terms spec_curve wild_cluster_bootstrap placebo_permute
pesaran_cd rolling_origin quality_gate scenario_fanout stream_annualize stream_ingest_once stream_upsert_current fc_arma exposure_placebo quadratic_bootstrap panel_with_vintage""".split()


def names():
    from comarca.plans import CATALOG

    return list(CATALOG) if os.environ.get("COMARCA_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip(f"no test data in {SF}")
    return oracle(SF)


@pytest.mark.parametrize("name", names())
def test_matches_oracle(spark, con, name):
    from comarca.plans import CATALOG

    ok, message = compare(CATALOG[name], spark, con, SF)
    assert ok, message


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["unit", "name", "region", "year", "quarters", "orders", "amount", "buyers", "growth"]
