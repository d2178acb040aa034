"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Plans return full precision; doubles are rounded here, once, for comparison with other engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.plans import campaign, layouts, mart, studio


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns to ``digits`` places as round(x * 10^d) / 10^d, the same
    IEEE steps on every engine (so an exact half never rounds two ways)."""
    scale = float(10 ** digits)
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") * F.lit(scale), 0) / F.lit(scale)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _edge(plan: Callable) -> Callable:
    @wraps(plan)
    def query(spark, sf_dir):
        return rounded(plan(spark, sf_dir))
    return query


STUDY = """tie_aware_deciles scan_account_month dim_enrich data_window exclusion_set tier_accounts available_cohorts
score_availability cohort_bulk cohort_point_in_time cohort_month portfolio_snapshot portfolio_snapshot_given
portfolio_closest_score portfolio_closest_score_given benchmark_snapshot snapshot_diagnostics snapshot_summary
score_status invalid_scores funnel read_funnel board_reconciliation quantile_deciles overall_summary segment_tables
rank_diagnostics d1_d10_lift reversals kpi_strip verdict verdict_wide gains_curve read_comparison month_stats
tie_aware_deciles_months benchmark_summary benchmark_overlay lift_comparison lift_table grouped_rank_order
grouped_summary grouped_segments grouped_diagnostics activation_base activation_state activation_by_month activation_curve
activation_histogram activation_table activation_by_score real_score_deciles real_score_quantiles asof_forward asof_backward asof_nearest selected_deciles
selected_gains selected_kpis stored_month_stats cube_months_touched account_payload columnar_payload payload_metadata decile_export activation_export
dataset_diagnostics restrict_accounts"""
LAYOUTS = "enrich_in_place exclude_accounts restrict_fact board_rows"
CAMPAIGN = """campaign_windows mailfile_month applications first_application response_join final_response
campaign_flags vs_band fixed_cut_deciles campaign_rollup combined_rollup append_attributes engineered_features
woe_transforms feature_select feature_select_sc4"""
MART = """aggregate_by kpi_totals monthly_trend pivot_metric suppress_small_cells pivot_overall pivot_overall_wide
formatted_pivot exec_kpis trend_long model_by_band_trm model_by_band_xpm model_monthly model_by_tier
model_by_scorecard volume_mix mom_delta volume_share dict_filter month_window filter_options validate_rollup
validate_rollup_faulty validation_summary parse_rollup_month missing_months mart_replace_month read_mart mart_months
csv_rollup_roundtrip load_log ingest_plan ingest_summary ingest_isolation mart_swap mart_status filtered_export cache_or_compute cache_rules"""

QUERIES = {name: _edge(getattr(module, name))
           for module, names in ((studio, STUDY), (layouts, LAYOUTS), (campaign, CAMPAIGN), (mart, MART)) for name in names.split()}
