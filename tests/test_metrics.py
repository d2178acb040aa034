"""Ratio-of-sums rules of the response mart (the reference's own six checks),
plus suppression, validation and month parsing edges."""

import pytest
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.operators import metrics as M

SCHEMA = ("campaign_month string, vs_band string, scorecard int, volume long, responders long, Boards long, "
          "expected_responses double, expected_responses_xpm double")


def toy(spark):
    return spark.createDataFrame([
        ("2025-01", "A", 1, 1000, 50, 25, 60.0, 55.0),
        ("2025-01", "B", 1, 100, 30, 15, 25.0, 28.0),
        ("2025-02", "A", 1, 800, 40, 20, 50.0, 48.0),
        ("2025-02", "B", 1, 200, 20, 10, 18.0, 22.0),
    ], SCHEMA)


def test_actual_response_rate_uses_sum_over_sum(spark):
    out = M.aggregate_by(toy(spark), ["campaign_month"]).orderBy("campaign_month").collect()
    assert out[0].actual_response_rate == pytest.approx(80 / 1100)
    assert out[1].actual_response_rate == pytest.approx(60 / 1000)
    assert out[0].actual_response_rate != pytest.approx((50 / 1000 + 30 / 100) / 2)


def test_expected_rates_recomputed_from_sums(spark):
    out = M.aggregate_by(toy(spark), ["campaign_month"]).orderBy("campaign_month").collect()
    assert out[0].expected_rr_trm == pytest.approx(85 / 1100)
    assert out[0].expected_rr_xpm == pytest.approx(83 / 1100)


def test_actual_vs_expected_ratio(spark):
    out = M.aggregate_by(toy(spark), ["campaign_month"]).orderBy("campaign_month").collect()
    assert out[0].actual_vs_expected_trm == pytest.approx((80 / 1100) / (85 / 1100))


def test_kpi_totals_match_full_aggregate(spark):
    k = M.kpi_totals(toy(spark)).collect()[0]
    assert (k.volume, k.responders, k.Boards) == (2100, 140, 70)
    assert k.actual_response_rate == pytest.approx(140 / 2100)


def test_kpi_totals_empty_is_all_null(spark):
    k = M.kpi_totals(toy(spark).filter("false")).collect()[0]
    assert all(v is None for v in k)


def test_safe_div_handles_zero_denominator(spark):
    df = spark.createDataFrame([("2025-01", "A", 1, 0, 0, 0, 0.0, 0.0)], SCHEMA)
    assert M.aggregate_by(df, ["campaign_month"]).collect()[0].actual_response_rate is None


def test_suppression_nulls_rates_but_keeps_counts(spark):
    out = M.suppress_small_cells(M.aggregate_by(toy(spark), ["campaign_month", "vs_band"]), 500)
    small = out.filter("vs_band = 'B'").orderBy("campaign_month").collect()[0]
    assert small.volume == 100 and small.actual_response_rate is None and small.actual_board_rate is None


def test_xpm_rate_null_when_month_has_no_xpm(spark):
    df = toy(spark).withColumn("expected_responses_xpm",
                               F.when(F.col("campaign_month") == "2025-02", F.lit(None).cast("double"))
                               .otherwise(F.col("expected_responses_xpm")))
    out = {r.campaign_month: r for r in M.aggregate_by(df, ["campaign_month"]).collect()}
    assert out["2025-02"].expected_rr_xpm is None and out["2025-02"].expected_responses_xpm == 0.0
    assert out["2025-01"].expected_rr_xpm == pytest.approx(83 / 1100)


def test_overall_row_not_suppressed(spark):
    long = M.pivot_overall_long(toy(spark), "vs_band", "actual_response_rate", threshold=500).collect()
    levels = {(r.level, r.row_value, r.column_key): r.value for r in long}
    assert ("cell", "B", "2025-01") not in levels            # suppressed cell is not shown
    assert levels[("col_total", "Overall", "2025-01")] == pytest.approx(80 / 1100)
    assert levels[("grand", "Overall", "Overall")] == pytest.approx(140 / 2100)


def rollup(spark, rows):
    """Mart rows with all required columns; rows: (load month, campaign_month, volume, responders, Boards, expected, xpm)."""
    df = spark.createDataFrame(rows, "load_month string, campaign_month string, volume long, responders long, Boards long, "
                                     "expected_responses double, expected_responses_xpm double")
    have = set(df.columns)
    return df.select("*", *[F.lit(1).alias(c) for c in C.REQUIRED_ROLLUP_COLUMNS if c not in have])


def test_validation_compares_totals(spark):
    df = rollup(spark, [
        ("2025-01", "2025-01", 10, 12, 0, 1.0, 1.0), ("2025-01", "2025-01", 1000, 5, 0, 1.0, 1.0),   # one row over, total fine
        ("2025-02", "2025-02", 100, 150, 5, 10.0, 10.0),                                             # responders
        ("2025-03", "2025-03", 100, 10, 101, 10.0, 10.0),                                            # boards
        ("2025-04", "2025-04", 100, 10, 5, 500.0, None),                                             # warning only
        ("2025-05", "2025-05", -1, 0, 0, 0.0, None), ("2025-05", "2025-05", 5, 0, 0, 0.0, None),     # a negative row
        ("2025-06", "2025-07", 5, 0, 0, 0.0, -1.0), ("2025-08", None, 5, 0, 0, 0.0, None),           # foreign, null month
        ("2025-09", "2025-09", 0, 0, 0, 0.0, None)])
    attempts = spark.createDataFrame([(f"2025-{m:02d}",) for m in range(1, 11) if m != 7], "load_month string")
    v = {r.campaign_month: r for r in M.validate_rollup(df, attempts).collect()}
    assert v["2025-01"].ok and v["2025-01"].errors == v["2025-01"].warnings == ""
    assert v["2025-02"].errors == "responders exceed volume" and v["2025-03"].errors == "boards exceed volume"
    assert v["2025-04"].ok and v["2025-04"].warnings == "expected_responses outside [0, volume]"
    assert v["2025-05"].errors == "negative volume" and v["2025-08"].errors == "foreign campaign_month"
    assert v["2025-06"].errors == "foreign campaign_month" and "xpm" in v["2025-06"].warnings
    assert v["2025-09"].errors == "total volume not positive"
    assert v["2025-10"].errors == "rollup is empty" and v["2025-10"].row_count == 0 and not v["2025-10"].ok


def test_validation_without_a_required_column(spark):
    df = rollup(spark, [("2025-01", "2025-01", 10, 1, 1, 1.0, 1.0)]).drop("Boards")
    v = M.validate_rollup(df).collect()
    assert [r.ok for r in v] == [False] and v[0].errors == "missing required columns: Boards"


def test_wide_pivot_with_overall_and_text(spark):
    wide = M.pivot_overall(toy(spark), "vs_band", "actual_response_rate", ["2025-01", "2025-02"], threshold=150)
    rows = {r.Row: r.asDict() for r in wide.collect()}
    assert rows["A"]["2025-01"] == pytest.approx(0.05) and rows["B"]["2025-01"] is None
    assert rows["Overall"]["2025-01"] == pytest.approx(80 / 1100) and rows["Overall"]["Overall"] == pytest.approx(140 / 2100)
    assert rows["A"]["Overall"] == pytest.approx(90 / 1800)
    text = {r.Row: r.asDict() for r in M.formatted_pivot(wide, "actual_response_rate").collect()}
    assert text["A"]["2025-01"] == "5.00%" and text["B"]["2025-01"] == "\u2014" and text["Overall"]["Overall"] == "6.67%"
    one = spark.createDataFrame([(1234567.0, 1.236)], "n double, r double")
    assert one.select(M.format_metric(F.col("n"), "volume"), M.format_metric(F.col("r"), "actual_vs_expected_trm")).first() == ("1,234,567", "1.24")


def test_overall_equals_the_global_ratio(spark):
    long = M.pivot_overall_long(toy(spark), "vs_band", "actual_board_rate", threshold=0).collect()
    k = M.kpi_totals(toy(spark)).first()
    assert [r.value for r in long if r.level == "grand"] == [pytest.approx(k.actual_board_rate)]


def test_month_on_month_takes_the_previous_visible_month(spark):
    d = {(r.row_value, r.campaign_month): r for r in M.mom_delta(toy(spark), "vs_band", "actual_response_rate", threshold=150).collect()}
    assert set(d) == set()  # A does not move, B has one visible month only
    d = {r.row_value: r for r in M.mom_delta(toy(spark), "vs_band", "actual_response_rate", threshold=0).collect()}
    assert d["B"].direction == "down" and d["B"].intensity == 1.0 and d["B"].alpha == pytest.approx(0.70)


def test_missing_months_of_an_expected_list(spark):
    found = spark.createDataFrame([("2025-01",), ("2025-04",)], "campaign_month string")
    want = M.expected_months(found, end="2025-05")
    assert sorted(r[0] for r in M.missing_months(want, found).collect()) == ["2025-02", "2025-03", "2025-05"]


def test_parse_rollup_month(spark):
    names = spark.createDataFrame([("exp_JAN25_rollup.csv",), ("EXP_dec79_rollup.CSV",), ("exp_DEC80_rollup.csv",),
                                   ("exp_2025_rollup.csv",)], "file_name string")
    out = {r.file_name: r.campaign_month for r in M.parse_rollup_month(names).collect()}
    assert str(out["exp_JAN25_rollup.csv"]) == "2025-01-01"
    assert str(out["EXP_dec79_rollup.CSV"]) == "2079-12-01"
    assert str(out["exp_DEC80_rollup.csv"]) == "1980-12-01"
    assert out["exp_2025_rollup.csv"] is None


def test_blank_band_becomes_lowest(spark):
    df = spark.createDataFrame([(" ", "x", 5, 1), (None, "1", 5, 1)], "vs_band string, rm_flag string, volume long, x int")
    out = M.prepare_rollup(df).collect()
    assert [r.vs_band for r in out] == ["530-549", "530-549"]
    assert [r.rm_flag for r in out] == [None, 1]
    assert "expected_responses_xpm" in M.prepare_rollup(df).columns


def test_prepare_takes_names_in_any_case_and_drops_the_rates(spark):
    df = spark.createDataFrame([("A", "4", "x", 1.0, 2.0)], "VS_BAND string, Scorecard string, TRM10_TIER string, grr double, Nrr double")
    out = M.prepare_rollup(df)
    assert not {"grr", "nrr"} & {c.lower() for c in out.columns}
    assert out.first().scorecard == 4 and out.first().trm10_tier is None


def test_wide_pivots_lose_no_month(spark):
    from tests.conftest import SF_SMALL
    from vintagekit.plans import mart
    months = {r[0] for r in mart.mart_frame(spark, SF_SMALL).select("campaign_month").distinct().collect()}
    assert len(months) > 24
    for name in ("pivot_metric", "pivot_overall_wide", "formatted_pivot"):
        assert months <= set(getattr(mart, name)(spark, SF_SMALL).columns)
