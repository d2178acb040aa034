"""End-to-end plans of the behaviour-score study over the test tables.

``StudyInputs`` builds the lazy fact and dimensions once per call; each plan
function returns a DataFrame. Only one aggregated row (the data window) is
brought to the driver, to turn detected months into literal date bounds that
reach the scan as pushed filters.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.config import CREDITLINE_GROUPS, FUNNEL_BUCKET_MAX, SCORE_AVAILABILITY_MAX_MOB, StudyConfig
from vintagekit.functions.dates import month_end_of
from vintagekit.operators import asof as AS
from vintagekit.operators import cube as CU
from vintagekit.operators import distinct as DI
from vintagekit.operators import payload as PL
from vintagekit.operators import population as P
from vintagekit.operators import rank as R
from vintagekit.session import checkpoint_dir, prepare
from vintagekit.sources import testdata as TD

CFG = StudyConfig()


@dataclass
class StudyInputs:
    spark: SparkSession
    sf_dir: str
    fact: DataFrame
    products: DataFrame
    cfg: StudyConfig
    window_start: dt.date
    window_end: dt.date

    @property
    def exclude_from(self) -> dt.date:
        return P.exclusion_start(self.cfg, self.window_start)

    @property
    def excluded(self) -> DataFrame:
        return P.exclusion_set(self.fact, self.cfg, self.window_start)

    def cohort(self, **kw) -> DataFrame:
        return P.cohort_bulk(self.fact, self.cfg, self.window_start, self.window_end, self.products, **kw)

    def cohort_pairs(self, months: list[str] | None = None) -> DataFrame:
        return R.eligible_pairs(self.cohort(), self.cfg, months=months)

    def snapshot(self, **kw) -> DataFrame:
        """Subject and benchmark rows of the snapshot month, one pass, with exclusion and tier flags."""
        return P.snapshot_pass(self.fact, self.cfg, self.products, benchmark=True, exclude_from=self.exclude_from, **kw)


def staged_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A in the session's staging folder (SRC5), sorted by month inside each file so date-bounded scans
    skip row groups. A warehouse that holds the fact hands it to the operators directly."""
    from vintagekit.sources.cache import cache_or_compute, source_path
    return cache_or_compute(spark, source_path(spark, "account_month", TD.source_files(sf_dir)),
                            lambda: TD.account_month_fact(spark, sf_dir),
                            required=["creditaccountid", "reportingdate", "bhvr_score"],
                            sort_within=["reportingdate"])


_WINDOWS: dict[tuple, tuple[dt.date, dt.date, dt.date]] = {}


def inputs(spark: SparkSession, sf_dir: str, cfg: StudyConfig = CFG) -> StudyInputs:
    """Fact, dimensions and the detected window (one aggregated row, computed once per session and scope). A
    configuration without a snapshot month gets the detected one."""
    prepare(spark, TD.source_files(sf_dir))
    fact = staged_fact(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, cfg)
    if key not in _WINDOWS:
        _WINDOWS[key] = P.resolve_window(fact, cfg)
    start, end, snapshot = _WINDOWS[key]
    if cfg.snapshot_month is None:
        cfg = replace(cfg, snapshot_month=snapshot)
    return StudyInputs(spark, sf_dir, fact, TD.product_dimension(spark, sf_dir), cfg, start, end)


def tie_aware_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cohort (all board months, all reads in one pass) -> tie-aware deciles per read."""
    s = inputs(spark, sf_dir)
    return R.tie_aware_deciles(s.cohort_pairs(), ["read_key"], k=s.cfg.n_deciles)


# ----------------------------------------------------------------------------
# sources, window, account sets
# ----------------------------------------------------------------------------

def scan_account_month(spark, sf_dir):
    """SRC1: the account-month fact (adapter A)."""
    prepare(spark, TD.source_files(sf_dir))
    return TD.account_month_fact(spark, sf_dir)


def dim_enrich(spark, sf_dir):
    """J1 + J2: fact with channel and the month-end scorecard identifier."""
    prepare(spark, TD.source_files(sf_dir))
    fact = TD.account_month_fact(spark, sf_dir)
    return P.dim_enrich(fact, TD.product_dimension(spark, sf_dir), TD.month_end_info(spark, sf_dir))


def data_window(spark, sf_dir):
    prepare(spark, TD.source_files(sf_dir))
    return P.data_window(staged_fact(spark, sf_dir), CFG)


def exclusion_set(spark, sf_dir):
    return inputs(spark, sf_dir).excluded


def tier_accounts(spark, sf_dir):
    prepare(spark, TD.source_files(sf_dir))
    return P.tier_accounts(staged_fact(spark, sf_dir), CFG)


def _bounds(s: StudyInputs):
    return month_end_of(s.window_start), month_end_of(s.window_end)


def available_cohorts(spark, sf_dir):
    """Boarded cohorts by (vintage, program, channel) with maturity counts."""
    s = inputs(spark, sf_dir)
    lo, hi = _bounds(s)
    br = P.boards(s.fact, s.cfg, lo, hi, s.products)
    mob = s.fact.filter(F.col("cardid").isNotNull()).groupBy(P.ACCT).agg(F.max("monthsonbooks").alias("max_mob_observed"))
    j = br.join(mob, P.ACCT, "left")
    m = F.coalesce(F.col("max_mob_observed"), F.lit(-1))
    return j.groupBy("vintage", "program_code", "channel").agg(
        F.count(F.lit(1)).alias("accounts"), F.min("opendate").alias("min_opendate"),
        F.max("opendate").alias("max_opendate"), F.avg("creditline").alias("avg_creditline"),
        F.sum((m >= 4).cast("long")).alias("matured_mob4"), F.sum((m >= 6).cast("long")).alias("matured_mob6"),
        F.max("max_mob_observed").alias("max_mob_observed"))


def score_availability(spark, sf_dir):
    """P5: for every cohort, accounts with a row / a score / a valid score by MOB 1..max."""
    s = inputs(spark, sf_dir)
    lo, hi = _bounds(s)
    br = P.boards(s.fact, s.cfg, lo, hi, None).select("vintage", P.ACCT)
    rows = s.fact.filter(F.col("cardid").isNotNull() & F.col("monthsonbooks").between(1, SCORE_AVAILABILITY_MAX_MOB)) \
        .select(P.ACCT, "monthsonbooks", "bhvr_score")
    j = br.join(rows, P.ACCT, "left")
    counts = {"boarded_accounts_with_row": F.lit(True), "accounts_with_score": F.col("bhvr_score").isNotNull(),
              "accounts_with_valid_score": P.valid_score(s.cfg)}
    maps = DI.id_bitmaps(j, ["vintage", F.col("monthsonbooks").alias("score_mob")], P.ACCT, counts,
                         F.min("bhvr_score").alias("min_score"), F.max("bhvr_score").alias("max_score"))
    g = DI.distinct_counts(maps, ["vintage", "score_mob"], list(counts), F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"))
    return g.withColumn("valid_score_rate_among_rows",
                               R.safe_div("accounts_with_valid_score", "boarded_accounts_with_row"))


# ----------------------------------------------------------------------------
# cohort and snapshots
# ----------------------------------------------------------------------------

def cohort_bulk(spark, sf_dir):
    """Cohort rows (account x read) for every board month in one pass."""
    return inputs(spark, sf_dir).cohort()


def cohort_point_in_time(spark, sf_dir):
    """Cohort in point-in-time mode."""
    return inputs(spark, sf_dir).cohort(mode="point_in_time")


def cohort_month(spark, sf_dir):
    """One board month (the first), score and performance rows without date bounds."""
    s = inputs(spark, sf_dir)
    return P.cohort_month(s.fact, s.cfg, s.window_start, s.products)


GIVEN_MONTH = dt.date(1998, 6, 1)
GIVEN = replace(CFG, snapshot_month=GIVEN_MONTH)


def _portfolio(s: StudyInputs):
    return P.portfolio_snapshot(s.fact, s.cfg, s.products, s.exclude_from)


def portfolio_snapshot(spark, sf_dir):
    """Eligible, valid-score subject snapshot rows per read."""
    return _portfolio(inputs(spark, sf_dir))


def portfolio_snapshot_given(spark, sf_dir):
    """P11 for a given snapshot month."""
    return _portfolio(inputs(spark, sf_dir, GIVEN))


def _closest(s: StudyInputs):
    return P.portfolio_closest_score(s.fact, s.cfg, s.products)


def portfolio_closest_score(spark, sf_dir):
    """P12 + J5: snapshot with the closest valid score in each read's window."""
    return _closest(inputs(spark, sf_dir))


def portfolio_closest_score_given(spark, sf_dir):
    """P12 for a given snapshot month."""
    return _closest(inputs(spark, sf_dir, GIVEN))


def _asof(spark, sf_dir, direction, **kw):
    """Boarding rows of the month-end account table (J5's left side) with the score row nearest in time; a third of all
    accounts are one key."""
    fact = staged_fact(spark, sf_dir)
    owner = F.when(F.col(P.ACCT) % 3 == 0, F.lit(0)).otherwise(F.col(P.ACCT)).alias("owner")
    mid = F.date_sub("reportingdate", 10).alias("at")
    left = fact.where(F.col("newaccountindicator") == 1).select(owner, P.ACCT, F.col("cardid").alias("board_card"), mid)
    right = fact.where(P.valid_score(CFG)).select(owner, "reportingdate", "bhvr_score", "cardid", "card_part", "card_supp")
    return AS.asof_join(left, right, ["owner"], "at", "reportingdate", ["bhvr_score", "cardid"], direction,
                        ties=["cardid", "card_part", "card_supp"], **kw)


def asof_forward(spark, sf_dir):
    """J5 as an operator on two tables: the first valid score at or after the date."""
    prepare(spark, TD.source_files(sf_dir))
    return _asof(spark, sf_dir, "forward")


def asof_backward(spark, sf_dir):
    """J5 backward, at most 45 days."""
    prepare(spark, TD.source_files(sf_dir))
    return _asof(spark, sf_dir, "backward", tolerance=45)


def asof_nearest(spark, sf_dir):
    """J5 either way, at most 400 days, the later of two equally near."""
    prepare(spark, TD.source_files(sf_dir))
    return _asof(spark, sf_dir, "nearest", tolerance=400, prefer="forward")


def _benchmark(s: StudyInputs):
    return P.benchmark_snapshot(s.fact, s.cfg, s.products, s.exclude_from)


def benchmark_snapshot(spark, sf_dir):
    """Benchmark population with credit-line groups."""
    return _benchmark(inputs(spark, sf_dir))


def _diag_rows(s: StudyInputs):
    return P.subject_rows(P.snapshot_pass(s.fact, s.cfg, s.products), s.cfg)


def snapshot_diagnostics(spark, sf_dir):
    """By (read, board month, source, program, channel) before score/eligibility filters."""
    s = inputs(spark, sf_dir)
    d = _diag_rows(s)
    valid = P.valid_score(s.cfg)
    elig = (F.coalesce(F.col("has_horizon"), F.lit(0)) == 1) | (F.coalesce(F.col("chargeoff"), F.lit(0)) == 1)
    keys = ["read_key", "board_month", "snapshot_population_source", "program_code", "channel"]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("active_or_new_snapshot_accounts"),
        F.sum((F.col("activeaccountindicator") == 1).cast("long")).alias("active_snapshot_accounts"),
        F.sum((F.col("newaccountindicator") == 1).cast("long")).alias("new_board_snapshot_accounts"),
        F.sum(F.col("bhvr_score").isNotNull().cast("long")).alias("accounts_with_score"),
        F.sum(F.coalesce(valid, F.lit(False)).cast("long")).alias("accounts_with_valid_score"),
        F.sum(elig.cast("long")).alias("eligible_accounts"),
        F.sum(F.coalesce(valid & elig, F.lit(False)).cast("long")).alias("eligible_valid_score_accounts"),
        F.sum(F.coalesce(valid & elig & (F.coalesce(F.col("target"), F.lit(0)) == 1), F.lit(False)).cast("long"))
        .alias("bads_valid_score"),
        F.avg(F.when(valid, F.col("bhvr_score").cast("double"))).alias("avg_valid_score"))


def snapshot_summary(spark, sf_dir):
    """Diagnostics re-aggregated by board month with three rates."""
    d = snapshot_diagnostics(spark, sf_dir)
    sums = ["active_or_new_snapshot_accounts", "active_snapshot_accounts", "new_board_snapshot_accounts",
            "accounts_with_score", "accounts_with_valid_score", "eligible_accounts",
            "eligible_valid_score_accounts", "bads_valid_score"]
    g = d.groupBy("read_key", "board_month").agg(*[F.sum(c).alias(c) for c in sums])
    return (g.withColumn("valid_score_rate", R.safe_div("accounts_with_valid_score", "active_or_new_snapshot_accounts"))
            .withColumn("eligible_valid_score_rate",
                        R.safe_div("eligible_valid_score_accounts", "active_or_new_snapshot_accounts"))
            .withColumn("bad_rate_valid_score", R.safe_div("bads_valid_score", "eligible_valid_score_accounts")))


def _status_rows(s: StudyInputs):
    return P.snapshot_pass(s.fact, s.cfg, s.products, subject="score_card")


def score_status(spark, sf_dir):
    """P16 + F8: snapshot score status counts with min/max/avg score."""
    s = inputs(spark, sf_dir)
    d = _status_rows(s).withColumn("snapshot_score_status", P.score_status(s.cfg))
    keys = ["board_month", "snapshot_population_source", "program_code", "channel", "snapshot_score_status"]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accounts"), F.min("bhvr_score").alias("min_snapshot_score"),
        F.max("bhvr_score").alias("max_snapshot_score"),
        F.avg(F.col("bhvr_score").cast("double")).alias("avg_snapshot_score"))


def invalid_scores(spark, sf_dir):
    """Frequencies of invalid snapshot score values."""
    s = inputs(spark, sf_dir)
    d = _status_rows(s).filter(~F.coalesce(P.valid_score(s.cfg), F.lit(False)))
    keys = ["board_month", "snapshot_population_source", "program_code", "channel",
            F.col("bhvr_score").alias("snapshot_bhvr_score")]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounts"))


def funnel(spark, sf_dir):
    """Five parallel step counts at the snapshot in one scan."""
    s = inputs(spark, sf_dir)
    obs = month_end_of(s.cfg.snapshot_month)
    f = s.fact.filter((F.col("reportingdate") == F.lit(obs)) & F.col("cardid").isNotNull() & P.program_filter(s.cfg))
    an = P.active_or_new()
    c = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
    return f.agg(F.count(F.lit(1)).alias("step1_rows_at_snapshot"), c(an).alias("step2_active_or_new"),
                 c(an & (F.col("creditline") == F.lit(s.cfg.creditline_tier))).alias("step3_snapshot_cl_tier"),
                 c(an & P.valid_score(s.cfg)).alias("step4_valid_score"),
                 c(an & (F.col("dimbucketid") <= FUNNEL_BUCKET_MAX)).alias("step5_current_or_30dpd"))


def read_funnel(spark, sf_dir):
    """Per read - pulled, not excluded, and boarded at the tier."""
    s = inputs(spark, sf_dir)
    rows = P.snapshot_pass(s.fact, s.cfg, s.products, exclude_from=s.exclude_from)
    pulled = P.portfolio_rows(rows, s.cfg, more=("excluded", "at_tier"))
    kept = F.coalesce("excluded", F.lit(0)) == 0
    return pulled.groupBy("read_key").agg(
        F.count(F.lit(1)).alias("pulled"), F.sum(kept.cast("long")).alias("not_excluded"),
        F.sum((kept & (F.col("at_tier") == 1)).cast("long")).alias("at_tier"))


def board_reconciliation(spark, sf_dir):
    """P20: distinct boards by board month (any line / at tier) and a TOTAL row
    that adds the months; ``boards_once`` counts an account of several months once in the TOTAL."""
    s = inputs(spark, sf_dir)
    lo, hi = _bounds(s)
    f = s.fact.filter(F.col("cardid").isNotNull() & (F.col("newaccountindicator") == 1) & P.program_filter(s.cfg)
                      & (F.col("reportingdate") >= F.lit(lo)) & (F.col("reportingdate") <= F.lit(hi)))
    counts = {"boards_any_cl": F.lit(True), "boards_at_tier": F.col("creditline") == F.lit(s.cfg.creditline_tier)}
    maps = DI.id_bitmaps(f, [F.date_format(F.trunc("opendate", "month"), "yyyy-MM").alias("board_month")], P.ACCT, counts,
                         F.sum(F.col("creditline").cast("decimal(38,6)")).alias("_line"), F.count("creditline").alias("_lines"))
    g = DI.distinct_counts(maps, ["board_month"], list(counts), (F.sum("_line").cast("double") / F.sum("_lines")).alias("avg_creditline"))
    g = g.withColumn("boards_once", F.col("boards_any_cl"))
    total = g.agg(F.lit("TOTAL").alias("board_month"), F.sum("boards_any_cl").alias("boards_any_cl"),
                  F.sum("boards_at_tier").alias("boards_at_tier"),
                  F.lit(None).cast("double").alias("avg_creditline"))
    total = R._join(total, DI.union_counts(maps, ["boards_any_cl"]).withColumnRenamed("boards_any_cl", "boards_once"), [])  # a row each
    out = g.unionByName(total)
    return out.withColumn("tier_share", R.safe_div("boards_at_tier", "boards_any_cl"))


# ----------------------------------------------------------------------------
# rank-order analytics on the cohort
# ----------------------------------------------------------------------------

def _priced_lines(spark, sf_dir):
    """Order lines by status with a real-valued score (the price) and a flag (returned)."""
    prepare(spark, TD.source_files(sf_dir))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_linestatus", F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("bad"))


#: Ranges for the real-valued queries: a range of the 100 TB case holds a few million distinct scores.
RANGES = 200


def real_score_deciles(spark, sf_dir):
    """R1 and W1 on a real-valued score."""
    return R.tie_aware_deciles(_priced_lines(spark, sf_dir), ["l_linestatus"], "price", ranges=RANGES)


def real_score_quantiles(spark, sf_dir):
    """R2 on a real-valued score."""
    return R.quantile_deciles_ranged(_priced_lines(spark, sf_dir), ["l_linestatus"], "price", ranges=RANGES)


def quantile_deciles(spark, sf_dir):
    return R.quantile_deciles(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])


def overall_summary(spark, sf_dir):
    s = inputs(spark, sf_dir)
    return R.overall_summary(R.eligible_pairs(s.cohort(), s.cfg, mark="eligible"), ["read_key"])


def segment_tables(spark, sf_dir):
    return R.segment_tables(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])


def rank_diagnostics(spark, sf_dir):
    dec = R.quantile_deciles(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])
    return R.rank_diagnostics(dec, ["read_key"])


def d1_d10_lift(spark, sf_dir):
    dec = R.tie_aware_deciles(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])
    return R.d1_d10_lift(dec, ["read_key"])


def reversals(spark, sf_dir):
    dec = R.tie_aware_deciles(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])
    return R.reversals(dec, ["read_key"])


def kpi_strip(spark, sf_dir):
    return R.kpi_strip(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])


def verdict(spark, sf_dir):
    return R.verdict(inputs(spark, sf_dir).cohort_pairs(), [])


def gains_curve(spark, sf_dir):
    dec = R.tie_aware_deciles(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])
    return R.gains_curve(dec, ["read_key"])


def read_comparison(spark, sf_dir):
    return R.read_comparison(inputs(spark, sf_dir).cohort_pairs(), ["read_key"])


def month_stats(spark, sf_dir):
    return R.month_stats(inputs(spark, sf_dir).cohort_pairs(), "vintage", ["read_key"])


def _stored_cube(spark, sf_dir) -> str:
    """The cohort's counts by read, month and score, written in two goes: the months up to the middle, then the rest."""
    s = inputs(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/cube-{uuid.uuid4().hex}"
    cube = CU.month_cube(s.cohort_pairs(), ["read_key"], F.col("vintage"))
    middle = f"{(s.window_start.year + s.window_end.year) // 2}-06"
    CU.write_months(cube.where(F.col(CU.MONTH) <= middle), path)
    CU.write_months(cube.where(F.col(CU.MONTH) > middle), path)
    return path


def _selections(spark, sf_dir) -> DataFrame:
    """Counts of three selections of months, read from the stored state alone."""
    path = _stored_cube(spark, sf_dir)
    months = CU.stored_months(spark, path)
    out = None
    some = [m for m in months if m.endswith(("-02", "-07"))] or ["none"]  # an empty list would take all
    for name, picked in (("all", []), ("first", months[:3]), ("some", some)):
        rows = CU.select_months(spark, path, picked).withColumn("selection", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def selected_deciles(spark, sf_dir):
    """F20 + R16: deciles of three selections of months from the stored counts."""
    return CU.deciles(_selections(spark, sf_dir), ["selection", "read_key"])


def selected_gains(spark, sf_dir):
    """F20 + R10."""
    return R.gains_curve(selected_deciles(spark, sf_dir), ["selection", "read_key"])


def selected_kpis(spark, sf_dir):
    """F20 + R8."""
    return CU.kpis(_selections(spark, sf_dir), ["selection", "read_key"])


def stored_month_stats(spark, sf_dir):
    """R13 from the stored counts."""
    return CU.month_stats(CU.select_months(spark, _stored_cube(spark, sf_dir)), ["read_key"])


def cube_months_touched(spark, sf_dir):
    """Adding to the state: the last month is written again with the counts of both halves of its accounts merged. Per
    month its accounts, and whether its files are others than before."""
    path = _stored_cube(spark, sf_dir)
    pairs = inputs(spark, sf_dir).cohort_pairs()
    last = CU.stored_months(spark, path)[-1]

    def files(name):
        rows = CU.select_months(spark, path)
        found = rows.groupBy(CU.MONTH, F.col("_metadata.file_name").alias("f")).agg(F.sum("n").alias("n"))
        found = found.groupBy(CU.MONTH).agg(F.sort_array(F.collect_set("f")).alias(name), F.sum("n").alias(f"{name}_n"))
        return spark.createDataFrame(found.collect(), found.schema)  # a row a month, as it is now

    before = files("before")
    halves = [CU.month_cube(pairs.where(F.col(P.ACCT) % 2 == i), ["read_key"], F.col("vintage")).where(F.col(CU.MONTH) == last) for i in (0, 1)]
    CU.write_months(CU.merge_cubes(*halves), path)
    both = before.join(files("after"), CU.MONTH, "full")
    return both.select(CU.MONTH, F.col("before_n").alias("accounts"), F.col("after_n").alias("accounts_after"), (F.col("before") != F.col("after")).alias("touched"))


def tie_aware_deciles_months(spark, sf_dir):
    """R16 + F20: deciles of the first three board months only."""
    s = inputs(spark, sf_dir)
    start = s.window_start.year * 12 + s.window_start.month - 1
    months = [f"{(start + i) // 12:04d}-{(start + i) % 12 + 1:02d}" for i in range(3)]
    return R.tie_aware_deciles(s.cohort_pairs(months), ["read_key"], k=s.cfg.n_deciles)


WIDE = replace(CFG, program_codes=("AUTO", "BUIL", "FURN", "HOUS", "MACH"), creditline_tier=None)


def verdict_wide(spark, sf_dir):
    """R9 over all programs and credit lines."""
    return R.verdict(inputs(spark, sf_dir, WIDE).cohort_pairs(), [])


def _snapshot_pairs(s: StudyInputs) -> DataFrame:
    """Subject portfolio and benchmark groups as one population-labelled frame, from one pass."""
    rows = P.not_excluded(s.snapshot())
    port = P.portfolio_rows(rows.filter(F.col("at_tier") == 1), s.cfg).withColumn("population", F.lit("subject"))
    bench = P.benchmark_rows(rows, s.cfg).withColumn("population", F.col("benchmark_group"))
    cols = ["population", "read_key", P.ACCT, "bhvr_score", "metric_eligible", "target", "creditline"]
    return R.eligible_pairs(port.select(*cols).unionByName(bench.select(*cols)), s.cfg)


def benchmark_summary(spark, sf_dir):
    """KPI strip per population (subject portfolio and benchmark groups) and read."""
    s = inputs(spark, sf_dir)
    return R.kpi_strip(_snapshot_pairs(s), ["population", "read_key"])


def benchmark_overlay(spark, sf_dir):
    """Decile series of all populations on the requested read; here a read that is not there, so the first
    one with subject rows is taken."""
    s = inputs(spark, sf_dir)
    return R.overlay_series(_snapshot_pairs(s), "b90_w9", [r.key for r in s.cfg.reads], "subject", k=s.cfg.n_deciles)


def lift_comparison(spark, sf_dir):
    """Lift-normalised comparison across populations."""
    s = inputs(spark, sf_dir)
    return R.lift_comparison(_snapshot_pairs(s), ["population", "read_key"])


def lift_table(spark, sf_dir):
    """Each decile's lift over its population's rate."""
    s = inputs(spark, sf_dir)
    return R.lift_table(_snapshot_pairs(s), ["population", "read_key"])


_BY_GROUP = ["benchmark_group", "read_key"]


def _group_pairs(s: StudyInputs) -> DataFrame:
    return R.eligible_pairs(_benchmark(s), s.cfg)


def grouped_rank_order(spark, sf_dir):
    """Quantile deciles per benchmark credit-line group and read."""
    return R.quantile_deciles(_group_pairs(inputs(spark, sf_dir)), _BY_GROUP)


def grouped_summary(spark, sf_dir):
    """R3 per benchmark credit-line group and read."""
    s = inputs(spark, sf_dir)
    bench = _benchmark(s)
    return R.overall_summary(R.eligible_pairs(bench, s.cfg, mark="eligible"), _BY_GROUP)


def grouped_segments(spark, sf_dir):
    """R4 per benchmark credit-line group and read."""
    return R.segment_tables(_group_pairs(inputs(spark, sf_dir)), _BY_GROUP)


def grouped_diagnostics(spark, sf_dir):
    """R5 per benchmark credit-line group and read."""
    return R.rank_diagnostics(R.quantile_deciles(_group_pairs(inputs(spark, sf_dir)), _BY_GROUP), _BY_GROUP)


# ----------------------------------------------------------------------------
# activation
# ----------------------------------------------------------------------------

def _activation(s: StudyInputs):
    from vintagekit.operators import activation as A
    return A.activation_base(s.fact, s.cfg, s.window_start, s.window_end, s.exclude_from)


def activation_base(spark, sf_dir):
    return _activation(inputs(spark, sf_dir))


def activation_state(spark, sf_dir):
    """The mergeable state of T3-T7, merged from two halves of the accounts."""
    from vintagekit.operators import activation as A
    base = _activation(inputs(spark, sf_dir))
    half = F.col(P.ACCT) % 2
    return A.merge_states(A.activation_state(base.where(half == 0)), A.activation_state(base.where(half != 0)))


def _activation_state(spark, sf_dir):
    from vintagekit.operators import activation as A
    return A.activation_state(_activation(inputs(spark, sf_dir)))


def activation_by_month(spark, sf_dir):
    from vintagekit.operators import activation as A
    return A.activation_by_month(_activation_state(spark, sf_dir))


def activation_curve(spark, sf_dir):
    from vintagekit.operators import activation as A
    return A.activation_curve(_activation_state(spark, sf_dir))


def activation_histogram(spark, sf_dir):
    from vintagekit.operators import activation as A
    return A.activation_histogram(_activation_state(spark, sf_dir))


def activation_table(spark, sf_dir):
    from vintagekit.operators import activation as A
    return A.activation_table(_activation_state(spark, sf_dir))


def activation_by_score(spark, sf_dir):
    from vintagekit.operators import activation as A
    s = inputs(spark, sf_dir)
    scores = A.first_score_per_account(s.cohort(), s.cfg.reads[0].key)
    return A.activation_by_score(_activation(s), scores)


# ----------------------------------------------------------------------------
# payload and exports
# ----------------------------------------------------------------------------

def build_payload(s: StudyInputs) -> DataFrame:
    """One cohort pass and one snapshot pass; the snapshot rows carry their population."""
    reads = s.cfg.reads
    cohort = PL.with_dataset(PL.account_frame(s.cohort(), reads, "vintage", s.cfg),
                             "cohort-subject", "Cohort", "subject")
    rows = P.not_excluded(s.snapshot())
    cols = ["population", P.ACCT, "read_key", "board_month", "bhvr_score", "program_code", "channel", "creditline",
            "metric_eligible", "target"]
    port = P.portfolio_rows(rows.filter(F.col("at_tier") == 1), s.cfg).withColumn("population", F.lit("subject"))
    bench = P.benchmark_rows(rows, s.cfg).withColumn("population", F.col("benchmark_group"))
    snap = PL.account_frame(port.select(*cols).unionByName(bench.select(*cols)), reads, "board_month", s.cfg, keys=["population"])
    snap = PL.with_dataset(snap.withColumnRenamed("population", "group"), F.concat(F.lit("port-"), F.col("group")),
                           "Total Portfolio", F.col("group")).drop("group")
    return cohort.unionByName(snap)


def _payload(s: StudyInputs) -> DataFrame:
    """SNK6: written once per session, one folder per dataset, and read by everything that needs it."""
    from vintagekit.sources.cache import _complete, source_path
    path = source_path(s.spark, "payload", TD.source_files(s.sf_dir))
    got = _complete(s.spark, path, ["dataset_id", P.ACCT])
    if got is None:
        PL.write_payload(build_payload(s), path)
        got = s.spark.read.parquet(path)
    return got


def account_payload(spark, sf_dir):
    """SNK6: one row per (dataset, account) with e_<read>/b_<read> flags."""
    return _payload(inputs(spark, sf_dir))


def decile_export(spark, sf_dir):
    """SNK7: tie-aware deciles per (dataset, read) over the payload, written and read back."""
    import uuid

    from vintagekit.session import checkpoint_dir
    s = inputs(spark, sf_dir)
    long = PL.payload_long(_payload(s), s.cfg.reads).filter(F.col("eligible") == 1)
    path = f"{checkpoint_dir(spark).rstrip('/')}/decile-export-{uuid.uuid4().hex}"
    PL.write_deciles(R.tie_aware_deciles(long, ["dataset_id", "read_key"], score="score", bad="bad"), path)
    return spark.read.parquet(path)


def dataset_diagnostics(spark, sf_dir):
    """SNK8: expected datasets left-joined to payload counts, and the activation tracker."""
    from vintagekit.operators import activation as A
    s = inputs(spark, sf_dir)
    listed = [("cohort-subject", "Cohort / subject"), ("port-subject", "Total Portfolio / subject")]
    listed += [(f"port-{g}", f"Total Portfolio / {g}") for g in CREDITLINE_GROUPS]
    expected = spark.createDataFrame(listed, "dataset_id string, source string")
    scores = A.first_score_per_account(s.cohort(), s.cfg.reads[0].key)
    return PL.dataset_diagnostics(_payload(s), expected).unionByName(PL.activation_diagnostics(_activation(s), scores))


#: Accounts of a chunk here, so that the test tables give several chunks.
PAYLOAD_CHUNK = 64


def columnar_payload(spark, sf_dir):
    """SNK6: the payload packed into chunks of aligned arrays, written, read back and unpacked."""
    s = inputs(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/columnar-{uuid.uuid4().hex}"
    chunks, meta = PL.columnar_payload(_payload(s), s.cfg.reads, PAYLOAD_CHUNK)
    chunks.write.partitionBy("dataset_id").parquet(f"{path}/chunks")
    meta.write.parquet(f"{path}/meta")
    return PL.unpack_payload(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/meta"), s.cfg.reads)


def payload_metadata(spark, sf_dir):
    """SNK6: the metadata row of each dataset, lists as text, and the sizes of its chunks."""
    s = inputs(spark, sf_dir)
    chunks, meta = PL.columnar_payload(_payload(s), s.cfg.reads, PAYLOAD_CHUNK)
    sizes = chunks.groupBy("dataset_id").agg(F.max(F.size("score")).alias("largest_chunk"), F.count(F.lit(1)).alias("chunk_rows"))
    text = [F.array_join(c, ",").alias(c) for c in ("reads", "months", "programs", "channels")]
    return meta.join(sizes, "dataset_id").select("dataset_id", "prism", "population", "n", "chunks", "chunk_rows", "largest_chunk", *text)


def activation_export(spark, sf_dir):
    """SNK7: the activation-by-month sheet, written and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/activation-export-{uuid.uuid4().hex}"
    PL.write_activation(activation_by_month(spark, sf_dir), path)
    return spark.read.schema("board_month date, boarded long, activated long, pct_activated double").option("header", True).csv(path)


def restrict_accounts(spark, sf_dir):
    """The cohort of the accounts boarded at the tier (an allow-list), without the excluded ones."""
    s = inputs(spark, sf_dir)
    return P.exclude_accounts(P.restrict_accounts(s.cohort(exclude=False), P.tier_accounts(s.fact, s.cfg)), s.excluded)
