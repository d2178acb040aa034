"""Card activation tracker: first active month after boarding, with censoring.

Lags are whole calendar months (small integers), so medians are taken from a
(group, lag) histogram instead of buffering each group's rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagekit.config import ACTIVATION_MAX_MONTHS, ACTIVATION_SCORE_BANDS, StudyConfig
from vintagekit.functions.dates import month_diff, month_end_of, month_start
from vintagekit.functions.nulls import safe_div
from vintagekit.operators import population as P
from vintagekit.operators.rank import histogram_quantiles

ACCT = "creditaccountid"


def activation_base(fact: DataFrame, cfg: StudyConfig, window_start: dt.date, window_end: dt.date,
                    exclude_from: dt.date | None = None) -> DataFrame:
    """T1 + T2: one row per boarded account: board month (of open date), first active
    date up to the window end, lag (-1 when never) and observable months. Boarding row, first active date and
    exclusion (``exclude_from``: since when a listed status reason excludes) are one aggregation by account."""
    start_eom, end_eom = month_end_of(window_start), month_end_of(window_end)
    upto = F.col("reportingdate") <= F.lit(end_eom)
    boarded = (upto & (F.col("reportingdate") >= F.lit(start_eom)) & (F.col("newaccountindicator") == 1) & P.program_filter(cfg))
    if cfg.creditline_tier is not None:
        boarded = boarded & (F.col("creditline") == F.lit(cfg.creditline_tier))
    excluded = P.excluded_flag(cfg, exclude_from) if exclude_from else F.lit(0)
    g = fact.filter(F.col("cardid").isNotNull()).groupBy(ACCT).agg(
        P.first_where(boarded, P.board_order(), [F.col("opendate")]).alias("_board"),
        F.min(F.when(upto & (F.col("activeaccountindicator") == 1), F.col("reportingdate"))).alias("first_active_date"),
        F.max(excluded).alias("_excluded") if not exclude_from else excluded.alias("_excluded"))
    g = g.filter(F.col("_board").isNotNull() & (F.coalesce("_excluded", F.lit(0)) == 0))
    out = g.select(ACCT, month_start("_board.opendate").alias("board_month"), "first_active_date")
    lag = F.when(F.col("first_active_date").isNull(), F.lit(-1)).otherwise(
        F.greatest(F.lit(0), month_diff("first_active_date", "board_month")))
    return (out.withColumn("act_lag", lag.cast("int"))
            .withColumn("obs_months", month_diff(F.lit(window_end), "board_month").cast("int")))


STATE = ("board_month", "obs_months", "act_lag")


def activation_state(base: DataFrame, *more: str) -> DataFrame:
    """The mergeable state behind T3-T7: accounts by board month, observable months and lag (and ``more``): calendar-
    bounded, and all the tables, curves and medians follow from it. Of a state, the state by fewer columns."""
    n = F.sum("accounts") if "accounts" in base.columns else F.count(F.lit(1))
    return base.groupBy(*STATE, *more).agg(n.alias("accounts"))


def merge_states(*states: DataFrame) -> DataFrame:
    """States of separate accounts as one."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "accounts"]
    return out.groupBy(*keys).agg(F.sum("accounts").alias("accounts"))


def _n(cond=None):
    """Accounts of a state's rows, or of those that meet a condition."""
    return F.coalesce(F.sum(F.col("accounts") if cond is None else F.when(cond, F.col("accounts"))), F.lit(0)).cast("long")


def activation_by_month(state: DataFrame) -> DataFrame:
    """Boarded, activated and share by board month."""
    return (state.groupBy("board_month").agg(_n().alias("boarded"), _n(F.col("act_lag") >= 0).alias("activated"))
            .withColumn("pct_activated", safe_div("activated", "boarded")))


def activation_curve(state: DataFrame, max_months: int = ACTIVATION_MAX_MONTHS) -> DataFrame:
    """T4: for t = 0..min(max observed, cap): activated by t among accounts observed >= t."""
    rows = state.filter(F.col("obs_months").isNotNull() & (F.col("obs_months") >= 0)).select(
        "act_lag", "accounts", F.explode(F.sequence(F.lit(0), F.least(F.col("obs_months"), F.lit(max_months)))).alias("t"))
    got = (F.col("act_lag") >= 0) & (F.col("act_lag") <= F.col("t"))
    return (rows.groupBy("t").agg(_n().alias("denom"), _n(got).alias("numer"))
            .withColumn("rate", safe_div("numer", "denom")))


def activation_histogram(state: DataFrame, max_lag: int = ACTIVATION_MAX_MONTHS) -> DataFrame:
    """T5: lag histogram with overflow bin at the cap; empty bins up to the largest lag kept."""
    active = state.filter(F.col("act_lag") >= 0)
    counts = active.groupBy(F.least(F.col("act_lag"), F.lit(max_lag)).alias("lag")).agg(_n().alias("n"))
    bins = active.agg(F.least(F.max("act_lag"), F.lit(max_lag)).alias("m")).select(
        F.explode(F.sequence(F.lit(0), F.col("m"))).alias("lag"))
    return bins.join(counts, "lag", "left").select("lag", F.coalesce("n", F.lit(0)).alias("n"))


def _median_lag(state: DataFrame, keys: list[str]) -> DataFrame:
    hist = state.filter(F.col("act_lag") >= 0).groupBy(*keys, "act_lag").agg(_n().alias("_n"))
    q = histogram_quantiles(hist, keys, "act_lag", "_n", F.array(F.lit(0.5)))
    return q.select(*keys, F.col("q").alias("median_lag"))


def activation_table(state: DataFrame) -> DataFrame:
    """By board month - % ever active, % active by months 1/3/6 among the
    accounts observable that long, median lag of the activated."""
    lag, obs = F.col("act_lag"), F.col("obs_months")
    aggs = [_n().alias("boarded"), _n(lag >= 0).alias("activated")]
    for t in (1, 3, 6):
        seen = obs.isNotNull() & (obs >= t)
        aggs += [_n(seen).alias(f"_d{t}"), _n(seen & (lag >= 0) & (lag <= t)).alias(f"_n{t}")]
    g = state.groupBy("board_month").agg(*aggs)
    g = g.select("board_month", "boarded", "activated",
                 safe_div("activated", "boarded").alias("pct_ever"),
                 *[safe_div(f"_n{t}", f"_d{t}").alias(f"pct_by_{t}") for t in (1, 3, 6)])
    return g.join(_median_lag(state, ["board_month"]), "board_month", "left")


def score_band(score_col: str = "bhvr_score"):
    """Activation score band; unscored and out-of-band accounts fall in the first band."""
    s = F.coalesce(F.col(score_col).cast("double"), F.lit(-1.0))
    expr = None
    for label, lo, hi in ACTIVATION_SCORE_BANDS[1:]:
        cond = (s >= lo) & (s <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(ACTIVATION_SCORE_BANDS[0][0])


def activation_by_score(base: DataFrame, scores: DataFrame) -> DataFrame:
    """T7 + J13: board x score-band crosstab; every band shown."""
    b = activation_state(base.join(scores.select(ACCT, "bhvr_score"), ACCT, "left").withColumn("score_band", score_band()), "score_band")
    g = b.groupBy("score_band").agg(_n().alias("boarded"), _n(F.col("act_lag") >= 0).alias("activated"))
    bands = b.sparkSession.createDataFrame(
        [(i, label) for i, (label, _, _) in enumerate(ACTIVATION_SCORE_BANDS)], "band_order int, score_band string")
    out = F.broadcast(bands).join(g, "score_band", "left").join(_median_lag(b, ["score_band"]), "score_band", "left")
    return out.select("band_order", "score_band", F.coalesce("boarded", F.lit(0)).alias("boarded"),
                      F.coalesce("activated", F.lit(0)).alias("activated"),
                      safe_div("activated", "boarded").alias("pct_activated"), "median_lag")


def first_score_per_account(cohort: DataFrame, read_key: str) -> DataFrame:
    """Score attached to activation rows: the cohort row of the first read (one per account)."""
    rows = cohort.filter(F.col("read_key") == read_key)
    return rows.groupBy(ACCT).agg(F.max("bhvr_score").alias("bhvr_score"))
