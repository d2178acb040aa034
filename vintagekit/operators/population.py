"""Population selection and performance windows of the behaviour-score study.

Every function is ``DataFrame -> DataFrame``. The fact is an account-month
table (see ``sources.testdata.account_month_fact``) with columns
creditaccountid, cardid, card_part, card_supp, reportingdate, opendate,
monthsonbooks, newaccountindicator, activeaccountindicator, chargeoffindicator,
dimbucketid, dimstatusreasonid, bhvr_score, esc, scorecard, reservationnumber,
dimproductofferedid, creditline, vantage3.

Physical design: a study population is one scan of the fact and one exchange on
``creditaccountid``. Best rows are minima of ordering structs, performance per
read is a conditional maximum and exclusion is a flag, all in one ``groupBy``
with a partial aggregate before the exchange, so an account with very many rows
is never held together. Reads are unpivoted afterwards - no per-read or
per-month loop and no cross join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.config import CREDITLINE_GROUPS, CREDITLINE_HIGH, CREDITLINE_MID, StudyConfig
from vintagekit.functions.dates import add_month_start, month_end_of, month_start
from vintagekit.functions.rows import first_row
from vintagekit.functions.nulls import blank, flag

ACCT = "creditaccountid"

# ----------------------------------------------------------------------------
# predicates (F1-F8)
# ----------------------------------------------------------------------------

def program_code(col: str = "reservationnumber") -> Column:
    return F.substring(F.col(col), 1, 4)


def campaign_code(col: str = "reservationnumber") -> Column:
    return F.substring(F.col(col), 1, 6)


def program_filter(cfg: StudyConfig, col: str = "reservationnumber") -> Column:
    """first four characters of the reservation number in the program list."""
    return program_code(col).isin(cfg.codes)


def not_program_filter(cfg: StudyConfig, col: str = "reservationnumber") -> Column:
    """not in the program list, keeping a null reservation number."""
    return F.col(col).isNull() | ~program_code(col).isin(cfg.codes)


def valid_score(cfg: StudyConfig, col: str = "bhvr_score") -> Column:
    """inclusive validity band; null is not valid."""
    return F.col(col).between(cfg.valid_min, cfg.valid_max)


def valid_score_filter(df: DataFrame, cfg: StudyConfig, col: str = "bhvr_score",
                       include_invalid: bool = False) -> DataFrame:
    return df if include_invalid else df.filter(valid_score(cfg, col))


def active_or_new() -> Column:
    """F5 predicate."""
    return (F.col("activeaccountindicator") == 1) | (F.col("newaccountindicator") == 1)


def population_source() -> Column:
    """F5 label."""
    return (F.when(F.col("activeaccountindicator") == 1, "active")
            .when(F.col("newaccountindicator") == 1, "new_board").otherwise("other"))


def score_status(cfg: StudyConfig, col: str = "bhvr_score") -> Column:
    """F8: valid / missing / below / above / other, labels derived from the limits."""
    s = F.col(col)
    lo, hi = cfg.valid_min, cfg.valid_max
    return (F.when(s.between(lo, hi), f"valid_{lo}_{hi}")
            .when(s.isNull(), "missing_score")
            .when(s < lo, f"below_{lo}_exception")
            .when(s > hi, f"above_{hi}_exception")
            .otherwise("other_invalid"))


def contractual(cfg: StudyConfig) -> Column:
    """Status reason outside the exclusion list; a null reason is not contractual."""
    return F.col("dimstatusreasonid").isNotNull() & ~F.col("dimstatusreasonid").isin(list(cfg.exclusion_ids))


# ----------------------------------------------------------------------------
# joins to dimensions
# ----------------------------------------------------------------------------

def dim_enrich(fact: DataFrame, products: DataFrame, month_end: DataFrame | None = None) -> DataFrame:
    """J1 + J2: channel from the product dimension and the scorecard identifier from the
    month-end table on (cardid, reportingdate)."""
    out = fact.join(products, "dimproductofferedid", "left")
    if month_end is not None:
        me = month_end.filter(F.col("cardid").isNotNull())
        out = out.join(me, ["cardid", "reportingdate"], "left")
    return out


def _with_channel(df: DataFrame, products: DataFrame | None) -> DataFrame:
    if products is None:
        return df.withColumn("channel", F.lit(None).cast("string"))
    return df.join(products, "dimproductofferedid", "left")


# ----------------------------------------------------------------------------
# data window, exclusion and tier sets
# ----------------------------------------------------------------------------

def data_window(fact: DataFrame, cfg: StudyConfig) -> DataFrame:
    """First board month, latest reporting date, latest complete month,
    board-month count and the snapshot month whose longest read has matured."""
    f = fact.filter(F.col("cardid").isNotNull() & program_filter(cfg))
    agg = f.agg(
        F.min(F.when(F.col("newaccountindicator") == 1, month_start("opendate"))).alias("first_board_month"),
        F.max("reportingdate").alias("latest_reporting_date"))
    latest = F.col("latest_reporting_date")
    complete = F.when(latest >= F.last_day(latest), F.trunc(latest, "month")).otherwise(
        F.add_months(F.trunc(latest, "month"), -1))
    offset = cfg.max_horizon - 1 if cfg.m1_inclusive else cfg.max_horizon
    return (agg.withColumn("latest_data_month", complete)
            .withColumn("board_months",
                        (F.year("latest_data_month") * 12 + F.month("latest_data_month")
                         - F.year("first_board_month") * 12 - F.month("first_board_month") + 1).cast("int"))
            .withColumn("portfolio_snapshot_month", F.add_months("latest_data_month", -offset)))


def resolve_window(fact: DataFrame, cfg: StudyConfig) -> tuple[dt.date, dt.date, dt.date]:
    """Driver-side (first board month, latest complete month, snapshot month): one aggregated row."""
    row = data_window(fact, cfg).select("first_board_month", "latest_data_month", "portfolio_snapshot_month").first()
    if row is None or row[0] is None or row[1] is None:
        raise ValueError("no subject accounts found for the configured program codes")
    return row[0], row[1], row[2]


def exclusion_set(fact: DataFrame, cfg: StudyConfig, window_start: dt.date) -> DataFrame:
    """Accounts that ever had a listed status reason since the look-back start."""
    start = exclusion_start(cfg, window_start)
    return (fact.filter(F.col("cardid").isNotNull() & (F.col("reportingdate") >= F.lit(start))
                        & F.col("dimstatusreasonid").isin(list(cfg.exclusion_ids)))
            .select(ACCT).distinct())


def tier_accounts(fact: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Accounts whose boarding row carried the configured credit line."""
    f = fact.filter(F.col("cardid").isNotNull() & (F.col("newaccountindicator") == 1) & program_filter(cfg))
    if cfg.creditline_tier is not None:
        f = f.filter(F.col("creditline") == F.lit(cfg.creditline_tier))
    return f.select(ACCT).distinct()


def exclude_accounts(df: DataFrame, excluded: DataFrame | None, on: Sequence[str] = (ACCT,)) -> DataFrame:
    """Anti join by account set. ``on``: the key columns that both sides are laid out by."""
    return df if excluded is None else df.join(excluded.select(*on), list(on), "left_anti")


def restrict_accounts(df: DataFrame, allowed: DataFrame | None, on: Sequence[str] = (ACCT,)) -> DataFrame:
    """Semi join; None = no-op."""
    return df if allowed is None else df.join(allowed.select(*on), list(on), "left_semi")


# ----------------------------------------------------------------------------
# best-row selection
# ----------------------------------------------------------------------------

def boards(fact: DataFrame, cfg: StudyConfig, start_eom: dt.date, end_eom: dt.date,
           products: DataFrame | None = None, tier: bool = True) -> DataFrame:
    """First boarding row per account (earliest month, largest card) in a month-end range."""
    f = fact.filter(
        (F.col("reportingdate") >= F.lit(start_eom)) & (F.col("reportingdate") <= F.lit(end_eom))
        & F.col("cardid").isNotNull() & (F.col("newaccountindicator") == 1) & program_filter(cfg))
    if tier and cfg.creditline_tier is not None:
        f = f.filter(F.col("creditline") == F.lit(cfg.creditline_tier))
    b = first_row(f, [ACCT], board_order())
    b = _with_channel(b, products)
    return b.select(
        month_start("reportingdate").alias("vintage"),
        F.col("reportingdate").alias("cohort_reportingdate"),
        "opendate", ACCT,
        F.col("cardid").alias("board_cardid"),
        "reservationnumber",
        program_code().alias("program_code"),
        campaign_code().alias("campaign_code"),
        "channel", "creditline")


def _down(*cols: str) -> list[Column]:
    """Keys of a descending order, nulls last, for use in an ordering struct."""
    return [k for c in cols for k in (F.col(c).isNull(), -F.col(c))]


def first_where(cond: Column, order: list[Column], fields: list[Column]) -> Column:
    """The fields of the first row under ``order`` among the rows where ``cond`` holds."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    return F.min(F.when(cond, F.struct(*keys, *fields)))


_CARD = ("cardid", "card_part", "card_supp")


def board_order() -> list[Column]:
    """Earliest month, then the largest card; the line's part and supplier keys finish the order."""
    return [F.col("reportingdate")] + _down(*_CARD)


def _score_order(cfg: StudyConfig, status: bool = True) -> list[Column]:
    """Valid score first, then (optionally) blank status first."""
    return ([F.when(valid_score(cfg), 0).otherwise(1)]
            + ([F.when(blank("esc"), 0).otherwise(1)] if status else []))


def excluded_flag(cfg: StudyConfig, start: dt.date) -> Column:
    """1 if any of an account's rows since ``start`` carries a listed status reason."""
    return F.max(flag((F.col("reportingdate") >= F.lit(start)) & F.col("dimstatusreasonid").isin(list(cfg.exclusion_ids))))


def _read_aggs(cfg: StudyConfig, in_window: Column, at_horizon, cols: tuple[str, ...]):
    """Per-read conditional aggregates over one set of performance rows."""
    aggs = []
    for r in cfg.reads:
        inside = in_window(r)
        aggs += [
            F.max(F.when(inside, F.col("monthsonbooks"))).alias(f"{r.key}__max_mob_observed"),
            F.max(F.when(inside, F.col("dimbucketid"))).alias(f"{r.key}__max_bucket"),
            F.max(F.when(inside, flag(F.col("chargeoffindicator") == 1))).alias(f"{r.key}__chargeoff"),
            F.max(F.when(inside, flag((F.col("chargeoffindicator") == 1) & F.col("_contractual"))))
            .alias(f"{r.key}__contractual_chargeoff"),
            F.max(F.when(inside, flag(at_horizon(r)))).alias(f"{r.key}__has_horizon"),
            F.max(F.when(inside, flag((F.col("dimbucketid") >= r.bucket) | (F.col("chargeoffindicator") == 1))))
            .alias(f"{r.key}__target"),
        ]
    return aggs


PERF_FIELDS = ("max_mob_observed", "max_bucket", "chargeoff", "contractual_chargeoff", "has_horizon", "target")


def _stack_reads(df: DataFrame, cfg: StudyConfig, keep: list[str]) -> DataFrame:
    """Unpivot per-read column groups into one row per (account, read)."""
    structs = [
        F.struct(F.lit(r.key).alias("read_key"), F.lit(r.bucket).alias("target_bucket"),
                 F.lit(r.horizon).alias("horizon"),
                 *[F.col(f"{r.key}__{c}").alias(c) for c in PERF_FIELDS])
        for r in cfg.reads
    ]
    out = df.select(*keep, F.explode(F.array(*structs)).alias("_r"))
    return out.select(*keep, "_r.*")


def _inside(mode: str):
    """Which performance rows count for a read. "ever": up to the horizon; "point_in_time": the
    horizon row, or a charge-off row up to it (the activity condition applies to both branches)."""
    mob = F.col("monthsonbooks")
    if mode == "ever":
        return lambda r: mob <= r.horizon
    if mode == "point_in_time":
        return lambda r: (mob == r.horizon) | ((mob <= r.horizon) & (F.col("chargeoffindicator") == 1))
    raise ValueError("mode must be 'ever' or 'point_in_time'")


def _performing() -> Column:
    return (F.col("activeaccountindicator") == 1) | (F.col("chargeoffindicator") == 1)


def _eligible(has_col: str, co_col: str) -> Column:
    return flag((F.coalesce(F.col(has_col), F.lit(0)) == 1) | (F.coalesce(F.col(co_col), F.lit(0)) == 1))


def _cohort(fact: DataFrame, cfg: StudyConfig, boarded: tuple[dt.date, dt.date], window: tuple[dt.date, dt.date] | None,
            exclude_from: dt.date | None, products: DataFrame | None, mode: str) -> DataFrame:
    """D1 + D2 + P8 + P10 (+ J6): boarding row, best score, performance per read and exclusion of every
    account in one aggregation. ``boarded`` and ``window`` are month-end ranges of the boarding rows and
    of the score and performance rows (None: all)."""
    date, mob = F.col("reportingdate"), F.col("monthsonbooks")
    rows = F.lit(True) if window is None else date.between(F.lit(window[0]), F.lit(window[1]))
    f = fact.filter(F.col("cardid").isNotNull())
    if window is not None and exclude_from is not None:
        f = f.filter(date >= F.lit(min(window[0], exclude_from)))
    board = date.between(*map(F.lit, boarded)) & (F.col("newaccountindicator") == 1) & program_filter(cfg)
    if cfg.creditline_tier is not None:
        board = board & (F.col("creditline") == F.lit(cfg.creditline_tier))
    scored = rows if cfg.score_mob is None else rows & (mob == cfg.score_mob)
    perform = rows & _performing() & (mob >= cfg.perf_start_mob) & (mob <= cfg.max_horizon)
    inside = _inside(mode)
    f = f.withColumn("_contractual", contractual(cfg)).withColumn("_day", F.unix_date("reportingdate"))
    g = f.groupBy(ACCT).agg(
        first_where(board, [date] + _down(*_CARD), [
            date.alias("cohort_reportingdate"), F.col("opendate"), F.col("cardid").alias("board_cardid"),
            F.col("reservationnumber"), F.col("dimproductofferedid"), F.col("creditline")]).alias("b"),
        first_where(scored, _score_order(cfg) + _down("_day", *_CARD), [
            date.alias("score_reportingdate"), mob.alias("score_mob"), F.col("dimbucketid").alias("bucket_at_score"),
            F.col("bhvr_score"), F.col("esc"), F.col("scorecard")]).alias("s"),
        *_read_aggs(cfg, lambda r: perform & inside(r), lambda r: mob == r.horizon, PERF_FIELDS),
        (excluded_flag(cfg, exclude_from) if exclude_from is not None else F.lit(0)).alias("_excluded"))
    g = g.filter(F.col("b").isNotNull() & (F.coalesce("_excluded", F.lit(0)) == 0))
    reads = [f"{r.key}__{c}" for r in cfg.reads for c in PERF_FIELDS]
    wide = _with_channel(g.select(ACCT, *[f"b.{c}" for c in (
        "cohort_reportingdate", "opendate", "board_cardid", "reservationnumber", "dimproductofferedid", "creditline")],
        *[f"s.{c}" for c in SCORE_FIELDS], *reads), products)
    wide = wide.select("*", month_start("cohort_reportingdate").alias("vintage"), program_code().alias("program_code"),
                       campaign_code().alias("campaign_code"))
    keep = ["vintage", "cohort_reportingdate", "opendate", ACCT, "board_cardid", "reservationnumber", "program_code",
            "campaign_code", "channel", "creditline", *SCORE_FIELDS]
    return (_stack_reads(wide, cfg, keep).withColumn("metric_eligible", _eligible("has_horizon", "chargeoff"))
            .withColumnRenamed("has_horizon", "has_horizon_mob"))


SCORE_FIELDS = ("score_reportingdate", "score_mob", "bucket_at_score", "bhvr_score", "esc", "scorecard")


def exclusion_start(cfg: StudyConfig, window_start: dt.date) -> dt.date:
    return add_month_start(window_start, -cfg.exclusion_lookback_months)


def cohort_bulk(fact: DataFrame, cfg: StudyConfig, window_start: dt.date, window_end: dt.date,
                products: DataFrame | None = None, mode: str = "ever",
                include_invalid: bool = False, exclude: bool = True) -> DataFrame:
    """Cohort dataset for every board month and every read in one pass.

    One row per (account, read): board attributes, best score, performance,
    ``metric_eligible`` (horizon observed or charged off) and ``target``.
    """
    window = month_end_of(window_start), month_end_of(window_end)
    out = _cohort(fact, cfg, window, window, exclusion_start(cfg, window_start) if exclude else None, products, mode)
    return valid_score_filter(out, cfg, include_invalid=include_invalid)


def cohort_month(fact: DataFrame, cfg: StudyConfig, cohort: dt.date, products: DataFrame | None = None,
                 mode: str = "ever", include_invalid: bool = False) -> DataFrame:
    """One board month, score rows and performance rows without date bounds."""
    eom = month_end_of(cohort)
    out = (_cohort(fact, cfg, (eom, eom), None, None, products, mode)
           .withColumn("performance_mode", F.lit(mode))
           .withColumn("configured_score_mob", F.lit(cfg.score_mob).cast("int")))
    return valid_score_filter(out, cfg, include_invalid=include_invalid)


# ----------------------------------------------------------------------------
# portfolio snapshots
# ----------------------------------------------------------------------------

def perf_bounds(snapshot: dt.date, horizon: int, m1_inclusive: bool) -> tuple[dt.date, dt.date]:
    start = month_end_of(snapshot, 0 if m1_inclusive else 1)
    end = month_end_of(snapshot, horizon - 1 if m1_inclusive else horizon)
    return start, end


SNAPSHOT_ORDERS = ("score_status_card", "score_card", "card")
_AT_SNAPSHOT = ("snapshot_reportingdate", "opendate", "snapshot_cardid", "activeaccountindicator", "newaccountindicator",
                "reservationnumber", "dimproductofferedid", "creditline", "vantage3", "bucket_at_snapshot", "bhvr_score",
                "esc", "scorecard")
_CLOSEST = ("score_reportingdate", "score_mob", "score_cardid", "days_from_snapshot", "bhvr_score", "esc", "scorecard")


def snapshot_pass(fact: DataFrame, cfg: StudyConfig, products: DataFrame | None = None, subject: str | None = "score_status_card",
                  benchmark: bool = False, exclude_from: dt.date | None = None, closest: bool = False) -> DataFrame:
    """D3 + J4 + P8 (+ J5, J6, J7): the subject and benchmark rows of a snapshot month in one scan and one
    exchange. One row per (population, account) with the row picked at the month end, the forward performance
    of every read as ``<read>__<field>``, and with ``exclude_from`` the flags ``excluded`` and ``at_tier``.

    ``subject``: which of an account's rows stands for it - "score_status_card" (valid, blank status, largest
    card), "score_card" or "card"; None leaves the subject out. ``closest``: per read the nearest valid score
    on or after the snapshot inside the read's window (nearest, earlier, larger card)."""
    if subject is not None and subject not in SNAPSHOT_ORDERS:
        raise ValueError(f"subject must be one of {SNAPSHOT_ORDERS}")
    snapshot = cfg.snapshot_month
    obs, date = month_end_of(snapshot), F.col("reportingdate")
    bounds = {r.key: perf_bounds(snapshot, r.horizon, cfg.m1_inclusive) for r in cfg.reads}
    f = fact.filter(F.col("cardid").isNotNull())
    if exclude_from is None:
        f = f.filter((date >= F.lit(obs)) & (date <= F.lit(max(e for _, e in bounds.values()))))
    at = date == F.lit(obs)
    fields = [date.alias("snapshot_reportingdate"), F.col("opendate"), F.col("cardid").alias("snapshot_cardid"),
              *[F.col(c) for c in ("activeaccountindicator", "newaccountindicator", "reservationnumber", "dimproductofferedid",
                                   "creditline", "vantage3")],
              F.col("dimbucketid").alias("bucket_at_snapshot"), *[F.col(c) for c in ("bhvr_score", "esc", "scorecard")]]
    picks = {}
    if subject is not None:
        order = [] if subject == "card" else _score_order(cfg, status=subject == "score_status_card")
        picks["subject"] = first_where(at & active_or_new() & program_filter(cfg), order + _down(*_CARD), fields)
    if benchmark:
        like = (at & (F.col("activeaccountindicator") == 1) & (F.col("dimbucketid") <= cfg.benchmark_bucket_max)
                & (F.col("vantage3") >= cfg.benchmark_vantage_min) & not_program_filter(cfg))
        if cfg.benchmark_require_blank_status:
            like = like & blank("esc")
        picks["benchmark"] = first_where(like, _score_order(cfg, status=False) + _down(*_CARD), fields)

    def inside(r):
        s, e = bounds[r.key]
        return _performing() & (date >= F.lit(s)) & (date <= F.lit(e))

    aggs = _read_aggs(cfg, inside, lambda r: date == F.lit(bounds[r.key][1]), PERF_FIELDS)
    kept = [f"{r.key}__{c}" for r in cfg.reads for c in PERF_FIELDS]
    if closest:
        days = F.datediff(date, F.lit(obs))
        for r in cfg.reads:
            near = valid_score(cfg) & (date >= F.lit(obs)) & (date <= F.lit(bounds[r.key][1]))
            aggs.append(first_where(near, [F.abs(days), date] + _down(*_CARD), [
                date.alias("score_reportingdate"), F.col("monthsonbooks").alias("score_mob"), F.col("cardid").alias("score_cardid"),
                days.alias("days_from_snapshot"), F.col("bhvr_score"), F.col("esc"), F.col("scorecard")]).alias(f"{r.key}__pick"))
            kept.append(f"{r.key}__pick")
    if exclude_from is not None:
        tier = (F.col("newaccountindicator") == 1) & program_filter(cfg)
        if cfg.creditline_tier is not None:
            tier = tier & (F.col("creditline") == F.lit(cfg.creditline_tier))
        aggs += [excluded_flag(cfg, exclude_from).alias("excluded"), F.max(flag(tier)).alias("at_tier")]
        kept += ["excluded", "at_tier"]
    g = f.withColumn("_contractual", contractual(cfg)).groupBy(ACCT).agg(*[v.alias(k) for k, v in picks.items()], *aggs)
    each = F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("population"), *[F.col(f"{k}.{c}").alias(c) for c in _AT_SNAPSHOT]))
        for k in picks]))
    g = g.select(ACCT, F.explode(each).alias("x"), *kept).select(ACCT, "x.*", *kept)
    return _with_channel(g, products).select(
        "*", month_start("snapshot_reportingdate").alias("vintage"), month_start("opendate").alias("board_month"),
        population_source().alias("snapshot_population_source"), program_code().alias("program_code"),
        campaign_code().alias("campaign_code"))


_SUBJECT = ("vintage", "snapshot_reportingdate", "opendate", "board_month", ACCT, "snapshot_cardid", "activeaccountindicator",
            "newaccountindicator", "snapshot_population_source", "reservationnumber", "program_code", "campaign_code",
            "channel", "creditline", "bucket_at_snapshot", "bhvr_score", "esc", "scorecard")
_BENCHMARK = ("vintage", "snapshot_reportingdate", "opendate", "board_month", ACCT, "snapshot_cardid", "reservationnumber",
              "program_code", "channel", "creditline", "vantage3", "bucket_at_snapshot", "bhvr_score", "esc", "scorecard")


def subject_rows(rows: DataFrame, cfg: StudyConfig, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per (account, read) of the subject rows of a pass, before any score or eligibility filter."""
    return _stack_reads(rows.filter(F.col("population") == "subject"), cfg, [*_SUBJECT, *more])


def portfolio_rows(rows: DataFrame, cfg: StudyConfig, include_invalid: bool = False, eligible_only: bool = True,
                   more: tuple[str, ...] = ()) -> DataFrame:
    """P11 on the rows of a pass."""
    out = (subject_rows(rows, cfg, more).withColumn("metric_eligible", _eligible("has_horizon", "chargeoff"))
           .withColumnRenamed("has_horizon", "has_horizon_snapshot"))
    out = valid_score_filter(out, cfg, include_invalid=include_invalid)
    return out.filter(F.col("metric_eligible") == 1) if eligible_only else out


def benchmark_rows(rows: DataFrame, cfg: StudyConfig, with_groups: bool = True) -> DataFrame:
    """P13 on the rows of a pass: null target counts as good and every account is eligible."""
    long = _stack_reads(rows.filter(F.col("population") == "benchmark"), cfg, list(_BENCHMARK))
    group = creditline_group() if with_groups else F.lit("Benchmark")
    return (long.withColumn("target", F.coalesce(F.col("target"), F.lit(0))).withColumn("metric_eligible", F.lit(1))
            .withColumn("benchmark_group", group).drop("has_horizon"))


def not_excluded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("excluded", F.lit(0)) == 0)


def portfolio_snapshot(fact: DataFrame, cfg: StudyConfig, products: DataFrame | None, exclude_from: dt.date, **kw) -> DataFrame:
    """Active-or-new subject accounts at the snapshot, boarded at the tier and not excluded, with forward
    performance per read."""
    rows = not_excluded(snapshot_pass(fact, cfg, products, exclude_from=exclude_from)).filter(F.col("at_tier") == 1)
    return portfolio_rows(rows, cfg, **kw)


def benchmark_snapshot(fact: DataFrame, cfg: StudyConfig, products: DataFrame | None, exclude_from: dt.date,
                       with_groups: bool = True) -> DataFrame:
    """Non-subject active accounts of comparable quality at the snapshot, not excluded, forward performance."""
    rows = snapshot_pass(fact, cfg, products, subject=None, benchmark=True, exclude_from=exclude_from)
    return benchmark_rows(not_excluded(rows), cfg, with_groups)


def portfolio_closest_score(fact: DataFrame, cfg: StudyConfig, products: DataFrame | None = None) -> DataFrame:
    """P12 + J5: snapshot (largest card) with, per read, the closest valid score inside that read's window;
    rows without a valid score or not eligible go."""
    rows = snapshot_pass(fact, cfg, products, subject="card", closest=True)
    structs = [
        F.struct(F.lit(r.key).alias("read_key"), F.lit(r.bucket).alias("target_bucket"), F.lit(r.horizon).alias("horizon"),
                 *[F.col(f"{r.key}__{c}").alias(c) for c in PERF_FIELDS],
                 *[F.col(f"{r.key}__pick.{c}").alias(c) for c in _CLOSEST])
        for r in cfg.reads
    ]
    keep = [c for c in _SUBJECT if c not in _CLOSEST]
    long = rows.select(*keep, F.explode(F.array(*structs)).alias("_r")).select(*keep, "_r.*")
    return (long.withColumn("metric_eligible", _eligible("has_horizon", "chargeoff"))
            .withColumnRenamed("has_horizon", "has_horizon_snapshot")
            .filter(valid_score(cfg) & (F.col("metric_eligible") == 1)))


def creditline_group(col: str = "creditline") -> Column:
    """benchmark credit-line groups and short labels."""
    c = F.col(col)
    high, mid, low, unknown = CREDITLINE_GROUPS
    return (F.when(c >= CREDITLINE_HIGH, high).when((c < CREDITLINE_HIGH) & (c >= CREDITLINE_MID), mid)
            .when(c < CREDITLINE_MID, low).otherwise(unknown))
