"""Campaign response pipeline: mail file -> applications -> response attribution ->
bands, tiers and flags -> 11-dimension rollup. Every campaign month is processed
in the same job: the month is a column, not a loop.

Null rules follow the SAS data step: a missing number is below every number
(scorecard, bands), ``^=`` is true for a missing value, a missing board date is
not "after" the campaign start, and sums over only-missing values stay missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.functions.rows import first_row
from vintagekit.functions.nulls import flag, null_safe_ne, sas_ge, sas_lt

# ----------------------------------------------------------------------------
# C1 windows, SRC2 mail file
# ----------------------------------------------------------------------------


def campaign_windows(months: DataFrame, col: str = "campaign_month") -> DataFrame:
    """Month end; applications from the first day of the previous month to the
    end of month + 3; pre-qualification start two months back."""
    m = F.col(col)
    return months.select(
        m, F.last_day(m).alias("month_end"), F.add_months(m, -1).alias("min_app_date"),
        F.last_day(F.add_months(m, 3)).alias("max_app_date"), F.add_months(m, -2).alias("pq_app_date"),
        F.upper(F.date_format(m, "MMMyy")).alias("month_label"))


def mailfile(raw: DataFrame, start=None, end=None) -> DataFrame:
    """SRC2: keep-list projection, month range, campaign-flag list, end-mark exclusion,
    char-to-number casts and derived columns, for every campaign month at once."""
    df = raw.withColumn("campaign_month", F.trunc("CAMPAIGN_DATE", "month"))
    if start is not None:
        df = df.filter(F.col("CAMPAIGN_DATE") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("CAMPAIGN_DATE") <= F.last_day(F.lit(end)))
    df = df.filter(F.col("CAMPFLAG1").isin(list(C.MAIL_CAMPFLAGS))
                   & ~F.coalesce(F.col("endmark"), F.lit("")).contains("S"))
    rm = (F.when(F.col("CAMPFLAG1").isin(list(C.NEW_MAIL_FLAGS)), 0)
          .when(F.col("CAMPFLAG1").isin(list(C.REMAIL_FLAGS)), 1))
    return df.select(
        "*",
        F.expr("try_cast(SCORE_VANTAGE_VALUE_V3 AS double)").alias("vantage3"),
        F.expr("try_cast(TRM10_Score AS double)").alias("TRM_Score"),
        F.expr("try_cast(EXP_RESPONSE_SCORE AS double)").alias("EXP_RESPONSE_SCORE_num"),
        F.concat(F.coalesce("OFFER_CODE_FIRST_7", F.lit("")), F.coalesce("RESERVATION_SEQUENCE", F.lit("")))
        .alias("ReservationNumber"),  # a missing part is blank
        F.expr("try_cast(TM12_3BR AS double)").alias("TM12_3RR"),
        rm.cast("int").alias("rm_flag"))


def first_mail_row(mail: DataFrame) -> DataFrame:
    """D4 on the mail file: one row per (month, reservation number), deterministic."""
    return first_row(mail, ["campaign_month", "ReservationNumber"],
                     [F.col(c) for c in ("CAMPAIGN_DATE", "ENCRYPTED_PIN", "RESERVATION_SEQUENCE")])


# ----------------------------------------------------------------------------
# J8/J9/C2 applications
# ----------------------------------------------------------------------------


def application_flags() -> list[Column]:
    """Fraud decline, gross response (status not the expired offer, true when
    missing), net response (boarded after the campaign start; missing -> 0)."""
    return [
        flag(F.col("STATUS_DESC").isin(list(C.FRAUD_DECLINE_STATUSES))).alias("FraudDecline_dm"),
        flag(null_safe_ne("STATUS_DESC", C.EXPIRED_OFFER_STATUS)).alias("GrossResponse_dm"),
        flag(F.col("BoardDate") > F.col("campaign_month")).alias("NetResponse_dm"),
    ]


def applications(apps: DataFrame, applicants: DataFrame, status: DataFrame, mail: DataFrame,
                 on: Sequence[str] = ("APPLICATION_ID",)) -> DataFrame:
    """J8 + J9 + C2: application chain restricted, per campaign month, to the
    application window and to campaign codes mailed that month.

    The window is the whole months from one before to three after the campaign, so every (month, code) is
    listed once for each of these application months and both code and month are join keys: no range
    condition, and a code with very many applications is spread over its months. ``on``: the application id, and
    what else of it the three tables lie by.
    """
    on = list(on)
    codes = (mail.select("campaign_month", F.substring("OFFER_CODE_FIRST_7", 1, 7).alias("CampaignCode")).distinct()
             .withColumn("app_month", F.explode(F.array(*[F.add_months("campaign_month", k).cast("date") for k in range(-1, 4)]))))
    chain = (apps.join(applicants, on, "left").join(status, on, "left")
             .withColumn("CampaignCode", F.substring("RESERVATION_NUMBER", 1, 7))
             .withColumn("AppRcvDate", F.to_date("APPLICATION_RECEIVE_DATE"))
             .withColumn("RTBDate", F.to_date("READY_TO_BOARD_DATE"))
             .withColumn("BoardDate", F.to_date("BOARDDATE"))
             .withColumn("app_month", F.trunc("AppRcvDate", "month")))
    j = chain.join(codes, ["CampaignCode", "app_month"])
    return j.select("campaign_month", "APPLICATION_ID", "DOB", "RESERVATION_NUMBER", "CampaignCode",
                    "AppRcvDate", "RTBDate", "BoardDate", "STATUS_DESC", "STATUS_NAME", *application_flags())


def first_application(apps: DataFrame) -> DataFrame:
    """The first application per (month, reservation number) by receive date;
    ties broken by application id (the source order is unspecified there)."""
    return first_row(apps, ["campaign_month", "RESERVATION_NUMBER"], [F.col("AppRcvDate"), F.col("APPLICATION_ID")])


# ----------------------------------------------------------------------------
# J10/J11 response join, C3 final response
# ----------------------------------------------------------------------------


def response_join(mail: DataFrame, first_apps: DataFrame, fees: DataFrame) -> DataFrame:
    """J10 + J11: every mail row with its first application and the annual fee of
    its 4-character program code. A program code with two fees raises: it would multiply mail rows."""
    a = first_apps.select("campaign_month", F.col("RESERVATION_NUMBER").alias("ReservationNumber"),
                          "AppRcvDate", "BoardDate", F.col("FraudDecline_dm").alias("FraudDecline"),
                          F.col("GrossResponse_dm").alias("GrossResponse"),
                          F.col("NetResponse_dm").alias("NetResponse"))
    j = mail.join(a, ["campaign_month", "ReservationNumber"], "left")
    fee = fees.groupBy(F.col("ProgramCode").alias("_pc")).agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two fees for one program code")))
        .otherwise(F.max("finalcombinedaf")).alias("annual_fee"))
    return j.join(fee, F.substring("OFFER_CODE_FIRST_7", 1, 4) == F.col("_pc"), "left").drop("_pc")


def scorecard(vantage: str = "vantage3", prospect: str = "prospect_type") -> Column:
    """F16: scorecard 1-4 from vantage x prospect type; a missing vantage is low."""
    low = sas_lt(vantage, C.SCORECARD_VANTAGE_CUT)
    high = sas_ge(vantage, C.SCORECARD_VANTAGE_CUT)
    p = F.col(prospect)
    return (F.when(low & (p == "Prospecting"), 1).when(high & (p == "Prospecting"), 2)
            .when(low & (p == "Retargeting"), 3).when(high & (p == "Retargeting"), 4)).cast("int")


def vs_band(vantage: str = "vantage3") -> Column:
    """vantage bands; below the lowest band or missing -> null."""
    v = F.col(vantage)
    expr = None
    for label, lo, hi in C.VS_BANDS:
        cond = (v >= lo) if hi is None else ((v >= lo) & (v <= hi))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def campaign_flags(col: str = "CAMPFLAG1") -> list[Column]:
    """0/1 flags from campaign-flag groups (missing -> 0)."""
    c = F.col(col)
    return [flag(c.isin(list(C.PROSPECTING_FLAGS))).alias("prospectingflag"),
            flag(c.isin(list(C.PQ_ABANDON_FLAGS))).alias("pqabandon_flag"),
            flag(c.isin(list(C.CHARGEOFF_FLAGS))).alias("prchargeoff_flag"),
            flag(c.isin(list(C.CLOSURE_FLAGS))).alias("prclosure_flag"),
            flag(c.isin(list(C.DECLINE_FLAGS))).alias("prdecline_flag")]


def fixed_cut_decile(score: str, cuts) -> Column:
    """first closed interval containing the score; gaps and out-of-range -> null."""
    s = F.col(score)
    expr = None
    for i, (lo, hi) in enumerate(cuts, start=1):
        cond = (s >= F.lit(float(lo))) & (s <= F.lit(float(hi)))
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.cast("int")


def fixed_cut_deciles(score: str = "TRM_Score") -> list[Column]:
    names = {"total": "total_decile", "sc1": "sc1_decile", "sc2": "sc2_decile", "sc3": "sc3_decile",
             "sc4": "sc4_decile"}
    return [fixed_cut_decile(score, C.FIXED_CUTS[k]).alias(v) for k, v in names.items()]


def final_response(joined: DataFrame) -> DataFrame:
    """Scorecard, band, campaign flags and the fixed-cut deciles."""
    return joined.select("*", scorecard().alias("scorecard"), vs_band().alias("vs_band"),
                         *campaign_flags(), *fixed_cut_deciles())


# ----------------------------------------------------------------------------
# C4/C5 rollup
# ----------------------------------------------------------------------------


def exact_sum(col: str) -> Column:
    """Sum of a double accumulated in decimal: exact, hence independent of how the
    rows are partitioned and ordered across executors."""
    return F.sum(F.col(col).cast("decimal(38,18)")).cast("double")


def campaign_rollup(final: DataFrame, by_month: bool = True) -> DataFrame:
    """C4 + C5: volume, responders, expected responses (TRM, XPM), boards and the
    source's precomputed rates, by campaign month and the 11 dimensions.
    Null dimension values form their own groups."""
    keys = (["campaign_month"] if by_month else []) + list(C.ROLLUP_DIMENSIONS)
    g = final.groupBy(*[F.col(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("volume"),
        F.sum("GrossResponse").cast("long").alias("responders"),
        exact_sum("TRM_Score").alias("expected_responses"),
        exact_sum("EXP_RESPONSE_SCORE_num").alias("expected_responses_xpm"),
        F.sum("NetResponse").cast("long").alias("Boards"))
    return (g.withColumn("GRR", F.col("responders") / F.col("volume"))
            .withColumn("NRR", F.col("Boards") / F.col("volume")))


def combined_rollup(rollup: DataFrame) -> DataFrame:
    """The combined table with the month indicator as text (yyyy-MM) and the
    SAS-style label (MONyy)."""
    return rollup.select(F.date_format("campaign_month", "yyyy-MM").alias("campaign_month"),
                         F.upper(F.date_format("campaign_month", "MMMyy")).alias("month_label"),
                         *[c for c in rollup.columns if c != "campaign_month"])
