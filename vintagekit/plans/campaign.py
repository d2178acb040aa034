"""End-to-end plans of the campaign response pipeline over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.operators import campaign as CP
from vintagekit.operators import features as FE
from vintagekit.session import join_on_part_of_the_key, prepare
from vintagekit.sources import buckets as B
from vintagekit.sources import testdata as TD
from vintagekit.sources.cache import cache_or_compute, source_path

BUREAU_FILE_PATTERN = "TRM_BUREAU_A%"


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, TD.source_files(sf_dir))
    return CP.mailfile(TD.mail_file_raw(spark, sf_dir))


#: Source bytes for each bucket of the application tables, which are joined where they lie.
APPLICATION_BUCKET_BYTES = 8 << 20


def _apps(spark, sf_dir, mail):
    files = TD.source_files(sf_dir)
    join_on_part_of_the_key(spark, True)  # an order's few applications lie together
    buckets = B.bucket_count(spark, files, APPLICATION_BUCKET_BYTES)
    rows = B.bucketed(spark, source_path(spark, "applications_by_order", files), lambda: TD.application_rows(spark, sf_dir, buckets),
                      ["l_orderkey"], buckets, placed=True)
    codes = cache_or_compute(spark, source_path(spark, "mailed_codes", TD.source_files(sf_dir)),
                             lambda: mail.select("campaign_month", "OFFER_CODE_FIRST_7").distinct())  # staged: Spark knows how few there are
    tables = [t(rows, TD.APPLICATION_KEY) for t in (TD.applications, TD.applicants, TD.application_status)]
    return CP.applications(*tables, codes, TD.APPLICATION_KEY)


#: What the response join takes of an application: only these travel when the first one is picked.
APPLICATION_COLUMNS = ["campaign_month", "RESERVATION_NUMBER", "APPLICATION_ID", "AppRcvDate", "BoardDate", "FraudDecline_dm", "GrossResponse_dm",
                       "NetResponse_dm"]


def response(spark, sf_dir) -> DataFrame:
    mail = _mail(spark, sf_dir)
    first = CP.first_application(_apps(spark, sf_dir, mail).select(*APPLICATION_COLUMNS))
    joined = CP.response_join(CP.first_mail_row(mail), first, TD.program_code_lookup(spark, sf_dir))
    return CP.final_response(joined)


def staged_response(spark, sf_dir) -> DataFrame:
    """C3 as a table of the session: the chain is joined once and everything after it reads it."""
    prepare(spark, TD.source_files(sf_dir))
    staged = cache_or_compute(spark, source_path(spark, "response", TD.source_files(sf_dir)), lambda: response(spark, sf_dir),
                              required=["campaign_month", "ReservationNumber", "scorecard"], sort_within=["campaign_month"])
    join_on_part_of_the_key(spark, False)
    return staged


def campaign_windows(spark, sf_dir):
    return CP.campaign_windows(_mail(spark, sf_dir).select("campaign_month").distinct())


def mailfile_month(spark, sf_dir):
    return _mail(spark, sf_dir)


def applications(spark, sf_dir):
    return _apps(spark, sf_dir, _mail(spark, sf_dir))


def first_application(spark, sf_dir):
    return CP.first_application(applications(spark, sf_dir))


def response_join(spark, sf_dir):
    mail = _mail(spark, sf_dir)
    first = CP.first_application(_apps(spark, sf_dir, mail))
    return CP.response_join(CP.first_mail_row(mail), first, TD.program_code_lookup(spark, sf_dir))


def final_response(spark, sf_dir):
    return staged_response(spark, sf_dir)


def campaign_flags(spark, sf_dir):
    """flag values per campaign flag, with mail counts."""
    m = _mail(spark, sf_dir).select("CAMPFLAG1", "rm_flag", *CP.campaign_flags())
    keys = [c for c in m.columns]
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("mail_rows"))


def vs_band(spark, sf_dir):
    """F11 + F16: band x scorecard distribution of the mail file."""
    m = _mail(spark, sf_dir).select(CP.vs_band().alias("vs_band"), CP.scorecard().alias("scorecard"))
    return m.groupBy("vs_band", "scorecard").agg(F.count(F.lit(1)).alias("mail_rows"))


def fixed_cut_deciles(spark, sf_dir):
    """response-score deciles from fixed cut points for every mail row."""
    m = _mail(spark, sf_dir)
    return m.select("campaign_month", "ReservationNumber", "TRM_Score", *CP.fixed_cut_deciles())


def campaign_rollup(spark, sf_dir):
    return CP.campaign_rollup(staged_response(spark, sf_dir))


def combined_rollup(spark, sf_dir):
    return CP.combined_rollup(CP.campaign_rollup(staged_response(spark, sf_dir)))


def _with_attrs(spark, sf_dir):
    f = staged_response(spark, sf_dir).select("campaign_month", "ReservationNumber", "ENCRYPTED_PIN", "vantage3",
                                     "TM12_3RR", "scorecard", "pqabandon_flag", "prchargeoff_flag",
                                     "prclosure_flag", "prdecline_flag", "TRM_Score", "OFFER_CODE_FIRST_7",
                                                   "CAMPFLAG1")
    return FE.append_attributes(f, TD.bureau_attributes(spark, sf_dir), BUREAU_FILE_PATTERN)


def append_attributes(spark, sf_dir):
    return _with_attrs(spark, sf_dir)


def engineered_features(spark, sf_dir):
    return FE.engineered_features(_with_attrs(spark, sf_dir))


def woe_transforms(spark, sf_dir):
    return FE.woe_transforms(_with_attrs(spark, sf_dir))


IDS = ["campaign_month", "ReservationNumber", "scorecard"]


def _modelled(spark, sf_dir):
    return FE.woe_transforms(FE.engineered_features(_with_attrs(spark, sf_dir)))


def feature_select(spark, sf_dir):
    """The union of the four scorecards' variables over the engineered frame."""
    keep = [c for k in sorted(FE.KEEP_LISTS) for c in FE.KEEP_LISTS[k]]
    return FE.feature_select(_modelled(spark, sf_dir), keep, ids=IDS)


def feature_select_sc4(spark, sf_dir):
    """Scorecard 4's rows with its own variables."""
    return FE.feature_select(_modelled(spark, sf_dir).filter(F.col("scorecard") == 4), FE.KEEP_LISTS[4], ids=IDS)
