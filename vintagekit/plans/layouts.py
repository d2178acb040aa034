"""Joins over layouts made once by join key (J1-J4, J6, J7): no exchange of the fact, nor of the other side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagekit.config import SCORE_AVAILABILITY_MAX_MOB
from vintagekit.operators import population as P
from vintagekit.plans import studio
from vintagekit.sources import buckets as B
from vintagekit.sources import testdata as TD
from vintagekit.sources.cache import source_path

CARD_MONTH = ["cardid", "reportingdate"]
ACCOUNT_SLICE = [P.ACCT, B.SLICE]


@dataclass
class Layouts:
    """Layouts of one source folder, each built at its first use and found again by later sessions."""
    s: studio.StudyInputs
    buckets: int

    def _table(self, name: str, build, keys: list[str], *params: str) -> DataFrame:
        path = source_path(self.s.spark, name, TD.source_files(self.s.sf_dir), *params)
        return B.bucketed(self.s.spark, path, build, keys, self.buckets)

    def fact_by_card(self) -> DataFrame:
        return self._table("fact_by_card", lambda: self.s.fact, CARD_MONTH)

    def month_end(self) -> DataFrame:
        return self._table("month_end_by_card", lambda: TD.month_end_info(self.s.spark, self.s.sf_dir), CARD_MONTH)

    def fact_by_account(self) -> DataFrame:
        return self._table("fact_by_account", lambda: B.by_account_slice(self.s.fact), ACCOUNT_SLICE, str(B.SLICES))

    def excluded(self) -> DataFrame:
        return self._accounts("excluded", lambda: self.s.excluded)

    def tier(self) -> DataFrame:
        return self._accounts("tier", lambda: P.tier_accounts(self.s.fact, self.s.cfg))

    def boards(self) -> DataFrame:
        lo, hi = studio._bounds(self.s)
        return self._accounts("boards", lambda: P.boards(self.s.fact, self.s.cfg, lo, hi, None).select("vintage", P.ACCT))

    def _accounts(self, name: str, build) -> DataFrame:
        return self._table(f"{name}_accounts", lambda: B.in_every_slice(build()), ACCOUNT_SLICE, str(B.SLICES), repr(self.s.cfg))


def layouts(spark, sf_dir) -> Layouts:
    s = studio.inputs(spark, sf_dir)
    path = source_path(spark, "account_month", TD.source_files(sf_dir))
    return Layouts(s, B.bucket_count(spark, path))


def enrich_in_place(spark, sf_dir):
    """J1 + J2: channel and month-end scorecard of every fact row, joined bucket by bucket on (card, month)."""
    l = layouts(spark, sf_dir)
    return P.dim_enrich(l.fact_by_card(), l.s.products, l.month_end())


def exclude_accounts(spark, sf_dir):
    """The fact without the rows of excluded accounts."""
    l = layouts(spark, sf_dir)
    return P.exclude_accounts(l.fact_by_account(), l.excluded(), ACCOUNT_SLICE).drop(B.SLICE)


def restrict_fact(spark, sf_dir):
    """The fact rows of the accounts boarded at the tier."""
    l = layouts(spark, sf_dir)
    return P.restrict_accounts(l.fact_by_account(), l.tier(), ACCOUNT_SLICE).drop(B.SLICE)


def board_rows(spark, sf_dir):
    """Boards joined to their performing rows in a range of months on books; counts by cohort and month on books.
    Partial counts are taken where the rows lie, so only they are exchanged."""
    l = layouts(spark, sf_dir)
    rows = l.fact_by_account().filter(F.col("cardid").isNotNull() & F.col("monthsonbooks").between(1, SCORE_AVAILABILITY_MAX_MOB)
                                      & P._performing())
    return (l.boards().join(rows, ACCOUNT_SLICE).groupBy("vintage", "monthsonbooks")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(P.valid_score(l.s.cfg), 1).otherwise(0)).alias("valid_scores"),
                 F.max("dimbucketid").alias("max_bucket"), F.sum(F.when(F.col("chargeoffindicator") == 1, 1).otherwise(0)).alias("chargeoffs")))
