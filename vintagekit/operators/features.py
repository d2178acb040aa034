"""Bureau-attribute append and feature engineering (capped, exception-coded,
rounded buckets, ratios with -1 on a zero denominator, gradients, WOE map).

``roundz(x, u)`` is the nearest multiple of ``u`` with halves away from zero
(``round``, not ``bround``). Comparisons follow SAS: a missing attribute is
below every number, and ``min``/``max`` skip missing values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.functions.nulls import sas_lt

# FIXED VALUES - weight of evidence for the capped credit amount of the most recent card
BCC5421_WOE = ((-1, -0.221847752), (1, -0.615782366), (2, 0.049639017), (3, 0.0846879412), (4, 0.408789384))
BCC5421_WOE_ELSE = 0.5849793963

# FIXED VALUES - bureau attributes appended to the mail file
ATTRIBUTES = (
    "ALL7516", "ALL7120", "ALL6980", "ALL1361", "IQT9416", "IQT9413", "IQT9415", "IQT9410", "BCC5030", "BCC5830",
    "ALL7110", "BCC5020", "ALL0300", "ALL0336", "ALL0400", "ALL0416", "ALL1380", "ALL2002", "ALL2005", "ALL2350",
    "ALL2390", "ALL2488", "ALL2717D", "ALL5012", "ALL5070", "ALL5320", "ALL5361", "ALL6200", "ALL6220", "ALL6230",
    "ALL6250", "ALL6400", "ALL6900", "ALL7371D", "ALL7460", "ALL8020", "ALL8110", "ALL8120", "ALL8121", "ALL8221",
    "ALL8320", "ALL8321", "ALL8370", "ALL8552", "ALL8560", "ALL9110", "ALL9210", "AUA2320", "AUA8220", "AUA8320",
    "AUT5620", "BCA6210", "BCA8151", "BCC2328", "BCC2388", "BCC2800", "BCC3456", "BCC3512", "BCC5120", "BCC5320",
    "BCC5400", "BCC5421", "BCC5422", "BCC7117", "BCC7147", "BCC7516", "BCC7800", "BCX0438", "BRC5620", "BRC6280",
    "COL3203", "COL3211", "COL3237", "COL5060", "COL8192", "ILN0438", "ILN1380", "ILN2380", "ILN5020", "ILN6160",
    "IQB9416", "IQB9510", "IQF9510", "IQT9417", "IQT9510", "MTA2320", "MTA2388", "MTA6230", "PIL0438", "PIL6200",
    "REH5020", "REH5320", "REV0300", "REV2388", "REV3421", "REV3424", "REV3511", "REV5036", "REV5742", "REV6220",
    "REV7470", "REV7801", "REV8220", "RTA8151", "RTR1380", "RTR3422", "RTR3511", "RTR6200", "RTR8320", "STU2558",
    "STU8320", "UTI4180")

# FIXED VALUES - variables kept for each scorecard's model
KEEP_LISTS = {
    1: ("vantage3", "TM12_3RR", "ALL8120", "ALL1380", "ALL6250", "ALL8020", "ALL8110", "ALL5070", "BCC5400", "AUA2320",
        "AUT5620", "BCC7147", "IQB9510", "COL5060", "REV7801", "REV8220", "REV5036", "RTR1380", "ALL5012", "BCA8151",
        "BCC3512", "IQB9416", "MTA6230", "ALL7460", "BCC5421", "ILN5020", "IQT9417", "REV0300", "RTR6200", "ALL7371D",
        "REV5742", "iqt_1317ratio", "iqbt_16ratio", "Full_delinq", "ALL8370tr", "Totbal_mon_pymt_rate", "ALL7516tr",
        "Util_NewCards_rate"),
    2: ("vantage3", "TM12_3RR", "ALL5320", "ALL8320", "ALL6250", "ALL0400", "ALL8121", "BCC5400", "BCX0438", "AUA8220",
        "ALL9210", "ALL2005", "ILN0438", "ALL2002", "IQB9510", "ILN1380", "RTR8320", "REV5036", "RTA8151", "MTA2320",
        "STU8320", "REV7470", "BCA6210", "REV6220", "BCC5422", "BRC5620", "BCC7800", "BRC6280", "ALL2488", "IQB9416",
        "ALL6400", "ALL5361", "ALL7460", "ALL8560", "ALL2350", "ALL8321", "iqt9510_impcaplog", "bcc5421_woe",
        "rev3511_cap", "Effetive_max_util", "Maxbal_mon_pymt_rate"),
    3: ("BCC7516", "MTA2388", "ALL2350tr", "Full_delinq", "REV3511", "ALL5320", "REV3421", "ALL0336",
        "Util_NewCards_rate", "ALL9110", "STU2558", "BCC2800", "ALL7460", "COL3203", "REH5320", "iqt_1510grad",
        "IQT9510", "ALL8370tr", "ALL8560", "AUA2320", "BCA8151", "ALL6200", "COL8192", "ALL2717D", "iqt_1317grad",
        "ALL6230", "ALL0300", "ALL2488", "ALL8221", "IQF9510", "ALL1361", "BCC7117", "BCC2388", "REV2388",
        "iqt_1315ratio", "PIL6200", "RTR3422", "iqbt_16ratio", "ALL0400", "BCC3456", "ILN2380", "TM12_3RR",
        "prdecline_flag", "prclosure_flag", "pqabandon_flag", "prchargeoff_flag", "scorecard", "TRM_Score",
        "OFFER_CODE_FIRST_7", "CAMPFLAG1"),
    4: ("Effetive_max_util", "Full_delinq", "iqt_1510grad", "iqbt_16ratio", "vantage3", "prclosure_flag",
        "prdecline_flag", "prchargeoff_flag", "ALL0300", "ALL0336", "ALL0416", "ALL2390", "ALL2488", "ALL5320",
        "ALL6220", "ALL7460", "ALL8221", "ALL8370", "ALL8552", "ALL8560", "ALL9110", "AUA8320", "BCC2328", "BCC5120",
        "BCC5320", "BCC5400", "BCC7117", "COL3211", "IQT9510", "PIL0438", "REH5020", "REV2388", "REV3424", "STU2558",
        "TM12_3RR"),
}


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def roundz(x, unit: float) -> Column:
    return F.round(_c(x) / F.lit(float(unit)), 0) * F.lit(float(unit))


def append_attributes(df: DataFrame, attrs: DataFrame, file_pattern: str, pin: str = "ENCRYPTED_PIN",
                      columns: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Left join to the file-filtered, column-pruned attribute table."""
    sub = attrs.filter(F.col("FileName").like(file_pattern)).select("EPIN", *columns)
    return df.join(sub, _c(pin) == F.col("EPIN"), "left")


def _payment(x: str) -> Column:
    v = F.col(x)
    return (F.when(v > 999999990, F.lit(2500.0)).when(v.isNull() | (v <= 10), F.lit(9.0))
            .when(v <= 100, roundz(v, 10)).otherwise(roundz(F.least(v, F.lit(2000.0)), 100)))


def _ratio(a: str, b: str) -> Column:
    den = F.col(b)
    return F.when(den == 0, F.lit(-1.0)).otherwise(F.col(a) / den)


def engineered_features(df: DataFrame) -> DataFrame:
    """Derived bureau features."""
    a = F.col
    all7120 = F.when(a("ALL7120") > 990, 230.0).otherwise(F.least(a("ALL7120"), F.lit(200.0)))
    all8370 = F.when(a("ALL8370") > 9990, 230.0).otherwise(F.least(a("ALL8370"), F.lit(200.0)))
    all2350 = F.least(a("ALL2350") + 10, F.lit(28.0))
    all6980 = F.when(a("ALL6980") > 990, 15.0).otherwise(F.least(a("ALL6980") + 10, F.lit(1000.0)))
    fd_min = F.least(all2350 * all6980, F.lit(10000.0))
    full_delinq = (F.when(fd_min <= 500, roundz(fd_min, 50)).when(fd_min <= 1000, roundz(fd_min, 100))
                   .otherwise(roundz(fd_min, 750)))
    bcc5120 = F.when(a("BCC5120") > 999999990, 25000.0).when(a("BCC5120").isNull() | (a("BCC5120") <= 10), 9.0) \
        .when(a("BCC5120") <= 100, roundz("BCC5120", 10)).when(a("BCC5120") <= 1000, roundz("BCC5120", 100)) \
        .when(a("BCC5120") <= 10000, roundz("BCC5120", 500)).otherwise(roundz(F.least(a("BCC5120"), F.lit(20000.0)), 1000))
    bcc5020 = F.when(a("BCC5020") > 999999990, 25000.0).when(a("BCC5020").isNull() | (a("BCC5020") <= 10), 9.0) \
        .when(a("BCC5020") <= 100, roundz("BCC5020", 10)).when(a("BCC5020") <= 1000, roundz("BCC5020", 100)) \
        .when(a("BCC5020") <= 10000, roundz("BCC5020", 500)).otherwise(roundz(F.least(a("BCC5020"), F.lit(20000.0)), 1000))
    bcc5830 = _payment("BCC5830")
    all7110 = F.when(a("ALL7110") > 990, 240.0).otherwise(F.least(a("ALL7110") + 10, F.lit(210.0)))
    all7516 = F.when(a("ALL7516") > 990, 140.0).otherwise(F.least(a("ALL7516") + 10, F.lit(130.0)))
    return df.select(
        "*",
        all7120.alias("ALL7120tr"), all8370.alias("ALL8370tr"),
        (all7120 * all8370 / 100).alias("Effetive_max_util"),
        all2350.alias("ALL2350tr"), all6980.alias("ALL6980tr"), fd_min.alias("Full_delinq_min"),
        full_delinq.alias("Full_delinq"),
        bcc5120.alias("BCC5120tr"), bcc5830.alias("BCC5830tr"), bcc5020.alias("BCC5020tr"),
        F.least(bcc5830 / bcc5120 * 100, F.lit(60.0)).alias("Maxbal_mon_pymt_rate"),
        F.least(bcc5830 / bcc5020 * 100, F.lit(60.0)).alias("Totbal_mon_pymt_rate"),
        all7110.alias("ALL7110tr"), all7516.alias("ALL7516tr"),
        (all7516 / all7110 * 10).alias("Util_NewCards_rate"),
        _ratio("IQB9416", "IQT9416").alias("iqbt_16ratio"),
        _ratio("IQT9413", "IQT9415").alias("iqt_1315ratio"),
        _ratio("IQT9413", "IQT9417").alias("iqt_1317ratio"),
        (2 * a("IQT9413") - a("IQT9417")).alias("iqt_1317grad"),
        _ratio("IQT9415", "IQT9410").alias("iqt_1510ratio"),
        (2 * a("IQT9415") - a("IQT9410")).alias("iqt_1510grad"))


def woe_transforms(df: DataFrame) -> DataFrame:
    """capped/rounded credit amount with its WOE, log(1 + capped months since
    inquiry), capped count of recent revolving trades."""
    a = F.col
    cap = (F.when(a("BCC5421") > 999999990, -1.0).when(a("BCC5421") == 0, 0.0)
           .otherwise(F.greatest(F.lit(1000.0), F.least(roundz("BCC5421", 1000), F.lit(5000.0))) / 1000))
    woe = None
    for k, v in BCC5421_WOE:
        woe = F.when(cap == k, F.lit(v)) if woe is None else woe.when(cap == k, F.lit(v))
    woe = woe.otherwise(F.lit(BCC5421_WOE_ELSE))
    iqt = F.when(a("IQT9510") > 9990, 8.0).otherwise(F.least(a("IQT9510"), F.lit(11.0)))
    rev = F.when(a("REV3511") > 90, 3.0).otherwise(F.least(a("REV3511"), F.lit(2.0)))
    return df.select("*", cap.alias("bcc5421_impcap"), woe.alias("bcc5421_woe"), iqt.alias("iqt9510_impcap"),
                     F.log1p(iqt).alias("iqt9510_impcaplog"), rev.alias("rev3511_cap"))


def feature_select(df: DataFrame, keep: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Model keep-list after the id columns; a listed variable that is not there raises."""
    cols = list(dict.fromkeys([*ids, *keep]))
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing model variables: {missing}")
    return df.select(*cols)
