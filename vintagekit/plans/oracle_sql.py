"""Independent ANSI/DuckDB SQL for every registered query (the correctness oracle).

Tables available as views: region nation customer supplier part orders
lineitem events documents embeddings pages benchmark labels conversations.
Fragments below rebuild the adapters in SQL; each query appends its own CTEs.
Double outputs are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from vintagekit.config import DEFAULT_READS, SCORE_AVAILABILITY_MAX_MOB, StudyConfig

CFG = StudyConfig()


def _d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def _codes(cfg: StudyConfig = CFG) -> str:
    return ", ".join(f"'{c}'" for c in cfg.codes)


def _ids(cfg: StudyConfig = CFG) -> str:
    return ", ".join(str(i) for i in cfg.exclusion_ids)


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap a query so the named double columns are rounded."""
    if not cols:
        return sql
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    rep = ", ".join(f"round({c} * {scale}) / {scale} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _q"


# ----------------------------------------------------------------------------
# Adapter A in SQL
# ----------------------------------------------------------------------------

FACT = """
li AS (
  SELECT o.o_custkey AS creditaccountid,
         l.l_orderkey * 10 + l.l_linenumber AS cardid,
         l.l_partkey AS card_part, l.l_suppkey AS card_supp,
         CAST(l.l_shipdate AS DATE) AS shipdate,
         l.l_quantity, l.l_tax, l.l_returnflag, l.l_linestatus
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
li2 AS (
  SELECT *, last_day(shipdate) AS reportingdate,
         min(shipdate) OVER (PARTITION BY creditaccountid) AS opendate
  FROM li
),
fact AS (
  SELECT creditaccountid, cardid, card_part, card_supp, reportingdate, opendate,
    CAST((year(reportingdate) * 12 + month(reportingdate)) - (year(opendate) * 12 + month(opendate)) AS INTEGER)
      AS monthsonbooks,
    CASE WHEN reportingdate = last_day(opendate) THEN 1 ELSE 0 END AS newaccountindicator,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE 1 END AS activeaccountindicator,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 3 THEN 1 ELSE 0 END
      AS chargeoffindicator,
    CASE WHEN l_quantity >= 46 THEN 60 WHEN l_quantity >= 41 THEN 30 ELSE 0 END AS dimbucketid,
    CAST((card_part * 3 + card_supp * 11) % 2000 AS INTEGER) AS dimstatusreasonid,
    CAST(CASE WHEN (card_part + card_supp) % 20 = 0 THEN NULL
              ELSE 350 + (card_part * 7 + card_supp * 13) % 600 END AS INTEGER) AS bhvr_score,
    CASE WHEN l_tax >= CAST(0.07 AS DOUBLE) THEN 'Z' WHEN l_tax >= CAST(0.06 AS DOUBLE) THEN ' ' ELSE NULL END
      AS esc,
    'BS' || CAST(card_supp % 3 + 1 AS VARCHAR) AS scorecard,
    upper(substr(c.c_mktsegment, 1, 4)) || lpad(CAST(c.c_custkey AS VARCHAR), 6, '0') AS reservationnumber,
    c.c_nationkey AS dimproductofferedid,
    CAST(1000 + (c.c_custkey % 5) * 2000 AS DOUBLE) AS creditline,
    CAST(500 + floor((c.c_acctbal + 1000) * CAST(0.03 AS DOUBLE)) AS INTEGER) AS vantage3
  FROM li2 JOIN customer c ON li2.creditaccountid = c.c_custkey
),
products AS (
  SELECT n.n_nationkey AS dimproductofferedid, r.r_name AS channel
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def window_cte(cfg: StudyConfig = CFG) -> str:
    offset = cfg.max_horizon - 1 if cfg.m1_inclusive else cfg.max_horizon
    return f"""
win0 AS (
  SELECT min(CASE WHEN newaccountindicator = 1 THEN date_trunc('month', opendate) END)::DATE AS first_board_month,
         max(reportingdate) AS latest_reporting_date
  FROM fact WHERE cardid IS NOT NULL AND substr(reservationnumber, 1, 4) IN ({_codes(cfg)})
),
win AS (
  SELECT *,
    last_day(first_board_month) AS start_eom,
    last_day(latest_data_month) AS end_eom,
    (first_board_month - INTERVAL {cfg.exclusion_lookback_months} MONTH)::DATE AS excl_start,
    CAST(year(latest_data_month) * 12 + month(latest_data_month)
         - year(first_board_month) * 12 - month(first_board_month) + 1 AS INTEGER) AS board_months,
    (latest_data_month - INTERVAL {offset} MONTH)::DATE AS portfolio_snapshot_month
  FROM (
    SELECT *, CASE WHEN latest_reporting_date >= last_day(latest_reporting_date)
                   THEN date_trunc('month', latest_reporting_date)::DATE
                   ELSE (date_trunc('month', latest_reporting_date) - INTERVAL 1 MONTH)::DATE END
              AS latest_data_month
    FROM win0) w
),
excl AS (
  SELECT DISTINCT f.creditaccountid FROM fact f, win
  WHERE f.cardid IS NOT NULL AND f.reportingdate >= win.excl_start AND f.dimstatusreasonid IN ({_ids(cfg)})
)"""


def boards_cte(cfg: StudyConfig = CFG, name: str = "boards", start: str = "win.start_eom",
               end: str = "win.end_eom", tier: bool = True) -> str:
    tier_sql = f"AND a.creditline = {cfg.creditline_tier}" if (tier and cfg.creditline_tier is not None) else ""
    return f"""
{name}_raw AS (
  SELECT date_trunc('month', a.reportingdate)::DATE AS vintage, a.reportingdate AS cohort_reportingdate,
         a.opendate, a.creditaccountid, a.cardid AS board_cardid, a.reservationnumber,
         substr(a.reservationnumber, 1, 4) AS program_code, substr(a.reservationnumber, 1, 6) AS campaign_code,
         p.channel, a.creditline,
         row_number() OVER (PARTITION BY a.creditaccountid
                            ORDER BY a.reportingdate ASC, a.cardid DESC, a.card_part DESC, a.card_supp DESC) AS rn
  FROM fact a CROSS JOIN win LEFT JOIN products p ON a.dimproductofferedid = p.dimproductofferedid
  WHERE a.reportingdate >= {start} AND a.reportingdate <= {end}
    AND a.cardid IS NOT NULL AND a.newaccountindicator = 1
    AND substr(a.reservationnumber, 1, 4) IN ({_codes(cfg)}) {tier_sql}
),
{name} AS (SELECT * EXCLUDE (rn) FROM {name}_raw WHERE rn = 1)"""


def score_cte(cfg: StudyConfig = CFG, boards: str = "boards", bounded: bool = True) -> str:
    bounds = "AND s.reportingdate >= win.start_eom AND s.reportingdate <= win.end_eom" if bounded else ""
    mob = f"AND s.monthsonbooks = {cfg.score_mob}" if cfg.score_mob is not None else ""
    return f"""
score_rows AS (
  SELECT b.creditaccountid, s.reportingdate AS score_reportingdate, s.monthsonbooks AS score_mob,
         s.dimbucketid AS bucket_at_score, s.bhvr_score, s.esc, s.scorecard,
         row_number() OVER (PARTITION BY b.creditaccountid ORDER BY
             CASE WHEN s.bhvr_score BETWEEN {cfg.valid_min} AND {cfg.valid_max} THEN 0 ELSE 1 END,
             CASE WHEN s.esc IS NULL OR trim(s.esc) = '' THEN 0 ELSE 1 END,
             s.reportingdate DESC, s.cardid DESC, s.card_part DESC, s.card_supp DESC) AS rn
  FROM {boards} b CROSS JOIN win JOIN fact s ON b.creditaccountid = s.creditaccountid
   AND s.cardid IS NOT NULL {bounds} {mob}
),
score AS (SELECT * EXCLUDE (rn) FROM score_rows WHERE rn = 1)"""


def cohort_perf_ctes(cfg: StudyConfig = CFG, boards: str = "boards", bounded: bool = True,
                     mode: str = "ever") -> str:
    bounds = "AND p.reportingdate >= win.start_eom AND p.reportingdate <= win.end_eom" if bounded else ""
    parts = []
    for r in cfg.reads:
        if mode == "ever":
            mob = f"p.monthsonbooks BETWEEN {cfg.perf_start_mob} AND {r.horizon}"
        else:
            mob = (f"(p.monthsonbooks = {r.horizon} OR (p.monthsonbooks BETWEEN {cfg.perf_start_mob} "
                   f"AND {r.horizon} AND p.chargeoffindicator = 1))")
        parts.append(f"""
perf_{r.key} AS (
  SELECT p.creditaccountid,
    max(p.monthsonbooks) AS max_mob_observed,
    max(p.dimbucketid) AS max_bucket,
    max(CASE WHEN p.chargeoffindicator = 1 THEN 1 ELSE 0 END) AS chargeoff,
    max(CASE WHEN p.chargeoffindicator = 1 AND p.dimstatusreasonid NOT IN ({_ids(cfg)}) THEN 1 ELSE 0 END)
      AS contractual_chargeoff,
    max(CASE WHEN p.monthsonbooks = {r.horizon} THEN 1 ELSE 0 END) AS has_horizon_mob,
    max(CASE WHEN p.dimbucketid >= {r.bucket} OR p.chargeoffindicator = 1 THEN 1 ELSE 0 END) AS target
  FROM {boards} b CROSS JOIN win JOIN fact p ON b.creditaccountid = p.creditaccountid
   AND p.cardid IS NOT NULL {bounds} AND {mob}
   AND (p.activeaccountindicator = 1 OR p.chargeoffindicator = 1)
  GROUP BY p.creditaccountid
)""")
    return ",".join(parts)


def cohort_union(cfg: StudyConfig = CFG, boards: str = "boards") -> str:
    sel = []
    for r in cfg.reads:
        sel.append(f"""
  SELECT b.*, s.score_reportingdate, s.score_mob, s.bucket_at_score, s.bhvr_score, s.esc, s.scorecard,
         '{r.key}' AS read_key, {r.bucket} AS target_bucket, {r.horizon} AS horizon,
         pf.max_mob_observed, pf.max_bucket, pf.chargeoff, pf.contractual_chargeoff, pf.has_horizon_mob,
         pf.target,
         CASE WHEN coalesce(pf.has_horizon_mob, 0) = 1 OR coalesce(pf.chargeoff, 0) = 1 THEN 1 ELSE 0 END
           AS metric_eligible
  FROM {boards} b LEFT JOIN score s ON b.creditaccountid = s.creditaccountid
  LEFT JOIN perf_{r.key} pf ON b.creditaccountid = pf.creditaccountid""")
    return "\nUNION ALL\n".join(sel)


def cohort_ctes(cfg: StudyConfig = CFG, exclude: bool = True, mode: str = "ever") -> str:
    """CTEs up to ``cohort`` (valid score, exclusions applied) and ``pairs`` (eligible)."""
    excl = "AND creditaccountid NOT IN (SELECT creditaccountid FROM excl)" if exclude else ""
    return ("WITH " + FACT + "," + window_cte(cfg) + "," + boards_cte(cfg) + "," + score_cte(cfg) + ","
            + cohort_perf_ctes(cfg, mode=mode) + f""",
cohort_all AS ({cohort_union(cfg)}
),
cohort AS (
  SELECT * FROM cohort_all
  WHERE bhvr_score BETWEEN {cfg.valid_min} AND {cfg.valid_max} {excl}
),
pairs AS (
  SELECT *, CAST(coalesce(target, 0) AS INTEGER) AS bad FROM cohort WHERE metric_eligible = 1
)""")


def deciles_sql(src: str, groups: list[str], k: int = 10, score: str = "bhvr_score") -> str:
    """Tie-aware deciles over CTE ``src`` (columns groups..., score, bad)."""
    g = ", ".join(groups)
    gp = f"PARTITION BY {g}" if groups else ""
    gsel = g + ", " if groups else ""
    return f"""
dsc AS (
  SELECT {gsel}{score}, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bads FROM {src} GROUP BY {gsel}{score}
),
dsc2 AS (
  SELECT *, sum(n) OVER ({gp} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_n0,
         sum(n) OVER ({gp}) AS total_n, sum(bads) OVER ({gp}) AS total_bads
  FROM dsc
),
dsc3 AS (
  SELECT *, CAST(least(greatest((cum_n0 * {k} + total_n - 1) // total_n, 1), {k}) AS INTEGER) AS decile FROM dsc2
),
dec0 AS (
  SELECT {gsel}decile, min({score}) AS score_min, max({score}) AS score_max,
         CAST(sum(n) AS BIGINT) AS n, CAST(sum(bads) AS BIGINT) AS bads,
         CAST(any_value(total_n) AS BIGINT) AS total_n, CAST(any_value(total_bads) AS BIGINT) AS total_bads
  FROM dsc3 GROUP BY {gsel}decile
),
deciles AS (
  SELECT {gsel}decile, score_min, score_max, n, bads,
    CASE WHEN n = 0 THEN NULL ELSE bads / n END AS bad_rate,
    CASE WHEN total_bads = 0 OR total_n = 0 THEN NULL ELSE (bads / n) / (total_bads / total_n) END
      AS lift_vs_overall,
    n / total_n AS pct_population,
    CAST(sum(n) OVER ({gp} ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_n,
    CAST(sum(bads) OVER ({gp} ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
      AS cum_bads,
    CAST(round(n * 100.0 / max(n) OVER ({gp})) AS INTEGER) AS bar_pct,
    total_bads
  FROM dec0
),
deciles_full AS (
  SELECT * EXCLUDE (total_bads), cum_bads / cum_n AS cum_bad_rate,
         CASE WHEN total_bads = 0 THEN NULL ELSE cum_bads / total_bads END AS cum_bad_share
  FROM deciles
)"""


DECILE_DOUBLES = ["bad_rate", "lift_vs_overall", "pct_population", "cum_bad_rate", "cum_bad_share"]

QUERIES: dict[str, str] = {}


def register(name: str, sql: str, doubles: list[str] | None = None) -> None:
    QUERIES[name] = rounded(sql, doubles or [])


register("tie_aware_deciles",
         cohort_ctes() + "," + deciles_sql("pairs", ["read_key"]) + "\nSELECT * FROM deciles_full",
         DECILE_DOUBLES)


# ----------------------------------------------------------------------------
# study: sources, window, sets
# ----------------------------------------------------------------------------

BASE = "WITH " + FACT + "," + window_cte()

register("scan_account_month", BASE + "\nSELECT * FROM fact")

register("dim_enrich", BASE + """,
mefi AS (
  SELECT l_orderkey * 10 + l_linenumber AS cardid, last_day(CAST(l_shipdate AS DATE)) AS reportingdate,
         'SC' || CAST(min(l_suppkey) % 4 AS VARCHAR) AS behaviorscorecardidentifier
  FROM lineitem GROUP BY 1, 2
)
SELECT f.*, p.channel, m.behaviorscorecardidentifier
FROM fact f LEFT JOIN products p ON f.dimproductofferedid = p.dimproductofferedid
LEFT JOIN mefi m ON f.cardid = m.cardid AND f.reportingdate = m.reportingdate""")

register("data_window", BASE + """
SELECT first_board_month, latest_reporting_date, latest_data_month, board_months, portfolio_snapshot_month FROM win""")

register("exclusion_set", BASE + "\nSELECT * FROM excl")

TIER = f"""
tier AS (
  SELECT DISTINCT creditaccountid FROM fact
  WHERE cardid IS NOT NULL AND newaccountindicator = 1 AND substr(reservationnumber, 1, 4) IN ({_codes()})
    AND creditline = {CFG.creditline_tier}
)"""

register("tier_accounts", BASE + "," + TIER + "\nSELECT * FROM tier")

register("available_cohorts", BASE + "," + boards_cte() + """,
mob AS (
  SELECT b.creditaccountid, max(p.monthsonbooks) AS max_mob_observed
  FROM boards b LEFT JOIN fact p ON b.creditaccountid = p.creditaccountid AND p.cardid IS NOT NULL
  GROUP BY b.creditaccountid
)
SELECT b.vintage, b.program_code, b.channel, count(*) AS accounts, min(b.opendate) AS min_opendate,
       max(b.opendate) AS max_opendate, avg(b.creditline) AS avg_creditline,
       CAST(sum(CASE WHEN coalesce(m.max_mob_observed, -1) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS matured_mob4,
       CAST(sum(CASE WHEN coalesce(m.max_mob_observed, -1) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS matured_mob6,
       max(m.max_mob_observed) AS max_mob_observed
FROM boards b LEFT JOIN mob m ON b.creditaccountid = m.creditaccountid
GROUP BY b.vintage, b.program_code, b.channel""", ["avg_creditline"])

register("score_availability", BASE + "," + boards_cte() + f"""
SELECT b.vintage, s.monthsonbooks AS score_mob,
  count(DISTINCT b.creditaccountid) AS boarded_accounts_with_row,
  count(DISTINCT CASE WHEN s.bhvr_score IS NOT NULL THEN b.creditaccountid END) AS accounts_with_score,
  count(DISTINCT CASE WHEN s.bhvr_score BETWEEN {CFG.valid_min} AND {CFG.valid_max} THEN b.creditaccountid END)
    AS accounts_with_valid_score,
  min(s.bhvr_score) AS min_score, max(s.bhvr_score) AS max_score,
  count(DISTINCT CASE WHEN s.bhvr_score BETWEEN {CFG.valid_min} AND {CFG.valid_max} THEN b.creditaccountid END)
    / count(DISTINCT b.creditaccountid) AS valid_score_rate_among_rows
FROM boards b LEFT JOIN fact s ON b.creditaccountid = s.creditaccountid AND s.cardid IS NOT NULL
  AND s.monthsonbooks BETWEEN 1 AND 8
GROUP BY b.vintage, s.monthsonbooks""", ["valid_score_rate_among_rows"])

# ----------------------------------------------------------------------------
# study: cohorts and snapshots
# ----------------------------------------------------------------------------

COHORT_DOUBLES = ["creditline"]
register("cohort_bulk", cohort_ctes() + "\nSELECT * FROM cohort", COHORT_DOUBLES)
register("cohort_point_in_time", cohort_ctes(mode="point_in_time") + "\nSELECT * FROM cohort", COHORT_DOUBLES)

register("cohort_month", "WITH " + FACT + "," + window_cte()
         + "," + boards_cte(start="win.start_eom", end="win.start_eom") + "," + score_cte(bounded=False) + ","
         + cohort_perf_ctes(bounded=False) + f""",
cohort_all AS ({cohort_union()})
SELECT *, 'ever' AS performance_mode, CAST(NULL AS INTEGER) AS configured_score_mob FROM cohort_all
WHERE bhvr_score BETWEEN {CFG.valid_min} AND {CFG.valid_max}""", COHORT_DOUBLES)


#: Snapshot month: the detected one; ``at_month`` puts a given month in its place.
SNAPSHOT = "(SELECT portfolio_snapshot_month FROM win)"
OBS = f"last_day({SNAPSHOT})"


def at_month(sql: str, month: dt.date) -> str:
    return sql.replace(SNAPSHOT, _d(month))


def _perf_bounds(horizon: int, cfg: StudyConfig = CFG):
    shift = 0 if cfg.m1_inclusive else 1
    return tuple(f"last_day(CAST({SNAPSHOT} + INTERVAL {k} MONTH AS DATE))" for k in (shift, horizon - 1 + shift))


VALID = f"BETWEEN {CFG.valid_min} AND {CFG.valid_max}"
VALID_CASE = f"CASE WHEN a.bhvr_score {VALID} THEN 0 ELSE 1 END"
BLANK_CASE = "CASE WHEN a.esc IS NULL OR trim(a.esc) = '' THEN 0 ELSE 1 END"
CARD_ORDER = "a.cardid DESC, a.card_part DESC, a.card_supp DESC"


def snap_cte(name: str = "snap", variant: str = "score_status_card") -> str:
    order = []
    if variant in ("score_status_card", "score_card"):
        order.append(VALID_CASE)
    if variant == "score_status_card":
        order.append(BLANK_CASE)
    order.append(CARD_ORDER)
    return f"""
{name}_raw AS (
  SELECT date_trunc('month', a.reportingdate)::DATE AS vintage, a.reportingdate AS snapshot_reportingdate,
    a.opendate, date_trunc('month', a.opendate)::DATE AS board_month, a.creditaccountid,
    a.cardid AS snapshot_cardid, a.activeaccountindicator, a.newaccountindicator,
    CASE WHEN a.activeaccountindicator = 1 THEN 'active' WHEN a.newaccountindicator = 1 THEN 'new_board'
         ELSE 'other' END AS snapshot_population_source,
    a.reservationnumber, substr(a.reservationnumber, 1, 4) AS program_code,
    substr(a.reservationnumber, 1, 6) AS campaign_code, p.channel, a.creditline,
    a.dimbucketid AS bucket_at_snapshot, a.bhvr_score, a.esc, a.scorecard,
    row_number() OVER (PARTITION BY a.creditaccountid ORDER BY {', '.join(order)}) AS rn
  FROM fact a LEFT JOIN products p ON a.dimproductofferedid = p.dimproductofferedid
  WHERE a.reportingdate = {OBS} AND a.cardid IS NOT NULL
    AND (a.activeaccountindicator = 1 OR a.newaccountindicator = 1)
    AND substr(a.reservationnumber, 1, 4) IN ({_codes()})
),
{name} AS (SELECT * EXCLUDE (rn) FROM {name}_raw WHERE rn = 1)"""


def fperf_ctes(src: str, prefix: str) -> str:
    parts = []
    for r in CFG.reads:
        s, e = _perf_bounds(r.horizon)
        parts.append(f"""
{prefix}_{r.key} AS (
  SELECT p.creditaccountid, max(p.monthsonbooks) AS max_mob_observed, max(p.dimbucketid) AS max_bucket,
    max(CASE WHEN p.chargeoffindicator = 1 THEN 1 ELSE 0 END) AS chargeoff,
    max(CASE WHEN p.chargeoffindicator = 1 AND p.dimstatusreasonid NOT IN ({_ids()}) THEN 1 ELSE 0 END)
      AS contractual_chargeoff,
    max(CASE WHEN p.reportingdate = {e} THEN 1 ELSE 0 END) AS has_horizon,
    max(CASE WHEN p.dimbucketid >= {r.bucket} OR p.chargeoffindicator = 1 THEN 1 ELSE 0 END) AS target
  FROM fact p JOIN {src} s ON p.creditaccountid = s.creditaccountid
  WHERE p.reportingdate >= {s} AND p.reportingdate <= {e} AND p.cardid IS NOT NULL
    AND (p.activeaccountindicator = 1 OR p.chargeoffindicator = 1)
  GROUP BY p.creditaccountid
)""")
    return ",".join(parts)


def long_union(src: str, prefix: str, name: str) -> str:
    sel = []
    for r in CFG.reads:
        sel.append(f"""
  SELECT s.*, '{r.key}' AS read_key, {r.bucket} AS target_bucket, {r.horizon} AS horizon,
    f.max_mob_observed, f.max_bucket, f.chargeoff, f.contractual_chargeoff, f.has_horizon, f.target,
    CASE WHEN coalesce(f.has_horizon, 0) = 1 OR coalesce(f.chargeoff, 0) = 1 THEN 1 ELSE 0 END AS metric_eligible
  FROM {src} s LEFT JOIN {prefix}_{r.key} f ON s.creditaccountid = f.creditaccountid""")
    return f"{name} AS (" + "\nUNION ALL\n".join(sel) + "\n)"


PORT = BASE + "," + TIER + "," + snap_cte() + "," + fperf_ctes("snap", "fp") + "," + long_union("snap", "fp", "snap_long") + f""",
port AS (
  SELECT * RENAME (has_horizon AS has_horizon_snapshot) FROM snap_long
  WHERE creditaccountid NOT IN (SELECT creditaccountid FROM excl)
    AND creditaccountid IN (SELECT creditaccountid FROM tier)
    AND bhvr_score {VALID} AND metric_eligible = 1
)"""
register("portfolio_snapshot", PORT + "\nSELECT * FROM port", ["creditline"])
GIVEN_MONTH = dt.date(1998, 6, 1)
register("portfolio_snapshot_given", at_month(PORT, GIVEN_MONTH) + "\nSELECT * FROM port", ["creditline"])


def _closest_ctes() -> str:
    parts = []
    for r in CFG.reads:
        _, e = _perf_bounds(r.horizon)
        parts.append(f"""
cs_{r.key} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT a.creditaccountid, s.reportingdate AS score_reportingdate, s.monthsonbooks AS score_mob,
      s.cardid AS score_cardid, CAST(date_diff('day', {OBS}, s.reportingdate) AS INTEGER) AS days_from_snapshot,
      s.bhvr_score, s.esc, s.scorecard,
      row_number() OVER (PARTITION BY a.creditaccountid ORDER BY abs(date_diff('day', {OBS}, s.reportingdate)),
        s.reportingdate, s.cardid DESC, s.card_part DESC, s.card_supp DESC) AS rn
    FROM snapc a JOIN fact s ON a.creditaccountid = s.creditaccountid AND s.cardid IS NOT NULL
     AND s.reportingdate >= {OBS} AND s.reportingdate <= {e} AND s.bhvr_score {VALID}
  ) WHERE rn = 1
)""")
    return ",".join(parts)


def _closest_union() -> str:
    sel = []
    for r in CFG.reads:
        sel.append(f"""
  SELECT l.* RENAME (has_horizon AS has_horizon_snapshot), c.score_reportingdate, c.score_mob, c.score_cardid,
         c.days_from_snapshot, c.bhvr_score, c.esc, c.scorecard
  FROM snapc_long l LEFT JOIN cs_{r.key} c ON l.creditaccountid = c.creditaccountid
  WHERE l.read_key = '{r.key}'""")
    return "\nUNION ALL\n".join(sel)


CLOSEST = (BASE + "," + snap_cte("snapc0", "card") + """,
snapc AS (SELECT * EXCLUDE (bhvr_score, esc, scorecard) FROM snapc0),""" + fperf_ctes("snapc", "fpc") + ","
           + long_union("snapc", "fpc", "snapc_long") + "," + _closest_ctes() + f""",
closest AS ({_closest_union()})
SELECT * FROM closest WHERE bhvr_score {VALID} AND metric_eligible = 1""")
register("portfolio_closest_score", CLOSEST, ["creditline"])
register("portfolio_closest_score_given", at_month(CLOSEST, GIVEN_MONTH), ["creditline"])

GROUP_CASE = """CASE WHEN creditline >= 5000 THEN 'Group 1 - Credit Line >= $5,000'
       WHEN creditline < 5000 AND creditline >= 3000 THEN 'Group 2 - $5,000 > Credit Line >= $3,000'
       WHEN creditline < 3000 THEN 'Group 3 - Credit Line < $3,000'
       ELSE 'Group Unknown Credit Line' END"""

BENCH_CTES = f"""
bsnap_raw AS (
  SELECT date_trunc('month', a.reportingdate)::DATE AS vintage, a.reportingdate AS snapshot_reportingdate,
    a.opendate, date_trunc('month', a.opendate)::DATE AS board_month, a.creditaccountid,
    a.cardid AS snapshot_cardid, a.reservationnumber, substr(a.reservationnumber, 1, 4) AS program_code,
    p.channel, a.creditline, a.vantage3, a.dimbucketid AS bucket_at_snapshot, a.bhvr_score, a.esc, a.scorecard,
    row_number() OVER (PARTITION BY a.creditaccountid ORDER BY {VALID_CASE}, {CARD_ORDER}) AS rn
  FROM fact a LEFT JOIN products p ON a.dimproductofferedid = p.dimproductofferedid
  WHERE a.reportingdate = {OBS} AND a.cardid IS NOT NULL AND a.activeaccountindicator = 1
    AND a.dimbucketid <= {CFG.benchmark_bucket_max} AND a.vantage3 >= {CFG.benchmark_vantage_min}
    AND (a.reservationnumber IS NULL OR substr(a.reservationnumber, 1, 4) NOT IN ({_codes()}))
    AND (a.esc IS NULL OR trim(a.esc) = '')
),
bsnap AS (SELECT * EXCLUDE (rn) FROM bsnap_raw WHERE rn = 1),""" + fperf_ctes("bsnap", "fb") + "," + long_union("bsnap", "fb", "bsnap_long") + f""",
bench AS (
  SELECT * EXCLUDE (has_horizon, target, metric_eligible), coalesce(target, 0) AS target, 1 AS metric_eligible,
         {GROUP_CASE} AS benchmark_group
  FROM bsnap_long WHERE creditaccountid NOT IN (SELECT creditaccountid FROM excl)
)"""
BENCH = BASE + "," + BENCH_CTES
register("benchmark_snapshot", BENCH + "\nSELECT * FROM bench", ["creditline"])

DIAG = BASE + "," + snap_cte() + "," + fperf_ctes("snap", "fp") + "," + long_union("snap", "fp", "snap_long")
register("snapshot_diagnostics", DIAG + f"""
SELECT read_key, board_month, snapshot_population_source, program_code, channel,
  count(*) AS active_or_new_snapshot_accounts,
  CAST(sum(CASE WHEN activeaccountindicator = 1 THEN 1 ELSE 0 END) AS BIGINT) AS active_snapshot_accounts,
  CAST(sum(CASE WHEN newaccountindicator = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new_board_snapshot_accounts,
  CAST(sum(CASE WHEN bhvr_score IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS accounts_with_score,
  CAST(sum(CASE WHEN bhvr_score {VALID} THEN 1 ELSE 0 END) AS BIGINT) AS accounts_with_valid_score,
  CAST(sum(metric_eligible) AS BIGINT) AS eligible_accounts,
  CAST(sum(CASE WHEN bhvr_score {VALID} AND metric_eligible = 1 THEN 1 ELSE 0 END) AS BIGINT)
    AS eligible_valid_score_accounts,
  CAST(sum(CASE WHEN bhvr_score {VALID} AND metric_eligible = 1 AND coalesce(target, 0) = 1 THEN 1 ELSE 0 END)
    AS BIGINT) AS bads_valid_score,
  avg(CASE WHEN bhvr_score {VALID} THEN CAST(bhvr_score AS DOUBLE) END) AS avg_valid_score
FROM snap_long GROUP BY ALL""", ["avg_valid_score"])

register("snapshot_summary", DIAG + f""",
d AS (
  SELECT read_key, board_month, count(*) AS a, sum(CASE WHEN activeaccountindicator = 1 THEN 1 ELSE 0 END) AS b,
    sum(CASE WHEN newaccountindicator = 1 THEN 1 ELSE 0 END) AS c,
    sum(CASE WHEN bhvr_score IS NOT NULL THEN 1 ELSE 0 END) AS d,
    sum(CASE WHEN bhvr_score {VALID} THEN 1 ELSE 0 END) AS e, sum(metric_eligible) AS f,
    sum(CASE WHEN bhvr_score {VALID} AND metric_eligible = 1 THEN 1 ELSE 0 END) AS g,
    sum(CASE WHEN bhvr_score {VALID} AND metric_eligible = 1 AND coalesce(target, 0) = 1 THEN 1 ELSE 0 END) AS h
  FROM snap_long GROUP BY ALL
)
SELECT read_key, board_month, CAST(a AS BIGINT) AS active_or_new_snapshot_accounts,
  CAST(b AS BIGINT) AS active_snapshot_accounts, CAST(c AS BIGINT) AS new_board_snapshot_accounts,
  CAST(d AS BIGINT) AS accounts_with_score, CAST(e AS BIGINT) AS accounts_with_valid_score,
  CAST(f AS BIGINT) AS eligible_accounts, CAST(g AS BIGINT) AS eligible_valid_score_accounts,
  CAST(h AS BIGINT) AS bads_valid_score,
  CASE WHEN a = 0 THEN NULL ELSE e / a END AS valid_score_rate,
  CASE WHEN a = 0 THEN NULL ELSE g / a END AS eligible_valid_score_rate,
  CASE WHEN g = 0 THEN NULL ELSE h / g END AS bad_rate_valid_score
FROM d""", ["valid_score_rate", "eligible_valid_score_rate", "bad_rate_valid_score"])

STATUS = BASE + "," + snap_cte("ssnap", "score_card")
register("score_status", STATUS + f"""
SELECT board_month, snapshot_population_source, program_code, channel,
  CASE WHEN bhvr_score {VALID} THEN 'valid_{CFG.valid_min}_{CFG.valid_max}'
       WHEN bhvr_score IS NULL THEN 'missing_score'
       WHEN bhvr_score < {CFG.valid_min} THEN 'below_{CFG.valid_min}_exception'
       WHEN bhvr_score > {CFG.valid_max} THEN 'above_{CFG.valid_max}_exception' ELSE 'other_invalid' END
    AS snapshot_score_status,
  count(*) AS accounts, min(bhvr_score) AS min_snapshot_score, max(bhvr_score) AS max_snapshot_score,
  avg(CAST(bhvr_score AS DOUBLE)) AS avg_snapshot_score
FROM ssnap GROUP BY ALL""", ["avg_snapshot_score"])

register("invalid_scores", STATUS + f"""
SELECT board_month, snapshot_population_source, program_code, channel, bhvr_score AS snapshot_bhvr_score,
       count(*) AS accounts
FROM ssnap WHERE bhvr_score IS NULL OR bhvr_score < {CFG.valid_min} OR bhvr_score > {CFG.valid_max}
GROUP BY ALL""")

register("funnel", BASE + f"""
SELECT count(*) AS step1_rows_at_snapshot,
  CAST(sum(CASE WHEN activeaccountindicator = 1 OR newaccountindicator = 1 THEN 1 ELSE 0 END) AS BIGINT)
    AS step2_active_or_new,
  CAST(sum(CASE WHEN (activeaccountindicator = 1 OR newaccountindicator = 1) AND creditline = {CFG.creditline_tier}
    THEN 1 ELSE 0 END) AS BIGINT) AS step3_snapshot_cl_tier,
  CAST(sum(CASE WHEN (activeaccountindicator = 1 OR newaccountindicator = 1) AND bhvr_score {VALID}
    THEN 1 ELSE 0 END) AS BIGINT) AS step4_valid_score,
  CAST(sum(CASE WHEN (activeaccountindicator = 1 OR newaccountindicator = 1) AND dimbucketid <= 29
    THEN 1 ELSE 0 END) AS BIGINT) AS step5_current_or_30dpd
FROM fact WHERE reportingdate = {OBS} AND cardid IS NOT NULL AND substr(reservationnumber, 1, 4) IN ({_codes()})""")

register("read_funnel", BASE + "," + TIER + "," + snap_cte() + "," + fperf_ctes("snap", "fp") + ","
         + long_union("snap", "fp", "snap_long") + f"""
SELECT read_key, count(*) AS pulled,
  CAST(sum(CASE WHEN creditaccountid NOT IN (SELECT creditaccountid FROM excl) THEN 1 ELSE 0 END) AS BIGINT)
    AS not_excluded,
  CAST(sum(CASE WHEN creditaccountid NOT IN (SELECT creditaccountid FROM excl)
                 AND creditaccountid IN (SELECT creditaccountid FROM tier) THEN 1 ELSE 0 END) AS BIGINT) AS at_tier
FROM snap_long WHERE bhvr_score {VALID} AND metric_eligible = 1 GROUP BY read_key""")

register("board_reconciliation", BASE + f""",
g AS (
  SELECT strftime(date_trunc('month', a.opendate), '%Y-%m') AS board_month,
    count(DISTINCT a.creditaccountid) AS boards_any_cl,
    count(DISTINCT CASE WHEN a.creditline = {CFG.creditline_tier} THEN a.creditaccountid END) AS boards_at_tier,
    avg(a.creditline) AS avg_creditline, count(DISTINCT a.creditaccountid) AS boards_once
  FROM fact a, win
  WHERE a.cardid IS NOT NULL AND a.newaccountindicator = 1 AND substr(a.reservationnumber, 1, 4) IN ({_codes()})
    AND a.reportingdate >= win.start_eom AND a.reportingdate <= win.end_eom
  GROUP BY 1
),
u AS (
  SELECT * FROM g
  UNION ALL
  SELECT 'TOTAL', CAST(sum(boards_any_cl) AS BIGINT), CAST(sum(boards_at_tier) AS BIGINT), CAST(NULL AS DOUBLE),
    (SELECT count(DISTINCT a.creditaccountid) FROM fact a, win
     WHERE a.cardid IS NOT NULL AND a.newaccountindicator = 1 AND substr(a.reservationnumber, 1, 4) IN ({_codes()})
       AND a.reportingdate >= win.start_eom AND a.reportingdate <= win.end_eom) FROM g
)
SELECT *, CASE WHEN boards_any_cl = 0 THEN NULL ELSE boards_at_tier / boards_any_cl END AS tier_share FROM u""",
         ["avg_creditline", "tier_share"])

# ----------------------------------------------------------------------------
# study: rank-order analytics
# ----------------------------------------------------------------------------


def quantile_sql(src: str, groups: list[str], k: int = 10, score: str = "bhvr_score") -> str:
    g = ", ".join(groups)
    cases = " ".join(
        f"WHEN {kk} THEN quantile_cont({score}, [{', '.join(repr(i / kk) for i in range(kk + 1))}])"
        for kk in range(2, k + 1))
    on = " AND ".join(f"p.{c} = q.{c}" for c in groups)
    return f"""
qk AS (SELECT {g}, least(count(DISTINCT {score}), {k}) AS k FROM {src} GROUP BY {g}),
qe AS (
  SELECT {', '.join('p.' + c for c in groups)}, any_value(q.k) AS k,
         list_sort(list_distinct(CASE any_value(q.k) {cases} END)) AS edges
  FROM {src} p JOIN qk q ON {on} GROUP BY {', '.join('p.' + c for c in groups)}
),
qb AS (
  SELECT p.*, CAST(CASE WHEN q.k <= 1 THEN 1
    ELSE greatest(len(list_filter(q.edges, lambda e: e < p.{score})) - 1, 0) + 1 END AS INTEGER) AS score_decile
  FROM {src} p JOIN qe q ON {on}
),
qd AS (
  SELECT {g}, score_decile, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bads, min({score}) AS score_min,
         max({score}) AS score_max, avg({score}) AS score_mean, median({score}) AS score_median
  FROM qb GROUP BY ALL
),
qdec AS (
  SELECT *, n - bads AS goods, bads / n AS bad_rate,
    CASE WHEN sum(bads) OVER (PARTITION BY {g}) = 0 THEN NULL
         ELSE (bads / n) / (sum(bads) OVER (PARTITION BY {g}) / sum(n) OVER (PARTITION BY {g})) END AS lift_vs_overall,
    n / sum(n) OVER (PARTITION BY {g}) AS pct_population,
    CAST(sum(n) OVER (PARTITION BY {g} ORDER BY score_decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS BIGINT) AS cum_n_low_to_high,
    CAST(sum(bads) OVER (PARTITION BY {g} ORDER BY score_decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS BIGINT) AS cum_bads_low_to_high,
    CAST(count(*) OVER (PARTITION BY {g}) AS INTEGER) AS actual_deciles, {k} AS requested_deciles
  FROM qd
),
qfull AS (SELECT *, cum_bads_low_to_high / cum_n_low_to_high AS cum_bad_rate_low_to_high FROM qdec)"""


QDOUBLES = ["score_mean", "score_median", "bad_rate", "lift_vs_overall", "pct_population",
            "cum_bad_rate_low_to_high"]
COH = cohort_ctes()
_LINES = """WITH priced AS (SELECT l_linestatus, l_extendedprice AS price, CAST(l_returnflag = 'R' AS INTEGER) AS bad FROM lineitem)"""
register("real_score_deciles", _LINES + "," + deciles_sql("priced", ["l_linestatus"], score="price") + "\nSELECT * FROM deciles_full",
         DECILE_DOUBLES + ["score_min", "score_max"])
register("real_score_quantiles", _LINES + "," + quantile_sql("priced", ["l_linestatus"], score="price") + "\nSELECT * FROM qfull",
         QDOUBLES + ["score_min", "score_max"])
register("quantile_deciles", COH + "," + quantile_sql("pairs", ["read_key"]) + "\nSELECT * FROM qfull", QDOUBLES)



def summary_sql(src: str, pairs: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"t.{c} = e.{c}" for c in groups)
    return f""",
t AS (SELECT {g}, count(*) AS total_scored_rows FROM {src} GROUP BY {g}),
e AS (SELECT {g}, count(*) AS eligible_rows, CAST(sum(bad) AS BIGINT) AS bads, min(bhvr_score) AS score_min,
             max(bhvr_score) AS score_max, avg(bhvr_score) AS score_mean FROM {pairs} GROUP BY {g})
SELECT {", ".join("t." + c for c in groups)}, t.total_scored_rows, coalesce(e.eligible_rows, 0) AS eligible_rows,
       coalesce(e.bads, 0) AS bads, e.score_min, e.score_max, e.score_mean,
       CASE WHEN coalesce(e.eligible_rows, 0) = 0 THEN NULL ELSE coalesce(e.bads, 0) / e.eligible_rows END AS rate
FROM t LEFT JOIN e ON {on}"""


def segments_sql(pairs: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    return "\nUNION ALL\n".join(f"""
SELECT {g}, '{c}' AS segment, {c} AS value, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bads,
       avg(bhvr_score) AS score_mean, CAST(sum(bad) AS BIGINT) / count(*) AS bad_rate
FROM {pairs} GROUP BY {g}, {c}""" for c in ("program_code", "channel"))


def rank_diag_sql(groups: list[str]) -> str:
    g = ", ".join(groups)
    return f""",
rk AS (
  SELECT {g}, score_decile, bad_rate,
    rank() OVER (PARTITION BY {g} ORDER BY score_decile)
      + (count(*) OVER (PARTITION BY {g}, score_decile) - 1) / 2.0 AS r1,
    rank() OVER (PARTITION BY {g} ORDER BY bad_rate)
      + (count(*) OVER (PARTITION BY {g}, bad_rate) - 1) / 2.0 AS r2,
    CASE WHEN bad_rate > lag(bad_rate) OVER (PARTITION BY {g} ORDER BY score_decile) THEN 1 ELSE 0 END AS up
  FROM qfull
),
g AS (SELECT {g}, CASE WHEN stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN covar_pop(r1, r2) / (stddev_pop(r1) * stddev_pop(r2)) END AS sp,
             CAST(sum(up) AS INTEGER) AS v, count(*) AS n FROM rk GROUP BY {g})
SELECT {g}, CASE WHEN n >= 2 THEN sp END AS spearman_decile_bad_rate,
       CASE WHEN n >= 2 THEN v END AS monotonic_violations,
       CASE WHEN n < 2 THEN 'Not enough deciles' WHEN v = 0 AND sp < 0 THEN 'Pass'
            ELSE 'Review rank-order bumps' END AS note
FROM g"""


register("overall_summary", COH + summary_sql("cohort", "pairs", ["read_key"]), ["score_mean", "rate"])
register("segment_tables", COH + segments_sql("pairs", ["read_key"]), ["score_mean", "bad_rate"])
register("rank_diagnostics", COH + "," + quantile_sql("pairs", ["read_key"]) + rank_diag_sql(["read_key"]), ["spearman_decile_bad_rate"])

DEC = COH + "," + deciles_sql("pairs", ["read_key"])
LIFT_LABEL = """CASE WHEN {x} IS NULL THEN 'insufficient' WHEN {x} >= 2.0 THEN 'clean rank-order'
       WHEN {x} >= 1.5 THEN 'weak rank-order' ELSE 'not separating' END"""


def lift_sql(src: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    return f"""
lf0 AS (
  SELECT {g}, arg_min(bad_rate, decile) AS d1_bad_rate, arg_max(bad_rate, decile) AS d10_bad_rate,
         count(*) AS deciles_present
  FROM {src} GROUP BY {g}
),
lf AS (
  SELECT *, CASE WHEN d10_bad_rate IS NULL OR d10_bad_rate = 0 OR d1_bad_rate IS NULL THEN NULL
                 ELSE d1_bad_rate / d10_bad_rate END AS d1_d10_lift
  FROM lf0
),
lift AS (SELECT *, {LIFT_LABEL.format(x='d1_d10_lift')} AS lift_label FROM lf)"""


def rev_sql(src: str, groups: list[str], eps: str = "0.0") -> str:
    g = ", ".join(groups)
    return f"""
rv0 AS (
  SELECT {g}, CASE WHEN bad_rate > lag(bad_rate) OVER (PARTITION BY {g} ORDER BY decile) + {eps} THEN 1 ELSE 0 END
         AS up FROM {src}
),
rev AS (SELECT {g}, CAST(coalesce(sum(up), 0) AS INTEGER) AS reversals FROM rv0 GROUP BY {g})"""


def stats_sql(src: str, groups: list[str], with_line: bool = True) -> str:
    g = ", ".join(groups)
    line = ", avg(creditline) AS avg_creditline" if with_line else ""
    return f"""
st AS (
  SELECT {g}, count(*) AS eligible, CAST(sum(bad) AS BIGINT) AS bads, avg(bhvr_score) AS avg_score{line},
         CAST(sum(bad) AS BIGINT) / count(*) AS edr
  FROM {src} GROUP BY {g}
)"""


LIFT_DOUBLES = ["d1_bad_rate", "d10_bad_rate", "d1_d10_lift"]
register("d1_d10_lift", DEC + "," + lift_sql("deciles_full", ["read_key"]) + "\nSELECT * FROM lift", LIFT_DOUBLES)
register("reversals", DEC + "," + rev_sql("deciles_full", ["read_key"]) + "\nSELECT * FROM rev")
register("kpi_strip", DEC + "," + lift_sql("deciles_full", ["read_key"]) + "," + stats_sql("pairs", ["read_key"]) + """
SELECT st.*, lift.d1_d10_lift, lift.lift_label FROM st LEFT JOIN lift ON st.read_key = lift.read_key""",
         ["avg_score", "avg_creditline", "edr", "d1_d10_lift"])

def rc_sql(cohort: str) -> str:
    return (cohort + "," + deciles_sql("pairs", ["read_key"]) + "," + lift_sql("deciles_full", ["read_key"]) + ","
            + rev_sql("deciles_full", ["read_key"], "1e-9") + "," + stats_sql("pairs", ["read_key"], False) + """,
rc AS (
  SELECT st.read_key, st.eligible, st.bads, st.edr, lift.d1_bad_rate, lift.d10_bad_rate, lift.d1_d10_lift,
         lift.lift_label, rev.reversals
  FROM st LEFT JOIN lift ON st.read_key = lift.read_key LEFT JOIN rev ON st.read_key = rev.read_key
)""")


VERDICT = """
SELECT max(CASE WHEN eligible < 200 THEN 1 ELSE 0 END) AS any_thin,
       max(CASE WHEN eligible >= 200 AND lift_label = 'clean rank-order' THEN 1 ELSE 0 END) AS any_clean,
       max(CASE WHEN eligible >= 200 AND lift_label = 'not separating' THEN 1 ELSE 0 END) AS any_bad,
       count(*) AS reads,
       CASE WHEN max(CASE WHEN eligible >= 200 AND lift_label = 'not separating' THEN 1 ELSE 0 END) = 1 THEN 'bad'
            WHEN max(CASE WHEN eligible >= 200 AND lift_label = 'clean rank-order' THEN 1 ELSE 0 END) = 0
              OR max(CASE WHEN eligible < 200 THEN 1 ELSE 0 END) = 1 THEN 'warn' ELSE 'good' END AS verdict
FROM rc"""
WIDE = replace(CFG, program_codes=("AUTO", "BUIL", "FURN", "HOUS", "MACH"), creditline_tier=None)
register("read_comparison", rc_sql(COH) + "\nSELECT * FROM rc", ["edr"] + LIFT_DOUBLES)
register("verdict", rc_sql(COH) + VERDICT)
register("verdict_wide", rc_sql(cohort_ctes(WIDE)) + VERDICT)

register("gains_curve", DEC + """
SELECT read_key, decile AS point, cum_n / sum(n) OVER (PARTITION BY read_key) AS cum_pop_share, cum_bad_share
FROM deciles_full
UNION ALL
SELECT DISTINCT read_key, 0, 0.0, 0.0 FROM deciles_full""", ["cum_pop_share", "cum_bad_share"])


register("month_stats", COH + "," + deciles_sql("pairs", ["read_key", "vintage"]) + ","
         + lift_sql("deciles_full", ["read_key", "vintage"]) + """
SELECT p.read_key, p.vintage, count(*) AS n, CAST(sum(p.bad) AS BIGINT) AS bads, avg(p.bhvr_score) AS avg_score,
       CAST(sum(p.bad) AS BIGINT) / count(*) AS bad_rate, any_value(l.d1_d10_lift) AS d1_d10_lift
FROM pairs p LEFT JOIN lift l ON p.read_key = l.read_key AND p.vintage = l.vintage
GROUP BY p.read_key, p.vintage""", ["avg_score", "bad_rate", "d1_d10_lift"])

SNAPPAIRS = (PORT + "," + BENCH_CTES + f""",
spairs AS (
  SELECT 'subject' AS population, read_key, creditaccountid, bhvr_score, metric_eligible, target, creditline,
         CAST(coalesce(target, 0) AS INTEGER) AS bad FROM port
  UNION ALL
  SELECT benchmark_group, read_key, creditaccountid, bhvr_score, metric_eligible, target, creditline,
         CAST(coalesce(target, 0) AS INTEGER) FROM bench
  WHERE metric_eligible = 1 AND bhvr_score {VALID}
)""")
register("benchmark_summary", SNAPPAIRS + "," + deciles_sql("spairs", ["population", "read_key"]) + ","
         + lift_sql("deciles_full", ["population", "read_key"]) + "," + stats_sql("spairs", ["population", "read_key"]) + """
SELECT st.*, lift.d1_d10_lift, lift.lift_label FROM st LEFT JOIN lift
  ON st.population = lift.population AND st.read_key = lift.read_key""",
         ["avg_score", "avg_creditline", "edr", "d1_d10_lift"])

register("lift_comparison", SNAPPAIRS + "," + deciles_sql("spairs", ["population", "read_key"]) + ","
         + lift_sql("deciles_full", ["population", "read_key"]) + """
SELECT d.population, d.read_key, CAST(sum(d.n) AS BIGINT) AS eligible, sum(d.bads) / sum(d.n) AS edr,
       arg_min(d.lift_vs_overall, d.decile) AS d1_lift, arg_max(d.lift_vs_overall, d.decile) AS d10_lift,
       any_value(l.d1_d10_lift) AS d1_d10_lift, any_value(l.lift_label) AS lift_label
FROM deciles_full d JOIN lift l ON d.population = l.population AND d.read_key = l.read_key
GROUP BY d.population, d.read_key""", ["edr", "d1_lift", "d10_lift", "d1_d10_lift"])

register("lift_table", SNAPPAIRS + "," + deciles_sql("spairs", ["population", "read_key"]) + """
SELECT population, read_key, decile, n, bad_rate,
       sum(bads) OVER (PARTITION BY population, read_key) / sum(n) OVER (PARTITION BY population, read_key) AS edr,
       lift_vs_overall
FROM deciles_full""", ["bad_rate", "edr", "lift_vs_overall"])

# the requested read does not exist: the first read with subject rows is shown
register("benchmark_overlay", SNAPPAIRS + "," + deciles_sql("spairs", ["population", "read_key"]) + """,
chosen AS (SELECT read_key FROM spairs WHERE population = 'subject'
           ORDER BY CASE read_key """ + " ".join(f"WHEN '{r.key}' THEN {i}" for i, r in enumerate(CFG.reads)) + """ END LIMIT 1)
SELECT population, read_key, decile, score_min, score_max, n, bads, bad_rate, cum_bad_rate, lift_vs_overall
FROM deciles_full WHERE read_key IN (SELECT read_key FROM chosen)""", ["bad_rate", "cum_bad_rate", "lift_vs_overall"])

register("tie_aware_deciles_months", COH + """,
few AS (SELECT p.* FROM pairs p, win WHERE p.vintage < win.first_board_month + INTERVAL 3 MONTH),"""
         + deciles_sql("few", ["read_key"]) + "\nSELECT * FROM deciles_full", DECILE_DOUBLES)

BPAIRS = BENCH + f""",
bpairs AS (SELECT *, CAST(coalesce(target, 0) AS INTEGER) AS bad FROM bench
           WHERE metric_eligible = 1 AND bhvr_score {VALID})"""
BYGROUP = ["benchmark_group", "read_key"]
register("grouped_rank_order", BPAIRS + "," + quantile_sql("bpairs", BYGROUP) + "\nSELECT * FROM qfull", QDOUBLES)
register("grouped_summary", BPAIRS + summary_sql("bench", "bpairs", BYGROUP), ["score_mean", "rate"])
register("grouped_segments", BPAIRS + segments_sql("bpairs", BYGROUP), ["score_mean", "bad_rate"])
register("grouped_diagnostics", BPAIRS + "," + quantile_sql("bpairs", BYGROUP) + rank_diag_sql(BYGROUP), ["spearman_decile_bad_rate"])

# ----------------------------------------------------------------------------
# study: activation
# ----------------------------------------------------------------------------

ACT_CTES = f"""
act_b_raw AS (
  SELECT a.creditaccountid, date_trunc('month', a.opendate)::DATE AS board_month,
         row_number() OVER (PARTITION BY a.creditaccountid ORDER BY a.reportingdate, {CARD_ORDER}) AS rn
  FROM fact a, win
  WHERE a.reportingdate >= win.start_eom AND a.reportingdate <= win.end_eom AND a.cardid IS NOT NULL
    AND a.newaccountindicator = 1 AND substr(a.reservationnumber, 1, 4) IN ({_codes()})
    AND a.creditline = {CFG.creditline_tier}
),
act_b AS (SELECT creditaccountid, board_month FROM act_b_raw WHERE rn = 1),
act_f AS (
  SELECT b.creditaccountid, min(CASE WHEN p.activeaccountindicator = 1 THEN p.reportingdate END) AS first_active_date
  FROM act_b b CROSS JOIN win JOIN fact p ON b.creditaccountid = p.creditaccountid AND p.cardid IS NOT NULL
   AND p.reportingdate <= win.end_eom
  GROUP BY b.creditaccountid
),
act AS (
  SELECT b.creditaccountid, b.board_month, f.first_active_date,
    CAST(CASE WHEN f.first_active_date IS NULL THEN -1
         ELSE greatest(0, year(f.first_active_date) * 12 + month(f.first_active_date)
                          - year(b.board_month) * 12 - month(b.board_month)) END AS INTEGER) AS act_lag,
    CAST(year(win.latest_data_month) * 12 + month(win.latest_data_month)
         - year(b.board_month) * 12 - month(b.board_month) AS INTEGER) AS obs_months
  FROM act_b b CROSS JOIN win LEFT JOIN act_f f ON b.creditaccountid = f.creditaccountid
  WHERE b.creditaccountid NOT IN (SELECT creditaccountid FROM excl)
)"""
ACT = BASE + "," + ACT_CTES
register("activation_base", ACT + "\nSELECT * FROM act")
register("activation_state", ACT + "\nSELECT board_month, obs_months, act_lag, count(*) AS accounts FROM act GROUP BY ALL")
register("activation_by_month", ACT + """
SELECT board_month, count(*) AS boarded, CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS activated,
       CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS pct_activated
FROM act GROUP BY board_month""", ["pct_activated"])
register("activation_curve", ACT + """,
tt AS (SELECT act_lag, CAST(unnest(generate_series(0, least(obs_months, 12))) AS INTEGER) AS t
       FROM act WHERE obs_months IS NOT NULL AND obs_months >= 0)
SELECT t, count(*) AS denom, CAST(sum(CASE WHEN act_lag >= 0 AND act_lag <= t THEN 1 ELSE 0 END) AS BIGINT) AS numer,
       CAST(sum(CASE WHEN act_lag >= 0 AND act_lag <= t THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate
FROM tt GROUP BY t""", ["rate"])
register("activation_histogram", ACT + """,
bins AS (SELECT CAST(unnest(generate_series(0, least(max(act_lag), 12))) AS INTEGER) AS lag FROM act WHERE act_lag >= 0),
c AS (SELECT CAST(least(act_lag, 12) AS INTEGER) AS lag, count(*) AS n FROM act WHERE act_lag >= 0 GROUP BY 1)
SELECT bins.lag, coalesce(c.n, 0) AS n FROM bins LEFT JOIN c ON bins.lag = c.lag""")
register("activation_table", ACT + """
SELECT board_month, count(*) AS boarded, CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS activated,
  CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS pct_ever,
  sum(CASE WHEN obs_months >= 1 AND act_lag >= 0 AND act_lag <= 1 THEN 1 ELSE 0 END)
    / nullif(sum(CASE WHEN obs_months >= 1 THEN 1 ELSE 0 END), 0) AS pct_by_1,
  sum(CASE WHEN obs_months >= 3 AND act_lag >= 0 AND act_lag <= 3 THEN 1 ELSE 0 END)
    / nullif(sum(CASE WHEN obs_months >= 3 THEN 1 ELSE 0 END), 0) AS pct_by_3,
  sum(CASE WHEN obs_months >= 6 AND act_lag >= 0 AND act_lag <= 6 THEN 1 ELSE 0 END)
    / nullif(sum(CASE WHEN obs_months >= 6 THEN 1 ELSE 0 END), 0) AS pct_by_6,
  median(CASE WHEN act_lag >= 0 THEN act_lag END) AS median_lag
FROM act GROUP BY board_month""", ["pct_ever", "pct_by_1", "pct_by_3", "pct_by_6", "median_lag"])

BANDS_SQL = """
bands AS (SELECT * FROM (VALUES (0, '<400'), (1, '400-499'), (2, '500-599'), (3, '600-699'), (4, '700-799'),
                                (5, '800-900')) v(band_order, score_band))"""
register("activation_by_score", COH + "," + ACT_CTES + "," + BANDS_SQL + f""",
sc AS (SELECT creditaccountid, max(bhvr_score) AS bhvr_score FROM cohort WHERE read_key = '{CFG.reads[0].key}'
       GROUP BY creditaccountid),
ab AS (
  SELECT a.*, CASE WHEN coalesce(CAST(s.bhvr_score AS DOUBLE), -1) >= 400 AND coalesce(CAST(s.bhvr_score AS DOUBLE), -1) <= 499.99 THEN '400-499'
    WHEN coalesce(CAST(s.bhvr_score AS DOUBLE), -1) >= 500 AND coalesce(CAST(s.bhvr_score AS DOUBLE), -1) <= 599.99 THEN '500-599'
    WHEN coalesce(CAST(s.bhvr_score AS DOUBLE), -1) >= 600 AND coalesce(CAST(s.bhvr_score AS DOUBLE), -1) <= 699.99 THEN '600-699'
    WHEN coalesce(CAST(s.bhvr_score AS DOUBLE), -1) >= 700 AND coalesce(CAST(s.bhvr_score AS DOUBLE), -1) <= 799.99 THEN '700-799'
    WHEN coalesce(CAST(s.bhvr_score AS DOUBLE), -1) >= 800 AND coalesce(CAST(s.bhvr_score AS DOUBLE), -1) <= 900 THEN '800-900'
    ELSE '<400' END AS score_band
  FROM act a LEFT JOIN sc s ON a.creditaccountid = s.creditaccountid
),
g AS (SELECT score_band, count(*) AS boarded, CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS activated,
             median(CASE WHEN act_lag >= 0 THEN act_lag END) AS median_lag FROM ab GROUP BY score_band)
SELECT b.band_order, b.score_band, coalesce(g.boarded, 0) AS boarded, coalesce(g.activated, 0) AS activated,
       CASE WHEN coalesce(g.boarded, 0) = 0 THEN NULL ELSE g.activated / g.boarded END AS pct_activated, g.median_lag
FROM bands b LEFT JOIN g ON b.score_band = g.score_band""", ["pct_activated", "median_lag"])


# ----------------------------------------------------------------------------
# study: payload and exports
# ----------------------------------------------------------------------------


def _frame_sql(src: str, board_col: str, dataset: str, prism: str, population: str, keys: str = "") -> str:
    r0 = CFG.reads[0].key
    flags = ", ".join(
        f"CAST(coalesce(max(CASE WHEN read_key = '{r.key}' THEN coalesce(metric_eligible, 0) END), 0) AS INTEGER) AS e_{r.key}, "
        f"CAST(coalesce(max(CASE WHEN read_key = '{r.key}' THEN coalesce(target, 0) END), 0) AS INTEGER) AS b_{r.key}"
        for r in CFG.reads)
    k = f"{keys}, " if keys else ""
    return f"""
  SELECT {dataset} AS dataset_id, '{prism}' AS prism, {population} AS population, b.creditaccountid,
         b.board_month, b.score, b.cl, coalesce(b.program, '') AS program, coalesce(b.channel, '') AS channel,
         {', '.join(f'f.e_{r.key}, f.b_{r.key}' for r in CFG.reads)}
  FROM (SELECT {k}creditaccountid, min(strftime({board_col}, '%Y-%m')) AS board_month,
               min(program_code) AS program, min(channel) AS channel, min(creditline) AS cl,
               CAST(min(bhvr_score) AS INTEGER) AS score
        FROM {src} WHERE read_key = '{r0}' AND bhvr_score {VALID} GROUP BY ALL) b
  LEFT JOIN (SELECT {k}creditaccountid, {flags} FROM {src} GROUP BY ALL) f
    ON b.creditaccountid = f.creditaccountid {"AND b." + keys + " = f." + keys if keys else ""}"""


PAYLOAD = (COH + "," + TIER + "," + snap_cte() + "," + fperf_ctes("snap", "fp") + ","
           + long_union("snap", "fp", "snap_long") + f""",
port AS (
  SELECT * RENAME (has_horizon AS has_horizon_snapshot) FROM snap_long
  WHERE creditaccountid NOT IN (SELECT creditaccountid FROM excl)
    AND creditaccountid IN (SELECT creditaccountid FROM tier)
    AND bhvr_score {VALID} AND metric_eligible = 1
),""" + BENCH_CTES + ",\npayload AS ("
           + _frame_sql("cohort", "vintage", "'cohort-subject'", "Cohort", "'subject'") + "\nUNION ALL\n"
           + _frame_sql("port", "board_month", "'port-subject'", "Total Portfolio", "'subject'") + "\nUNION ALL\n"
           + _frame_sql("bench", "board_month", "'port-' || b.benchmark_group", "Total Portfolio",
                        "b.benchmark_group", "benchmark_group") + "\n)")
register("account_payload", PAYLOAD + "\nSELECT * FROM payload", ["cl"])

_plong = " UNION ALL ".join(
    f"SELECT dataset_id, '{r.key}' AS read_key, score, b_{r.key} AS bad FROM payload WHERE e_{r.key} = 1"
    for r in CFG.reads)
register("decile_export", PAYLOAD + f""",
plong AS ({_plong}),""" + deciles_sql("plong", ["dataset_id", "read_key"], score="score") + "\nSELECT * FROM deciles_full",
         DECILE_DOUBLES)

register("dataset_diagnostics", PAYLOAD + "," + ACT_CTES + f""",
expected AS (SELECT * FROM (VALUES ('cohort-subject', 'Cohort / subject'), ('port-subject', 'Total Portfolio / subject'),
  ('port-Group 1 - Credit Line >= $5,000', 'Total Portfolio / Group 1 - Credit Line >= $5,000'),
  ('port-Group 2 - $5,000 > Credit Line >= $3,000', 'Total Portfolio / Group 2 - $5,000 > Credit Line >= $3,000'),
  ('port-Group 3 - Credit Line < $3,000', 'Total Portfolio / Group 3 - Credit Line < $3,000'),
  ('port-Group Unknown Credit Line', 'Total Portfolio / Group Unknown Credit Line')) v(dataset_id, source)),
c AS (SELECT dataset_id, count(*) AS rows, count(DISTINCT board_month) AS months FROM payload GROUP BY dataset_id),
sc AS (SELECT DISTINCT creditaccountid FROM cohort WHERE read_key = '{CFG.reads[0].key}'),
t AS (SELECT count(*) AS rows, count(sc.creditaccountid) AS scored FROM act LEFT JOIN sc ON act.creditaccountid = sc.creditaccountid)
SELECT e.dataset_id, e.source, coalesce(c.rows, 0) AS rows, CASE WHEN coalesce(c.rows, 0) > 0 THEN 'included' ELSE 'empty' END AS status,
  CASE WHEN coalesce(c.rows, 0) > 0 THEN format('{{:,}}', c.rows) || ' valid-scored accounts across ' || CAST(c.months AS VARCHAR) || ' board month(s)'
       ELSE 'No accounts available for this slice.' END AS message
FROM expected e LEFT JOIN c ON e.dataset_id = c.dataset_id
UNION ALL
SELECT 'activation', 'Active card tracker', rows, CASE WHEN rows > 0 THEN 'included' ELSE 'empty' END,
  CASE WHEN rows > 0 THEN format('{{:,}}', rows) || ' boarded accounts (' || format('{{:,}}', scored) || ' with a cohort score)' ELSE 'No boarded accounts.' END
FROM t""")
register("columnar_payload", PAYLOAD + "\nSELECT * FROM payload", ["cl"])
register("payload_metadata", PAYLOAD + f"""
SELECT dataset_id, prism, population, count(*) AS n, CAST(ceil(count(*) / 64) AS BIGINT) AS chunks, CAST(ceil(count(*) / 64) AS BIGINT) AS chunk_rows,
  CAST(least(count(*), 64) AS INTEGER) AS largest_chunk, '{','.join(r.key for r in CFG.reads)}' AS reads,
  string_agg(DISTINCT board_month, ',' ORDER BY board_month) AS months, string_agg(DISTINCT program, ',' ORDER BY program) AS programs,
  string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
FROM payload GROUP BY dataset_id, prism, population""")
register("activation_export", ACT + """
SELECT board_month, count(*) AS boarded, CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS activated,
       CAST(sum(CASE WHEN act_lag >= 0 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS pct_activated
FROM act GROUP BY board_month""", ["pct_activated"])
register("restrict_accounts", cohort_ctes() + f"""
SELECT * FROM cohort WHERE creditaccountid IN (
  SELECT creditaccountid FROM fact WHERE cardid IS NOT NULL AND newaccountindicator = 1 AND substr(reservationnumber, 1, 4) IN ({_codes()})
    AND creditline = {CFG.creditline_tier})""", COHORT_DOUBLES)

register("enrich_in_place", QUERIES["dim_enrich"])
register("exclude_accounts", BASE + "\nSELECT * FROM fact WHERE creditaccountid NOT IN (SELECT creditaccountid FROM excl)")
register("restrict_fact", BASE + "," + TIER + "\nSELECT * FROM fact WHERE creditaccountid IN (SELECT creditaccountid FROM tier)")
register("board_rows", BASE + "," + boards_cte() + f"""
SELECT b.vintage, f.monthsonbooks, count(*) AS rows,
  CAST(sum(CASE WHEN f.bhvr_score BETWEEN {CFG.valid_min} AND {CFG.valid_max} THEN 1 ELSE 0 END) AS BIGINT) AS valid_scores,
  max(f.dimbucketid) AS max_bucket, CAST(sum(CASE WHEN f.chargeoffindicator = 1 THEN 1 ELSE 0 END) AS BIGINT) AS chargeoffs
FROM boards b JOIN fact f ON b.creditaccountid = f.creditaccountid
WHERE f.cardid IS NOT NULL AND f.monthsonbooks BETWEEN 1 AND {SCORE_AVAILABILITY_MAX_MOB}
  AND (f.activeaccountindicator = 1 OR f.chargeoffindicator = 1)
GROUP BY 1, 2""")


# ----------------------------------------------------------------------------
# campaign pipeline (adapter C in SQL)
# ----------------------------------------------------------------------------
from vintagekit import config as _C  # noqa: E402


def _lst(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _score_text(expr: str) -> str:
    return f"'0.' || lpad(CAST(({expr}) * 5 AS VARCHAR), 5, '0')"


MAIL = f"""WITH
mraw AS (
  SELECT 'P' || lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 3, '0')
           AS CAMPAIGN_CODE,
    CAST(o.o_orderdate AS DATE) AS CAMPAIGN_DATE,
    substr('VABCN', CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER), 1) AS CAMPFLAG1,
    CAST(NULL AS VARCHAR) AS CAMPFLAG2,
    CAST(o.o_custkey AS VARCHAR) AS ENCRYPTED_PIN,
    lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS RESERVATION_SEQUENCE,
    'P' || lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 3, '0')
      AS OFFER_CODE_FIRST_7,
    '000' AS OFFER_CODE_LAST_3,
    CASE WHEN o.o_orderstatus = 'O' THEN 'Prospecting' ELSE 'Retargeting' END AS prospect_type,
    CASE WHEN o.o_custkey % 20 = 0 THEN NULL
         ELSE CAST(CAST(500 + floor((c.c_acctbal + 1000) * CAST(0.03 AS DOUBLE)) AS BIGINT) AS VARCHAR) END
      AS SCORE_VANTAGE_VALUE_V3,
    {_score_text('o.o_orderkey * 31 % 1000')} AS TRM10_Score,
    CAST(1 + o.o_orderkey % 10 AS INTEGER) AS TRM10_TIER,
    CAST(o.o_custkey % 13 AS INTEGER) AS TIMES_MAILED_12MO_CNT,
    CASE WHEN year(o.o_orderdate) = 1995 THEN NULL ELSE {_score_text('o.o_orderkey * 17 % 1000')} END
      AS EXP_RESPONSE_SCORE,
    CASE WHEN o.o_orderkey % 101 = 0 THEN 'S' ELSE NULL END AS endmark,
    CAST(o.o_orderkey % 7 AS VARCHAR) AS TM12_3BR
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus <> 'F'
),
mail AS (
  SELECT *, date_trunc('month', CAMPAIGN_DATE)::DATE AS campaign_month,
    TRY_CAST(SCORE_VANTAGE_VALUE_V3 AS DOUBLE) AS vantage3,
    TRY_CAST(TRM10_Score AS DOUBLE) AS TRM_Score,
    TRY_CAST(EXP_RESPONSE_SCORE AS DOUBLE) AS EXP_RESPONSE_SCORE_num,
    coalesce(OFFER_CODE_FIRST_7, '') || coalesce(RESERVATION_SEQUENCE, '') AS ReservationNumber,
    TRY_CAST(TM12_3BR AS DOUBLE) AS TM12_3RR,
    CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.NEW_MAIL_FLAGS)}) THEN 0
              WHEN CAMPFLAG1 IN ({_lst(_C.REMAIL_FLAGS)}) THEN 1 END AS INTEGER) AS rm_flag
  FROM mraw
  WHERE CAMPFLAG1 IN ({_lst(_C.MAIL_CAMPFLAGS)}) AND coalesce(endmark, '') NOT LIKE '%S%'
),
arows AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, c.c_nationkey,
         concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS APPLICATION_ID
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
app AS (SELECT APPLICATION_ID, l_shipdate AS APPLICATION_RECEIVE_DATE, l_shipdate AS READY_TO_BOARD_DATE,
               CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS BOARDDATE FROM arows),
applicant AS (SELECT APPLICATION_ID, CAST(DATE '1950-01-01' + CAST(o_custkey % 15000 AS INTEGER) AS DATE) AS DOB
              FROM arows),
status AS (
  SELECT APPLICATION_ID,
    'P' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(month(o_orderdate) AS VARCHAR), 3, '0')
      || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS RESERVATION_NUMBER,
    CASE WHEN l_returnflag = 'N' THEN 'Declined: Expired Offer' WHEN l_returnflag = 'R'
         THEN 'Failed IP Fraud Score Check' ELSE 'Approved' END AS STATUS_DESC,
    l_returnflag AS STATUS_NAME
  FROM arows
),
codes AS (SELECT DISTINCT campaign_month, substr(OFFER_CODE_FIRST_7, 1, 7) AS CampaignCode FROM mail),
chain AS (
  SELECT a.APPLICATION_ID, b.DOB, c.RESERVATION_NUMBER, substr(c.RESERVATION_NUMBER, 1, 7) AS CampaignCode,
    CAST(a.APPLICATION_RECEIVE_DATE AS DATE) AS AppRcvDate, CAST(a.READY_TO_BOARD_DATE AS DATE) AS RTBDate,
    CAST(a.BOARDDATE AS DATE) AS BoardDate, c.STATUS_DESC, c.STATUS_NAME
  FROM app a LEFT JOIN applicant b ON a.APPLICATION_ID = b.APPLICATION_ID
  LEFT JOIN status c ON a.APPLICATION_ID = c.APPLICATION_ID
),
apps AS (
  SELECT k.campaign_month, ch.*,
    CASE WHEN ch.STATUS_DESC IN ({_lst(_C.FRAUD_DECLINE_STATUSES)}) THEN 1 ELSE 0 END AS FraudDecline_dm,
    CASE WHEN ch.STATUS_DESC IS DISTINCT FROM '{_C.EXPIRED_OFFER_STATUS}' THEN 1 ELSE 0 END AS GrossResponse_dm,
    CASE WHEN ch.BoardDate > k.campaign_month THEN 1 ELSE 0 END AS NetResponse_dm
  FROM chain ch JOIN codes k ON ch.CampaignCode = k.CampaignCode
  WHERE ch.AppRcvDate >= (k.campaign_month - INTERVAL 1 MONTH)
    AND ch.AppRcvDate <= last_day(k.campaign_month + INTERVAL 3 MONTH)
),
fapps AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_month, RESERVATION_NUMBER
                                 ORDER BY AppRcvDate, APPLICATION_ID) AS rn FROM apps) WHERE rn = 1
),
mail1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_month, ReservationNumber
                                 ORDER BY CAMPAIGN_DATE, ENCRYPTED_PIN, RESERVATION_SEQUENCE) AS rn FROM mail)
  WHERE rn = 1
),
fees AS (
  SELECT 'P' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS ProgramCode,
         CAST((n_nationkey % 4) * 25 AS DOUBLE) AS finalcombinedaf
  FROM nation WHERE n_nationkey % 6 <> 5
),
rj AS (
  SELECT m.*, a.AppRcvDate, a.BoardDate, a.FraudDecline_dm AS FraudDecline, a.GrossResponse_dm AS GrossResponse,
         a.NetResponse_dm AS NetResponse, f.finalcombinedaf AS annual_fee
  FROM mail1 m LEFT JOIN fapps a ON m.campaign_month = a.campaign_month AND m.ReservationNumber = a.RESERVATION_NUMBER
  LEFT JOIN fees f ON substr(m.OFFER_CODE_FIRST_7, 1, 4) = f.ProgramCode
)"""


def _cuts(name: str, col: str = "TRM_Score") -> str:
    parts = " ".join(f"WHEN {col} >= CAST({lo} AS DOUBLE) AND {col} <= CAST({hi} AS DOUBLE) THEN {i}"
                     for i, (lo, hi) in enumerate(_C.FIXED_CUTS[name], start=1))
    return f"CAST(CASE {parts} END AS INTEGER)"


_DEC_COLS = ", ".join(f"{_cuts(k)} AS {k if k != 'total' else 'total'}_decile" for k in _C.FIXED_CUTS)
_SCORECARD = f"""CAST(CASE WHEN (vantage3 IS NULL OR vantage3 < {_C.SCORECARD_VANTAGE_CUT}) AND prospect_type = 'Prospecting' THEN 1
  WHEN vantage3 >= {_C.SCORECARD_VANTAGE_CUT} AND prospect_type = 'Prospecting' THEN 2
  WHEN (vantage3 IS NULL OR vantage3 < {_C.SCORECARD_VANTAGE_CUT}) AND prospect_type = 'Retargeting' THEN 3
  WHEN vantage3 >= {_C.SCORECARD_VANTAGE_CUT} AND prospect_type = 'Retargeting' THEN 4 END AS INTEGER)"""
_BAND = "CASE " + " ".join(
    (f"WHEN vantage3 >= {lo} AND vantage3 <= {hi} THEN '{lab}'" if hi is not None else
     f"WHEN vantage3 >= {lo} THEN '{lab}'") for lab, lo, hi in _C.VS_BANDS) + " END"
_FLAGS = f"""CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.PROSPECTING_FLAGS)}) THEN 1 ELSE 0 END AS INTEGER) AS prospectingflag,
  CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.PQ_ABANDON_FLAGS)}) THEN 1 ELSE 0 END AS INTEGER) AS pqabandon_flag,
  CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.CHARGEOFF_FLAGS)}) THEN 1 ELSE 0 END AS INTEGER) AS prchargeoff_flag,
  CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.CLOSURE_FLAGS)}) THEN 1 ELSE 0 END AS INTEGER) AS prclosure_flag,
  CAST(CASE WHEN CAMPFLAG1 IN ({_lst(_C.DECLINE_FLAGS)}) THEN 1 ELSE 0 END AS INTEGER) AS prdecline_flag"""

FINAL = MAIL + f""",
fr AS (SELECT *, {_SCORECARD} AS scorecard, {_BAND} AS vs_band, {_FLAGS}, {_DEC_COLS} FROM rj)"""

MAIL_DOUBLES = ["vantage3", "TRM_Score", "EXP_RESPONSE_SCORE_num", "TM12_3RR"]
register("campaign_windows", MAIL + """
SELECT campaign_month, last_day(campaign_month) AS month_end, (campaign_month - INTERVAL 1 MONTH)::DATE AS min_app_date,
       last_day(campaign_month + INTERVAL 3 MONTH) AS max_app_date, (campaign_month - INTERVAL 2 MONTH)::DATE AS pq_app_date,
       upper(strftime(campaign_month, '%b%y')) AS month_label
FROM (SELECT DISTINCT campaign_month FROM mail)""")
register("mailfile_month", MAIL + "\nSELECT * FROM mail", MAIL_DOUBLES)
register("applications", MAIL + "\nSELECT * FROM apps")
register("first_application", MAIL + "\nSELECT * FROM fapps")
register("response_join", MAIL + "\nSELECT * FROM rj", MAIL_DOUBLES + ["annual_fee"])
register("final_response", FINAL + "\nSELECT * FROM fr", MAIL_DOUBLES + ["annual_fee"])
register("campaign_flags", MAIL + f"""
SELECT CAMPFLAG1, rm_flag, {_FLAGS}, count(*) AS mail_rows FROM mail GROUP BY ALL""")
register("vs_band", MAIL + f"""
SELECT {_BAND} AS vs_band, {_SCORECARD} AS scorecard, count(*) AS mail_rows FROM mail GROUP BY ALL""")
register("fixed_cut_deciles", MAIL + f"""
SELECT campaign_month, ReservationNumber, TRM_Score, {_DEC_COLS} FROM mail""", ["TRM_Score"])

_DIMS = "prospect_type AS Prospect_type, pqabandon_flag, prchargeoff_flag, prclosure_flag, prdecline_flag, vs_band, " \
        "annual_fee, TIMES_MAILED_12MO_CNT AS times_mailed_12mo_cnt, TRM10_TIER AS trm10_tier, scorecard, rm_flag"
ROLLUP = FINAL + f""",
roll AS (
  SELECT campaign_month, {_DIMS}, count(*) AS volume, CAST(sum(GrossResponse) AS BIGINT) AS responders,
         CAST(CAST(sum(CAST(CAST(TRM_Score AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) AS expected_responses,
         CAST(CAST(sum(CAST(CAST(EXP_RESPONSE_SCORE_num AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) AS expected_responses_xpm,
         CAST(sum(NetResponse) AS BIGINT) AS Boards
  FROM fr GROUP BY ALL
),
rollup AS (SELECT *, responders / volume AS GRR, Boards / volume AS NRR FROM roll)"""
ROLL_DOUBLES = ["annual_fee", "expected_responses", "expected_responses_xpm", "GRR", "NRR"]
register("campaign_rollup", ROLLUP + "\nSELECT * FROM rollup", ROLL_DOUBLES)
register("combined_rollup", ROLLUP + """
SELECT strftime(campaign_month, '%Y-%m') AS campaign_month, upper(strftime(campaign_month, '%b%y')) AS month_label,
       * EXCLUDE (campaign_month) FROM rollup""", ROLL_DOUBLES)

from vintagekit.operators.features import ATTRIBUTES as _ATTR_COLS, KEEP_LISTS  # noqa: E402
from vintagekit.sources.testdata import OTHER_ATTRIBUTES  # noqa: E402

_OTHER = ", ".join(f"CAST((px + q * {i + 1} + n * {i * i % 17}) % {40 + 13 * (i % 9)} AS DOUBLE) AS {c}"
                   for i, c in enumerate(OTHER_ATTRIBUTES))


def _exc(mod, code, value):
    return f"CAST(CASE WHEN k % {mod} = 0 THEN {code} ELSE {value} END AS DOUBLE)"


BUREAU = f""",
agg AS (
  SELECT o.o_custkey AS k, count(*) AS n, CAST(sum(l.l_quantity) AS BIGINT) AS q,
         CAST(sum(floor(l.l_extendedprice)) AS BIGINT) AS px,
         sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS nr,
         sum(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS no
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
),
attrs AS (
  SELECT CAST(k AS VARCHAR) AS EPIN, CASE WHEN k % 3 = 0 THEN 'TRM_BUREAU_B' ELSE 'TRM_BUREAU_A' END AS FileName,
    {_exc(23, 995, 'q % 260')} AS ALL7120, {_exc(29, 9995, 'q * 7 % 240')} AS ALL8370,
    CAST(nr % 25 AS DOUBLE) AS ALL2350, {_exc(19, 996, 'no * 37 % 1100')} AS ALL6980,
    {_exc(31, 999999999, 'CASE WHEN k % 11 = 0 THEN n ELSE px % 30000 END')} AS BCC5120,
    {_exc(37, 999999999, 'CASE WHEN k % 13 = 0 THEN n ELSE px % 2500 END')} AS BCC5830,
    {_exc(41, 999999999, 'CASE WHEN k % 17 = 0 THEN n * 9 ELSE px * 3 % 26000 END')} AS BCC5020,
    {_exc(43, 999, 'q % 230')} AS ALL7110, {_exc(47, 998, 'q * 3 % 150')} AS ALL7516,
    CAST(n % 4 AS DOUBLE) AS IQB9416, CAST(n % 7 AS DOUBLE) AS IQT9416, CAST(nr % 3 AS DOUBLE) AS IQT9413,
    CAST(no % 5 AS DOUBLE) AS IQT9415, CAST(n % 9 AS DOUBLE) AS IQT9417, CAST((n + no) % 11 AS DOUBLE) AS IQT9410,
    {_exc(53, 999999999, 'CASE WHEN k % 5 = 0 THEN 0 ELSE px % 7000 END')} AS BCC5421,
    {_exc(59, 9999, 'n % 15')} AS IQT9510, {_exc(61, 98, 'nr % 4')} AS REV3511,
    {_OTHER}
  FROM agg
),
wa AS (
  SELECT f.campaign_month, f.ReservationNumber, f.ENCRYPTED_PIN, f.vantage3, f.TM12_3RR, f.scorecard,
         f.pqabandon_flag, f.prchargeoff_flag, f.prclosure_flag, f.prdecline_flag, f.TRM_Score, f.OFFER_CODE_FIRST_7,
         f.CAMPFLAG1, a.*
  FROM fr f LEFT JOIN (SELECT EPIN, {', '.join(_ATTR_COLS)} FROM attrs WHERE FileName LIKE 'TRM_BUREAU_A%') a
    ON f.ENCRYPTED_PIN = a.EPIN
)"""
ATTR_DOUBLES = ["vantage3", "TM12_3RR", "TRM_Score"] + list(_ATTR_COLS)
register("append_attributes", FINAL + BUREAU + "\nSELECT * FROM wa", ATTR_DOUBLES)


def _rz(x: str, u) -> str:
    return f"(round(({x}) / CAST({u} AS DOUBLE)) * CAST({u} AS DOUBLE))"


_B5120 = """CASE WHEN {x} > 999999990 THEN 25000.0 WHEN {x} IS NULL OR {x} <= 10 THEN 9.0
  WHEN {x} <= 100 THEN {r10} WHEN {x} <= 1000 THEN {r100} WHEN {x} <= 10000 THEN {r500}
  ELSE {r1000} END"""


def _bal(x):
    return "CAST(" + _B5120.format(x=x, r10=_rz(x, 10), r100=_rz(x, 100), r500=_rz(x, 500),
                                   r1000=_rz(f"least({x}, 20000.0)", 1000)) + " AS DOUBLE)"


ENG = f""",
e0 AS (
  SELECT *,
    CAST(CASE WHEN ALL7120 > 990 THEN 230.0 ELSE least(ALL7120, 200.0) END AS DOUBLE) AS ALL7120tr,
    CAST(CASE WHEN ALL8370 > 9990 THEN 230.0 ELSE least(ALL8370, 200.0) END AS DOUBLE) AS ALL8370tr,
    CAST(least(ALL2350 + 10, 28.0) AS DOUBLE) AS ALL2350tr,
    CAST(CASE WHEN ALL6980 > 990 THEN 15.0 ELSE least(ALL6980 + 10, 1000.0) END AS DOUBLE) AS ALL6980tr,
    {_bal('BCC5120')} AS BCC5120tr,
    CAST(CASE WHEN BCC5830 > 999999990 THEN 2500.0 WHEN BCC5830 IS NULL OR BCC5830 <= 10 THEN 9.0
         WHEN BCC5830 <= 100 THEN {_rz('BCC5830', 10)} ELSE {_rz('least(BCC5830, 2000.0)', 100)} END AS DOUBLE)
      AS BCC5830tr,
    {_bal('BCC5020')} AS BCC5020tr,
    CAST(CASE WHEN ALL7110 > 990 THEN 240.0 ELSE least(ALL7110 + 10, 210.0) END AS DOUBLE) AS ALL7110tr,
    CAST(CASE WHEN ALL7516 > 990 THEN 140.0 ELSE least(ALL7516 + 10, 130.0) END AS DOUBLE) AS ALL7516tr
  FROM wa
),
e1 AS (SELECT *, CAST(least(ALL2350tr * ALL6980tr, 10000.0) AS DOUBLE) AS Full_delinq_min FROM e0),
eng AS (
  SELECT * EXCLUDE (ALL7120tr, ALL8370tr, ALL2350tr, ALL6980tr, Full_delinq_min, BCC5120tr, BCC5830tr, BCC5020tr,
                    ALL7110tr, ALL7516tr),
    ALL7120tr, ALL8370tr, ALL7120tr * ALL8370tr / 100 AS Effetive_max_util, ALL2350tr, ALL6980tr, Full_delinq_min,
    CASE WHEN Full_delinq_min <= 500 THEN {_rz('Full_delinq_min', 50)}
         WHEN Full_delinq_min <= 1000 THEN {_rz('Full_delinq_min', 100)}
         ELSE {_rz('Full_delinq_min', 750)} END AS Full_delinq,
    BCC5120tr, BCC5830tr, BCC5020tr,
    least(BCC5830tr / BCC5120tr * 100, 60.0) AS Maxbal_mon_pymt_rate,
    least(BCC5830tr / BCC5020tr * 100, 60.0) AS Totbal_mon_pymt_rate,
    ALL7110tr, ALL7516tr, ALL7516tr / ALL7110tr * 10 AS Util_NewCards_rate,
    CASE WHEN IQT9416 = 0 THEN -1.0 ELSE IQB9416 / IQT9416 END AS iqbt_16ratio,
    CASE WHEN IQT9415 = 0 THEN -1.0 ELSE IQT9413 / IQT9415 END AS iqt_1315ratio,
    CASE WHEN IQT9417 = 0 THEN -1.0 ELSE IQT9413 / IQT9417 END AS iqt_1317ratio,
    2 * IQT9413 - IQT9417 AS iqt_1317grad,
    CASE WHEN IQT9410 = 0 THEN -1.0 ELSE IQT9415 / IQT9410 END AS iqt_1510ratio,
    2 * IQT9415 - IQT9410 AS iqt_1510grad
  FROM e1
)"""
ENG_DOUBLES = ATTR_DOUBLES + ["ALL7120tr", "ALL8370tr", "Effetive_max_util", "ALL2350tr", "ALL6980tr",
                              "Full_delinq_min", "Full_delinq", "BCC5120tr", "BCC5830tr", "BCC5020tr",
                              "Maxbal_mon_pymt_rate", "Totbal_mon_pymt_rate", "ALL7110tr", "ALL7516tr",
                              "Util_NewCards_rate", "iqbt_16ratio", "iqt_1315ratio", "iqt_1317ratio", "iqt_1317grad",
                              "iqt_1510ratio", "iqt_1510grad"]
register("engineered_features", FINAL + BUREAU + ENG + "\nSELECT * FROM eng", ENG_DOUBLES)

WOE = """,
w0 AS (
  SELECT *, CAST(CASE WHEN BCC5421 > 999999990 THEN -1.0 WHEN BCC5421 = 0 THEN 0.0
                      ELSE greatest(1000.0, least(""" + _rz("BCC5421", 1000) + """, 5000.0)) / 1000 END AS DOUBLE)
              AS bcc5421_impcap
  FROM {src}
),
woe AS (
  SELECT *, CASE WHEN bcc5421_impcap = -1 THEN -0.221847752 WHEN bcc5421_impcap = 1 THEN -0.615782366
                 WHEN bcc5421_impcap = 2 THEN 0.049639017 WHEN bcc5421_impcap = 3 THEN 0.0846879412
                 WHEN bcc5421_impcap = 4 THEN 0.408789384 ELSE 0.5849793963 END::DOUBLE AS bcc5421_woe,
    CAST(CASE WHEN IQT9510 > 9990 THEN 8.0 ELSE least(IQT9510, 11.0) END AS DOUBLE) AS iqt9510_impcap,
    ln(1 + CAST(CASE WHEN IQT9510 > 9990 THEN 8.0 ELSE least(IQT9510, 11.0) END AS DOUBLE)) AS iqt9510_impcaplog,
    CAST(CASE WHEN REV3511 > 90 THEN 3.0 ELSE least(REV3511, 2.0) END AS DOUBLE) AS rev3511_cap
  FROM w0
)"""
WOE_DOUBLES = ["bcc5421_impcap", "bcc5421_woe", "iqt9510_impcap", "iqt9510_impcaplog", "rev3511_cap"]
register("woe_transforms", FINAL + BUREAU + WOE.format(src="wa") + "\nSELECT * FROM woe", ATTR_DOUBLES + WOE_DOUBLES)

def _select(lists: list[int], where: str = "") -> tuple[str, list[str]]:
    cols = list(dict.fromkeys(["campaign_month", "ReservationNumber", "scorecard"] + [c for k in lists for c in KEEP_LISTS[k]]))
    doubles = [c for c in cols if c in ENG_DOUBLES + WOE_DOUBLES]
    return FINAL + BUREAU + ENG + WOE.format(src="eng") + f"\nSELECT {', '.join(cols)} FROM woe {where}", doubles


register("feature_select", *_select([1, 2, 3, 4]))
register("feature_select_sc4", *_select([4], "WHERE scorecard = 4"))


# ----------------------------------------------------------------------------
# response mart (adapter M in SQL)
# ----------------------------------------------------------------------------

MART = ROLLUP + f""",
mart AS (
  SELECT strftime(campaign_month, '%Y-%m') AS campaign_month, Prospect_type,
    pqabandon_flag, prchargeoff_flag, prclosure_flag, prdecline_flag,
    CASE WHEN vs_band IS NULL OR trim(vs_band) = '' THEN '{_C.LOWEST_BAND}' ELSE vs_band END AS vs_band,
    annual_fee, times_mailed_12mo_cnt, trm10_tier, scorecard, rm_flag,
    volume, responders, expected_responses, expected_responses_xpm, Boards
  FROM rollup
)"""


def agg_sql(src: str, dims: list[str], name: str = "agg", where: str = "") -> str:
    d = ", ".join(dims)
    sel = d + ", " if dims else ""
    grp = f"GROUP BY {d}" if dims else ""
    return f"""
{name}0 AS (
  SELECT {sel}CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume,
    CAST(coalesce(sum(responders), 0) AS BIGINT) AS responders, CAST(coalesce(sum(Boards), 0) AS BIGINT) AS Boards,
    coalesce(CAST(CAST(sum(CAST(CAST(expected_responses AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE), 0.0) AS expected_responses,
    coalesce(CAST(CAST(sum(CAST(CAST(expected_responses_xpm AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE), 0.0) AS expected_responses_xpm,
    count(expected_responses_xpm) AS xnn, count(*) AS nrows
  FROM {src} {where} {grp}
),
{name}1 AS (
  SELECT *,
    CASE WHEN volume = 0 THEN NULL ELSE responders / volume END AS actual_response_rate,
    CASE WHEN volume = 0 THEN NULL ELSE Boards / volume END AS actual_board_rate,
    CASE WHEN volume = 0 THEN NULL ELSE expected_responses / volume END AS expected_rr_trm,
    CASE WHEN volume = 0 OR xnn = 0 THEN NULL ELSE expected_responses_xpm / volume END AS expected_rr_xpm
  FROM {name}0
),
{name} AS (
  SELECT * EXCLUDE (xnn, nrows),
    CASE WHEN expected_rr_trm IS NULL OR expected_rr_trm = 0 THEN NULL ELSE actual_response_rate / expected_rr_trm END
      AS actual_vs_expected_trm,
    CASE WHEN expected_rr_xpm IS NULL OR expected_rr_xpm = 0 THEN NULL ELSE actual_response_rate / expected_rr_xpm END
      AS actual_vs_expected_xpm,
    nrows AS _rows
  FROM {name}1
)"""


AGG_DOUBLES = ["expected_responses", "expected_responses_xpm", "actual_response_rate", "actual_board_rate",
               "expected_rr_trm", "expected_rr_xpm", "actual_vs_expected_trm", "actual_vs_expected_xpm"]
RATES = ["actual_response_rate", "actual_board_rate", "expected_rr_trm", "expected_rr_xpm",
         "actual_vs_expected_trm", "actual_vs_expected_xpm"]

_met, _LB, _thr = _C.DEFAULT_METRIC, _C.DEFAULT_LOOKBACK_MONTHS, 12
MART_DOUBLES = ["annual_fee", "expected_responses", "expected_responses_xpm"]
#: All years of the mart: the mail file follows the orders of the test tables, from 1995 to 2001.
PIVOT_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]
#: The months a view shows by default: the latest ones present.
VIEW = MART + f""",
mr AS (SELECT campaign_month, row_number() OVER (ORDER BY campaign_month DESC) AS r
       FROM (SELECT DISTINCT campaign_month FROM mart WHERE campaign_month IS NOT NULL)),
mj AS (SELECT m.*, mr.r FROM mart m JOIN mr ON m.campaign_month = mr.campaign_month),
vw AS (SELECT * EXCLUDE (r) FROM mj WHERE r <= {_LB})"""


def _unpivot(src: str, ids: list[str], metrics: list[str], dropna: bool = False) -> str:
    i = ", ".join(ids)
    parts = [f"SELECT {i}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}"
             + (f" WHERE {m} IS NOT NULL" if dropna else "") for m in metrics]
    return "\nUNION ALL\n".join(parts)


register("aggregate_by", MART + "," + agg_sql("mart", ["vs_band", "scorecard"]) + "\nSELECT * EXCLUDE (_rows) FROM agg",
         AGG_DOUBLES)
register("kpi_totals", MART + "," + agg_sql("mart", []) + "\nSELECT " + ", ".join(
    f"CASE WHEN _rows > 0 THEN {m} END AS {m}" for m in _C.METRIC_COLUMNS) + " FROM agg",
    [m for m in _C.METRIC_COLUMNS if m in AGG_DOUBLES])
register("monthly_trend", MART + "," + agg_sql("mart", ["campaign_month"]) + "\nSELECT * EXCLUDE (_rows) FROM agg",
         AGG_DOUBLES)
register("pivot_metric", VIEW + "," + agg_sql("mart", ["vs_band", "campaign_month"]) + "\nSELECT vs_band, " + ", ".join(
    f"max(CASE WHEN campaign_month = '{m}' THEN {_met} END) AS \"{m}\"" for m in PIVOT_MONTHS) + " FROM agg GROUP BY vs_band",
    [f'"{m}"' for m in PIVOT_MONTHS])
_supp = ", ".join(f"CASE WHEN volume < {_thr} THEN NULL ELSE {r} END AS {r}" for r in RATES)
register("suppress_small_cells", MART + "," + agg_sql("mart", ["campaign_month", "vs_band"])
         + f"\nSELECT * EXCLUDE (_rows, {', '.join(RATES)}), {_supp} FROM agg", AGG_DOUBLES)


def overall_sql(src: str) -> str:
    """Cells, Overall column, Overall row and grand total, as rows of ``ov``."""
    return ("," + agg_sql(src, ["vs_band", "campaign_month"], "ac") + "," + agg_sql(src, ["vs_band"], "ar") + ","
            + agg_sql(src, ["campaign_month"], "am") + "," + agg_sql(src, [], "ag") + f""",
cells AS (SELECT vs_band, campaign_month, CASE WHEN volume < {_thr} THEN NULL ELSE {_met} END AS value FROM ac
          WHERE vs_band IS NOT NULL),
vis AS (SELECT * FROM cells WHERE value IS NOT NULL),
ov AS (
SELECT 'cell' AS level, CAST(vs_band AS VARCHAR) AS row_value, campaign_month AS column_key, value FROM vis
UNION ALL
SELECT 'row_total', CAST(vs_band AS VARCHAR), 'Overall', CASE WHEN volume < {_thr} THEN NULL ELSE {_met} END FROM ar
WHERE vs_band IN (SELECT vs_band FROM vis)
UNION ALL
SELECT 'col_total', 'Overall', campaign_month, {_met} FROM am
UNION ALL
SELECT 'grand', 'Overall', 'Overall', {_met} FROM ag)""")


_WIDE_COLS = PIVOT_MONTHS + ["Overall"]
OVERALL_WIDE = VIEW + overall_sql("mart") + """,
wide AS (SELECT row_value AS "Row", """ + ", ".join(
    f"max(CASE WHEN column_key = '{c}' THEN value END) AS \"{c}\"" for c in _WIDE_COLS) + " FROM ov GROUP BY row_value)"
register("pivot_overall", VIEW + overall_sql("vw") + "\nSELECT * FROM ov", ["value"])
register("pivot_overall_wide", OVERALL_WIDE + "\nSELECT * FROM wide", [f'"{c}"' for c in _WIDE_COLS])


def _percent(c: str) -> str:
    h = f'CAST(floor("{c}" * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)'
    return (f"CASE WHEN \"{c}\" IS NULL THEN '\u2014' ELSE CAST({h} // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '%' END AS \"{c}\"")


register("formatted_pivot", OVERALL_WIDE + '\nSELECT "Row", ' + ", ".join(map(_percent, _WIDE_COLS)) + " FROM wide")

register("exec_kpis", VIEW + "," + agg_sql("mj", [], "kl", "WHERE r = 1") + ","
         + agg_sql("mj", [], "ka", f"WHERE r <= {_LB}") + ","
         + agg_sql("mj", [], "kx", f"WHERE r <= {_LB} AND expected_responses_xpm IS NOT NULL") + """
SELECT (SELECT max(campaign_month) FROM mj WHERE r = 1) AS latest_month, """
         + ", ".join(f"kl.{m} AS latest_{m}" for m in _C.METRIC_COLUMNS) + ", "
         + ", ".join((f"CASE WHEN kx._rows > 0 THEN kx.{m} END AS all_{m}"
                      if m in ("expected_rr_xpm", "actual_vs_expected_xpm") else f"ka.{m} AS all_{m}")
                     for m in _C.METRIC_COLUMNS) + f""",
  CASE WHEN kl.actual_vs_expected_trm IS NULL THEN 'plain' WHEN kl.actual_vs_expected_trm >= {_C.KPI_GOOD} THEN 'good'
       WHEN kl.actual_vs_expected_trm < {_C.KPI_BAD} THEN 'bad' ELSE 'warn' END AS aoe_status
FROM kl, ka, kx""", [f"{p}_{m}" for p in ("latest", "all") for m in _C.METRIC_COLUMNS if m in AGG_DOUBLES])

register("trend_long", VIEW + "," + agg_sql("vw", ["campaign_month"]) + "\n"
         + _unpivot("agg", ["campaign_month"], ["actual_board_rate", "actual_response_rate", "expected_rr_trm",
                                               "expected_rr_xpm"]), ["value"])
register("model_by_band_trm", VIEW + "," + agg_sql("vw", ["vs_band"]) + "\n"
         + _unpivot("agg", ["vs_band"], ["actual_response_rate", "expected_rr_trm"]), ["value"])
register("model_by_band_xpm", VIEW + "," + agg_sql("vw", ["vs_band"], "agg", "WHERE expected_responses_xpm IS NOT NULL")
         + "\n" + _unpivot("agg", ["vs_band"], ["actual_response_rate", "expected_rr_xpm"]), ["value"])
register("model_monthly", VIEW + "," + agg_sql("vw", ["campaign_month"]) + "\n"
         + _unpivot("agg", ["campaign_month"], ["actual_response_rate", "expected_rr_trm", "expected_rr_xpm"], True),
         ["value"])
register("model_by_tier", VIEW + "," + agg_sql("vw", ["trm10_tier"]) + "\nSELECT * EXCLUDE (_rows) FROM agg", AGG_DOUBLES)
register("model_by_scorecard", VIEW + "," + agg_sql("vw", ["scorecard"]) + "\nSELECT * EXCLUDE (_rows) FROM agg", AGG_DOUBLES)
register("volume_mix", VIEW + "\nSELECT vs_band, campaign_month, CAST(sum(volume) AS BIGINT) AS volume FROM vw GROUP BY ALL")

register("mom_delta", VIEW + "," + agg_sql("vw", ["vs_band", "campaign_month"]) + f""",
c AS (SELECT CAST(vs_band AS VARCHAR) AS row_value, campaign_month,
             CASE WHEN volume < {_thr} THEN NULL ELSE {_met} END AS v FROM agg),
c2 AS (SELECT * FROM c WHERE row_value IS NOT NULL AND v IS NOT NULL),
idx AS (SELECT campaign_month, row_number() OVER (ORDER BY campaign_month) AS i FROM (SELECT DISTINCT campaign_month FROM c2)),
ci AS (SELECT c2.*, idx.i FROM c2 JOIN idx ON c2.campaign_month = idx.campaign_month),
d AS (SELECT a.row_value, a.campaign_month, a.v AS value, b.v AS prev_v, a.v - b.v AS delta
      FROM ci a JOIN ci b ON a.row_value = b.row_value AND a.i = b.i + 1 WHERE a.v - b.v <> 0),
mx AS (SELECT max(abs(delta)) AS m FROM d)
SELECT d.*, least(1.0, abs(delta) / mx.m) AS intensity,
       {_C.MOM_ALPHA_BASE} + {_C.MOM_ALPHA_SPAN} * least(1.0, abs(delta) / mx.m) AS alpha,
       CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction
FROM d, mx""", ["value", "prev_v", "delta", "intensity", "alpha"])

register("volume_share", VIEW + f""",
cell AS (SELECT CAST(vs_band AS VARCHAR) AS row_value, campaign_month AS column_key, CAST(sum(volume) AS BIGINT) AS vol
         FROM vw WHERE vs_band IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM cell UNION ALL SELECT row_value, 'Overall', CAST(sum(vol) AS BIGINT) FROM cell GROUP BY row_value),
t AS (SELECT *, sum(vol) OVER (PARTITION BY column_key) AS tot FROM b)
SELECT row_value, column_key, vol,
       greatest({float(_C.VOLUME_SHARE_MIN)}, least({float(_C.VOLUME_SHARE_MAX)}, vol / tot * 100)) AS pct
FROM t WHERE tot > 0 AND vol > 0""", ["pct"])

_PICKED = "vs_band IN ('640-700', '701-730', '731-830') AND scorecard IN (2, 4)"
register("dict_filter", MART + f"\nSELECT * FROM mart WHERE {_PICKED}", MART_DOUBLES)
register("month_window", VIEW + "\nSELECT * FROM vw", MART_DOUBLES)
register("filter_options", MART + "\n" + "\nUNION\n".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM mart WHERE {d} IS NOT NULL"
    for d in _C.ROLLUP_DIMENSIONS))

# --- validation: rules on totals, one row per month attempt

VALIDATED_DOUBLES = ["total_expected_responses", "total_expected_responses_xpm"]


def validation_sql(src: str, attempts: str, name: str = "val") -> str:
    """``src`` with load_month and campaign_month; ``attempts`` with load_month."""
    rules = [("coalesce(n, 0) = 0", "rollup is empty"), ("least_volume < 0", "negative volume"),
             ("n > 0 AND coalesce(v, 0) <= 0", "total volume not positive"), ("r > v", "responders exceed volume"),
             ("b > v", "boards exceed volume"), ("foreign_rows > 0", "foreign campaign_month")]
    warns = [("et < 0 OR et > v", "expected_responses outside [0, volume]"),
             ("ex < 0 OR ex > v", "expected_responses_xpm outside [0, volume]")]
    said = lambda rs: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rs) + ")"
    return f""",
{name}_t AS (
  SELECT load_month, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v, CAST(sum(responders) AS BIGINT) AS r,
    CAST(sum(Boards) AS BIGINT) AS b, CAST(CAST(sum(CAST(CAST(expected_responses AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) AS et,
    CAST(CAST(sum(CAST(CAST(expected_responses_xpm AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) AS ex, min(volume) AS least_volume,
    sum(CASE WHEN campaign_month IS DISTINCT FROM load_month THEN 1 ELSE 0 END) AS foreign_rows
  FROM {src} GROUP BY load_month),
{name} AS (
  SELECT a.load_month AS campaign_month, coalesce(n, 0) AS row_count, v AS total_volume, r AS total_responders,
    b AS total_boards, et AS total_expected_responses, ex AS total_expected_responses_xpm,
    {said(rules)} = '' AS ok, {said(rules)} AS errors, {said(warns)} AS warnings
  FROM (SELECT DISTINCT load_month FROM {attempts}) a LEFT JOIN {name}_t t ON a.load_month = t.load_month)"""


_MN = "(CAST(substr(campaign_month, 1, 4) AS INTEGER) * 12 + CAST(substr(campaign_month, 6, 2) AS INTEGER))"
LOADED = MART + ",\nld AS (SELECT *, campaign_month AS load_month FROM mart)"
FAULTY = LOADED + f""",
faulty AS (
  SELECT * REPLACE (
    CAST(CASE WHEN {_MN} % 9 = 1 AND trm10_tier = 1 THEN -volume WHEN {_MN} % 9 = 2 THEN 0 ELSE volume END AS BIGINT) AS volume,
    CAST(CASE WHEN {_MN} % 9 = 3 THEN volume * 2 WHEN {_MN} % 9 = 8 AND trm10_tier = 1 THEN volume + 1
              WHEN {_MN} % 9 IN (2, 8) THEN 0 ELSE responders END AS BIGINT) AS responders,
    CAST(CASE WHEN {_MN} % 9 = 4 THEN volume * 2 WHEN {_MN} % 9 = 2 THEN 0 ELSE Boards END AS BIGINT) AS Boards,
    CASE WHEN {_MN} % 9 = 5 AND trm10_tier = 1 THEN '1900-01' ELSE campaign_month END AS campaign_month,
    CASE WHEN {_MN} % 9 = 6 THEN volume * 3.0 ELSE expected_responses END AS expected_responses,
    CASE WHEN {_MN} % 9 = 7 THEN volume * -1.0 ELSE expected_responses_xpm END AS expected_responses_xpm)
  FROM ld WHERE {_MN} % 9 <> 0)"""
register("validate_rollup", LOADED + validation_sql("ld", "ld") + "\nSELECT * FROM val", VALIDATED_DOUBLES)
register("validate_rollup_faulty", FAULTY + validation_sql("faulty", "ld") + "\nSELECT * FROM val", VALIDATED_DOUBLES)

register("validation_summary", MART + """
SELECT campaign_month, 'campaign_month=' || campaign_month AS partition_path, count(*) AS row_count,
  CAST(coalesce(sum(volume), 0) AS BIGINT) AS total_volume, CAST(coalesce(sum(responders), 0) AS BIGINT) AS total_responders,
  CAST(coalesce(sum(Boards), 0) AS BIGINT) AS total_boards,
  coalesce(CAST(CAST(sum(CAST(CAST(expected_responses AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE), 0.0) AS total_expected_responses,
  CAST(CAST(sum(CAST(CAST(expected_responses_xpm AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE) AS total_expected_responses_xpm,
  count(expected_responses_xpm) > 0 AND coalesce(sum(expected_responses_xpm) <> 0, false) AS has_xpm
FROM mart GROUP BY campaign_month""", VALIDATED_DOUBLES)

_FILE = "'exp_' || upper(strftime(strptime(campaign_month, '%Y-%m'), '%b%y')) || '_rollup.csv'"
register("parse_rollup_month", MART + """,
ms AS (SELECT DISTINCT strptime(campaign_month, '%Y-%m')::DATE AS d FROM mart),
names AS (
  SELECT 'exp_' || upper(strftime(d, '%b%y')) || '_rollup.csv' AS file_name FROM ms
  UNION ALL SELECT 'EXP_' || lower(strftime(d, '%b%y')) || '_rollup.CSV' FROM ms
  UNION ALL SELECT 'exp_' || strftime(d, '%Y%m') || '_rollup.csv' FROM ms
)
SELECT file_name,
  CASE WHEN regexp_matches(file_name, '(?i)^exp_(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)(\\d{2})_rollup\\.csv$')
  THEN make_date(
    CASE WHEN CAST(regexp_extract(file_name, '(?i)^exp_([a-z]{3})(\\d{2})_rollup\\.csv$', 2) AS INTEGER) < 80
         THEN 2000 ELSE 1900 END + CAST(regexp_extract(file_name, '(?i)^exp_([a-z]{3})(\\d{2})_rollup\\.csv$', 2) AS INTEGER),
    list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'],
                  upper(regexp_extract(file_name, '(?i)^exp_([a-z]{3})(\\d{2})_rollup\\.csv$', 1))), 1) END
    AS campaign_month
FROM names""")

register("missing_months", MART + f""",
p AS (SELECT DISTINCT campaign_month FROM mart),
b AS (SELECT min(campaign_month) AS lo, max(campaign_month) AS hi FROM p),
e AS (SELECT strftime(unnest(generate_series(strptime(lo, '%Y-%m'), strptime(hi, '%Y-%m'), INTERVAL 1 MONTH)), '%Y-%m')
        AS campaign_month FROM b)
SELECT campaign_month FROM e WHERE campaign_month NOT IN (SELECT campaign_month FROM p WHERE {_MN} % 5 <> 0)""")

# --- file-backed mart: what the files must hold follows from the tables

register("read_mart", MART + "\nSELECT * FROM mart", MART_DOUBLES)
register("cache_or_compute", MART + "\nSELECT * FROM mart", MART_DOUBLES)
register("mart_months", MART + "\nSELECT DISTINCT campaign_month FROM mart")
register("mart_status", MART + """
SELECT max(campaign_month) AS latest_month, count(DISTINCT campaign_month) AS months, true AS refreshed FROM mart""")
register("csv_rollup_roundtrip", MART + f"\nSELECT *, {_FILE} AS source_file FROM mart", MART_DOUBLES)
_DIM_COLS = ", ".join(_C.REQUIRED_ROLLUP_COLUMNS + tuple(_C.OPTIONAL_ROLLUP_COLUMNS))
register("filtered_export", MART + f"""
SELECT {_DIM_COLS}, campaign_month FROM mart
WHERE {_PICKED} AND campaign_month >= '1997-01' AND campaign_month <= '1999-12'""", MART_DOUBLES)
register("mart_replace_month", FAULTY + validation_sql("faulty", "faulty") + """,
kept AS (
  SELECT load_month, volume, responders FROM faulty WHERE load_month IN (SELECT campaign_month FROM val WHERE ok)
  UNION ALL
  SELECT load_month, volume, responders FROM ld WHERE load_month NOT IN (SELECT campaign_month FROM val WHERE ok))
SELECT k.load_month AS campaign_month, count(*) AS stored_rows, CAST(sum(k.volume) AS BIGINT) AS stored_volume,
  CAST(sum(k.responders) AS BIGINT) AS stored_responders, any_value(val.ok) AS ok, any_value(val.errors) AS errors
FROM kept k LEFT JOIN val ON k.load_month = val.campaign_month GROUP BY k.load_month""")

# files for all months; every other month in the mart, every sixth with a newer file; every seventh fails
INGEST = LOADED + f""",
files AS (SELECT * REPLACE (CAST(CASE WHEN {_MN} % 7 = 3 THEN volume * 2 ELSE responders END AS BIGINT) AS responders) FROM ld),
ages AS (SELECT campaign_month, {_MN} AS k, CAST(2001 * 12 + 9 - {_MN} AS INTEGER) AS age_months
         FROM (SELECT DISTINCT campaign_month FROM ld)),
plan AS (
  SELECT campaign_month, age_months,
    CASE WHEN age_months >= {_C.HISTORY_FREEZE_MONTHS} THEN 'frozen' WHEN k % 2 <> 0 THEN 'add' WHEN k % 6 = 0 THEN 'replace'
         WHEN age_months >= 0 AND age_months < {_C.RECENT_REFRESH_WINDOW_MONTHS} THEN 'replace' ELSE 'skip' END AS action,
    CASE WHEN age_months >= {_C.HISTORY_FREEZE_MONTHS} THEN 'in the freeze window' WHEN k % 2 <> 0 THEN 'new month'
         WHEN k % 6 = 0 THEN 'file newer than partition'
         WHEN age_months >= 0 AND age_months < {_C.RECENT_REFRESH_WINDOW_MONTHS} THEN 'in the refresh window'
         ELSE 'up to date' END AS reason
  FROM ages)""" + validation_sql("files", "files") + """,
done AS (
  SELECT p.*, CASE WHEN action IN ('add', 'replace') AND NOT val.ok THEN 'failed' WHEN action = 'add' THEN 'added'
                   WHEN action = 'replace' THEN 'replaced' WHEN action = 'skip' THEN 'skipped' ELSE 'frozen' END AS status,
         val.* EXCLUDE (campaign_month)
  FROM plan p JOIN val ON p.campaign_month = val.campaign_month)"""
register("ingest_plan", INGEST + f"\nSELECT campaign_month, {_FILE} AS file_name, age_months, action, reason FROM plan")
register("ingest_summary", INGEST + """
SELECT s.status, count(done.campaign_month) AS files
FROM (VALUES ('added'), ('replaced'), ('skipped'), ('frozen'), ('failed')) s(status) LEFT JOIN done ON s.status = done.status
GROUP BY s.status""")
register("load_log", INGEST + f"""
SELECT campaign_month, {_FILE} AS source_file, row_count, total_volume, total_responders, total_boards, total_expected_responses,
  total_expected_responses_xpm, status, CASE WHEN status = 'failed' THEN errors ELSE warnings END AS message
FROM done WHERE status IN ('added', 'replaced', 'failed')""", VALIDATED_DOUBLES)

# files of eight kinds in an empty mart: text in a volume fails the month, a faulty header too, the newer of two files counts
_LOADS = f"age_months < {_C.HISTORY_FREEZE_MONTHS}"
register("ingest_isolation", LOADED + f""",
odd AS (SELECT * REPLACE (CASE WHEN {_MN} % 8 = 1 AND trm10_tier = 1 THEN NULL ELSE volume END AS volume),
               CASE WHEN {_MN} % 8 = 1 AND trm10_tier = 1 THEN 1 ELSE 0 END AS no_number FROM ld),
wrong AS (SELECT load_month, CAST(sum(no_number) AS VARCHAR) AS n FROM odd GROUP BY load_month HAVING sum(no_number) > 0),
ages AS (SELECT campaign_month, {_MN} % 8 AS kind, 2001 * 12 + 9 - {_MN} AS age_months FROM (SELECT DISTINCT campaign_month FROM ld))"""
         + validation_sql("odd", "odd") + f""",
seen AS (
  SELECT a.*, val.row_count, val.total_volume, concat_ws('; ', nullif(val.errors, ''), wrong.n || ' values of volume are no numbers') AS errors, val.warnings
  FROM ages a JOIN val ON val.campaign_month = a.campaign_month LEFT JOIN wrong ON wrong.load_month = a.campaign_month),
files AS (
  SELECT *, {_FILE} AS file_name, CASE WHEN {_LOADS} THEN 'add' ELSE 'frozen' END AS action,
         CASE kind WHEN 2 THEN 'repeated columns: volume' WHEN 3 THEN 'missing required columns: Boards' WHEN 4 THEN 'the file is empty' END AS fault
  FROM seen WHERE kind <> 6),
done AS (
  SELECT *, CASE WHEN action = 'frozen' THEN 'frozen' WHEN fault IS NOT NULL OR errors <> '' THEN 'failed' ELSE 'added' END AS status FROM files),
result AS (
  SELECT campaign_month, file_name, action, status,
         CASE WHEN status = 'frozen' THEN '' WHEN fault IS NOT NULL THEN fault WHEN status = 'failed' THEN errors ELSE warnings END AS message,
         CASE WHEN status <> 'frozen' AND fault IS NULL THEN row_count
              WHEN status <> 'frozen' AND fault IS NOT NULL THEN NULL END AS row_count,
         CASE WHEN status <> 'frozen' AND fault IS NULL THEN total_volume END AS total_volume FROM done
  UNION ALL
  SELECT campaign_month, lower({_FILE}), 'skip', 'skipped', 'a newer file of the month is there', NULL, NULL FROM seen WHERE kind = 5
  UNION ALL
  SELECT NULL, 'exp_' || replace(campaign_month, '-', '') || '_rollup.csv', 'ignore', 'ignored', 'the name gives no month', NULL, NULL
  FROM seen WHERE kind = 6)
SELECT result.*, stored.total_volume AS stored_volume
FROM result LEFT JOIN (SELECT campaign_month, total_volume FROM done WHERE status = 'added') stored ON stored.campaign_month = result.campaign_month""")

register("mart_swap", LOADED + """,
v AS (SELECT load_month AS campaign_month, CAST(sum(volume) AS BIGINT) AS v, row_number() OVER (ORDER BY load_month DESC) AS back FROM ld GROUP BY load_month),
last4 AS (SELECT campaign_month, v, 5 - back AS r FROM v WHERE back <= 4),
died AS (SELECT * FROM (VALUES ('staged', 0), ('moved', 1), ('published', 2)) x(died_after, done))
SELECT died_after, campaign_month, CASE WHEN r <= done THEN 2 * v ELSE v END AS open, CASE WHEN r <= done THEN 2 * v ELSE v END AS recovered
FROM last4, died""")

# as-of joins: the whole list of candidates per left row, best one first


def asof_sql(where: str, order: str) -> str:
    owner = "CASE WHEN creditaccountid % 3 = 0 THEN 0 ELSE creditaccountid END AS owner"
    return f"""WITH {FACT},
l AS (SELECT row_number() OVER () AS rid, {owner}, creditaccountid, cardid AS board_card, CAST(reportingdate - INTERVAL 10 DAY AS DATE) AS at
      FROM fact WHERE newaccountindicator = 1),
r AS (SELECT DISTINCT {owner}, reportingdate, bhvr_score, cardid, card_part, card_supp FROM fact WHERE bhvr_score {VALID}),
j AS (
  SELECT l.*, r.bhvr_score, r.cardid, datediff('day', l.at, r.reportingdate) AS gap,
         row_number() OVER (PARTITION BY rid ORDER BY {order}, r.cardid DESC, r.card_part DESC, r.card_supp DESC) AS best
  FROM l JOIN r ON l.owner = r.owner WHERE {where})
SELECT l.owner, l.creditaccountid, l.board_card, l.at, j.bhvr_score, j.cardid, CAST(j.gap AS INTEGER) AS gap
FROM l LEFT JOIN j ON l.rid = j.rid AND j.best = 1"""


register("asof_forward", asof_sql("r.reportingdate >= l.at", "r.reportingdate"))
register("asof_backward", asof_sql("r.reportingdate <= l.at AND r.reportingdate >= l.at - INTERVAL 45 DAY", "r.reportingdate DESC"))
register("asof_nearest", asof_sql("abs(datediff('day', l.at, r.reportingdate)) <= 400",
                                  "abs(datediff('day', l.at, r.reportingdate)), r.reportingdate DESC"))

# selections of months: the full recompute that the stored counts must equal
SELECTED = COH + """,
pm AS (SELECT *, strftime(vintage, '%Y-%m') AS board_month FROM pairs),
ms AS (SELECT board_month, row_number() OVER (ORDER BY board_month) AS r FROM (SELECT DISTINCT board_month FROM pm)),
picked AS (
  SELECT 'all' AS selection, * FROM pm
  UNION ALL SELECT 'first', * FROM pm WHERE board_month IN (SELECT board_month FROM ms WHERE r <= 3)
  UNION ALL SELECT 'some', * FROM pm WHERE substr(board_month, 6, 2) IN ('02', '07'))"""
_SEL = ["selection", "read_key"]
register("selected_deciles", SELECTED + "," + deciles_sql("picked", _SEL) + "\nSELECT * FROM deciles_full", DECILE_DOUBLES)
register("selected_gains", SELECTED + "," + deciles_sql("picked", _SEL) + """
SELECT selection, read_key, decile AS point, cum_n / sum(n) OVER (PARTITION BY selection, read_key) AS cum_pop_share, cum_bad_share FROM deciles_full
UNION ALL
SELECT DISTINCT selection, read_key, 0, 0.0, 0.0 FROM deciles_full""", ["cum_pop_share", "cum_bad_share"])
register("selected_kpis", SELECTED + "," + deciles_sql("picked", _SEL) + "," + lift_sql("deciles_full", _SEL) + "," + stats_sql("picked", _SEL) + """
SELECT st.*, lift.d1_d10_lift, lift.lift_label FROM st LEFT JOIN lift ON st.selection = lift.selection AND st.read_key = lift.read_key""",
         ["avg_score", "avg_creditline", "edr", "d1_d10_lift"])
register("stored_month_stats", SELECTED + "," + deciles_sql("pm", ["read_key", "board_month"]) + "," + lift_sql("deciles_full", ["read_key", "board_month"]) + """
SELECT p.read_key, p.board_month, count(*) AS n, CAST(sum(p.bad) AS BIGINT) AS bads, avg(p.bhvr_score) AS avg_score,
       CAST(sum(p.bad) AS BIGINT) / count(*) AS bad_rate, any_value(l.d1_d10_lift) AS d1_d10_lift
FROM pm p LEFT JOIN lift l ON p.read_key = l.read_key AND p.board_month = l.board_month
GROUP BY p.read_key, p.board_month""", ["avg_score", "bad_rate", "d1_d10_lift"])
register("cube_months_touched", SELECTED + """
SELECT board_month, count(*) AS accounts, count(*) AS accounts_after, board_month = (SELECT max(board_month) FROM pm) AS touched
FROM pm GROUP BY board_month""")

register("cache_rules", """
WITH c AS (SELECT o_custkey, count(*) AS orders, max(o_orderkey) AS last FROM orders GROUP BY o_custkey),
e AS (SELECT o_custkey, count(*) AS orders, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
t AS (SELECT count(*) AS customers, sum(orders) AS orders, sum(last) AS last_keys FROM c),
h AS (SELECT count(*) AS customers, sum(orders) AS orders, sum(last) AS last_keys FROM e)
SELECT step, CAST(builds AS INTEGER) AS builds, CAST(customers AS BIGINT) AS customers, CAST(orders AS BIGINT) AS orders, CAST(last_keys AS BIGINT) AS last_keys
FROM (VALUES ('1 built', 1), ('2 read', 0)) s(step, builds), h
UNION ALL
SELECT step, CAST(builds AS INTEGER), CAST(customers AS BIGINT), CAST(orders AS BIGINT), CAST(last_keys AS BIGINT)
FROM (VALUES ('3 source changed', 1), ('4 copy emptied', 1), ('5 two at once', 0)) s(step, builds), t""")
