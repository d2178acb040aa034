"""Response-mart metrics: rates are always sum(numerator) / sum(denominator).

Mart rows: campaign_month (yyyy-MM text) + the 11 rollup dimensions + volume,
responders, Boards, expected_responses, expected_responses_xpm (optional).
Sums over only-null values count as 0, except that the XPM rate is null for a
group with no non-null XPM row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit import config as C
from vintagekit.functions.nulls import safe_div

SUMS = ("volume", "responders", "Boards", "expected_responses", "expected_responses_xpm")


def _sum_aggs(cond: Column | None = None, prefix: str = "") -> list[Column]:
    def v(c):
        return F.col(c) if cond is None else F.when(cond, F.col(c))
    out = []
    for c in SUMS:
        if c in ("volume", "responders", "Boards"):
            out.append(F.coalesce(F.sum(v(c)), F.lit(0)).cast("long").alias(prefix + c))
        else:  # exact decimal accumulation: deterministic under any partitioning
            s = F.sum(v(c).cast("decimal(38,18)")).cast("double")
            out.append(F.coalesce(s, F.lit(0.0)).alias(prefix + c))
    out.append(F.count(v("expected_responses_xpm")).alias(prefix + "_xpm_nn"))
    return out


def add_rate_columns(df: DataFrame, prefix: str = "") -> DataFrame:
    """A2: six derived rates; null on a null/0 denominator; XPM rate null when no XPM row."""
    p = prefix
    vol = F.col(p + "volume")
    out = (df.withColumn(p + "actual_response_rate", safe_div(p + "responders", vol))
           .withColumn(p + "actual_board_rate", safe_div(p + "Boards", vol))
           .withColumn(p + "expected_rr_trm", safe_div(p + "expected_responses", vol))
           .withColumn(p + "expected_rr_xpm", safe_div(p + "expected_responses_xpm", vol)))
    if p + "_xpm_nn" in df.columns:
        out = out.withColumn(p + "expected_rr_xpm",
                             F.when(F.col(p + "_xpm_nn") > 0, F.col(p + "expected_rr_xpm")))
    out = (out.withColumn(p + "actual_vs_expected_trm", safe_div(p + "actual_response_rate", p + "expected_rr_trm"))
           .withColumn(p + "actual_vs_expected_xpm", safe_div(p + "actual_response_rate", p + "expected_rr_xpm")))
    return out.drop(p + "_xpm_nn") if p + "_xpm_nn" in out.columns else out


def aggregate_by(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """A1: sums by any dimensions, then rates recomputed from the sums."""
    return add_rate_columns(df.groupBy(*dims).agg(*_sum_aggs()))


def kpi_totals(df: DataFrame) -> DataFrame:
    """A3: one row of the nine metrics; all null for an empty input."""
    g = add_rate_columns(df.agg(F.count(F.lit(1)).alias("_rows"), *_sum_aggs()))
    return g.select(*[F.when(F.col("_rows") > 0, F.col(m)).alias(m) for m in C.METRIC_COLUMNS])


def monthly_trend(df: DataFrame) -> DataFrame:
    """A4."""
    return aggregate_by(df, ["campaign_month"])


def suppress_small_cells(df: DataFrame, threshold: int = C.SMALL_CELL_THRESHOLD,
                         volume_col: str = "volume", rates: Sequence[str] = C.RATE_COLUMNS) -> DataFrame:
    """null the rates where volume < threshold (a null volume keeps them);
    counts stay. threshold <= 0 is a no-op."""
    if threshold <= 0 or volume_col not in df.columns:
        return df
    small = F.col(volume_col) < threshold
    present = [r for r in rates if r in df.columns]
    return df.select(*[F.when(small, F.lit(None)).otherwise(F.col(c)).alias(c) if c in present else F.col(c)
                       for c in df.columns])


def pivot_metric(df: DataFrame, row_dim: str, metric: str, values: Sequence[str], column_dim: str = "campaign_month") -> DataFrame:
    """A5: aggregate to (row, column) first, then lay the metric out wide over the caller's columns."""
    return aggregate_by(df, [row_dim, column_dim]).groupBy(row_dim).pivot(column_dim, list(values)).agg(F.first(metric))


def pivot_overall_long(df: DataFrame, row_dim: str, metric: str, threshold: int = C.SMALL_CELL_THRESHOLD,
                       column_dim: str = "campaign_month") -> DataFrame:
    """A13 in long form: cells (row x month), Overall column (per row), Overall row
    (per month) and the grand total, each recomputed from sums in one grouping-sets
    aggregation. Cells and the Overall column are suppressed, the Overall row is
    not; rows with a null key or with no visible cell are dropped (they remain in
    the Overall row)."""
    g = df.groupingSets([[row_dim, column_dim], [row_dim], [column_dim], []], row_dim, column_dim).agg(
        F.grouping_id().alias("_gid"), *_sum_aggs())
    g = add_rate_columns(g)
    level = (F.when(F.col("_gid") == 0, "cell").when(F.col("_gid") == 1, "row_total")
             .when(F.col("_gid") == 2, "col_total").otherwise("grand"))
    g = g.withColumn("level", level)
    masked = F.when(F.col("level").isin("cell", "row_total") & (F.col("volume") < threshold), F.lit(None)) \
        .otherwise(F.col(metric)) if threshold > 0 else F.col(metric)
    g = g.withColumn("value", masked.cast("double"))
    cells = g.filter((F.col("level") == "cell") & F.col(row_dim).isNotNull() & F.col("value").isNotNull())
    kept = cells.select(row_dim).distinct()
    row_tot = g.filter(F.col("level") == "row_total").join(kept, row_dim, "left_semi")
    rest = g.filter(F.col("level").isin("col_total", "grand"))
    out = cells.unionByName(row_tot).unionByName(rest)
    return out.select(
        "level",
        F.when(F.col("level").isin("cell", "row_total"), F.col(row_dim).cast("string")).otherwise("Overall")
        .alias("row_value"),
        F.when(F.col("level").isin("cell", "col_total"), F.col(column_dim).cast("string")).otherwise("Overall")
        .alias("column_key"),
        "value")


def pivot_overall(df: DataFrame, row_dim: str, metric: str, values: Sequence[str],
                  threshold: int = C.SMALL_CELL_THRESHOLD, column_dim: str = "campaign_month") -> DataFrame:
    """The wide table - one row per row value plus "Overall", one column per month plus "Overall"."""
    long = pivot_overall_long(df, row_dim, metric, threshold, column_dim)
    return (long.groupBy(F.col("row_value").alias("Row")).pivot("column_key", [*values, "Overall"]).agg(F.first("value")))


def format_metric(value: Column, metric: str) -> Column:
    """Counts with thousands separators, ratios with two decimals, rates as percent with two decimals; a dash
    for a missing value. Halves round up."""
    if metric in C.COUNT_METRICS:
        text = F.format_number(value.cast("long"), 0)
    else:
        ratio = metric in C.RATIO_METRICS
        h = F.floor(value * F.lit(100.0 if ratio else 10000.0) + F.lit(0.5)).cast("long")
        whole = F.floor(h / 100).cast("long").cast("string")
        text = F.concat(whole, F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit("" if ratio else "%"))
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("\u2014")).otherwise(text)


def formatted_pivot(wide: DataFrame, metric: str, row_col: str = "Row") -> DataFrame:
    """A16 on the wide table."""
    return wide.select(row_col, *[format_metric(F.col(f"`{c}`"), metric).alias(c) for c in wide.columns if c != row_col])


def month_window(df: DataFrame, months: Sequence[str] | None = None, month_from: str | None = None,
                 month_to: str | None = None, lookback: int | None = C.DEFAULT_LOOKBACK_MONTHS,
                 col: str = "campaign_month") -> DataFrame:
    """explicit months > from/to range > latest N months present."""
    if months:
        return df.filter(F.col(col).isin(list(months)))
    if month_from or month_to:
        out = df
        if month_from:
            out = out.filter(F.col(col) >= month_from)
        if month_to:
            out = out.filter(F.col(col) <= month_to)
        return out
    if lookback is None:
        return df
    latest = (df.select(col).where(F.col(col).isNotNull()).distinct()
              .withColumn("_r", F.row_number().over(Window.orderBy(F.col(col).desc())))
              .filter(F.col("_r") <= lookback).select(col))
    return df.join(F.broadcast(latest), col, "left_semi")


def dict_filter(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """AND of IN-lists; empty lists and unknown columns are ignored."""
    out = df
    for c, vals in filters.items():
        if vals and c in df.columns:
            out = out.filter(F.col(c).isin(list(vals)))
    return out


def filter_options(df: DataFrame, dims: Sequence[str] = C.ROLLUP_DIMENSIONS) -> DataFrame:
    """distinct non-null values per dimension, as (dimension, value) rows."""
    sets = df.agg(*[F.collect_set(F.col(d).cast("string")).alias(d) for d in dims])  # one row, a few values a dimension
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("values")) for d in dims])
    return sets.select(F.explode(each).alias("_o")).select("_o.dimension", F.explode("_o.values").alias("value"))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], dropna: bool = False) -> DataFrame:
    """Long form (ids..., metric, value); nulls kept unless ``dropna``."""
    structs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    out = df.select(*ids, F.explode(F.array(*structs)).alias("_m")).select(*ids, "_m.*")
    return out.where(F.col("value").isNotNull()) if dropna else out


def exec_kpis(df: DataFrame, lookback: int = C.DEFAULT_LOOKBACK_MONTHS) -> DataFrame:
    """Latest-month KPIs, look-back KPIs (XPM ones over rows with XPM only) and
    the actual/expected status - three conditional aggregates in one pass."""
    months = (df.select("campaign_month").where(F.col("campaign_month").isNotNull()).distinct()
              .withColumn("_r", F.row_number().over(Window.orderBy(F.col("campaign_month").desc()))))
    j = df.join(F.broadcast(months), "campaign_month", "inner")
    latest = F.col("_r") == 1
    inwin = F.col("_r") <= lookback
    xpm = inwin & F.col("expected_responses_xpm").isNotNull()
    g = j.agg(F.max(F.when(latest, F.col("campaign_month"))).alias("latest_month"),
              *_sum_aggs(latest, "l_"), *_sum_aggs(inwin, "a_"), *_sum_aggs(xpm, "x_"),
              F.count(F.when(xpm, 1)).alias("_xrows"))
    g = add_rate_columns(add_rate_columns(add_rate_columns(g, "l_"), "a_"), "x_")
    aoe = F.col("l_actual_vs_expected_trm")
    status = (F.when(aoe.isNull(), "plain").when(aoe >= C.KPI_GOOD, "good").when(aoe < C.KPI_BAD, "bad")
              .otherwise("warn"))
    cols = [F.col("latest_month")]
    cols += [F.col("l_" + m).alias("latest_" + m) for m in C.METRIC_COLUMNS]
    for m in C.METRIC_COLUMNS:
        src = "x_" if m in ("expected_rr_xpm", "actual_vs_expected_xpm") else "a_"
        val = F.col(src + m) if src == "a_" else F.when(F.col("_xrows") > 0, F.col(src + m))
        cols.append(val.alias("all_" + m))
    return g.select(*cols, status.alias("aoe_status"))


def mom_delta(df: DataFrame, row_dim: str, metric: str, threshold: int = C.SMALL_CELL_THRESHOLD) -> DataFrame:
    """Month-on-month change of the masked cell metric against the previous
    *visible* month column; zero and null deltas skipped; intensity scaled by the
    largest absolute delta; alpha = base + span * intensity."""
    cells = suppress_small_cells(aggregate_by(df, [row_dim, "campaign_month"]), threshold)
    cells = cells.select(F.col(row_dim).cast("string").alias("row_value"), "campaign_month",
                         F.col(metric).alias("v")).where(F.col("row_value").isNotNull() & F.col("v").isNotNull())
    idx = (cells.select("campaign_month").distinct()
           .withColumn("_i", F.row_number().over(Window.orderBy("campaign_month"))))
    c = cells.join(F.broadcast(idx), "campaign_month")
    prev = c.select("row_value", (F.col("_i") + 1).alias("_i"), F.col("v").alias("prev_v"))
    d = c.join(prev, ["row_value", "_i"]).withColumn("delta", F.col("v") - F.col("prev_v")) \
        .where(F.col("delta") != 0)
    mx = d.agg(F.max(F.abs("delta")).alias("_mx")).withColumn("_k", F.lit(1))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(mx), "_k")
    inten = F.least(F.lit(1.0), safe_div(F.abs(F.col("delta")), F.col("_mx")))
    return d.select("row_value", "campaign_month", F.col("v").alias("value"), "prev_v", "delta",
                    inten.alias("intensity"),
                    (F.lit(C.MOM_ALPHA_BASE) + F.lit(C.MOM_ALPHA_SPAN) * inten).alias("alpha"),
                    F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"))


def volume_share(df: DataFrame, row_dim: str) -> DataFrame:
    """Cell volume as a percent of its column total, clamped to [2, 100], with
    the Overall column (row totals); null row keys dropped."""
    cell = df.where(F.col(row_dim).isNotNull()).groupBy(F.col(row_dim).cast("string").alias("row_value"),
                                                        F.col("campaign_month").alias("column_key")) \
        .agg(F.sum("volume").alias("vol"))
    overall = cell.groupBy("row_value").agg(F.sum("vol").alias("vol")).withColumn("column_key", F.lit("Overall"))
    both = cell.unionByName(overall)
    tot = F.sum("vol").over(Window.partitionBy("column_key"))
    pct = F.greatest(F.lit(float(C.VOLUME_SHARE_MIN)), F.least(F.lit(float(C.VOLUME_SHARE_MAX)),
                                                               F.col("vol") / tot * 100))
    out = both.withColumn("_tot", tot).withColumn("pct", pct)
    return out.where((F.col("_tot") > 0) & (F.col("vol") > 0)).select("row_value", "column_key", "vol", "pct")


def volume_mix(df: DataFrame, row_dim: str) -> DataFrame:
    """Volume by row dimension and month."""
    return df.groupBy(row_dim, "campaign_month").agg(F.sum("volume").alias("volume"))


# ----------------------------------------------------------------------------
# validation (DQ1, SNK4)
# ----------------------------------------------------------------------------

TOTALS = ("row_count", "total_volume", "total_responders", "total_boards", "total_expected_responses",
          "total_expected_responses_xpm")
VALIDATION_SCHEMA = ("campaign_month string, row_count long, total_volume long, total_responders long, total_boards long, "
                     "total_expected_responses double, total_expected_responses_xpm double, ok boolean, errors string, warnings string")


def _exact(col: str) -> Column:
    """Sum of a double accumulated in decimal: the same under any partitioning."""
    return F.sum(F.col(col).cast("decimal(38,18)")).cast("double")


def validate_rollup(df: DataFrame, expected: DataFrame | None = None, month: str = "load_month") -> DataFrame:
    """DQ1: one row per month attempt (``month``, where the rows were read from): errors block the month, warnings
    do not. Responders, boards and expected responses are compared as totals. ``expected`` lists the attempts, so a
    month without rows is reported as empty; without required columns every attempt fails. A ``mark`` column says what was
    wrong with a row as it was read; a row with text for a number or with a broken line blocks its month."""
    missing = [c for c in C.REQUIRED_ROLLUP_COLUMNS if c not in df.columns]
    attempts = (expected if expected is not None else df).select(month).distinct()
    if missing:
        return attempts.select(
            F.col(month).alias("campaign_month"), *[F.lit(None).cast("double" if "expected" in t else "long").alias(t) for t in TOTALS],
            F.lit(False).alias("ok"), F.lit(f"missing required columns: {', '.join(missing)}").alias("errors"), F.lit("").alias("warnings"))
    marked = "mark" in df.columns
    holds = lambda c: F.array_contains(F.split(F.col("mark"), ","), c)
    foreign = (holds("campaign_month") if marked else ~F.col("campaign_month").eqNullSafe(F.col(month))
               if "campaign_month" in df.columns else F.lit(False))
    faults = ["line", *NUMBERS] if marked else []
    xpm = _exact("expected_responses_xpm") if "expected_responses_xpm" in df.columns else F.lit(None).cast("double")
    g = df.groupBy(month).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("volume").cast("long").alias("total_volume"),
        F.sum("responders").cast("long").alias("total_responders"), F.sum("Boards").cast("long").alias("total_boards"),
        _exact("expected_responses").alias("total_expected_responses"), xpm.alias("total_expected_responses_xpm"),
        F.min("volume").alias("_least"), F.max(foreign).alias("_foreign"), *[F.count_if(holds(c)).alias(f"_{c}") for c in faults])
    g = attempts.join(g, month, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    v, some = F.col("total_volume"), F.col("row_count") > 0

    def outside(col: str) -> Column:
        return (F.col(col) < 0) | (F.col(col) > v)

    errors = [(~some, "rollup is empty"), (F.col("_least") < 0, "negative volume"),
              (some & F.coalesce(v <= 0, F.lit(True)), "total volume not positive"),
              (F.col("total_responders") > v, "responders exceed volume"), (F.col("total_boards") > v, "boards exceed volume"),
              (F.col("_foreign"), "foreign campaign_month")]
    errors += [(F.col(f"_{c}") > 0, F.concat(F.col(f"_{c}").cast("string"), F.lit(" broken lines" if c == "line" else f" values of {c} are no numbers")))
               for c in faults]
    warnings = [(outside("total_expected_responses"), "expected_responses outside [0, volume]"),
                (outside("total_expected_responses_xpm"), "expected_responses_xpm outside [0, volume]")]
    said = lambda rules: F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    return g.select(F.col(month).alias("campaign_month"), *TOTALS, (F.size(said(errors)) == 0).alias("ok"),
                    F.array_join(said(errors), "; ").alias("errors"), F.array_join(said(warnings), "; ").alias("warnings"))


def validation_summary(mart: DataFrame) -> DataFrame:
    """SNK4: one row per partition with totals and has_xpm (non-null and non-zero)."""
    g = mart.groupBy("campaign_month").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("total_volume"),
        F.coalesce(F.sum("responders"), F.lit(0)).cast("long").alias("total_responders"),
        F.coalesce(F.sum("Boards"), F.lit(0)).cast("long").alias("total_boards"),
        F.coalesce(F.sum(F.col("expected_responses").cast("decimal(38,18)")).cast("double"), F.lit(0.0))
        .alias("total_expected_responses"),
        F.sum(F.col("expected_responses_xpm").cast("decimal(38,18)")).cast("double")
        .alias("total_expected_responses_xpm"),
        F.count("expected_responses_xpm").alias("_nn"))
    has = (F.col("_nn") > 0) & F.coalesce(F.col("total_expected_responses_xpm") != 0, F.lit(False))
    return g.select("campaign_month", F.concat(F.lit("campaign_month="), F.col("campaign_month")).alias("partition_path"),
                    "row_count", "total_volume", "total_responders", "total_boards", "total_expected_responses",
                    "total_expected_responses_xpm", has.alias("has_xpm"))


# ----------------------------------------------------------------------------
# ingest conform (ING2-ING7, ING9)
# ----------------------------------------------------------------------------

def rollup_month(name: str) -> Column:
    """ING2: exp_<MON><YY>_rollup.csv -> first day of month; 2-digit years below
    the pivot are 20YY, others 19YY; anything else -> null."""
    months = "|".join(C.MONTH_ABBREVIATIONS)
    pat = rf"(?i)^exp_({months})(\d{{2}})_rollup\.csv$"
    mon = F.upper(F.regexp_extract(F.col(name), pat, 1))
    number = F.array_position(F.array(*[F.lit(m) for m in C.MONTH_ABBREVIATIONS]), mon).cast("int")
    y = F.regexp_extract(F.col(name), pat, 2).try_cast("int")
    year = F.when(y < C.TWO_DIGIT_YEAR_PIVOT, y + 2000).otherwise(y + 1900)
    return F.when(mon != "", F.make_date(year, number, F.lit(1)))


def parse_rollup_month(names: DataFrame, col: str = "file_name") -> DataFrame:
    return names.select(col, rollup_month(col).alias("campaign_month"))


def canonicalize_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """ING3: rename columns whose lower-case form matches a canonical name."""
    want = {n.lower(): n for n in names}
    mapping = {c: want[c.lower()] for c in df.columns if c.lower() in want and c != want[c.lower()]}
    return df.withColumnsRenamed(mapping) if mapping else df


def prepare_rollup(df: DataFrame, month_text: Column | str | None = None) -> DataFrame:
    """ING3-ING7: canonical names, drop the precomputed rates, backfill the optional
    XPM column, blank band -> lowest band, month literal, permissive int flags."""
    out = canonicalize_columns(df, C.ROLLUP_COLUMNS)
    out = out.drop(*[c for c in C.DROP_RATE_COLUMNS if c in out.columns])
    for c in C.OPTIONAL_ROLLUP_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    band = F.col("vs_band")
    out = out.withColumn("vs_band", F.when(band.isNull() | (F.trim(band) == ""), F.lit(C.LOWEST_BAND))
                         .otherwise(band))
    if month_text is not None:
        out = out.withColumn("campaign_month", F.lit(month_text) if isinstance(month_text, str) else month_text)
    for c in C.FLAG_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, F.expr(f"try_cast(CAST({c} AS string) AS int)"))
    return out


_TYPES = {"Prospect_type": "string", "vs_band": "string", "annual_fee": "double", "times_mailed_12mo_cnt": "int", "volume": "bigint",
          "responders": "bigint", "Boards": "bigint", "expected_responses": "double", "expected_responses_xpm": "double"}


#: The mark of a row that nothing is wrong with.
CLEAN = "clean"
#: Columns in which text that is no number blocks the month; the flags are read permissively (ING7).
NUMBERS = ("volume", "responders", "Boards", "expected_responses", "expected_responses_xpm", "annual_fee", "times_mailed_12mo_cnt")


def number(col: str, kind: str) -> Column:
    """Text as a number; null if it is none. A whole number may be written with decimals (100.0)."""
    c = F.trim(F.col(col).cast("string"))
    if kind == "double":
        return c.try_cast("double")
    wide = c.try_cast("decimal(38,6)")
    return F.when(wide == F.floor(wide), wide).try_cast(kind)


def conform_rollup(df: DataFrame, broken: Column | None = None) -> DataFrame:
    """The known columns by name, cast by name, and the month and file columns. With ``broken`` (whether a line had too
    few or too many fields) the rows get a ``mark``: the columns whose text is no number, in order and comma-joined, or
    "line", or CLEAN; without it such text becomes null."""
    own = [*C.REQUIRED_ROLLUP_COLUMNS, *C.OPTIONAL_ROLLUP_COLUMNS]
    extra = [c for c in ("campaign_month", "source_file") if c in df.columns]
    kind = {c: _TYPES.get(c, "int") for c in own}
    value = {c: F.col(c).try_cast(kind[c]) if kind[c] == "string" else number(c, kind[c]) for c in own}
    marks = []
    if broken is not None:
        wrong = [F.when(value[c].isNull() & (F.trim(F.col(c).cast("string")) != ""), c) for c in NUMBERS]
        said = F.array_join(F.array_compact(F.array(*wrong)), ",")
        marks = [F.when(broken, "line").when(said == "", CLEAN).otherwise(said).alias("mark")]
    return df.select(*[value[c].alias(c) for c in own], *extra, *marks)


def expected_months(present: DataFrame, start: str | None = None, end: str | None = None,
                    col: str = "campaign_month") -> DataFrame:
    """Every month (yyyy-MM) between the bounds; missing bounds are the first and last month present."""
    b = present.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = F.to_date(F.lit(start) if start else F.col("lo"), "yyyy-MM")
    hi = F.to_date(F.lit(end) if end else F.col("hi"), "yyyy-MM")
    return b.select(F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("_m")).select(
        F.date_format("_m", "yyyy-MM").alias(col))


def missing_months(expected: DataFrame, found: DataFrame, col: str = "campaign_month") -> DataFrame:
    """ING9: expected months for which no file is in the plan."""
    return expected.select(col).distinct().join(found.select(col).distinct(), col, "left_anti")
