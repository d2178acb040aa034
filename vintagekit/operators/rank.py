"""Rank-order analytics: tie-aware deciles, quantile deciles, lift, gains, diagnostics.

Input rows are (group columns..., score, bad). Every operator is partitioned by
its group columns (population, read, month ...), so one call covers every
group - no driver loop.

Scale: deciles first aggregate to one row per (group, distinct score) with a
map-side partial aggregate; valid integer scores are bounded (at most
``valid_max - valid_min + 1`` values per group), so the ordered window that
turns cumulative counts into deciles runs on a tiny input instead of a
single-partition sort of all accounts. Real-valued scores have no such bound:
with ``ranges`` the cumulative counts come from ``prefix.RunningSums``, which
spreads each group over that many ranges of all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.config import LIFT_CLEAN, LIFT_WEAK, THIN_READ_ELIGIBLE
from vintagekit.functions.nulls import safe_div
from vintagekit.operators.prefix import RunningSums


def _w(groups: Sequence[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def eligible_pairs(df: DataFrame, cfg, target: str = "target", score: str = "bhvr_score",
                   months: Sequence[str] | None = None, month_col: str = "vintage", mark: str | None = None) -> DataFrame:
    """Eligible, valid-score rows; null target counts as 0; optional month list. ``mark``: all rows stay, and a column of
    this name says which are eligible."""
    eligible = (F.coalesce(F.col("metric_eligible"), F.lit(0)) == 1) & F.col(score).between(cfg.valid_min, cfg.valid_max)
    if mark:
        eligible = F.coalesce(eligible, F.lit(False))
    out = df.withColumn(mark, eligible) if mark else df.filter(eligible)
    if months:
        out = out.filter(F.date_format(F.col(month_col), "yyyy-MM").isin(list(months)))
    return out.withColumn("bad", F.coalesce(F.col(target), F.lit(0)).cast("int"))


def tie_aware_deciles(df: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score",
                      bad: str = "bad", k: int = 10, ranges: int | None = None, count: str | None = None) -> DataFrame:
    """Cumulative-share deciles; equal scores never split across deciles.

    decile = clip(ceil(cum_n / n * k), 1, k), evaluated in exact integer arithmetic.
    ``ranges``: for real-valued scores, the number of ranges their order is spread over.
    ``count``: how many accounts a row stands for, if rows are counts (``bad`` then holds the bad ones).
    Output per (groups, decile): score range, n, bads, bad rate, lift, shares,
    cumulative measures, and the decile-detail bar width (R12).
    """
    groups = list(groups)
    by_score = df.groupBy(*groups, score).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"),
                                              F.sum(F.col(bad).cast("long")).alias("bads"))
    part = _w(groups)
    if ranges:
        by_score = RunningSums(by_score, groups, score, ["n", "bads"], ranges).rows.withColumnRenamed("cum_n", "_cum_n")
    else:
        cum = part.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_score = (by_score.withColumn("_cum_n", F.sum("n").over(cum))
                    .withColumn("total_n", F.sum("n").over(part))
                    .withColumn("total_bads", F.sum("bads").over(part)))
    share = F.expr(f"(_cum_n * {int(k)} + total_n - 1) div total_n")
    by_score = by_score.withColumn("decile", F.least(F.greatest(share, F.lit(1)), F.lit(k)).cast("int"))
    d = by_score.groupBy(*groups, "decile").agg(
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.sum("n").alias("n"), F.sum("bads").alias("bads"),
        F.first("total_n").alias("total_n"), F.first("total_bads").alias("total_bads"))
    cumd = part.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overall = safe_div("total_bads", "total_n")
    d = (d.withColumn("bad_rate", safe_div("bads", "n"))
         .withColumn("lift_vs_overall", safe_div(F.col("bad_rate"), overall))
         .withColumn("pct_population", safe_div("n", "total_n"))
         .withColumn("cum_n", F.sum("n").over(cumd))
         .withColumn("cum_bads", F.sum("bads").over(cumd))
         .withColumn("cum_bad_rate", safe_div("cum_bads", "cum_n"))
         .withColumn("cum_bad_share", safe_div("cum_bads", "total_bads"))
         .withColumn("bar_pct", F.round(F.col("n") * 100.0 / F.max("n").over(part)).cast("int")))
    return d.drop("total_n", "total_bads")


def lift_label(lift: Column) -> Column:
    """Lift bucket: >=2 clean, >=1.5 weak, else not separating; null -> insufficient."""
    return (F.when(lift.isNull(), "insufficient").when(lift >= LIFT_CLEAN, "clean rank-order")
            .when(lift >= LIFT_WEAK, "weak rank-order").otherwise("not separating"))


def d1_d10_lift(deciles: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Bad rate of the first present decile over the last present decile."""
    groups = list(groups)
    g = deciles.groupBy(*groups).agg(
        F.min_by("bad_rate", "decile").alias("d1_bad_rate"),
        F.max_by("bad_rate", "decile").alias("d10_bad_rate"),
        F.count(F.lit(1)).alias("deciles_present"))
    lift = F.when(F.col("d10_bad_rate").isNull() | (F.col("d10_bad_rate") == 0)
                  | F.col("d1_bad_rate").isNull(), F.lit(None).cast("double")).otherwise(
        F.col("d1_bad_rate") / F.col("d10_bad_rate"))
    return g.withColumn("d1_d10_lift", lift).withColumn("lift_label", lift_label(F.col("d1_d10_lift")))


def reversals(deciles: DataFrame, groups: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """Count of decile steps where the bad rate rises by more than ``eps``."""
    groups = list(groups)
    w = _w(groups).orderBy("decile")
    prev = F.lag("bad_rate").over(w)
    flagged = deciles.withColumn("_up", (F.col("bad_rate") > prev + F.lit(eps)).cast("int"))
    return flagged.groupBy(*groups).agg(F.coalesce(F.sum("_up"), F.lit(0)).cast("int").alias("reversals"))


def population_stats(pairs: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score",
                     bad: str = "bad", creditline: str | None = "creditline") -> DataFrame:
    """Eligible count, bads, EDR, average score (and average line) per group."""
    aggs = [F.count(F.lit(1)).alias("eligible"), F.sum(F.col(bad).cast("long")).alias("bads"),
            F.avg(score).alias("avg_score")]
    if creditline:
        aggs.append(F.avg(creditline).alias("avg_creditline"))
    return pairs.groupBy(*groups).agg(*aggs).withColumn("edr", safe_div("bads", "eligible"))


def score_counts(pairs: DataFrame, groups: Sequence[str], score: str = "bhvr_score", bad: str = "bad",
                 creditline: str = "creditline") -> DataFrame:
    """(groups, score, n, bads, line, lines): the counts that deciles, KPIs and lift are all taken from, so that account
    rows are aggregated once."""
    return pairs.groupBy(*groups, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("bads"),
        F.sum(F.col(creditline).cast("double")).alias("line"), F.count(creditline).alias("lines"))


def kpis_of(counts: DataFrame, groups: Sequence[str], k: int = 10, score: str = "bhvr_score") -> DataFrame:
    """R8 from score counts."""
    groups = list(groups)
    stats = counts.groupBy(*groups).agg(
        F.sum("n").alias("eligible"), F.sum("bads").alias("bads"), (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("avg_score"),
        (F.sum("line") / F.sum("lines")).alias("avg_creditline")).withColumn("edr", safe_div("bads", "eligible"))
    lift = d1_d10_lift(tie_aware_deciles(counts, groups, score, "bads", k, count="n"), groups)
    return _join(stats, lift.select(*groups, "d1_d10_lift", "lift_label"), groups, "left")


def kpi_strip(pairs: DataFrame, groups: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Eligible, EDR, bads, D1/D10 lift with label, average score, average line."""
    return kpis_of(score_counts(pairs, groups), groups, k)


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    keys = list(keys)
    if keys:
        return a.join(b, keys, how)
    one = F.lit(1)
    return a.withColumn("_all", one).join(b.withColumn("_all", one), "_all", how).drop("_all")


def read_comparison(pairs: DataFrame, groups: Sequence[str] = ("read_key",), k: int = 10,
                    eps: float = 1e-9) -> DataFrame:
    """Per read eligible, bads, EDR, D1 and last-decile EDR, lift, reversals."""
    groups = list(groups)
    counts = pairs.groupBy(*groups, "bhvr_score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bads"))
    dec = tie_aware_deciles(counts, groups, bad="bads", k=k, count="n")
    lift = d1_d10_lift(dec, groups)
    rev = reversals(dec, groups, eps)
    stats = dec.groupBy(*groups).agg(F.sum("n").alias("eligible"), F.sum("bads").alias("bads")).withColumn("edr", safe_div("bads", "eligible"))
    return (stats.join(lift, groups, "left").join(rev, groups, "left")
            .select(*groups, "eligible", "bads", "edr", "d1_bad_rate", "d10_bad_rate",
                    "d1_d10_lift", "lift_label", "reversals"))


def verdict(pairs: DataFrame, groups: Sequence[str] = (), read_col: str = "read_key", k: int = 10) -> DataFrame:
    """Over all reads - any bad read -> bad; else no clean read or any thin read -> warn."""
    groups = list(groups)
    per_read = read_comparison(pairs, groups + [read_col], k)
    thin = F.col("eligible") < THIN_READ_ELIGIBLE
    g = per_read.groupBy(*groups).agg(
        F.max(thin.cast("int")).alias("any_thin"),
        F.max((~thin & (F.col("lift_label") == "clean rank-order")).cast("int")).alias("any_clean"),
        F.max((~thin & (F.col("lift_label") == "not separating")).cast("int")).alias("any_bad"),
        F.count(F.lit(1)).alias("reads"))
    status = (F.when(F.col("any_bad") == 1, "bad")
              .when((F.col("any_clean") == 0) | (F.col("any_thin") == 1), "warn").otherwise("good"))
    return g.withColumn("verdict", status)


def gains_curve(deciles: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Cumulative population share vs cumulative bad share, with the origin."""
    groups = list(groups)
    part = _w(groups)
    pts = deciles.select(*groups, F.col("decile").alias("point"),
                         (F.col("cum_n") / F.sum("n").over(part)).alias("cum_pop_share"),
                         F.col("cum_bad_share"))
    origin = deciles.select(*groups).distinct().select(
        *groups, F.lit(0).alias("point"), F.lit(0.0).alias("cum_pop_share"), F.lit(0.0).alias("cum_bad_share"))
    return pts.unionByName(origin)


def month_stats(pairs: DataFrame, month_col: str = "vintage", groups: Sequence[str] = ("read_key",),
                k: int = 10) -> DataFrame:
    """Per board month n, bads, rate, average score and D1/D10 lift."""
    keys = list(groups) + [month_col]
    stats = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.col("bad").cast("long")).alias("bads"),
                                     F.avg("bhvr_score").alias("avg_score"))
    lift = d1_d10_lift(tie_aware_deciles(pairs, keys, k=k), keys).select(*keys, "d1_d10_lift")
    return stats.withColumn("bad_rate", safe_div("bads", "n")).join(lift, keys, "left")


def lift_comparison(pairs: DataFrame, groups: Sequence[str] = ("population", "read_key"), k: int = 10) -> DataFrame:
    """Per population eligible, overall rate, first and last decile over it, and the D1/D10 lift with its label."""
    groups = list(groups)
    dec = tie_aware_deciles(pairs, groups, k=k)
    g = dec.groupBy(*groups).agg(F.sum("n").alias("eligible"), safe_div(F.sum("bads"), F.sum("n")).alias("edr"),
                                 F.min_by("lift_vs_overall", "decile").alias("d1_lift"),
                                 F.max_by("lift_vs_overall", "decile").alias("d10_lift"))
    return g.join(d1_d10_lift(dec, groups).select(*groups, "d1_d10_lift", "lift_label"), groups, "left")


def lift_table(pairs: DataFrame, groups: Sequence[str] = ("population", "read_key"), k: int = 10) -> DataFrame:
    """Every decile's rate over its population's overall rate."""
    dec = tie_aware_deciles(pairs, groups, k=k)
    part = _w(list(groups))
    return dec.select(*groups, "decile", "n", "bad_rate", safe_div(F.sum("bads").over(part), F.sum("n").over(part)).alias("edr"),
                      "lift_vs_overall")


def overlay_series(pairs: DataFrame, read: str, reads: Sequence[str], base: str, population: str = "population",
                   read_col: str = "read_key", k: int = 10) -> DataFrame:
    """Decile series of every population on one read: the requested one if the base population has rows on
    it, else the first of ``reads`` on which it has."""
    order = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate([read, *reads]))):
        order = F.when(F.col(read_col) == r, F.lit(i)).otherwise(order)
    dec = tie_aware_deciles(pairs, [population, read_col], k=k).withColumn("_order", order)
    chosen = dec.filter(F.col(population) == base).agg(F.min("_order").alias("_order"))  # one row
    return (dec.join(F.broadcast(chosen), "_order")
            .select(population, read_col, "decile", "score_min", "score_max", "n", "bads", "bad_rate", "cum_bad_rate", "lift_vs_overall"))


# ----------------------------------------------------------------------------
# quantile deciles and the notebook summaries
# ----------------------------------------------------------------------------

def histogram_quantiles(hist: DataFrame, keys: Sequence[str], value: str, count: str,
                        probs: Column) -> DataFrame:
    """Exact linearly interpolated quantiles (numpy/pandas "linear") from a
    (keys, value, count) histogram. ``probs`` is an array column evaluated per
    key group. Returns (keys, p, q). Nothing is buffered per group beyond the
    histogram rows themselves.
    """
    keys = list(keys)
    part = _w(keys)
    ordered = part.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = (hist.withColumn("_hi", F.sum(count).over(ordered))
         .withColumn("_lo", F.col("_hi") - F.col(count))
         .withColumn("_N", F.sum(count).over(part)))
    h = h.withColumn("_probs", probs).select(*keys, value, "_lo", "_hi", "_N",
                                             F.posexplode("_probs").alias("_i", "p"))
    pos = (F.col("_N") - 1) * F.col("p")
    lo_i = F.floor(pos)
    hi_i = F.ceil(pos)
    h = h.withColumn("_pos", pos)
    agg = h.groupBy(*keys, "_i", "p").agg(
        F.max(F.when((lo_i >= F.col("_lo")) & (lo_i < F.col("_hi")), F.col(value))).alias("_xlo"),
        F.max(F.when((hi_i >= F.col("_lo")) & (hi_i < F.col("_hi")), F.col(value))).alias("_xhi"),
        F.first("_pos").alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos")
    return agg.select(*keys, "_i", "p",
                      (F.col("_xlo").cast("double") + frac * (F.col("_xhi") - F.col("_xlo")).cast("double"))
                      .alias("q"))


def quantile_deciles(df: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score",
                     bad: str = "bad", k: int = 10) -> DataFrame:
    """R2: value-quantile deciles with interpolated edges, duplicate edges dropped,
    right-closed bins (first bin closed on the left), k = min(k, distinct scores).

    Edges are exact interpolated quantiles computed from the per-group score
    histogram; the bin of a score is the number of distinct edges strictly
    below it, minus one (floored at 0), so bin numbers can skip as with
    interpolated cuts. Bins are assigned on the histogram (one row per distinct
    score) and joined back, so no group is ever buffered whole.
    """
    groups = list(groups)
    hist = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"),
                                          F.sum(F.col(bad).cast("long")).alias("_bads"))
    kcol = F.least(F.count(F.lit(1)).over(_w(groups)), F.lit(k))
    hist = hist.withColumn("_k", kcol)
    probs = F.transform(F.sequence(F.lit(0), F.col("_k")), lambda i: i / F.col("_k"))
    edges = histogram_quantiles(hist, groups, score, "_n", probs)
    edges = edges.groupBy(*groups).agg(F.array_sort(F.collect_set("q")).alias("_edges"))
    binned = _join(hist, edges, groups, "inner")
    x = F.col(score).cast("double")
    below = F.size(F.filter(F.col("_edges"), lambda e: e < x))
    b = F.when(F.col("_k") <= 1, F.lit(0)).otherwise(F.greatest(below - 1, F.lit(0)))
    binned = binned.withColumn("score_decile", (b + 1).cast("int"))
    g = _bins(binned, groups, score)
    med = histogram_quantiles(binned, groups + ["score_decile"], score, "_n", F.array(F.lit(0.5)))
    g = g.join(med.select(*groups, "score_decile", F.col("q").alias("score_median")),
               groups + ["score_decile"], "left")
    return _bin_rates(g, groups, k)


def _bins(binned: DataFrame, groups: list[str], score: str) -> DataFrame:
    return binned.groupBy(*groups, "score_decile").agg(
        F.sum("_n").alias("n"), F.sum("_bads").alias("bads"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        (F.sum(F.col(score) * F.col("_n")) / F.sum("_n")).alias("score_mean"))


def quantile_deciles_ranged(df: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score",
                            bad: str = "bad", k: int = 10, ranges: int = 200) -> DataFrame:
    """R2 for real-valued scores: the same rows, with edges, bins and medians from one set of running sums. The
    distinct scores are spread over ``ranges``; nothing but k bins a group is ever ordered in one task."""
    groups = list(groups)
    hist = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(bad).cast("long")).alias("_bads"))
    run = RunningSums(hist, groups, score, ["_n"], ranges)
    parts = F.least("total_rows", F.lit(k))
    probs = F.transform(F.sequence(F.lit(0).cast("long"), parts), lambda i: (F.col("total__n") - 1) * (i / parts))
    edges = run.at(run.rows, "_n", probs).groupBy(*groups).agg(F.array_sort(F.collect_set("q")).alias("_edges"))
    rows = run.with_group(run.rows, edges)
    x = F.col(score).cast("double")
    below = F.size(F.filter("_edges", lambda e: e < x))
    bin_ = F.when(parts <= 1, F.lit(0)).otherwise(F.greatest(below - 1, F.lit(0))) + 1
    binned = rows.withColumn("score_decile", bin_.cast("int"))
    g = _bins(binned, groups, score)
    last = F.sum("n").over(_w(groups).orderBy("score_decile").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = g.withColumn("_last", last).groupBy(*groups).agg(F.map_from_entries(F.collect_list(
        F.struct("score_decile", (F.col("_last") - F.col("n") + (F.col("n") - 1) * 0.5).alias("p")))).alias("_middle"))
    placed = run.with_group(binned, middle)
    med = run.at(placed, "_n", F.array(F.col("_middle")[F.col("score_decile")]), ["score_decile"])
    med = med.select(*groups, F.col("score_decile"), F.col("q").alias("score_median"))
    return _bin_rates(_join(g, med, [*groups, "score_decile"], "left"), groups, k)


def _bin_rates(g: DataFrame, groups: list[str], k: int) -> DataFrame:
    part = _w(groups)
    cum = part.orderBy("score_decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overall = F.sum("bads").over(part) / F.sum("n").over(part)
    return (g.withColumn("goods", F.col("n") - F.col("bads"))
            .withColumn("bad_rate", safe_div("bads", "n"))
            .withColumn("lift_vs_overall", F.when(overall == 0, F.lit(None)).otherwise(F.col("bad_rate") / overall))
            .withColumn("pct_population", F.col("n") / F.sum("n").over(part))
            .withColumn("cum_n_low_to_high", F.sum("n").over(cum))
            .withColumn("cum_bads_low_to_high", F.sum("bads").over(cum))
            .withColumn("cum_bad_rate_low_to_high", F.col("cum_bads_low_to_high") / F.col("cum_n_low_to_high"))
            .withColumn("actual_deciles", F.count(F.lit(1)).over(part).cast("int"))
            .withColumn("requested_deciles", F.lit(k)))


def overall_summary(marked: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score", mark: str = "eligible") -> DataFrame:
    """Scored rows, eligible rows, bads, rate, score min/max/mean per group, from all rows in one pass; ``mark`` says
    which are eligible (``eligible_pairs``)."""
    groups = list(groups)

    def of_eligible(c: str) -> Column:
        return F.when(F.col(mark), F.col(c))

    out = marked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_scored_rows"), F.count(F.when(F.col(mark), 1)).alias("eligible_rows"),
        F.coalesce(F.sum(of_eligible("bad").cast("long")), F.lit(0)).alias("bads"),
        F.min(of_eligible(score)).alias("score_min"), F.max(of_eligible(score)).alias("score_max"), F.avg(of_eligible(score)).alias("score_mean"))
    return out.withColumn("rate", safe_div("bads", "eligible_rows"))


def segment_tables(pairs: DataFrame, groups: Sequence[str] = (), score: str = "bhvr_score") -> DataFrame:
    """Tables by program and by channel in one aggregation (grouping sets);
    the null group of each dimension is kept."""
    groups = list(groups)
    sets = [[*groups, "program_code"], [*groups, "channel"]]
    out = pairs.groupingSets(sets, *groups, "program_code", "channel").agg(
        F.grouping("program_code").alias("_gp"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bads"),
        F.avg(score).alias("score_mean"))
    is_prog = F.col("_gp") == 0
    return out.select(*groups, F.when(is_prog, "program_code").otherwise("channel").alias("segment"),
                      F.when(is_prog, F.col("program_code")).otherwise(F.col("channel")).alias("value"),
                      "n", "bads", "score_mean", safe_div("bads", "n").alias("bad_rate"))


def rank_diagnostics(deciles: DataFrame, groups: Sequence[str] = (), decile: str = "score_decile") -> DataFrame:
    """Spearman(decile, bad rate) on average ranks, strict reversals, Pass/Review."""
    groups = list(groups)
    part = _w(groups)
    d = deciles.withColumn("_r_dec", F.rank().over(part.orderBy(decile))
                           + (F.count(F.lit(1)).over(_w(groups + [decile])) - 1) / 2.0)
    d = d.withColumn("_r_rate", F.rank().over(part.orderBy("bad_rate"))
                     + (F.count(F.lit(1)).over(_w(groups + ["bad_rate"])) - 1) / 2.0)
    d = d.withColumn("_up", (F.col("bad_rate") > F.lag("bad_rate").over(part.orderBy(decile))).cast("int"))
    pearson = safe_div(F.covar_pop("_r_dec", "_r_rate"), F.stddev_pop("_r_dec") * F.stddev_pop("_r_rate"))
    g = d.groupBy(*groups).agg(pearson.alias("spearman_decile_bad_rate"),
                               F.coalesce(F.sum("_up"), F.lit(0)).cast("int").alias("monotonic_violations"),
                               F.count(F.lit(1)).alias("_n"))
    enough = F.col("_n") >= 2
    return g.select(
        *groups,
        F.when(enough, F.col("spearman_decile_bad_rate")).alias("spearman_decile_bad_rate"),
        F.when(enough, F.col("monotonic_violations")).alias("monotonic_violations"),
        F.when(~enough, "Not enough deciles")
        .when((F.col("monotonic_violations") == 0) & (F.col("spearman_decile_bad_rate") < 0), "Pass")
        .otherwise("Review rank-order bumps").alias("note"))
