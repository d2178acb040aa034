"""Mixing sources to target word shares by pivotal dependent rounding, in DataFrame functions only.

Targets. The weights of the sources (by code point, null last) repeat 3, 1, 2; together they share
150 % of all words. No source gets more than twice its size: what is over is shared again by weight
among the others until none is above.

Copies. A source's documents should be taken r = target / size times each. The whole part of r
goes to every document, the rest is a copy probability. Two documents with fractional probabilities
meet: words of probability move from one to the other, in a random direction weighted so that
the expectation of each stays, until one of them is 0 or 1. The words of both together do not
change, so a source misses its target by less than one document. The meetings form a tree: documents
are dealt by hash to groups of about ``FAN`` and folded within their group (longest first), each group passes on the
one document that is still fractional, and the groups are folded again until each source has one
left, which is rounded at random. No task holds more than a group; a source with a third of the
rows is just more groups. Rows equal in id, source, size and text are one unit with a count, taken
together and split evenly, so copies of one row cannot fill a group either.

All random choices come from hashes of ids, sources, sizes and texts: reruns agree, whatever the
partitions.

Cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own; an
empty table gives an empty table; if all texts are empty all targets are 0; repeated rows each get
their share; only id, source and text are read by :func:`mix_report`, so other columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.llm.common import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FAN = 64
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "struct<doc_id:{id},source:string,size:bigint,n:bigint,uid:bigint,ratio:double,source_size:bigint,target:double,whole:bigint,p:double>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size). One row per source; the ranks come
    from one window over the sources, not over documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("rank") % len(weights) == i, F.lit(w)).otherwise(weight)
    ranked = stage(ranked.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    room = F.lit(most) * F.col("source_size")
    rate = None
    while True:  # sources over their limit are fixed at it; the rest is shared again by weight
        capped = F.lit(False) if rate is None else F.lit(rate) * F.col("weight") >= room
        row = ranked.agg(F.sum(F.when(capped, room)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        now = (share * total - (row["fixed"] or 0.0)) / row["open"] if row["open"] else 0.0
        if rate is not None and (not row["open"] or now <= rate):
            break
        rate = now
    target = F.least(F.lit(float(rate or 0.0)) * F.col("weight"), room)
    return ranked.select("source", "source_size", target.alias("target"))


def _units(docs: DataFrame) -> DataFrame:
    """Equal rows (id, source, size, text) as one unit with their number n."""
    return (docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("k_text"))
            .groupBy("doc_id", "source", "size", "k_text").agg(F.count("*").alias("n")))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def _meet(a: Column, b: Column) -> tuple[Column, Column]:
    """Probabilities of two units after words of probability moved; one of them is 0 or 1. Column
    ``size`` counts a unit's words."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])       # words that can move to a
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])     # words that can move to b
    to_a = _uniform(a["uid"], b["uid"]) * (up + down) < down
    a_full, b_empty = (1 - a["p"]) * a["size"] <= b["p"] * b["size"], b["p"] * b["size"] <= (1 - a["p"]) * a["size"]
    a_empty, b_full = a["p"] * a["size"] <= (1 - b["p"]) * b["size"], (1 - b["p"]) * b["size"] <= a["p"] * a["size"]
    pa = F.when(to_a, F.when(a_full, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(
        F.when(a_empty, 0.0).otherwise(a["p"] - down / a["size"]))
    pb = F.when(to_a, F.when(b_empty, 0.0).otherwise(b["p"] - up / b["size"])).otherwise(
        F.when(b_full, 1.0).otherwise(b["p"] + down / b["size"]))
    return pa, pb


def _open(p: Column) -> Column:
    return (p > 0.0) & (p < 1.0)


def _fold(units: Column, names: list[str], kind: str) -> Column:
    """Fold a group's units: struct of the decided ones and the one still open (null if none)."""
    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        pa, pb = _meet(a, x)
        with_p = lambda u, p: F.struct(*[u[c].alias(c) for c in names if c != "p"], p.alias("p"))
        a2, b2 = with_p(a, pa), with_p(x, pb)
        none = F.lit(None).cast(kind)
        met = F.struct(
            F.concat(state["done"], F.when(_open(pa), F.array(b2)).when(_open(pb), F.array(a2)).otherwise(F.array(a2, b2))).alias("done"),
            F.when(_open(pa), a2).when(_open(pb), b2).otherwise(none).alias("open"))
        return (F.when(~_open(x["p"]), F.struct(F.concat(state["done"], F.array(x)).alias("done"), a.alias("open")))
                .when(a.isNull(), F.struct(state["done"].alias("done"), x.alias("open")))
                .otherwise(met))

    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    return F.aggregate(units, empty, step)


def mix(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Per unit of equal rows: doc_id, source, size (one row's words), n (rows), source_size, target,
    copies (of all n rows together)."""
    units = stage(_units(docs), "units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    by_source = stage(by_source, "source-sizes")
    targets = source_targets(by_source.select("source", "source_size"))
    per = (targets.withColumnRenamed("source", "s").join(
        by_source.select(F.col("source").alias("b"), "units"), F.col("s").eqNullSafe(F.col("b"))).drop("b"))
    per = stage(per, "targets")
    most = per.agg(F.max("units")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.col("n") * F.col("ratio")
    # all n rows of a unit together: whole copies, and one more with probability p
    level = (units.join(per, units["source"].eqNullSafe(per["s"])).drop("s")
             .withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(F.lit(0.0)))
             .withColumn("uid", F.xxhash64("doc_id", F.col("source"), "size", "k_text"))
             .withColumn("whole", F.floor(copies).cast("long")).withColumn("p", copies - F.floor(copies)))
    names = ["doc_id", "source", "size", "n", "uid", "ratio", "source_size", "target", "whole", "p"]
    kind = _UNIT.format(id=docs.schema["doc_id"].dataType.simpleString())
    groups = F.greatest(F.ceil(F.col("units") / F.lit(fan)), F.lit(1)).cast("long")
    level = level.select("source", F.pmod(F.xxhash64("uid", F.lit(SEED)), groups).alias("node"), F.struct(*names).cast(kind).alias("u"))
    decided, nodes, depth = None, -(-most // fan), 0
    while True:
        folded = (level.groupBy("source", "node").agg(F.sort_array(F.collect_list(F.struct((-F.col("u.size")).alias("size"), F.col("u.uid").alias("uid"), "u"))).alias("us"))
                  .select("source", "node", _fold(F.transform("us", lambda x: x["u"]), names, kind).alias("f")))
        folded = stage(folded.select("source", "node", "f.done", "f.open"), f"level{depth}")
        done = folded.select(F.explode("done").alias("u"))
        decided = done if decided is None else decided.unionByName(done)
        left = folded.where("open is not null")
        if nodes <= 1:
            break
        nodes, depth = -(-nodes // fan), depth + 1
        level = left.select("source", F.floor(F.col("node") / F.lit(fan)).cast("long").alias("node"), F.col("open").alias("u"))
    last = left.select(F.col("open").alias("u")).select("u.*")
    last = last.withColumn("p", F.when(_uniform(F.col("uid")) < F.col("p"), 1.0).otherwise(0.0))
    return (decided.select("u.*").unionByName(last)
            .select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies")))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    units = mix(docs)
    each = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.expr("copies div n") + F.when(F.col("i") <= F.expr("copies % n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * own).cast("long").alias("taken"))
