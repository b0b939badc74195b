"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Every document gets a rate: how often the mix takes it. Among all rates from 0 to `cap`, entropy
balancing picks those of least relative entropy to "every document once" under one constraint for each
source: the rates times the sizes add up to the source's target of words. The dual is convex in one
multiplier a source, and the rates are min(cap, exp(multiplier * size / mean size)). Newton steps on the dual,
kept inside a bracket, run as aggregations over the distinct (source, size) pairs, then rates are rounded to whole copies with the
error carried from long to short documents in blocks of about BLOCK documents.

Rows of one source, id and size cannot be told apart in the result, so they are one entry with a multiplicity until the copies are set: an
id, null included, that holds a third of all rows is a few entries, aggregated before any shuffle; its rows are dealt the entry's copies as evenly
as whole numbers allow. Windows run over one row a source, after aggregation.

Rows: a null text or one without words has size 0 and takes nothing. A null source is a source of its own, last in
order. Rows that share an id are kept, each with its own copies. An empty table gives an empty result. Only the id,
source and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 256
CHUNK = 1_000_000


def word_count(text: str):
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, weight, source_size, target): the total shared by weight, each stopped at cap times its size.

    The windows run over one row for each source, after aggregation. With sources in order of cap * size / weight the
    stopped ones are a prefix, so the level that the others share follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    shared = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return per.withColumn("target", F.least("most", F.coalesce(shared * F.col("weight"), "most"))).select("source", "weight", "source_size", "docs", "target")


def multipliers(scratch: Scratch, hist: DataFrame, targets: DataFrame, cap: float = CAP, rounds: int = 60, tol: float = 1e-6) -> DataFrame:
    """(source, lam, mean): the dual solution for each source. hist: (source, size, n)."""
    # A bracket: at lo the rates give less than any target above 0, at hi the smallest document is at the cap.
    start = (
        hist.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "mean", "target", F.lit(0.0).alias("lam"), (-F.lit(50.0) * F.col("mean") / F.col("least")).alias("lo"), (F.lit(math.log(cap)) * F.col("mean") / F.col("least")).alias("hi"), F.lit(False).alias("done"))
    )
    state = scratch.save(start, "dual-0")
    for i in range(1, rounds + 1):
        z = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(math.log(cap))))
        mass = F.col("n") * F.col("size") * tilt
        seen = hist.where("size > 0").withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
        sums = seen.groupBy("source").agg(F.sum(mass).alias("got"), F.sum(F.when(F.col("lam") * z < math.log(cap), mass * z).otherwise(0.0)).alias("slope"))
        x = state.withColumnRenamed("source", "s").join(sums, F.col("s").eqNullSafe(F.col("source")))
        over = F.col("got") - F.col("target")
        done = (F.abs(over) <= F.col("target") * tol) | (F.col("hi") - F.col("lo") <= 1e-13 * (F.abs("lo") + F.abs("hi")))
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        # Newton on the logarithm of the constraint, which is closer to a line in the multiplier.
        step = F.col("lam") - F.when(F.col("slope") > 0, F.col("got") * F.log(F.col("got") / F.col("target")) / F.col("slope"))
        x = x.select("source", "mean", "target", "lam", lo.alias("lo"), hi.alias("hi"), done.alias("done"), step.alias("step"))
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        nxt = F.when(F.col("done"), F.col("lam")).when(inside, F.col("step")).when(F.col("step") >= F.col("hi"), F.col("hi")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = scratch.save(x.select("source", "mean", "target", nxt.alias("lam"), "lo", "hi", (F.col("done") | (nxt == F.col("lam"))).alias("done")), f"dual-{i}")
        scratch.drop(f"dual-{i - 1}")
        if state.where(~F.col("done")).isEmpty():
            break
    # Sums of floating numbers depend on their order in the last digits; without those, reruns give the same rates and copies.
    return state.select("source", "mean", F.round("lam", 10).alias("lam"))


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(id_col, source, size, source_size, target, rate, copies, taken) for each row of docs."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    hist = scratch.save(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    targets = scratch.save(source_targets(sizes, weights, cap), "targets")
    dual = multipliers(scratch, hist, targets, cap)
    plan = targets.join(dual.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("of"), "source_size", "target", "docs", "mean", "lam")
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))).otherwise(F.lit(0.0))
    entries = sizes.where("size > 0").groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("id", "size"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)))
    rated = entries.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "n", "source_size", "target", F.least(rate, F.lit(cap)).alias("rate"), block.alias("block"))
    # Within a block, from the longest document down: an entry's copies are n times the rate rounded down or up, whichever brings the running sum of words closer to that of rates.
    due = "(acc.due + r.rate * r.size * r.n)"
    copies = f"cast(least(greatest(round(({due} - acc.got) / greatest(r.size, 1)), floor(r.rate * r.n + 1e-9)), least(ceil(r.rate * r.n - 1e-9), {cap}D * r.n)) as long)"
    fold = F.expr(
        f"""aggregate(rows, named_struct('due', 0D, 'got', 0D, 'out', cast(array() as array<long>)), (acc, r) -> named_struct(
              'due', {due}, 'got', acc.got + r.size * {copies}, 'out', concat(acc.out, array({copies}))), acc -> acc.out)"""
    )
    blocks = rated.groupBy("source", "source_size", "target", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("down"), F.col("id"), F.col("size"), F.col("n"), F.col("rate")))).alias("rows"))
    out = blocks.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", fold.alias("copies"))).alias("x"))
    out = out.select("source", "source_size", "target", "x.rows.id", "x.rows.size", "x.rows.rate", F.col("x.rows.n").alias("n"), F.col("x.copies").alias("all_copies"))
    out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    if not entries.where(F.col("n") > CHUNK).isEmpty():
        out = out.repartition("id", "chunk")
    out = out.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK))))
    copies = (F.floor(F.col("all_copies") / F.col("n")) + F.when(F.col("i") <= F.col("all_copies") % F.col("n"), 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", copies)
    out = out.select("id", "source", "size", "source_size", "target", "rate", "copies")
    nothing = sizes.where("size = 0").join(plan, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return out.unionByName(nothing).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op1_entropy_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return entropy_mix(table(spark, sf_dir, "documents"))
