"""Raw program entries to functions with their name maps, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivar.functions.names import col, interesting_function, interesting_name, let, long_enough, mentions
from lexivar.operators.relational import last_wins


def at_position(entries: Column, pos: Column) -> Column:
    return F.try_element_at(F.filter(entries, lambda x: x["pos"] == pos), F.lit(1))["name"]


def last_values(pairs: Column) -> Column:
    """Pairs (k, v) as a map that keeps order: each key where it stands first, with the value it has last."""
    of = lambda p, k: F.try_element_at(F.filter(p, lambda e: e["k"] == k), F.lit(-1))["v"]
    return let(pairs, lambda p: F.transform(F.array_distinct(F.transform(p, lambda e: e["k"])), lambda k: F.struct(k.alias("k"), of(p, k).alias("v"))))


def variable_names(gt: str, stripped: str) -> Column:
    """Placeholder to true name by position: arguments, then locals, whose truth falls back on the argument at that place; only names that are worth it and differ."""
    args, places = col(f"{gt}.args"), col(f"{gt}.locals")
    pair = lambda name, truth: F.struct(name.alias("k"), truth.alias("v"))
    of_args = F.transform(col(f"{stripped}.args"), lambda a: pair(a["name"], at_position(args, a["pos"])))
    of_locals = F.transform(col(f"{stripped}.locals"), lambda a: pair(a["name"], F.coalesce(at_position(places, a["pos"]), at_position(args, a["pos"]))))
    good = lambda e: e["v"].isNotNull() & interesting_name(e["v"]) & (e["v"] != e["k"])
    return last_values(F.filter(F.concat(of_args, of_locals), good))


def retained(raw: DataFrame) -> DataFrame:
    """The entries worth a name, one for each placeholder of a program: the last."""
    rows = raw.where(interesting_function("gt.name") & long_enough("stripped.code") & F.col("stripped.name").isNotNull()).withColumn("func_name", F.col("stripped.name"))
    return last_wins(rows, ["prog_name", "func_name"], ["func_seq"])


def met_by_name(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows(prog_name, at, ...) with `value` of the row with at = -1 of the same program and key, null where there is none: a join of a table with itself that reads it once.

    Rows that are partitioned by program stay where they are.
    """
    first = W.partitionBy("prog_name", key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(value, F.when(F.col("prog_name").isNotNull(), F.first(F.when(F.col("at") < 0, F.col(value))).over(first)))


def functions_of(raw: DataFrame, prefix: str = "sub_", columns: Sequence[str] = ("func_seq", "body", "var_ids")) -> DataFrame:
    """(prog_name, func_name, func_seq, body, var_ids, func_ids) of functions with a name to recover; func_ids: functions mentioned in the code whose true name differs, in order of first mention.

    `columns`: those of func_seq, body and var_ids that are wanted. Each function becomes a row of its own, which holds its columns and its true name, and a row for
    each mention; names meet mentions, and mentions their function, by sorts within programs.
    """
    x = retained(raw).withColumn("body", F.col("stripped.code")).withColumn("var_ids", variable_names("gt", "stripped"))
    own = F.struct(*columns, (F.size("var_ids") > 0).alias("any"))
    row = lambda at, k, v, o: F.struct(at.cast("int").alias("at"), k.alias("k"), v.cast("string").alias("v"), o.cast(kind).alias("own"))
    kind = x.select(own.alias("o")).schema["o"].dataType
    said = F.transform(F.array_distinct(mentions("body", prefix)), lambda k, i: row(i, k, F.lit(None), F.lit(None)))
    rows = F.concat(F.array(row(F.lit(-1), F.col("func_name"), F.col("gt.name"), own)), said)
    x = met_by_name(x.select("prog_name", "func_name", F.inline(rows)), "k", "v").where("at < 0 or v <> k")
    of = W.partitionBy("prog_name", "func_name").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ids = F.collect_list(F.when(F.col("at") >= 0, F.struct("k", "v"))).over(of)
    x = x.withColumn("func_ids", F.when(F.col("at") < 0, F.reverse(ids))).where("at < 0 and (own.any or size(func_ids) > 0)")
    return x.select("prog_name", "func_name", *[f"own.{c}" for c in columns], "func_ids")


def known_as(functions: DataFrame) -> DataFrame:
    """functions with `known`: the true name where the function's own id is mapped, else the placeholder; main is left out."""
    own = F.try_element_at(F.filter("func_ids", lambda e: e["k"] == F.col("func_name")), F.lit(1))["v"]
    return functions.withColumn("known", F.coalesce(own, F.col("func_name"))).where("known <> 'main'")
