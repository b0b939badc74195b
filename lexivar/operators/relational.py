"""Deduplication, splits, last-wins, voting, evaluation: windows, joins and aggregates that Catalyst plans.

No side is broadcast by a hint: Spark does so itself where files or finished stages show it to be under its threshold, and joins by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = (0, 10, 100, 1000, 999999)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key, the last in order: a group limit drops most rows before the shuffle, then each key's rows are ranked."""
    down = [F.col(c).desc_nulls_last() if isinstance(c, str) else c.desc_nulls_last() for c in order]
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*down))).where("__rank = 1").drop("__rank")


def common_keys(rows: DataFrame, keys: Sequence[str], systems: Sequence[str]) -> DataFrame:
    """One row a key that every system has, with the greatest value of each: columns of systems are null where a row is not theirs."""
    out = rows.groupBy(*keys).agg(*[F.max(s).alias(s) for s in systems])
    return out.where(" and ".join(f"`{s}` is not null" for s in systems))


def enforced(df: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """df with the dimension's column; a row whose key the dimension lacks is an error, not a row that goes."""
    joined = df.join(dimension.select(key, F.struct(column).alias("__found")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{key} without an entry: "), F.col(key).cast("string")))
    return joined.withColumn(column, F.when(F.col("__found").isNull(), missing.cast(dimension.schema[column].dataType)).otherwise(F.col(f"__found.{column}"))).drop("__found")


def combine_files(rounds: Sequence[tuple[str, DataFrame]], keys: Sequence[str], order: str, fields: Sequence[str], name: str = "name_list") -> DataFrame:
    """(keys, name): candidates of all rounds as one list a key, by round and then by `order`. rounds: (path, rows); a path that stood before is left out."""
    first: dict[str, DataFrame] = {}
    for path, df in rounds:
        first.setdefault(path, df)
    parts = [df.select(*keys, F.lit(i).alias("src_seq"), F.lit(path).alias("src"), order, *fields) for i, (path, df) in enumerate(first.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return ordered_lists(every, keys, ["src_seq", order], [*fields, "src"], name)


def first_seen_programs(funcs: DataFrame, prog: str, name: str, order: Sequence[str], share: float = 0.7) -> DataFrame:
    """(prog, n_new, n_total) of programs that bring more than `share` of new function names, in the order of the rows.

    A name is new where it stands first over all programs, rejected ones included.
    """
    seq = F.struct(*order)
    first = funcs.groupBy(name).agg(F.min(F.struct(seq.alias("s"), F.col(prog).alias("p")))["p"].alias("__p"))
    new = first.groupBy(F.col("__p").alias(prog)).agg(F.count(F.lit(1)).alias("n_new"))
    total = funcs.groupBy(prog).agg(F.count(F.lit(1)).alias("n_total"))
    return total.join(new, prog, "left").na.fill(0, ["n_new"]).where(F.col("n_new") > F.col("n_total") * F.lit(share)).select(prog, "n_new", "n_total")


def hash_split(df: DataFrame, key: str, train: float = 0.9) -> DataFrame:
    """A deterministic split by the key's hash: no global order, and the same at every size."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
    return df.withColumn("split", F.when(bucket < int(train * 1000), "train").otherwise("test"))


def permuted_split(df: DataFrame, key: str, train: float = 0.9, seed: int = 42) -> DataFrame:
    """df(key, distinct) with `split`: a seeded permutation, in the order of a hash of key and seed, cut so that int(train * n) rows are `train`.

    The row at the cut is found by a sort over all tasks; no task holds all rows.
    """
    x = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))))
    cut = int(x.count() * train)
    edge = x.orderBy("__h", F.desc(key)).offset(cut).limit(1).collect()
    if not edge:
        return x.drop("__h").withColumn("split", F.lit("train"))
    before = (F.col("__h") < edge[0]["__h"]) | ((F.col("__h") == edge[0]["__h"]) & (F.col(key) > F.lit(edge[0][key])))
    return x.withColumn("split", F.when(before, "train").otherwise("test")).drop("__h")


def freq_bins(rows: DataFrame, freq: str, measures: Sequence[str], bins: Sequence[int] = BINS) -> DataFrame:
    """Means in the bins (-1, 0], (0, 10], ...; an empty bin stays, with nulls; what is above the last bin has none."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(b,) for b in bins], "upper long")
    upper = F.coalesce(*[F.when(F.col(freq) <= b, F.lit(b).cast("long")) for b in bins])
    means = rows.withColumn("upper", upper).where(F.col("upper").isNotNull()).groupBy("upper").agg(*[F.avg(F.nanvl(m, F.lit(None).cast("double"))).alias(m) for m in measures], F.count(F.lit(1)).alias("n"))
    return edges.join(means, "upper", "left").na.fill(0, ["n"])


def mode_first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, mode, share): the most frequent value, ties to the first seen."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


def macro_mean(rows: DataFrame, program: str, group: str | None, measures: Sequence[str]) -> DataFrame:
    """Mean a program, then mean over programs (by group): two aggregates that do not collapse."""
    keys = [program] + ([group] if group else [])
    per = rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("n"))
    out = [F.avg(m).alias(m) for m in measures] + [F.count(F.lit(1)).alias("n_programs"), F.sum("n").alias("n")]
    return per.groupBy(group).agg(*out) if group else per.agg(*out)


def ordered_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "items") -> DataFrame:
    got = F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return df.groupBy(*keys).agg(got.alias(name))


def positions(df: DataFrame, order: Sequence[str], first: int = 0, last: int | None = None) -> DataFrame:
    """The rows at the positions first to last (from 0, both included) in order; without bounds all rows, and nothing is sorted."""
    if first <= 0 and last is None:
        return df
    x = df.orderBy(*order).offset(max(first, 0))
    return x if last is None else x.limit(max(last - max(first, 0) + 1, 0))


def new_rows(df: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a keyed, resumable append still has to write."""
    return df.join(written.select(*keys).distinct(), list(keys), "left_anti")
