"""Preference pairs: the best composed answer of a function beside a worse one that it was composed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivar.functions.answers import render_map
from lexivar.functions.names import demangled, f1, score_name

#: Below the first a function is hopeless, below the second a name is; a name is interesting if it is worse than the best by more than the third.
HOPELESS, SKIPPED, MARGIN = 0.2, 0.4, 0.1


def distinct_answers(entries: DataFrame) -> DataFrame:
    """Entries with variables and at least two distinct answers that name every variable."""
    ids = F.array_sort(F.transform("var_ids", lambda e: e["k"]))
    named = F.transform("answers", lambda a: F.transform(ids, lambda i: F.try_element_at(a["names"], i)))
    whole = F.array_distinct(F.transform(F.filter(named, lambda n: F.forall(n, lambda x: x.isNotNull())), lambda n: F.array_join(n, "#")))
    return entries.where((F.size("var_ids") > 0) & (F.size(whole) > 1))


def preference_pairs(entries: DataFrame, prefix: str = "sub_", filter_data: bool = True) -> DataFrame:
    """entries(prog_name, func_name, var_ids, func_ids, answers array<struct<pos, names map>>) -> (prog_name, func_name, rank, chosen, rejected, gt, chosen_score, rejected_score, interesting).

    chosen: of each id the best name of all answers (by F1, the later answer of equals), in the order of variables and functions. rejected, rank 1: the worst answer by
    the means of its variables' and functions' F1, the first of equals, if it names all ids that have a best name. rank 2: the best answer, from the best down, that names them all, differs
    from both, and with filter_data scores below the chosen one. Functions whose best names are all poor give nothing; interesting are the ids that can be bettered. With
    filter_data pairs whose chosen score is not the greater go.
    """
    key = ["prog_name", "func_name"]
    some = distinct_answers(entries)
    ids = some.select(*key, F.posexplode(F.concat("var_ids", "func_ids")).alias("at", "e")).select(*key, "at", F.col("e.k").alias("id"), F.col("e.v").alias("gt"))
    said = some.select(*key, F.explode("answers").alias("a")).select(*key, F.col("a.pos").alias("pos"), F.explode("a.names").alias("id", "name"))
    every = some.select(*key, F.explode("answers.pos").alias("pos"))
    rows = ids.join(said, [*key, "id"]).withColumn("s", score_name("gt", "name")).withColumn("f1", f1("s.precision", "s.recall")).drop("s").withColumn("var", ~F.startswith("id", F.lit(prefix)))
    best = rows.groupBy(*key, "at", "id", "gt", "var").agg(F.max_by("name", F.struct("f1", "pos")).alias("best"), F.max("f1").alias("top"))
    score = F.coalesce(F.avg(F.when(F.col("var"), F.col("top"))), F.lit(None).cast("double"))
    head = best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "id", "best", "top"))).alias("bests"), score.alias("chosen_score")).where(F.col("chosen_score") >= HOPELESS)
    shown = F.when(F.startswith("id", F.lit(prefix)), demangled("gt")).otherwise(F.col("gt"))
    truth = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", F.col("id").alias("k"), shown.alias("v")))).alias("gt"))
    mean = lambda own: F.coalesce(F.avg(F.when(F.col("var") == own, F.col("f1"))), F.lit(0.0))
    answers = rows.groupBy(*key, "pos").agg(mean(True).alias("v"), mean(False).alias("f"), F.sort_array(F.collect_list(F.struct("at", "id", "name", "f1"))).alias("names"))
    answers = every.join(answers, [*key, "pos"], "left").na.fill(0.0, ["v", "f"])
    none = F.array().cast("array<struct<at:int,id:string,name:string,f1:double>>")
    ordered = answers.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("v", "f", "pos", F.coalesce("names", none).alias("names")))).alias("order"))
    x = head.join(ordered, key).join(truth, key)
    pairs = lambda names: F.transform(names, lambda e: F.struct(e["id"].alias("k"), e["name"].alias("v")))
    x = x.withColumn("chosen", F.transform("bests", lambda e: F.struct(e["id"].alias("k"), e["best"].alias("v")))).withColumn("worst", F.element_at("order", 1))
    complete = lambda a: F.size(a["names"]) == F.size("bests")
    # From the best answer down; the worst, which stands first, is not among them.
    down = F.reverse(F.slice("order", 2, F.greatest(F.size("order") - 1, F.lit(0))))
    below = (lambda a: a["v"] < F.col("chosen_score")) if filter_data else (lambda a: F.lit(True))
    second = F.try_element_at(F.filter(down, lambda a: complete(a) & below(a) & (pairs(a["names"]) != pairs(F.col("worst.names"))) & (pairs(a["names"]) != F.col("chosen"))), F.lit(1))
    x = x.withColumn("second", second)
    both = F.array(F.when(complete(F.col("worst")), F.struct(F.lit(1).alias("rank"), F.col("worst").alias("a"))), F.when(F.col("second").isNotNull(), F.struct(F.lit(2).alias("rank"), F.col("second").alias("a"))))
    x = x.select(*key, "chosen", "chosen_score", "bests", "gt", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e"))
    top = lambda i: F.filter("bests", lambda b: b["id"] == i)[0]["top"]
    worse = F.filter("e.a.names", lambda n: (top(n["id"]) >= SKIPPED) & (n["f1"] + MARGIN < top(n["id"])))
    out = x.select(
        *key, "e.rank", F.concat(F.lit(":"), render_map("chosen")).alias("chosen"), F.concat(F.lit(":"), render_map(pairs(F.col("e.a.names")))).alias("rejected"),
        F.concat(F.lit(":"), render_map("gt")).alias("gt"), "chosen_score", F.col("e.a.v").alias("rejected_score"), F.array_sort(F.transform(worse, lambda n: n["id"])).alias("interesting"),
    )
    return out.where("chosen_score > rejected_score") if filter_data else out


def ratios(pairs: DataFrame) -> DataFrame:
    """(n, reasonable, kept, kept_ratio) of pairs with the columns reasonable and overfit."""
    n, kept = F.count(F.lit(1)), F.count_if(F.expr("reasonable and not overfit"))
    return pairs.agg(n.alias("n"), F.count_if("reasonable").alias("reasonable"), kept.alias("kept"), F.try_divide(kept, n).alias("kept_ratio"))
