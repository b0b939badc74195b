"""Model answers to scored names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivar.functions.answers import dominant_pick, is_valid, parse_answer, repair_answer
from lexivar.functions.names import demangled, interesting_name, score_name

PREFIXES = ("sub_", "FUN_")


def placeholder_rows(entries: DataFrame, prefixes: tuple[str, ...] = PREFIXES, case_study: bool = False) -> DataFrame:
    """Entries of functions without a name; all of them in a case study."""
    if case_study:
        return entries
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.startswith("func_name", F.lit(p))
    return entries.where(starts)


def parsed_answers(entries: DataFrame, force: bool = True) -> DataFrame:
    """(prog_name, func_name, pos, raw, prob, broken, fixed, answer): each answer of entries(.., answers array<struct<pos, raw, prob>>); answer is null where it stays broken."""
    x = entries.select("prog_name", "func_name", F.explode("answers").alias("a")).select("prog_name", "func_name", "a.pos", "a.raw", "a.prob")
    x = x.withColumn("plain", parse_answer("raw")).withColumn("broken", ~is_valid("plain"))
    mended = F.when(F.col("broken"), repair_answer("raw", F.col("plain"))).otherwise(F.col("plain")) if force else F.col("plain")
    x = x.withColumn("mended", mended).withColumn("answer", F.when(is_valid("mended"), F.col("mended")))
    return x.withColumn("fixed", F.col("broken") & F.col("answer").isNotNull()).drop("plain", "mended")


def answer_counts(parsed: DataFrame) -> DataFrame:
    """(total, error, fixed, error_ratio, fixed_ratio) in one aggregate; ratios over nothing are null."""
    n = F.count(F.lit(1))
    error, fixed = F.count_if("broken"), F.count_if("fixed")
    return parsed.agg(n.alias("total"), error.alias("error"), fixed.alias("fixed"), F.try_divide(error, n).alias("error_ratio"), F.try_divide(fixed, error).alias("fixed_ratio"))


def by_id(parsed: DataFrame) -> DataFrame:
    """(prog_name, func_name, varname, names array<struct<pos, name, prob>>): what the answers say for each id, in their order."""
    # A filter on answers would parse them once more; without an answer there is a row without a name, which goes.
    rows = parsed.select("prog_name", "func_name", "pos", "prob", F.explode_outer("answer").alias("varname", "name")).where("varname is not null")
    return rows.groupBy("prog_name", "func_name", "varname").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "prob"))).alias("names"))


def truth_rows(entries: DataFrame) -> DataFrame:
    """(prog_name, func_name, varname, gt_varname): names that are worth a score, of functions first; those equal to their placeholder go."""
    x = entries.select("prog_name", "func_name", F.explode(F.concat("func_ids", "var_ids")).alias("e")).select("prog_name", "func_name", F.col("e.k").alias("varname"), demangled("e.v").alias("gt_varname"))
    return x.where(interesting_name("gt_varname", evaluation=True) & (F.col("gt_varname") != F.col("varname")))


def _scored(x: DataFrame, name: str) -> Column:
    return F.when(F.col(name) == "<emptyname>", F.struct(F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))).otherwise(score_name("gt_varname", name))


def scored_names(entries: DataFrame, best: bool = False, topk: int = 3, force: bool = True, case_study: bool = False) -> DataFrame:
    """(prog_name, func_name, varname, gt_varname, pred_name, precision, recall) of every name that has a truth and an answer; unanswered ones are left out.

    The first answer counts; with `best`, of the topk likeliest the last that is no worse in precision and recall than the best before it.
    """
    some = placeholder_rows(entries, case_study=case_study)
    x = truth_rows(some).join(by_id(parsed_answers(some, force)), ["prog_name", "func_name", "varname"])
    key = ["prog_name", "func_name", "varname", "gt_varname"]
    if not best:
        x = x.withColumn("pred_name", F.element_at("names", 1)["name"]).withColumn("s", _scored(x, "pred_name"))
        return x.select(*key, "pred_name", "s.precision", "s.recall")
    likely = F.slice(F.array_sort(F.transform("names", lambda e: F.struct((-e["prob"]).alias("p"), e["pos"].alias("pos"), e["name"].alias("name")))), 1, topk)
    x = x.select(*key, F.explode(likely).alias("e")).select(*key, "e.p", "e.pos", F.col("e.name").alias("name"))
    x = x.withColumn("s", _scored(x, "name")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("p", "pos", "name", "s.precision", "s.recall"))).alias("c"))
    return x.withColumn("b", dominant_pick("c", topk)).select(*key, F.col("b.name").alias("pred_name"), "b.precision", "b.recall")


def train_names(rows: DataFrame, prefix: str = "sub_") -> DataFrame:
    """rows(response: two characters, then a map) -> (name, n): how often a name stands in training answers; ids of functions and missing names do not count."""
    m = F.from_json(F.expr("substring(response, 3)"), "map<string,string>", {"allowSingleQuotes": "true"})
    x = rows.select(F.explode(m).alias("id", "name")).where(~F.startswith("id", F.lit(prefix)) & F.col("name").isNotNull())
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
