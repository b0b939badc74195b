"""Prompts for a judge of names, its answers, and the comparison of two judged systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivar.functions.answers import fenced_json_all, render_map
from lexivar.functions.names import col, program_prefix, rename_all
from lexivar.operators.relational import last_wins

ANSWER = "struct<var:string,v:string,prediction:string,score:struct<`Q-A`:int,`Q-B`:int>>"
_KEY = ["prog_name", "func_name", "varname"]


def in_either(preds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of preds(prog_name, func_name, varname) whose (program prefix, func_name, varname) stands in wanted as (prog_name, func_name, ori_name) or as (binary, funcname, ori_name)."""
    layouts = wanted.select("prog_name", "func_name", "ori_name").unionByName(wanted.select(F.col("binary").alias("prog_name"), F.col("funcname").alias("func_name"), "ori_name")).distinct()
    layouts = layouts.select(F.col("prog_name").alias("prefix"), "func_name", F.col("ori_name").alias("varname"))
    return preds.withColumn("prefix", program_prefix("prog_name")).join(layouts, ["prefix", "func_name", "varname"], "left_semi")


def judge_prompts(functions: DataFrame, preds: DataFrame, prefix: str = "sub_") -> DataFrame:
    """(prefix, func_name, body, predictions, prompt) of functions with predictions: the body with true names, and the predictions by true name.

    functions(prog_name, func_name, body, var_ids, func_ids); of functions whose programs share a prefix the last by (prog_name) counts. Predictions for functions
    and for names without a truth are left out; of several for one name the last line_no counts.
    """
    f = last_wins(functions.withColumn("prefix", program_prefix("prog_name")).select("prefix", "func_name", "prog_name", "body", F.concat("var_ids", "func_ids").alias("gt")), ["prefix", "func_name"], ["prog_name"])
    rows = preds.withColumn("prefix", program_prefix("prog_name"))
    asked = rows.select("prefix", "func_name").distinct()
    lines = rows.where(~F.startswith("varname", F.lit(prefix))).groupBy("prefix", "func_name", "varname").agg(F.min("line_no").alias("at"), F.max_by("pred_name", "line_no").alias("pred"))
    maps = lines.groupBy("prefix", "func_name").agg(F.sort_array(F.collect_list(F.struct("at", "varname", "pred"))).alias("p"))
    x = f.join(asked, ["prefix", "func_name"], "left_semi").join(maps, ["prefix", "func_name"], "left")
    true_name = lambda v: F.filter("gt", lambda e: e["k"] == v)[0]["v"]
    known = F.filter(F.coalesce("p", F.array().cast("array<struct<at:long,varname:string,pred:string>>")), lambda e: F.exists("gt", lambda g: g["k"] == e["varname"]))
    predictions = render_map(F.transform(known, lambda e: F.struct(true_name(e["varname"]).alias("k"), e["pred"].alias("v"))))
    x = x.select("prefix", "func_name", rename_all("body", "gt").alias("body"), predictions.alias("predictions"))
    prompt = F.concat(F.lit("\n<Decompiled code with groundtruth variable names>\n"), "body", F.lit("\n</END>\n\n<Predicted variable names>\n"), "predictions", F.lit("\n</END>\n"))
    return x.withColumn("prompt", prompt)


def scored_answers(response, gt) -> Column:
    """The judge's scores in a response: structs (var, gt_varname, prediction, qa, qb), with the placeholder of each true name by the map gt, an array of (k, v).

    Blocks that are broken or name no variable are left out, as are true names that the map lacks. Of placeholders with one true name the last counts.
    """
    of = lambda v: F.try_element_at(F.filter(col(gt), lambda g: g["v"] == v), F.lit(-1))["k"]
    said = F.filter(fenced_json_all(response, ANSWER), lambda b: b["var"].isNotNull())
    rows = F.transform(said, lambda b: F.struct(of(b["var"]).alias("var"), b["var"].alias("gt_varname"), b["prediction"].alias("prediction"), b["score"]["Q-A"].alias("qa"), b["score"]["Q-B"].alias("qb")))
    return F.filter(rows, lambda r: r["var"].isNotNull())


def judged_names(records: DataFrame) -> DataFrame:
    """records(prog_name, func_name, line_no, scored array<struct<var, gt_varname, prediction, qa, qb>>) -> one row a name, the last; names without both scores go."""
    rows = records.select("prog_name", "func_name", "line_no", F.posexplode("scored").alias("at", "s")).select("prog_name", "func_name", F.col("s.var").alias("varname"), "line_no", "at", "s.gt_varname", "s.qa", "s.qb")
    return last_wins(rows.where("varname is not null and qa is not null and qb is not null"), _KEY, ["line_no", "at"]).drop("line_no", "at")


def compare_judged(a: DataFrame, b: DataFrame, origins: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names that both systems have, with both systems' scores: merged on names and on all that is known of the program, nulls equal to nulls.

    origins(prog_name, seen, category, project) describes each program; fresh(prog_name, func_name) lists functions that do not overlap with training.
    """
    none = fresh.select("prog_name", "func_name").distinct().withColumn("fresh", F.lit(True))
    common = ["prog_name", "func_name", "varname", "gt_varname", "overlapped", "seen", "category", "project"]

    def described(x: DataFrame, other: DataFrame, side: str) -> DataFrame:
        x = x.join(other.select(*_KEY), _KEY, "left_semi").join(none, ["prog_name", "func_name"], "left").join(origins, "prog_name")
        return x.select(*common[:4], F.col("fresh").isNull().alias("overlapped"), *common[5:], F.col("qa").alias(f"{side}_qa"), F.col("qb").alias(f"{side}_qb"))

    left, right = described(a, b, "a"), described(b, a, "b")
    same = None
    for c in common:
        one = left[c].eqNullSafe(right[c])
        same = one if same is None else same & one
    return left.join(right, same).select(*[left[c] for c in common], "a_qa", "a_qb", "b_qa", "b_qb")


def score_histogram(pairs: DataFrame) -> DataFrame:
    """(measure, score, n) of the four measures over names that do not overlap."""
    x = pairs.where(~F.col("overlapped")).unpivot([], ["a_qa", "a_qb", "b_qa", "b_qb"], "measure", "score").where("score is not null")
    return x.groupBy("measure", "score").agg(F.count(F.lit(1)).alias("n"))
