"""Hints: what is known about a function's callees and call sites, from names predicted elsewhere in its program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivar.functions.names import col, demangled, rename_all
from lexivar.operators.ingest import last_values

#: What makes a string telling, and which share of unnamed callees is too much.
TELLING_LENGTH, UNNAMED_SHARE = 20, 0.3


def _telling(strings: Column) -> Column:
    return F.size(F.filter(strings, lambda s: F.length(s) > TELLING_LENGTH)) > 1


def _unnamed(callees: Column, prefix: str, own: Column | None = None) -> Column:
    count = F.filter(callees, lambda c: F.startswith(c, F.lit(prefix)) & (F.lit(True) if own is None else c != own))
    return F.size(count) > F.size(callees) * F.lit(UNNAMED_SHARE)


def context_sufficient(name="func_name", has_def="has_def", strings="strings", callees="callees", prefix: str = "sub_") -> Column:
    """Whether a function tells enough by itself: it has a name, or two long strings, or few calls of unnamed functions other than itself. A null name: false."""
    n = col(name)
    return (
        F.when(n.isNull(), F.lit(False)).when(~F.startswith(n, F.lit(prefix)), F.lit(True)).when(~col(has_def), F.lit(False))
        .when(_telling(col(strings)), F.lit(True)).otherwise(~_unnamed(col(callees), prefix, n))
    )


def likely_overfit(has_def="has_def", strings="strings", callees="callees", prefix: str = "sub_") -> Column:
    """Whether an answer could only be right by heart: no two long strings and many calls of unnamed functions, itself among them."""
    return F.when(~col(has_def) | _telling(col(strings)), F.lit(False)).otherwise(_unnamed(col(callees), prefix))


def predicted_names(scored: DataFrame) -> DataFrame:
    """scored(prog_name, func_name, varname, pred_name, line_no) -> (prog_name, func_name, names): maps in the order of the lines, the last value of each name."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", F.col("varname").alias("k"), F.col("pred_name").alias("v"))))
    grouped = scored.groupBy("prog_name", "func_name").agg(lines.alias("x"))
    pairs = F.transform("x", lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    return grouped.select("prog_name", "func_name", last_values(pairs).alias("names"))


def names_for_training(functions: DataFrame, predicted: DataFrame, gt_only: bool = False) -> DataFrame:
    """(prog_name, func_name, names, source): a function's predicted names, else its true ones (functions demangled); source is `infer` or `gt`.

    functions(prog_name, func_name, var_ids, func_ids), predicted as predicted_names() gives it.
    """
    true_names = F.concat("var_ids", F.transform("func_ids", lambda e: F.struct(e["k"].alias("k"), demangled(e["v"]).alias("v"))))
    x = functions.select("prog_name", "func_name", true_names.alias("gt"))
    if gt_only:
        return x.select("prog_name", "func_name", F.col("gt").alias("names"), F.lit("gt").alias("source"))
    x = x.join(predicted.withColumnRenamed("names", "predicted"), ["prog_name", "func_name"], "left")
    return x.select("prog_name", "func_name", F.coalesce("predicted", "gt").alias("names"), F.when(F.col("predicted").isNull(), "gt").otherwise("infer").alias("source"))


def source_statistics(parsed: DataFrame, names: DataFrame, prefix: str = "sub_") -> DataFrame:
    """(source, n): from where the names came of the functions that tell enough by themselves."""
    x = parsed.join(names, ["prog_name", "func_name"]).where(context_sufficient(prefix=prefix))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def hints(parsed: DataFrame, scored: DataFrame, edges: DataFrame, prefix: str = "sub_") -> DataFrame:
    """(prog_name, func_name, callees, callsites) of each function that has predictions or is called by one.

    parsed(prog_name, func_name, func_seq, declarator, calls, ...), edges(prog_name, caller, callee, at). A function that tells enough by itself gives its renamed
    declarator, if its own name was predicted, to its callers, in the order in which they mention it; and its renamed calls to those it calls, in the order of functions and calls.
    """
    known = parsed.join(predicted_names(scored), ["prog_name", "func_name"]).where(context_sufficient(prefix=prefix))
    heads = known.where(F.exists("names", lambda e: e["k"] == F.col("func_name")) & F.col("declarator").isNotNull())
    heads = heads.select("prog_name", F.col("func_name").alias("callee"), rename_all("declarator", "names").alias("text"))
    of_callees = edges.join(heads, ["prog_name", "callee"]).groupBy("prog_name", F.col("caller").alias("func_name"))
    of_callees = of_callees.agg(F.sort_array(F.collect_list(F.struct("at", "callee", "text"))).alias("callees"))
    calls = known.select("prog_name", "func_seq", "names", F.posexplode("calls").alias("at", "call")).select("prog_name", "func_seq", "at", "call.callee", F.col("call.text").alias("was"), rename_all("call.text", "names").alias("text"))
    calls = calls.where("was <> text").groupBy("prog_name", F.col("callee").alias("func_name")).agg(F.sort_array(F.collect_list(F.struct("func_seq", "at", "text"))).alias("callsites"))
    asked = scored.select("prog_name", "func_name").distinct()
    asked = parsed.select("prog_name", "func_name").join(asked.select("prog_name").distinct(), "prog_name", "left_semi")
    out = asked.join(of_callees, ["prog_name", "func_name"], "left").join(calls, ["prog_name", "func_name"], "left")
    callees = F.coalesce(F.transform("callees", lambda e: F.struct(e["callee"].alias("callee"), e["text"].alias("text"))), F.array().cast("array<struct<callee:string,text:string>>"))
    return out.select("prog_name", "func_name", callees.alias("callees"), F.coalesce("callsites.text", F.array().cast("array<string>")).alias("callsites"))


def _distinct_first(items: Column, key) -> Column:
    """Items whose key did not stand before, in order."""
    seen = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(seen, key(x)) == i + 1)


def render_hints(callees="callees", callsites="callsites", max_callees: int = 5, max_callsites: int = 5) -> Column:
    """The hints as text: one less than max_callees distinct callee hints, then at most max_callsites distinct, numbered call sites; "" where there are none."""
    a, b = col(callees), col(callsites)
    first = F.slice(_distinct_first(a, lambda x: F.trim(x["text"])), 1, max_callees - 1)
    head = F.concat(F.lit("<Hints Callees>"), F.array_join(F.transform(first, lambda x: F.concat(F.lit("\n"), x["callee"], F.lit(": "), F.trim(x["text"]))), ""), F.lit("\n</Hints Callees>\n"))
    sites = F.slice(F.array_distinct(F.transform(b, lambda x: F.trim(x))), 1, max_callsites)
    line = lambda x, i: F.concat(F.lit("\n<"), i.cast("string"), F.lit("> "), x, F.lit(" </"), i.cast("string"), F.lit(">"))
    tail = F.concat(F.lit("<Hints Callsites>"), F.array_join(F.transform(sites, line), ""), F.lit("\n</Hints Callsites>"))
    return F.concat(F.when(F.size(a) > 0, head).otherwise(""), F.when(F.size(b) > 0, tail).otherwise(""))


def with_hints(body, hints_text) -> Column:
    return F.when(col(hints_text) == "", col(body)).otherwise(F.concat(col(body), F.lit("\n"), col(hints_text)))
