"""The outer loop: ask, parse and score, draw hints, ask again; the tables between rounds are written, so each round starts from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivar.functions.answers import render_prompt
from lexivar.operators import hints as H
from lexivar.operators import scoring
from lexivar.operators.relational import combine_files
from lexivar.sources.scratch import Scratch


def prompts(functions: DataFrame, hints: DataFrame | None = None, max_body: int = 5120, max_ids: int = 20) -> DataFrame:
    """(prog_name, func_name, prompt) of every function; hints(prog_name, func_name, callees, callsites) are put in where there are any."""
    ids = F.transform(F.concat("var_ids", "func_ids"), lambda e: e["k"])
    if hints is None:
        return functions.select("prog_name", "func_name", render_prompt("body", ids, max_body=max_body, max_ids=max_ids).alias("prompt"))
    x = functions.join(hints.select("prog_name", "func_name", H.render_hints().alias("hints")), ["prog_name", "func_name"], "left")
    return x.select("prog_name", "func_name", render_prompt("body", ids, "hints", max_body, max_ids).alias("prompt"))


def recover(functions: DataFrame, parsed: DataFrame, edges: DataFrame, ask: Callable[[DataFrame, int], DataFrame], rounds: int = 4) -> DataFrame:
    """(prog_name, func_name, varname, name_list): the names of all rounds, in their order.

    ask(prompts, round) answers with (prog_name, func_name, answers array<struct<pos, raw, prob>>); a model stands behind it, or a table. The first round has no hints,
    each later one those that the round before gave.
    """
    scratch = Scratch(functions.sparkSession, "rounds")
    hints, found = None, []
    for i in range(rounds):
        answers = ask(prompts(functions, hints), i)
        scored = scratch.save(scoring.scored_names(functions.join(answers, ["prog_name", "func_name"])), f"scored-{i}")
        found.append((f"scored-{i}", scored.withColumn("line_no", F.lit(0))))
        if i + 1 < rounds:
            lines = scored.withColumn("line_no", F.xxhash64("varname"))  # one row a name, so any order gives the same map
            hints = scratch.save(H.hints(parsed, lines, edges), f"hints-{i}")
    return combine_files(found, ["prog_name", "func_name", "varname"], "line_no", ["pred_name", "precision", "recall"])
