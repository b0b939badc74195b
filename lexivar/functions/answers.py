"""Tolerant parsing of model answers; nothing is ever evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col

_OPTIONS = {"allowSingleQuotes": "true"}


def _map(text: Column) -> Column:
    """The map that a text is, else null; only what begins as one is tried, as each failure costs an exception."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, "map<string,string>", _OPTIONS))


def parse_answer(text) -> Column:
    """The map that the text is; else that in its last {...} block; else the map it begins with; else one entry `Error` with the text. Leading colons go."""
    t = F.trim(F.regexp_replace(col(text).cast("string"), r"^:+", ""))
    block = F.try_element_at(F.regexp_extract_all(t, F.lit(r"\{[^}]*\}"), F.lit(0)), F.lit(-1))
    return F.coalesce(F.when(t.rlike(r"^\{[^{}]*\}\s*$"), _map(t)), _map(block), _map(t), F.create_map(F.lit("Error"), F.coalesce(t, F.lit(""))))


def repair_answer(text, parsed: Column | None = None) -> Column:
    """parse_answer(), which may be given; then the text from its last { on, cut at its last comma and closed; then, of a text that ends a map it never began, what follows the fragment before its first whole entry."""
    t = F.trim(F.regexp_replace(col(text).cast("string"), r"^:+", ""))
    tail = F.regexp_extract(t, r"(\{[^{]*)$", 1)
    closed = F.concat(F.regexp_replace(tail, r",[^,]*$", ""), F.lit("}"))
    # Up to the last comma before the first colon; without one, up to the first comma.
    rest = F.trim(F.when(t.rlike(r"^[^:,]*,[^:]*:"), F.regexp_replace(t, r"^[^:]*,", "")).otherwise(F.regexp_replace(t, r"^[^,]*,", "")))
    opened = F.concat(F.lit("{"), F.when(F.startswith(rest, F.lit("'")), rest).otherwise(F.concat(F.lit("'"), rest)))
    begun = F.when(~F.contains(t, F.lit("{")) & F.endswith(t, F.lit("}")) & F.contains(t, F.lit(":")), opened)
    parsed = parse_answer(t) if parsed is None else parsed
    return F.when(F.array_contains(F.map_keys(parsed), "Error"), F.coalesce(_map(F.concat(tail, F.lit("}"))), _map(closed), _map(begun), parsed)).otherwise(parsed)


def is_valid(answer) -> Column:
    return ~F.array_contains(F.map_keys(col(answer)), "Error")


def fenced_blocks(text) -> Column:
    """What stands in the text's ```json blocks, in order."""
    return F.regexp_extract_all(col(text), F.lit("(?s)```json(.*?)```"), F.lit(1))


def fenced_json(text, schema: str) -> Column:
    """The last ```json block, parsed."""
    return F.from_json(F.try_element_at(fenced_blocks(text), F.lit(-1)), schema, _OPTIONS)


def fenced_json_all(text, schema: str) -> Column:
    """All ```json blocks, parsed; null where one is broken."""
    return F.transform(fenced_blocks(text), lambda b: F.from_json(b, schema, _OPTIONS))


def dominant_pick(candidates, k: int = 3) -> Column:
    """Of the first k (name, precision, recall): the last that is no worse in both than the best so far."""
    first = F.slice(col(candidates), 1, k)
    return F.aggregate(first, F.try_element_at(first, F.lit(1)), lambda b, x: F.when((x["precision"] >= b["precision"]) & (x["recall"] >= b["recall"]), x).otherwise(b))


def hint_slice(items, n: int) -> Column:
    return F.slice(F.array_distinct(F.transform(col(items), lambda x: F.trim(x))), 1, n)


def render_prompt(body, ids, hints=None, max_body: int = 5120, max_ids: int = 20) -> Column:
    """The cut body, the hints on lines of their own if there are any, and the first ids to name."""
    text = F.substring(col(body), 1, max_body)
    if hints is not None:
        text = F.when(F.coalesce(col(hints), F.lit("")) == "", text).otherwise(F.concat(text, F.lit("\n"), col(hints)))
    return F.concat(F.lit("\n"), text, F.lit("\n\n\n\nQ:["), F.array_join(F.transform(F.slice(col(ids), 1, max_ids), lambda x: F.concat(x, F.lit(","))), ""), F.lit("]A"))


def render_map(pairs) -> Column:
    """Pairs (k, v) in order, as {'k': 'v', ...}."""
    return F.concat(F.lit("{"), F.array_join(F.transform(col(pairs), lambda e: F.concat(F.lit("'"), e["k"], F.lit("': '"), e["v"], F.lit("'"))), ", "), F.lit("}"))
