"""What keeps the queries on programs fast on large tables: one pass over the programs, one parse a shape, and pairs that arise in the last step."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexivar.functions import names as N
from lexivar.operators import fuzzy, graph, ingest, overlap, preference, scoring
from lexivar.parsing import facts as M
from lexivar.plans import programs as P
from lexivar.plans import recovery

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def always_parsed(text):
    out = M._told(M._drawn(text), lambda s: text[s[0] : s[1]])
    return out | {"callees": sorted(out["callees"])}


def test_texts_of_one_shape_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(M, "parse", lambda text, f=M.parse: parsed.append(text) or f(text))
    M._SHAPES.clear()
    code = '__int64 __fastcall sub_{0:X}(int a1)\n{{\n  v1 = sub_{1:X}(v2, "s {0}"); // eax\n  return sub_{1:X}(v1);\n}}'
    texts = [code.format(k, k * 7) for k in range(1, 200)]
    found = [M.facts(t) for t in texts]
    assert len(parsed) == 2  # the second time a shape is seen it is kept
    assert found == [always_parsed(t) for t in texts]


def test_shapes_never_change_facts():
    """Texts put together from pieces in which a quote, a comment or a name may end early."""
    rng, M_kept = random.Random(3), M.SHAPES_KEPT
    pieces = ['"', "'", '"a"', '"it\'s"', '"return"', "sub_1", "sub_2F", "sub_2G", "LABEL_1:", "//", "\n", "/*", "*/", "#", "\\", "L", "(", ")", "{", "}", ";", ",", "=", " ", "v1", "int ", "return ", "1e+", "0x", ".", "::", "-", "if", "f(", "foo_"]
    M._SHAPES.clear()
    for _ in range(1500):
        base = ["int sub_9(int a1) {"] + [rng.choice(pieces) for _ in range(rng.randrange(3, 14))]
        for _ in range(4):
            text = "".join({"sub_1": f"sub_{rng.randrange(999):X}", '"a"': f'"{rng.choice(("a", "b c", "return", "x,y", ""))}"'}.get(p, p) for p in base) + "}"
            assert M.facts(text) == always_parsed(text), text
    assert 0 < len(M._SHAPES) <= M_kept


def test_functions_are_drawn_in_one_pass(spark):
    raw = P.raw_functions(spark, SF)
    for df in (ingest.functions_of(raw), graph.mention_edges(ingest.retained(raw).select("prog_name", "func_name", F.col("stripped.code").alias("body")))):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1 and "Join" not in text


def test_names_of_functions_without_a_program_do_not_meet(spark):
    schema = "prog_name string, func_name string, body string"
    rows = [(None, "sub_1", "a sub_1( sub_2("), (None, "sub_2", ""), ("p", "sub_1", " sub_2( sub_3( sub_1( sub_2("), ("p", "sub_2", "x"), ("q", "sub_3", "sub_2(")]
    got = sorted(tuple(r) for r in graph.mention_edges(spark.createDataFrame(rows, schema)).collect())
    assert got == [("p", "sub_1", "sub_2", 0)]


def test_classes_of_delimiters_are_the_same(spark):
    text = "sub_1 sub_2(é sub_3é sub_4@ @sub_5- sub_6_ asub_7 sub_8"
    x = spark.range(1).select(N.mentions(F.lit(text)).alias("m"), F.regexp_extract_all(F.lit(text), F.lit(r"([^a-zA-Z0-9_]|^)(sub_[0-9a-fA-F_]*)([^a-zA-Z0-9_])"), F.lit(2)).alias("w")).first()
    assert x["m"] == x["w"] != []


def test_exact_pairs_without_bodies_and_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LISTED", 3)
    monkeypatch.setattr(overlap, "TRAIN_LISTED", 2)
    rows = lambda p, n: [(f"{p}{i}", f"sub_{i}", ("", "a#b", "c")[i % 3]) for i in range(n)]
    schema = "prog_name string, func_name string, sig string"
    test, train = rows("t", 23), rows("u", 61)
    got = overlap.exact(*(spark.createDataFrame(x, schema) for x in (test, train)))
    keys = sorted((r["prog_name"], r["func_name"], r["train_prog_name"], r["train_func_name"], r["sig"], r["train_sig"], r["name_ratio"]) for r in got.collect())
    assert keys == sorted((a[0], a[1], b[0], b[1], a[2], b[2], 100) for a in test for b in train if a[2] == b[2])


def test_answers_are_parsed_once(spark):
    entries = spark.createDataFrame([("p", "sub_1", [(0, "{'a1': 'x', 'v1': 'y'}", 0.5), (1, "no map", 0.4), (2, "{}", 0.3)])], "prog_name string, func_name string, answers array<struct<pos:int,raw:string,prob:double>>")
    df = scoring.by_id(scoring.parsed_answers(entries))
    assert not [x for x in plan(df).split("\n") if "Filter" in x and "from_json" in x]
    assert sorted((r["varname"], r["names"][0]["name"], len(r["names"])) for r in df.collect()) == [("a1", "x", 1), ("v1", "y", 1)]


def test_functions_are_drawn_once_for_scores_and_pairs(spark):
    for df in (scoring.scored_names(recovery.answered(spark, SF)), preference.preference_pairs(recovery.preference_entries(spark, SF))):
        assert "inline(" not in plan(df)  # which draws mentions from code


def test_a_matcher_used_again_gives_the_same_ratio():
    rng, match = random.Random(5), SequenceMatcher(None)
    texts = ["".join(rng.choice("ab(); sub_") for _ in range(rng.choice((0, 1, 40, 230)))) for _ in range(25)]
    for b in texts:
        match.set_seq2(b)
        for a in texts:
            match.set_seq1(a)
            assert fuzzy.percent(match) == fuzzy.ratio(a, b)
