"""Operators on programs, with rows and expectations written by hand, and comparisons with all pairs."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexivar.functions import answers as A
from lexivar.functions import names as N
from lexivar.operators import fuzzy, graph, hints, ingest, judge, origins, overlap, preference, propagation, relational, scoring
from lexivar.parsing.cparse import parse
from lexivar.parsing.facts import facts, with_facts
from lexivar.plans import recovery, storage  # noqa: F401
from lexivar.sources import tables
from lexivar.sources.scratch import Scratch

PAIRS = "array<struct<k:string,v:string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- parser


def test_facts_of_code():
    code = """__int64 __fastcall sub_1(int a1, char *a2, const char b)
{
  int v1; // eax
  char *v3 = foo(a1, sub_9(a2));
  v1 = sub_2(v2, a1);
  v2 = v1; v7 += (char)v2;
  *(_DWORD *)(a1 + 4LL) = v2;
  puts("it's \\"here\\"" "x");
  if ( v2 > 5 && sub_3(v2) ) { sub_3(v2, 'c'); } else goto LABEL_2;
  for ( i = 0; i < 10; ++i ) v5[i] = (*(__int64 (__fastcall **)(int))(a1 + 8))(v2);
LABEL_2:
  do { --v1; } while ( v1 );
  while ( 1 ) { x = y ? z : w; break; }
  switch ( v1 ) { case 1: v1 = (v2); break; default: f(); }
  return sub_2(v2);
}"""
    f = facts(code)
    assert f["has_def"] and f["declarator"] == "sub_1(int a1, char *a2, const char b)" and f["params"] == ["a1", "unknown", "b"]
    assert f["strings"] == ['"it\'s \\"here\\""', '"x"'] and f["callees"] == ["f", "foo", "puts", "sub_2", "sub_2", "sub_3", "sub_3", "sub_9"]
    copies = [(x["lhs"], x["rhs_kind"], x["rhs"], x["direct"]) for x in f["ir"] if x["kind"] == "copy"]
    assert copies == [("v1", "implicit_return", "sub_2", True), ("v2", "var", "v1", True), ("v7", "var", "v2", True), ("i", "opaque", None, False), ("x", "opaque", None, False), ("v1", "var", "v2", True)]
    calls = [x["callee"] for x in f["ir"] if x["kind"] == "call"]
    assert calls == ["sub_9", "foo", "sub_2", "puts", "sub_3", "sub_3", "f", "sub_2", "sub_2"]  # a returned call stands twice
    assert [(x["rhs_kind"], x["rhs"]) for x in f["ir"] if x["kind"] == "return"] == [("implicit_return", "sub_2")]
    assert [x["seq"] for x in f["ir"]] == list(range(len(f["ir"])))


@pytest.mark.parametrize("text", [None, "", "int x", ")))", "{{{{", "void f(", "f(1", '"open', "int f() { a b c ))) ; g(1); }", "(" * 3000, "int f() {" + "(" * 500 + "}", "a = " * 400, "#define X\nint f(void) { return X; }", "\x00é"])
def test_parser_never_fails(text):
    facts(text)


def test_parser_goes_on_behind_what_it_cannot_read():
    assert facts("int f() { a b c ))) ; g(1); }")["callees"] == ["g"] and facts("__int64 f(void) { return h(); }")["params"] == []
    assert [x["args"] for x in facts("f((char *)x, (y), !z, 7);")["ir"]] == [[{"kind": "var", "name": "x"}, {"kind": "var", "name": "y"}, {"kind": "opaque", "name": None}, {"kind": "opaque", "name": None}]]
    root = parse("int f() { g(h(1)); }")
    assert [c["ids"] for c in facts("int f() { g(h(a), (T)b); }")["calls"]] == [["g", "h", "a", "b"], ["h", "a"]]
    assert len(list(root.find("call_expression"))) == 2 and len(list(root.find("call_expression", depth=0))) == 0


def test_facts_table_keeps_columns(spark):
    x = with_facts(spark.createDataFrame([(1, "void f() { g(a); }"), (2, None)], "id int, body string"))
    out = {r["id"]: r for r in x.collect()}
    assert out[1]["callees"] == ["g"] and out[1]["ir"][0]["args"][0]["name"] == "a" and out[2]["has_def"] is False and x.columns[:2] == ["id", "body"]


# -- ingest


RAW = "prog_name string, func_seq int, gt struct<name:string,args:array<struct<pos:string,name:string>>,locals:array<struct<pos:string,name:string>>>, stripped struct<name:string,code:string,args:array<struct<pos:string,name:string>>,locals:array<struct<pos:string,name:string>>>"


def test_ingest(spark):
    code = "f\n{ sub_2 ( ) ; sub_3 ( ) ; sub_2 ( ) ;\n}\n"
    rows = [
        ("p", 1, ("alpha", [("0", "size"), ("1", "v9")], [("2", "buf"), ("0", "other")]), ("sub_1", code, [("0", "a1"), ("1", "a2")], [("2", "v1"), ("0", "v2"), ("1", "v3")])),
        ("p", 2, ("beta", [], []), ("sub_2", code, [], [])),
        ("p", 3, ("__init", [], []), ("sub_3", code, [], [])),  # made by a compiler
        ("p", 4, ("sub_4", [], []), ("sub_4", "a\nb\nc\nd", [], [])),  # nothing to recover
        ("p", 5, ("short", [], []), ("sub_5", "a\nb\nc", [], [])), ("p", 6, (None, [], []), ("sub_6", code, [], [])),
    ]
    out = {r["func_name"]: r for r in ingest.functions_of(spark.createDataFrame(rows, RAW)).collect()}
    assert set(out) == {"sub_1", "sub_2"}
    pairs = lambda x: [(e["k"], e["v"]) for e in x]
    # Arguments first; locals overwrite the truth at their place, and fall back on arguments; v9 is a dummy.
    assert pairs(out["sub_1"]["var_ids"]) == [("a1", "size"), ("v1", "buf"), ("v2", "other")] and pairs(out["sub_1"]["func_ids"]) == [("sub_2", "beta")]
    known = ingest.known_as(spark.createDataFrame([("f", [("f", "main")]), ("g", [("g", "good")]), ("h", [])], f"func_name string, func_ids {PAIRS}"))
    assert sorted(r["known"] for r in known.collect()) == ["good", "h"]


def test_last_value_of_a_key_at_its_first_place(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("b", "1"), ("a", "2"), ("b", "3"))])
    assert [tuple(e) for e in one(spark, ingest.last_values(pairs))] == [("b", "3"), ("a", "2")]


# -- hints


def test_hints(spark):
    parsed = with_facts(spark.createDataFrame([("p", "sub_1", 1, "int sub_1(int a1)\n{ sub_2(a1, x); sub_2(a1, x); sub_2(y); }"), ("p", "sub_2", 2, "int sub_2(int a1)\n{ g(a1); h(); i(); j(); }"), ("p", "sub_3", 3, "int x;")], "prog_name string, func_name string, func_seq int, body string"))
    scored = spark.createDataFrame([("p", "sub_1", "a1", "len", 1), ("p", "sub_2", "a1", "first", 2), ("p", "sub_2", "sub_2", "run", 3), ("p", "sub_2", "a1", "count", 4)], "prog_name string, func_name string, varname string, pred_name string, line_no int")
    edges = graph.mention_edges(parsed)
    out = {r["func_name"]: r for r in hints.hints(parsed, scored, edges).collect()}
    # sub_1 calls only functions without a name, so it says nothing about them; sub_2 tells enough.
    assert [tuple(e) for e in out["sub_1"]["callees"]] == [("sub_2", "run(int count)")] and out["sub_2"]["callsites"] == [] and out["sub_3"]["callees"] == []
    named = parsed.withColumn("strings", F.array(F.lit("x" * 21), F.lit("y" * 21)))
    out = {r["func_name"]: r for r in hints.hints(named, scored, edges).collect()}
    assert out["sub_2"]["callsites"] == ["sub_2(len, x)", "sub_2(len, x)"]


def test_hint_text(spark):
    callees = F.array(*[F.struct(F.lit(f"c{i}").alias("callee"), F.lit(f" h{i // 2} ").alias("text")) for i in range(14)])
    sites = F.array(*[F.lit(f" s{i}") for i in range(7)])
    text = one(spark, hints.render_hints(callees, sites))
    assert text == "<Hints Callees>\nc0: h0\nc2: h1\nc4: h2\nc6: h3\n</Hints Callees>\n<Hints Callsites>\n<0> s0 </0>\n<1> s1 </1>\n<2> s2 </2>\n<3> s3 </3>\n<4> s4 </4>\n</Hints Callsites>"
    none = F.array().cast("array<struct<callee:string,text:string>>"), F.array().cast("array<string>")
    assert one(spark, hints.render_hints(*none)) == "" and one(spark, hints.with_hints(F.lit("b"), F.lit(""))) == "b"


@pytest.mark.parametrize(
    ("name", "has_def", "strings", "callees", "enough", "by_heart"),
    [
        (None, True, 0, [], False, False), ("main", False, 0, ["sub_2"], True, False), ("sub_1", False, 0, [], False, False), ("sub_1", True, 2, ["sub_2"], True, False),
        ("sub_1", True, 1, ["sub_2"], False, True), ("sub_1", True, 0, ["sub_1"], True, True), ("sub_1", True, 0, ["sub_2", "a", "b", "c"], True, False), ("sub_1", True, 0, ["sub_2", "a", "b"], False, True), ("sub_1", True, 0, [], True, False),
    ],
)
def test_context_rules(spark, name, has_def, strings, callees, enough, by_heart):
    x = spark.createDataFrame([(name, has_def, ["s" * 21] * strings, callees)], "func_name string, has_def boolean, strings array<string>, callees array<string>")
    assert tuple(x.select(hints.context_sufficient(), hints.likely_overfit()).first()) == (enough, by_heart)


# -- propagation


def code(spark, *functions):
    return with_facts(spark.createDataFrame([("p", n, b) for n, b in functions], "prog_name string, func_name string, body string"))


def named_all(spark, *variables):
    return spark.createDataFrame([("p", f, v) for f, v in variables], "prog_name string, src_func string, src_var string")


def reach(parsed, sources, rounds=3, calls=None):
    calls = graph.mention_edges(parsed) if calls is None else calls
    return {(r["dst_func"], r["dst_var"], r["src_func"], r["src_var"]): (list(propagation.KINDS)[r["kind"]], r["level"]) for r in propagation.propagate(propagation.edges(parsed, calls), sources, rounds).collect()}


def test_copies_go_both_ways(spark):
    p = code(spark, ("f", "int f() { v1 = v2; v3 = v1; }"))
    got = reach(p, named_all(spark, ("f", "v2")))
    assert got == {("f", "v1", "f", "v2"): ("direct use", 0), ("f", "v3", "f", "v2"): ("direct use", 1)}
    assert reach(p, named_all(spark, ("f", "v3"))) == {("f", "v1", "f", "v3"): ("direct use back", 0)}  # backwards only one step


def test_arguments_by_position_and_number(spark):
    p = code(spark, ("sub_1", "int sub_1() { x; sub_2(v3); sub_2(v4, v5); }"), ("sub_2", "int sub_2(int a1) { }"))
    got = reach(p, named_all(spark, ("sub_1", "v3"), ("sub_1", "v4"), ("sub_2", "a1")))
    assert got == {("sub_1", "v3", "sub_2", "a1"): ("callee args", 0), ("sub_2", "a1", "sub_1", "v3"): ("caller args", 0)}
    none = graph.mention_edges(p).where("1 = 0")  # the caller's side needs the call graph
    assert set(reach(p, named_all(spark, ("sub_1", "v3"), ("sub_2", "a1")), calls=none)) == {("sub_1", "v3", "sub_2", "a1")}


def test_returned_values(spark):
    p = code(spark, ("sub_1", "int sub_1() { v1 = sub_2 (x) ; v9 = v1; }"), ("sub_2", "int sub_2() { r = q; return r; }"))
    got = reach(p, named_all(spark, ("sub_1", "v1"), ("sub_2", "r"), ("sub_2", "q")))
    assert got[("sub_1", "v1", "sub_2", "r")] == ("callee return", 0) and got[("sub_2", "r", "sub_1", "v1")] == ("caller return", 0)
    assert got[("sub_1", "v1", "sub_2", "q")] == ("direct use", 1) and got[("sub_1", "v9", "sub_2", "q")] == ("direct use", 2)
    assert ("sub_1", "v9", "sub_2", "q") not in reach(p, named_all(spark, ("sub_2", "q")), rounds=2)


def test_choice_of_names(spark):
    schema = "prog_name string, func_name string, varname string, candidates array<struct<pred_name:string,precision:double>>"
    c = lambda *n: [(x, 0.5) for x in n]
    names = spark.createDataFrame([("p", "f", "one", c("a", "a", "<emptyname>")), ("p", "f", "none", c("<emptyname>")), ("p", "f", "gone", c("<empty>")), ("p", "f", "alone", c("a", "b")), ("p", "f", "vote", c("b", "a", "b")), ("p", "f", "tie", c("c", "d")), ("p", "g", "s", c("b", "<empty>", "a", "b"))], schema)
    defaults = spark.createDataFrame([("p", "f", v, "dflt") for v in ("one", "none", "alone", "vote")], "prog_name string, func_name string, varname string, pred_name string")
    reached = spark.createDataFrame([("p", "f", v, "g", "s", 4, 0) for v in ("vote", "tie", "one")], "prog_name string, dst_func string, dst_var string, src_func string, src_var string, kind int, level int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [2.0, 2.0]), ("d", [1.0, 1.0])], "name string, embedding array<double>")
    out = {r["varname"]: (r["pred_name"], r["how"]) for r in propagation.choose(names, reached, defaults, vectors).collect()}
    assert out == {"one": ("a", "only"), "none": ("dflt", "default"), "alone": ("dflt", "default"), "vote": ("b", "vote"), "tie": ("c", "vote")}
    assert propagation.modes(names).where("src_var = 's'").first()["mode"] == "b"


# -- overlap


def test_overlap_against_all_pairs(spark):
    rnd = random.Random(3)
    def rows(prog, n):
        return [(prog, f"f{i}", " ".join(rnd.choice(("x", "y", "zz")) for _ in range(6)) + " ;", [("a1" if rnd.random() < 0.7 else "a12", "len"), ("v1", rnd.choice(("buf", "node")))], [(f"f{i}", rnd.choice(("parse_header", "parse_headers", "read_it")))] if rnd.random() < 0.9 else []) for i in range(n)]
    schema = f"prog_name string, func_name string, body string, var_ids {PAIRS}, func_ids {PAIRS}"
    test, train = (overlap.signed(spark.createDataFrame(rows(p, n), schema)) for p, n in (("t", 15), ("u", 40)))
    a, b = test.collect(), train.collect()
    want = sorted((x["func_name"], y["func_name"], r, fuzzy.ratio(x["norm_body"], y["norm_body"])) for x in a for y in b if (r := fuzzy.ratio(x["sig"], y["sig"])) > 90)
    got = overlap.candidates(test, train)
    assert sorted((r["func_name"], r["train_func_name"], r["name_ratio"], r["body_ratio"]) for r in got.collect()) == want and any(w[2] < 100 for w in want)
    assert sum(len(r["overlaps"]) for r in overlap.as_lists(got).collect()) == len(want)


def test_project_rules(spark):
    schema = "binary int, project string, category string"
    train = spark.createDataFrame([(1, "net-kit", "gui"), (2, "tool2", "cli"), (3, "same", None)], schema)
    x = spark.createDataFrame([(10, "net_tool", "cli"), (11, "tool.net", "cli"), (12, "same", "x"), (13, "none", "cli"), (14, "same-y", None), (15, None, "cli"), (16, "a-b", "gui")], schema)
    assert {r["binary"]: r["seen"] for r in origins.project_seen(x, train).collect()} == {10: False, 11: True, 12: True, 13: False, 14: True, 15: False, 16: False}
    assert [r["binary"] for r in origins.project_seen(x, train, exact_only=True).where("seen").collect()] == [12]


# -- answers


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{'a': 'b'} then {'c': 'd'}", {"c": "d"}), ("q', 'a1': 'x', 'v1': 'y'}", {"a1": "x", "v1": "y"}), ("a1': 'x', 'v1': 'y'}", {"v1": "y"}), ("x', y', 'a1': 'x'}", {"a1": "x"}),
        ("z {'a': 'b', 'c': 'd', 'e", {"a": "b", "c": "d"}), ("z {'a': 'b', 'c': 'd'", {"a": "b", "c": "d"}), ("none", {"Error": "none"}), ("", {"Error": ""}), ("x}", {"Error": "x}"}), ("{'a': 'x{y}'}", {"a": "x{y}"}),
    ],
)
def test_repair(spark, text, want):
    assert one(spark, A.repair_answer(F.lit(text))) == want


def test_scored_names(spark):
    schema = f"prog_name string, func_name string, var_ids {PAIRS}, func_ids {PAIRS}, answers array<struct<pos:int,raw:string,prob:double>>"
    answers = [(0, "{'a1': 'size', 'v1': 'i'}", 0.1), (1, "{'a1': 'len', 'v2': '<emptyname>'}", 0.9), (2, "junk", 0.9)]
    rows = [("p", "sub_1", [("a1", "len"), ("v1", "i"), ("v2", "buf"), ("v3", "never_said"), ("a2", "a2")], [], answers), ("p", "named", [("a1", "len")], [], answers)]
    e = spark.createDataFrame(rows, schema)
    out = {r["varname"]: (r["pred_name"], r["precision"], r["recall"]) for r in scoring.scored_names(e).collect()}
    assert out == {"a1": ("size", 0.0, 0.0), "v2": ("<emptyname>", 0.0, 0.0)}  # trivial, unanswered and unchanged names are not scored
    assert {r["varname"]: r["pred_name"] for r in scoring.scored_names(e, best=True).collect()}["a1"] == "len"
    assert scoring.scored_names(e, case_study=True).where("func_name = 'named'").count() == 1
    assert tuple(scoring.answer_counts(scoring.parsed_answers(e)).first()) == (6, 2, 0, pytest.approx(1 / 3), 0.0)


def test_preference_walk(spark):
    schema = f"prog_name string, func_name string, var_ids {PAIRS}, func_ids {PAIRS}, answers array<struct<pos:int,names:map<string,string>>>"
    ids = [("a", "len"), ("b", "buffer"), ("c", "node")]
    answers = [(0, {"a": "len", "b": "x", "c": "y"}), (1, {"a": "q", "b": "buffer", "c": "y"}), (2, {"a": "q", "b": "x", "c": "y"}), (3, {"a": "len", "b": "buffer"})]
    rows = [("p", "f", ids, [], answers), ("p", "same", ids, [], [answers[0], answers[0]]), ("p", "poor", ids, [], [answers[2], (1, {"a": "q", "b": "x", "c": "z"})]), ("p", "novars", [], ids, answers)]
    out = {(r["func_name"], r["rank"]): r for r in preference.preference_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {("f", 1), ("f", 2)}
    assert out[("f", 1)]["chosen"] == ":{'a': 'len', 'b': 'buffer', 'c': 'y'}" and out[("f", 1)]["rejected"] == ":{'a': 'q', 'b': 'x', 'c': 'y'}" and out[("f", 1)]["interesting"] == ["a", "b"]
    # From the best down: the fourth answer lacks a name; of the two alike the later stands higher.
    assert out[("f", 2)]["rejected"] == ":{'a': 'q', 'b': 'buffer', 'c': 'y'}" and out[("f", 2)]["interesting"] == ["a"]


# -- judge


def test_judge(spark):
    gt = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a1", "len"), ("v1", "buf"))])
    text = "x\n```json\n{'var': 'len', 'prediction': 'n', 'score': {'Q-A': 5, 'Q-B': 4}}\n```\n```json\n{broken\n```\n```json\n{'note': 1}\n```\n```json\n{'var': 'other', 'score': {'Q-A': 1, 'Q-B': 1}}\n```\n```json\n{'var': 'buf'}\n```"
    got = [tuple(r) for r in one(spark, judge.scored_answers(F.lit(text), gt))]
    assert got == [("a1", "len", "n", 5, 4), ("v1", "buf", None, None, None)]
    schema = "prog_name string, func_name string, line_no int, scored array<struct<var:string,gt_varname:string,prediction:string,qa:int,qb:int>>"
    a = judge.judged_names(spark.createDataFrame([("p", "f", 1, [("a1", None, "x", 1, 1), ("v1", "buf", "x", 2, None)]), ("p", "f", 2, [("a1", None, "x", 3, 4)]), ("q", "f", 1, [("a1", "len", "x", 1, 1)])], schema))
    b = judge.judged_names(spark.createDataFrame([("p", "f", 1, [("a1", None, "x", 5, 5)]), ("q", "f", 1, [("a1", "size", "x", 1, 1)])], schema))
    origin = spark.createDataFrame([("p", True, None, "x"), ("q", True, "c", "x")], "prog_name string, seen boolean, category string, project string")
    fresh = spark.createDataFrame([("p", "f")], "prog_name string, func_name string")
    out = judge.compare_judged(a, b, origin, fresh).collect()
    assert [(r["prog_name"], r["a_qa"], r["a_qb"], r["b_qa"], r["overlapped"]) for r in out] == [("p", 3, 4, 5, False)]  # nulls meet nulls; names that differ do not meet


# -- relational


def test_vote_counts_repeated_names(spark):
    vectors = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8]}
    bag = [1, 1, 1, 2, 3]
    d = spark.createDataFrame([("k", n, vectors[n]) for n in bag], "key string, name int, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    want = max((round(sum(cos(n, m) for m in bag) / len(bag), 9), -n) for n in vectors)
    r = graph.vote(d, "key", "name", "v").first()
    assert r["name"] == -want[1] and abs(r["similarity"] - want[0]) < 1e-9


def test_a_key_without_an_entry_is_an_error(spark):
    d, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, True)], "k int, x boolean")
    assert relational.enforced(d.where("k = 1"), dim, "k", "x").first()["x"]
    with pytest.raises(PySparkException):
        relational.enforced(d, dim, "k", "x").collect()


def test_exact_split(spark):
    d = spark.createDataFrame([(f"p{i}",) for i in range(103)], "prog string")
    out = {r["prog"]: r["split"] for r in relational.permuted_split(d.repartition(5), "prog", 0.9).collect()}
    assert sum(v == "train" for v in out.values()) == 92 and out == {r["prog"]: r["split"] for r in relational.permuted_split(d, "prog", 0.9).collect()}
    assert relational.permuted_split(d.where("1 = 0"), "prog").count() == 0


def test_combined_files_in_order(spark):
    d = lambda *rows: spark.createDataFrame(list(rows), "k string, line int, name string")
    a, b = d(("x", 2, "n2"), ("x", 1, "n1")), d(("x", 1, "m"), ("y", 1, "o"))
    out = {r["k"]: [e["name"] for e in r["name_list"]] for r in relational.combine_files([("b", b), ("a", a), ("b", b)], ["k"], "line", ["name"]).collect()}
    assert out == {"x": ["m", "n1", "n2"], "y": ["o"]}


# -- sources and names


def test_json_lines(spark):
    scratch = Scratch(spark, "test")
    spark.createDataFrame([('{"a": 1}',), ("{oops",), ('{"a": 3}',)], "value string").coalesce(1).write.text(f"{scratch.root}/j")
    assert [r["a"] for r in tables.read_jsonl(spark, f"{scratch.root}/j", "a int", strict=False).collect()] == [1, 3]
    assert tables.read_jsonl(spark, f"{scratch.root}/j", "a int", strict=False, corrupt="c").agg(F.count("a"), F.count("c")).first() == (2, 1)
    assert [r["a"] for r in tables.read_jsonl(spark, f"{scratch.root}/j", "a int", first=1).collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, f"{scratch.root}/j", "a int").collect()
    with pytest.raises(FileNotFoundError):
        tables.read_files(spark, [f"{scratch.root}/nothing"])


@pytest.mark.parametrize(("name", "want"), [("_Z3fooi", "foo"), ("_ZN3abc3fooEv", "foo"), ("_ZNK3abc3fooEv_1", "foo"), ("_ZN3abcIiE3fooEv", "_ZN3abcIiE3fooEv"), ("plain_1", "plain_1"), ("_Z99x", "_Z99x"), ("", "")])
def test_demangled(spark, name, want):
    assert one(spark, N.demangled(F.lit(name))) == want


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lexivar.sources.scratch import shared_dir

    fake = lambda master, base: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: base), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert shared_dir(fake("spark://h:1", "hdfs://c/")) == "hdfs://c"
    with pytest.raises(ValueError):
        shared_dir(fake("spark://h:1", None))
