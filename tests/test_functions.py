"""Small inline rows with expectations derived by hand."""

from pyspark.sql import functions as F

from lexivar.functions import answers as A
from lexivar.functions import names as N
from lexivar.operators import graph as G
from lexivar.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_pairs(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])


def test_rename(spark):
    assert one(spark, N.rename(F.lit("f(a1,a1,a1) a1"), F.lit("a1"), F.lit("N"))) == "f(N,a1,N) a1"
    assert one(spark, N.rename_all(F.lit("f(a1, v2)"), lit_pairs(("a1", "len"), ("v2", "b$f")))) == "f(len, b$f)"


def test_mentions(spark):
    assert one(spark, N.mentions(F.lit(" sub_1(sub_2(x), sub_3(y))"))) == ["sub_1", "sub_3"]


def test_words(spark):
    for name, words in (("SHA256_Update", "sha update"), ("getHTTPResponse", "get http response"), ("a_b_c", "abc")):
        assert one(spark, N.split_words(F.lit(name))) == words


def test_score(spark):
    for gt, pred, p, r in (("Len", "len", 1, 1), ("buffer_size", "buf_len", 0.5, 0.5), ("buf", "buf_buf", 0.5, 1), ("__", "x", 0, 0)):
        assert tuple(one(spark, N.score_name(F.lit(gt), F.lit(pred)))) == (p, r)
    assert one(spark, N.f1(F.lit(0.0), F.lit(0.0))) == 0


def test_dummy_flavours(spark):
    assert one(spark, N.dummy_name(F.lit("v2ray"))) and not one(spark, N.dummy_name(F.lit("v2ray"), True))


def test_answers(spark):
    assert one(spark, A.parse_answer(F.lit(":{'a1': 'len', 'v2': 3}"))) == {"a1": "len", "v2": "3"}
    assert one(spark, A.parse_answer(F.lit("garbage"))) == {"Error": "garbage"}
    assert one(spark, A.parse_answer(F.lit(None).cast("string"))) == {"Error": ""}
    assert one(spark, A.repair_answer(F.lit("x {'a': 'b', 'c': 'd"))) == {"a": "b"}
    text = "```json\n[{'var': 'a', 'score': {'Q-A': 5, 'Q-B': 4}}]\n```"
    assert one(spark, A.fenced_json(F.lit(text), "array<struct<var:string,score:struct<`Q-A`:int,`Q-B`:int>>>"))[0]["score"]["Q-A"] == 5


def test_dominance(spark):
    c = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("precision"), F.lit(r).alias("recall")) for n, p, r in (("a", 0.5, 0.5), ("b", 0.9, 0.1), ("c", 0.5, 0.6))])
    assert one(spark, A.dominant_pick(c))["name"] == "c"


def test_hint_slice(spark):
    assert one(spark, A.hint_slice(F.array(*map(F.lit, "abcdefg")), 4)) == list("abcd")


def test_first_seen(spark):
    rows = [("A", "f"), ("A", "g"), ("B", "f"), ("B", "g"), ("B", "h"), ("C", "h"), ("C", "k"), ("D", "h"), ("D", "m"), ("D", "n"), ("D", "o")]
    df = spark.createDataFrame([(p, n, i) for i, (p, n) in enumerate(rows)], "p string, n string, i int")
    assert {r["p"] for r in R.first_seen_programs(df, "p", "n", ["i"]).collect()} == {"A", "D"}


def test_bins(spark):
    df = spark.createDataFrame([(f, 1.0) for f in (0, 1, 10, 11, 1000000)], "f long, m double")
    assert {r["upper"]: r["n"] for r in R.freq_bins(df, "f", ["m"]).collect()} == {0: 1, 10: 2, 100: 1, 1000: 0, 999999: 0}


def test_macro_and_mode(spark):
    df = spark.createDataFrame([("P1", "u", 0.2), ("P1", "u", 0.4), ("P2", "u", 1.0)], "p string, g string, m double")
    assert abs(R.macro_mean(df, "p", "g", ["m"]).first()["m"] - 0.65) < 1e-12
    seen = spark.createDataFrame([(1, v, i) for i, v in enumerate("baba")], "k int, v string, i int")
    assert R.mode_first(seen, ["k"], "v", "i").first()["mode"] == "b"


def test_rekey(spark):
    assert one(spark, N.rekey_address(F.lit("sub_4011D0"))) == "00000000004011D0"
    assert one(spark, N.rekey_address(F.lit("FUN_00101160"), 8, False)) == "00101160"


def test_edges(spark):
    df = spark.createDataFrame([("p", "sub_1", " sub_1(sub_2 ( ) ) sub_9 ;"), ("p", "sub_2", "")], "prog_name string, func_name string, body string")
    assert [tuple(r) for r in G.call_edges(df).collect()] == []  # a loop, a neighbour that shares its delimiter, an unknown function
    df = spark.createDataFrame([("p", "sub_1", "{ sub_2 ( ) ; }"), ("p", "sub_2", "")], "prog_name string, func_name string, body string")
    assert [tuple(r) for r in G.call_edges(df).collect()] == [("p", "sub_1", "sub_2")]
