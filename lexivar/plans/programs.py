"""Programs made from the table of orders: a customer is a program, an order a function of it.

Everything follows from the order's key k and from the next keys of the same customer, by expressions that mean the same in Spark SQL and in the SQL of
the queries: so a query builds raw programs and applies operators to them, while its SQL states the result from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivar.sources.tables import table

NL = "chr(10)"
_VERBS, _NOUNS = ("read", "write", "parse", "init", "free"), ("len", "buffer_size", "node", "path_name", "flags", "head", "msg_type")
VARS = {1: "a1", 2: "a2", 3: "v1", 4: "v2"}


def pick(index: str, words: tuple[str, ...]) -> str:
    return f"case ({index}) % {len(words)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(words)) + " end"


def verb(k: str) -> str:
    return pick(k, _VERBS)


def noun(k: str) -> str:
    return pick(k, _NOUNS)


def placeholder(k: str) -> str:
    return f"('sub_' || hex({k}))"


def truth_name(k: str = "k") -> str:
    """Function names: some that a compiler makes, main, and some equal to their placeholder."""
    return f"case {k} % 11 when 0 then '__cxa_x' when 1 then 'main' when 2 then {placeholder(k)} else {verb(k)} || '_' || {noun(k)} end"


def truth_var(j: int, k: str = "k") -> str:
    """Variables' names: some dummy, trivial or equal to the placeholder; null where the truth has none."""
    name = f"case ({k} + {j}) % 9 when 0 then 'v{j}' when 1 then 'i' when 2 then '{VARS[j]}' else ({noun(f'{k} + {j}')}) || case ({k} + {j}) % 4 when 0 then '_in' when 1 then '_out' else '' end end"
    return name if j < 3 else f"case when ({k} + {j - 2}) % 19 = 0 then null else {name} end"


#: (prog, k, n1, n2) of every function.
KEYS = """select 'p' || o_custkey || '_x' prog, o_orderkey k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) n1,
lead(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) n2 from {orders}"""
PARAMS = "case k % 3 when 0 then '' when 1 then 'int a1' else 'int a1, int a2' end"
ARGS = "case k % 3 when 0 then '' when 1 then 'v2' else 'v2, a1' end"
#: Strings of a function: one, or two where k % 8 = 0; long where k % 4 = 0.
STRING = "case when k % 4 = 0 then '\"a message of some length ' || k || '\"' else '\"s' || k || '\"' end"
#: What stands in a function's text, in order: a piece and the condition under which it is there.
_TEXT = [
    ("'__int64 __fastcall ' || {own} || '(' || {params} || ')' || {nl} || '{{' || {nl} || '  int v1; // eax' || {nl}", None),
    ("'  v1 = ' || {n1} || '(' || {args} || ');' || {nl}", "n1 is not null"),
    ("'  v2 = v1;' || {nl}", "k % 2 = 0"),
    ("'  puts(' || {string} || ');' || {nl}", None),
    ("'  puts(' || {string} || ');' || {nl}", "k % 8 = 0"),
    ("'  if ( v2 > 5 )' || {nl} || '  {{ ' || {n2} || '(v2, \"x\"); }}' || {nl}", "n2 is not null"),
    ("'  log_it(v1, (char *)v2);' || {nl}", None),
    ("'  return ' || {n1} || '(v2);' || {nl}", "n1 is not null and k % 5 = 0"),
    ("'  return v1;' || {nl}", "not (n1 is not null and k % 5 = 0)"),
    ("'}}'", None),
]
_PIECES = [(p.format(own=placeholder("k"), n1=placeholder("n1"), n2=placeholder("n2"), params=PARAMS, args=ARGS, string=STRING, nl=NL), c) for p, c in _TEXT]
#: Functions with k % 13 = 0 have a body too short to matter.
CODE = "case when k % 13 = 0 then 'int f() { return 0; }' else " + " || ".join(f"case when {c} then {p} else '' end" if c else p for p, c in _PIECES) + " end"
#: Whether a function is kept at ingest.
KEPT = "(k % 13 <> 0 and k % 11 <> 0)"


def keys(spark, d: str) -> DataFrame:
    """The same as KEYS, dealt out by program, so that what is worked out within programs stays in its task. What follows is far larger than these rows, so they are not coalesced."""
    x = table(spark, d, "orders").select(F.expr("'p' || o_custkey || '_x'").alias("prog"), F.col("o_orderkey").alias("k"))
    after = W.partitionBy("prog").orderBy("k")
    return x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "prog").select("prog", "k", F.lead("k").over(after).alias("n1"), F.lead("k", 2).over(after).alias("n2"))


def keys_sql() -> str:
    return KEYS.format(orders="orders")


def _entries(*items: tuple[Column, Column, Column]) -> Column:
    """An array of (pos, name) of the items whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.struct(p.alias("pos"), n.alias("name"))) for c, p, n in items]), lambda x: x.isNotNull())


def raw_functions(spark, d: str) -> DataFrame:
    """(prog_name, func_seq, gt, stripped): raw function entries, a struct of names, arguments and locals by position for each side."""
    x = keys(spark, d)
    e = F.expr
    args = [(e(f"k % 3 >= {j}"), F.lit(f"r{j}"), j) for j in (1, 2)]
    places = [(F.lit(True), e("case when k % 17 = 0 then 'r1' else 's1' end"), 3), (F.lit(True), F.lit("s2"), 4)]
    side = lambda name, code, of: F.struct(name.alias("name"), *code, _entries(*[(c & of(j).isNotNull(), p, of(j)) for c, p, j in args]).alias("args"), _entries(*[(c & of(j).isNotNull(), p, of(j)) for c, p, j in places]).alias("locals"))
    return x.select(
        F.col("prog").alias("prog_name"), F.col("k").alias("func_seq"),
        side(e(truth_name()), [], lambda j: e(truth_var(j))).alias("gt"),
        side(e(placeholder("k")), [e(CODE).alias("code")], lambda j: F.lit(VARS[j])).alias("stripped"),
    )


def predicted(j: int, k: str = "k") -> str:
    """A predicted name of variable j, or null."""
    return f"case when ({k} + {j}) % 3 <> 0 then ({noun(f'{k} * 3 + {j}')}) || '_p' end"


#: Predicted names of a function itself and of its first callee.
PREDICTED_OWN, PREDICTED_N1 = f"case when k % 4 <> 1 then ({verb('k + 2')}) || '_fn' end", f"case when n1 is not null and k % 6 = 0 then ({verb('k')}) || '_c' end"
_LINES = [*((f"'{VARS[j]}'", predicted(j)) for j in VARS), (placeholder("k"), PREDICTED_OWN), (placeholder("n1"), PREDICTED_N1)]


def scored_names(spark, d: str) -> DataFrame:
    """(prog_name, func_name, varname, pred_name, line_no): predictions of kept functions, line by line."""
    x = keys(spark, d).where(KEPT)
    lines = F.array(*[F.struct(F.expr(name).alias("varname"), F.expr(value).alias("pred_name"), (F.col("k") * 6 + i).alias("line_no")) for i, (name, value) in enumerate(_LINES)])
    x = x.select(F.col("prog").alias("prog_name"), F.expr(placeholder("k")).alias("func_name"), F.explode(lines).alias("x"))
    return x.select("prog_name", "func_name", "x.*").where("pred_name is not null and varname is not null")


#: Rounds of candidates: the name that round r gives to variable j, empty at times; in functions with even k all rounds that answer agree.
ROUNDS = 3


def candidate(j: int, r: int, k: str = "k") -> str:
    return f"case when ({k} + {j} + {r}) % 5 = 0 then '<emptyname>' else {noun(f'{k} * 2 + {j} + {r} * ({k} % 2)')} end"


def candidate_names(spark, d: str) -> DataFrame:
    """(prog_name, func_name, varname, candidates): combined rounds of kept functions; a1 and a2 have names only where they are parameters."""
    x = keys(spark, d).where(KEPT)
    # A varying measure, so that candidates differ in precision.
    of = lambda j: F.array(*[F.struct(F.lit(r).alias("round"), F.expr(candidate(j, r)).alias("pred_name"), F.expr(f"(k * 7 + {j} * 3 + {r} * 5) % 4 / 4D").alias("precision")) for r in range(ROUNDS)])
    rows = F.filter(F.array(*[F.when(F.expr(f"k % 3 >= {j}") if j < 3 else F.lit(True), F.struct(F.lit(v).alias("varname"), of(j).alias("candidates"))) for j, v in VARS.items()]), lambda e: e.isNotNull())
    return x.select(F.col("prog").alias("prog_name"), F.expr(placeholder("k")).alias("func_name"), F.explode(rows).alias("x")).select("prog_name", "func_name", "x.*")


def default_names(spark, d: str) -> DataFrame:
    x = keys(spark, d).where(KEPT)
    rows = F.array(*[F.struct(F.lit(v).alias("varname"), F.expr(f"case when (k + {j}) % 2 = 0 then 'default{j}' end").alias("pred_name")) for j, v in VARS.items()])
    return x.select(F.col("prog").alias("prog_name"), F.expr(placeholder("k")).alias("func_name"), F.explode(rows).alias("x")).select("prog_name", "func_name", "x.*").where("pred_name is not null")


def name_vectors(spark, d: str) -> DataFrame:
    """(name, embedding): each noun has the vector of its number."""
    nouns = spark.createDataFrame(list(enumerate(_NOUNS)), "vec_id long, name string")
    return table(spark, d, "embeddings").join(F.broadcast(nouns), "vec_id").select("name", "embedding")


def name_vectors_sql() -> str:
    return f"select {noun('vec_id')} name, embedding::double[] e from embeddings where vec_id < {len(_NOUNS)}"


def said(j: int, pos: int | str, k: str = "k") -> str:
    """What answer pos says for variable j."""
    return f"({noun(f'{k} * 5 + {j} + {pos}')}) || case ({k} + {j} * {pos}) % 3 when 0 then '_in' else '' end"


def said_own(pos: int | str, k: str = "k") -> str:
    return f"({verb(f'{k} + {pos}')}) || '_' || ({noun(f'{k} + {pos}')})"


ANSWERS = 3
PROB = "(k * 3 + {pos} * 7) % 5 / 10.0"


def answer_text(pos: int | str) -> str:
    """An answer as text, in eight shapes: a map as it is, behind a colon, in prose, none at all, cut off at its end, cut off at its start, empty, and two maps."""
    a, b, c = said(1, pos), said(3, pos), said_own(pos)
    first, rest = f"'{{''a1'': ''' || ({a}) || ''''", f"', ''v1'': ''' || ({b}) || ''''"
    own = f"', ''' || {placeholder('k')} || ''': ''' || ({c}) || ''''"
    whole = f"{first} || {rest} || {own} || '}}'"
    shapes = [
        whole, f"':' || {whole}", f"'sure: ' || {whole} || ' done'", "'garbage ' || k", f"'x ' || {first} || {rest} || ', ''v2'': ''cut'",
        f"'q'', ''a1'': ''' || ({a}) || ''''|| {rest} || '}}'", "''", f"{first} || '}} ' || '{{''v1'': ''' || ({b}) || '''}}'",
    ]
    return f"case (k + {pos}) % 8 " + " ".join(f"when {i} then {x}" for i, x in enumerate(shapes)) + " end"


def model_answers(spark, d: str) -> DataFrame:
    """(prog_name, func_name, answers): raw answers of kept functions, with differing probabilities."""
    x = keys(spark, d).where(KEPT)
    answers = F.expr(f"transform(sequence(0, {ANSWERS - 1}), pos -> named_struct('pos', pos, 'raw', {answer_text('pos')}, 'prob', cast({PROB.format(pos='pos')} as double)))")
    return x.select(F.col("prog").alias("prog_name"), F.expr(placeholder("k")).alias("func_name"), answers.alias("answers"))


#: What the answers say once parsed and mended: rows (prog, f, pos, prob, id, name) over fun.
ANSWER_ROWS = " union all ".join(
    f"select prog, f, {p} pos, {PROB.format(pos=p)} prob, {i} id, {n} name from fun where (k + {p}) % 8 in ({s})"
    for p in range(ANSWERS)
    for i, n, s in (("'a1'", said(1, p), "0, 1, 2, 4, 5"), ("'v1'", said(3, p), "0, 1, 2, 4, 5, 7"), (placeholder("f"), said_own(p), "0, 1, 2"))
)


def judge_response(spark, d: str, side: int) -> DataFrame:
    """(prog_name, func_name, line_no, response): a judge's answers on variables of kept functions, one block each; a name without a score and a broken block at times."""
    x = keys(spark, d).where(KEPT).where(f"k % {3 + side} <> 0")
    block = lambda j: f"'```json' || {NL} || {judge_block(j, side)} || {NL} || '```' || {NL}"
    text = " || ".join(f"coalesce({block(j)}, '')" for j in (3, 4))
    return x.select(F.col("prog").alias("prog_name"), F.expr(placeholder("k")).alias("func_name"), F.col("k").alias("line_no"), F.expr(f"'Summary. ' || {text}").alias("response"))


def judge_scores(j: int, side: int, k: str = "k") -> tuple[str, str]:
    return f"(1 + ({k} + {j} * 2 + {side}) % 5)", f"(1 + ({k} * 2 + {j} + {side}) % 5)"


def judge_block(j: int, side: int) -> str:
    qa, qb = judge_scores(j, side)
    full = f"'{{''var'': ''' || ({truth_var(j)}) || ''', ''prediction'': ''p{side}'', ''score'': {{''Q-A'': ' || {qa} || ', ''Q-B'': ' || {qb} || '}}}}'"
    return f"case when (k + {j}) % 10 = 3 then '{{''var'': ''' || ({truth_var(j)}) || '''}}' when (k + {j}) % 10 = 4 then '{{broken' when (k + {j}) % 10 = 5 then '{{''note'': 1}}' else {full} end"


def judge_list(spark, d: str) -> DataFrame:
    """Names to judge in two layouts: some rows give the program under one pair of columns, some under the other."""
    x = keys(spark, d).where("k % 4 = 1 or k % 6 = 2")
    prefix, name, other = F.expr("split_part(prog, '_', 1)"), F.expr(placeholder("k")), F.lit("?")
    mine = F.expr("k % 4 = 1")
    x = x.select(
        F.when(mine, prefix).otherwise(other).alias("prog_name"), F.when(mine, name).otherwise(other).alias("func_name"), F.when(mine, other).otherwise(prefix).alias("binary"),
        F.when(mine, other).otherwise(name).alias("funcname"), F.explode(F.array(*map(F.lit, VARS.values()))).alias("ori_name"),
    )
    return x
