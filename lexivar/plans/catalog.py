"""Each query applies library operators to the driver tables; ORACLE holds the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivar.functions import answers as A
from lexivar.functions import names as N
from lexivar.operators import graph as G
from lexivar.operators import relational as R
from lexivar.operators.fuzzy import fuzzy_overlap
from lexivar.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from lexivar.sources.tables import table as t

_KEY = ["prog", "func", "var", "part"]


def _systems(spark, d, **measures: tuple[str, str]) -> DataFrame:
    """One row a key with the last value of each system, keys that all systems have: one scan and one shuffle for all of them."""
    li = t(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("prog"), F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("var"), F.col("l_partkey").alias("part"), *[F.when(F.expr(w), F.col(m)).alias(n) for n, (m, w) in measures.items()])
    return R.common_keys(rows, _KEY, list(measures))


_SYS = "select l_suppkey prog, l_orderkey func, l_linenumber var, l_partkey part, max({m}) v from lineitem where {w} group by all"


@query(f"""
with a as ({_SYS.format(m="l_discount", w="true")}), b as ({_SYS.format(m="l_tax", w="l_returnflag <> 'R'")}),
x as (select a.prog, a.v pa, b.v pb, n.n_regionkey < 2 in_train from a join b using (prog, func, var, part) join orders o on o.o_orderkey = func and o.o_orderstatus = 'O'
      join supplier s on s.s_suppkey = prog join nation n on n.n_nationkey = s.s_nationkey),
p as (select prog, in_train, avg(pa) pa, avg(pb) pb, count(*) n from x group by all)
select in_train, round(avg(pa), 6) precision_a, round(avg(pb), 6) precision_b, count(*) n_programs, cast(sum(n) as bigint) n from p group by in_train""")
def macro_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two systems on common keys, not overlapping, macro mean by project seen in training; a program without an origin is an error."""
    both = _systems(spark, d, pa=("l_discount", "true"), pb=("l_tax", "l_returnflag <> 'R'"))
    fresh = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("func"))
    origin = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("prog"), (F.col("n_regionkey") < 2).alias("in_train"))
    rows = R.enforced(both.join(fresh, "func", "left_semi"), origin, "prog", "in_train")
    out = R.macro_mean(rows, "prog", "in_train", ["pa", "pb"])
    return out.select("in_train", F.round("pa", 6).alias("precision_a"), F.round("pb", 6).alias("precision_b"), "n_programs", "n")


@query(f"""
with a as ({_SYS.format(m="l_discount", w="true")}), b as ({_SYS.format(m="l_tax", w="l_returnflag <> 'R'")}), c as ({_SYS.format(m="l_quantity", w="l_linestatus = 'O'")}),
p as (select a.prog, avg(a.v) pa, avg(b.v) pb, avg(c.v) pc, count(*) n from a join b using (prog, func, var, part) join c using (prog, func, var, part) group by a.prog)
select round(avg(pa), 6) pa, round(avg(pb), 6) pb, round(avg(pc), 6) pc, count(*) n_programs, cast(sum(n) as bigint) n from p""")
def macro_global(spark, d):
    """Three systems on their common keys, mean per program, then over all."""
    rows = _systems(spark, d, pa=("l_discount", "true"), pb=("l_tax", "l_returnflag <> 'R'"), pc=("l_quantity", "l_linestatus = 'O'"))
    out = R.macro_mean(rows, "prog", None, ["pa", "pb", "pc"])
    return out.select(*[F.round(x, 6).alias(x) for x in ("pa", "pb", "pc")], "n_programs", "n")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from
(select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_extendedprice desc) r from lineitem) where r = 1""")
def last_wins(spark, d):
    """The last row of each key, in a total order."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.last_wins(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("""with f as (select l_partkey, count(*) n from lineitem group by 1 having count(*) > 25), x as (select l_discount a, l_tax b, coalesce(n, 0) f from lineitem left join f using (l_partkey)),
e(upper, lower) as (values (0, -1), (10, 0), (100, 10), (1000, 100), (999999, 1000))
select cast(upper as bigint) upper, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, count(a) n from e left join x on f > lower and f <= upper group by upper""")
def freq_bins(spark, d):
    """Means by how often a name stood in training; its SQL counts names seen 25 times or less as absent, freq_bins_all does not. Empty bins stay."""
    li = t(spark, d, "lineitem")
    return _freq_means(li, li, over=25)


def _freq_means(rows: DataFrame, train: DataFrame, over: int = 0) -> DataFrame:
    """Means of rows by the frequency of their names in train; names that stand there `over` times or less count 0."""
    freq = train.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > over)
    rows = rows.join(freq, "l_partkey", "left").select(F.coalesce("f", F.lit(0)).alias("f"), F.col("l_discount").alias("mean_a"), F.col("l_tax").alias("mean_b"))
    out = R.freq_bins(rows, "f", ["mean_a", "mean_b"])
    return out.select("upper", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "n")


@query("""with f as (select l_partkey, count(*) n from lineitem where l_orderkey % 10 = 0 group by 1), x as (select l_discount a, l_tax b, coalesce(n, 0) f from lineitem left join f using (l_partkey) where l_orderkey % 10 <> 0),
e(upper, lower) as (values (0, -1), (10, 0), (100, 10), (1000, 100), (999999, 1000))
select cast(upper as bigint) upper, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, count(f) n from e left join x on f > lower and f <= upper group by upper""")
def freq_bins_all(spark, d):
    """The same with every name counted, on a train side (orders whose key ends in 0) that truly lacks some names of the rest."""
    li = t(spark, d, "lineitem")
    return _freq_means(li.where("l_orderkey % 10 <> 0"), li.where("l_orderkey % 10 = 0"))


@query("""select 'quality' measure, cast(quality as bigint) score, count(*) n from labels group by all union all select 'toxic', cast(toxic as bigint), count(*) from labels group by all""")
def histogram(spark, d):
    """Counts by score of several measures in one pass."""
    x = t(spark, d, "labels").unpivot([], ["quality", "toxic"], "measure", "score").where("score is not null")
    return x.groupBy("measure", F.col("score").cast("bigint").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select *, row_number() over (partition by md5(text) order by doc_id) r from documents)
select source, cast(sum(case when r = 1 then 1 else 0 end) as bigint) n_new, count(*) n_total from x group by source having sum(case when r = 1 then 1 else 0 end) > count(*) * 0.7e0""")
def first_seen_dedup(spark, d):
    """Programs that bring more than 70 % of new functions, by first occurrence over all programs."""
    docs = t(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("name"))
    return R.first_seen_programs(docs, "source", "name", ["doc_id"]).withColumnRenamed("prog", "source")


@query("""select doc_id, case when cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) % 1000 < 900 then 'train' else 'test' end split from documents""")
def split_train_test(spark, d):
    """A seeded 90/10 split by the hash of each key alone; split_programs (O2) permutes and cuts exactly."""
    return R.hash_split(t(spark, d, "documents").select("doc_id"), "doc_id")


@query("""select a.doc_id test_id, b.doc_id train_id, cast(100 as integer) name_ratio from documents a join documents b on md5(a.text) = md5(b.text) where a.doc_id % 10 = 9 and b.doc_id % 10 <> 9""")
def exact_overlap(spark, d):
    """Test and training functions of equal text; overlap_exact (J4) goes by signature."""
    docs = t(spark, d, "documents").select("doc_id", F.md5("text").alias("sig"))
    test, train = docs.where("doc_id % 10 = 9").withColumnRenamed("doc_id", "test_id"), docs.where("doc_id % 10 <> 9").withColumnRenamed("doc_id", "train_id")
    return test.join(train, "sig").select("test_id", "train_id", F.lit(100).alias("name_ratio"))


@query()
def fuzzy_name_overlap(spark, d):
    """Pairs of distinct names with a matching-blocks ratio over 90 between two parts of `part`; overlap_candidates joins such pairs back to functions."""
    names = t(spark, d, "part").select("p_partkey", "p_name")
    return fuzzy_overlap(names.where("p_partkey % 10 = 9").select("p_name"), names.where("p_partkey % 10 <> 9").select("p_name"), "p_name")


@query("""select p_partkey, regexp_replace(regexp_replace(' ' || p_name || ' ;', '([^a-zA-Z0-9_@]|^)(' || split_part(p_name, ' ', 1) || ')([^a-zA-Z0-9_@])', '\\1v1\\3', 'g'), '([^a-zA-Z0-9_@]|^)(' || split_part(p_name, ' ', 2) || ')([^a-zA-Z0-9_@])', '\\1v2\\3', 'g') renamed from part where regexp_full_match(p_name, '[a-zA-Z]+ [a-zA-Z]+.*')""")
def rename(spark, d):
    """Ordered renames of delimited names."""
    p = t(spark, d, "part").where(F.col("p_name").rlike("^[a-zA-Z]+ [a-zA-Z]+"))
    w = F.split("p_name", " ")
    pairs = F.array(*[F.struct(w[i].alias("k"), F.lit(f"v{i + 1}").alias("v")) for i in (0, 1)])
    return p.select("p_partkey", N.rename_all(F.concat(F.lit(" "), "p_name", F.lit(" ;")), pairs).alias("renamed"))


@query("""with x as (select page_id, ' __int64 f(_DWORD a' || page_id || ') ; undefined4 b ;' code from pages)
select page_id, regexp_replace(regexp_replace(code, '([^a-zA-Z0-9_@]|^)(__int64)([^a-zA-Z0-9_@])', '\\1long\\3', 'g'), '([^a-zA-Z0-9_@]|^)(_DWORD)([^a-zA-Z0-9_@])', '\\1int\\3', 'g') ida,
regexp_replace(regexp_replace(regexp_replace(code, '([^a-zA-Z0-9_@]|^)(undefined4)([^a-zA-Z0-9_@])', '\\1int\\3', 'g'), '([^a-zA-Z0-9_@]|^)(__int64)([^a-zA-Z0-9_@])', '\\1long\\3', 'g'), '([^a-zA-Z0-9_@]|^)(_DWORD)([^a-zA-Z0-9_@])', '\\1int\\3', 'g') ghidra from x""")
def sanitize(spark, d):
    """Decompiler types to plain ones."""
    x = t(spark, d, "pages").select("page_id", F.concat(F.lit(" __int64 f(_DWORD a"), F.col("page_id").cast("string"), F.lit(") ; undefined4 b ;")).alias("code"))
    return x.select("page_id", N.sanitize_types("code").alias("ida"), N.sanitize_types("code", N.GHIDRA_TYPES | N.IDA_TYPES).alias("ghidra"))


_CODE = "'{ sub_' || (l_partkey % 50) || ' ( sub_' || (l_suppkey % 50) || ' ) ; }'"


@query(f"""with f as (select o_custkey % 20 prog_name, 'sub_' || (o_orderkey % 50) func_name, o_orderkey, {_CODE} body from orders join lineitem on l_orderkey = o_orderkey),
m as (select distinct prog_name, func_name caller, unnest(regexp_extract_all(body, '([^a-zA-Z0-9_]|^)(sub_[0-9a-fA-F_]*)([^a-zA-Z0-9_])', 2)) callee from f),
e as (select distinct m.* from m where caller <> callee and exists (select 1 from f where f.prog_name = m.prog_name and f.func_name = m.callee)),
n as (select distinct prog_name, func_name from f)
select n.prog_name, n.func_name, count(callee) out_degree from n left join e on e.prog_name = n.prog_name and e.caller = n.func_name group by all""")
def call_graph_degree(spark, d):
    """Call edges out of code text, and each function's out-degree."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    body = F.concat(F.lit("{ sub_"), (F.col("l_partkey") % 50).cast("string"), F.lit(" ( sub_"), (F.col("l_suppkey") % 50).cast("string"), F.lit(" ) ; }"))
    fn = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.col("o_custkey") % 20).alias("prog_name"), F.concat(F.lit("sub_"), (F.col("o_orderkey") % 50).cast("string")).alias("func_name"), body.alias("body"))
    return G.out_degrees(fn.select("prog_name", "func_name").distinct(), G.call_edges(fn))


@query("""with x as (select c_custkey, case c_custkey % 8 when 0 then 'v' || c_custkey when 1 then 'a' || c_custkey || 'x' when 2 then 'ret' when 3 then '__' || c_name when 4 then '_start' when 5 then '.' || c_name when 6 then '' else c_name end n from customer)
select c_custkey, not (n in ('_start') or regexp_matches(n, '^(\\.|__)')) func_ok, trim(n) = '' or regexp_matches(n, '^[va][0-9]+') dummy, trim(n) = '' or regexp_matches(n, '^(v[0-9]+|a[0-9]+|[_0-9]+)\\b') dummy_eval, n in ('i', 'j', 'k', 'ret') trivial from x""")
def name_filters(spark, d):
    """Predicates on names, both flavours."""
    c = F.col("c_custkey")
    n = F.element_at(F.array(F.concat(F.lit("v"), c), F.concat(F.lit("a"), c, F.lit("x")), F.lit("ret"), F.concat(F.lit("__"), "c_name"), F.lit("_start"), F.concat(F.lit("."), "c_name"), F.lit(""), F.col("c_name")), (c % 8 + 1).cast("int"))
    x = t(spark, d, "customer").select("c_custkey", n.alias("n"))
    return x.select("c_custkey", N.interesting_function("n").alias("func_ok"), N.dummy_name("n").alias("dummy"), N.dummy_name("n", True).alias("dummy_eval"), N.trivial_name("n").alias("trivial"))


@query("""select p_partkey, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(p_type, '([A-Z])', ' \\1', 'g')), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') tokens
from (select p_partkey, 'get' || upper(substr(p_name, 1, 1)) || lower(split_part(substr(p_name, 2), ' ', 1)) || '_size' p_type from part) """)
def tokenize(spark, d):
    """camel case and underscores to tokens."""
    n = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring_index(F.expr("substring(p_name, 2)"), " ", 1)), F.lit("_size"))
    return t(spark, d, "part").select("p_partkey", N.tokenize(n).alias("tokens"))


_TOK = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')"
_SAME = "(x = y or (least(length(x), length(y)) >= 2 and case when length(x) <= length(y) then starts_with(y, x) or suffix(y, x) else starts_with(x, y) or suffix(x, y) end))"


@query(f"""with x as (select p_partkey, p_name g, lead(p_name) over (partition by p_brand order by p_partkey) q from part), y as (select *, {_TOK.format("g")} gt, {_TOK.format("q")} pt from x where q is not null),
s as (select p_partkey, case when lower(g) = lower(q) then 1 when len(gt) = 0 or len(pt) = 0 then 0 else len(list_distinct(list_filter(pt, lambda x: len(list_filter(gt, lambda y: {_SAME})) > 0))) / len(pt) end p,
case when lower(g) = lower(q) then 1 when len(gt) = 0 or len(pt) = 0 then 0 else len(list_distinct(list_filter(gt, lambda x: len(list_filter(pt, lambda y: {_SAME})) > 0))) / len(gt) end r from y)
select p_partkey, round(p, 6) "precision", round(r, 6) recall, round(case when p + r < 0.001 then 0 else 2 * p * r / (p + r) end, 6) f1 from s""")
def score_pairs(spark, d):
    """Token precision and recall of a predicted name."""
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    x = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("g"), F.lead("p_name").over(w).alias("q")).where("q is not null")
    x = x.withColumn("s", N.score_name("g", "q"))
    return x.select("p_partkey", F.round("s.precision", 6).alias("precision"), F.round("s.recall", 6).alias("recall"), F.round(N.f1("s.precision", "s.recall"), 6).alias("f1"))


@query("""select cast(event_id as bigint) event_id, cast(json_extract(props, '$.k') as varchar) k, true valid from events""")
def parse_answers(spark, d):
    """tolerant parse of answer text to a map."""
    e = t(spark, d, "events").select("event_id", A.parse_answer(F.concat(F.lit(":"), "props")).alias("m"))
    return e.select("event_id", F.element_at("m", "k").alias("k"), A.is_valid("m").alias("valid"))


@query("""with x as (select event_type, event_id % 3 k, event_id from events) select count(*) total, cast(sum(case when k = 0 then 1 else 0 end) as bigint) error, cast(sum(case when k = 1 then 1 else 0 end) as bigint) fixed, round(sum(case when k = 0 then 1 else 0 end) / count(*), 6) error_ratio from x""")
def repair_counts(spark, d):
    """Broken, repaired and sound answers, counted in one aggregate."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.lit("garbage")).when(k == 1, F.lit("xx {'a1': 'len', 'v2': 'bu")).otherwise(F.lit("{'a1': 'len'}"))
    e = t(spark, d, "events").select(text.alias("s")).select(A.parse_answer("s").alias("p"), A.repair_answer("s").alias("r"))
    bad, still = ~A.is_valid("p"), ~A.is_valid("r")
    return e.agg(F.count(F.lit(1)).alias("total"), F.count_if(still).alias("error"), F.count_if(bad & ~still).alias("fixed"), F.round(F.try_divide(F.count_if(still), F.count(F.lit(1))), 6).alias("error_ratio"))


@query("""select conv_id, list(text order by turn)[1] first_answer, cast(count(*) as integer) n_answers, array_to_string(list(role order by turn), ',') roles from conversations group by conv_id""")
def transpose_answers(spark, d):
    """Answers of an id as an ordered list, and the first."""
    x = R.ordered_lists(t(spark, d, "conversations"), ["conv_id"], ["turn"], ["role", "text"])
    return x.select("conv_id", F.element_at("items", 1)["text"].alias("first_answer"), F.size("items").alias("n_answers"), F.array_join("items.role", ",").alias("roles"))


@query("""with o as (select l_orderkey, l_linenumber, l_partkey, l_discount p, l_tax r, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_discount, l_tax) i from lineitem),
x as (select a.l_orderkey, b.l_orderkey is not null and b.p >= a.p and b.r >= a.r bw, a.l_linenumber al, a.l_partkey ak, a.p ap, a.r ar, b.l_linenumber bl, b.l_partkey bk, b.p bp, b.r br from (select * from o where i = 1) a left join (select * from o where i = 2) b using (l_orderkey)),
y as (select l_orderkey, case when bw then bl else al end l, case when bw then bk else ak end k, case when bw then bp else ap end p, case when bw then br else ar end r from x),
z as (select y.*, c.l_orderkey is not null and c.p >= y.p and c.r >= y.r cw, c.l_linenumber cl, c.l_partkey ck, c.p cp, c.r cr from y left join (select * from o where i = 3) c using (l_orderkey))
select l_orderkey, case when cw then cl else l end l_linenumber, case when cw then ck else k end l_partkey, case when cw then cp else p end "precision", case when cw then cr else r end recall from z""")
def dominant_pick(spark, d):
    """Among the first three answers the last that is no worse in precision and recall than the best so far."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"))
    x = R.ordered_lists(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["precision", "recall"])
    return x.withColumn("p", A.dominant_pick("items")).select("l_orderkey", F.col("p.l_linenumber").alias("l_linenumber"), F.col("p.l_partkey").alias("l_partkey"), "p.precision", "p.recall")


@query("""select user_id, array_to_string(list(event_type || ':' || event_id order by event_type, event_id), ',') names, count(*) n from events group by user_id""")
def combine_rounds(spark, d):
    """A3: the rounds of all types, the missing one included, as one ordered candidate list a key."""
    x = R.ordered_lists(t(spark, d, "events"), ["user_id"], ["event_type", "event_id"], [])
    names = F.filter(F.transform("items", lambda i: F.concat(i["event_type"], F.lit(":"), i["event_id"].cast("string"))), lambda x: x.isNotNull())
    return x.select("user_id", F.when(F.size(names) > 0, F.array_join(names, ",")).alias("names"), F.size("items").cast("bigint").alias("n"))


@query("""with c as (select l_orderkey, list(distinct trim(l_returnflag || l_linestatus || (l_suppkey % 9))) s from lineitem group by 1)
select o_orderkey, coalesce(array_to_string(list_sort(s)[1:4], '|'), 'none') callees from orders left join c on c.l_orderkey = o_orderkey""")
def hints(spark, d):
    """At most four distinct hints a function, none where there is no call."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders").select("o_orderkey")
    h = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 9).cast("string")))).alias("s"))
    return o.join(h, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.array_join(A.hint_slice("s", 4), "|"), F.lit("none")).alias("callees"))


@query("""with x as (select l_orderkey, list(distinct l_linenumber) ids from lineitem group by 1), y as (select *, row_number() over (order by l_orderkey) - 1 i from x)
select l_orderkey, chr(10) || 'order ' || l_orderkey || chr(10) || chr(10) || chr(10) || chr(10) || 'Q:[' || array_to_string(list_transform(list_sort(ids)[1:20], lambda v: cast(v as varchar)), ',') || ',]A' prompt
from x where l_orderkey between 10 and 500 and exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'O')""")
def prompts(spark, d):
    """Prompts of listed functions whose key lies in its SQL's window; prompts_all takes every function. Twenty ids at most."""
    return prompt_rows(t(spark, d, "lineitem").where("l_orderkey between 10 and 500"), t(spark, d, "orders"))


def prompt_rows(lines: DataFrame, orders: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Prompts of the listed functions among those that stand at the positions first to last (from 0, both included) in the order of keys; all by default."""
    wanted = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    x = R.positions(lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids")), ["l_orderkey"], first, last).join(wanted, "l_orderkey", "left_semi")
    return x.select("l_orderkey", A.render_prompt(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), F.transform("ids", lambda v: v.cast("string"))).alias("prompt"))


@query("""with x as (select l_orderkey, list(distinct l_linenumber) ids from lineitem group by 1)
select l_orderkey, chr(10) || 'order ' || l_orderkey || chr(10) || chr(10) || chr(10) || chr(10) || 'Q:[' || array_to_string(list_transform(list_sort(ids)[1:20], lambda v: cast(v as varchar)), ',') || ',]A' prompt
from x where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'O')""")
def prompts_all(spark, d):
    """Prompts of all listed functions; prompt_rows() takes a range of positions."""
    return prompt_rows(t(spark, d, "lineitem"), t(spark, d, "orders"))


@query("""with c as (select user_id, event_type, count(*) n, min(event_id) fst from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, fst) k, sum(n) over (partition by user_id) s from c)
select user_id, event_type as mode, round(n / s, 6) share from r where k = 1""")
def mode_vote(spark, d):
    """The most frequent name with its share, ties to the first seen."""
    return R.mode_first(t(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", "mode", F.round("share", 6).alias("share"))


@query("""with e as (select vec_id, label, embedding::double[] v from embeddings), s as (select a.label, a.vec_id, avg(list_cosine_similarity(a.v, b.v)) s from e a join e b on a.label = b.label group by all)
select label, arg_max(vec_id, struct_pack(s := round(s, 9), k := -vec_id)) vec_id, round(max(s), 5) similarity from s group by label""")
def cosine_vote(spark, d):
    """The candidate nearest on average to its bag, without pairing the bag."""
    return G.vote(t(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", F.round("similarity", 5).alias("similarity"))


@query("""with e as (select distinct s_suppkey dst, (s_suppkey * 7 + 3) % 50 src, s_suppkey % 3 <> 0 tr from supplier), l1 as (select distinct dst, src from e where dst <> src),
h2 as (select distinct e.dst, l1.src from e join l1 on l1.dst = e.src where e.tr and e.dst <> l1.src and e.dst <> e.src), l2 as (select * from h2 except select * from l1),
h3 as (select distinct e.dst, l2.src from e join l2 on l2.dst = e.src where e.tr and e.dst <> l2.src and e.dst <> e.src), l3 as (select * from h3 except select * from l1 except select * from l2)
select dst, src, cast(1 as integer) as level from l1 where src % 2 = 1 union all select dst, src, 2 from l2 where src % 2 = 1 union all select dst, src, 3 from l3 where src % 2 = 1""")
def propagate(spark, d):
    """Names carried along edges for three rounds; some edge kinds do not carry further."""
    e = t(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), ((F.col("s_suppkey") * 7 + 3) % 50).alias("src"), (F.col("s_suppkey") % 3 != 0).alias("transitive"))
    nodes = e.select(F.col("src").alias("node")).where("node % 2 = 1")
    return G.propagate(e, nodes).select("dst", "src", "level")


@query("""with x as (select l_orderkey, max(l_discount) best, min(l_discount) worst, count(distinct l_discount) n, arg_max(l_partkey, struct_pack(d := l_discount, k := l_linenumber, p := l_partkey)) chosen, arg_min(l_partkey, struct_pack(d := l_discount, k := l_linenumber, p := l_partkey)) rejected from lineitem group by 1)
select l_orderkey, chosen, rejected, best, worst from x where n >= 2 and best >= 0.04 and best > worst + 0.02""")
def preference(spark, d):
    """Best and worst answer of entries with two distinct answers at least, apart by a margin."""
    key = F.struct("l_discount", "l_linenumber", "l_partkey")
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", key).alias("chosen"), F.min_by("l_partkey", key).alias("rejected"), F.max("l_discount").alias("best"), F.min("l_discount").alias("worst"))
    return x.where("best >= 0.04 and best > worst + 0.02D")  # differing extremes are two distinct answers


@query("""with x as (select page_id, list_transform(list_filter(regexp_split_to_array(regexp_extract(url, '//([^/]*)', 1), '[^a-zA-Z]'), lambda w: length(w) > 1), lambda w: lower(w)) f from pages),
tr as (select distinct unnest(f) w from x where page_id % 2 = 0)
select page_id, exists (select 1 from tr where list_contains(f, w)) seen from x where page_id % 2 = 1""")
def project_leak(spark, d):
    """whether any fragment of the project's name stands in training; project_seen has the rule of J22."""
    x = t(spark, d, "pages").select("page_id", N.project_fragments(F.regexp_extract("url", "//([^/]*)", 1)).alias("f"))
    known = x.where("page_id % 2 = 0").select(F.explode("f").alias("w")).distinct().withColumn("hit", F.lit(True))
    hit = x.where("page_id % 2 = 1").select("page_id", F.explode_outer("f").alias("w")).join(known, "w", "left")
    return hit.groupBy("page_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("seen"))


@query("""select o_orderkey, printf('%016X', o_orderkey) upper_key, printf('%08x', o_orderkey) short_key, 'p' || o_custkey prog from orders""")
def rekey_hex(spark, d):
    """Addresses in names brought to one form."""
    x = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("sub_"), F.hex("o_orderkey")).alias("n"), F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("_x_y")).alias("p"))
    return x.select("o_orderkey", N.rekey_address("n").alias("upper_key"), N.rekey_address("n", 8, False).alias("short_key"), N.program_prefix("p").alias("prog"))


@query("""select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 48) or o_custkey in (select l_suppkey from lineitem where l_discount > 0.09)""")
def eligible_either(spark, d):
    """Rows whose key stands in either of two lists, as two semi-joins."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    a = o.join(li.where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    b = o.join(li.where("l_discount > 0.09").select(F.col("l_suppkey").alias("o_custkey")), "o_custkey", "left_semi")
    return a.select("o_orderkey").union(b.select("o_orderkey")).distinct()


@query("""select page_id, len(regexp_extract_all(html, '"([^"]*)"', 1)) n_strings, cast(length(html) - length(replace(html, '(', '')) as integer) n_calls, len(list_filter(regexp_extract_all(html, '"([^"]*)"', 1), lambda x: length(x) > 20)) > 1 enough from pages""")
def context_heuristic(spark, d):
    """Counts of string literals and calls; only the count of long strings decides whether local context suffices."""
    s = F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.size(s).cast("bigint").alias("n_strings"), (F.length("html") - F.length(F.replace("html", F.lit("("), F.lit("")))).alias("n_calls"), (F.size(F.filter(s, lambda x: F.length(x) > 20)) > 1).alias("enough"))


@query("""select doc_id, cast(quality + 1 as integer) qa, cast(toxic + 1 as integer) qb from labels""")
def judge_blocks(spark, d):
    """scores out of a fenced JSON block in a judge's answer."""
    text = F.concat(F.lit("Here:\n```json\n[{'var': 'a', 'score': {'Q-A': "), (F.col("quality") + 1).cast("string"), F.lit(", 'Q-B': "), (F.col("toxic") + 1).cast("string"), F.lit("}}]\n```"))
    x = t(spark, d, "labels").select("doc_id", A.fenced_json(text, "array<struct<var:string,score:struct<`Q-A`:int,`Q-B`:int>>>")[0].alias("r")).where("r.score is not null")
    return x.select("doc_id", F.col("r.score.`Q-A`").alias("qa"), F.col("r.score.`Q-B`").alias("qb"))


@query("""select doc_id from documents where doc_id % 4 <> 0""")
def resumable_append(spark, d):
    """What a keyed, resumable append still has to write."""
    docs = t(spark, d, "documents").select("doc_id")
    return R.new_rows(docs, docs.where("doc_id % 4 = 0"), ["doc_id"])
