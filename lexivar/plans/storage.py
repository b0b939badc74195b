"""Queries that write to the shared folder and read back, and functions on names that need a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivar.functions import names as N
from lexivar.operators import relational as R
from lexivar.plans.registry import query
from lexivar.sources import tables as T
from lexivar.sources.scratch import Scratch


@query("""select c_custkey, c_name from customer where c_custkey % 4 in (0, 1)""")
def listed_files(spark, d):
    """The files of a list, each once, those that do not exist left out."""
    scratch, x = Scratch(spark, "files"), T.table(spark, d, "customer").select("c_custkey", "c_name")
    for i in (0, 1, 2):
        scratch.save(x.where(F.col("c_custkey") % 4 == i), f"part{i}")
    spark.createDataFrame([(f"{scratch.root}/{p}",) for p in ("part0", "gone", "part1", "part0")], "value string").coalesce(1).write.text(f"{scratch.root}/list")
    return T.read_listed(spark, f"{scratch.root}/list")


@query("""select o_orderkey, o_custkey, o_orderstatus from orders""")
def jsonl_strict(spark, d):
    """JSON lines written, replacing what was there, and read strictly."""
    path = f"{Scratch(spark, 'jsonl').root}/out"
    x = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    T.write_jsonl(x.limit(1), path)
    T.write_jsonl(x, path)
    return T.read_jsonl(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("""select count(*) total, cast(count(*) filter (event_id % 7 = 0) as bigint) corrupt, cast(sum(case when event_id % 7 <> 0 then cast(json_extract(props, '$.k') as bigint) else 0 end) as bigint) k_sum from events""")
def jsonl_tolerant(spark, d):
    """JSON lines of which some are broken, counted beside the sound ones."""
    path = f"{Scratch(spark, 'jsonl').root}/out"
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    T.table(spark, d, "events").select(line.alias("value")).write.text(path)
    x = T.read_jsonl(spark, path, "k long", strict=False, corrupt="broken")
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("broken").isNotNull()).alias("corrupt"), F.sum("k").alias("k_sum"))


@query("""select event_id from events order by event_id limit 25""")
def jsonl_first_lines(spark, d):
    """The first lines of a file, in its order; the number is the feature."""
    path = f"{Scratch(spark, 'jsonl').root}/out"
    T.table(spark, d, "events").select("event_id").orderBy("event_id").coalesce(1).write.json(path)
    return T.read_jsonl(spark, path, "event_id long", first=25)


@query("""select n_name prog, s_suppkey item, s_name text from supplier join nation on n_nationkey = s_nationkey""")
def json_document(spark, d):
    """A nested document of lists by program, written as JSON documents and read back."""
    path = f"{Scratch(spark, 'doc').root}/hints"
    x = T.table(spark, d, "supplier").join(T.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    T.write_json_document(R.ordered_lists(x.select(F.col("n_name").alias("prog"), F.col("s_suppkey").alias("item"), F.col("s_name").alias("text")), ["prog"], ["item"], ["text"]), path)
    out = T.read_json_document(spark, path, "prog string, items array<struct<item:long,text:string>>")
    return out.select("prog", F.explode("items").alias("i")).select("prog", "i.item", "i.text")


@query("""select o_orderkey, o_totalprice from orders""")
def append_resumed(spark, d):
    """An append that is broken off and run again; keys that are written already are left out."""
    path = f"{Scratch(spark, 'append').root}/out"
    x = T.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    T.append_new(x.where("o_orderkey % 3 = 0"), path, ["o_orderkey"])
    T.append_new(x, path, ["o_orderkey"])
    T.append_new(x, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("""select case when json_valid(v) then 'kept' else 'error' end sink, count(*) n from (select case when event_id % 5 = 0 then 'x' || props else props end v from events) group by 1""")
def error_sink(spark, d):
    """Good rows to one sink and broken ones to another, beside each other."""
    scratch = Scratch(spark, "sinks")
    x = T.table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("text"))
    T.write_with_errors(x, F.from_json("text", "k long").isNotNull() & F.get_json_object("text", "$").isNotNull(), f"{scratch.root}/kept", f"{scratch.root}/error")
    counted = lambda name: spark.read.schema("text string").json(f"{scratch.root}/{name}").select(F.lit(name).alias("sink"))
    return counted("kept").unionByName(counted("error")).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select distinct source prog from documents), r as (select prog, row_number() over (order by md5(prog || '#42'), prog desc) r, count(*) over () n from p)
select prog, case when r <= floor(n * 0.9e0) then 'train' else 'test' end split from r""")
def split_programs(spark, d):
    """A seeded permutation of the programs, by the hash of name and seed, cut at nine tenths exactly, written and read by part."""
    path = f"{Scratch(spark, 'split').root}/out"
    R.permuted_split(T.table(spark, d, "documents").select(F.col("source").alias("prog")).distinct(), "prog", 0.9).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("prog", F.col("split").cast("string").alias("split"))


@query("""select conv_id, turn from conversations""")
def publish_shuffled(spark, d):
    """A seeded shuffle, written out."""
    path = f"{Scratch(spark, 'publish').root}/out"
    T.publish_shuffled(T.table(spark, d, "conversations").select("conv_id", "turn"), path)
    return spark.read.parquet(path)


def _lexicon(x: DataFrame) -> DataFrame:
    """Rows with the maps and lists that the functions on names need: lemmas, sub-words and clusters, as a one-row table."""
    pairs = lambda kv: F.create_map(*[e for k, v in kv.items() for e in (F.lit(k), F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)))])
    return x.withColumns({
        "lemmas": pairs({"rings": "ring", "gears": "gear", "bolts": "bolt"}),
        "pieces": F.array(*map(F.lit, ("wid", "get", "ga", "dget", "bo", "lt", "ring", "small", "re", "d"))),
        "clusters": pairs({"red": [1], "green": [1, 2], "blue": [2], "small": [3], "large": [3]}),
    })


@query("""with x as (select p_partkey, string_split(lower(p_name), ' ') t from part) select p_partkey, array_to_string(list_transform(list_transform(t, lambda w: w || 's'), lambda w: case when w in ('rings', 'gears', 'bolts') then substr(w, 1, length(w) - 1) else w end), ' ') lemmas from x""")
def lemmatise(spark, d):
    """tokens by a lexicon of lemmas; words that it lacks stay."""
    x = _lexicon(T.table(spark, d, "part").select("p_partkey", F.transform(F.split(F.lower("p_name"), " "), lambda w: F.concat(w, F.lit("s"))).alias("t")))
    return x.select("p_partkey", F.array_join(N.lemmatised("t", "lemmas"), " ").alias("lemmas"))


@query("""with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) w, unnest([1, 2]) i from part),
c as (select p_partkey, i, case w when 'widget' then 'wid get' when 'gadget' then 'ga dget' when 'bolt' then 'bo lt' when 'ring' then 'ring' when 'small' then 'small' when 'red' then 're d' else w end p, w from w),
t as (select p_partkey, i, case when w in ('widget', 'gadget', 'bolt', 'ring', 'small', 'red') then p else null end p from c) select p_partkey, string_agg(p, ' ' order by i) pieces, count(p) n from t group by p_partkey""")
def sub_words(spark, d):
    """tokens cut into the longest known pieces; only words that the pieces cover are shown."""
    known = ("widget", "gadget", "bolt", "ring", "small", "red")
    x = _lexicon(T.table(spark, d, "part").select("p_partkey", F.filter(F.split(F.lower("p_name"), " "), lambda w: w.isin(*known)).alias("t")))
    cut = N.pieces("t", "pieces")
    return x.select("p_partkey", F.when(F.size("t") > 0, F.array_join(cut, " ")).alias("pieces"), F.size("t").cast("long").alias("n"))


@query("""with x as (select p_partkey, string_split(p_name, ' ')[1] g, lead(string_split(p_name, ' ')[1]) over (partition by p_brand order by p_partkey) q from part),
c(w, ids) as (values ('red', [1]), ('green', [1, 2]), ('blue', [2]), ('small', [3]), ('large', [3]))
select p_partkey, g = q or (least(length(g), length(q)) >= 2 and (case when length(g) <= length(q) then starts_with(q, g) or suffix(q, g) else starts_with(g, q) or suffix(g, q) end)) or coalesce(list_has_any(a.ids, b.ids), false) same,
g = q or starts_with(g, q) or starts_with(q, g) or (g[1] = q[1] and levenshtein(g, q) / greatest(length(g), length(q)) < 1 / 3) by_edits from x left join c a on a.w = g left join c b on b.w = q where q is not null""")
def same_words(spark, d):
    """Words that are the same by beginning or end or by a shared cluster, and by edits."""
    first = F.split("p_name", " ")[0]
    x = T.table(spark, d, "part").select("p_partkey", first.alias("g"), F.lead(first).over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("q")).where("q is not null")
    x = _lexicon(x)
    return x.select("p_partkey", N.same_cluster("clusters")(F.col("g"), F.col("q")).alias("same"), N.same_token_by_edits(F.col("g"), F.col("q")).alias("by_edits"))


_TOK = "list_filter(string_split(lower({0}), ' '), lambda x: x <> '')"
_EDITS = "(x = y or starts_with(x, y) or starts_with(y, x) or (x[1] = y[1] and levenshtein(x, y) / greatest(length(x), length(y)) < 1 / 3))"


@query(f"""with x as (select p_partkey, p_name g, lead(p_name) over (partition by p_brand order by p_partkey) q from part), y as (select *, {_TOK.format("g")} gt, {_TOK.format("q")} pt from x where q is not null)
select p_partkey, round(case when lower(g) = lower(q) then 1 else len(list_distinct(list_filter(pt, lambda x: len(list_filter(gt, lambda y: {_EDITS})) > 0))) / len(pt) end, 6) "precision",
round(case when lower(g) = lower(q) then 1 else len(list_distinct(list_filter(gt, lambda x: len(list_filter(pt, lambda y: {_EDITS})) > 0))) / len(gt) end, 6) recall from y""")
def score_by_edits(spark, d):
    """Token precision and recall with words compared by their edits."""
    x = T.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("g"), F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("q")).where("q is not null")
    s = N.score_name("g", "q", N.same_token_by_edits)
    return x.withColumn("s", s).select("p_partkey", F.round("s.precision", 6).alias("precision"), F.round("s.recall", 6).alias("recall"))


@query("""with x as (select c_custkey, c_mktsegment w, c_custkey % 5 s from customer)
select c_custkey, case s when 0 then lower(w) when 1 then lower(w) when 2 then '_ZN3fooI' || w when 3 then w else 'get' || lower(w) end bare from x""")
def demangle(spark, d):
    """Bare names of mangled ones, single and nested, with a suffix; forms beyond that stay."""
    w = F.lower("c_mktsegment")
    size = F.length(w).cast("string")
    n = F.element_at(
        F.array(F.concat(F.lit("_Z"), size, w, F.lit("iPKc")), F.concat(F.lit("_ZN3foo"), size, w, F.lit("Ev_2")), F.concat(F.lit("_ZN3fooI"), "c_mktsegment"), F.col("c_mktsegment"), F.concat(F.lit("_ZN9my_lib_v23Foo"), (F.length(w) + 3).cast("string"), F.lit("get"), w, F.lit("Ev"))),
        (F.col("c_custkey") % 5 + 1).cast("int"),
    )
    return T.table(spark, d, "customer").select("c_custkey", N.demangled(n).alias("bare"))


@query("""with x as (select c_custkey, case c_custkey % 4 when 0 then 'std::ns::' || lower(c_mktsegment) || '<int>(char const*)' when 1 then 'A::operator==(A const&)' when 2 then c_name else 'f[abi:cxx11](int)' end t, c_name, c_mktsegment from customer)
select c_custkey, case c_custkey % 4 when 0 then lower(c_mktsegment) when 1 then 'operator==' when 2 then c_name else 'f' end bare from x""")
def bare_names(spark, d):
    """bare names of functions and operators in demangled signatures."""
    c = F.col("c_custkey") % 4
    t = F.when(c == 0, F.concat(F.lit("std::ns::"), F.lower("c_mktsegment"), F.lit("<int>(char const*)"))).when(c == 1, F.lit("A::operator==(A const&)")).when(c == 2, F.col("c_name")).otherwise(F.lit("f[abi:cxx11](int)"))
    return T.table(spark, d, "customer").select("c_custkey", N.bare_name(t, F.col("c_name")).alias("bare"))


@query("""with x as (select page_id, case page_id % 5 when 0 then '''a' when 1 then '9''' when 2 then ':_x' when 3 then 'plain' else ''':' end token from pages) select count(*) n, cast(count(*) filter (regexp_matches(token, '''[0-9a-zA-Z]') or regexp_matches(token, '[0-9a-zA-Z]''') or contains(token, ':_')) as bigint) awkward from x""")
def vocabulary_check(spark, d):
    """entries of a vocabulary that forbid cutting texts at quotes."""
    k = F.col("page_id") % 5
    token = F.when(k == 0, "'a").when(k == 1, "9'").when(k == 2, ":_x").when(k == 3, "plain").otherwise("':")
    return T.table(spark, d, "pages").select(token.alias("token")).agg(F.count(F.lit(1)).alias("n"), F.count_if(N.awkward_entry("token", "_")).alias("awkward"))


@query("""select p_partkey, regexp_replace(' ' || p_name || '@x ;', '([^a-zA-Z0-9_]|^)(' || split_part(p_name, ' ', 2) || ')([^a-zA-Z0-9_])', '\\1v\\3', 'g') plain,
substr(regexp_replace(substr(regexp_replace(' ' || p_name || ' ;', '([^a-zA-Z0-9_@]|^)(' || split_part(p_name, ' ', 1) || ')([^a-zA-Z0-9_@])', '\\1alpha\\3', 'g'), 1, 9), '([^a-zA-Z0-9_@]|^)(none)([^a-zA-Z0-9_@])', '\\1x\\3', 'g'), 1, 9) cut from part""")
def rename_variants(spark, d):
    """Renaming with @ as a delimiter, and an ordered rename that leaves some ids alone and cuts after each step."""
    w = F.split("p_name", " ")
    pairs = F.array(F.struct(w[0].alias("k"), F.lit("alpha").alias("v")), F.struct(w[1].alias("k"), F.lit("beta").alias("v")))
    cut = N.rename_all(F.concat(F.lit(" "), "p_name", F.lit(" ;")), pairs, keep=F.array(w[1]), max_len=9)
    return T.table(spark, d, "part").select("p_partkey", N.rename_plain(F.concat(F.lit(" "), "p_name", F.lit("@x ;")), w[1], F.lit("v")).alias("plain"), cut.alias("cut"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'p' || o_custkey else 'p' || o_custkey || '_x' end prog, case when o_orderkey % 3 = 0 then 'main_' || o_orderkey else printf('%016X', o_orderkey) end func from orders""")
def overlap_keys(spark, d):
    """P20: keys of overlap lists brought to one form: programs are cut only where they name a jsonl file, functions re-keyed only where they hold the prefix."""
    x = T.table(spark, d, "orders")
    prog = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("p"), "o_custkey", F.lit("_a.jsonl"))).otherwise(F.concat(F.lit("p"), "o_custkey", F.lit("_x")))
    func = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("main_"), "o_orderkey")).otherwise(F.concat(F.lit("sub_"), F.lower(F.hex("o_orderkey"))))
    return x.select("o_orderkey", N.overlap_program(prog).alias("prog"), N.overlap_function(func).alias("func"))


@query("""select o_orderkey, least(length(t), 20) n, substr(t, 1, 20) cut from (select o_orderkey, repeat('x' || o_orderkey, 4) t from orders)""")
def cut_bodies(spark, d):
    """Bodies cut at a length that some exceed."""
    t = F.substring(F.repeat(F.concat(F.lit("x"), "o_orderkey"), 4), 1, 20)
    return T.table(spark, d, "orders").select("o_orderkey", F.length(t).cast("long").alias("n"), t.alias("cut"))
