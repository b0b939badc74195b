"""Queries over programs: ingest, overlap, parsing, hints, propagation, scoring, preference and judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivar.functions import answers as A
from lexivar.functions import names as N
from lexivar.operators import graph as G
from lexivar.operators import hints as H
from lexivar.operators import ingest as I
from lexivar.operators import judge as J
from lexivar.operators import origins as O
from lexivar.operators import overlap as OV
from lexivar.operators import preference as PR
from lexivar.operators import propagation as PG
from lexivar.operators import relational as R
from lexivar.operators import rounds as RO
from lexivar.operators import scoring as SC
from lexivar.parsing.facts import with_facts
from lexivar.plans import programs as P
from lexivar.plans.registry import query
from lexivar.sources.scratch import Scratch
from lexivar.sources.tables import read_jsonl, table, write_jsonl


def pairs_text(pairs: str | Column) -> Column:
    return F.array_join(F.transform(N.col(pairs), lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")


_GOOD = "v is not null and v <> k and not (trim(v) = '' or regexp_matches(v, '^[va][0-9]+') or v in ('i', 'j', 'k', 'ret'))"
_VARS = " union all ".join(
    f"select prog, f, {j} pos, '{P.VARS[j]}' k, {truth} v from fun where {cond}"
    for j, truth, cond in (
        (1, P.truth_var(1, "f"), "f % 3 >= 1"), (2, P.truth_var(2, "f"), "f % 3 >= 2"),
        (3, f"coalesce({P.truth_var(3, 'f')}, case when f % 17 = 0 and f % 3 >= 1 then {P.truth_var(1, 'f')} end)", "true"), (4, P.truth_var(4, "f"), "true"),
    )
)
#: fun: kept functions; var_ids and func_ids: their name maps as rows; funcs: functions with a name to recover.
INGEST = f"""keys as ({P.keys_sql()}), fun as (select *, k f, {P.truth_name()} truth from keys where {P.KEPT}),
var_ids as (select prog, f, pos, k, v from ({_VARS}) where {_GOOD}),
said as (select prog, f, 0 pos, f callee from fun union all select prog, f, 1, n1 from fun where n1 is not null union all select prog, f, 2, n2 from fun where n2 is not null),
func_ids as (select s.prog, s.f, s.pos, {P.placeholder("s.callee")} k, t.truth v from said s join fun t on t.prog = s.prog and t.f = s.callee where t.truth <> {P.placeholder("s.callee")}),
funcs as (select * from fun where exists (select 1 from var_ids i where i.f = fun.f) or exists (select 1 from func_ids i where i.f = fun.f))"""


@query(f"""with {INGEST}, a as (select f, string_agg(k || '=' || v, ',' order by pos) t from var_ids group by f), b as (select f, string_agg(k || '=' || v, ',' order by pos) t from func_ids group by f)
select prog prog_name, {P.placeholder("funcs.f")} func_name, coalesce(a.t, '') var_ids, coalesce(b.t, '') func_ids from funcs left join a on a.f = funcs.f left join b on b.f = funcs.f""")
def ingest_functions(spark, d):
    """Raw entries to functions with their maps of variables (by position, locals over arguments) and of functions (by mention)."""
    x = I.functions_of(P.raw_functions(spark, d))
    return x.select("prog_name", "func_name", pairs_text("var_ids").alias("var_ids"), pairs_text("func_ids").alias("func_ids"))


@query(f"""with {INGEST}, own as (select prog, f, case when truth <> {P.placeholder("f")} then truth else {P.placeholder("f")} end known from funcs where truth <> 'main'),
first as (select known, arg_min(prog, struct_pack(p := prog, f := f)) prog from own group by known), new as (select prog, count(*) n from first group by prog)
select o.prog prog_name, cast(coalesce(max(new.n), 0) as bigint) n_new, count(*) n_total from own o left join new on new.prog = o.prog group by o.prog having coalesce(max(new.n), 0) > count(*) * 0.7e0""")
def first_seen_functions(spark, d):
    """Programs that bring more than 70 % of new functions, by the functions' true names where known, without main."""
    x = I.known_as(I.functions_of(P.raw_functions(spark, d)))
    return R.first_seen_programs(x, "prog_name", "known", ["prog_name", "func_seq"])


def call_edges(spark, d):
    """Edges between all kept functions."""
    return G.mention_edges(I.retained(P.raw_functions(spark, d)).select("prog_name", "func_name", F.col("stripped.code").alias("body")))


def parsed_functions(spark, d):
    """Functions with a name to recover, and the facts of their code."""
    return with_facts(I.functions_of(P.raw_functions(spark, d)).select("prog_name", "func_name", "func_seq", "body"))


@query(f"""with {INGEST}, ed as (select distinct prog, f, callee from said where callee <> f and callee in (select f from fun)),
b as (select prog, callee f, f other, 0 kind from ed union all select prog, f, callee, 1 from ed)
select prog prog_name, {P.placeholder("f")} func_name, coalesce(string_agg(case when kind = 0 then {P.placeholder("other")} end, ',' order by {P.placeholder("other")}), '') callers,
coalesce(string_agg(case when kind = 1 then {P.placeholder("other")} end, ',' order by {P.placeholder("other")}), '') callees from b group by prog, f""")
def graph_neighbours(spark, d):
    """Predecessors and successors of each function in the call graph."""
    x = G.neighbours(call_edges(spark, d))
    return x.select("prog_name", "func_name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


_N = "(case when n1 is not null then 1 else 0 end + case when n2 is not null then 1 else 0 end + case when n1 is not null and k % 5 = 0 then 1 else 0 end)"
_PUTS = "case when k % 8 = 0 then 2 else 1 end"


@query(f"""with {INGEST} select prog prog_name, {P.placeholder("f")} func_name, {P.placeholder("f")} || '(' || {P.PARAMS} || ')' declarator, case k % 3 when 0 then '' when 1 then 'a1' else 'a1,a2' end params, cast({_N} + {_PUTS} + 1 as integer) n_calls,
cast(case when n1 is not null then 1 + k % 3 + case when k % 5 = 0 then 2 else 0 end else 0 end + case when n2 is not null then 2 else 0 end + {_PUTS} + 3 as integer) n_ids,
k % 8 = 0 or not ({_N} > ({_N} + {_PUTS} + 1) * 0.3e0) sufficient, case when k % 8 = 0 then false else {_N} > ({_N} + {_PUTS} + 1) * 0.3e0 end overfit from funcs""")
def code_features(spark, d):
    """Features of parsed code, whether its own context suffices and whether an answer would be by heart."""
    x = parsed_functions(spark, d)
    return x.select("prog_name", "func_name", "declarator", F.array_join("params", ",").alias("params"), F.size("calls").alias("n_calls"), F.size(F.flatten("calls.ids")).alias("n_ids"), H.context_sufficient().alias("sufficient"), H.likely_overfit().alias("overfit"))


_ARG = "case when k % 3 >= 1 then coalesce({v2}, 'v2') else '' end || case when k % 3 = 2 then ', ' || coalesce({a1}, 'a1') else '' end".format(v2=P.predicted(4), a1=P.predicted(1))
_V2 = f"coalesce({P.predicted(4)}, 'v2')"
_N1 = f"coalesce({P.PREDICTED_N1}, {P.placeholder('n1')})"
#: enough: functions whose own context suffices; sites: the renamed calls they make.
HINTS = f"""{INGEST}, enough as (select *, {P.PREDICTED_OWN} own from funcs where k % 8 = 0 or not ({_N} > ({_N} + {_PUTS} + 1) * 0.3e0)),
heads as (select f, {P.placeholder("f")} callee, own || '(' || replace(replace({P.PARAMS}, 'a1', coalesce({P.predicted(1)}, 'a1')), 'a2', coalesce({P.predicted(2)}, 'a2')) || ')' hint from enough where own is not null),
sites as (select prog, f, 1 pos, n1 callee, {_N1} || '(' || {_ARG} || ')' hint, {P.placeholder("n1")} || '(' || {P.ARGS} || ')' was from enough where n1 is not null
  union all select prog, f, 2, n2, {P.placeholder("n2")} || '(' || {_V2} || ', "x")', {P.placeholder("n2")} || '(v2, "x")' from enough where n2 is not null
  union all select prog, f, 3, n1, {_N1} || '(' || {_V2} || ')', {P.placeholder("n1")} || '(v2)' from enough where n1 is not null and k % 5 = 0),
ordered as (select callee, hint, min(f * 4 + pos) o from sites where hint <> was group by all), ranked as (select *, row_number() over (partition by callee order by o) - 1 r from ordered),
cs as (select callee f, '<Hints Callsites>' || string_agg({P.NL} || '<' || r || '> ' || hint || ' </' || r || '>', '' order by r) || {P.NL} || '</Hints Callsites>' t from ranked where r < 5 group by callee),
ce0 as (select s.f, s.pos, h.callee, h.hint from said s join heads h on h.f = s.callee where s.pos > 0), ce1 as (select f, hint, min(pos) pos, arg_min(callee, pos) callee from ce0 group by f, hint),
ce as (select f, '<Hints Callees>' || string_agg({P.NL} || callee || ': ' || hint, '' order by pos) || {P.NL} || '</Hints Callees>' || {P.NL} t from ce1 group by f),
asked as (select distinct prog from fun where coalesce({", ".join(P.predicted(j) for j in P.VARS)}, {P.PREDICTED_OWN}, {P.PREDICTED_N1}) is not null)"""


@query(f"""with {HINTS} select prog prog_name, {P.placeholder("funcs.f")} func_name, coalesce(ce.t, '') || coalesce(cs.t, '') hints
from funcs left join ce on ce.f = funcs.f left join cs on cs.f = funcs.f where prog in (select prog from asked)""")
def context_hints(spark, d):
    """For each function the renamed declarators of its callees and the renamed calls of itself, in order of first sight, as text."""
    x = H.hints(Scratch(spark, "hints").save(parsed_functions(spark, d).drop("body", "ir"), "parsed"), P.scored_names(spark, d), call_edges(spark, d))
    return x.select("prog_name", "func_name", H.render_hints().alias("hints"))


_IR = " union all ".join(
    f"select prog, f, {at} at_, '{kind}' kind, {lhs} lhs, {rk} rhs_kind, {rhs} rhs, {callee} callee, {args} args from funcs where {cond}"
    for at, kind, lhs, rk, rhs, callee, args, cond in (
        (1, "call", "null", "null", "null", P.placeholder("n1"), "case k % 3 when 0 then '' when 1 then 'var:v2' else 'var:v2,var:a1' end", "n1 is not null"),
        (2, "copy", "'v1'", "'implicit_return'", P.placeholder("n1"), "null", "null", "n1 is not null"),
        (3, "copy", "'v2'", "'var'", "'v1'", "null", "null", "k % 2 = 0"),
        (4, "call", "null", "null", "null", "'puts'", "'opaque:'", "true"),
        (5, "call", "null", "null", "null", "'puts'", "'opaque:'", "k % 8 = 0"),
        (6, "call", "null", "null", "null", P.placeholder("n2"), "'var:v2,opaque:'", "n2 is not null"),
        (7, "call", "null", "null", "null", "'log_it'", "'var:v1,var:v2'", "true"),
        (8, "call", "null", "null", "null", P.placeholder("n1"), "'var:v2'", "n1 is not null and k % 5 = 0"),
        (9, "call", "null", "null", "null", P.placeholder("n1"), "'var:v2'", "n1 is not null and k % 5 = 0"),
        (10, "return", "null", "case when n1 is not null and k % 5 = 0 then 'implicit_return' else 'var' end", f"case when n1 is not null and k % 5 = 0 then {P.placeholder('n1')} else 'v1' end", "null", "null", "true"),
    )
)


@query(f"""with {INGEST}, ir as ({_IR}) select prog prog_name, {P.placeholder("f")} func_name, cast(row_number() over (partition by f order by at_) - 1 as integer) seq, kind, lhs, rhs_kind, rhs, callee, args from ir""")
def code_ir(spark, d):
    """Calls, copies and returns of parsed code, as rows; calls inside returns stand twice."""
    x = parsed_functions(spark, d).select("prog_name", "func_name", F.explode("ir").alias("x"))
    args = F.array_join(F.transform("x.args", lambda a: F.concat(a["kind"], F.lit(":"), F.coalesce(a["name"], F.lit("")))), ",")
    return x.select("prog_name", "func_name", "x.seq", "x.kind", "x.lhs", "x.rhs_kind", "x.rhs", "x.callee", args.alias("args"))


_V = P.VARS
_NAMES = " union all ".join(
    f"select prog, k, {j} j, {r} r, '{_V[j]}' v, {P.candidate(j, r)} name, (k * 7 + {j} * 3 + {r} * 5) % 4 / 4.0 prec from fun where {f'k % 3 >= {j}' if j < 3 else 'true'}" for j in _V for r in range(P.ROUNDS)
)
_ALSO = "{p}.f in (select f from funcs)"
#: cand: candidates as rows; reach: sources that reach a variable, by rounds.
PROPAGATED = f"""{INGEST}, ir as ({_IR}), cand as ({_NAMES}), src as (select distinct k, v from cand where name not like '%<empty%'),
arg as (select prog, f, {P.placeholder("f")} fn, callee, unnest(string_split(args, ',')) a, unnest(range(len(string_split(args, ',')))) i, case when args = '' then 0 else len(string_split(args, ',')) end n from ir where kind = 'call'),
pas as (select distinct a.prog, a.f, split_part(a.a, ':', 2) arg, g.f callee, ['a1', 'a2'][a.i + 1] param from arg a join funcs g on g.prog = a.prog and {P.placeholder("g.f")} = a.callee where a.n = g.f % 3 and a.a like 'var:%'),
ret as (select f, rhs from ir where kind = 'return' and rhs_kind = 'var'),
val as (select distinct i.prog, i.f, i.lhs, g.f callee, ret.rhs ret from ir i join funcs g on g.prog = i.prog and {P.placeholder("g.f")} = i.rhs join ret on ret.f = g.f where i.rhs_kind = 'implicit_return' and i.kind = 'copy'),
cop as (select distinct prog, f, lhs, rhs from ir where kind = 'copy' and rhs_kind = 'var'),
ed as (select prog, f df, arg dv, callee sf, param sv, 0 kind, false tr from pas union all select prog, f, lhs, callee, ret, 1, true from val union all select prog, callee, param, f, arg, 2, true from pas where f <> callee
  union all select prog, callee, ret, f, lhs, 3, false from val where f <> callee union all select prog, f, lhs, f, rhs, 4, true from cop union all select prog, f, rhs, f, lhs, 5, false from cop),
own as (select * from ed where df <> sf or dv <> sv), step as (select distinct df, dv, sf mf, sv mv from own where tr),
r0 as (select prog, df, dv, sf, sv, min(kind) kind, 0 lvl from own join src on src.k = sf and src.v = sv group by prog, df, dv, sf, sv),
r1 as (select prog, s.df, s.dv, r.sf, r.sv, min(kind) kind, 1 lvl from step s join r0 r on r.df = s.mf and r.dv = s.mv where (s.df <> r.sf or s.dv <> r.sv) and (s.df, s.dv, r.sf, r.sv) not in (select (df, dv, sf, sv) from r0) group by prog, s.df, s.dv, r.sf, r.sv),
r2 as (select prog, s.df, s.dv, r.sf, r.sv, min(kind) kind, 2 lvl from step s join r1 r on r.df = s.mf and r.dv = s.mv where (s.df <> r.sf or s.dv <> r.sv) and (s.df, s.dv, r.sf, r.sv) not in (select (df, dv, sf, sv) from r0)
  and (s.df, s.dv, r.sf, r.sv) not in (select (df, dv, sf, sv) from r1) group by prog, s.df, s.dv, r.sf, r.sv),
reach as (select * from r0 union all select * from r1 union all select * from r2)"""


def reached(spark, d):
    """What reaches each variable; code is parsed once, and each round is written."""
    scratch = Scratch(spark, "propagation")
    parsed = scratch.save(parsed_functions(spark, d).select("prog_name", "func_name", "params", "ir"), "parsed")
    edges = scratch.save(PG.edges(parsed, call_edges(spark, d)), "edges")
    return PG.propagate(edges, PG.named(P.candidate_names(spark, d)), save=scratch.save)


@query(f"""with {PROPAGATED} select prog prog_name, {P.placeholder("df")} dst_func, dv dst_var, {P.placeholder("sf")} src_func, sv src_var, cast(kind as integer) kind, cast(lvl as integer) as level from reach""")
def propagate_names(spark, d):
    """Sources whose names reach a variable along arguments, returns and copies of parsed code in three rounds."""
    return reached(spark, d)


@query(f"""with {PROPAGATED} select case kind when 0 then 'callee args' when 1 then 'callee return' when 2 then 'caller args' when 3 then 'caller return' else 'direct use' end reason, count(*) n from reach group by 1""")
def propagation_reasons(spark, d):
    """How many names came by each kind of edge."""
    return PG.reason_counts(reached(spark, d))


@query(f"""with {INGEST}, cand as ({_NAMES}) select prog prog_name, {P.placeholder("k")} func_name, v varname, arg_max(name, struct_pack(p := prec, r := -r)) pred_name, max(prec) "precision" from cand group by prog, k, v""")
def best_candidate(spark, d):
    """The candidate of the greatest precision, the first of equals, empty ones included."""
    return PG.upper_bound(P.candidate_names(spark, d)).select("prog_name", "func_name", "varname", "chosen.pred_name", "chosen.precision")


@query(f"""with {PROPAGATED}, full_ as (select * from cand where name not like '%<empty%'), cnt as (select k, v, name, count(*) n, min(r) r from full_ group by all), mode as (select k, v, arg_max(name, struct_pack(n := n, r := -r)) name from cnt group by k, v),
nd as (select k, v, count(distinct name) nd from full_ group by all), hit as (select df k, dv v, m.name from reach join mode m on m.k = sf and m.v = sv),
vote as (select * from nd where nd > 1 and (k, v) in (select (k, v) from hit)), vec as ({P.name_vectors_sql()}),
bag as (select k, v, name from hit union all select k, v, name from full_), sim as (select t.k, t.v, c.name, avg(list_cosine_similarity(x.e, y.e)) s from vote t join (select distinct k, v, name from full_) c using (k, v) join vec x on x.name = c.name
  join bag b on b.k = t.k and b.v = t.v join vec y on y.name = b.name group by all), won as (select k, v, name, row_number() over (partition by k, v order by round(s, 9) desc, name) r from sim),
def as (select k, j, case when (k + j) % 2 = 0 then 'default' || j end name from cand group by k, j), vars as (select distinct prog, k, j, v from cand),
out_ as (select prog, vars.k, vars.v, case when won.name is not null then won.name when nd.nd = 1 then lone.name else def.name end name, case when won.name is not null then 'vote' when nd.nd = 1 then 'only' else 'default' end how
  from vars left join nd on nd.k = vars.k and nd.v = vars.v left join won on won.k = vars.k and won.v = vars.v and won.r = 1 left join def on def.k = vars.k and def.j = vars.j left join (select k, v, min(name) name from full_ group by all) lone on lone.k = vars.k and lone.v = vars.v)
select prog prog_name, {P.placeholder("k")} func_name, v varname, name pred_name, how from out_ where name is not null""")
def choose_names(spark, d):
    """A name for each variable: the only candidate, the default, or a vote of propagated modes and candidates by their vectors."""
    names = Scratch(spark, "candidates").save(P.candidate_names(spark, d), "names")
    return PG.choose(names, reached(spark, d), P.default_names(spark, d), P.name_vectors(spark, d))


def answered(spark, d, bodies: bool = False):
    """Functions with a name to recover, and the raw answers for them; functions are drawn once, however often they are read."""
    functions = I.functions_of(P.raw_functions(spark, d), columns=("body", "var_ids") if bodies else ("var_ids",))
    return Scratch(spark, "answered").save(functions, "functions").join(P.model_answers(spark, d), ["prog_name", "func_name"])


@query(f"""with {INGEST}, s as (select (k + p) % 8 s from funcs, (values (0), (1), (2)) x(p)) select count(*) total, cast(count(*) filter (s in (3, 4, 5, 6)) as bigint) error, cast(count(*) filter (s in (4, 5)) as bigint) fixed,
round(count(*) filter (s in (3, 4, 5, 6)) / count(*), 6) error_ratio, round(count(*) filter (s in (4, 5)) / count(*) filter (s in (3, 4, 5, 6)), 6) fixed_ratio from s""")
def answer_errors(spark, d):
    """Broken and mended answers of eight shapes, counted in one aggregate."""
    x = SC.answer_counts(SC.parsed_answers(answered(spark, d)))
    return x.select("total", "error", "fixed", F.round("error_ratio", 6).alias("error_ratio"), F.round("fixed_ratio", 6).alias("fixed_ratio"))


_TOK = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')"
_SAME = "(x = y or (least(length(x), length(y)) >= 2 and case when length(x) <= length(y) then starts_with(y, x) or suffix(y, x) else starts_with(x, y) or suffix(x, y) end))"


def sql_score(a: str, b: str, gt: str, pred: str) -> str:
    """The share of tokens of `a` that match one of `b`; 1 for equal names."""
    t, u = _TOK.format(a), _TOK.format(b)
    return f"case when lower({gt}) = lower({pred}) then 1 when len({_TOK.format(gt)}) = 0 or len({_TOK.format(pred)}) = 0 then 0 else len(list_distinct(list_filter({t}, lambda x: len(list_filter({u}, lambda y: {_SAME})) > 0))) / len({t}) end"


#: truth: names that are worth a score; said_: what the answers say for them.
SCORED = f"""{INGEST}, truth as (select prog, f, k id, v gt from var_ids union all select prog, f, k, v from func_ids), ans as ({P.ANSWER_ROWS}),
good as (select * from truth where f in (select f from funcs) and not (trim(gt) = '' or regexp_matches(gt, '^(v[0-9]+|a[0-9]+|[_0-9]+)\\b') or gt in ('i', 'j', 'k', 'ret')) and gt <> id),
said_ as (select g.*, a.pos, a.prob, a.name from good g join ans a on a.f = g.f and a.id = g.id),
marked as (select *, {sql_score("name", "gt", "gt", "name")} p, {sql_score("gt", "name", "gt", "name")} r from said_)"""


@query(f"""with {SCORED}, one as (select *, row_number() over (partition by f, id order by pos) rn from marked)
select prog prog_name, {P.placeholder("f")} func_name, id varname, gt gt_varname, name pred_name, round(p, 6) "precision", round(r, 6) recall from one where rn = 1""")
def score_answers(spark, d):
    """Names of parsed and mended answers that have a truth, scored; the first answer of each counts."""
    x = SC.scored_names(answered(spark, d))
    return x.select("prog_name", "func_name", "varname", "gt_varname", "pred_name", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""with {SCORED}, o as (select *, row_number() over (partition by f, id order by prob desc, pos) rn from marked), a as (select * from o where rn = 1), b as (select * from o where rn = 2), c as (select * from o where rn = 3),
ab as (select a.prog, a.f, a.id, a.gt, case when b.p >= a.p and b.r >= a.r then b.name else a.name end name, case when b.p >= a.p and b.r >= a.r then b.p else a.p end p, case when b.p >= a.p and b.r >= a.r then b.r else a.r end r from a left join b using (f, id))
select ab.prog prog_name, {P.placeholder("ab.f")} func_name, id varname, ab.gt gt_varname, case when c.p >= ab.p and c.r >= ab.r then c.name else ab.name end pred_name,
round(case when c.p >= ab.p and c.r >= ab.r then c.p else ab.p end, 6) "precision", round(case when c.p >= ab.p and c.r >= ab.r then c.r else ab.r end, 6) recall from ab left join c using (f, id)""")
def score_best_answers(spark, d):
    """Of the three likeliest answers the last that is no worse in precision and recall than the best before it."""
    x = SC.scored_names(answered(spark, d), best=True)
    return x.select("prog_name", "func_name", "varname", "gt_varname", "pred_name", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""with {INGEST}, t as (select prog, f, id, name from ({P.ANSWER_ROWS}) where pos = 0 and (f + 0) % 8 in (0, 1, 2)) select name, count(*) n from t where id not like 'sub_%' group by name""")
def train_name_counts(spark, d):
    """Frequencies of names in training answers, two characters before each map; ids of functions do not count."""
    x = P.model_answers(spark, d).select(F.concat(F.lit(": "), F.regexp_extract(F.element_at("answers", 1)["raw"], r"(\{.*\})", 1).alias("m")).alias("response"), F.expr("conv(substring(func_name, 5), 16, 10) % 8").alias("s"))
    return SC.train_names(x.where("s in (0, 1, 2)"))


def preference_entries(spark, d):
    """Functions with the maps of those answers that parse; written, as pairs are drawn from several readings of them."""
    x = answered(spark, d, bodies=True)
    # Answers are filtered behind the aggregate: a filter before it would parse them once more.
    said = F.when(F.col("answer").isNotNull(), F.struct("pos", F.map_entries("answer").alias("e")))
    maps = SC.parsed_answers(x).groupBy("prog_name", "func_name").agg(F.sort_array(F.collect_list(said)).alias("a")).where(F.size("a") > 0)
    names = F.transform("a", lambda a: F.struct(a["pos"].alias("pos"), F.map_from_entries(a["e"]).alias("names")))
    entries = x.drop("answers").join(maps, ["prog_name", "func_name"]).select("prog_name", "func_name", "body", "var_ids", "func_ids", names.alias("answers"))
    return Scratch(spark, "preference").save(entries, "entries")


_F1 = "case when p + r < 0.001 then 0 else 2 * p * r / (p + r) end"
PREFERENCE = f"""{INGEST}, ids as (select prog, f, k id, v gt, pos, true var from var_ids union all select prog, f, k, v, 100 + pos, false from func_ids), ans as ({P.ANSWER_ROWS}),
nv as (select f, count(*) n from var_ids group by f), row0 as (select i.prog, i.f, i.id, i.gt, i.pos at_, i.var, a.pos, a.name from ids i join ans a on a.f = i.f and a.id = i.id),
whole as (select f, pos, string_agg(name, '#' order by id) t from row0 where var group by f, pos having count(*) = (select n from nv where nv.f = row0.f)),
some_ as (select f from whole group by f having count(distinct t) > 1),
rows_ as (select *, {_F1} f1 from (select *, {sql_score("name", "gt", "gt", "name")} p, {sql_score("gt", "name", "gt", "name")} r from row0 where f in (select f from some_))),
best as (select prog, f, id, gt, at_, var, arg_max(name, struct_pack(f1 := f1, pos := pos)) best, max(f1) top from rows_ group by all),
head as (select prog, f, ':{{' || string_agg('''' || id || ''': ''' || best || '''', ', ' order by at_) || '}}' chosen, count(*) n, avg(top) filter (var) score from best group by prog, f having avg(top) filter (var) >= 0.2e0),
every as (select distinct f, pos from ans where f in (select f from some_)),
an as (select e.f, e.pos, coalesce(avg(f1) filter (var), 0) v, coalesce(avg(f1) filter (not var), 0) fn, count(id) n, ':{{' || string_agg('''' || id || ''': ''' || name || '''', ', ' order by at_) || '}}' t from every e left join rows_ r on r.f = e.f and r.pos = e.pos group by e.f, e.pos),
ord as (select *, row_number() over (partition by f order by v, fn, pos) rn from an), worst as (select * from ord where rn = 1),
sec as (select o.*, row_number() over (partition by o.f order by o.rn desc) k2 from ord o join head h using (f) join worst w using (f) where o.rn > 1 and o.n = h.n and o.v < h.score and o.t is distinct from w.t and o.t <> h.chosen),
pair as (select f, 1 "rank", pos, t, v from worst join head using (f) where worst.n = head.n union all select f, 2, pos, t, v from sec where k2 = 1),
inter as (select pair.f, "rank", string_agg(r.id, ',' order by r.id) i from pair join rows_ r on r.f = pair.f and r.pos = pair.pos join best b on b.f = r.f and b.id = r.id where b.top >= 0.4e0 and r.f1 + 0.1e0 < b.top group by all)"""


@query(f"""with {PREFERENCE} select h.prog prog_name, {P.placeholder("h.f")} func_name, cast(pair."rank" as integer) as "rank", h.chosen, pair.t rejected, round(h.score, 6) chosen_score, round(pair.v, 6) rejected_score, coalesce(i.i, '') interesting
from pair join head h using (f) left join inter i on i.f = pair.f and i."rank" = pair."rank" where h.score > pair.v""".replace("{{", "{").replace("}}", "}"))
def preference_pairs(spark, d):
    """The composed best answer beside the worst and beside the best other one, with gates on how hopeless a function or a name is."""
    x = PR.preference_pairs(preference_entries(spark, d))
    return x.select("prog_name", "func_name", "rank", "chosen", "rejected", F.round("chosen_score", 6).alias("chosen_score"), F.round("rejected_score", 6).alias("rejected_score"), F.array_join("interesting", ",").alias("interesting"))


@query(f"""with {PREFERENCE.replace("{{", "{").replace("}}", "}").replace("and o.v < h.score and", "and")}, p as (select h.score > pair.v good, case when h.f % 8 = 0 then false else {_N} > ({_N} + {_PUTS} + 1) * 0.3e0 end over_ from pair join head h using (f) join funcs on funcs.f = h.f)
select count(*) n, cast(count(*) filter (good) as bigint) reasonable, cast(count(*) filter (good and not over_) as bigint) kept, round(count(*) filter (good and not over_) / count(*), 6) kept_ratio from p""")
def preference_ratios(spark, d):
    """How many pairs are reasonable and not by heart, judged by the body that is taken back out of each prompt."""
    entries = preference_entries(spark, d)
    ids = F.transform(F.concat("var_ids", "func_ids"), lambda e: e["k"])
    prompts = entries.select("prog_name", "func_name", N.strip_characters(F.concat(F.lit("<bos>"), A.render_prompt("body", ids)), "<bos>").alias("input"))
    code = with_facts(prompts.select("prog_name", "func_name", N.body_of_prompt("input").alias("body"))).select("prog_name", "func_name", H.likely_overfit().alias("overfit"))
    pairs = PR.preference_pairs(entries, filter_data=False).withColumn("reasonable", F.expr("chosen_score > rejected_score")).join(code, ["prog_name", "func_name"])
    return PR.ratios(pairs).withColumn("kept_ratio", F.round("kept_ratio", 6))


_ROUND = " union all ".join(f"select prog, f, {r} r, '{P.VARS[j]}' v, {P.candidate(j, r)} name from fun where f % {r + 2} <> 0" for r in range(P.ROUNDS) for j in (3, 4))


@query(f"""with {INGEST}, c as ({_ROUND}) select prog prog_name, {P.placeholder("f")} func_name, v varname, string_agg(r || ':' || name, ',' order by r) names from c group by prog, f, v""")
def combine_files(spark, d):
    """Files of rounds, one of them listed twice, as one list of candidates a name in the order of files and lines."""
    scratch = Scratch(spark, "rounds")
    names = P.candidate_names(spark, d).where("varname in ('v1', 'v2')").withColumn("k", F.conv(F.expr("substring(func_name, 5)"), 16, 10).cast("long"))
    for r in range(P.ROUNDS):
        rows = names.where(f"k % {r + 2} <> 0").select("prog_name", "func_name", "varname", F.col("candidates")[r]["pred_name"].alias("pred_name"), F.col("k").alias("line_no"))
        write_jsonl(rows, f"{scratch.root}/round{r}")
    listed = [f"{scratch.root}/round{r}" for r in (0, 1, 0, 2)]
    schema = "prog_name string, func_name string, varname string, pred_name string, line_no long"
    x = R.combine_files([(p, read_jsonl(spark, p, schema)) for p in listed], ["prog_name", "func_name", "varname"], "line_no", ["pred_name"])
    return x.select("prog_name", "func_name", "varname", F.array_join(F.transform("name_list", lambda e: F.concat(e["src_seq"].cast("string"), F.lit(":"), e["pred_name"])), ",").alias("names"))


def _renamed(body: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        body = f"regexp_replace({body}, '([^a-zA-Z0-9_@]|^)(' || {old} || ')([^a-zA-Z0-9_@])', '\\1' || {new} || '\\3', 'g')"
    return body


_TRUE = [(f"'{v}'", f"coalesce({v}.v, '{v}')") for v in P.VARS.values()] + [(P.placeholder("funcs.f"), f"coalesce(fo.v, {P.placeholder('funcs.f')})"), (f"coalesce({P.placeholder('n1')}, 'none')", f"coalesce(f1.v, {P.placeholder('n1')}, 'none')"), (f"coalesce({P.placeholder('n2')}, 'none')", f"coalesce(f2.v, {P.placeholder('n2')}, 'none')")]
_WITH_TRUE = " ".join(f"left join (select f f_, k k_, v from var_ids) {v} on {v}.f_ = funcs.f and {v}.k_ = '{v}'" for v in P.VARS.values()) + " ".join(f" left join (select f f_, pos p_, v from func_ids) {n} on {n}.f_ = funcs.f and {n}.p_ = {i}" for i, n in enumerate(("fo", "f1", "f2")))
_LISTED = "(k % 4 = 1 or k % 6 = 2)"
_SAID = " || ".join(f"case when {v}.v is not null and ({P.predicted(j)}) is not null and {_LISTED} then ', ''' || {v}.v || ''': ''' || ({P.predicted(j)}) || '''' else '' end" for j, v in P.VARS.items())


@query(f"""with {INGEST}, x as (select funcs.*, {_SAID} s, {_renamed(P.CODE, _TRUE)} body from funcs {_WITH_TRUE} where {_LISTED} and coalesce({", ".join(P.predicted(j) for j in P.VARS)}) is not null)
select split_part(prog, '_', 1) prefix, {P.placeholder("f")} func_name, md5(body) body_md5, '{{' || substr(s, 3) || '}}' predictions from x""".replace("{{", "{").replace("}}", "}"))
def judge_prompts(spark, d):
    """Prompts for a judge: bodies with true names, and predictions by true name, of names listed in either of two layouts."""
    preds = J.in_either(P.scored_names(spark, d).where("varname not like 'sub%'"), P.judge_list(spark, d))
    x = J.judge_prompts(I.functions_of(P.raw_functions(spark, d)), preds)
    return x.select("prefix", "func_name", F.md5("body").alias("body_md5"), "predictions")


@query(f"""with {INGEST}, a as (select distinct split_part(prog, '_', 1) prefix, {P.placeholder("f")} func_name from funcs where {_LISTED} and coalesce({", ".join(P.predicted(j) for j in P.VARS)}) is not null)
select prefix, func_name from a order by prefix, func_name limit 102""")
def judge_order(spark, d):
    """The functions to judge in order of their key, from position 0 to 101, both included; the range is the feature."""
    preds = J.in_either(P.scored_names(spark, d).where("varname not like 'sub%'"), P.judge_list(spark, d))
    return R.positions(J.judge_prompts(I.functions_of(P.raw_functions(spark, d)), preds).select("prefix", "func_name"), ["prefix", "func_name"], 0, 101)


def _judged(side: int) -> str:
    rows = " union all ".join(f"select prog, f, '{P.VARS[j]}' v, {P.truth_var(j)} gt, {P.judge_scores(j, side)[0]} qa, {P.judge_scores(j, side)[1]} qb from fun where k % {3 + side} <> 0 and (k + {j}) % 10 not in (3, 4, 5)" for j in (3, 4))
    # Of placeholders with one true name the last one counts, for whichever block names it; of blocks for one placeholder the last.
    return f"""j{side}a as (select r.prog, r.f, r.v said, r.gt, r.qa, r.qb, (select arg_max(i.k, i.pos) from var_ids i where i.f = r.f and i.v = r.gt) v from ({rows}) r where r.gt is not null),
j{side} as (select prog, f, v, arg_max(gt, said) gt, arg_max(qa, said) qa, arg_max(qb, said) qb from j{side}a where v is not null group by prog, f, v)"""


_ORIGIN = "f.f % 4 <> 0"
JUDGED = f"{INGEST}, {_judged(0)}, {_judged(1)}"


@query(f"""with {JUDGED}, x as (select a.qa aa, a.qb ab, b.qa ba, b.qb bb from j0 a join j1 b using (prog, f, v) where a.gt = b.gt and a.f % 4 <> 0)
select 'a_qa' measure, cast(aa as integer) score, count(*) n from x group by aa union all select 'a_qb', cast(ab as integer), count(*) from x group by ab
union all select 'b_qa', cast(ba as integer), count(*) from x group by ba union all select 'b_qb', cast(bb as integer), count(*) from x group by bb""")
def judge_compare(spark, d):
    """Scores out of all fenced blocks of two judged systems, merged on all they have in common, nulls included, as histograms."""
    truth = Scratch(spark, "judge").save(I.functions_of(P.raw_functions(spark, d)).select("prog_name", "func_name", "var_ids"), "truth")
    records = [P.judge_response(spark, d, s).join(truth, ["prog_name", "func_name"]).withColumn("scored", J.scored_answers("response", "var_ids")) for s in (0, 1)]
    fresh = truth.where("conv(substring(func_name, 5), 16, 10) % 4 <> 0")
    # Categories are null for some programs: nulls meet nulls.
    number = F.regexp_extract("prog_name", "([0-9]+)", 1).cast("int")
    origins = truth.select("prog_name").distinct().select("prog_name", (number % 2 == 0).alias("seen"), F.when(number % 3 > 0, F.lit("tool")).alias("category"), F.lit("x").alias("project"))
    a, b = (J.judged_names(r) for r in records)
    return J.score_histogram(J.compare_judged(a, b, origins, fresh))


def _sides(spark, d, bodies: bool = False):
    """Signed functions of the test programs (every fiftieth customer) and of the training programs; with renamed bodies if those are wanted."""
    functions = I.functions_of(P.raw_functions(spark, d), columns=("body", "var_ids") if bodies else ("var_ids",))
    x = Scratch(spark, "overlap").save(OV.signed(functions, bodies), "signed")
    number = F.regexp_extract("prog_name", "([0-9]+)", 1).cast("int")
    return x.where(number % 50 == 7), x.where(number % 50 != 7)


_SIG = f"""{INGEST}, names as (select f, k s from var_ids union all select f, v from func_ids where pos = 0), sig as (select f, string_agg(s, '#' order by s) sig from names group by f),
sg as (select funcs.prog, funcs.f, coalesce(sig.sig, '') sig, cast(regexp_extract(prog, '([0-9]+)', 1) as integer) % 50 = 7 test from funcs left join sig on sig.f = funcs.f)"""


@query(f"""with {_SIG} select a.prog prog_name, {P.placeholder("a.f")} func_name, b.prog train_prog_name, {P.placeholder("b.f")} train_func_name, cast(100 as integer) name_ratio from sg a join sg b on a.sig = b.sig where a.test and not b.test""")
def overlap_exact(spark, d):
    """Test and training functions of equal signature (sorted placeholders and own true name)."""
    test, train = _sides(spark, d)
    return OV.exact(test, train).select("prog_name", "func_name", "train_prog_name", "train_func_name", "name_ratio")


@query(f"""with {_SIG} select sig, count(*) n from sg where not test group by sig""")
def overlap_groups(spark, d):
    """A2: training functions grouped by signature."""
    return OV.grouped(_sides(spark, d)[1]).select("sig", "n")  # the lists of functions are not drawn where nothing asks for them


@query()
def overlap_candidates(spark, d):
    """Exact pairs and pairs of signatures with a ratio over 90, each once, with the ratio of their renamed bodies. No SQL: a test compares it with all pairs."""
    return OV.candidates(*_sides(spark, d, bodies=True))


@query("""with o as (select page_id, regexp_extract(url, '//([^/:]*)', 1) project, case when page_id % 5 = 0 then null else regexp_extract(url, '//[^/]*/([a-z]+)', 1) end category0 from pages), c as (select *, coalesce(category0, 'unknown') category from o),
w as (select page_id, category, unnest(f) w, unnest(range(len(f))) i from (select page_id, category, list_transform(list_filter(regexp_split_to_array(project, '[^a-zA-Z]'), lambda w: length(w) > 1), lambda w: lower(w)) f from c)),
tr as (select distinct w.w, w.category from w where page_id % 4 = 0), h as (select w.page_id, w.i, bool_or(tr.category = w.category) own from w join tr on tr.w = w.w where page_id % 4 <> 0 group by w.page_id, w.i),
f as (select page_id, arg_min(own, i) own from h group by page_id)
select c.page_id, c.project in (select project from c where page_id % 4 = 0) or coalesce(f.own, false) seen from c left join f on f.page_id = c.page_id where c.page_id % 4 <> 0""")
def project_seen(spark, d):
    """Whether a program's project stands in training: by name, else by the categories of its first fragment found there."""
    host, path = F.regexp_extract("url", "//([^/:]*)", 1), F.regexp_extract("url", "//[^/]*/([a-z]+)", 1)
    x = table(spark, d, "pages").select(F.col("page_id").alias("binary"), host.alias("project"), F.when(F.col("page_id") % 5 != 0, path).alias("category"))
    return O.project_seen(x.where("binary % 4 <> 0"), x.where("binary % 4 = 0")).withColumnRenamed("binary", "page_id")


_DEG = f"""deg as (select f, count(distinct callee) n from said where callee <> f and callee in (select f from fun) group by f), rk as (select funcs.*, coalesce(deg.n, 0) out_degree from funcs left join deg on deg.f = funcs.f)"""
_IDS = """idl as (select f, list(k order by side, pos) ids from (select f, k, pos, 0 side from var_ids union all select f, k, pos, 1 from func_ids) group by f)"""


@query(f"""with {HINTS}, {_DEG}, {_IDS}, t as (select rk.*, case when prog in (select prog from asked) then coalesce(ce.t, '') || coalesce(cs.t, '') else '' end h, idl.ids from rk left join ce on ce.f = rk.f left join cs on cs.f = rk.f left join idl on idl.f = rk.f)
select prog prog_name, {P.placeholder("f")} func_name, out_degree, row_number() over (partition by prog order by out_degree, f) "position",
md5({P.NL} || substr({P.CODE}, 1, 200) || case when h = '' then '' else {P.NL} || h end || {P.NL} || {P.NL} || {P.NL} || {P.NL} || 'Q:[' || array_to_string(list_transform(ids[1:3], lambda i: i || ','), '') || ']A') prompt_md5 from t""")
def ordered_prompts(spark, d):
    """Prompts with hints, bodies cut at 200 characters and three ids at most, in each program by rising out-degree, then as the functions stand."""
    functions = Scratch(spark, "prompts").save(I.functions_of(P.raw_functions(spark, d)), "functions")
    edges = call_edges(spark, d)
    degree = edges.groupBy("prog_name", F.col("caller").alias("func_name")).agg(F.count(F.lit(1)).alias("out_degree"))
    x = functions.join(degree, ["prog_name", "func_name"], "left").na.fill(0, ["out_degree"])
    x = x.join(context_hints(spark, d), ["prog_name", "func_name"], "left")
    ids = F.transform(F.concat("var_ids", "func_ids"), lambda e: e["k"])
    place = F.row_number().over(W.partitionBy("prog_name").orderBy("out_degree", "func_seq")).cast("long")
    return x.select("prog_name", "func_name", "out_degree", place.alias("position"), F.md5(A.render_prompt("body", ids, "hints", max_body=200, max_ids=3)).alias("prompt_md5"))


@query(f"""with {HINTS} select case when k % 7 <> 0 and coalesce({", ".join(P.predicted(j) for j in P.VARS)}, {P.PREDICTED_OWN}, {P.PREDICTED_N1}) is not null then 'infer' else 'gt' end source, count(*) n from enough group by 1""")
def hint_statistics(spark, d):
    """From where names come for the hints of training, over all programs: predictions, else the truth."""
    functions = Scratch(spark, "statistics").save(I.functions_of(P.raw_functions(spark, d)), "functions")
    names = H.names_for_training(functions, H.predicted_names(P.scored_names(spark, d).where("floor(line_no / 6) % 7 <> 0")))
    return H.source_statistics(with_facts(functions.select("prog_name", "func_name", "body")), names)


@query(f"""with {SCORED} select prog prog_name, {P.placeholder("f")} func_name, id varname, string_agg(pos || ':' || name, ',' order by pos) names from said_ group by prog, f, id""")
def recovery_rounds(spark, d):
    """The loop of asking, scoring and drawing hints in three rounds, with a table of answers in the model's place."""
    scratch = Scratch(spark, "loop")
    functions = scratch.save(I.functions_of(P.raw_functions(spark, d)), "functions")
    parsed = scratch.save(with_facts(functions.select("prog_name", "func_name", "func_seq", "body")).drop("ir"), "parsed")
    edges, answers = scratch.save(call_edges(spark, d), "edges"), P.model_answers(spark, d)

    def ask(prompts, i):
        return prompts.select("prog_name", "func_name").join(answers.withColumn("answers", F.filter("answers", lambda a: a["pos"] == i)), ["prog_name", "func_name"])

    x = RO.recover(functions, parsed, edges, ask, P.ANSWERS)
    return x.select("prog_name", "func_name", "varname", F.array_join(F.transform("name_list", lambda e: F.concat(e["src_seq"].cast("string"), F.lit(":"), e["pred_name"])), ",").alias("names"))
