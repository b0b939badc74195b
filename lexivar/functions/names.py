"""Name predicates, renaming, tokenising and scoring (all native column expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions without a name worth recovering.
UNINTERESTING_FUNCTIONS = (
    "__libc_csu_init", "__libc_csu_fini", "_start", "__libc_start_main", "__gmon_start__", "__cxa_finalize", "__cxa_atexit",
    "frame_dummy", "_dl_relocate_static_pie", "deregister_tm_clones", "register_tm_clones", "nullsub", "nullsub_1", ".init_proc",
)
TRIVIAL_NAMES = ("i", "j", "k", "ret")
DUMMY_AT_INGEST = r"^[va][0-9]+"
DUMMY_AT_EVALUATION = r"^(v\d+|a\d+|[_0-9]+)\b"
# \W is [^a-zA-Z0-9_] as one class: a union of ranges is several times slower.
MENTION = r"(\W|^)({}[0-9a-fA-F_]*)\W"
# Decompiler types and calling conventions, and what they are replaced by, in order.
GHIDRA_TYPES = {
    "undefined8": "long", "undefined4": "int", "undefined2": "short", "undefined1": "char", "undefined": "char",
    "code": "void", "byte": "char", "word": "short", "dword": "int", "qword": "long",
}
IDA_TYPES = {
    "__int64": "long", "__int32": "int", "__int16": "short", "__int8": "char", "_QWORD": "long", "_DWORD": "int", "_WORD": "short", "_BYTE": "char",
    "QWORD": "long", "DWORD": "int", "WORD": "short", "BYTE": "char", "__fastcall": "", "__cdecl": "", "__stdcall": "", "__thiscall": "", "__noreturn": "",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interesting_function(name) -> Column:
    n = col(name)
    return F.coalesce(~n.isin(*UNINTERESTING_FUNCTIONS) & ~n.rlike(r"^(\.|__)"), F.lit(False))


def long_enough(code, lines: int = 4) -> Column:
    return F.size(F.split(col(code), "\n")) >= lines


def dummy_name(name, evaluation: bool = False) -> Column:
    n = col(name)
    return (F.trim(n) == "") | n.rlike(DUMMY_AT_EVALUATION if evaluation else DUMMY_AT_INGEST)


def trivial_name(name) -> Column:
    return col(name).isin(*TRIVIAL_NAMES)


def interesting_name(name, evaluation: bool = False) -> Column:
    return ~dummy_name(name, evaluation) & ~trivial_name(name)


def _quoted(value: Column) -> Column:
    """The replacement as it stands: backslashes and dollar signs have no meaning in it."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def rename(code, old, new) -> Column:
    """Replaces a delimited name. A match takes its delimiters along, so of two occurrences one character apart the second stays."""
    pattern = F.concat(F.lit(r"([^\w@]|^)("), col(old), F.lit(r")([^\w@])"))
    return F.regexp_replace(col(code), pattern, F.concat(F.lit("$1"), _quoted(col(new)), F.lit("$3")))


def rename_all(code, pairs, keep: Column | None = None, max_len: int | None = None) -> Column:
    """Left fold of rename() over an array of (k, v) in order; ids in `keep` stay; max_len cuts after each step."""

    def step(text: Column, e: Column) -> Column:
        out = rename(text, e["k"], e["v"])
        if max_len is not None:
            out = F.substring(out, 1, max_len)
        return out if keep is None else F.when(F.array_contains(keep, e["k"]), text).otherwise(out)

    return F.aggregate(col(pairs), col(code), step)


def sanitize_types(code, types: dict[str, str] = IDA_TYPES) -> Column:
    """Every type in turn, where the text holds it at all; pass GHIDRA_TYPES | IDA_TYPES for the other decompiler."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in types.items()])
    return F.aggregate(pairs, col(code), lambda c, e: F.when(F.contains(c, e["k"]), rename(c, e["k"], e["v"])).otherwise(c))


def mentions(code, prefix: str = "sub_") -> Column:
    return F.regexp_extract_all(col(code), F.lit(MENTION.format(prefix)), F.lit(2))


def split_words(name) -> Column:
    """Letters only, split before capitals, runs of single letters merged, lower case."""
    c = F.regexp_replace(col(name), r"[^\p{L}]", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(\p{Lu})", " $1"), " +", " "))
    c = F.regexp_replace(c, r"(?<=(?:^| )\p{L}) (?=\p{L}(?: |$))", "")
    return F.lower(F.trim(c))


def tokenize(name) -> Column:
    return F.filter(F.split(split_words(name), " "), lambda x: x != "")


def same_token(gt: Column, pred: Column) -> Column:
    """Equal, or the shorter (two characters at least) begins or ends the longer."""
    lo, hi = F.when(F.length(gt) <= F.length(pred), gt).otherwise(pred), F.when(F.length(gt) <= F.length(pred), pred).otherwise(gt)
    return (gt == pred) | ((F.length(lo) >= 2) & (F.startswith(hi, lo) | F.endswith(hi, lo)))


def same_token_by_edits(gt: Column, pred: Column) -> Column:
    """Equal, one begins the other, or the same first letter and an edit distance under a third of the longer."""
    longer = F.greatest(F.length(gt), F.length(pred))
    near = (F.substring(gt, 1, 1) == F.substring(pred, 1, 1)) & (F.levenshtein(gt, pred) / longer < 1 / 3)
    return (gt == pred) | F.startswith(gt, pred) | F.startswith(pred, gt) | near


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def score_name(gt, pred, same=same_token) -> Column:
    """struct(precision, recall): distinct matched tokens over the number of tokens; equal names 1, no tokens 0."""

    def of_tokens(x: Column) -> Column:
        part = lambda a, b, f: F.size(F.array_distinct(F.filter(a, lambda t: F.exists(b, lambda u: f(t, u))))) / F.size(a)
        empty = (F.size(x["g"]) == 0) | (F.size(x["p"]) == 0)
        precision, recall = part(x["p"], x["g"], lambda t, u: same(u, t)), part(x["g"], x["p"], same)
        return F.struct(F.when(empty, 0.0).otherwise(precision).alias("precision"), F.when(empty, 0.0).otherwise(recall).alias("recall"))

    def of_names(x: Column) -> Column:
        whole = F.struct(F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"))
        return F.when(x["g"] == x["p"], whole).otherwise(let(F.struct(tokenize(x["g"]).alias("g"), tokenize(x["p"]).alias("p")), of_tokens))

    return let(F.struct(F.lower(col(gt)).alias("g"), F.lower(col(pred)).alias("p")), of_names)


def f1(p, r) -> Column:
    p, r = col(p), col(r)
    return F.when(p + r < 0.001, 0.0).otherwise(2 * p * r / (p + r))


def project_fragments(project) -> Column:
    return F.transform(F.filter(F.split(col(project), "[^a-zA-Z]"), lambda x: F.length(x) > 1), F.lower)


def rekey_address(name, width: int = 16, upper: bool = True) -> Column:
    value = F.conv(F.element_at(F.split(col(name), "_"), 2), 16, 10).cast("bigint")
    return F.format_string(f"%0{width}{'X' if upper else 'x'}", value)


def overlap_program(prog) -> Column:
    """The program of an overlap list: its prefix, only where the name has jsonl in it."""
    p = col(prog)
    return F.when(F.contains(p, F.lit("jsonl")), program_prefix(p)).otherwise(p)


def overlap_function(func, prefix: str = "sub_") -> Column:
    """The function of an overlap list: its address in 16 digits, only where the name has the prefix in it."""
    f = col(func)
    return F.when(F.contains(f, F.lit(prefix)), rekey_address(f)).otherwise(f)


def signature(ids, own_name) -> Column:
    return F.array_join(F.array_sort(F.concat(col(ids), F.array(col(own_name)))), "#")


def program_prefix(prog) -> Column:
    return F.substring_index(col(prog), "_", 1)


def strip_characters(text, characters: str) -> Column:
    return F.regexp_replace(col(text), f"^[{re.escape(characters)}]+", "")


def body_of_prompt(prompt) -> Column:
    return F.trim(F.substring_index(col(prompt), "\n\n\nQ:", 1))


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rename_plain(code, old, new) -> Column:
    """rename() with @ as a delimiter too."""
    pattern = F.concat(F.lit(r"(\W|^)("), col(old), F.lit(r")(\W)"))
    return F.regexp_replace(col(code), pattern, F.concat(F.lit("$1"), _quoted(col(new)), F.lit("$3")))


# What a demangled function or operator looks like; the second group is its bare name.
DEMANGLED_FUNCTION = r"^.*([^0-9A-Za-z_~]|^)([~0-9a-zA-Z_]+)(<.*>)?(\[abi.*\])?\(.*\)"
DEMANGLED_OPERATOR = r"^.*([^0-9A-Za-z_~]|^)(operator ?[^0-9a-zA-Z_]+|new|new\[\]|delete|delete\[\])(<.*>)?(\[abi.*\])?\(.*\)"


def bare_name(text, otherwise) -> Column:
    """The bare name in a demangled signature; `otherwise` where there is none."""
    t = col(text)
    found = F.when(t.rlike(DEMANGLED_FUNCTION), F.regexp_extract(t, DEMANGLED_FUNCTION, 2)).when(t.rlike(DEMANGLED_OPERATOR), F.regexp_extract(t, DEMANGLED_OPERATOR, 2))
    return F.coalesce(found, otherwise)


def demangled(name) -> Column:
    """The bare name of a mangled C++ name whose parts are spelt out: _Z, then nested or single names with their lengths. A suffix _0 to _3 is dropped first where the
    name is mangled. Names that are not mangled, and forms beyond that (templates, operators, substitutions), stay as they are."""
    n = col(name)
    short = F.regexp_replace(n, r"_[0-3]$", "")
    rest = F.regexp_replace(short, r"^_ZN?K?", "")
    # Takes one length and name after the other; the state is (what is left, the last name, whether a form was met that is not covered).
    state = F.struct(rest.alias("left"), F.lit("").alias("last"))

    def part(s: Column, _: Column) -> Column:
        size = F.regexp_extract(s["left"], r"^([0-9]{1,3})", 1)
        n_ = F.when(size == "", 0).otherwise(size.cast("int"))
        taken = F.substring(s["left"], F.length(size) + 1, n_)
        return F.when((size != "") & (F.length(taken) == n_), F.struct(F.substring(s["left"], F.length(size) + 1 + n_, F.length(s["left"])).alias("left"), taken.alias("last"))).otherwise(s)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(12)), state, part)
    nested = n.startswith("_ZN")
    covered = n.startswith("_Z") & (last["last"] != "") & F.when(nested, last["left"].rlike("^E")).otherwise(~last["left"].rlike("^(I|[0-9])"))
    # Names that are not mangled, which most are, are told apart first: the parts of a conjunction may be worked out all the same.
    return F.when(n.startswith("_Z"), F.when(covered, last["last"]).otherwise(n)).otherwise(n)


def lemmatised(tokens, lexicon) -> Column:
    """Tokens with the words of lexicon, a map column of word to lemma, replaced; others stay."""
    return F.transform(col(tokens), lambda t: F.coalesce(F.try_element_at(col(lexicon), t), t))


def pieces(tokens, known) -> Column:
    """Each token cut into the longest known pieces from its left, character by character where none fits; `known` is an array column of pieces of at most 16 characters."""
    k = col(known)

    def cut(token: Column) -> Column:
        start = F.struct(token.alias("left"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, _: Column) -> Column:
            sizes = F.filter(F.sequence(F.least(F.length(s["left"]), F.lit(16)), F.lit(1)), lambda n: F.array_contains(k, F.substring(s["left"], F.lit(1), n)))
            n = F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(1))
            return F.when(F.length(s["left"]) == 0, s).otherwise(F.struct(F.substring(s["left"], n + 1, F.length(s["left"])).alias("left"), F.concat(s["out"], F.array(F.substring(s["left"], F.lit(1), n))).alias("out")))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), start, step)["out"]

    return F.flatten(F.transform(col(tokens), cut))


def same_cluster(clusters) -> callable:
    """A comparison that also takes words that share a cluster; `clusters` is a map column of word to cluster ids."""
    c = col(clusters)
    return lambda gt, pred: same_token(gt, pred) | F.coalesce(F.arrays_overlap(F.try_element_at(c, gt), F.try_element_at(c, pred)), F.lit(False))


#: Vocabulary entries in which a quote meets a letter or digit, or a colon a blank, so that texts cannot be cut at quotes.
QUOTE_PATTERNS = (r"'[0-9a-zA-Z]", r"[0-9a-zA-Z]'", ":{}")


def awkward_entry(token, blank: str = " ") -> Column:
    t = col(token)
    return t.rlike(QUOTE_PATTERNS[0]) | t.rlike(QUOTE_PATTERNS[1]) | F.contains(t, F.lit(QUOTE_PATTERNS[2].format(blank)))
